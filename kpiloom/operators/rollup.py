"""Grouped aggregations over any fact table.

Sums, means, counts, minima and maxima are all algebraic: Spark combines them
on the map side, so a key that holds a third of the rows sends one partial row
per map task and group. Nothing here gathers the rows of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.functions import month_start, quarter_start, safe_divide, week_start
from kpiloom.operators.quantiles import known

GRAINS = {
    "Week": week_start,
    "Month": month_start,
    "Quarter": quarter_start,
    "Year": lambda d: F.year(d).cast("long"),
    "Quarter_No": lambda d: F.quarter(d).cast("long"),
}

def _known(c: Column) -> Column:
    """NaN counts as missing in sums and means."""
    return F.when(~F.isnan(c), c)


AGGREGATES = {
    "sum": lambda c: F.sum(_known(c)),
    "mean": lambda c: F.avg(_known(c)),
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "any": F.bool_or,
}

# Measure -> aggregate of the published rollups.
BASIC_MEASURES = {
    "Produced_Units": "sum",
    "Good_Units": "sum",
    "Sales_Units": "sum",
    "Returned_Units": "sum",
    "Revenue": "sum",
    "COGS": "sum",
    "Expenses": "sum",
    "Profit": "sum",
    "Material_kg": "sum",
    "Customer_Acquisition": "sum",
    "NPS": "mean",
    "Employee_Satisfaction": "mean",
    "Downtime_hours": "sum",
    "Defect_Rate": "mean",
}
RICH_MEASURES = {
    "Produced_Units": "sum",
    "Good_Units": "sum",
    "Sales_Units": "sum",
    "Returned_Units": "sum",
    "Revenue": "sum",
    "COGS": "sum",
    "Marketing_Spend": "sum",
    "Logistics_Cost": "sum",
    "Other_Expenses": "sum",
    "Profit": "sum",
    "Raw_Material_Cost": "sum",
    "Acquisition": "sum",
    "NPS": "mean",
    "Employee_Satisfaction": "mean",
    "Downtime_hours": "sum",
    "Defect_Rate": "mean",
    "Inventory": "mean",
    "Backorder": "sum",
}
OPERATIONS_MEASURES = {
    "Produced_Units": "sum",
    "Good_Units": "sum",
    "Sales_Units": "sum",
    "Revenue": "sum",
    "COGS": "sum",
    "Profit": "sum",
    "Lead_Time_days": "mean",
    "Efficiency_u_per_h": "mean",
    "Inventory": "mean",
}
QUALITY_MEASURES = {
    "Produced_Units": "sum",
    "Good_Units": "sum",
    "Sales_Units": "sum",
    "Revenue": "sum",
    "COGS": "sum",
    "Profit": "sum",
    "Lead_Time_days": "mean",
    "Efficiency_u_per_h": "mean",
    "Inventory": "mean",
    "Defect_Rate": "mean",
    "Downtime_hours": "mean",
    "Raw_Material_Cost": "sum",
    "Employee_Satisfaction": "mean",
    "NPS": "mean",
}
SALES_MEASURES = {
    "Sales_Units": "sum",
    "Revenue": "sum",
    "Profit": "sum",
    "Lead_Time_days": "mean",
    "Defect_Rate": "mean",
}
PERIOD_MEASURES = {
    "Produced_Units": "sum",
    "Sales_Units": "sum",
    "Revenue": "sum",
    "Lead_Time_days": "mean",
    "Efficiency_u_per_h": "mean",
}


def measure_columns(measures: Mapping[str, str]) -> list[Column]:
    return [AGGREGATES[how](F.col(name)).alias(name) for name, how in measures.items()]


def rollup(df: DataFrame, keys: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    """Group by ``keys``; rows with a null key are dropped."""
    kept = df.dropna(subset=list(keys)) if keys else df
    return kept.groupBy(*keys).agg(*measure_columns(measures))


def calendar_rollup(
    df: DataFrame,
    grain: str,
    measures: Mapping[str, str],
    keys: Sequence[str] = (),
    date: str = "Date",
) -> DataFrame:
    """Rollup by a calendar bucket (a key of ``GRAINS``) and further keys."""
    return rollup(df.withColumn(grain, GRAINS[grain](F.col(date))), [grain, *keys], measures)


def latest_period(df: DataFrame, period: str) -> DataFrame:
    """Rows of the last period present."""
    return df.where(F.col(period) == df.agg(F.max(period)).scalar())


def latest_year_table(yearly: DataFrame, year: str = "Year") -> DataFrame:
    """Latest year's products with the profit margin."""
    return latest_period(yearly, year).withColumn("Profit_Margin", safe_divide("Profit", "Revenue"))


def share_of_total(df: DataFrame, value: str, name: str = "Share") -> DataFrame:
    """``value`` over its total; the total is one scalar, not a window."""
    return df.withColumn(name, safe_divide(F.col(value), df.agg(F.sum(value)).scalar()))


def last_per_group(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Last known value of each column in ``order`` within a group."""
    return df.groupBy(key).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    )


def weekly_targets(
    df: DataFrame, key: str = "Product_ID", value: str = "Sales_Units", uplift: float = 1.05, rounding: str = "half_even"
) -> DataFrame:
    """Integer target per entity: mean times uplift, half-even or truncated."""
    return df.groupBy(key).agg(target_of(value, uplift, rounding).alias("Weekly_Target"))


def target_of(value: str, uplift: float, rounding: str) -> Column:
    """The target as an aggregate."""
    mean = F.avg(value) * uplift
    return (F.bround(mean, 0) if rounding == "half_even" else mean).cast("long")


def regrid_weekly(df: DataFrame, keys: Sequence[str], measures: Mapping[str, str]) -> DataFrame:
    """One row per entity and week, using only the measures the table has."""
    return rollup(df, keys, {c: how for c, how in measures.items() if c in df.columns})


def mean_with_interval(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean per group with the normal 95 % interval."""
    half = 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.dropna(subset=[key]).groupBy(key).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        (F.avg(value) - half).alias("low"),
        (F.avg(value) + half).alias("high"),
    )


#: Modulus of the bootstrap's draws, a prime.
PRIME = (1 << 31) - 1

#: Draws from here on up weigh 1, 2, ... by the Poisson distribution of mean 1.
POISSON = tuple(round(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10))

#: Replicate weights computed at once, and groups that a task holds.
_WEIGHTS = 1 << 21
_GROUPS = 256


def _draws(row_key: Sequence[str], seed: int) -> tuple[Column, Column]:
    """Two numbers of a row, from a digest of its key: the draw for replicate r
    is (first + r * second) modulo PRIME."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(f"`{c}`").cast("string") for c in row_key]).cast("binary"))
    parts = [F.conv(F.substring(digest, start, 8), 16, 10).cast("long") for start in (1, 9)]
    return F.pmod(parts[0], F.lit(PRIME)), F.pmod(parts[1], F.lit(PRIME - 1)) + 1


def mean_with_bootstrap(df: DataFrame, key: str, value: str, row_key: Sequence[str], replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Mean per group with a bootstrap 95 % interval over rows.

    A replicate draws every row with a Poisson(1) weight, which depends on the
    row's key, the replicate's number and the seed alone: any order, partitioning
    or retry gives the same interval. A task adds its rows to one array of
    ``replicates`` sums and counts per group; these arrays are what is shuffled.
    Missing values are left out; a group without known values has nulls.
    """
    first, second = _draws(row_key, seed)
    rows = df.dropna(subset=[key]).select(F.col(f"`{key}`").alias("key"), known(value).alias("value"), first.alias("a"), second.alias("b"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        numbers = np.arange(replicates, dtype=np.int64)

        def drained() -> pa.RecordBatch:
            columns = [pa.array([v[k].tolist() for v in held.values()], t) for k, t in ((0, pa.list_(pa.float64())), (1, pa.list_(pa.int64())))]
            return pa.RecordBatch.from_arrays([pa.array(list(held), names_type), *columns], names=["key", "sums", "counts"])

        for batch in batches:
            names_type = batch.schema.field(0).type
            batch = batch.filter(batch.column(1).is_valid())
            codes = batch.column(0).dictionary_encode()
            values, a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            at = codes.indices.to_numpy(zero_copy_only=False)
            for code, name in enumerate(codes.dictionary.to_pylist()):
                mine = np.flatnonzero(at == code)
                sums, counts = held.setdefault(name, (np.zeros(replicates), np.zeros(replicates, np.int64)))
                for start in range(0, len(mine), max(1, _WEIGHTS // replicates)):
                    part = mine[start : start + max(1, _WEIGHTS // replicates)]
                    draws = (a[part, None] + b[part, None] * numbers) % PRIME
                    weights = np.searchsorted(POISSON, draws, side="right")
                    sums += values[part] @ weights
                    counts += weights.sum(axis=0)
                if len(held) >= _GROUPS:
                    yield drained()
                    held = {}
        if held:
            yield drained()

    parts = rows.mapInArrow(run, f"key {kind}, sums array<double>, counts array<long>")
    drawn = parts.select("key", F.posexplode(F.arrays_zip("sums", "counts")).alias("replicate", "part"))
    means = drawn.groupBy("key", "replicate").agg(F.try_divide(F.sum("part.sums"), F.sum("part.counts")).alias("mean"))
    ends = means.groupBy("key").agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("ends"))
    whole = rows.groupBy("key").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    out = whole.join(ends, "key", "left")
    return out.select(F.col("key").alias(key), "n", "mean", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"))
