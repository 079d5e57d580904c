"""Descriptions of any range of months from stored summaries.

Each month and metric has one row: count, mean, sum of squared deviations,
smallest, largest, and a KLL sketch of the values. All of them merge, so a range
is described from its months' rows alone, and a new month adds rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.operators.quantiles import known

QUARTILES = (0.25, 0.5, 0.75)

#: Size parameter of the sketches.
SIZE = 800


def rank_error(size: int = SIZE) -> float:
    """Share of the rows by which a quantile's rank is off, at most: twice the
    sketch's published 99 per cent bound, or some five standard deviations."""
    return 2 * 2.296 / size**0.9723


def month_summaries(df: DataFrame, columns: Sequence[str], month: Column, size: int = SIZE) -> DataFrame:
    """One row per month and metric with known values; all columns in one pass."""

    def summary(c: str) -> Column:
        v = known(c)
        return F.struct(
            F.lit(c).alias("metric"),
            F.count(v).alias("count"),
            F.avg(v).alias("mean"),
            (F.var_pop(v) * F.count(v)).alias("spread"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.kll_sketch_agg_double(v, F.lit(size)).alias("sketch"),
        ).alias(c)

    rows = df.withColumn("_month", month).where("_month IS NOT NULL").groupBy("_month").agg(*[summary(c) for c in columns])
    return rows.select(F.col("_month").alias("month"), F.inline(F.array(*[F.col(f"`{c}`") for c in columns]))).where("count > 0")


def describe_months(summaries: DataFrame, first, last, probs: Sequence[float] = QUARTILES) -> DataFrame:
    """count, mean, std, min, quantiles (``p25`` ...) and max per metric over the
    months ``first`` to ``last``. A quantile's rank is within ``rank_error``."""
    months = summaries.where(F.col("month").between(F.lit(first), F.lit(last)))
    merged = months.groupBy("metric").agg(
        F.sum("count").alias("count"),
        F.try_divide(F.sum(F.col("count") * F.col("mean")), F.sum("count")).alias("mean"),
        F.sum("spread").alias("_within"),
        F.sum(F.col("count") * F.col("mean") * F.col("mean")).alias("_squares"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch").alias("_sketch"),
    )
    between = F.greatest(F.col("_squares") - F.col("count") * F.col("mean") * F.col("mean"), F.lit(0.0))
    std = F.sqrt(F.try_divide(F.col("_within") + between, F.col("count") - 1)).alias("std")
    quantiles = [F.kll_sketch_get_quantile_double("_sketch", F.lit(float(p))).alias(f"p{round(p * 100)}") for p in probs]
    return merged.select("metric", "count", "mean", std, "min", *quantiles, "max")


def ranks_of(df: DataFrame, described: DataFrame, columns: Sequence[str], probs: Sequence[float] = QUARTILES) -> DataFrame:
    """Largest distance, per metric, of a quantile's rank in ``df`` from the one
    asked for: one pass with a count below and up to each value. ``described``
    has one row per metric, which the driver reads."""
    values = {r["metric"]: r for r in described.collect()}
    off = []
    for c in columns:
        v = known(c)
        n = F.count(v)
        for p in probs if c in values else ():
            q = F.lit(values[c][f"p{round(p * 100)}"])
            low, high = F.try_divide(F.count_if(v < q), n), F.try_divide(F.count_if(v <= q), n)
            off.append(F.struct(F.lit(c).alias("metric"), F.greatest(low - p, p - high, F.lit(0.0)).alias("off")).alias(f"o{len(off)}"))
    found = df.agg(*off).select(F.inline(F.array(*[F.col(f"o{k}") for k in range(len(off))])))
    return found.groupBy("metric").agg(F.max("off").alias("off"))
