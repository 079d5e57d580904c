"""Joins: targets, spines, top-key semi-joins, calendar grids.

Hints are given only for tables with a fixed row bound. Everything else is
left to the optimizer, which broadcasts a side only when its size is known to
be small and otherwise shuffles, with adaptive execution splitting hot keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kpiloom.functions import week_end


def add_lookup(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join of a derived table that has one row per key."""
    return df.join(lookup, key, "left")


def align_to_spine(df: DataFrame, spine: DataFrame, keys: Sequence[str], fill: float = 0) -> DataFrame:
    """One row per spine key; measures without a match become ``fill``."""
    measures = [c for c in df.columns if c not in keys]
    return spine.join(df, list(keys), "left").fillna(fill, subset=measures)


def top_keys(totals: DataFrame, key: str, measure: str, n: int) -> DataFrame:
    """The ``n`` entities with the largest measure, ties by id."""
    return totals.orderBy(F.desc(measure), F.asc(key)).limit(n)


def keep_top(df: DataFrame, totals: DataFrame, key: str, measure: str, n: int) -> DataFrame:
    """Rows of the top ``n`` entities. The broadcast side has ``n`` rows."""
    top = top_keys(totals, key, measure, n).select(key)
    return df.join(F.broadcast(top), key, "left_semi")


def add_first_period(df: DataFrame, key: str, period: str, name: str) -> DataFrame:
    """First period per key by aggregate and join: fit for raw rows of any skew.

    The aggregate combines on the map side, so a hot key costs one row per
    task, and the join's hot partitions are split at run time.
    """
    first = df.groupBy(key).agg(F.min(period).alias(name))
    return df.join(first, key)


def bounds(df: DataFrame, date: str) -> tuple[Column, Column]:
    """First and last date as scalar subqueries."""
    return df.agg(F.min(date)).scalar(), df.agg(F.max(date)).scalar()


def calendar_grid(entities: DataFrame, first: Column, last: Column, date: str = "Date", days: int = 7) -> DataFrame:
    """Every entity with every calendar step.

    Each entity row expands its own calendar, so no join is needed and the work
    follows the partitioning of ``entities``.
    """
    step = F.make_dt_interval(F.lit(days))
    return entities.withColumn(date, F.explode(F.sequence(first, last, step)))


def resample_weekly(
    df: DataFrame, keys: Sequence[str], date: str, value: str, name: str | None = None
) -> DataFrame:
    """Weekly sums with Sunday labels; empty weeks between the first and the
    last of an entity count as 0.

    Each week expands up to the next known one, so the gaps are filled without
    building a calendar and joining it back.
    """
    name = name or value
    binned = df.groupBy(*keys, week_end(date).alias("_week")).agg(F.sum(value).alias("_sum"))
    following = F.lead("_week").over(W.partitionBy(*keys).orderBy("_week"))
    spans = binned.withColumn("_until", F.coalesce(F.date_sub(following, 7), F.col("_week")))
    filled = spans.withColumn("Week_End", F.explode(F.sequence("_week", "_until", F.make_dt_interval(F.lit(7)))))
    amount = F.when(F.col("Week_End") == F.col("_week"), F.coalesce("_sum", F.lit(0))).otherwise(0)
    return filled.select(*keys, "Week_End", amount.alias(name))


def fill_weeks(weekly: DataFrame, keys: Sequence[str], date: str, zero: Sequence[str]) -> DataFrame:
    """Weekly rows with every week between an entity's first and last: in added
    weeks the columns ``zero`` are 0 and the others null."""
    following = F.lead(date).over(W.partitionBy(*keys).orderBy(date))
    spans = weekly.withColumn("_until", F.coalesce(F.date_sub(following, 7), F.col(date)))
    spread = spans.withColumn("_at", F.explode(F.sequence(date, "_until", F.make_dt_interval(F.lit(7)))))
    added = F.col("_at") != F.col(date)
    others = [c for c in weekly.columns if c not in (*keys, date)]
    filled = [F.when(added, F.lit(0 if c in zero else None)).otherwise(F.col(c)).alias(c) for c in others]
    return spread.select(*keys, F.col("_at").alias(date), *filled)


def future_weeks(
    weekly: DataFrame, keys: Sequence[str], horizon: int, week: str = "Week_Index", date: str = "Date"
) -> DataFrame:
    """The ``horizon`` weeks after each entity's last one."""
    last = weekly.groupBy(*keys).agg(F.max(week).alias("_week"), F.max(date).alias("_date"))
    steps = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(
        *keys,
        (F.col("_week") + F.col("step")).cast("long").alias(week),
        F.date_add(F.col("_date"), F.col("step") * 7).alias(date),
    )


def with_known_regressors(
    future: DataFrame, regressors: DataFrame, keys: Sequence[str], columns: Mapping[str, float]
) -> DataFrame:
    """Attach regressor columns by key; unknown ones take the given value."""
    known = regressors.select(*keys, *columns)
    return future.join(known, list(keys), "left").fillna(dict(columns))
