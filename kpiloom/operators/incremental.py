"""A written product-week table that new weeks extend.

``weeks`` holds every row with its rolling means, changes and lags, partitioned
by month. ``state`` holds each product's last ``DEPTH`` rows and those that a
later row may still change, the number of its rows and the sum of its sales, as
of a date. An extension computes the new rows
from the state alone and rewrites only the months it touches; the written rows
of other months are neither read nor written. The target, which moves with the
mean of all weeks, is computed from the state when the table is read.

If an extension fails, run it again: the months it has written are written once
more with the same rows, and the state is replaced last.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kpiloom.functions import target_achieved
from kpiloom.operators.growth import add_lags, weekly_history
from kpiloom.session import checkpointed

#: Rows that the longest change looks back.
DEPTH = 52

LAGS = (1, 2, 3, 4, 13)


def _history(rows: DataFrame, key: str, date: str, value: str, lags: Sequence[int]) -> DataFrame:
    return add_lags(weekly_history(rows, key, date), [key], date, value, lags)


def _names(lags: Sequence[int]) -> list[str]:
    return [f"lag_{n}" for n in lags]


def _unknown(names: Sequence[str]) -> Column:
    """Some lag of the row is not known yet: a later row may give it."""
    return reduce(or_, (F.col(c).isNull() for c in names))


def _write_state(rows: DataFrame, path: str, key: str, date: str, lags: Sequence[int]) -> None:
    """``rows`` have ``_n``, ``_total`` and ``_known``; a product's last ``DEPTH``
    stay, and those before with an unknown lag. The date is that of the last row
    of all."""
    latest_first = W.partitionBy(key).orderBy(F.desc(date))
    recent = F.row_number().over(latest_first) <= DEPTH
    kept = rows.withColumn("_recent", recent).where(F.col("_recent") | _unknown(_names(lags))).drop("_recent")
    as_of = rows.agg(F.max(date)).first()[0]
    if as_of is not None:
        kept.write.mode("overwrite").parquet(f"{path}/state/as_of={as_of.isoformat()}")


def _state(spark: SparkSession, path: str) -> DataFrame:
    """The latest state. The dates are folder names, so none but its files is read."""
    states = spark.read.parquet(f"{path}/state")
    return states.where(F.col("as_of") == F.lit(states.agg(F.max("as_of")).first()[0])).drop("as_of")


def write_series(
    fact: DataFrame, path: str, key: str = "Product_ID", date: str = "Date", month: str = "Month", value: str = "Sales_Units", lags: Sequence[int] = LAGS
) -> None:
    """Write the table new. Rows without a key or a date are left out."""
    rows = checkpointed(_history(fact.dropna(subset=[key, date]), key, date, value, lags))
    rows.write.partitionBy(month).parquet(f"{path}/weeks")
    totals = rows.groupBy(key).agg(F.count("*").alias("_n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("_total"), F.count(value).alias("_known"))
    _write_state(rows.join(totals, key), path, key, date, lags)


def extend_series(
    new: DataFrame, path: str, key: str = "Product_ID", date: str = "Date", month: str = "Month", value: str = "Sales_Units", lags: Sequence[int] = LAGS
) -> None:
    """Add ``new`` rows, each later than its product's last written one.

    Besides the new rows only those with an unknown lag can change: leading gaps
    take the next known lag.
    """
    spark = new.sparkSession
    state = checkpointed(_state(spark, path))
    counted = ["_n", "_total", "_known"]
    counters = state.groupBy(key).agg(F.max(date).alias("_last"), *[F.max(c).alias(c) for c in counted])
    added = checkpointed(new.dropna(subset=[key, date]))
    late = added.join(counters, key).where(F.col(date) <= F.col("_last")).select(key, date).limit(3).collect()
    if late:
        raise ValueError(f"weeks that are written already: {', '.join(f'{r[0]} {r[1]}' for r in late)}")
    found = [c for c in state.columns if c not in (*counted, *new.columns)]
    stored = state.select(*new.columns, *[F.col(c).alias(f"_old_{c}") for c in found], F.lit(False).alias("_new"))
    context = stored.unionByName(added.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    context = context.join(counters.drop("_last"), key, "left").fillna(0, counted)
    names = _names(lags)
    kept = {c: F.when(F.col("_new"), F.col(c)).otherwise(F.coalesce(f"_old_{c}", c) if c in names else F.col(f"_old_{c}")) for c in found}
    learnt = reduce(or_, (F.col(f"_old_{c}").isNull() & F.col(c).isNotNull() for c in names))
    computed = _history(context, key, date, value, lags).withColumns(kept).withColumn("_changed", F.col("_new") | learnt)
    computed = checkpointed(computed.drop(*[f"_old_{c}" for c in found]))
    changed = computed.where("_changed").drop("_new", "_changed", *counted)
    months = [r[0] for r in changed.select(month).distinct().collect()]  # calendar months
    weeks = spark.read.parquet(f"{path}/weeks").where(F.col(month).isin(months))
    others = weeks.join(changed.select(key, date), [key, date], "left_anti")
    whole = checkpointed(others.unionByName(changed))
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(f"{path}/weeks")
    mine = W.partitionBy(key)
    sums = {
        "_n": F.col("_n") + F.count_if("_new").over(mine),
        "_total": F.col("_total") + F.coalesce(F.sum(F.when(F.col("_new"), F.col(value))).over(mine), F.lit(0.0)),
        "_known": F.col("_known") + F.count(F.when(F.col("_new"), F.col(value))).over(mine),
    }
    _write_state(computed.withColumns(sums).drop("_new", "_changed"), path, key, date, lags)


def read_series(spark: SparkSession, path: str, key: str = "Product_ID", value: str = "Sales_Units", uplift: float = 1.05) -> DataFrame:
    """The written rows with the target that the state gives."""
    mean = F.try_divide(F.max("_total"), F.max("_known"))
    targets = _state(spark, path).groupBy(key).agg(F.bround(mean * uplift, 0).cast("long").alias("Weekly_Target"))
    weeks = spark.read.parquet(f"{path}/weeks").join(targets, key, "left")
    return weeks.withColumn("Target_Achieved", target_achieved(value, "Weekly_Target"))
