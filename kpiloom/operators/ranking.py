"""Top-N, running totals over a global order, and Pareto tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kpiloom.session import checkpointed


def top_n(df: DataFrame, measure: str, n: int, tie: str) -> DataFrame:
    """Largest ``n`` rows by measure, ties by id; no full sort."""
    return df.orderBy(F.desc(measure), F.asc(tie)).limit(n)


def running_total(
    df: DataFrame, order: Sequence[Column], value: str, name: str = "Cumulative", partitions: int | None = None
) -> tuple[DataFrame, Column]:
    """Running total over one global order, and the grand total.

    A window without a partition would put all rows into one task. Here the
    rows are range-partitioned by the order (sampled bounds, so equal measures
    spread by the further order columns), checkpointed once so that every pass
    sees the same partitions, and summed per partition; a row's total is the
    sum of the partitions before its own plus the total within it. The offsets
    have one row per partition. Without ``partitions`` adaptive execution merges
    small neighbours, which keeps the order.
    """
    spread = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranged = checkpointed(spread.withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = (
        ranged.withColumn("_within", F.sum(value).over(within))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_within"))
        .drop("_part", "_before", "_within")
    )
    return out, sums.agg(F.sum("_sum")).scalar()


def pareto(totals: DataFrame, measure: str = "Revenue", key: str = "Product_ID") -> DataFrame:
    """Measure, running total and its share, largest first."""
    out, total = running_total(
        totals, [F.col(measure).desc(), F.col(key).asc()], measure, f"Cumulative_{measure}"
    )
    return out.withColumn(f"Cumulative_{measure}_pct", F.try_divide(F.col(f"Cumulative_{measure}"), total))


def pareto_set(table: DataFrame, share: str = "Cumulative_Revenue_pct", limit: float = 0.8) -> DataFrame:
    """Entities whose running share stays within the limit (the crossing one is out)."""
    return table.where(F.col(share) <= limit)


def pareto_crossing(
    table: DataFrame, share: str = "Cumulative_Revenue_pct", key: str = "Product_ID", limit: float = 0.8
) -> DataFrame:
    """The first entity that reaches the limit."""
    order = F.struct(share, key)
    return table.where(F.col(share) >= limit).agg(
        F.min_by(key, order).alias(key), F.min_by(share, order).alias(share)
    )
