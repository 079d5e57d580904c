"""Windows over one long series without a key.

A window without a partition puts the whole series into one task. Here the rows
are range-partitioned by their order and numbered, cut into blocks of equal
length, and each block is given the last rows of the one before (its halo), as
many as the longest lag reaches back. Every block is a window of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kpiloom.operators.growth import pct_change
from kpiloom.session import checkpointed

#: Rows of a block.
BLOCK = 100_000


def add_series_position(df: DataFrame, order: Sequence[Column | str], name: str = "position") -> DataFrame:
    """0-based position of every row in the whole table's ``order``, which should
    leave no ties. The driver gets one number per partition."""
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["count"]) for r in ranged.groupBy("_part").count().collect())
    before = [0, *accumulate(n for _, n in sizes)]
    starts = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_part int, _before long")
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    placed = ranged.withColumn("_within", within).join(F.broadcast(starts), "_part")  # a row per partition
    return placed.withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")


def over_series(
    df: DataFrame, order: Sequence[Column | str], reach: int, columns: Callable[[WindowSpec], Mapping[str, Column]], block: int = BLOCK, position: str = "position"
) -> DataFrame:
    """Add ``position`` and the window ``columns`` over the whole table's order;
    they may look up to ``reach`` rows back."""
    if reach > block:
        raise ValueError(f"blocks of {block} rows cannot lend {reach}")
    placed = add_series_position(df, order, position)
    own = F.floor(F.col(position) / block)
    lent = F.col(position) % block >= block - reach
    blocks = F.when(lent, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.withColumn("_block", F.explode(blocks))
    window = W.partitionBy("_block").orderBy(position)
    return spread.withColumns(dict(columns(window))).where(F.col("_block") == own).drop("_block")


def add_series_growth(
    df: DataFrame,
    order: Sequence[Column | str],
    growth: Mapping[str, tuple[str, int]],
    rolling: Mapping[str, tuple[str, int]] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """``growth.add_growth`` and ``growth.add_rolling`` for a series without a key."""
    means = rolling or {}

    def columns(window: WindowSpec) -> dict[str, Column]:
        changes = {name: pct_change(value, window, lag) for name, (value, lag) in growth.items()}
        return changes | {name: F.avg(value).over(window.rowsBetween(1 - k, 0)) for name, (value, k) in means.items()}

    reach = max([*(lag for _, lag in growth.values()), *(k - 1 for _, k in means.values())], default=0)
    return over_series(df, order, reach, columns, block)
