"""Connected components of a large graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import written


def _lowest(edges: DataFrame) -> DataFrame:
    """Smallest neighbour or own id of each source node; written, so that the
    join back on a node with many edges can be split."""
    return written(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low")), "lowest")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(_lowest(both), "u").where("v > u")
    return linked.select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from larger to smaller nodes."""
    low = _lowest(edges)
    linked = edges.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return linked.unionByName(low.select("u", F.col("low").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Node ``u`` and the smallest node ``v`` reachable from it, for every node
    that is not itself the smallest; ``edges`` has longs ``u`` and ``v``.

    Each round is two joins by node; a component of n nodes takes some log n
    rounds. Self-links and repeated links change nothing.
    """
    current = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _state(current)
    while before[0]:
        current = written(_small_star(written(_large_star(current), "large-star")), "small-star")
        after = _state(current)
        if after == before:
            break
        before = after
    return current
