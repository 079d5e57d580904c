"""Top entities by a sum, of very many, without a shuffle of all of them.

Every task keeps a bounded summary of its rows: sums of at most ``held`` keys
and the amount by which any key's sum may be short (Misra and Gries, with
weights). Summaries are added up; a key can reach the first ``n`` only if its sum
and the total shortage reach the n-th largest sum. These candidates are summed
exactly. Where a key outside the summaries could still be among the first, or a
negative value voids the bound, all keys are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.operators.quantiles import known
from kpiloom.operators.ranking import top_n
from kpiloom.session import checkpointed

#: Keys that one task's summary holds.
HELD = 10_000

#: Candidates that are broadcast to be summed exactly, at most.
MOST = 100_000

#: Rounding of sums, relative to the total.
SLACK = 1e-9


def summaries(rows: DataFrame, held: int = HELD) -> DataFrame:
    """Of ``rows`` (key, value): per task its held keys with ``low``, what their
    sums come to at least, and one row without a key: ``short``, by how much any
    sum may be larger, ``low``, the total, and ``negative`` values seen."""
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, short, total, negative, kept = None, 0.0, 0.0, 0, None
        for batch in batches:
            kept = batch.schema.field(0).type
            new = pa.table({"key": batch.column(0), "low": batch.column(1)})
            total += pc.sum(new["low"]).as_py() or 0.0
            negative += pc.sum(pc.less(new["low"], 0)).as_py() or 0
            both = new if sums is None else pa.concat_tables([sums, new])
            sums = both.group_by("key").aggregate([("low", "sum")]).rename_columns(["key", "low"])
            if sums.num_rows > 2 * held:
                sums, short = _pruned(sums, held, short)
        if sums is None:
            return
        if sums.num_rows > held:
            sums, short = _pruned(sums, held, short)
        n, names = sums.num_rows, ["key", "low", "short", "negative", "listed"]
        keys = sums["key"].combine_chunks()
        listed = [keys, sums["low"].combine_chunks(), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int64()), pa.array([True] * n, pa.bool_())]
        yield pa.RecordBatch.from_arrays(listed, names=names)
        totals = [pa.nulls(1, kept), pa.array([total]), pa.array([short]), pa.array([negative], pa.int64()), pa.array([False])]
        yield pa.RecordBatch.from_arrays(totals, names=names)

    return rows.mapInArrow(run, f"key {kind}, low double, short double, negative long, listed boolean")


def _pruned(sums: pa.Table, held: int, short: float) -> tuple[pa.Table, float]:
    """The largest ``held`` sums, less the largest of the others."""
    low = sums["low"].to_numpy()
    cut = float(np.partition(low, len(low) - held - 1)[len(low) - held - 1])
    left = sums.set_column(1, "low", pa.array(low - cut))
    return left.filter(pc.greater(left["low"], 0.0)), short + max(cut, 0.0)


def candidates(rows: DataFrame, n: int, held: int = HELD) -> DataFrame | None:
    """Keys that can be among the first ``n`` sums of ``rows`` (key, value), or
    None where the summaries do not prove it or the list would be too long."""
    parts = checkpointed(summaries(rows, held))
    totals = parts.where(~F.col("listed")).agg(F.sum("low"), F.sum("short"), F.sum("negative")).first()
    if totals[0] is None or totals[2]:
        return None
    short = totals[1] + SLACK * totals[0]
    sums = checkpointed(parts.where("listed").groupBy("key").agg(F.sum("low").alias("low")))
    first = [r["low"] for r in sums.orderBy(F.desc("low")).limit(n).collect()]
    if not totals[1]:  # every key is listed
        least = first[-1] - short if len(first) == n else None
        found = sums.select("key") if least is None else sums.where(F.col("low") >= least).select("key")
    elif len(first) < n or short >= first[-1]:
        return None
    else:
        found = sums.where(F.col("low") + short >= first[-1]).select("key")
    return found if found.count() <= MOST else None


def top_sums(df: DataFrame, key: str, measure: str, n: int, held: int = HELD) -> DataFrame:
    """The ``n`` keys with the largest sums of ``measure``, ties by key: the key
    and ``measure``. Rows without a key or a value are left out (NaN counts as
    missing); the result is that of summing every key."""
    rows = df.select(F.col(f"`{key}`").alias("key"), known(f"`{measure}`").alias("value")).dropna()
    listed = candidates(rows, n, held)
    chosen = rows if listed is None else rows.join(F.broadcast(listed), "key", "left_semi")  # at most MOST keys
    sums = chosen.groupBy("key").agg(F.sum("value").alias("value"))
    return top_n(sums, "value", n, "key").select(F.col("key").alias(key), F.col("value").alias(measure))
