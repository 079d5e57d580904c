"""Correlations of hundreds of columns from blocked co-moments.

An aggregate per pair is one expression per pair: 300 columns make 45,000 of
them. Here a task turns its rows into matrices: with X the values about the
columns' means (0 where missing) and M the mask of known ones, M'M counts the
complete pairs, X'M and (X*X)'M are sums and squares over them, and X'X their
products. The matrices are cut into blocks of columns and added up block by
block, 64 tasks at a time, so no group grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.operators.quantiles import known

#: Columns of a block.
BLOCK = 64

#: Matrices that are added up at once.
FAN_IN = 64

SCHEMA = "bi int, bj int, part long, sums binary"


def _block_sums(rows: DataFrame, k: int) -> DataFrame:
    """Per task and pair of blocks: counts, sums of either side, squares of either side, products."""
    cuts = [slice(i, min(i + BLOCK, k)) for i in range(0, k, BLOCK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            mask = np.isfinite(x)
            x, m = np.where(mask, x, 0.0), mask.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        if not total[0].any():
            return
        part = TaskContext.get().partitionId()
        for i, a in enumerate(cuts):
            for j, b in enumerate(cuts[i:], i):
                n, s, q, p = (t[a, b] for t in total)
                both = np.stack([n, s, total[1][b, a].T, q, total[2][b, a].T, p])
                arrays = [pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([part], pa.int64()), pa.array([both.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["bi", "bj", "part", "sums"])

    return rows.mapInArrow(run, SCHEMA)


def _added(parts: DataFrame) -> DataFrame:
    """One matrix per pair of blocks and ``FAN_IN`` tasks."""

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py()) for b in group["sums"])
        first = group.slice(0, 1)
        return first.set_column(3, "sums", pa.array([total.tobytes()], pa.binary()))

    fewer = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
    return fewer.groupBy("bi", "bj", "part").applyInArrow(add, SCHEMA)


def correlation_blocks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``stats.correlation_matrix`` for many columns: rows (x, y, corr), both
    triangles and the diagonal, each pair over the rows where both are known.
    Null where fewer than two are, or where a side is constant on them. NaN and
    infinities count as missing."""
    names, k = list(columns), len(columns)
    rows = df.select(*[known(c).alias(f"c{i}") for i, c in enumerate(names)])
    rows = rows.select(*[F.when(F.abs(c) != float("inf"), F.col(c)).alias(c) for c in rows.columns])
    found = rows.select("*", F.spark_partition_id().alias("part")).agg(F.max("part"), *[F.avg(c) for c in rows.columns]).first()
    means = [m if m is not None else 0.0 for m in found[1:]]
    parts = _block_sums(rows.select(*[(F.col(c) - F.lit(m)).alias(c) for c, m in zip(rows.columns, means)]), k)
    tasks = (found[0] or 0) + 1
    while tasks > FAN_IN:
        parts, tasks = _added(parts), -(-tasks // FAN_IN)
    parts = _added(parts.withColumn("part", F.lit(0).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, _, raw in zip(*(c.to_pylist() for c in batch.columns)):
                high, wide = min(BLOCK, k - bi * BLOCK), min(BLOCK, k - bj * BLOCK)
                n, si, sj, qi, qj, p = np.frombuffer(raw).reshape(6, high, wide)
                with np.errstate(divide="ignore", invalid="ignore"):
                    vi, vj, cov = qi - si * si / n, qj - sj * sj / n, p - si * sj / n
                    corr = np.clip(cov / np.sqrt(vi * vj), -1.0, 1.0)
                here, there = np.abs(means)[bi * BLOCK :][:high, None], np.abs(means)[bj * BLOCK :][None, :wide]
                still = (vi <= 1e-13 * qi + n * (4e-15 * here) ** 2) | (vj <= 1e-13 * qj + n * (4e-15 * there) ** 2)
                corr[(n < 2) | still] = np.nan
                x = np.repeat(np.array(names[bi * BLOCK :][:high]), wide)
                y = np.tile(np.array(names[bj * BLOCK :][:wide]), high)
                value = corr.ravel()
                if bi == bj:
                    value = np.where((x == y) & ~np.isnan(value), 1.0, value)
                else:
                    x, y, value = np.concatenate([x, y]), np.concatenate([y, x]), np.tile(value, 2)
                arrays = [pa.array(x, pa.string()), pa.array(y, pa.string()), pa.array(value, mask=np.isnan(value))]
                yield pa.RecordBatch.from_arrays(arrays, names=["x", "y", "corr"])

    return parts.mapInArrow(run, "x string, y string, corr double")
