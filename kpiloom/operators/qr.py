"""Least squares on nearly collinear features by tree-reduced QR.

Covariances square the condition number and lose half the digits. Here every
task reduces its rows [1, features, target] to one triangular matrix, groups of
these are reduced again, and the last one is solved: orthogonal steps only, on
matrices of the number of features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.operators.quantiles import known
from kpiloom.session import checkpointed

#: Rows that a task adds to its triangle at once.
ROWS = 1 << 15

#: Triangles that one task of the second step reduces, and that the driver gets, on average.
FAN_IN = 64


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _reduced(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Per task the rows of the triangle of all its rows."""
    schema = ", ".join(f"{c} double" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(names)))
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.zeros((0, len(names)))
            for at in range(0, len(rows), ROWS):
                held = _triangle(np.vstack([held, rows[at : at + ROWS]]))
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in held.T], names=list(names))

    return df.mapInArrow(run, schema)


def qr_ols(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """``stats.ols`` for features of any correlation short of exact: one row per
    term. Rows with a missing value are left out. Features are taken about their
    means and over their deviations, from one aggregate, and the weights are
    returned in the features' own units; exactly collinear ones get the smallest
    weights."""
    names = [f"v{i}" for i in range(len(features) + 1)]
    rows = df.select(*[known(c).alias(n) for c, n in zip([*features, target], names)]).dropna()
    found = rows.agg(F.count("*"), *[F.avg(n) for n in names], *[F.stddev_pop(n) for n in names]).first()
    if found[0] < 2:
        raise ValueError("a regression needs at least two complete rows")
    means, spread = np.array(found[1 : len(names) + 1], float), np.array(found[len(names) + 1 :], float)
    spread = np.where(spread > 0, spread, 1.0)
    scaled = rows.select(F.lit(1.0).alias("one"), *[((F.col(n) - F.lit(float(m))) / F.lit(float(s))).alias(n) for n, m, s in zip(names, means, spread)])
    parts = checkpointed(_reduced(scaled, ["one", *names]))
    groups = max(1, -(-parts.count() // (FAN_IN * (len(names) + 1))))
    last = _reduced(parts.repartition(groups), ["one", *names]).collect()  # a triangle per group
    top = _triangle(np.array([list(r) for r in last]))
    weights = np.linalg.lstsq(top[:, :-1], top[:, -1], rcond=1e-14)[0]
    own = weights[1:] * spread[-1] / spread[:-1]
    level = means[-1] + weights[0] * spread[-1] - float(means[:-1] @ own)
    terms = [("intercept", float(level)), *((f, float(w)) for f, w in zip(features, own, strict=True))]
    return df.sparkSession.createDataFrame(terms, "term string, coefficient double")
