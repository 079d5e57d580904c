"""Cross-validated least squares from sums, without refits.

Each (entity, fold) has one Gram matrix of the rows [1, features, target], an
aggregate that Spark combines on the map side. The train sums of an expanding
fold are those of the folds before it, added up; its weights and the squared
error on its own rows both follow from sums, so the rows are read once for all
folds, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kpiloom.operators.quantiles import known


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def fold_grams(folded: DataFrame, key: str, features: Sequence[str], target: str, fold: str = "fold") -> DataFrame:
    """Per entity and fold the sums of products of all pairs of [1, features,
    target], features and target as distances from the entity's means, which
    keeps their digits. Rows with a missing value are left out; rows without a
    fold number are fold -1."""
    names = [*features, target]
    whole = W.partitionBy(key)
    rows = folded.select(key, F.coalesce(F.col(fold), F.lit(-1)).cast("long").alias("fold"), *[known(c).alias(f"v{i}") for i, c in enumerate(names, 1)])
    rows = rows.dropna()
    centred = rows.select(key, "fold", F.lit(1.0).alias("v0"), *[(F.col(f"v{i}") - F.avg(f"v{i}").over(whole)).alias(f"v{i}") for i in range(1, len(names) + 1)])
    sums = [F.sum(F.col(f"v{i}") * F.col(f"v{j}")) for i, j in _pairs(len(names) + 1)]
    return centred.groupBy(key, "fold").agg(F.array(*sums).alias("gram"))


def fold_errors(folded: DataFrame, key: str, features: Sequence[str], target: str, fold: str = "fold") -> DataFrame:
    """Per entity and fold: ``train`` rows before it, its own rows ``n`` and the
    mean squared error ``mse`` on them of the least-squares fit on the earlier
    ones. Collinear features get the smallest weights."""
    size = len(features) + 2
    pairs = _pairs(size)
    grams = fold_grams(folded, key, features, target, fold)
    earlier = W.partitionBy(key).orderBy("fold").rowsBetween(W.unboundedPreceding, -1)
    before = [F.sum(F.col("gram")[k]).over(earlier) for k in range(len(pairs))]
    both = grams.withColumn("train", F.array(*before)).where(F.col("fold") >= 0).where(F.col("train")[0].isNotNull())
    kind = both.schema[key].dataType.simpleString()

    def square(flat: list[float]) -> np.ndarray:
        out = np.zeros((size, size))
        for (i, j), v in zip(pairs, flat):
            out[i, j] = out[j, i] = v
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ns, errors = [], [], []
            for own, train in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                own, train = square(own), square(train)
                scale = np.sqrt(np.where(train.diagonal() > 0, train.diagonal(), 1.0))[:-1]
                weights = np.linalg.lstsq(train[:-1, :-1] / np.outer(scale, scale), train[:-1, -1] / scale, rcond=1e-12)[0] / scale
                residual = np.append(-weights, 1.0)
                counts.append(int(train[0, 0]))
                ns.append(int(own[0, 0]))
                errors.append(max(float(residual @ own @ residual), 0.0) / own[0, 0])
            columns = [pa.array(counts, pa.int64()), pa.array(ns, pa.int64()), pa.array(errors, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[key, "fold", "train", "n", "mse"])

    return both.select(key, "fold", "gram", "train").mapInArrow(run, f"`{key}` {kind}, fold long, train long, n long, mse double")
