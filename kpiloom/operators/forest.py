"""Isolation forest (Liu, Ting and Zhou 2008) on Spark.

Spark draws the per-tree samples, one grouped task builds each tree from at
most 256 rows, and the trees (bounded by trees x sample size) go to all tasks,
which score the rows in Arrow batches. The cut-off is an exact quantile.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.operators.quantiles import exact_quantiles
from kpiloom.session import checkpointed

NODE_SCHEMA = "tree long, node long, feature long, cut double, left long, right long, path double"
HASH_RANGE = 1 << 30


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def draw_samples(
    df: DataFrame, features: Sequence[str], row_key: Sequence[str], trees: int, sample: int, seed: int
) -> DataFrame:
    """About two samples' worth of rows per tree, chosen by a hash of the row key.

    Every row is drawn ``2 * trees * sample / n`` times, the fraction by chance,
    and each draw picks a tree; a row counts once per tree. The expanded rows
    are the samples', whatever the size of the table.
    """
    rows = df.select(
        F.xxhash64(*row_key, F.lit(seed)).alias("h"),
        F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("x"),
    )
    times = 2.0 * trees * sample / max(df.count(), 1)
    chance = F.pmod(F.xxhash64("h", F.lit(1)), F.lit(HASH_RANGE)) / HASH_RANGE
    draws = F.lit(int(times)) + (chance < times - int(times)).cast("int")
    drawn = rows.withColumn("draws", draws).where("draws > 0")
    picks = F.transform(F.sequence(F.lit(1), "draws"), lambda k: F.pmod(F.xxhash64("h", F.lit(2), k), F.lit(trees)))
    kept = drawn.select("h", "x", F.explode(F.array_distinct(picks)).alias("tree"))
    return kept.select(F.col("tree").cast("long").alias("tree"), F.xxhash64("h", "tree").alias("h"), "x")


def build_tree(points: np.ndarray, rng: np.random.Generator, depth_limit: int) -> list[tuple]:
    """Nodes as (node, feature, cut, left, right, path); leaves have feature -1."""
    nodes: list[tuple] = []
    todo = [(0, points, 0)]
    count = 1
    while todo:
        node, rows, depth = todo.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= depth_limit or len(rows) <= 1 or len(open_features) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + average_path(len(rows))))
            continue
        feature = int(rng.choice(open_features))
        cut = float(rng.uniform(low[feature], high[feature]))
        below = rows[:, feature] <= cut
        nodes.append((node, feature, cut, count, count + 1, 0.0))
        todo += [(count, rows[below], depth + 1), (count + 1, rows[~below], depth + 1)]
        count += 2
    return sorted(nodes)


class IsolationForest:
    """Estimator and model in one: ``fit`` then ``score`` / ``flag``."""

    def __init__(
        self,
        features: Sequence[str],
        row_key: Sequence[str],
        trees: int = 200,
        sample: int = 256,
        contamination: float = 0.01,
        seed: int = 42,
    ) -> None:
        self.features, self.row_key = list(features), list(row_key)
        self.trees, self.sample, self.contamination, self.seed = trees, sample, contamination, seed
        self.forest: list[tuple[np.ndarray, ...]] = []
        self.norm = 1.0

    def fit(self, df: DataFrame) -> IsolationForest:
        sample, seed = self.sample, self.seed

        def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("h").head(sample)
            points = np.stack(pdf["x"].to_numpy())
            limit = int(np.ceil(np.log2(max(len(points), 2))))
            nodes = build_tree(points, np.random.default_rng([seed, int(key[0])]), limit)
            out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "path"])
            out.insert(0, "tree", int(key[0]))
            out["drawn"] = len(points)
            return out

        samples = draw_samples(df, self.features, self.row_key, self.trees, sample, seed)
        grown = samples.groupBy("tree").applyInPandas(grow, NODE_SCHEMA + ", drawn long")
        nodes = grown.toPandas().sort_values(["tree", "node"])
        self.norm = average_path(float(nodes.groupby("tree")["drawn"].first().mean()))
        self.forest = [
            tuple(g[c].to_numpy() for c in ("feature", "cut", "left", "right", "path"))
            for _, g in nodes.groupby("tree")
        ]
        return self

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``raw_score``: close to -1 for easily isolated rows."""
        forest = df.sparkSession.sparkContext.broadcast(self.forest)
        norm = max(self.norm, 1e-12)

        @F.pandas_udf("double")
        def raw_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series(score_points(np.stack(batch.to_numpy()), forest.value, norm))

        x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features])
        return df.withColumn("raw_score", raw_score(x))

    def flag(self, df: DataFrame) -> DataFrame:
        """Add ``anomaly_score`` (negative for anomalies) and ``is_anomaly``."""
        scored = checkpointed(self.score(df))
        cut = exact_quantiles(scored, ["raw_score"], [self.contamination]).select("value").scalar()
        return (
            scored.withColumn("anomaly_score", F.col("raw_score") - cut)
            .withColumn("is_anomaly", F.col("anomaly_score") < 0)
            .drop("raw_score")
        )


def score_points(x: np.ndarray, forest: Sequence[tuple[np.ndarray, ...]], norm: float) -> np.ndarray:
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, cut, left, right, path in forest:
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            below = x[rows, np.where(inner, f, 0)] <= cut[node]
            node = np.where(inner, np.where(below, left[node], right[node]), node)
        total += path[node]
    return -np.exp2(-total / max(len(forest), 1) / norm)
