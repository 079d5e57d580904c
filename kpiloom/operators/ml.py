"""Clustering, pooled forests and boosting with Spark ML.

All fits are distributed over the rows of the table. Inputs that several fits
read are checkpointed once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.operators.stats import standardise
from kpiloom.session import checkpointed


def _vectors(df: DataFrame, features: Sequence[str], fill: bool = False) -> DataFrame:
    data = df.withColumns({f: F.col(f).cast("double") for f in features})
    data = data.fillna(0.0, subset=list(features)) if fill else data.dropna(subset=list(features))
    return VectorAssembler(inputCols=list(features), outputCol="_x").transform(data)


def _balanced(df: DataFrame) -> DataFrame:
    """Even partitions of the advised size, which adaptive execution can split,
    written once: every fit makes many passes."""
    return checkpointed(df.hint("rebalance"))


#: Rows that a task of a tree fit holds. A fit runs a job per level of a tree, and
#: every task of a job sends the statistics of all open nodes: few rows on many
#: partitions cost more than they save, and independent fits fill the cores.
TASK_ROWS = 20_000


def _spread(df: DataFrame, *order: str) -> DataFrame:
    """Partitions for the tree fits by the number of rows alone, rows in a fixed
    order, since the fits draw rows by their place."""
    data = _balanced(df)
    data = data.repartition(max(1, -(-data.count() // TASK_ROWS)))
    return data.sortWithinPartitions(*order) if order else data


def _in_parallel(spark: SparkSession, run: Callable, settings: Sequence, workers: int) -> list:
    """Independent fits as concurrent Spark jobs."""
    with ThreadPoolExecutor(max_workers=workers) as pool:
        return list(pool.map(inheritable_thread_target(spark)(run), settings))


def fit_kmeans(
    df: DataFrame, k: int = 3, starts: int = 10, seed: int = 42, iterations: int = 300, parallelism: int = 4
) -> KMeansModel:
    """Best of ``starts`` random starts by within-cluster cost, on the ``_x``
    vectors; a start ends when the centres settle, or after ``iterations``."""

    def run(i: int) -> KMeansModel:
        return KMeans(k=k, seed=seed + i, maxIter=iterations, featuresCol="_x", predictionCol="cluster").fit(df)

    df.persist()  # all starts read the same vectors
    try:
        models = _in_parallel(df.sparkSession, run, range(starts), parallelism)
        return min(models, key=lambda m: m.summary.trainingCost)
    finally:
        df.unpersist()


def cluster(df: DataFrame, features: Sequence[str], k: int = 3, starts: int = 10, seed: int = 42) -> DataFrame:
    """Add ``cluster``: unscaled features, nulls as 0, clusters numbered by their first feature's centre."""
    data = _balanced(_vectors(df, features, fill=True))
    model = fit_kmeans(data, k, starts, seed)
    centres = model.clusterCenters()
    ranked = sorted(range(len(centres)), key=lambda i: tuple(centres[i]))
    number = F.lit(None).cast("long")
    for new, old in enumerate(ranked):
        number = F.when(F.col("cluster") == old, F.lit(new).cast("long")).otherwise(number)
    return model.transform(data).withColumn("cluster", number).drop("_x")


#: Trees that are fitted together; the others of a forest are independent fits.
FIT_TREES = 25


def _forest(
    train: DataFrame, label: str, trees: int, depth: int, bins: int, seed: int, parallelism: int = 8
) -> Callable[[DataFrame], DataFrame]:
    """One forest from concurrent fits of some of its trees; the returned function
    adds ``pred``, the mean over all trees."""
    fits = -(-trees // FIT_TREES)
    sizes = [trees // fits + (i < trees % fits) for i in range(fits)]

    def run(i: int) -> RandomForestRegressionModel:
        return RandomForestRegressor(
            featuresCol="_x", labelCol=label, predictionCol=f"_pred{i}", numTrees=sizes[i], maxDepth=depth, maxBins=bins, featureSubsetStrategy="all", seed=seed + i
        ).fit(train)

    train.persist()  # all fits read the same rows
    try:
        models = _in_parallel(train.sparkSession, run, range(fits), parallelism)
    finally:
        train.unpersist()

    def score(df: DataFrame) -> DataFrame:
        for model in models:
            df = model.transform(df)
        total = sum((F.col(f"_pred{i}") * n for i, n in enumerate(sizes)), F.lit(0.0))
        return df.withColumn("pred", total / trees).drop(*[f"_pred{i}" for i in range(fits)])

    return score


def forest_regression(
    df: DataFrame, target: str, features: Sequence[str], trees: int = 100, depth: int = 30, bins: int = 32, seed: int = 42
) -> DataFrame:
    """Random forest pooled over all rows: adds ``pred``. The default depth is
    the deepest that Spark grows, more than a leaf of one row needs in practice;
    a feature is cut at ``bins`` quantiles."""
    data = _spread(_vectors(df.dropna(subset=[target]), features), *features)
    return _forest(data, target, trees, depth, bins, seed)(data).drop("_x")


def _scaled_series(split: DataFrame, key: str, features: Sequence[str], target: str, order: str, train: Column) -> DataFrame:
    """Features and target of each entity in deviations of its train rows, so
    that one model fits entities of any level; ``_mean`` and ``_spread`` undo the
    target's scale. Entities without train rows are left out."""
    spread = F.coalesce(F.nullif(F.stddev_pop(target), F.lit(0.0)), F.lit(1.0))
    level = split.where(train).groupBy(key).agg(F.avg(target).alias("_mean"), spread.alias("_spread"))
    scaled = standardise(split.where(F.col(target).isNotNull()), list(features), train, [key]).join(level, key)
    y = (F.col(target) - F.col("_mean")) / F.col("_spread")
    rows = scaled.select(key, order, F.col(target).cast("double").alias("actual"), train.alias("_train"), "_mean", "_spread", y.alias("_y"), *[f"{c}_std" for c in features])
    return _vectors(rows, [f"{c}_std" for c in features], fill=True)


def _unscaled(scored: DataFrame, key: str, order: str) -> DataFrame:
    return scored.select(key, order, "actual", (F.col("pred") * F.col("_spread") + F.col("_mean")).alias("pred"))


def series_forest(
    split: DataFrame, key: str, features: Sequence[str], target: str, order: str, trees: int = 200, depth: int = 10, seed: int = 42, is_test: str = "is_test"
) -> DataFrame:
    """One random forest over the train rows of all entities, each scaled by
    itself, evaluated on their test rows: key, order, actual, pred."""
    data = _spread(_scaled_series(split, key, features, target, order, ~F.col(is_test)), key, order)
    score = _forest(data.where("_train"), "_y", trees, depth, 32, seed)
    return _unscaled(score(data.where("NOT _train")), key, order)


# The searched settings of the boosted trees.
BOOST_DEPTHS = (4, 5)
BOOST_TREES = (20, 40)
BOOST_RATES = (0.05, 0.1)


def _boosting(depth: int, trees: int, rate: float, seed: int) -> GBTRegressor:
    return GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="pred", maxDepth=depth, maxIter=trees, stepSize=rate, seed=seed)


def _first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model after its first ``n`` trees."""
    fitted = model._java_obj
    jvm = SparkSession.active().sparkContext._jvm
    first = jvm.org.apache.spark.ml.regression.GBTRegressionModel(f"{model.uid}_{n}", fitted.trees()[:n], fitted.treeWeights()[:n])
    return GBTRegressionModel(first.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol()))


def boosted_errors(
    folded: DataFrame,
    key: str,
    features: Sequence[str],
    target: str,
    order: str,
    fold: str = "fold",
    depths: Sequence[int] = BOOST_DEPTHS,
    trees: Sequence[int] = BOOST_TREES,
    rates: Sequence[float] = BOOST_RATES,
    seed: int = 42,
    parallelism: int = 8,
) -> DataFrame:
    """Errors of every setting on every expanding fold of every entity: key, fold,
    depth, trees, rate, n, mse and scaled_mse (in units of the entity's deviation).

    Per fold, depth and rate one pooled model is fitted on the rows before the
    fold and evaluated on its rows after each number of trees.
    """
    folds = sorted(r[0] for r in folded.where(F.col(fold).isNotNull()).select(fold).distinct().collect())
    if not folds:
        raise ValueError("no series is long enough for a fold")
    spark = folded.sparkSession

    def scaled(i: int) -> tuple[DataFrame, DataFrame]:
        before = F.coalesce(F.col(fold) < i, F.lit(True))
        rows = folded.where(before | (F.col(fold) == i))
        data = _spread(_scaled_series(rows, key, features, target, order, before), key, order)
        return data.where("_train").persist(), data.where("NOT _train")

    def run(setting: tuple[int, int, float]) -> list[DataFrame]:
        i, depth, rate = setting
        train, valid = parts[i]
        model = _boosting(depth, max(trees), rate, seed).fit(train)
        named = [F.lit(v).alias(c) for c, v in ((fold, i), ("depth", depth))]
        error = F.col("pred") - F.col("_y")
        return [
            _first_trees(model, n)
            .transform(valid)
            .select(key, *named, F.lit(n).alias("trees"), F.lit(rate).alias("rate"), error.alias("_error"), "_spread")
            for n in trees
        ]

    parts = dict(zip(folds, _in_parallel(spark, scaled, folds, parallelism)))
    try:
        scored = sum(_in_parallel(spark, run, list(product(folds, depths, rates)), parallelism), [])
        square = F.col("_error") * F.col("_error")
        errors = reduce(DataFrame.unionAll, scored).groupBy(key, fold, "depth", "trees", "rate").agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(square * F.col("_spread") * F.col("_spread")).alias("mse"),
            F.avg(square).alias("scaled_mse"),
        )
        return checkpointed(errors)
    finally:
        for train, _ in parts.values():
            train.unpersist()


def boosted_search(
    folded: DataFrame, key: str, features: Sequence[str], target: str, order: str, fold: str = "fold", **grid: Sequence
) -> list[tuple[float, int, int, float]]:
    """(mean squared error, depth, trees, rate) of every setting, best first: the
    mean over all expanding folds, in units of an entity's deviation."""
    setting = ["depth", "trees", "rate"]
    errors = boosted_errors(folded, key, features, target, order, fold, **grid)
    per_fold = errors.groupBy(fold, *setting).agg((F.sum(F.col("scaled_mse") * F.col("n")) / F.sum("n")).alias("mse"))
    return sorted(tuple(r) for r in per_fold.groupBy(*setting).agg(F.avg("mse").alias("mse")).select("mse", *setting).collect())


def boosted_series(
    folded: DataFrame, key: str, features: Sequence[str], target: str, order: str, fold: str = "fold", seed: int = 42, is_test: str = "is_test", **grid: Sequence
) -> DataFrame:
    """Boosted trees pooled over all entities: the grid is searched on the
    folds of the train rows, the best setting is fitted on all of them and
    evaluated on the test rows. Ties go to less depth, fewer trees, the lower rate."""
    _, depth, trees, rate = boosted_search(folded.where(~F.col(is_test)), key, features, target, order, fold, seed=seed, **grid)[0]
    data = _spread(_scaled_series(folded, key, features, target, order, ~F.col(is_test)), key, order)
    model = _boosting(depth, trees, rate, seed).fit(data.where("_train"))
    return _unscaled(model.transform(data.where("NOT _train")), key, order)
