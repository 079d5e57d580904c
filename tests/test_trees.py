"""Folds, partitions and parts of the pooled tree fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kpiloom.operators import forecast as FC
from kpiloom.operators import ml
from kpiloom.operators.growth import add_holdout


def step_series(seed=1):
    rng = np.random.default_rng(seed)
    dates = pd.date_range("2020-01-06", periods=120, freq="7D").date
    frame = pd.DataFrame({"Product_ID": "P1", "Date": dates, "Sales_Units": np.tile(np.repeat([0.0, 10.0], 10), 6), "z": 1.0})
    return frame.assign(x=frame["Sales_Units"] + rng.normal(scale=0.1, size=120))


def two_scales(spark):
    large = step_series(2).assign(Product_ID="P2")
    large["Sales_Units"] *= 100
    return add_holdout(spark.createDataFrame(pd.concat([step_series(), large])), ["Product_ID"], "Date", 12)


def folded_scales(spark):
    folded = FC.add_cv_folds(two_scales(spark), ["Product_ID", "is_test"], "Date", 2)
    return folded.withColumn("fold", F.when(~F.col("is_test"), F.col("fold")))


def test_boosted_errors_of_every_fold_and_entity(spark):
    train = folded_scales(spark).where("NOT is_test")
    grid = {"depths": (1, 2), "trees": (2, 8), "rates": (0.3,)}
    got = ml.boosted_errors(train, "Product_ID", ["x", "z"], "Sales_Units", "Date", **grid).toPandas()
    assert sorted(set(zip(got["Product_ID"], got["fold"]))) == [("P1", 0), ("P1", 1), ("P2", 0), ("P2", 1)]
    assert len(got) == 16 and set(got["n"]) == {36}
    units = (got["mse"] / got["scaled_mse"]).groupby([got["Product_ID"], got["fold"]]).mean()
    assert list(units["P2"] / units["P1"]) == pytest.approx([1e4, 1e4])  # in units of the target
    best = ml.boosted_search(train, "Product_ID", ["x", "z"], "Sales_Units", "Date", **grid)
    mean = got.groupby(["depth", "trees"])["scaled_mse"].mean()
    assert best[0][0] == pytest.approx(mean.min())


def test_first_trees_are_a_shorter_fit(spark):
    data = ml._vectors(spark.createDataFrame(step_series().assign(_y=lambda f: f["Sales_Units"])), ["x", "z"])
    long, short = (ml._boosting(2, n, 0.1, 42).fit(data) for n in (9, 4))
    pair = ml._first_trees(long, 4).transform(data).select("x", "pred").join(short.transform(data).select("x", F.col("pred").alias("want")), "x")
    assert pair.count() == 120 and pair.where("abs(pred - want) > 1e-9").count() == 0


def test_tree_fits_get_partitions_by_rows_alone(spark):
    """Whatever the session's shuffle setting is, few rows make one task."""
    setting = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        parts = [ml._spread(spark.range(n).toDF("id"), "id").rdd.getNumPartitions() for n in (100, 50_000)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", setting)
    assert parts == [1, 3]


def test_forest_of_several_fits_has_all_trees(spark, monkeypatch):
    made = []
    regressor = ml.RandomForestRegressor
    monkeypatch.setattr(ml, "RandomForestRegressor", lambda **k: made.append(k["numTrees"]) or regressor(**k))
    got = ml.series_forest(two_scales(spark), "Product_ID", ["x", "z"], "Sales_Units", "Date", trees=60, depth=3).toPandas()
    assert sum(made) == 60 and len(made) == 3 and len(got) == 24
    assert np.abs(got["pred"] - got["actual"])[got["Product_ID"] == "P1"].mean() < 0.5
