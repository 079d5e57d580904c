from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kpiloom.operators import forecast as FC
from kpiloom.operators import ml
from kpiloom.operators.forest import IsolationForest, average_path, build_tree, draw_samples
from kpiloom.operators.growth import add_holdout
from kpiloom.operators.stats import standardise

RNG = np.random.default_rng(5)


def weekly(values, key="P1"):
    start = dt.date(2020, 1, 6)
    return pd.DataFrame(
        {
            "Product_ID": key,
            "Date": [start + dt.timedelta(days=7 * i) for i in range(len(values))],
            "Week_Index": range(len(values)),
            "Sales_Units": np.asarray(values, float),
        }
    )


def test_entity_ols_matches_least_squares(spark):
    frames = []
    for key in ("a", "b"):
        frame = weekly(RNG.normal(size=40), key)
        frame["x1"], frame["x2"] = RNG.normal(size=40), RNG.normal(size=40)
        frame["x3"] = frame["x1"] + frame["x2"]  # rank deficient on purpose
        frame["Sales_Units"] += 2 * frame["x1"] - frame["x2"]
        frames.append(frame)
    df = add_holdout(spark.createDataFrame(pd.concat(frames)), ["Product_ID"], "Date", 5)
    got = FC.entity_ols(df, "Product_ID", ["x1", "x2", "x3"], "Sales_Units", "Week_Index").toPandas()
    assert len(got) == 10
    for key, frame in zip(("a", "b"), frames, strict=True):
        design = np.column_stack([np.ones(40), frame[["x1", "x2"]]])
        weights = np.linalg.lstsq(design[:-5], frame["Sales_Units"][:-5], rcond=None)[0]
        mine = got[got["Product_ID"] == key].sort_values("Week_Index")["pred"]
        assert list(mine) == pytest.approx(list(design[-5:] @ weights))


def test_regression_backtest_on_a_trend(spark):
    values = 100 + 2.0 * np.arange(60)
    df = spark.createDataFrame(weekly(values))
    got = FC.regression_backtest(df, include_current=False).orderBy("Week_Index").toPandas()
    assert list(got["Week_Index"]) == list(range(48, 60))
    assert np.abs(got["pred"] - got["actual"]).max() < 1.0


def test_backtest_skips_short_series(spark):
    df = spark.createDataFrame(pd.concat([weekly(RNG.normal(size=29), "short"), weekly(RNG.normal(size=30), "long")]))
    got = FC.regression_backtest(df)
    assert {r["Product_ID"] for r in got.collect()} == {"long"}


def test_additive_backtest_follows_the_season(spark):
    weeks = np.arange(208)
    values = 500 + weeks + 80 * np.sin(2 * np.pi * weeks / FC.SEASON_WEEKS)
    frame = weekly(values)
    frame["On_Promo"], frame["Marketing_Spend"] = False, 10.0
    got = FC.additive_backtest(spark.createDataFrame(frame)).toPandas()
    assert len(got) == 12
    assert (np.abs(got["pred"] - got["actual"]) / got["actual"]).max() < 0.02


def test_sarima_recovers_an_autoregression():
    n, w = 4000, [0.0]
    for e in RNG.normal(size=n):
        w.append(0.6 * w[-1] + e)
    ar, ma, _ = FC.fit_arma(np.array(w[1:]), (1, 12, 13))
    assert ar[0] + ma[0] == pytest.approx(0.6, abs=0.05)
    assert np.abs(ar[1:]).max() < 0.25


def test_sarima_continues_season_and_trend(spark):
    season = np.tile([0, 5, 9, 4, -3, -8, -6, 0, 2, 7, -5, -5], 12)
    values = 200 + 1.5 * np.arange(144) + season + np.random.default_rng(5).normal(scale=0.2, size=144)
    df = spark.createDataFrame(pd.concat([weekly(values), weekly(values[:59], "short")]))
    got = FC.sarima_backtest(df, "Product_ID", "Date", "Sales_Units").toPandas()
    assert set(got["Product_ID"]) == {"P1"}
    assert len(got) == 12
    assert got["error"].isna().all()
    error = np.abs(got["pred"] - got["actual"]).max()
    naive = np.abs(values[120:132] + 18.0 - values[132:]).max()
    assert error < min(0.5, naive)


def test_sarima_reports_failures(spark):
    frame = weekly(np.arange(40.0))
    got = FC.sarima_backtest(spark.createDataFrame(frame), "Product_ID", "Date", "Sales_Units", min_rows=20).collect()
    assert len(got) == 12
    assert all(r["pred"] is None and "too few" in r["error"] for r in got)


def test_expanding_folds(spark):
    df = spark.createDataFrame(weekly(range(23)))
    got = [r["fold"] for r in FC.add_cv_folds(df, ["Product_ID"], "Date", 4).orderBy("Date").collect()]
    assert got == [None] * 7 + [0] * 4 + [1] * 4 + [2] * 4 + [3] * 4


def test_folds_of_a_tiny_series_are_empty(spark):
    df = spark.createDataFrame(weekly(range(3)))
    assert {r["fold"] for r in FC.add_cv_folds(df, ["Product_ID"], "Date", 4).collect()} == {None}


# --- isolation forest -------------------------------------------------------


def test_average_path():
    assert [average_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    # c(n) = 2 H(n-1) - 2 (n-1)/n with the harmonic number's usual estimate.
    harmonic = sum(1 / i for i in range(1, 256))
    assert average_path(256) == pytest.approx(2 * harmonic - 2 * 255 / 256, abs=0.01)


def test_tree_isolates_an_outlier_early():
    points = np.vstack([RNG.normal(size=(255, 2)), [[50.0, 50.0]]])
    nodes = {n[0]: n for n in build_tree(points, np.random.default_rng(1), 8)}

    def depth(x):
        node, steps = 0, 0
        while nodes[node][1] >= 0:
            _, feature, cut, left, right, _ = nodes[node]
            node, steps = (left if x[feature] <= cut else right), steps + 1
        return steps

    assert depth(points[-1]) < np.mean([depth(p) for p in points[:50]])


def test_forest_flags_outliers(spark):
    values = RNG.normal(size=(1000, 2))
    values[:5] += 12
    df = spark.createDataFrame(pd.DataFrame({"id": range(1000), "a": values[:, 0], "b": values[:, 1]}))
    forest = IsolationForest(["a", "b"], ["id"], trees=50, contamination=0.01).fit(df)
    flagged = {r["id"] for r in forest.flag(df).where("is_anomaly").collect()}
    assert len(flagged) == 10
    assert set(range(5)) <= flagged
    again = IsolationForest(["a", "b"], ["id"], trees=50, contamination=0.01).fit(df.repartition(3))
    assert {r["id"] for r in again.flag(df).where("is_anomaly").collect()} == flagged


@pytest.mark.parametrize("n", [50, 1000, 30_000])
def test_samples_are_drawn_alike_at_all_sizes(spark, n):
    df = spark.range(n).select("id", (F.col("id") % 101).alias("a"))
    samples = draw_samples(df, ["a"], ["id"], trees=20, sample=64, seed=1)
    sizes = {r["tree"]: r["count"] for r in samples.groupBy("tree").count().collect()}
    assert len(sizes) == 20
    assert all(min(64, 0.8 * n) <= size <= min(200, n) for size in sizes.values())
    assert samples.groupBy("tree", "h").count().where("count > 1").count() == 0


# --- Spark ML ---------------------------------------------------------------


def test_clusters_of_separate_blobs(spark):
    data = [(float(c * 100 + RNG.normal()), float(RNG.normal()), c) for c in range(3) for _ in range(30)]
    df = spark.createDataFrame([*data, (None, None, 0)], "x double, y double, blob int")
    got = ml.cluster(df, ["x", "y"], starts=3)
    assert got.where("cluster <> blob").count() == 0
    assert got.count() == 91


def test_forest_learns_a_step(spark):
    data = [(float(i), float(i % 7), 10.0 if i > 50 else 0.0) for i in range(100)]
    df = spark.createDataFrame(data, "a double, b double, y double")
    error = ml.forest_regression(df, "y", ["a", "b"], trees=10, depth=3).agg(F.avg(F.abs(F.col("y") - F.col("pred"))))
    assert error.first()[0] < 1.0


# --- pooled series models -----------------------------------------------------


def step_series(n=120):
    frame = weekly(np.tile(np.repeat([0.0, 10.0], 10), n // 20))
    frame["x"] = frame["Sales_Units"] + RNG.normal(scale=0.1, size=n)
    frame["z"] = 1.0
    return frame


def two_scales(spark):
    """Two products, one at a hundred times the other's level."""
    large = step_series().assign(Product_ID="P2")
    large["Sales_Units"] *= 100
    return add_holdout(spark.createDataFrame(pd.concat([step_series(), large])), ["Product_ID"], "Date", 12)


def test_forest_of_series_of_any_level(spark):
    got = ml.series_forest(two_scales(spark), "Product_ID", ["x", "z"], "Sales_Units", "Date", trees=20, depth=4).toPandas()
    assert got.groupby("Product_ID").size().to_dict() == {"P1": 12, "P2": 12}
    errors = np.abs(got["pred"] - got["actual"])
    assert errors[got["Product_ID"] == "P1"].mean() < 0.5 and errors.mean() < 50.0


def folded_scales(spark):
    folded = FC.add_cv_folds(two_scales(spark), ["Product_ID", "is_test"], "Date", 2)
    return folded.withColumn("fold", F.when(~F.col("is_test"), F.col("fold")))


def test_boosted_search_has_every_setting(spark):
    train = folded_scales(spark).where("NOT is_test")
    got = ml.boosted_search(train, "Product_ID", ["x", "z"], "Sales_Units", "Date", depths=(1, 2), trees=(2, 8), rates=(0.1, 0.3))
    assert len(got) == 8 and got == sorted(got)
    errors = {setting: mse for mse, *at in got for setting in [tuple(at)]}
    assert errors[1, 8, 0.1] < errors[1, 2, 0.1]


def test_boosted_series_takes_the_best_setting(spark):
    got = ml.boosted_series(folded_scales(spark), "Product_ID", ["x"], "Sales_Units", "Date", depths=(2,), trees=(1, 20), rates=(0.3,)).toPandas()
    assert len(got) == 24
    assert np.abs(got["pred"] - got["actual"])[got["Product_ID"] == "P1"].mean() < 0.5


def test_search_needs_a_fold(spark):
    train = folded_scales(spark).where("fold IS NULL AND NOT is_test")
    with pytest.raises(ValueError, match="fold"):
        ml.boosted_search(train, "Product_ID", ["x"], "Sales_Units", "Date")


def test_additive_fit_does_not_see_the_test_rows(spark):
    frame = weekly(200 + RNG.normal(size=80)).assign(On_Promo=False)
    frame["Marketing_Spend"] = RNG.uniform(1, 2, 80)
    frame["Week_Index"] = range(80)
    changed = frame.copy()
    changed.loc[68:, "Marketing_Spend"] *= 1000
    weights = []
    for f in (frame, changed):
        split, features = FC.additive_split(spark.createDataFrame(f))
        fitted = FC.entity_ols(split, "Product_ID", features, "Sales_Units", "Week_Index", 1e-3, fitted=True)
        weights.append([round(r["pred"], 6) for r in fitted.orderBy("Week_Index").collect()])
    assert weights[0] == weights[1]


def test_scaler_per_group(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, True), ("a", 5.0, False), ("b", 7.0, True), ("c", 1.0, False)], "k string, v double, train boolean")
    got = {(r["k"], r["v"]): r["v_std"] for r in standardise(df, ["v"], F.col("train"), ["k"]).collect()}
    assert got == {("a", 1.0): -1.0, ("a", 3.0): 1.0, ("a", 5.0): 3.0, ("b", 7.0): 0.0, ("c", 1.0): None}
