from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from kpiloom.operators import stats

RNG = np.random.default_rng(11)


def test_correlation_guards(spark):
    frame = pd.DataFrame({"a": RNG.normal(size=50), "flat": 5.0})
    frame["b"] = frame["a"] * 2 + RNG.normal(size=50)
    frame.loc[3, "b"] = None
    df = spark.createDataFrame(frame).replace(float("nan"), None)
    got = {(r["x"], r["y"]): r["corr"] for r in stats.correlation_matrix(df, ["a", "b", "flat"]).collect()}
    want = frame.corr()
    assert len(got) == 9
    assert got["a", "b"] == got["b", "a"] == pytest.approx(want.loc["a", "b"])
    assert got["a", "a"] == 1.0
    assert got["a", "flat"] is None
    assert got["flat", "flat"] is None


def test_correlation_by_group(spark):
    df = spark.createDataFrame([("p", 1.0, 2.0), ("p", 2.0, 4.0), ("q", 1.0, 1.0)], "k string, a double, b double")
    got = {r["k"]: r["corr"] for r in stats.correlation_by_group(df, "k", "a", "b").collect()}
    assert got["p"] == pytest.approx(1.0)
    assert got["q"] is None


def test_histogram_matches_numpy(spark):
    values = np.round(RNG.normal(size=1000), 3)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = {r["bin"]: r["n"] for r in stats.histogram(df, "v").collect()}
    want, edges = np.histogram(values, bins=40)
    assert [got[i] for i in range(40)] == list(want)
    rows = stats.histogram(df, "v").orderBy("bin").collect()
    assert [r["low"] for r in rows] + [rows[-1]["high"]] == pytest.approx(list(edges))


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    want, _ = np.histogram([5.0, 5.0], bins=40)
    assert [r["n"] for r in stats.histogram(df, "v").orderBy("bin").collect()] == list(want)
    assert stats.histogram(df.where("v is null"), "v").collect() == []


def test_ols_matches_least_squares(spark):
    x = RNG.normal(size=(200, 2))
    y = 3.0 + x @ [2.0, -1.5] + RNG.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    got = {r["term"]: r["coefficient"] for r in stats.ols(df, "y", ["a", "b"]).collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert [got["intercept"], got["a"], got["b"]] == pytest.approx(list(want))


def test_regression_of_constant_x_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    got = stats.simple_regression(df, "y", "x").first()
    assert (got["slope"], got["r2"], got["n"]) == (None, None, 2)


def test_trend_skips_short_series(spark):
    data = [("a", i, 2.0 * i + 1) for i in range(10)] + [("b", i, 1.0) for i in range(9)]
    df = spark.createDataFrame(data, "Product_ID string, Week_Index long, Sales_Units double")
    got = stats.trend_forecast(df, "Product_ID", horizon=2).orderBy("Week_Index").collect()
    assert [(r["Product_ID"], r["Week_Index"]) for r in got] == [("a", 10), ("a", 11)]
    assert [r["pred"] for r in got] == pytest.approx([21.0, 23.0])
    assert got[0]["r2"] == pytest.approx(1.0)


def test_forecast_metrics_skip_zero_actuals(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 4.0, 2.0)], "k string, actual double, pred double")
    got = stats.forecast_metrics(df, ["k"]).first()
    assert got["mse"] == 2.5
    assert got["rmse"] == pytest.approx(math.sqrt(2.5))
    assert (got["mae"], got["mape"], got["mape_pct"]) == (1.5, 0.5, 50.0)


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t by numeric integration."""
    grid = np.linspace(0.0, abs(t), 200_001)
    norm = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    density = norm * (1 + grid * grid / df) ** (-(df + 1) / 2)
    return 1 - 2 * float(np.trapezoid(density, grid))


@pytest.mark.parametrize(("t", "df"), [(0.0, 5.0), (0.5, 3.3), (2.0, 10.0), (-2.5, 40.7), (4.0, 300.0)])
def test_student_t_tail(t, df):
    assert stats.student_t_p(t, df) == pytest.approx(t_tail(t, df), abs=1e-8)


def test_welch(spark):
    a, b = RNG.normal(0.0, 1.0, 80), RNG.normal(0.8, 2.0, 50)
    data = [("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("a", None), ("c", 99.0)]
    got = stats.welch_test(spark.createDataFrame(data, "g string, v double"), "g", "v", "a", "b").first()
    va, vb = a.var(ddof=1) / 80, b.var(ddof=1) / 50
    assert got["t"] == pytest.approx((a.mean() - b.mean()) / math.sqrt(va + vb))
    assert got["df"] == pytest.approx((va + vb) ** 2 / (va**2 / 79 + vb**2 / 49))
    assert got["p"] == pytest.approx(t_tail(got["t"], got["df"]), abs=1e-8)
    assert got["significant"] == (got["p"] < 0.05)


def test_standardise_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 7.0, True), (3.0, 7.0, True), (5.0, 7.0, False)], "v double, c double, train boolean")
    got = stats.standardise(df, ["v", "c"], df["train"]).orderBy("v").collect()
    assert [r["v_std"] for r in got] == [-1.0, 1.0, 3.0]
    assert {r["c_std"] for r in got} == {0.0}
