from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiloom.operators import forecast as FC
from kpiloom.operators import growth as G
from kpiloom.operators import joins as J
from tests.helpers import rows


def weekly(spark, values, key="P1", start=dt.date(2022, 1, 3), skip=()):
    data = [
        (key, start + dt.timedelta(days=7 * i), i, v) for i, v in enumerate(values) if i not in skip
    ]
    return spark.createDataFrame(data, "Product_ID string, Date date, Week_Index long, Sales_Units double")


def column(df, name, order="Date"):
    return [r[0] for r in df.orderBy("Product_ID", order).select(name).collect()]


def test_zero_base_gives_null(spark):
    df = weekly(spark, [2.0, 0.0, 4.0, 0.0, 0.0])
    out = G.add_growth(df, ["Product_ID"], "Date", {"pct": ("Sales_Units", 1)})
    assert column(out, "pct") == [None, -1.0, None, -1.0, None]


def test_lag_counts_rows_until_densified(spark):
    df = weekly(spark, [1.0, 2.0, 0.0, 4.0], skip=(2,))
    plain = G.add_growth(df, ["Product_ID"], "Date", {"pct": ("Sales_Units", 1)})
    assert column(plain, "pct") == [None, 1.0, 1.0]
    grid = J.calendar_grid(df.select("Product_ID").distinct(), *J.bounds(df, "Date"))
    dense = J.align_to_spine(df.drop("Week_Index"), grid, ["Product_ID", "Date"])
    grown = G.add_growth(dense, ["Product_ID"], "Date", {"pct": ("Sales_Units", 1)})
    assert column(grown, "Sales_Units") == [1.0, 2.0, 0.0, 4.0]
    assert column(grown, "pct") == [None, 1.0, -1.0, None]


def test_published_month_changes(spark):
    # Two published months of one product and their changes.
    data = [("P001", dt.date(2022, 1, 1), 9876.0, 9.0, 104.072), ("P001", dt.date(2022, 2, 1), 7848.0, 5.25, 80.3125)]
    df = spark.createDataFrame(
        data, "Product_ID string, Month date, Sales_Units double, Lead_Time_days double, Efficiency_u_per_h double"
    )
    last = G.monthly_summary(df).orderBy("Month").collect()[-1]
    assert last["MoM_Sales_pct"] == pytest.approx(-0.20534629404617255)
    assert last["MoM_LeadTime_pct"] == pytest.approx(-0.41666666666666663)
    assert last["MoM_Eff_pct"] == pytest.approx(-0.22829867783841962)
    assert last["Rolling_3m_Sales"] == 8862.0
    assert last["MoM_Drop_Flag"] is True
    assert last["YoY_Sales_pct"] is None


def test_rolling_mean_of_short_series(spark):
    df = weekly(spark, [2.0, 4.0])
    out = G.add_rolling(df, ["Product_ID"], "Date", {"r4": ("Sales_Units", 4), "r1": ("Sales_Units", 1)})
    assert column(out, "r4") == [2.0, 3.0]
    assert column(out, "r1") == [2.0, 4.0]


def test_lags_fill_the_start(spark):
    df = weekly(spark, [0.0, 1.0, 2.0, 3.0, 4.0])
    out = G.add_lags(df, ["Product_ID"], "Date", "Sales_Units", [1, 3, 13])
    assert column(out, "lag_3") == [0.0, 0.0, 0.0, 0.0, 1.0]
    assert column(out, "lag_1") == [0.0, 0.0, 1.0, 2.0, 3.0]
    assert column(out, "lag_13") == [None] * 5


def test_features_without_the_current_row(spark):
    df = weekly(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    leaky = G.series_features(df, windows=(4,), lags=(1,))
    honest = G.series_features(df, windows=(4,), lags=(1,), include_current=False)
    assert column(leaky, "roll_4") == [1.0, 1.5, 2.0, 2.5, 3.5]
    assert column(honest, "roll_4") == [1.0, 1.0, 1.5, 2.0, 2.5]


def test_last_change_needs_two_rows(spark):
    df = weekly(spark, [4.0, 5.0]).union(weekly(spark, [3.0], key="P2"))
    out = G.last_change(df, ["Product_ID"], "Date", {"chg": "Sales_Units"})
    got = rows(out, "Product_ID", "chg")
    assert len(got) == 1
    assert got[0][0] == "P1"
    assert got[0][1] == pytest.approx(0.25)


def test_holdout_and_positions(spark):
    df = weekly(spark, [1.0, 2.0, 3.0, 4.0]).union(weekly(spark, [1.0], key="P2"))
    out = G.add_holdout(G.add_position(df, ["Product_ID"], "Date"), ["Product_ID"], "Date", 2, min_rows=3)
    assert rows(out.orderBy("Date"), "position", "is_test") == [(0, False), (1, False), (2, True), (3, True)]


def test_target_variants(spark):
    from kpiloom.operators.rollup import weekly_targets

    df = weekly(spark, [2.0, 2.76190476190476])  # mean * 1.05 = 2.5
    assert weekly_targets(df).first()["Weekly_Target"] == 2
    assert G.add_target(df).first()["Weekly_Target"] == 2
    up = weekly(spark, [19.0, 19.0])  # 19.95
    assert weekly_targets(up).first()["Weekly_Target"] == 20
    assert weekly_targets(up, rounding="truncate").first()["Weekly_Target"] == 19


def test_resample_labels_and_gaps(spark):
    df = weekly(spark, [1.0, 2.0, 3.0, 4.0], skip=(1, 2))
    out = J.resample_weekly(df, ["Product_ID"], "Date", "Sales_Units").orderBy("Week_End")
    days = [dt.date(2022, 1, 9), dt.date(2022, 1, 16), dt.date(2022, 1, 23), dt.date(2022, 1, 30)]
    assert rows(out, "Week_End", "Sales_Units") == list(zip(days, [1.0, 0.0, 0.0, 4.0], strict=True))


def test_future_weeks_and_regressors(spark):
    df = weekly(spark, [1.0, 2.0])
    future = J.future_weeks(df, ["Product_ID"], 2)
    known = spark.createDataFrame([("P1", 2, 7.0)], "Product_ID string, Week_Index long, Spend double")
    out = J.with_known_regressors(future, known, ["Product_ID", "Week_Index"], {"Spend": 0.0}).orderBy("Week_Index")
    assert rows(out, "Week_Index", "Date", "Spend") == [
        (2, dt.date(2022, 1, 17), 7.0),
        (3, dt.date(2022, 1, 24), 0.0),
    ]


def test_first_period_of_hot_key(spark):
    df = spark.range(300).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), (F.col("id") % 7).alias("p")
    )
    out = J.add_first_period(df, "k", "p", "first")
    assert out.count() == 300
    assert out.where("k = 0 AND first <> 0").count() == 0


def test_null_keys_are_dropped_and_null_measures_ignored(spark):
    from kpiloom.operators.rollup import rollup

    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 5.0)], "k string, v double")
    assert rows(rollup(df, ["k"], {"v": "mean"})) == [("a", 1.0)]
    assert rollup(df, [], {"v": "sum"}).first()[0] == 6.0


def test_last_per_group_skips_nulls(spark):
    from kpiloom.operators.rollup import last_per_group

    df = spark.createDataFrame([("a", 1, 1.0, 9.0), ("a", 2, 2.0, None)], "k string, t int, x double, y double")
    assert rows(last_per_group(df, "k", "t", ["x", "y"])) == [("a", 2.0, 9.0)]


def test_bootstrap_interval_covers_the_normal_one(spark):
    from kpiloom.operators.rollup import mean_with_bootstrap, mean_with_interval

    df = spark.range(2000).select((F.col("id") % 2).cast("string").alias("k"), (F.col("id") % 17).alias("v"), "id")
    normal = {r["k"]: r for r in mean_with_interval(df, "k", "v").collect()}
    first = mean_with_bootstrap(df, "k", "v", ["id"], replicates=400).collect()
    again = mean_with_bootstrap(df, "k", "v", ["id"], replicates=400).collect()
    assert sorted(first) == sorted(again)
    for r in first:
        n = normal[r["k"]]
        assert r["mean"] == pytest.approx(n["mean"])
        assert r["low"] == pytest.approx(n["low"], abs=0.1)
        assert r["high"] == pytest.approx(n["high"], abs=0.1)


def test_filled_weeks_keep_the_known_ones(spark):
    df = weekly(spark, [1.0, 2.0, 3.0, 4.0], skip=(1, 2)).withColumn("Price", F.lit(7.0))
    got = J.fill_weeks(df, ["Product_ID"], "Date", ["Sales_Units"])
    assert column(got, "Sales_Units") == [1.0, 0.0, 0.0, 4.0]
    assert column(got, "Price") == [7.0, None, None, 7.0]
    assert got.agg(F.count_distinct("Date")).first()[0] == 4


def bent_series(spark, bend: int, n: int = 160):
    """Weekly units with a slope that changes at week ``bend`` and some noise."""
    draw = np.random.default_rng(8)
    week = np.arange(n)
    units = 500 + 1.0 * week + 6.0 * np.maximum(week - bend, 0) + draw.normal(0, 8, n)
    rows = [("p", int(w), dt.date(2020, 1, 6) + dt.timedelta(weeks=int(w)), float(u), 0, 0.0) for w, u in zip(week, units)]
    return spark.createDataFrame(rows, "Product_ID string, Week_Index int, Date date, Sales_Units double, On_Promo int, Marketing_Spend double")


def test_a_planted_slope_change_is_found(spark):
    fact = bent_series(spark, 70)
    changes = FC.trend_changes(fact).collect()
    near = sum(r["slope_change"] for r in changes if abs(r["Week_Index"] - 70) <= 12)
    assert near == pytest.approx(6.0, rel=0.25)
    error = F.avg((F.col("actual") - F.col("pred")) ** 2)
    bent, straight = (m(fact).agg(error).first()[0] for m in (FC.changepoint_backtest, FC.additive_backtest))
    assert bent < straight / 4


def test_a_straight_trend_has_no_large_change(spark):
    assert all(abs(r["slope_change"]) < 0.5 for r in FC.trend_changes(bent_series(spark, 1_000)).collect())


def test_coordinate_descent_meets_the_conditions_of_the_minimum():
    draw = np.random.default_rng(2)
    a, target = draw.normal(size=(60, 8)), draw.normal(size=60)
    gram, cross, penalty = a.T @ a, a.T @ target, 3.0
    w = FC.lasso(gram, cross, penalty, np.zeros(8))
    slope = cross - gram @ w
    assert 0 < np.count_nonzero(w) < 8
    assert np.allclose(slope[w != 0], penalty * np.sign(w[w != 0]), atol=1e-5)
    assert (np.abs(slope[w == 0]) <= penalty + 1e-9).all()
    assert not FC.lasso(gram, cross, np.abs(cross).max() + 0.1, np.zeros(8)).any()


def test_season_weights_are_products_of_two_factors():
    draw = np.random.default_rng(4)
    e, w = draw.normal(size=3_000), np.zeros(3_000)
    for t in range(13, 3_000):
        w[t] = 0.5 * w[t - 1] + 0.4 * w[t - 12] - 0.2 * w[t - 13] + e[t]
    ar, ma, _ = FC.fit_arma(w[100:], (1, 12, 13))
    assert ar[2] == pytest.approx(-ar[0] * ar[1]) and ma[2] == pytest.approx(ma[0] * ma[1])
    assert ar[:2] == pytest.approx([0.5, 0.4], abs=0.12)


def test_forecast_steps_rebuilt_from_the_weights():
    draw = np.random.default_rng(9)
    y = 100 + np.cumsum(draw.normal(size=120)) + 10 * np.sin(np.arange(120) * np.pi / 6)
    w = (y[13:] - y[12:-1]) - (y[1:-12] - y[:-13])
    ar, ma, noise = FC.fit_arma(w, (1, 12, 13))
    got = FC.sarima_forecast(y, w, (1, 12, 13), 12)
    whole, errors = np.concatenate([y, got]), np.concatenate([noise, np.zeros(12)])
    diffs = (whole[13:] - whole[12:-1]) - (whole[1:-12] - whole[:-13])
    for t in range(len(w), len(w) + 12):
        lagged, shocks = diffs[[t - 1, t - 12, t - 13]], errors[[t - 1, t - 12, t - 13]]
        assert diffs[t] == pytest.approx(ar @ lagged + ma @ shocks, abs=1e-8)
