"""Results that are put together from sums, sketches and blocks, against brute force."""

from __future__ import annotations

import datetime as dt
import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kpiloom.operators import forecast as FC
from kpiloom.operators import gram, halo, qr, rollup, sketches
from tests.helpers import plan_text, rows

RNG = np.random.default_rng(11)


# --- one series in blocks -----------------------------------------------------


def series(spark, n, ties=3):
    values = [float(v) if v else None for v in RNG.integers(0, 6, n)]
    return spark.createDataFrame([(i, i // ties, v) for i, v in enumerate(values)], "id long, t long, v double").repartition(7)


@pytest.mark.parametrize(("n", "block"), [(500, 7), (500, 64), (3, 7), (500, 100_000)])
def test_blocks_equal_one_window(spark, n, block):
    df = series(spark, n).cache()
    got = halo.add_series_growth(df, ["t", "id"], {"c1": ("v", 1), "c5": ("v", 5)}, {"m4": ("v", 4)}, block)
    frame = df.toPandas().sort_values("id")
    v = frame["v"].astype(float)
    want = pd.DataFrame({"id": frame["id"], "position": range(n)})
    for name, lag in (("c1", 1), ("c5", 5)):
        base = v.shift(lag)
        want[name] = ((v - base) / base.where(base != 0)).to_numpy()
    want["m4"] = v.rolling(4, min_periods=1).mean().to_numpy()
    mine = got.toPandas().sort_values("id")
    assert len(mine) == n and list(mine["position"]) == list(range(n))
    for c in ("c1", "c5", "m4"):
        assert np.allclose(mine[c].astype(float), want[c], equal_nan=True)


def test_no_window_holds_the_whole_series(spark):
    out = halo.add_series_growth(series(spark, 400), ["t", "id"], {"c": ("v", 1)}, block=50)
    out.collect()
    assert "SinglePartition" not in plan_text(out)


def test_empty_series_and_long_reach(spark):
    empty = series(spark, 3).limit(0)
    assert halo.add_series_growth(empty, ["t", "id"], {"c": ("v", 1)}).collect() == []
    with pytest.raises(ValueError, match="cannot lend"):
        halo.add_series_growth(empty, ["t", "id"], {"c": ("v", 9)}, block=8)


# --- folds from Gram matrices ---------------------------------------------------


def folded_frame(n=60, keys=("a", "b")):
    frames = []
    for k in keys:
        x = RNG.normal(1e4, 1, (n, 3))
        frame = pd.DataFrame({"k": k, "Date": [dt.date(2020, 1, 6) + dt.timedelta(days=7 * i) for i in range(n)], **{f"x{i}": x[:, i] for i in range(3)}})
        frame["x3"] = frame["x0"] + frame["x1"]  # collinear
        frame["y"] = 3e5 + 2 * frame["x0"] - frame["x2"] + RNG.normal(size=n)
        frames.append(frame)
    return pd.concat(frames)


@pytest.mark.parametrize("features", [["x0"], ["x0", "x2"], ["x0", "x1", "x2", "x3"]])
def test_fold_errors_equal_refits(spark, features):
    frame = folded_frame()
    folded = FC.add_cv_folds(spark.createDataFrame(frame), ["k"], "Date", 4)
    got = {(r["k"], r["fold"]): r for r in gram.fold_errors(folded, "k", features, "y").collect()}
    assert len(got) == 8
    for k, rows_ in frame.groupby("k"):
        for fold in range(4):
            cut = 12 * (fold + 1)
            x, y = rows_[features].to_numpy() - 1e4, rows_["y"].to_numpy() - 3e5
            design = np.column_stack([np.ones(len(x)), x])
            weights = np.linalg.lstsq(design[:cut], y[:cut], rcond=1e-9)[0]
            error = np.mean((y[cut : cut + 12] - design[cut : cut + 12] @ weights) ** 2)
            assert got[k, fold]["mse"] == pytest.approx(error, rel=1e-6)
            assert (got[k, fold]["train"], got[k, fold]["n"]) == (cut, 12)


def test_folds_leave_missing_values_out(spark):
    frame = folded_frame(keys=("a",))
    frame.loc[frame.index[3], "x0"] = np.nan
    folded = FC.add_cv_folds(spark.createDataFrame(frame), ["k"], "Date", 4)
    assert [r["train"] for r in gram.fold_errors(folded, "k", ["x0"], "y").orderBy("fold").collect()] == [11, 23, 35, 47]


# --- descriptions from stored sketches -------------------------------------------


def test_months_add_up(spark):
    days = [dt.date(2021, 1, 1) + dt.timedelta(days=int(i)) for i in RNG.integers(0, 365, 20_000)]
    values = np.where(RNG.random(20_000) < 0.3, 5.0, RNG.lognormal(0, 3, 20_000))
    data = pd.DataFrame({"d": days, "v": values, "w": np.arange(20_000.0)})
    df = spark.createDataFrame(data).withColumn("v", F.when(F.col("w") % 50 == 0, float("nan")).otherwise(F.col("v")))
    stored = sketches.month_summaries(df, ["v", "w"], F.trunc("d", "month"), size=200).checkpoint()
    assert stored.count() == 24
    first, last = dt.date(2021, 3, 1), dt.date(2021, 10, 1)
    described = sketches.describe_months(stored, first, last)
    part = df.where(F.trunc("d", "month").between(F.lit(first), F.lit(last)))
    kept = data[[first <= d.replace(day=1) <= last for d in data["d"]]]
    known = kept[kept["w"] % 50 != 0]["v"]
    got = {r["metric"]: r for r in described.collect()}
    assert got["v"]["count"] == len(known) and got["w"]["count"] == len(kept)
    assert got["v"]["mean"] == pytest.approx(known.mean()) and got["v"]["std"] == pytest.approx(known.std())
    assert (got["w"]["min"], got["w"]["max"]) == (kept["w"].min(), kept["w"].max())
    off = {r["metric"]: r["off"] for r in sketches.ranks_of(part, described, ["v", "w"]).collect()}
    assert max(off.values()) <= sketches.rank_error(200) and set(off) == {"v", "w"}


def test_ranges_without_values(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 1), None)], "d date, v double")
    stored = sketches.month_summaries(df, ["v"], F.col("d"))
    assert stored.collect() == [] and sketches.describe_months(stored, dt.date(2021, 1, 1), dt.date(2021, 1, 1)).collect() == []


# --- bootstrap over rows -----------------------------------------------------------


def plain_bootstrap(values, keys, replicates, seed=42):
    prime = (1 << 31) - 1
    steps = [round(prime * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10)]
    means = []
    for r in range(replicates):
        total = count = 0
        for v, key in zip(values, keys):
            digest = hashlib.md5(f"{seed}-{key}".encode()).hexdigest()
            draw = (int(digest[:8], 16) % prime + r * (int(digest[8:16], 16) % (prime - 1) + 1)) % prime
            weight = sum(draw >= s for s in steps)
            total, count = total + weight * v, count + weight
        means.append(total / count)
    return np.quantile(means, (0.025, 0.975))


@pytest.mark.parametrize("weights", [1 << 21, 64])
def test_bootstrap_draws_rows(spark, monkeypatch, weights):
    monkeypatch.setattr(rollup, "_WEIGHTS", weights)
    monkeypatch.setattr(rollup, "_GROUPS", 1 if weights == 64 else 256)
    data = [(i, "ab"[i % 2], float(v)) for i, v in enumerate(RNG.normal(5, 2, 80))]
    df = spark.createDataFrame([*data, (80, "a", None), (81, "a", float("nan")), (82, "c", None), (83, None, 1.0)], "id long, k string, v double")
    got = {r["k"]: r for r in rollup.mean_with_bootstrap(df.repartition(3), "k", "v", ["id"], replicates=50).collect()}
    for k in "ab":
        mine = [(i, v) for i, g, v in data if g == k]
        low, high = plain_bootstrap([v for _, v in mine], [i for i, _ in mine], 50)
        assert (got[k]["low"], got[k]["high"]) == (pytest.approx(low), pytest.approx(high)) and got[k]["n"] == 40
    assert tuple(got["c"]) == ("c", 0, None, None, None) and set(got) == {"a", "b", "c"}


def test_bootstrap_weights_are_poisson():
    draws = np.random.default_rng(1).integers(0, rollup.PRIME, 200_000)
    weights = np.searchsorted(rollup.POISSON, draws, side="right")
    assert weights.mean() == pytest.approx(1, abs=0.01) and weights.var() == pytest.approx(1, abs=0.02)


def test_bootstrap_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id long, k string, v double")
    assert rows(rollup.mean_with_bootstrap(df, "k", "v", ["id"])) == []


# --- least squares by QR ------------------------------------------------------------


@pytest.mark.parametrize(("rows_", "fan"), [(1 << 15, 64), (50, 1)])
def test_nearly_collinear_features(spark, monkeypatch, rows_, fan):
    monkeypatch.setattr(qr, "ROWS", rows_)
    monkeypatch.setattr(qr, "FAN_IN", fan)
    x = RNG.normal(size=2000)
    twin = x + 1e-7 * RNG.normal(size=2000)
    data = pd.DataFrame({"a": x, "b": twin, "c": RNG.normal(100, 5, 2000)})
    data["y"] = 7 + 2 * data["a"] - 3 * data["b"] + 0.5 * data["c"]
    df = spark.createDataFrame(data).repartition(6)
    got = {r["term"]: r["coefficient"] for r in qr.qr_ols(df, "y", ["a", "b", "c"]).collect()}
    for term, want in (("intercept", 7), ("a", 2), ("b", -3), ("c", 0.5)):
        assert got[term] == pytest.approx(want, abs=1e-6)


def test_qr_leaves_missing_rows_out(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (2.0, 5.0), (None, 9.0), (3.0, float("nan"))], "x double, y double")
    got = {r["term"]: r["coefficient"] for r in qr.qr_ols(df, "y", ["x"]).collect()}
    assert got == {"intercept": pytest.approx(1), "x": pytest.approx(2)}
    with pytest.raises(ValueError, match="two complete"):
        qr.qr_ols(df.limit(0), "y", ["x"])
