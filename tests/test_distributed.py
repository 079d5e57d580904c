"""Operators that replace a single-task step, against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kpiloom.operators import quantiles
from kpiloom.operators.quantiles import exact_quantiles
from kpiloom.operators.ranking import pareto, pareto_crossing, pareto_set, running_total, top_n
from kpiloom.operators.stats import describe
from tests.helpers import rows

RNG = np.random.default_rng(7)
COLUMNS = {
    "uniform": RNG.uniform(-50, 50, 4000),
    "hot": np.where(RNG.random(4000) < 0.4, 3.25, np.round(RNG.uniform(0, 10, 4000), 2)),
    "outlier": np.append(RNG.normal(size=3999), 1e12),
    "constant": np.full(4000, 5.0),
    "whole": RNG.integers(0, 5, 4000).astype(float),
}


@pytest.mark.parametrize(("accuracy", "most"), [(10_000, 100_000), (50, 10), (50, 1)])
def test_quantiles_match_numpy(spark, accuracy, most):
    df = spark.createDataFrame(pd.DataFrame(COLUMNS))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r["metric"], r["p"]): r["value"] for r in exact_quantiles(df, list(COLUMNS), probs, accuracy, most).collect()}
    assert len(got) == len(COLUMNS) * len(probs)
    for name, values in COLUMNS.items():
        for p in probs:
            assert got[name, p] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-9), (name, p)


@pytest.mark.parametrize("most", [1, 100])
@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_quantiles_of_few_rows_and_nulls(spark, n, most):
    values = [float(i * i) for i in range(n)]
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    got = {r["p"]: r["value"] for r in exact_quantiles(df, ["v"], [0.25, 0.5, 0.75], most=most).collect()}
    assert got == {p: pytest.approx(np.quantile(values, p)) for p in (0.25, 0.5, 0.75)}


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert exact_quantiles(df, ["v"], [0.5]).collect() == []


def test_heavy_tails_do_not_widen_the_bounds(spark):
    """One value of 1e12 among 200,000: no task ranks more than the stated number."""
    values = np.append(RNG.normal(size=200_000), 1e12)
    df = spark.createDataFrame(pd.DataFrame({"v0": values}))
    spots = quantiles._narrowed(df, quantiles._whole(df, 1, [0.25, 0.5, 0.75]), 1000, 2000)
    assert all(s.distinct <= 2000 and s.inside <= 4000 for s in spots)
    got = {r["p"]: r["value"] for r in exact_quantiles(df, ["v0"], [0.25, 0.5, 0.75], 1000, 2000).collect()}
    assert got == {p: pytest.approx(np.quantile(values, p)) for p in got} and len(got) == 3


def test_describe_matches_pandas(spark):
    frame = pd.DataFrame({k: COLUMNS[k] for k in ("uniform", "hot", "whole")})
    frame.loc[:9, "uniform"] = None
    got = describe(spark.createDataFrame(frame), list(frame.columns)).toPandas()
    want = frame.describe().T
    want.columns = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    got = got.set_index("metric").loc[want.index]
    pd.testing.assert_frame_equal(got.astype(float), want.astype(float), check_names=False)


def test_describe_skips_nan(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 102)] + [(float("nan"),)] * 5, "v double")
    for method in ("exact", "approximate"):
        got = describe(df, ["v"], method=method).first()
        assert (got["count"], got["p25"], got["p50"], got["mean"], got["max"]) == (101, 26.0, 51.0, 51.0, 101.0)


def test_describe_sketch_is_close(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": COLUMNS["uniform"]}))
    got = describe(df, ["v"], method="approximate").first()
    assert got["p50"] == pytest.approx(np.quantile(COLUMNS["uniform"], 0.5), abs=0.5)


@pytest.mark.parametrize("partitions", [None, 1, 7])
def test_running_total_with_ties(spark, partitions):
    data = [(f"P{i:03d}", float(100 if i % 3 == 0 else i)) for i in range(200)]
    df = spark.createDataFrame(data, "id string, v double").repartition(5)
    out, total = running_total(df, [F.col("v").desc(), F.col("id").asc()], "v", "cum", partitions)
    got = rows(out.withColumn("total", total), "id", "cum", "total")
    want = pd.DataFrame(data, columns=["id", "v"]).sort_values(["v", "id"], ascending=[False, True])
    want["cum"] = want["v"].cumsum()
    assert {g[0]: g[1] for g in got} == dict(zip(want["id"], want["cum"], strict=True))
    assert {g[2] for g in got} == {want["v"].sum()}


def test_pareto(spark):
    df = spark.createDataFrame([("a", 50.0), ("b", 30.0), ("c", 15.0), ("d", 5.0)], "Product_ID string, Revenue double")
    table = pareto(df)
    shares = {r["Product_ID"]: r["Cumulative_Revenue_pct"] for r in table.collect()}
    assert shares == {"a": 0.5, "b": 0.8, "c": 0.95, "d": 1.0}
    assert {r["Product_ID"] for r in pareto_set(table).collect()} == {"a", "b"}
    assert pareto_crossing(table).first()["Product_ID"] == "b"


def test_pareto_of_nothing_sold(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "Product_ID string, Revenue double")
    assert {r["Cumulative_Revenue_pct"] for r in pareto(df).collect()} == {None}


def test_top_n_breaks_ties_by_id(spark):
    df = spark.createDataFrame([("b", 5.0), ("a", 5.0), ("c", 9.0)], "id string, v double")
    assert [r["id"] for r in top_n(df, "v", 2, "id").collect()] == ["c", "a"]
