"""Operators whose memory is bounded whatever the number of keys, columns or points."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiloom.operators import comoments as CM
from kpiloom.operators import heavy as H
from kpiloom.operators import reports as RP
from kpiloom.operators import stats
from tests.helpers import plan_text


def _sums(df, n):
    sums = {}
    for key, value in df.collect():
        if key is not None and value is not None and not np.isnan(value):
            sums[key] = sums.get(key, 0.0) + value
    return sorted(sums.items(), key=lambda r: (-r[1], r[0]))[:n]


@pytest.fixture(scope="module")
def skewed(spark):
    """40,000 keys, a few of them with much of the total, over many partitions."""
    heavy = F.when(F.col("id") % 5 == 0, F.col("id") % 35).otherwise(F.col("id") * 7 % 40_009 + 100)
    value = (F.col("id") % 13 + 1).cast("double")
    return spark.range(0, 120_000, 1, 12).select(heavy.alias("k"), value.alias("v"))


def test_top_sums_from_bounded_summaries(spark, skewed):
    listed = H.candidates(skewed.select(F.col("k").alias("key"), F.col("v").alias("value")), 5, held=500)
    assert listed is not None and 5 <= listed.count() < 500
    got = [tuple(r) for r in H.top_sums(skewed, "k", "v", 5, held=500).collect()]
    assert got == _sums(skewed, 5)


def test_top_sums_without_a_proof_sum_all_keys(spark, skewed):
    even = spark.range(0, 20_000, 1, 8).select((F.col("id") % 9_973).alias("k"), (F.col("id") % 11).cast("double").alias("v"))
    assert H.candidates(even.select(F.col("k").alias("key"), F.col("v").alias("value")), 5, held=50) is None
    assert [tuple(r) for r in H.top_sums(even, "k", "v", 5, held=50).collect()] == _sums(even, 5)
    negative = skewed.withColumn("v", F.when(F.col("k") == 5, -F.col("v")).otherwise(F.col("v")))
    assert [tuple(r) for r in H.top_sums(negative, "k", "v", 5, held=500).collect()] == _sums(negative, 5)


def test_top_sums_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), (None, 9.0), ("c", None), ("d", float("nan"))], "k string, v double")
    assert [tuple(r) for r in H.top_sums(df, "k", "v", 3).collect()] == [("a", 1.0), ("b", 1.0)]
    assert [tuple(r) for r in H.top_sums(df, "k", "v", 1).collect()] == [("a", 1.0)]
    assert H.top_sums(df.where("false"), "k", "v", 3).collect() == []


def test_blocks_match_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(CM, "BLOCK", 2)
    monkeypatch.setattr(CM, "FAN_IN", 3)
    draw = np.random.default_rng(5)
    rows = [[None if draw.random() < 0.2 else float(v) for v in [*(draw.normal(size=4) + 1e6), 7.0]] for _ in range(200)]
    rows += [[float("nan")] * 5, [None] * 5]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(5))).repartition(11)
    want = {(r["x"], r["y"]): r["corr"] for r in stats.correlation_matrix(df.replace(float("nan"), None), df.columns).collect()}
    got = {(r["x"], r["y"]): r["corr"] for r in CM.correlation_blocks(df, df.columns).collect()}
    assert got.keys() == want.keys()
    for pair, value in want.items():
        assert got[pair] is None if value is None else got[pair] == pytest.approx(value, abs=1e-9)


def test_three_hundred_columns(spark):
    columns = [(F.hash("id", F.lit(i)) / 2**31 + (F.col("id") % 7 if i % 2 else 0)).alias(f"c{i}") for i in range(300)]
    df = spark.range(0, 2_000, 1, 8).select(*columns)
    got = CM.correlation_blocks(df, df.columns).toPandas()
    assert len(got) == 300 * 300
    want = df.toPandas().corr()
    found = got.pivot(index="x", columns="y", values="corr").loc[want.index, want.columns]
    assert np.abs(found.to_numpy() - want.to_numpy()).max() < 1e-9


def test_blocks_without_rows(spark):
    df = spark.createDataFrame([(None, None)], "a double, b double")
    assert all(r["corr"] is None for r in CM.correlation_blocks(df, ["a", "b"]).collect())


def test_bounded_points_do_not_follow_the_partitions(spark):
    df = spark.range(3_000).select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 2).alias("x"), F.lit(1.0).alias("y"))
    first = RP.scatter_points(df, "x", "y", "g", keys=["id"], most=20)
    again = RP.scatter_points(df.repartition(13, "x"), "x", "y", "g", keys=["id"], most=20)
    assert sorted(first.collect()) == sorted(again.collect()) and first.count() == 60
    assert "WindowGroupLimit" in plan_text(first)
    assert RP.scatter_points(df, "x", "y", keys=["id"], most=20).count() == 20
    with pytest.raises(ValueError):
        RP.scatter_points(df, "x", "y", most=20)
