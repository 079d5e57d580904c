from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from kpiloom.operators import reports as RP
from kpiloom.sources import read_csv, read_fact_csv, write_alerts, write_csv, write_per_entity
from tests.helpers import rows


def months(spark):
    # The last two published months behind three alert lines.
    return spark.createDataFrame(
        [
            ("A", dt.date(2024, 11, 1), 10.0, 100.0),
            ("A", dt.date(2024, 12, 1), 12.17, 82.9),
            ("B", dt.date(2024, 11, 1), 10.0, 100.0),
            ("B", dt.date(2024, 12, 1), 10.5, 95.0),
            ("C", dt.date(2024, 12, 1), 99.0, 1.0),
        ],
        "Product_ID string, Month date, Lead_Time_days double, Efficiency_u_per_h double",
    )


def test_alerts(spark):
    got = {(r["Product_ID"], r["rule"]): r["line"] for r in RP.alerts(months(spark)).collect()}
    assert set(got) == {("A", "Lead_Time"), ("A", "Efficiency")}
    assert got["A", "Lead_Time"].endswith("21.7%")
    assert got["A", "Efficiency"].endswith("-17.1%")


def test_alert_file_says_when_nothing_is_found(spark, tmp_path):
    found, none = str(tmp_path / "found"), str(tmp_path / "none")
    write_alerts(RP.alerts(months(spark)), found)
    assert spark.read.text(found).count() == 2
    write_alerts(RP.alerts(months(spark).where("Product_ID = 'B'")), none)
    assert [r[0] for r in spark.read.text(none).collect()] == ["No critical alerts detected."]


def test_alert_order_and_language(spark, tmp_path):
    more = months(spark).union(months(spark).where("Product_ID = 'A'").withColumn("Product_ID", F.lit("Z")))
    totals = spark.createDataFrame([("A", 1.0), ("Z", 9.0)], "Product_ID string, Revenue double")
    path = str(tmp_path / "fa")
    write_alerts(RP.ordered_alerts(RP.alerts(more, language="fa"), totals, "Product_ID", "Revenue"), path, language="fa")
    lines = [r[0] for r in spark.read.text(path).collect()]
    assert [("Z" in x, "Lead Time" in x) for x in lines] == [(True, True), (True, False), (False, True), (False, False)]
    # Fixed value: a published line.
    assert lines[0] == "هشدار: افزایش Lead Time برای محصول Z در ماه اخیر: 21.7%"


def test_month_matrix_covers_the_calendar(spark):
    df = spark.createDataFrame(
        [("x", dt.date(2023, 12, 1), 1.0), ("x", dt.date(2024, 2, 1), 3.0), ("y", dt.date(2024, 2, 1), None)],
        "name string, Month date, pct double",
    )
    out = RP.month_matrix(df, "name", "pct")
    assert out.columns == ["name", "2023-12", "2024-01", "2024-02"]
    assert sorted(rows(out)) == [("x", 1.0, 0.0, 3.0), ("y", 0.0, 0.0, 0.0)]


def test_cohort_matrix_averages_months_of_one_period(spark):
    df = spark.createDataFrame(
        [(dt.date(2022, 1, 1), dt.date(2022, m, 1), float(m)) for m in (1, 2, 3)],
        "cohort date, Month date, v double",
    )
    sums = RP.cohort_sums(df, "cohort", "Month", "v")
    assert rows(RP.cohort_matrix(sums, "cohort", [0, 1, 2])) == [(dt.date(2022, 1, 1), 1.0, 2.5, None)]
    assert rows(RP.cohort_matrix(sums, "cohort")) == [(dt.date(2022, 1, 1), 1.0, 2.5, *[None] * 10)]


def test_names_of_a_matrix_must_differ(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x")], "id string, name string")
    RP.require_unique_names(df, "id", "name")
    with pytest.raises(ValueError, match="named x"):
        RP.require_unique_names(df.unionByName(spark.createDataFrame([("c", "x")], "id string, name string")), "id", "name")


def test_month_labels_of_whole_years(spark):
    df = spark.createDataFrame([(dt.date(2021, 3, 1),), (dt.date(2022, 2, 1),)], "Month date")
    assert RP.month_labels(df) == [f"2021-{m:02d}" for m in range(3, 13)] + ["2022-01", "2022-02"]
    assert len(RP.month_labels(df, whole_years=True)) == 24


def test_waterfall_bases(spark):
    df = spark.createDataFrame([("p", 100.0, 60.0, 30.0, 10.0)], "k string, Revenue double, COGS double, Expenses double, Profit double")
    out = RP.waterfall(df, "k", RP.profit_steps()).orderBy("step")
    assert rows(out, "label", "amount", "base") == [
        ("Revenue", 100.0, 0.0),
        ("COGS", -60.0, 100.0),
        ("Expenses", -30.0, 40.0),
        ("Profit", 10.0, 10.0),
    ]


def test_compare_and_stack(spark):
    t = spark.createDataFrame([("p", 1.0)], "k string, mse double")
    long = RP.stack_models({"A": t, "B": t.withColumn("mse", F.lit(2.0))})
    assert rows(RP.compare_models(long, "k", ["A", "B", "C"], ["mse"])) == [("p", 1.0, 2.0, None)]


def test_scatter_keeps_all_points(spark):
    df = spark.range(50).selectExpr("id AS x", "id * 2 AS y", "id % 3 AS g")
    assert RP.scatter_points(df, "x", "y", "g").count() == 50
    assert RP.scatter_points(df, "x", "y", fraction=0.5).count() < 50


def test_csv_round_trip_keeps_the_word_none(spark, tmp_path):
    path = str(tmp_path / "fact")
    df = spark.createDataFrame([("None", "2024-01-01 00:00:00", 1.5), ("Sale", "2024-01-08", None)], "c string, Date string, v double")
    write_csv(df, path)
    back = read_fact_csv(spark, path, "c string, Date string, v double").orderBy("Date")
    assert rows(back) == [("None", dt.date(2024, 1, 1), 1.5), ("Sale", dt.date(2024, 1, 8), None)]
    assert dict(read_csv(spark, path).dtypes)["v"] == "double"
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        write_csv(df, path)


def test_one_folder_per_entity(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(30).select((F.col("id") % 3).cast("string").alias("k"), "id")
    write_per_entity(df, path, "k")
    assert sorted(d for d in os.listdir(path) if d.startswith("k=")) == ["k=0", "k=1", "k=2"]
    assert spark.read.parquet(path).count() == 30
