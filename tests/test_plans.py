"""Plan shape: what reaches the scan, what shuffles, and how hot keys split."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kpiloom.operators.growth import weekly_metrics
from kpiloom.plans.fact import order_lines, product_week
from tests.helpers import plan_text

QUERIES = entry.queries()


def final_plan(df) -> str:
    df.collect()
    text = plan_text(df)
    return re.split(r"\+- == Initial Plan ==", text)[0]


def scans(plan: str, column_prefix: str) -> list[str]:
    return [s for s in re.findall(r"FileScan parquet \[([^\]]*)\]", plan) if column_prefix in s]


PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas")
PYTHON_QUERIES = ("m", "op", "pipeline", "p4_anomaly", "a35", "v4_dashboard_clusters", "a11_channel_bootstrap")
BUILT_IN = [n for n in QUERIES if not n.startswith(PYTHON_QUERIES)]


@pytest.mark.parametrize("name", BUILT_IN)
def test_relational_queries_use_no_python_and_no_cross_join(name, spark, sf_dir):
    plan = plan_text(QUERIES[name](spark, sf_dir))
    assert not [n for n in PYTHON_NODES if n in plan]
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_only_needed_tables_and_columns_are_read(spark, sf_dir):
    plan = final_plan(order_lines(spark, sf_dir, ["Ship_Date", "Revenue"]))
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in plan


def test_filters_reach_the_scan(spark, sf_dir):
    lines = order_lines(spark, sf_dir, ["Sales_Units", "Category", "Region"])
    plan = final_plan(lines.where((F.col("Category") == "ECONOMY") & (F.col("Region") == "ASIA")))
    assert "EqualTo(p_type,ECONOMY)" in plan
    assert "EqualTo(r_name,ASIA)" in plan


def test_unused_measures_are_not_computed(spark, sf_dir):
    fact = product_week(spark, sf_dir, ["Sales_Units", "Revenue", "Profit"]).select("Product_ID", "Date", "Sales_Units")
    assert scans(final_plan(fact), "l_quantity") and not scans(plan_text(fact), "l_extendedprice")


def test_weekly_metrics_take_one_exchange_after_the_fact(spark, sf_dir):
    columns = ["Sales_Units", "Revenue", "Lead_Time_days", "Efficiency_u_per_h"]
    fact = product_week(spark, sf_dir, columns)
    shuffles = r"(?<!Broadcast)Exchange hashpartitioning"
    before = len(re.findall(shuffles, final_plan(fact)))
    after = len(re.findall(shuffles, final_plan(weekly_metrics(fact))))
    assert after == before + 1


@pytest.mark.parametrize("name", ["r7_monthly_summary", "r8_alerts", "a36_cohort_sums", "j5_weekly_resample", "w4_cumulative_share"])
def test_raw_tables_are_scanned_at_most_once(name, spark, sf_dir):
    plan = final_plan(QUERIES[name](spark, sf_dir))
    assert len(scans(plan, "l_")) <= 1
    assert len(scans(plan, "o_")) <= 1


def test_top_n_does_not_sort_everything(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan_text(QUERIES["o3_largest"](spark, sf_dir))


HOT_SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def test_a_hot_part_key_is_split(spark, sf_dir, tmp_path):
    """A third of the lines on one part: with broadcasts off, the join's hot
    partition is split at run time, and no row is lost."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    hot = F.when(F.xxhash64("l_orderkey", "l_linenumber") % 3 == 0, F.lit(7).cast("long")).otherwise(F.col("l_partkey"))
    lines.withColumn("l_partkey", hot).repartition(8).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.read.parquet(f"{sf_dir}/part.parquet").write.parquet(str(tmp_path / "part.parquet"))
    old = {k: spark.conf.get(k, None) for k in HOT_SETTINGS}
    for k, v in HOT_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        fact = product_week(spark, str(tmp_path), ["Sales_Units"])
        total = sum(r["Sales_Units"] for r in fact.collect())
        assert "skew=true" in plan_text(fact)
        assert total == lines.agg(F.sum("l_quantity")).first()[0]
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_written_fact_gives_the_same_rows(spark, sf_dir, tmp_path):
    from kpiloom.plans.fact import FACT_SETTING, write_product_week

    names = ["a15_month_rich", "w1_product_wow", "r9_full_fact"]
    want = {n: sorted(map(str, QUERIES[n](spark, sf_dir).collect())) for n in names}
    path = f"{tmp_path}/fact"
    write_product_week(spark, sf_dir, path)
    spark.conf.set(FACT_SETTING, path)
    try:
        for n in names:
            df = QUERIES[n](spark, sf_dir)
            assert sorted(map(str, df.collect())) == want[n]
            assert not scans(plan_text(df), "l_quantity")
        with pytest.raises(ValueError, match="names a fact of"):
            QUERIES[names[0]](spark, sf_dir.replace("sf0.001", "sf0.01"))
    finally:
        spark.conf.unset(FACT_SETTING)
