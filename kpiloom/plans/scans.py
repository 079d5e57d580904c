"""Sources and sinks: each query writes and reads the whole table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions import month_start
from kpiloom.operators.growth import monthly_summary
from kpiloom.operators.reports import alerts, ordered_alerts, stack_models
from kpiloom.operators.rollup import calendar_rollup, rollup
from kpiloom.operators.stats import forecast_metrics
from kpiloom.plans.fact import order_lines, product_week
from kpiloom.plans.registry import query
from kpiloom.plans.shared import (
    ALERT_SQL,
    SUMMARY_MEASURES,
    SUMMARY_OUT,
    SUMMARY_SQL,
    monthly_of_top,
    top_monthly,
    top_products,
    written_fact,
)
from kpiloom.session import scratch_path
from kpiloom.sources import read_csv, read_fact_csv, table, write_alerts, write_csv, write_per_entity


@query(
    "s1_csv_scan",
    "o_orderstatus:s n:i total:2 first_day:d last_day:d",
    """SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total,
              min(o_orderdate) AS first_day, max(o_orderdate) AS last_day
       FROM orders GROUP BY 1""",
)
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "orders_csv")
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    write_csv(table(spark, d, "orders").select(*columns), path)
    schema = "o_orderkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz"
    return read_csv(spark, path, schema).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("o_totalprice").alias("total"),
        F.min("o_orderdate").alias("first_day"),
        F.max("o_orderdate").alias("last_day"),
    )


@query(
    "s2_csv_dates",
    "Product_ID:s Date:d Week_Index:i Sales_Units:2 On_Promo:b",
    'SELECT Product_ID, "Date", Week_Index, Sales_Units, On_Promo FROM pw',
)
def csv_dates(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "fact_csv")
    fact = product_week(spark, d, ["Week_Index", "Sales_Units", "On_Promo"])
    write_csv(fact, path)
    return read_fact_csv(
        spark, path, "Product_ID string, Date string, Week_Index long, Sales_Units double, On_Promo boolean"
    )


@query(
    "s3_text_to_date",
    "Month:d n:i",
    "SELECT date_trunc('month', l_shipdate) AS \"Month\", count(*) AS n FROM lineitem GROUP BY 1",
)
def text_to_date(spark: SparkSession, d: str) -> DataFrame:
    text = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("text"))
    parsed = text.select(F.to_timestamp("text", "yyyy-MM-dd HH:mm:ss").alias("Date"))
    return parsed.groupBy(month_start("Date").alias("Month")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "s4_csv_sink",
    "Month:d Sales_Units:2 Revenue:4",
    """SELECT date_trunc('month', Ship_Date) AS "Month", sum(Sales_Units) AS Sales_Units, sum(Revenue) AS Revenue
       FROM lines GROUP BY 1""",
)
def csv_sink(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "monthly_csv")
    lines = order_lines(spark, d, ["Ship_Date", "Sales_Units", "Revenue"])
    write_csv(calendar_rollup(lines, "Month", {"Sales_Units": "sum", "Revenue": "sum"}, date="Ship_Date"), path)
    return read_csv(spark, path, "Month date, Sales_Units double, Revenue double")


@query("s5_file_per_entity", SUMMARY_OUT, SUMMARY_SQL)
def file_per_entity(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "summary_by_product")
    write_per_entity(_summary(spark, d), path, "Product_ID")
    return spark.read.parquet(path)


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return monthly_summary(top_monthly(spark, d))


@query(
    "s6_alert_text",
    "value:s",
    f"""WITH a AS ({ALERT_SQL})
        SELECT line AS value FROM a
        UNION ALL SELECT 'No critical alerts detected.' WHERE NOT EXISTS (SELECT 1 FROM a)""",
)
def alert_text(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "alerts_txt")
    fact = written_fact(spark, d, ["Month", "Year", "Product_Name", "Category", *SUMMARY_MEASURES])
    fired = alerts(monthly_of_top(fact))
    write_alerts(ordered_alerts(fired, top_products(fact), "Product_ID", "Revenue"), path)
    return spark.read.text(path)


@query(
    "s7_result_records",
    "Product_ID:s Model:s mse:4 mae:4 n:i",
    """WITH m AS (
         SELECT Product_ID, "Month", sum(Sales_Units) AS y FROM pw GROUP BY 1, 2
       ), p AS (
         SELECT Product_ID, y,
           lag(y) OVER (PARTITION BY Product_ID ORDER BY "Month") AS previous,
           avg(y) OVER (PARTITION BY Product_ID) AS level
         FROM m
       ), u AS (
         SELECT Product_ID, 'last value' AS Model, y, previous AS pred FROM p
         UNION ALL SELECT Product_ID, 'mean', y, level FROM p
       )
       SELECT Product_ID, Model, avg((y - pred) * (y - pred)) AS mse, avg(abs(y - pred)) AS mae, count(*) AS n
       FROM u GROUP BY 1, 2""",
)
def result_records(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    monthly = rollup(product_week(spark, d, ["Month", "Sales_Units"]), ["Product_ID", "Month"], {"Sales_Units": "sum"})
    by_product = W.partitionBy("Product_ID")
    known = monthly.select(
        "Product_ID",
        F.col("Sales_Units").alias("actual"),
        F.lag("Sales_Units").over(by_product.orderBy("Month")).alias("previous"),
        F.avg("Sales_Units").over(by_product).alias("level"),
    )
    models = {
        "last value": known.select("Product_ID", "actual", F.col("previous").alias("pred")),
        "mean": known.select("Product_ID", "actual", F.col("level").alias("pred")),
    }
    return forecast_metrics(stack_models(models), ["Product_ID", "Model"])


@query(
    "s8_preview",
    "Product_ID:s Date:d Sales_Units:2",
    'SELECT Product_ID, "Date", Sales_Units FROM pw ORDER BY Product_ID, "Date" LIMIT 20',
)
def preview(spark: SparkSession, d: str) -> DataFrame:
    return product_week(spark, d, ["Sales_Units"]).orderBy("Product_ID", "Date").limit(20)
