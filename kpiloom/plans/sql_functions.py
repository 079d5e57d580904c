"""The dashboard and growth tables as SQL table functions with named parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kpiloom.plans.fact import order_lines, product_week
from kpiloom.plans.registry import query
from kpiloom.plans.reporting import DASHBOARD_SQL
from kpiloom.plans.windowed import change_sql

PICK = "(category STRING DEFAULT NULL, region STRING DEFAULT NULL)"


def _dashboard(name: str, measures: dict[str, str]) -> str:
    """Monthly measures of one category and region; a null parameter takes all."""
    listed = ", ".join(f"{how}(l.{m}) AS {m}" for m, how in measures.items())
    return f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}{PICK}
        RETURNS TABLE (Month DATE, {", ".join(f"{m} DOUBLE" for m in measures)})
        RETURN SELECT CAST(date_trunc('month', l.Ship_Date) AS DATE) AS Month, {listed} FROM kpi_lines AS l
        WHERE ({name}.category IS NULL OR l.Category = {name}.category)
          AND ({name}.region IS NULL OR l.Region = {name}.region) GROUP BY 1"""


def register_functions(spark: SparkSession, sf_dir: str) -> None:
    """Views ``kpi_lines`` and ``kpi_weeks`` over the tables of a folder, and the
    functions ``dashboard_money``, ``dashboard_operations`` (category, region) and
    ``weekly_change`` (product) over them, for this session. They are expanded
    into the query that calls them, so its filters and columns reach the scans."""
    lines = ["Ship_Date", "Category", "Region", "Revenue", "Profit", "Efficiency_Rate", "Lead_Time_Days"]
    order_lines(spark, sf_dir, lines).createOrReplaceTempView("kpi_lines")
    product_week(spark, sf_dir, ["Sales_Units"]).createOrReplaceTempView("kpi_weeks")
    spark.sql(_dashboard("dashboard_money", {"Revenue": "sum", "Profit": "sum"}))
    spark.sql(_dashboard("dashboard_operations", {"Efficiency_Rate": "avg", "Lead_Time_Days": "avg"}))
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION weekly_change(product STRING DEFAULT NULL)
           RETURNS TABLE (Product_ID STRING, Date DATE, Sales_Units DOUBLE, WoW DOUBLE)
           RETURN SELECT Product_ID, Date, Sales_Units, try_divide(Sales_Units - before, before) FROM (
             SELECT Product_ID, CAST(Date AS DATE) AS Date, CAST(Sales_Units AS DOUBLE) AS Sales_Units,
               CAST(lag(Sales_Units) OVER (PARTITION BY Product_ID ORDER BY Date) AS DOUBLE) AS before
             FROM kpi_weeks WHERE weekly_change.product IS NULL OR Product_ID = weekly_change.product)"""
    )


@query("v4_sql_money", "Month:d Revenue:4 Profit:4", DASHBOARD_SQL)
def sql_money(spark: SparkSession, d: str) -> DataFrame:
    register_functions(spark, d)
    return spark.sql("SELECT * FROM dashboard_money(category => 'PROMO', region => 'AMERICA')")


@query("v4_sql_operations", "Month:d Efficiency_Rate:6 Lead_Time_Days:6", DASHBOARD_SQL)
def sql_operations(spark: SparkSession, d: str) -> DataFrame:
    register_functions(spark, d)
    return spark.sql("SELECT * FROM dashboard_operations(region => 'AMERICA', category => 'PROMO')")


@query(
    "v3_sql_change",
    "Product_ID:s Date:d Sales_Units:2 WoW:6",
    f'SELECT Product_ID, "Date", Sales_Units, {change_sql("Sales_Units", 1, "Date")} AS WoW FROM pw',
)
def sql_change(spark: SparkSession, d: str) -> DataFrame:
    register_functions(spark, d)
    return spark.sql("SELECT * FROM weekly_change()")
