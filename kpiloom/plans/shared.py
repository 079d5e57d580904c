"""Rollups that several queries start from, with their SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from kpiloom.operators.joins import keep_top
from kpiloom.operators.rollup import AGGREGATES, OPERATIONS_MEASURES, calendar_rollup, latest_period, rollup
from kpiloom.plans.fact import product_week
from kpiloom.session import checkpointed

TOP_PRODUCTS = 6
SUMMARY_MEASURES = OPERATIONS_MEASURES
SUMMARY_KEYS = ["Product_ID", "Product_Name", "Category", "Month"]
SUMMARY_OUT = (
    "Product_ID:s Month:d Product_Name:s Category:s Produced_Units:i Good_Units:i Sales_Units:2 Revenue:4 COGS:4 Profit:4 "
    "Lead_Time_days:6 Efficiency_u_per_h:6 Inventory:6 MoM_Sales_pct:6 YoY_Sales_pct:6 MoM_LeadTime_pct:6 MoM_Eff_pct:6 "
    "Rolling_3m_Sales:6 MoM_Drop_Flag:b"
)


def written_fact(spark: SparkSession, d: str, columns: Sequence[str]) -> DataFrame:
    """The product-week fact, written once: for queries that read it more than
    once, so that the raw tables are scanned and joined a single time."""
    return checkpointed(product_week(spark, d, columns))


def monthly_products(spark: SparkSession, d: str, measures: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Product-month rollup of the product-week fact."""
    fact = product_week(spark, d, ["Month", *keys, *measures])
    return rollup(fact, ["Product_ID", "Month", *keys], measures)


def yearly_products(spark: SparkSession, d: str, measures: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Product-year rollup; write it once where the latest year is found in a second pass."""
    fact = product_week(spark, d, ["Year", *keys, *measures])
    return rollup(fact, ["Product_ID", "Year", *keys], measures)


def top_products(fact: DataFrame) -> DataFrame:
    """Revenue per product in the latest year of the fact."""
    return latest_period(rollup(fact, ["Product_ID", "Year"], {"Revenue": "sum"}), "Year")


def top_monthly(spark: SparkSession, d: str) -> DataFrame:
    """Product-month rollup of the latest year's top products."""
    return monthly_of_top(written_fact(spark, d, ["Month", "Year", "Product_Name", "Category", *SUMMARY_MEASURES]))


def monthly_of_top(fact: DataFrame) -> DataFrame:
    monthly = rollup(fact, SUMMARY_KEYS, SUMMARY_MEASURES)
    return keep_top(monthly, top_products(fact), "Product_ID", "Revenue", TOP_PRODUCTS)


def product_revenue(spark: SparkSession, d: str) -> DataFrame:
    return rollup(product_week(spark, d, ["Revenue"]), ["Product_ID"], {"Revenue": "sum"})


SQL_AGGREGATES = {"sum": "sum", "mean": "avg", "min": "min", "max": "max", "any": "bool_or"}
assert set(SQL_AGGREGATES) <= set(AGGREGATES)


def measures_sql(measures: dict[str, str]) -> str:
    return ", ".join(f"{SQL_AGGREGATES[how]}({name}) AS {name}" for name, how in measures.items())


def rollup_sql(keys: Sequence[str], measures: dict[str, str], source: str = "pw") -> str:
    by = ", ".join(f'"{k}"' for k in keys)
    return f"SELECT {by}, {measures_sql(measures)} FROM {source} GROUP BY {by}"


def company(spark: SparkSession, d: str, grain: str, measures: dict[str, str]) -> DataFrame:
    """Company-level calendar rollup of the product-week fact."""
    fact = product_week(spark, d, list(measures))
    return calendar_rollup(fact, grain, measures)


TOP_SQL = f"""SELECT Product_ID FROM pw WHERE "Year" = (SELECT max("Year") FROM pw)
  GROUP BY Product_ID ORDER BY sum(Revenue) DESC, Product_ID LIMIT {TOP_PRODUCTS}"""

SUMMARY_SQL = f"""
SELECT *, coalesce(MoM_Sales_pct < -0.10, false) AS MoM_Drop_Flag FROM (
  SELECT *,
    Sales_Units / NULLIF(lag(Sales_Units, 1) OVER w, 0) - 1 AS MoM_Sales_pct,
    Sales_Units / NULLIF(lag(Sales_Units, 12) OVER w, 0) - 1 AS YoY_Sales_pct,
    (Lead_Time_days - lag(Lead_Time_days, 1) OVER w) / NULLIF(lag(Lead_Time_days, 1) OVER w, 0) AS MoM_LeadTime_pct,
    Efficiency_u_per_h / NULLIF(lag(Efficiency_u_per_h, 1) OVER w, 0) - 1 AS MoM_Eff_pct,
    avg(Sales_Units) OVER (PARTITION BY Product_ID ORDER BY "Month" ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
      AS Rolling_3m_Sales
  FROM ({rollup_sql(SUMMARY_KEYS, SUMMARY_MEASURES)}) AS m
  WINDOW w AS (PARTITION BY Product_ID ORDER BY "Month")
) AS s WHERE Product_ID IN ({TOP_SQL})"""

LAST_CHANGE_SQL = f"""
SELECT Product_ID, "Month", Lead_Time_days, Efficiency_u_per_h,
  Lead_Time_days / (prev_lead + 1e-9) - 1 AS lt_pct,
  Efficiency_u_per_h / (prev_eff + 1e-9) - 1 AS eff_pct
FROM (
  SELECT *, lag(Lead_Time_days) OVER w AS prev_lead, lag(Efficiency_u_per_h) OVER w AS prev_eff,
    row_number() OVER (PARTITION BY Product_ID ORDER BY "Month" DESC) AS back,
    count(*) OVER (PARTITION BY Product_ID) AS n
  FROM ({rollup_sql(["Product_ID", "Month"], SUMMARY_MEASURES)}) AS m
  WINDOW w AS (PARTITION BY Product_ID ORDER BY "Month")
) AS p WHERE back = 1 AND n >= 2"""

ALERT_SQL = f"""
SELECT Product_ID, "Month", 'Lead_Time' AS rule, lt_pct AS pct,
  'ALERT: Lead Time increase for product ' || Product_ID || ' in last month: '
    || printf('%.1f', lt_pct * 100) || '%' AS line
FROM ({LAST_CHANGE_SQL}) AS a WHERE lt_pct > 0.10 AND Product_ID IN ({TOP_SQL})
UNION ALL
SELECT Product_ID, "Month", 'Efficiency', eff_pct,
  'ALERT: Efficiency drop for product ' || Product_ID || ' in last month: '
    || printf('%.1f', eff_pct * 100) || '%'
FROM ({LAST_CHANGE_SQL}) AS b WHERE eff_pct < -0.10 AND Product_ID IN ({TOP_SQL})"""


