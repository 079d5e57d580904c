"""Management tables, matrices and the parameterised dashboard query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions import fill_rate, is_drop, safe_divide, weeks_of_inventory
from kpiloom.operators import growth as G
from kpiloom.operators import reports as RP
from kpiloom.operators.incremental import extend_series, read_series, write_series
from kpiloom.operators.joins import keep_top
from kpiloom.operators.ranking import pareto, pareto_crossing, pareto_set
from kpiloom.operators.rollup import BASIC_MEASURES, OPERATIONS_MEASURES, RICH_MEASURES, rollup
from kpiloom.plans.aggregations import COHORT_SQL, customer_cohorts, out_of
from kpiloom.plans.fact import order_lines, product_week
from kpiloom.plans.models import clustered_customers
from kpiloom.plans.registry import query
from kpiloom.plans.shared import (
    ALERT_SQL,
    SUMMARY_OUT,
    SUMMARY_SQL,
    TOP_PRODUCTS,
    TOP_SQL,
    monthly_products,
    product_revenue,
    rollup_sql,
    top_monthly,
    top_products,
    written_fact,
)
from kpiloom.plans.windowed import LAGS, LAGS_SQL, PARETO_SQL, WATERFALL_SQL, change_sql, rolling_sql, waterfall_table
from kpiloom.session import checkpointed, scratch_path


# The years of the test tables, for the checking SQL; the query reads them from the data.
MONTHS = [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(1995 * 12, 2002 * 12)]


@query(
    "r1_month_matrix",
    None,
    f"""WITH g AS (
          SELECT Product_Name, strftime("Month", '%Y-%m') AS label,
            round(coalesce({change_sql('Sales_Units', 1, 'Month')}, 0), 6) + CAST(0 AS DOUBLE) AS pct
          FROM ({rollup_sql(['Product_ID', 'Product_Name', 'Month'], {'Sales_Units': 'sum'})}) AS m
        )
        SELECT Product_Name, {', '.join(f"coalesce(max(pct) FILTER (label = '{m}'), 0) AS \"{m}\"" for m in MONTHS)}
        FROM g GROUP BY 1""",
)
def month_matrix(spark: SparkSession, d: str) -> DataFrame:
    monthly = checkpointed(monthly_products(spark, d, {"Sales_Units": "sum"}, ["Product_Name"]))
    RP.require_unique_names(monthly, "Product_ID", "Product_Name")
    grown = G.add_growth(monthly, ["Product_ID"], "Month", {"pct": ("Sales_Units", 1)})
    rounded = grown.withColumn("pct", F.round(F.coalesce("pct", F.lit(0.0)), 6) + F.lit(0.0))
    return RP.month_matrix(rounded, "Product_Name", "pct", months=RP.month_labels(monthly, whole_years=True))


# Whole dozens of periods up to the last one of the test tables, for the checking SQL.
PERIODS = range(0, 84)


@query(
    "r2_cohort_matrix",
    None,
    "SELECT Acquisition_Month, "
    + ", ".join(
        f"CAST(round(TRY_CAST(avg(n_sales) FILTER (Cohort_Period = {p}) AS DECIMAL(38, 7)), 4) AS DOUBLE) AS period_{p}"
        for p in PERIODS
    )
    + f" FROM ({COHORT_SQL}) AS c GROUP BY 1",
)
def cohort_matrix(spark: SparkSession, d: str) -> DataFrame:
    wide = RP.cohort_matrix(checkpointed(customer_cohorts(spark, d)), "Acquisition_Month")
    money = [F.round(F.col(c).cast("decimal(38,7)"), 4).cast("double").alias(c) for c in wide.columns[1:]]
    return wide.select("Acquisition_Month", *money)


@query(
    "r3_pareto_table",
    "Product_ID:s Product_Name:s Revenue:4 Cumulative_Revenue:3 Cumulative_Revenue_pct:6",
    f"""SELECT p.*, n.Product_Name FROM ({PARETO_SQL}) AS p
        JOIN (SELECT DISTINCT Product_ID, Product_Name FROM pw) AS n USING (Product_ID)""",
)
def pareto_table(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Product_Name", "Revenue"])
    return pareto(rollup(fact, ["Product_ID", "Product_Name"], {"Revenue": "sum"}))


@query(
    "r4_pareto_set",
    "Product_ID:s Cumulative_Revenue_pct:6",
    f"SELECT Product_ID, Cumulative_Revenue_pct FROM ({PARETO_SQL}) AS p WHERE Cumulative_Revenue_pct <= 0.8",
)
def pareto_products(spark: SparkSession, d: str) -> DataFrame:
    return pareto_set(pareto(product_revenue(spark, d)))


@query(
    "r5_pareto_crossing",
    "Product_ID:s Cumulative_Revenue_pct:6",
    f"""SELECT Product_ID, Cumulative_Revenue_pct FROM ({PARETO_SQL}) AS p WHERE Cumulative_Revenue_pct >= 0.8
        ORDER BY Cumulative_Revenue_pct, Product_ID LIMIT 1""",
)
def pareto_edge(spark: SparkSession, d: str) -> DataFrame:
    return pareto_crossing(pareto(product_revenue(spark, d)))


@query("r6_waterfall", "Product_ID:s step:i label:s amount:4 base:4", WATERFALL_SQL)
def waterfall(spark: SparkSession, d: str) -> DataFrame:
    return waterfall_table(spark, d)


@query("r7_monthly_summary", SUMMARY_OUT, SUMMARY_SQL)
def monthly_summary(spark: SparkSession, d: str) -> DataFrame:
    return G.monthly_summary(top_monthly(spark, d))


@query("r8_alerts", "Product_ID:s Month:d rule:s pct:6 line:s", ALERT_SQL)
def alerts(spark: SparkSession, d: str) -> DataFrame:
    return RP.alerts(top_monthly(spark, d))


FACT_ONLY = ["Returns_Rate", "Price_per_Unit", "Promo_Discount"]
ATTRIBUTES = ["Product_Name", "Category", "Week_Index", "Month", "Quarter", "Year"]
FINAL = [*dict.fromkeys([*RICH_MEASURES, *BASIC_MEASURES, *OPERATIONS_MEASURES]), *FACT_ONLY]


def with_stock(weekly: DataFrame) -> DataFrame:
    stock = {
        "Inventory_Weeks": weeks_of_inventory("Inventory", "Sales_Units"),
        "Fill_Rate": fill_rate("Backorder", "Sales_Units"),
    }
    return weekly.withColumns(stock)


FULL_OUT = (
    out_of("Product_ID:s Date:d Product_Name:s Category:s Week_Index:i Month:d Quarter:d Year:i", dict.fromkeys(FINAL, ""))
    + " On_Promo:b Weekly_Target:i Target_Achieved:6 Inventory_Weeks:6 Fill_Rate:6 Rolling_4w_Sales:6 Rolling_13w_Sales:6 "
    "Rolling_4w_Eff:6 WoW_pct_Sales_Units:6 WoW_pct_Revenue:6 WoW_pct_Lead_Time_days:6 WoW_pct_Efficiency_u_per_h:6 "
    "pct_4w_Sales:6 pct_52w_Sales:6"
)
FULL_SQL = f"""SELECT *, Sales_Units / (Weekly_Target + 1e-9) AS Target_Achieved,
          Inventory / (NULLIF(Sales_Units, 0) + 1e-6) AS Inventory_Weeks,
          1 - Backorder / (NULLIF(Sales_Units, 0) + 1e-6) AS Fill_Rate FROM (
          SELECT *, round_even(avg(Sales_Units) OVER (PARTITION BY Product_ID) * 1.05, 0) AS Weekly_Target,
            {rolling_sql('Sales_Units', 4)} AS Rolling_4w_Sales, {rolling_sql('Sales_Units', 13)} AS Rolling_13w_Sales,
            {rolling_sql('Efficiency_u_per_h', 4)} AS Rolling_4w_Eff,
            {change_sql('Sales_Units', 1, 'Date')} AS WoW_pct_Sales_Units,
            {change_sql('Revenue', 1, 'Date')} AS WoW_pct_Revenue,
            {change_sql('Lead_Time_days', 1, 'Date')} AS WoW_pct_Lead_Time_days,
            {change_sql('Efficiency_u_per_h', 1, 'Date')} AS WoW_pct_Efficiency_u_per_h,
            {change_sql('Sales_Units', 4, 'Date')} AS pct_4w_Sales, {change_sql('Sales_Units', 52, 'Date')} AS pct_52w_Sales
          FROM pw) AS f"""


@query("r9_full_fact", FULL_OUT, FULL_SQL)
def full_fact(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, [*ATTRIBUTES, *FINAL, "On_Promo"])
    return with_stock(G.weekly_metrics(fact))


@query(
    "r9_extended_fact",
    FULL_OUT + " " + " ".join(f"lag_{n}:2" for n in LAGS),
    f"""SELECT * FROM ({FULL_SQL}) AS w JOIN (SELECT * EXCLUDE (Sales_Units) FROM ({LAGS_SQL}) AS l) AS s USING (Product_ID, "Date")""",
)
def extended_fact(spark: SparkSession, d: str) -> DataFrame:
    """The same table and its lags, written without the last quarter and then
    extended by its weeks, a month at a time."""
    fact = checkpointed(product_week(spark, d, [*ATTRIBUTES, *FINAL, "On_Promo"]))
    path = scratch_path(spark, "weekly-table")
    last = fact.agg(F.max("Quarter")).first()[0]
    write_series(fact.where(F.col("Quarter") < last), path)
    months = sorted(r[0] for r in fact.where(F.col("Quarter") == last).select("Month").distinct().collect())
    for month in months:
        extend_series(fact.where(F.col("Month") == month), path)
    return with_stock(read_series(spark, path))


@query(
    "r10_top_series",
    "Product_ID:s Quarter:d Efficiency_u_per_h:6 QoQ_Sales_pct:6",
    f"""SELECT * FROM (
          SELECT *, {change_sql('Sales_Units', 1, 'Quarter')} AS QoQ_Sales_pct
          FROM ({rollup_sql(['Product_ID', 'Quarter'], {'Sales_Units': 'sum', 'Efficiency_u_per_h': 'mean'})}) AS q
        ) AS g WHERE Product_ID IN ({TOP_SQL})""",
)
def top_series(spark: SparkSession, d: str) -> DataFrame:
    measures = {"Sales_Units": "sum", "Efficiency_u_per_h": "mean"}
    fact = written_fact(spark, d, ["Quarter", "Year", "Revenue", *measures])
    quarterly = rollup(fact, ["Product_ID", "Quarter"], measures)
    top = keep_top(quarterly, top_products(fact), "Product_ID", "Revenue", TOP_PRODUCTS)
    return G.add_growth(top, ["Product_ID"], "Quarter", {"QoQ_Sales_pct": ("Sales_Units", 1)})


LEAD_TIMES = {"Lead_Time_days": "mean", "Efficiency_u_per_h": "mean"}


@query(
    "r10_top_lead_time",
    "Product_ID:s Month:d Lead_Time_days:6 Efficiency_u_per_h:6",
    f"SELECT * FROM ({rollup_sql(['Product_ID', 'Month'], LEAD_TIMES)}) AS m WHERE Product_ID IN ({TOP_SQL})",
)
def top_lead_time(spark: SparkSession, d: str) -> DataFrame:
    return top_monthly(spark, d)


@query(
    "r11_scatter_points",
    "Raw_Material_Cost:2 Profit:4 Category:s",
    "SELECT Raw_Material_Cost, Profit, Category FROM pw",
)
def scatter_points(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Raw_Material_Cost", "Profit", "Category"])
    return RP.scatter_points(fact, "Raw_Material_Cost", "Profit", "Category")


@query(
    "r11_bounded_points",
    "Raw_Material_Cost:2 Profit:4 Category:s",
    """SELECT Raw_Material_Cost, Profit, Category FROM pw QUALIFY row_number() OVER (
         PARTITION BY Category ORDER BY md5(Product_ID || '|' || strftime("Date", '%Y-%m-%d')), Raw_Material_Cost, Profit) <= 40""",
)
def bounded_points(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Raw_Material_Cost", "Profit", "Category"])
    return RP.scatter_points(fact, "Raw_Material_Cost", "Profit", "Category", keys=["Product_ID", "Date"], most=40)


# --- user functions ---------------------------------------------------------


@query(
    "v1_row_expression",
    "Product_ID:s Date:d margin:6 is_drop:b",
    f"""SELECT Product_ID, "Date", Profit / NULLIF(Revenue, 0) AS margin,
          coalesce({change_sql('Revenue', 1, 'Date')} < -0.1, false) AS is_drop FROM pw""",
)
def row_expression(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Profit", "Revenue"])
    grown = G.add_growth(fact, ["Product_ID"], "Date", {"pct": ("Revenue", 1)})
    return grown.withColumns({"margin": safe_divide("Profit", "Revenue"), "is_drop": is_drop("pct")})


@query(
    "v2_group_expression",
    "Product_ID:s Date:d rolling:6 change:6",
    f"""SELECT Product_ID, "Date", {rolling_sql('Revenue', 4)} AS rolling, {change_sql('Revenue', 4, 'Date')} AS change
        FROM pw""",
)
def group_expression(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Revenue"])
    rolled = fact.transform(G.add_rolling, ["Product_ID"], "Date", {"rolling": ("Revenue", 4)})
    return rolled.transform(G.add_growth, ["Product_ID"], "Date", {"change": ("Revenue", 4)})


@query(
    "v3_wow_function",
    "Product_ID:s Date:d Sales_Units:2 WoW:6",
    f'SELECT Product_ID, "Date", Sales_Units, {change_sql("Sales_Units", 1, "Date")} AS WoW FROM pw',
)
def wow_function(spark: SparkSession, d: str) -> DataFrame:
    return product_week(spark, d, ["Sales_Units"]).transform(G.wow, ["Product_ID"], "Sales_Units", "WoW")


def dashboard_tables(spark: SparkSession, d: str, category: str, region: str) -> tuple[DataFrame, DataFrame]:
    """Monthly money and monthly operations for one pick."""
    lines = order_lines(
        spark, d, ["Ship_Date", "Category", "Region", "Revenue", "Profit", "Efficiency_Rate", "Lead_Time_Days"]
    )
    return RP.dashboard(lines, category, region, "Ship_Date")


DASHBOARD_SQL = """SELECT date_trunc('month', Ship_Date) AS "Month", sum(Revenue) AS Revenue, sum(Profit) AS Profit,
  avg(Efficiency_Rate) AS Efficiency_Rate, avg(Lead_Time_Days) AS Lead_Time_Days
  FROM lines WHERE Category = 'PROMO' AND Region = 'AMERICA' GROUP BY 1"""


@query("v4_dashboard_money", "Month:d Revenue:4 Profit:4", DASHBOARD_SQL)
def dashboard_money(spark: SparkSession, d: str) -> DataFrame:
    return dashboard_tables(spark, d, "PROMO", "AMERICA")[0]


@query("v4_dashboard_operations", "Month:d Efficiency_Rate:6 Lead_Time_Days:6", DASHBOARD_SQL)
def dashboard_operations(spark: SparkSession, d: str) -> DataFrame:
    return dashboard_tables(spark, d, "PROMO", "AMERICA")[1]


@query("v4_dashboard_clusters", "o_custkey:i Revenue:2 Orders:i c_acctbal:2 cluster:i")
def dashboard_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustered_customers(spark, d)
