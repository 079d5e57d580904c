"""Growth, rolling, cumulative and positional queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions import is_drop
from kpiloom.operators import growth as G
from kpiloom.operators.halo import add_series_growth
from kpiloom.operators.joins import align_to_spine, bounds, calendar_grid
from kpiloom.operators.ranking import pareto, pareto_crossing
from kpiloom.operators.reports import profit_steps, waterfall
from kpiloom.operators.rollup import calendar_rollup, last_per_group, rollup
from kpiloom.plans.fact import order_lines, product_week
from kpiloom.plans.registry import query
from kpiloom.plans.shared import (
    LAST_CHANGE_SQL,
    SUMMARY_MEASURES,
    monthly_products,
    rollup_sql,
    written_fact,
)
from kpiloom.sources import table


def change_sql(value: str, lag: int, order: str, key: str | None = "Product_ID") -> str:
    over = f'OVER ({f"PARTITION BY {key} " if key else ""}ORDER BY "{order}")'
    return f"({value} - lag({value}, {lag}) {over}) / NULLIF(lag({value}, {lag}) {over}, 0)"


WOW_VALUES = ["Sales_Units", "Revenue", "Lead_Time_days", "Efficiency_u_per_h"]


@query(
    "w1_product_wow",
    "Product_ID:s Date:d " + " ".join(f"WoW_pct_{c}:6" for c in WOW_VALUES) + " pct_4w:6 pct_52w:6",
    'SELECT Product_ID, "Date", '
    + ", ".join(f"{change_sql(c, 1, 'Date')} AS WoW_pct_{c}" for c in WOW_VALUES)
    + f", {change_sql('Sales_Units', 4, 'Date')} AS pct_4w, {change_sql('Sales_Units', 52, 'Date')} AS pct_52w FROM pw",
)
def product_wow(spark: SparkSession, d: str) -> DataFrame:
    changes = {f"WoW_pct_{c}": (c, 1) for c in WOW_VALUES}
    changes |= {"pct_4w": ("Sales_Units", 4), "pct_52w": ("Sales_Units", 52)}
    return G.add_growth(product_week(spark, d, WOW_VALUES), ["Product_ID"], "Date", changes)


def _periodic(name: str, grain: str, kind: str, lags: dict[str, int]) -> None:
    """Growth of product rollups at month, quarter or year grain."""

    @query(
        name,
        f"Product_ID:s {grain}:{kind} Sales_Units:2 " + " ".join(f"{n}:6" for n in lags),
        f'SELECT Product_ID, "{grain}", Sales_Units, '
        + ", ".join(f"{change_sql('Sales_Units', lag, grain)} AS {n}" for n, lag in lags.items())
        + f" FROM ({rollup_sql(['Product_ID', grain], {'Sales_Units': 'sum'})}) AS r",
    )
    def build(spark: SparkSession, d: str) -> DataFrame:
        fact = product_week(spark, d, [grain, "Sales_Units"])
        totals = rollup(fact, ["Product_ID", grain], {"Sales_Units": "sum"})
        return G.add_growth(totals, ["Product_ID"], grain, {n: ("Sales_Units", lag) for n, lag in lags.items()})


_periodic("w1_month_growth", "Month", "d", {"MoM_Sales_pct": 1, "YoY_Sales_pct": 12})
_periodic("w1_quarter_growth", "Quarter", "d", {"QoQ_Sales_pct": 1, "YoY_Q_Sales_pct": 4})
_periodic("w1_year_growth", "Year", "i", {"YoY_Sales_pct": 1})


@query(
    "w1_densified_wow",
    "Product_ID:s Date:d Sales_Units:2 WoW:6",
    f"""WITH g AS (
          SELECT p.Product_ID, c."Date", coalesce(pw.Sales_Units, 0) AS Sales_Units
          FROM (SELECT DISTINCT Product_ID FROM pw) AS p
          CROSS JOIN (SELECT DISTINCT "Date" FROM pw) AS c
          LEFT JOIN pw ON pw.Product_ID = p.Product_ID AND pw."Date" = c."Date"
        ) SELECT *, {change_sql('Sales_Units', 1, 'Date')} AS WoW FROM g""",
)
def densified_wow(spark: SparkSession, d: str) -> DataFrame:
    fact = written_fact(spark, d, ["Sales_Units"])
    first, last = bounds(fact, "Date")
    grid = calendar_grid(fact.select("Product_ID").distinct(), first, last)
    dense = align_to_spine(fact, grid, ["Product_ID", "Date"])
    return G.add_growth(dense, ["Product_ID"], "Date", {"WoW": ("Sales_Units", 1)})


COMPANY = {"Sales_Units": "sum", "Revenue": "sum", "Profit": "sum"}


@query(
    "w2_company_wow",
    "Date:d Sales_Units:2 Revenue:4 Profit:4 WoW_Sales_pct:6 WoW_Revenue_pct:6",
    f"""SELECT *, {change_sql('Sales_Units', 1, 'Date', None)} AS WoW_Sales_pct,
          {change_sql('Revenue', 1, 'Date', None)} AS WoW_Revenue_pct
        FROM ({rollup_sql(['Date'], COMPANY)}) AS c""",
)
def company_wow(spark: SparkSession, d: str) -> DataFrame:
    weekly = rollup(product_week(spark, d, list(COMPANY)), ["Date"], COMPANY)
    return G.add_growth(
        weekly, [], "Date", {"WoW_Sales_pct": ("Sales_Units", 1), "WoW_Revenue_pct": ("Revenue", 1)}
    )


@query(
    "w2_company_mom",
    "Month:d Revenue:4 MoM_Revenue_pct:6 MoM_Drop_Flag:b",
    f"""SELECT *, coalesce(MoM_Revenue_pct < -0.1, false) AS MoM_Drop_Flag FROM (
          SELECT *, {change_sql('Revenue', 1, 'Month', None)} AS MoM_Revenue_pct FROM (
            SELECT CAST(date_trunc('month', Ship_Date) AS DATE) AS "Month", sum(Revenue) AS Revenue FROM lines GROUP BY 1
          ) AS m) AS g""",
)
def company_mom(spark: SparkSession, d: str) -> DataFrame:
    lines = order_lines(spark, d, ["Ship_Date", "Revenue"])
    monthly = calendar_rollup(lines, "Month", {"Revenue": "sum"}, date="Ship_Date")
    grown = G.add_growth(monthly, [], "Month", {"MoM_Revenue_pct": ("Revenue", 1)})
    return grown.withColumn("MoM_Drop_Flag", is_drop("MoM_Revenue_pct"))


def rolling_sql(value: str, rows: int, order: str = "Date") -> str:
    return (
        f'avg({value}) OVER (PARTITION BY Product_ID ORDER BY "{order}" '
        f"ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    )


@query(
    "w3_rolling_means",
    "Product_ID:s Date:d Rolling_4w_Sales:6 Rolling_13w_Sales:6 Rolling_4w_Eff:6",
    f"""SELECT Product_ID, "Date", {rolling_sql('Sales_Units', 4)} AS Rolling_4w_Sales,
          {rolling_sql('Sales_Units', 13)} AS Rolling_13w_Sales,
          {rolling_sql('Efficiency_u_per_h', 4)} AS Rolling_4w_Eff FROM pw""",
)
def rolling_means(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Sales_Units", "Efficiency_u_per_h"])
    return G.add_rolling(
        fact,
        ["Product_ID"],
        "Date",
        {
            "Rolling_4w_Sales": ("Sales_Units", 4),
            "Rolling_13w_Sales": ("Sales_Units", 13),
            "Rolling_4w_Eff": ("Efficiency_u_per_h", 4),
        },
    )


@query(
    "w3_rolling_months",
    "Product_ID:s Month:d Rolling_3m_Sales:6",
    f"""SELECT Product_ID, "Month", {rolling_sql('Sales_Units', 3, 'Month')} AS Rolling_3m_Sales
        FROM ({rollup_sql(['Product_ID', 'Month'], {'Sales_Units': 'sum'})}) AS m""",
)
def rolling_months(spark: SparkSession, d: str) -> DataFrame:
    monthly = monthly_products(spark, d, {"Sales_Units": "sum"})
    return G.add_rolling(monthly, ["Product_ID"], "Month", {"Rolling_3m_Sales": ("Sales_Units", 3)})


PARETO_SQL = """
SELECT Product_ID, Revenue,
  sum(Revenue) OVER (ORDER BY Revenue DESC, Product_ID ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AS Cumulative_Revenue,
  sum(Revenue) OVER (ORDER BY Revenue DESC, Product_ID ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    / sum(Revenue) OVER () AS Cumulative_Revenue_pct
FROM (SELECT Product_ID, sum(Revenue) AS Revenue FROM pw GROUP BY 1) AS t"""


UNITS_PARETO_SQL = PARETO_SQL.replace("Revenue", "Sales_Units")


@query(
    "w4_cumulative_share",
    "Product_ID:s Sales_Units:2 Cumulative_Sales_Units:2 Cumulative_Sales_Units_pct:6",
    UNITS_PARETO_SQL,
)
def cumulative_share(spark: SparkSession, d: str) -> DataFrame:
    return pareto(product_units(spark, d), "Sales_Units")


def product_units(spark: SparkSession, d: str) -> DataFrame:
    return rollup(product_week(spark, d, ["Sales_Units"]), ["Product_ID"], {"Sales_Units": "sum"})


@query(
    "w5_first_month",
    "Product_ID:s Month:d Acquisition_Month:d Sales_Units:2",
    f"""SELECT *, min("Month") OVER (PARTITION BY Product_ID) AS Acquisition_Month
        FROM ({rollup_sql(['Product_ID', 'Month'], {'Sales_Units': 'sum'})}) AS m""",
)
def first_month(spark: SparkSession, d: str) -> DataFrame:
    monthly = monthly_products(spark, d, {"Sales_Units": "sum"})
    return G.first_of_group(monthly, ["Product_ID"], "Month", "Acquisition_Month")


LAGS = (1, 2, 3, 4, 13)
LAGS_SQL = (
    'SELECT Product_ID, "Date", Sales_Units, '
    + ", ".join(
        f'coalesce(lag(Sales_Units, {n}) OVER w, first_value(Sales_Units) OVER w) AS lag_{n}' for n in LAGS
    )
    + ' FROM pw WINDOW w AS (PARTITION BY Product_ID ORDER BY "Date")'
)


@query("w6_lags", "Product_ID:s Date:d Sales_Units:2 " + " ".join(f"lag_{n}:2" for n in LAGS), LAGS_SQL)
def lags(spark: SparkSession, d: str) -> DataFrame:
    return G.add_lags(product_week(spark, d, ["Sales_Units"]), ["Product_ID"], "Date", "Sales_Units", LAGS)


@query("w7_last_change", "Product_ID:s Month:d Lead_Time_days:6 Efficiency_u_per_h:6 lt_pct:6 eff_pct:6", LAST_CHANGE_SQL)
def last_change(spark: SparkSession, d: str) -> DataFrame:
    monthly = monthly_products(spark, d, SUMMARY_MEASURES)
    return G.last_change(monthly, ["Product_ID"], "Month", {"lt_pct": "Lead_Time_days", "eff_pct": "Efficiency_u_per_h"})


@query(
    "w8_row_position",
    "Product_ID:s Date:d position:i",
    'SELECT Product_ID, "Date", row_number() OVER (PARTITION BY Product_ID ORDER BY "Date") - 1 AS position FROM pw',
)
def row_position(spark: SparkSession, d: str) -> DataFrame:
    return G.add_position(product_week(spark, d, []), ["Product_ID"], "Date")


@query(
    "w9_holdout",
    "Product_ID:s Date:d is_test:b",
    """SELECT Product_ID, "Date", row_number() OVER (PARTITION BY Product_ID ORDER BY "Date" DESC) <= 12 AS is_test FROM pw""",
)
def holdout(spark: SparkSession, d: str) -> DataFrame:
    return G.add_holdout(product_week(spark, d, []), ["Product_ID"], "Date", 12)


@query(
    "w10_threshold_crossing",
    "Product_ID:s Cumulative_Sales_Units_pct:6",
    f"""SELECT Product_ID, Cumulative_Sales_Units_pct FROM ({UNITS_PARETO_SQL}) AS p
        WHERE Cumulative_Sales_Units_pct >= 0.5 ORDER BY Cumulative_Sales_Units_pct, Product_ID LIMIT 1""",
)
def threshold_crossing(spark: SparkSession, d: str) -> DataFrame:
    table = pareto(product_units(spark, d), "Sales_Units")
    return pareto_crossing(table, "Cumulative_Sales_Units_pct", limit=0.5)


MONEY_MONTH = {"Revenue": "sum", "COGS": "sum", "Expenses": "sum", "Profit": "sum"}
WATERFALL_SQL = f"""
WITH m AS ({rollup_sql(["Product_ID", "Month"], MONEY_MONTH)}),
last AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY Product_ID ORDER BY "Month" DESC) = 1),
steps AS (
  SELECT Product_ID, 1 AS step, 'Revenue' AS label, Revenue AS amount FROM last
  UNION ALL SELECT Product_ID, 2, 'COGS', -COGS FROM last
  UNION ALL SELECT Product_ID, 3, 'Expenses', -Expenses FROM last
  UNION ALL SELECT Product_ID, 4, 'Profit', Profit FROM last
)
SELECT *, coalesce(sum(amount) OVER (PARTITION BY Product_ID ORDER BY step
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
FROM steps"""


def waterfall_table(spark: SparkSession, d: str) -> DataFrame:
    monthly = monthly_products(spark, d, MONEY_MONTH)
    last = last_per_group(monthly, "Product_ID", "Month", list(MONEY_MONTH))
    return waterfall(last, "Product_ID", profit_steps())


@query(
    "w11_running_base",
    "Product_ID:s Month:d Profit:4 base:3",
    f"""SELECT *, coalesce(sum(Profit) OVER (PARTITION BY Product_ID ORDER BY "Month"
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base
        FROM ({rollup_sql(["Product_ID", "Month"], {"Profit": "sum"})}) AS m""",
)
def running_base(spark: SparkSession, d: str) -> DataFrame:
    return G.running_base(monthly_products(spark, d, {"Profit": "sum"}), ["Product_ID"], "Month", "Profit")




EVENT_SQL = "(ORDER BY ts, event_id)"


@query(
    "w2_event_growth",
    "event_id:i position:i value_pct:6 value_4_pct:6 mean_7:6",
    f"""SELECT event_id, row_number() OVER {EVENT_SQL} - 1 AS position,
          (value - lag(value) OVER {EVENT_SQL}) / NULLIF(lag(value) OVER {EVENT_SQL}, 0) AS value_pct,
          (value - lag(value, 4) OVER {EVENT_SQL}) / NULLIF(lag(value, 4) OVER {EVENT_SQL}, 0) AS value_4_pct,
          avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS mean_7
        FROM events""",
)
def event_growth(spark: SparkSession, d: str) -> DataFrame:
    """Positions, changes and rolling means over all events in time, as one series."""
    events = table(spark, d, "events").select("event_id", "ts", "value")
    growth = {"value_pct": ("value", 1), "value_4_pct": ("value", 4)}
    return add_series_growth(events, ["ts", "event_id"], growth, {"mean_7": ("value", 7)}, block=2000)


@query(
    "w2_day_growth",
    "Day:d value:4 position:i day_pct:6 week_pct:6",
    """SELECT *, row_number() OVER w - 1 AS position, (value - lag(value) OVER w) / NULLIF(lag(value) OVER w, 0) AS day_pct,
         (value - lag(value, 7) OVER w) / NULLIF(lag(value, 7) OVER w, 0) AS week_pct
       FROM (SELECT CAST(ts AS DATE) AS "Day", sum(value) AS value FROM events GROUP BY 1) AS e WINDOW w AS (ORDER BY "Day")""",
)
def day_growth(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("Day")).agg(F.sum("value").alias("value"))
    return add_series_growth(days, ["Day"], {"day_pct": ("value", 1), "week_pct": ("value", 7)})
