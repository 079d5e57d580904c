"""Sorts, top-N and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.operators.growth import add_holdout, add_position
from kpiloom.operators.heavy import top_sums
from kpiloom.operators.ranking import top_n
from kpiloom.operators.reports import alerts, stack_models
from kpiloom.operators.rollup import RICH_MEASURES, latest_year_table
from kpiloom.operators.stats import forecast_metrics, trend_backtest
from kpiloom.plans.aggregations import NAMED, NAMED_OUT, out_of
from kpiloom.plans.fact import product_week
from kpiloom.plans.registry import query
from kpiloom.plans.shared import (
    LAST_CHANGE_SQL,
    SUMMARY_MEASURES,
    TOP_PRODUCTS,
    TOP_SQL,
    monthly_products,
    product_revenue,
    rollup_sql,
    written_fact,
    yearly_products,
)
from kpiloom.plans.shared import top_products as latest_products
from kpiloom.session import checkpointed
from kpiloom.sources import table


@query(
    "o1_multi_key_sort",
    "Product_ID:s Date:d Revenue:4",
    'SELECT Product_ID, "Date", Revenue FROM pw ORDER BY Product_ID, "Date"',
)
def multi_key_sort(spark: SparkSession, d: str) -> DataFrame:
    return product_week(spark, d, ["Revenue"]).orderBy("Product_ID", "Date")


@query(
    "o2_top_products",
    "Product_ID:s Revenue:4",
    f"""SELECT Product_ID, sum(Revenue) AS Revenue FROM pw
        WHERE "Year" = (SELECT max("Year") FROM pw) AND Product_ID IN ({TOP_SQL}) GROUP BY 1""",
)
def top_products(spark: SparkSession, d: str) -> DataFrame:
    fact = written_fact(spark, d, ["Year", "Revenue"])
    return top_n(latest_products(fact), "Revenue", TOP_PRODUCTS, "Product_ID")


LARGEST_SQL = "SELECT Product_ID, sum(Revenue) AS Revenue FROM pw GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT"


@query("o3_largest", "Product_ID:s Revenue:4", f"{LARGEST_SQL} 5")
def largest(spark: SparkSession, d: str) -> DataFrame:
    return top_n(product_revenue(spark, d), "Revenue", 5, "Product_ID")


@query(
    "o3_largest_customers",
    "o_custkey:i o_totalprice:2",
    "SELECT o_custkey, sum(o_totalprice) AS o_totalprice FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def largest_customers(spark: SparkSession, d: str) -> DataFrame:
    """Of very many entities, the ten with the largest sums, from bounded summaries."""
    return top_sums(table(spark, d, "orders"), "o_custkey", "o_totalprice", 10)


@query("o4_top_of_top", "Product_ID:s Revenue:4", f"{LARGEST_SQL} 3")
def top_of_top(spark: SparkSession, d: str) -> DataFrame:
    return top_n(top_n(product_revenue(spark, d), "Revenue", TOP_PRODUCTS, "Product_ID"), "Revenue", 3, "Product_ID")


@query(
    "o5_report_table",
    out_of(f"Year:i {NAMED_OUT}", RICH_MEASURES) + " Profit_Margin:6",
    f"""SELECT *, Profit / NULLIF(Revenue, 0) AS Profit_Margin
        FROM ({rollup_sql(["Year", "Product_ID", *NAMED], RICH_MEASURES)}) AS y
        WHERE "Year" = (SELECT max("Year") FROM pw) ORDER BY Revenue DESC, Product_ID LIMIT 10""",
)
def report_table(spark: SparkSession, d: str) -> DataFrame:
    yearly = checkpointed(yearly_products(spark, d, RICH_MEASURES, NAMED))
    return top_n(latest_year_table(yearly), "Revenue", 10, "Product_ID")


HOLDOUT_CTES = """
WITH p AS (
  SELECT Product_ID, "Date", Sales_Units AS y,
    row_number() OVER (PARTITION BY Product_ID ORDER BY "Date") - 1 AS position,
    row_number() OVER (PARTITION BY Product_ID ORDER BY "Date" DESC) <= 12 AS is_test
  FROM pw
), f AS (
  SELECT Product_ID, regr_slope(y, position) AS slope, regr_intercept(y, position) AS icpt, avg(y) AS level
  FROM p WHERE NOT is_test GROUP BY 1
), t AS (SELECT p.*, icpt + slope * position AS trend, level FROM p JOIN f USING (Product_ID) WHERE is_test)"""


def holdout_predictions(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Hold-out rows with a trend and a mean prediction."""
    fact = product_week(spark, d, ["Sales_Units"])
    split = add_holdout(add_position(fact, ["Product_ID"], "Date"), ["Product_ID"], "Date", 12)
    trend = trend_backtest(split, "Product_ID", "position", "Sales_Units")
    level = split.where("NOT is_test").groupBy("Product_ID").agg(F.avg("Sales_Units").alias("pred"))
    flat = split.where("is_test").join(level, "Product_ID")
    columns = ["Product_ID", "Date", F.col("Sales_Units").alias("actual"), "pred"]
    return {"Trend": trend.select(*columns), "Mean": flat.select(*columns)}


@query(
    "u1_model_rows",
    "Product_ID:s Model:s rmse:5 mae:5 mape_pct:5 n:i",
    f"""{HOLDOUT_CTES}, u AS (
          SELECT Product_ID, 'Trend' AS Model, y, trend AS pred FROM t
          UNION ALL SELECT Product_ID, 'Mean', y, level FROM t
        )
        SELECT Product_ID, Model, sqrt(avg((y - pred) * (y - pred))) AS rmse, avg(abs(y - pred)) AS mae,
          avg(abs((y - pred) / NULLIF(y, 0))) * 100 AS mape_pct, count(*) AS n
        FROM u GROUP BY 1, 2""",
)
def model_rows(spark: SparkSession, d: str) -> DataFrame:
    return forecast_metrics(stack_models(holdout_predictions(spark, d)), ["Product_ID", "Model"])


@query(
    "u2_alert_rules",
    "Product_ID:s Month:d rule:s pct:6",
    f"""SELECT Product_ID, "Month", 'Lead_Time' AS rule, lt_pct AS pct FROM ({LAST_CHANGE_SQL}) AS a WHERE lt_pct > 0.02
        UNION ALL
        SELECT Product_ID, "Month", 'Efficiency', eff_pct FROM ({LAST_CHANGE_SQL}) AS b WHERE eff_pct < -0.02""",
)
def alert_rules(spark: SparkSession, d: str) -> DataFrame:
    """Both rules over all products, at a lower threshold."""
    return alerts(monthly_products(spark, d, SUMMARY_MEASURES), threshold=0.02)


