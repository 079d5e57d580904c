"""Joins, spines and calendar grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions import replace_labels
from kpiloom.operators import joins as J
from kpiloom.operators.rollup import share_of_total, weekly_targets
from kpiloom.plans.fact import order_lines, product_name
from kpiloom.plans.projections import NAME_LABELS
from kpiloom.plans.registry import query
from kpiloom.plans.shared import TOP_PRODUCTS, TOP_SQL, product_revenue, top_products, written_fact
from kpiloom.sources import table


@query(
    "j1_target_join",
    "Product_ID:s Date:d Sales_Units:2 Weekly_Target:i",
    """WITH t AS (SELECT Product_ID, round_even(avg(Sales_Units) * 1.05, 0) AS Weekly_Target FROM pw GROUP BY 1)
       SELECT Product_ID, "Date", Sales_Units, Weekly_Target FROM pw LEFT JOIN t USING (Product_ID)""",
)
def target_join(spark: SparkSession, d: str) -> DataFrame:
    fact = written_fact(spark, d, ["Sales_Units"])
    return J.add_lookup(fact, weekly_targets(fact), "Product_ID")


@query(
    "j2_align_to_spine",
    "Product_ID:s Date:d promo_weeks:i promo_units:2",
    """SELECT Product_ID, "Date", coalesce(n, 0) AS promo_weeks, coalesce(s, 0) AS promo_units
       FROM pw LEFT JOIN (
         SELECT Product_ID, "Date", 1 AS n, Sales_Units AS s FROM pw WHERE On_Promo
       ) AS promo USING (Product_ID, "Date")""",
)
def align_to_spine(spark: SparkSession, d: str) -> DataFrame:
    fact = written_fact(spark, d, ["Sales_Units", "On_Promo"])
    promo = fact.where("On_Promo").select(
        "Product_ID", "Date", F.lit(1).alias("promo_weeks"), F.col("Sales_Units").alias("promo_units")
    )
    return J.align_to_spine(promo, fact.select("Product_ID", "Date"), ["Product_ID", "Date"])


@query(
    "j3_top_semi_join",
    "Product_ID:s Date:d Revenue:4",
    f'SELECT Product_ID, "Date", Revenue FROM pw WHERE Product_ID IN ({TOP_SQL})',
)
def top_semi_join(spark: SparkSession, d: str) -> DataFrame:
    fact = written_fact(spark, d, ["Year", "Revenue"])
    return J.keep_top(fact, top_products(fact), "Product_ID", "Revenue", TOP_PRODUCTS)


@query(
    "j4_name_lookup",
    "Product_ID:s Revenue:4 display:s",
    """WITH n AS (
         SELECT Product_ID, replace(replace(Product_Name, 'Item', 'Product'), ' ', ' no. ') AS display
         FROM (SELECT Product_ID, arg_min(Product_Name, "Date") AS Product_Name FROM pw GROUP BY 1) AS f
       )
       SELECT Product_ID, sum(Revenue) AS Revenue, display FROM pw LEFT JOIN n USING (Product_ID) GROUP BY 1, 3""",
)
def name_lookup(spark: SparkSession, d: str) -> DataFrame:
    totals = product_revenue(spark, d)
    names = table(spark, d, "part").select(F.col("p_brand").alias("Product_ID")).distinct()
    named = names.withColumn("display", replace_labels(product_name(), NAME_LABELS))
    return J.add_lookup(totals, named, "Product_ID")


RESAMPLE_SQL = """
WITH b AS (SELECT Product_ID, "Date" + 6 AS Week_End, sum(Sales_Units) AS s FROM pw GROUP BY 1, 2),
spine AS (
  SELECT Product_ID, CAST(unnest(generate_series(min(Week_End), max(Week_End), INTERVAL 7 DAY)) AS DATE) AS Week_End
  FROM b GROUP BY 1
)
SELECT Product_ID, Week_End, coalesce(s, 0) AS Sales_Units FROM spine LEFT JOIN b USING (Product_ID, Week_End)"""


@query("j5_weekly_resample", "Product_ID:s Week_End:d Sales_Units:2", RESAMPLE_SQL)
def weekly_resample(spark: SparkSession, d: str) -> DataFrame:
    lines = order_lines(spark, d, ["Product_ID", "Date", "Sales_Units"])
    return J.resample_weekly(lines, ["Product_ID"], "Date", "Sales_Units")


@query(
    "j5_event_gap_fill",
    "event_type:s Week_End:d value:2",
    """WITH b AS (
         SELECT event_type, CAST(date_trunc('week', ts) AS DATE) + 6 AS Week_End, sum(value) AS v FROM events GROUP BY 1, 2
       ), spine AS (
         SELECT event_type, CAST(unnest(generate_series(min(Week_End), max(Week_End), INTERVAL 7 DAY)) AS DATE) AS Week_End
         FROM b GROUP BY 1
       )
       SELECT event_type, Week_End, coalesce(v, 0) AS value FROM spine LEFT JOIN b USING (event_type, Week_End)""",
)
def event_gap_fill(spark: SparkSession, d: str) -> DataFrame:
    return J.resample_weekly(table(spark, d, "events"), ["event_type"], "ts", "value")


@query(
    "j6_calendar_grid",
    "Product_ID:s Date:d Sales_Units:2",
    """SELECT p.Product_ID, c."Date", coalesce(pw.Sales_Units, 0) AS Sales_Units
       FROM (SELECT DISTINCT Product_ID FROM pw) AS p
       CROSS JOIN (
         SELECT CAST(unnest(generate_series((SELECT min("Date") FROM pw), (SELECT max("Date") FROM pw), INTERVAL 7 DAY)) AS DATE)
           AS "Date"
       ) AS c
       LEFT JOIN pw ON pw.Product_ID = p.Product_ID AND pw."Date" = c."Date" """,
)
def calendar_grid(spark: SparkSession, d: str) -> DataFrame:
    fact = written_fact(spark, d, ["Sales_Units"])
    first, last = J.bounds(fact, "Date")
    grid = J.calendar_grid(fact.select("Product_ID").distinct(), first, last)
    return J.align_to_spine(fact, grid, ["Product_ID", "Date"])


@query(
    "j7_scalar_share",
    "Product_ID:s Revenue:4 Share:6",
    """SELECT Product_ID, sum(Revenue) AS Revenue, sum(Revenue) / (SELECT sum(Revenue) FROM pw) AS Share
       FROM pw GROUP BY 1""",
)
def scalar_share(spark: SparkSession, d: str) -> DataFrame:
    return share_of_total(product_revenue(spark, d), "Revenue")


@query(
    "j8_future_calendar",
    "Product_ID:s Week_Index:i Date:d Marketing_Spend:2 On_Promo:i",
    """WITH l AS (SELECT Product_ID, max(Week_Index) AS w, max("Date") AS d FROM pw GROUP BY 1),
       f AS (SELECT Product_ID, w + s AS Week_Index, d + CAST(7 * s AS INTEGER) AS "Date"
             FROM l, generate_series(1, 12) AS g(s)),
       y AS (SELECT Product_ID, Week_Index + 52 AS Week_Index, Marketing_Spend, CAST(On_Promo AS INTEGER) AS On_Promo FROM pw)
       SELECT Product_ID, Week_Index, "Date", coalesce(Marketing_Spend, 0) AS Marketing_Spend,
         coalesce(On_Promo, 0) AS On_Promo
       FROM f LEFT JOIN y USING (Product_ID, Week_Index)""",
)
def future_calendar(spark: SparkSession, d: str) -> DataFrame:
    fact = written_fact(spark, d, ["Week_Index", "Marketing_Spend", "On_Promo"])
    future = J.future_weeks(fact, ["Product_ID"], 12)
    last_year = fact.withColumns(
        {"Week_Index": F.col("Week_Index") + 52, "On_Promo": F.col("On_Promo").cast("long")}
    )
    return J.with_known_regressors(
        future, last_year, ["Product_ID", "Week_Index"], {"Marketing_Spend": 0.0, "On_Promo": 0}
    )


