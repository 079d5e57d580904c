"""Projections, filters, null handling, KPI formulas, dates and text."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom import functions as K
from kpiloom.operators.growth import add_growth, add_target, first_of_group
from kpiloom.operators.rollup import latest_year_table, rollup
from kpiloom.plans.fact import order_lines, product_name, product_week
from kpiloom.plans.fact_sql import FIRST_WEEK
from kpiloom.plans.registry import query
from kpiloom.plans.shared import rollup_sql, yearly_products
from kpiloom.sources import table

# --- projections and filters ------------------------------------------------


@query(
    "p1_project_columns",
    "Product_ID:s Date:d Sales_Units:2 Revenue:4 Profit:4",
    'SELECT Product_ID, "Date", Sales_Units, Revenue, Profit FROM pw',
)
def project_columns(spark: SparkSession, d: str) -> DataFrame:
    return product_week(spark, d, ["Sales_Units", "Revenue", "Profit"])


@query(
    "p2_equality_filter",
    "Order_Key:i Line_No:i Product_ID:s Sales_Units:2",
    "SELECT Order_Key, Line_No, Product_ID, Sales_Units FROM lines WHERE Product_ID = 'Brand#7'",
)
def equality_filter(spark: SparkSession, d: str) -> DataFrame:
    lines = order_lines(spark, d, ["Order_Key", "Line_No", "Product_ID", "Sales_Units"])
    return lines.where(F.col("Product_ID") == "Brand#7")


@query(
    "p3_conjunctive_filter",
    "Order_Key:i Line_No:i Revenue:4",
    "SELECT Order_Key, Line_No, Revenue FROM lines WHERE Category = 'ECONOMY' AND Region = 'ASIA'",
)
def conjunctive_filter(spark: SparkSession, d: str) -> DataFrame:
    lines = order_lines(spark, d, ["Order_Key", "Line_No", "Revenue", "Category", "Region"])
    return lines.where((F.col("Category") == "ECONOMY") & (F.col("Region") == "ASIA"))


@query(
    "p4_boolean_filter",
    "Product_ID:s Date:d Sales_Units:2",
    'SELECT Product_ID, "Date", Sales_Units FROM pw WHERE On_Promo',
)
def boolean_filter(spark: SparkSession, d: str) -> DataFrame:
    return product_week(spark, d, ["Sales_Units", "On_Promo"]).where("On_Promo")


@query(
    "p5_threshold_filter",
    "Product_ID:s Date:d Defect_Rate:6",
    'SELECT Product_ID, "Date", Defect_Rate FROM pw WHERE Defect_Rate >= 0.8',
)
def threshold_filter(spark: SparkSession, d: str) -> DataFrame:
    return product_week(spark, d, ["Defect_Rate"]).where(F.col("Defect_Rate") >= 0.8)


@query(
    "p6_rename",
    "ds:d y:2 Product_ID:s",
    'SELECT "Date" AS ds, Sales_Units AS y, Product_ID FROM pw',
)
def rename(spark: SparkSession, d: str) -> DataFrame:
    return product_week(spark, d, ["Sales_Units"]).withColumnsRenamed({"Date": "ds", "Sales_Units": "y"})


GROWTH_SQL = """SELECT Product_ID, "Date", Sales_Units,
  Sales_Units / NULLIF(lag(Sales_Units, 52) OVER (PARTITION BY Product_ID ORDER BY "Date"), 0) - 1 AS pct
  FROM pw"""


def _growth(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Sales_Units"])
    return add_growth(fact, ["Product_ID"], "Date", {"pct": ("Sales_Units", 52)})


@query("p7_drop_nulls", "Product_ID:s Date:d pct:6", f"SELECT * FROM ({GROWTH_SQL}) AS g WHERE pct IS NOT NULL")
def drop_nulls(spark: SparkSession, d: str) -> DataFrame:
    return _growth(spark, d).dropna(subset=["pct"])


@query(
    "p8_fill_nulls",
    "Product_ID:s Date:d pct:6",
    f'SELECT Product_ID, "Date", coalesce(pct, 0) AS pct FROM ({GROWTH_SQL}) AS g',
)
def fill_nulls(spark: SparkSession, d: str) -> DataFrame:
    return _growth(spark, d).fillna(0.0, subset=["pct"])


@query(
    "p9_value_to_null",
    "Product_ID:s Returned_Units:2 weeks:i known:i finite:i",
    """SELECT Product_ID, sum(NULLIF(Returned_Units, 0)) AS Returned_Units, count(*) AS weeks,
         count(NULLIF(Returned_Units, 0)) AS known,
         count(CASE WHEN Returned_Units <> 0 THEN Sales_Units / Returned_Units END) AS finite
       FROM pw GROUP BY 1""",
)
def value_to_null(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Sales_Units", "Returned_Units"])
    returned = K.null_if("Returned_Units", 0.0)
    ratio = F.when(F.col("Returned_Units") == 0, float("inf")).otherwise(
        K.safe_divide("Sales_Units", "Returned_Units")
    )
    return fact.groupBy("Product_ID").agg(
        F.sum(returned).alias("Returned_Units"),
        F.count(F.lit(1)).alias("weeks"),
        F.count(returned).alias("known"),
        F.count(K.null_if_infinite(ratio)).alias("finite"),
    )


@query(
    "p10_conditional_null",
    "Acq_Month:d n:i Acquisition:i",
    """SELECT CASE WHEN Acquisition > 2 THEN "Month" END AS Acq_Month, count(*) AS n, sum(Acquisition) AS Acquisition
       FROM pw GROUP BY 1""",
)
def conditional_null(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Acquisition"])
    month = K.month_start(K.keep_when(F.col("Acquisition") > 2, "Date"))
    return fact.groupBy(month.alias("Acq_Month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("Acquisition").alias("Acquisition")
    )


@query(
    "p11_guarded_division",
    "Product_ID:s Date:d or_zero:6 or_null:6",
    """SELECT Product_ID, "Date",
         CASE WHEN Returned_Units > 0 THEN Backorder / Returned_Units ELSE 0 END AS or_zero,
         Backorder / NULLIF(Returned_Units, 0) AS or_null
       FROM pw""",
)
def guarded_division(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Backorder", "Returned_Units"])
    return fact.withColumns(
        {
            "or_zero": K.safe_divide("Backorder", "Returned_Units", 0.0),
            "or_null": K.safe_divide("Backorder", "Returned_Units"),
        }
    )


@query(
    "p12_case_chain",
    "Order_Size:s lines:i Revenue:4",
    """SELECT CASE WHEN Sales_Units >= 40 THEN 'large' WHEN Sales_Units >= 15 THEN 'medium'
           WHEN Sales_Units IS NOT NULL THEN 'small' ELSE 'unknown' END AS Order_Size,
         count(*) AS lines, sum(Revenue) AS Revenue
       FROM lines GROUP BY 1""",
)
def case_chain(spark: SparkSession, d: str) -> DataFrame:
    units = F.col("Sales_Units")
    size = F.when(units >= 40, "large").when(units >= 15, "medium").when(units.isNotNull(), "small").otherwise("unknown")
    lines = order_lines(spark, d, ["Sales_Units", "Revenue"]).withColumn("Order_Size", size)
    return lines.groupBy("Order_Size").agg(F.count(F.lit(1)).alias("lines"), F.sum("Revenue").alias("Revenue"))


@query(
    "p13_drop_flag",
    "Product_ID:s Date:d is_drop:b",
    f'SELECT Product_ID, "Date", coalesce(pct < -0.1, false) AS is_drop FROM ({GROWTH_SQL}) AS g',
)
def drop_flag(spark: SparkSession, d: str) -> DataFrame:
    return _growth(spark, d).withColumn("is_drop", K.is_drop("pct"))


@query(
    "p14_casts",
    "Product_ID:s Date:d promo:i whole:i period:s",
    """SELECT Product_ID, "Date", CASE WHEN On_Promo THEN 1 ELSE 0 END AS promo,
         trunc(Efficiency_u_per_h) AS whole,
         CAST(year("Quarter") AS VARCHAR) || 'Q' || CAST(quarter("Quarter") AS VARCHAR) AS period
       FROM pw""",
)
def casts(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["On_Promo", "Efficiency_u_per_h", "Quarter"])
    return fact.withColumns(
        {
            "promo": F.col("On_Promo").cast("long"),
            "whole": K.truncate("Efficiency_u_per_h"),
            "period": F.concat(F.year("Quarter"), F.lit("Q"), F.quarter("Quarter")),
        }
    )


@query(
    "p15_adaptive_columns",
    "Product_ID:s Date:d Inventory:2 Ad_Clicks:2",
    'SELECT Product_ID, "Date", Inventory, 0 AS Ad_Clicks FROM pw',
)
def adaptive_columns(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Inventory"])
    return fact.select("Product_ID", "Date", K.present_or(fact, "Inventory"), K.present_or(fact, "Ad_Clicks"))


YEAR_MEASURES = {"Sales_Units": "sum", "Revenue": "sum", "Profit": "sum"}


@query(
    "p16_latest_year",
    "Year:i Product_ID:s Sales_Units:2 Revenue:4 Profit:4 Profit_Margin:6",
    f"""SELECT *, Profit / NULLIF(Revenue, 0) AS Profit_Margin FROM ({rollup_sql(["Product_ID", "Year"], YEAR_MEASURES)}) AS y
        WHERE "Year" = (SELECT max("Year") FROM pw)""",
)
def latest_year(spark: SparkSession, d: str) -> DataFrame:
    return latest_year_table(yearly_products(spark, d, YEAR_MEASURES))


# --- KPI formulas -----------------------------------------------------------


@query(
    "k1_order_profit",
    "Category:s line_value:2 margin:4",
    """SELECT p_type AS Category, sum(p_retailprice * l_quantity) AS line_value,
         sum(l_extendedprice - l_extendedprice * l_tax) AS margin
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
)
def order_profit(spark: SparkSession, d: str) -> DataFrame:
    lineitem, part = table(spark, d, "lineitem"), table(spark, d, "part")
    joined = lineitem.join(part, lineitem.l_partkey == part.p_partkey)
    return joined.groupBy(F.col("p_type").alias("Category")).agg(
        F.sum(K.line_profit("p_retailprice", "l_quantity")).alias("line_value"),
        F.sum(K.profit("l_extendedprice", F.col("l_extendedprice") * F.col("l_tax"))).alias("margin"),
    )


@query(
    "k2_order_cost",
    "Product_ID:s Date:d cost:4 churn:6",
    """SELECT Product_ID, "Date", Produced_Units * Efficiency_u_per_h + Marketing_Spend AS cost,
         1 - Returns_Rate AS churn FROM pw""",
)
def order_cost(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Produced_Units", "Efficiency_u_per_h", "Marketing_Spend", "Returns_Rate"])
    return fact.withColumns(
        {
            "cost": K.order_cost("Produced_Units", "Efficiency_u_per_h", "Marketing_Spend"),
            "churn": K.churn_rate("Returns_Rate"),
        }
    )


@query(
    "k3_cogs",
    "Product_ID:s Date:d by_weight:4 by_tenth:4 in_full:4",
    """SELECT Product_ID, "Date", Produced_Units * Price_per_Unit + Material_kg * 0.2 AS by_weight,
         Produced_Units * Price_per_Unit + Material_kg * 0.1 AS by_tenth,
         Produced_Units * Price_per_Unit + Material_kg AS in_full FROM pw""",
)
def cogs(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Produced_Units", "Price_per_Unit", "Material_kg"])
    variants = {"by_weight": 0.2, "by_tenth": 0.1, "in_full": 1.0}
    return fact.withColumns(
        {name: K.cogs("Produced_Units", "Price_per_Unit", "Material_kg", f) for name, f in variants.items()}
    )


@query(
    "k4_profit",
    "Product_ID:s Date:d basic:4 rich:4",
    """SELECT Product_ID, "Date", Revenue - COGS - Expenses AS basic,
         Revenue - COGS - Marketing_Spend - Logistics_Cost - Other_Expenses AS rich FROM pw""",
)
def profit(spark: SparkSession, d: str) -> DataFrame:
    costs = ["Marketing_Spend", "Logistics_Cost", "Other_Expenses"]
    fact = product_week(spark, d, ["Revenue", "COGS", "Expenses", *costs])
    return fact.withColumns(
        {"basic": K.profit("Revenue", "COGS", "Expenses"), "rich": K.profit("Revenue", "COGS", *costs)}
    )


@query(
    "k5_profit_margin",
    "Product_ID:s Date:d Profit_Margin:6",
    """SELECT Product_ID, "Date", round(CASE WHEN Revenue > 0 THEN Profit / Revenue ELSE 0 END, 4) AS Profit_Margin FROM pw""",
)
def profit_margin(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Profit", "Revenue"])
    return fact.withColumn("Profit_Margin", K.profit_margin("Profit", "Revenue"))


@query(
    "k6_efficiency",
    "Product_ID:s Date:d efficiency:6",
    """SELECT Product_ID, "Date", Produced_Units / (168 - Downtime_hours + 1e-6) AS efficiency FROM pw""",
)
def efficiency(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Produced_Units", "Downtime_hours"])
    return fact.withColumn("efficiency", K.efficiency("Produced_Units", F.lit(168.0), "Downtime_hours"))


@query(
    "k7_good_returned_units",
    "Product_ID:s Date:d good:i returned:i",
    """SELECT Product_ID, "Date", trunc(Produced_Units * (1 - Promo_Discount)) AS good,
         trunc(Sales_Units * Promo_Discount) AS returned FROM pw""",
)
def good_returned_units(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Produced_Units", "Sales_Units", "Promo_Discount"])
    return fact.withColumns(
        {
            "good": K.good_units("Produced_Units", "Promo_Discount"),
            "returned": K.returned_units("Sales_Units", "Promo_Discount"),
        }
    )


@query(
    "k8_discounted_price",
    "p_partkey:i price:2",
    "SELECT p_partkey, round(CAST(p_retailprice * (1 - p_size / 100) AS DECIMAL(18, 6)), 2) AS price FROM part",
)
def discounted_price(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return part.withColumn("price", K.discounted_price("p_retailprice", F.col("p_size") / 100))


@query(
    "k9_weeks_of_inventory",
    "Product_ID:s Date:d weeks:6 weeks_unguarded:4",
    """SELECT Product_ID, "Date", Inventory / (NULLIF(Sales_Units, 0) + 1e-6) AS weeks,
         round(Inventory / (Sales_Units + 1e-6), 2) AS weeks_unguarded FROM pw""",
)
def weeks_of_inventory(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Inventory", "Sales_Units"])
    return fact.withColumns(
        {
            "weeks": K.weeks_of_inventory("Inventory", "Sales_Units"),
            "weeks_unguarded": K.weeks_of_inventory_unguarded("Inventory", "Sales_Units"),
        }
    )


@query(
    "k10_fill_rate",
    "Product_ID:s Date:d fill_rate:6",
    """SELECT Product_ID, "Date", 1 - Backorder / (NULLIF(Sales_Units, 0) + 1e-6) AS fill_rate FROM pw""",
)
def fill_rate(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Backorder", "Sales_Units"])
    return fact.withColumn("fill_rate", K.fill_rate("Backorder", "Sales_Units"))


@query(
    "k11_target_achieved",
    "Product_ID:s Date:d plain:6 guarded:6",
    """WITH t AS (SELECT Product_ID, round_even(avg(Sales_Units) * 1.05, 0) AS target FROM pw GROUP BY 1)
       SELECT Product_ID, "Date", Sales_Units / NULLIF(target, 0) AS plain, Sales_Units / (target + 1e-9) AS guarded
       FROM pw JOIN t USING (Product_ID)""",
)
def target_achieved(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Sales_Units"])
    return add_target(fact).withColumns(
        {
            "plain": K.target_achieved("Sales_Units", "Weekly_Target", 0),
            "guarded": K.target_achieved("Sales_Units", "Weekly_Target"),
        }
    )


@query(
    "k12_acquisition_cost",
    "Product_ID:s Month:d cost:4",
    """SELECT Product_ID, "Month", round(sum(Marketing_Spend) / (sum(Acquisition) + 1e-6), 2) AS cost FROM pw GROUP BY 1, 2""",
)
def acquisition_cost(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Month", "Marketing_Spend", "Acquisition"])
    monthly = rollup(fact, ["Product_ID", "Month"], {"Marketing_Spend": "sum", "Acquisition": "sum"})
    return monthly.withColumn("cost", K.acquisition_cost("Marketing_Spend", "Acquisition"))


@query(
    "k13_weeks_since_acquisition",
    "weeks:i customers:i orders:i",
    f"""WITH o AS (
          SELECT o_custkey, date_diff('day', DATE '{FIRST_WEEK}', CAST(o_orderdate AS DATE)) AS day FROM orders
        ), w AS (SELECT o_custkey, CAST(floor(day / 7) AS BIGINT) AS week FROM o)
        SELECT week - start AS weeks, count(DISTINCT o_custkey) AS customers, count(*) AS orders
        FROM (SELECT *, min(week) OVER (PARTITION BY o_custkey) AS start FROM w) AS s GROUP BY 1""",
)
def weeks_since_acquisition(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(
        "o_custkey", K.week_index("o_orderdate", FIRST_WEEK).alias("week")
    )
    per_week = orders.groupBy("o_custkey", "week").agg(F.count(F.lit(1)).alias("orders"))
    known = first_of_group(per_week, ["o_custkey"], "week", "start")
    return known.groupBy(K.weeks_since("week", "start").alias("weeks")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("orders").alias("orders")
    )


@query(
    "k14_campaign_roi",
    "Campaign:s Region:s ROI:9",
    """SELECT Campaign, Region, avg(Acquisition_Rate) / NULLIF(sum(Marketing_Spend), 0) * 100 AS ROI
       FROM lines GROUP BY 1, 2""",
)
def campaign_roi(spark: SparkSession, d: str) -> DataFrame:
    lines = order_lines(spark, d, ["Campaign", "Region", "Marketing_Spend", "Acquisition_Rate"])
    totals = rollup(lines, ["Campaign", "Region"], {"Marketing_Spend": "sum", "Acquisition_Rate": "mean"})
    return totals.withColumn("ROI", K.campaign_roi("Acquisition_Rate", "Marketing_Spend"))


@query(
    "k15_clip",
    "Product_ID:s Date:d clipped:6",
    """SELECT Product_ID, "Date", greatest(0.25, least(0.75, Defect_Rate)) AS clipped FROM pw""",
)
def clip(spark: SparkSession, d: str) -> DataFrame:
    return product_week(spark, d, ["Defect_Rate"]).withColumn("clipped", K.clip("Defect_Rate", 0.25, 0.75))


# --- dates, numbers and text ------------------------------------------------


def _per_bucket(spark: SparkSession, d: str, name: str, bucket: object) -> DataFrame:
    lines = order_lines(spark, d, ["Ship_Date", "Revenue"])
    return lines.groupBy(bucket.alias(name)).agg(F.count(F.lit(1)).alias("n"), F.sum("Revenue").alias("Revenue"))


def _bucket_sql(name: str, bucket: str) -> str:
    return f'SELECT {bucket} AS "{name}", count(*) AS n, sum(Revenue) AS Revenue FROM lines GROUP BY 1'


@query("d1_month_start", "Month:d n:i Revenue:4", _bucket_sql("Month", "date_trunc('month', Ship_Date)"))
def month_start(spark: SparkSession, d: str) -> DataFrame:
    return _per_bucket(spark, d, "Month", K.month_start("Ship_Date"))


@query("d2_quarter_start", "Quarter:d n:i Revenue:4", _bucket_sql("Quarter", "date_trunc('quarter', Ship_Date)"))
def quarter_start(spark: SparkSession, d: str) -> DataFrame:
    return _per_bucket(spark, d, "Quarter", K.quarter_start("Ship_Date"))


@query(
    "d3_date_parts",
    "Year:i Quarter_No:i Month_No:i n:i",
    """SELECT year(Ship_Date) AS "Year", quarter(Ship_Date) AS Quarter_No, month(Ship_Date) AS Month_No, count(*) AS n
       FROM lines GROUP BY 1, 2, 3""",
)
def date_parts(spark: SparkSession, d: str) -> DataFrame:
    lines = order_lines(spark, d, ["Ship_Date"])
    parts = (F.year("Ship_Date").alias("Year"), F.quarter("Ship_Date").alias("Quarter_No"))
    return lines.groupBy(*parts, F.month("Ship_Date").alias("Month_No")).agg(F.count(F.lit(1)).alias("n"))


@query("d4_week_start", "Week:d n:i Revenue:4", _bucket_sql("Week", "date_trunc('week', Ship_Date)"))
def week_start(spark: SparkSession, d: str) -> DataFrame:
    return _per_bucket(spark, d, "Week", K.week_start("Ship_Date"))


@query(
    "d5_week_index",
    "Week_Index:i n:i Revenue:4",
    _bucket_sql("Week_Index", f"date_diff('day', DATE '{FIRST_WEEK}', Ship_Date) // 7"),
)
def week_index(spark: SparkSession, d: str) -> DataFrame:
    return _per_bucket(spark, d, "Week_Index", K.week_index("Ship_Date", FIRST_WEEK))


@query(
    "d6_cohort_period",
    "Month:d period:i months:i",
    """WITH m AS (SELECT DISTINCT "Month" FROM pw)
       SELECT "Month", date_diff('day', f, "Month") // 30 AS period, date_diff('month', f, "Month") AS months
       FROM m, (SELECT min("Month") AS f FROM m) AS s""",
)
def cohort_period(spark: SparkSession, d: str) -> DataFrame:
    months = product_week(spark, d, ["Month"]).select("Month").distinct()
    first = months.agg(F.min("Month")).scalar()
    return months.withColumn("first", first).withColumns(
        {"period": K.cohort_period("Month", "first"), "months": K.cohort_month_no("Month", "first")}
    )


@query("d7_month_label", "label:s n:i Revenue:4", _bucket_sql("label", "strftime(Ship_Date, '%Y-%m')"))
def month_label(spark: SparkSession, d: str) -> DataFrame:
    return _per_bucket(spark, d, "label", K.year_month_label("Ship_Date"))


@query(
    "x1_cyclic_month",
    "Date:d month_sin:6 month_cos:6",
    f"""SELECT DISTINCT "Date", sin(2 * {math.pi!r} * month("Date") / 12) AS month_sin,
          cos(2 * {math.pi!r} * month("Date") / 12) AS month_cos FROM pw""",
)
def cyclic_month(spark: SparkSession, d: str) -> DataFrame:
    sin, cos = K.cyclic_month("Date")
    weeks = order_lines(spark, d, ["Date"]).distinct()
    return weeks.withColumns({"month_sin": sin, "month_cos": cos})


@query(
    "x2_rounding",
    "Product_ID:s half_up:2 half_even:i whole:i",
    """SELECT Product_ID, avg(Sales_Units) AS half_up, round_even(avg(Sales_Units) * 1.05, 0) AS half_even,
         trunc(avg(Sales_Units) * 1.05) AS whole FROM pw GROUP BY 1""",
)
def rounding(spark: SparkSession, d: str) -> DataFrame:
    mean = F.avg("Sales_Units")
    return product_week(spark, d, ["Sales_Units"]).groupBy("Product_ID").agg(
        F.round(mean, 2).alias("half_up"),
        K.round_half_even(mean * 1.05).alias("half_even"),
        K.truncate(mean * 1.05).alias("whole"),
    )


@query(
    "x3_powers",
    "Product_ID:s root:6 size:4 square:2",
    """SELECT Product_ID, sum(sqrt(Sales_Units)) AS root, sum(abs(Profit)) AS size, sum(pow(Sales_Units, 2)) AS square
       FROM pw GROUP BY 1""",
)
def powers(spark: SparkSession, d: str) -> DataFrame:
    return product_week(spark, d, ["Sales_Units", "Profit"]).groupBy("Product_ID").agg(
        F.sum(F.sqrt("Sales_Units")).alias("root"),
        F.sum(F.abs("Profit")).alias("size"),
        F.sum(F.pow("Sales_Units", F.lit(2))).alias("square"),
    )


@query(
    "t1_code_prefix",
    "code:s n:i",
    "SELECT upper(substr(p_name, 1, 3)) AS code, count(*) AS n FROM part GROUP BY 1",
)
def code_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(K.code_prefix("p_name").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "t2_padded_key",
    "p_partkey:i product_key:s order_key:s",
    """SELECT p_partkey,
         'P' || CASE WHEN length(k) < 3 THEN lpad(k, 3, '0') ELSE k END AS product_key,
         'ORD-' || CASE WHEN length(k) < 4 THEN lpad(k, 4, '0') ELSE k END AS order_key
       FROM (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k FROM part) AS p""",
)
def padded_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumns(
        {"product_key": K.padded_key("P", "p_partkey", 3), "order_key": K.padded_key("ORD-", "p_partkey", 4)}
    )


NAME_LABELS = {"Item": "Product", " ": " no. "}


@query(
    "t3_replace_labels",
    "Product_ID:s Product_Name:s display:s",
    """SELECT DISTINCT Product_ID, Product_Name,
         replace(replace(Product_Name, 'Item', 'Product'), ' ', ' no. ') AS display FROM pw""",
)
def replace_labels(spark: SparkSession, d: str) -> DataFrame:
    names = order_lines(spark, d, ["Product_ID"]).distinct().withColumn("Product_Name", product_name())
    return names.withColumn("display", K.replace_labels("Product_Name", NAME_LABELS))


@query(
    "t4_percent_text",
    "Product_ID:s text:s",
    """SELECT Product_ID, printf('%.1f', sum(Profit) / sum(Revenue) * 100) AS text FROM pw GROUP BY 1""",
)
def percent_text(spark: SparkSession, d: str) -> DataFrame:
    totals = rollup(product_week(spark, d, ["Profit", "Revenue"]), ["Product_ID"], {"Profit": "sum", "Revenue": "sum"})
    return totals.withColumn("text", K.percent_text(K.safe_divide("Profit", "Revenue")))


