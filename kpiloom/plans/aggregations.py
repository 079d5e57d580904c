"""Calendar, product, region, campaign and channel rollups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions import campaign_roi, month_start, weeks_of_inventory
from kpiloom.operators import rollup as R
from kpiloom.operators import sketches as SK
from kpiloom.operators import stats
from kpiloom.operators.comoments import correlation_blocks
from kpiloom.operators.forecast import REGRID
from kpiloom.operators.growth import add_growth, first_of_group, long_enough
from kpiloom.operators.reports import cohort_sums
from kpiloom.plans.fact import order_lines, product_week
from kpiloom.plans.registry import query
from kpiloom.plans.shared import (
    company,
    measures_sql,
    monthly_products,
    product_revenue,
    rollup_sql,
    written_fact,
    yearly_products,
)
from kpiloom.session import checkpointed, scratch_path
from kpiloom.sources import table

MONEY = {
    "Revenue": 4,
    "COGS": 4,
    "Expenses": 4,
    "Profit": 4,
    "Marketing_Spend": 4,
    "Logistics_Cost": 4,
    "Other_Expenses": 4,
    "Raw_Material_Cost": 2,
    "Material_kg": 2,
}
WHOLE = {"Produced_Units", "Good_Units", "Sales_Units", "Returned_Units", "Acquisition", "Customer_Acquisition"}


def out_of(keys: str, measures: dict[str, str]) -> str:
    """Output statement: money to 4 digits, units whole, means to 6 digits."""
    kinds = [f"{m}:{'i' if m in WHOLE else MONEY.get(m, 6)}" for m in measures]
    return " ".join([keys, *kinds])


# --- order-level rollups ----------------------------------------------------


@query("a1_total_profit", "Total_Profit:4", "SELECT sum(Profit) AS Total_Profit FROM lines")
def total_profit(spark: SparkSession, d: str) -> DataFrame:
    return order_lines(spark, d, ["Profit"]).agg(F.sum("Profit").alias("Total_Profit"))


def _by(name: str, key: str, measures: dict[str, str], key_type: str = "s") -> None:
    """Order-level rollup by one category column."""

    @query(name, out_of(f"{key}:{key_type}", measures), rollup_sql([key], measures, "lines"))
    def build(spark: SparkSession, d: str) -> DataFrame:
        return R.rollup(order_lines(spark, d, [key, *measures]), [key], measures)


_by("a2_mean_by_category", "Category", {"Efficiency_Rate": "mean"})
_by(
    "a6_category_kpis",
    "Category",
    {"Efficiency_Rate": "mean", "Lead_Time_Days": "mean", "Profit": "sum"},
)
_by("a8_region_kpis", "Region", {"Revenue": "sum", "Profit": "sum", "Acquisition_Rate": "mean"})
_by("a9_campaign_kpis", "Campaign", {"Revenue": "sum", "Acquisition_Rate": "mean", "Satisfaction": "mean"})


@query(
    "a3_month_product_sum",
    "Month:d Total_Profit:4",
    """SELECT date_trunc('month', Ship_Date) AS "Month", sum(Price_per_Unit * Sales_Units) AS Total_Profit
       FROM lines GROUP BY 1""",
)
def month_product_sum(spark: SparkSession, d: str) -> DataFrame:
    lines = order_lines(spark, d, ["Ship_Date", "Price_per_Unit", "Sales_Units"])
    priced = lines.withColumn("Total_Profit", F.col("Price_per_Unit") * F.col("Sales_Units"))
    return R.calendar_rollup(priced, "Month", {"Total_Profit": "sum"}, date="Ship_Date")


MONTH_KPIS = {"Revenue": "sum", "Profit": "sum", "Acquisition_Rate": "mean", "Line_No": "sum"}


@query(
    "a4_month_kpis",
    "Month:d Revenue:4 Profit:4 Acquisition_Rate:6 Line_No:i",
    f"""SELECT date_trunc('month', Ship_Date) AS "Month", {measures_sql(MONTH_KPIS)} FROM lines GROUP BY 1""",
)
def month_kpis(spark: SparkSession, d: str) -> DataFrame:
    lines = order_lines(spark, d, ["Ship_Date", *MONTH_KPIS])
    return R.calendar_rollup(lines, "Month", MONTH_KPIS, date="Ship_Date")


@query(
    "a4_day_traffic",
    "day:d views:i signups:i acquisition:6",
    """SELECT CAST(ts AS DATE) AS day, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS views,
         sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS signups,
         sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
           / NULLIF(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END), 0) AS acquisition
       FROM events GROUP BY 1""",
)
def day_traffic(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    per_day = events.groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("event_type") == "view").alias("views"),
        F.count_if(F.col("event_type") == "signup").alias("signups"),
    )
    return per_day.withColumn("acquisition", F.try_divide("signups", "views"))


@query(
    "a5_campaign_spend",
    "Campaign:s Marketing_Spend:4 Acquisition_Rate:6 ROI:9",
    """SELECT *, Acquisition_Rate / NULLIF(Marketing_Spend, 0) * 100 AS ROI FROM (
         SELECT Campaign, sum(Marketing_Spend) AS Marketing_Spend, avg(Acquisition_Rate) AS Acquisition_Rate
         FROM lines WHERE Campaign IS NOT NULL GROUP BY 1) AS c""",
)
def campaign_spend(spark: SparkSession, d: str) -> DataFrame:
    lines = order_lines(spark, d, ["Campaign", "Marketing_Spend", "Acquisition_Rate"])
    spend = R.rollup(lines, ["Campaign"], {"Marketing_Spend": "sum", "Acquisition_Rate": "mean"})
    return spend.withColumn("ROI", campaign_roi("Acquisition_Rate", "Marketing_Spend"))


@query(
    "a7_quarter_of_year",
    "Quarter_No:i Efficiency_Rate:6 Lead_Time_Days:6",
    """SELECT quarter(Ship_Date) AS Quarter_No, avg(Efficiency_Rate) AS Efficiency_Rate,
         avg(Lead_Time_Days) AS Lead_Time_Days FROM lines GROUP BY 1""",
)
def quarter_of_year(spark: SparkSession, d: str) -> DataFrame:
    lines = order_lines(spark, d, ["Ship_Date", "Efficiency_Rate", "Lead_Time_Days"])
    means = {"Efficiency_Rate": "mean", "Lead_Time_Days": "mean"}
    return R.calendar_rollup(lines, "Quarter_No", means, date="Ship_Date")


@query(
    "a10_campaign_share",
    "Campaign:s Revenue:4 Share:6",
    """SELECT Campaign, sum(Revenue) AS Revenue, sum(Revenue) / (SELECT sum(Revenue) FROM lines) AS Share
       FROM lines GROUP BY 1""",
)
def campaign_share(spark: SparkSession, d: str) -> DataFrame:
    lines = order_lines(spark, d, ["Campaign", "Revenue"])
    return R.share_of_total(R.rollup(lines, ["Campaign"], {"Revenue": "sum"}), "Revenue")


@query(
    "a11_channel_interval",
    "Channel:s n:i mean:6 low:6 high:6",
    """SELECT Channel, count(*) AS n, avg(Efficiency_Rate) AS mean,
         avg(Efficiency_Rate) - 1.96 * stddev_samp(Efficiency_Rate) / sqrt(count(*)) AS low,
         avg(Efficiency_Rate) + 1.96 * stddev_samp(Efficiency_Rate) / sqrt(count(*)) AS high
       FROM lines GROUP BY 1""",
)
def channel_interval(spark: SparkSession, d: str) -> DataFrame:
    return R.mean_with_interval(order_lines(spark, d, ["Channel", "Efficiency_Rate"]), "Channel", "Efficiency_Rate")


REPLICATES = 200


@query(
    "a11_channel_bootstrap",
    "Channel:s n:i mean:6 low:6 high:6",
    f"""SELECT w.Channel, w.n, w.mean, quantile_cont(b.mean, 0.025) AS low, quantile_cont(b.mean, 0.975) AS high FROM (
          SELECT Channel, r, sum(v * k) / NULLIF(sum(k), 0) AS mean FROM (
            SELECT Channel, v, r, {" + ".join(f"CAST(u >= {t} AS INTEGER)" for t in R.POISSON)} AS k FROM (
              SELECT Channel, v, r, (a + r * b) % {R.PRIME} AS u FROM (
                SELECT Channel, v, CAST('0x' || substr(h, 1, 8) AS BIGINT) % {R.PRIME} AS a,
                  CAST('0x' || substr(h, 9, 8) AS BIGINT) % {R.PRIME - 1} + 1 AS b
                FROM (SELECT Channel, Efficiency_Rate AS v, md5('42-' || Order_Key || '-' || Line_No) AS h FROM lines) AS x
              ) AS y, range({REPLICATES}) AS g(r)
            ) AS z
          ) AS d GROUP BY 1, 2
        ) AS b JOIN (SELECT Channel, count(*) AS n, avg(Efficiency_Rate) AS mean FROM lines GROUP BY 1) AS w USING (Channel)
        GROUP BY 1, 2, 3""",
)
def channel_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    lines = order_lines(spark, d, ["Channel", "Efficiency_Rate", "Order_Key", "Line_No"])
    return R.mean_with_bootstrap(lines, "Channel", "Efficiency_Rate", ["Order_Key", "Line_No"], REPLICATES)


@query(
    "a12_filtered_month",
    "Month:d Revenue:4 Profit:4 Efficiency_Rate:6 Lead_Time_Days:6",
    """SELECT date_trunc('month', Ship_Date) AS "Month", sum(Revenue) AS Revenue, sum(Profit) AS Profit,
         avg(Efficiency_Rate) AS Efficiency_Rate, avg(Lead_Time_Days) AS Lead_Time_Days
       FROM lines WHERE Category = 'STANDARD' AND Region = 'EUROPE' GROUP BY 1""",
)
def filtered_month(spark: SparkSession, d: str) -> DataFrame:
    lines = order_lines(
        spark, d, ["Ship_Date", "Category", "Region", "Revenue", "Profit", "Efficiency_Rate", "Lead_Time_Days"]
    )
    picked = lines.where((F.col("Category") == "STANDARD") & (F.col("Region") == "EUROPE"))
    measures = {"Revenue": "sum", "Profit": "sum", "Efficiency_Rate": "mean", "Lead_Time_Days": "mean"}
    return R.calendar_rollup(picked, "Month", measures, date="Ship_Date")


# --- product-week rollups ---------------------------------------------------

COMPANY_SUMS = {"Sales_Units": "sum", "Revenue": "sum", "Profit": "sum"}


@query("a13_company_week", out_of("Date:d", COMPANY_SUMS), rollup_sql(["Date"], COMPANY_SUMS))
def company_week(spark: SparkSession, d: str) -> DataFrame:
    return R.rollup(product_week(spark, d, list(COMPANY_SUMS)), ["Date"], COMPANY_SUMS)


NAMED = ["Product_Name", "Category"]
NAMED_OUT = "Product_ID:s Product_Name:s Category:s"


def _monthly(name: str, measures: dict[str, str]) -> None:
    @query(
        name,
        out_of(f"Month:d {NAMED_OUT}", measures),
        rollup_sql(["Month", "Product_ID", *NAMED], measures),
    )
    def build(spark: SparkSession, d: str) -> DataFrame:
        return monthly_products(spark, d, measures, NAMED)


_monthly("a14_month_basic", R.BASIC_MEASURES)
_monthly("a15_month_rich", R.RICH_MEASURES)
_monthly("a16_month_operations", R.OPERATIONS_MEASURES)
_monthly("a17_month_quality", R.QUALITY_MEASURES)
_monthly("a18_month_sales", R.SALES_MEASURES)


@query(
    "a19_quarter_product",
    out_of(f"Quarter:d {NAMED_OUT}", R.PERIOD_MEASURES),
    rollup_sql(["Quarter", "Product_ID", *NAMED], R.PERIOD_MEASURES),
)
def quarter_product(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Quarter", *NAMED, *R.PERIOD_MEASURES])
    return R.rollup(fact, ["Quarter", "Product_ID", *NAMED], R.PERIOD_MEASURES)


QUARTER_MEANS = {"Efficiency_u_per_h": "mean", "Lead_Time_days": "mean"}


@query("a20_quarter_company", out_of("Quarter:d", QUARTER_MEANS), rollup_sql(["Quarter"], QUARTER_MEANS))
def quarter_company(spark: SparkSession, d: str) -> DataFrame:
    return company(spark, d, "Quarter", QUARTER_MEANS)


def _yearly(name: str, measures: dict[str, str]) -> None:
    @query(name, out_of(f"Year:i {NAMED_OUT}", measures), rollup_sql(["Year", "Product_ID", *NAMED], measures))
    def build(spark: SparkSession, d: str) -> DataFrame:
        return yearly_products(spark, d, measures, NAMED)


_yearly("a21_year_basic", R.BASIC_MEASURES)
_yearly("a21_year_rich", R.RICH_MEASURES)
_yearly("a22_year_period", R.PERIOD_MEASURES)


@query(
    "a23_latest_year_margin",
    out_of(f"Year:i {NAMED_OUT}", R.RICH_MEASURES) + " Profit_Margin:6",
    f"""SELECT *, Profit / NULLIF(Revenue, 0) AS Profit_Margin
        FROM ({rollup_sql(["Year", "Product_ID", *NAMED], R.RICH_MEASURES)}) AS y
        WHERE "Year" = (SELECT max("Year") FROM pw)""",
)
def latest_year_margin(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_year_table(checkpointed(yearly_products(spark, d, R.RICH_MEASURES, NAMED)))


TWO_LEVEL = {"Sales_Units": "sum", "Revenue": "sum", "Produced_Units": "sum"}


@query(
    "a24_two_level_month",
    out_of("Month:d", TWO_LEVEL) + " MoM_Sales_pct:6",
    f"""SELECT *, Sales_Units / NULLIF(lag(Sales_Units) OVER (ORDER BY "Month"), 0) - 1 AS MoM_Sales_pct
        FROM (SELECT "Month", {measures_sql(TWO_LEVEL)}
          FROM ({rollup_sql(["Product_ID", "Month"], TWO_LEVEL)}) AS m GROUP BY 1) AS c""",
)
def two_level_month(spark: SparkSession, d: str) -> DataFrame:
    monthly = R.rollup(monthly_products(spark, d, TWO_LEVEL), ["Month"], TWO_LEVEL)
    return add_growth(monthly, [], "Month", {"MoM_Sales_pct": ("Sales_Units", 1)})


@query(
    "a25_weekly_target",
    "Product_ID:s half_even:i truncated:i",
    """SELECT Product_ID, round_even(avg(Sales_Units) * 1.05, 0) AS half_even, trunc(avg(Sales_Units) * 1.05) AS truncated
       FROM pw GROUP BY 1""",
)
def weekly_target(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Sales_Units"])
    return fact.groupBy("Product_ID").agg(
        *[R.target_of("Sales_Units", 1.05, how).alias(how) for how in ("half_even", "truncated")]
    )


@query(
    "a26_product_revenue_name",
    "Product_ID:s Revenue:4 Product_Name:s",
    """SELECT Product_ID, sum(Revenue) AS Revenue, arg_min(Product_Name, "Date") AS Product_Name FROM pw GROUP BY 1""",
)
def product_revenue_name(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Revenue", "Product_Name"])
    return fact.groupBy("Product_ID").agg(
        F.sum("Revenue").alias("Revenue"), F.min_by("Product_Name", "Date").alias("Product_Name")
    )


@query(
    "a27_product_revenue_sorted",
    "Product_ID:s Revenue:4",
    "SELECT Product_ID, sum(Revenue) AS Revenue FROM pw GROUP BY 1 ORDER BY 2 DESC, 1",
)
def product_revenue_sorted(spark: SparkSession, d: str) -> DataFrame:
    return product_revenue(spark, d).orderBy(F.desc("Revenue"), "Product_ID")


@query(
    "a28_regrid_week",
    "Product_ID:s Week_Index:i Date:d Sales_Units:i On_Promo:b Marketing_Spend:4 Price_per_Unit:6 Inventory:4 Lead_Time_days:6",
    rollup_sql(["Product_ID", "Week_Index", "Date"], {**REGRID, "On_Promo": "any"}),
)
def regrid_week(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Week_Index", *REGRID])
    return R.regrid_weekly(fact, ["Product_ID", "Week_Index", "Date"], REGRID)


@query(
    "a29_product_week_sum",
    "Product_ID:s Week_Index:i Sales_Units:2",
    "SELECT Product_ID, Week_Index, sum(Sales_Units) AS Sales_Units FROM pw GROUP BY 1, 2",
)
def product_week_sum(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Week_Index", "Sales_Units"])
    return R.rollup(fact, ["Product_ID", "Week_Index"], {"Sales_Units": "sum"})


@query(
    "a30_last_row",
    "Product_ID:s Month:d Revenue:4 Profit:4",
    f"""SELECT Product_ID, max("Month") AS "Month", arg_max(Revenue, "Month") AS Revenue, arg_max(Profit, "Month") AS Profit
        FROM ({rollup_sql(["Product_ID", "Month"], {"Revenue": "sum", "Profit": "sum"})}) AS m GROUP BY 1""",
)
def last_row(spark: SparkSession, d: str) -> DataFrame:
    monthly = monthly_products(spark, d, {"Revenue": "sum", "Profit": "sum"})
    return R.last_per_group(monthly, "Product_ID", "Month", ["Month", "Revenue", "Profit"])


# --- distributions and correlation ------------------------------------------

LINE_METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "a31_describe",
    "metric:s count:i mean:6 std:6 min:4 p25:4 p50:4 p75:4 max:4",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, count({c}) AS "count", avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS "min",
              quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75,
              max({c}) AS "max" FROM lineitem"""
        for c in LINE_METRICS
    ),
)
def describe(spark: SparkSession, d: str) -> DataFrame:
    return stats.describe(table(spark, d, "lineitem"), LINE_METRICS)


@query("a31_describe_sketched", "metric:s count:i mean:6 std:6 min:4 p25:4 p50:4 p75:4 max:4")
def describe_sketched(spark: SparkSession, d: str) -> DataFrame:
    return stats.describe(table(spark, d, "lineitem"), LINE_METRICS, method="approximate")


STORED_MONTHS = (dt.date(1996, 3, 1), dt.date(1998, 10, 1))


@query(
    "a31_stored_months",
    "metric:s count:i mean:6 std:6 min:4 max:4 within:b",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, count({c}) AS "count", avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS "min",
              max({c}) AS "max", true AS within FROM lineitem
            WHERE l_shipdate >= DATE '1996-03-01' AND l_shipdate < DATE '1998-11-01'"""
        for c in LINE_METRICS
    ),
)
def describe_stored(spark: SparkSession, d: str) -> DataFrame:
    """A range of months from their written summaries, and whether the rank of
    every quartile, counted in the rows, is within the stated error."""
    lines = table(spark, d, "lineitem")
    path = scratch_path(spark, "month-summaries")
    SK.month_summaries(lines, LINE_METRICS, month_start("l_shipdate")).write.parquet(path)
    described = SK.describe_months(spark.read.parquet(path), *STORED_MONTHS)
    rows = lines.where(month_start("l_shipdate").between(*[F.lit(m) for m in STORED_MONTHS]))
    off = SK.ranks_of(rows, described, LINE_METRICS)
    return described.join(off, "metric").withColumn("within", F.col("off") <= SK.rank_error())


@query(
    "a32_correlation_matrix",
    "x:s y:s corr:6",
    " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, corr({x}, {y}) AS corr FROM lineitem"
        for x in LINE_METRICS
        for y in LINE_METRICS
    ),
)
def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    return stats.correlation_matrix(table(spark, d, "lineitem"), LINE_METRICS)


# Monthly measures of the published correlation matrix.
MONTH_METRICS = {
    "Produced_Units": "sum",
    "Sales_Units": "sum",
    "Revenue": "sum",
    "Profit": "sum",
    "Defect_Rate": "mean",
    "Downtime_hours": "mean",
    "Raw_Material_Cost": "sum",
    "Employee_Satisfaction": "mean",
    "NPS": "mean",
}


@query(
    "a32_monthly_correlation",
    "x:s y:s corr:6",
    f"WITH m AS ({rollup_sql(['Product_ID', 'Month'], MONTH_METRICS)})\n"
    + " UNION ALL ".join(
        f"SELECT '{x}' AS x, '{y}' AS y, corr({x}, {y}) AS corr FROM m" for x in MONTH_METRICS for y in MONTH_METRICS
    ),
)
def monthly_correlation(spark: SparkSession, d: str) -> DataFrame:
    return stats.correlation_matrix(monthly_products(spark, d, MONTH_METRICS), list(MONTH_METRICS))


@query(
    "a32_blocked_matrix",
    "x:s y:s corr:6",
    f"WITH c AS (SELECT {', '.join(f'CASE WHEN l_linenumber <> {i} THEN {c} END AS {c}' for i, c in enumerate(LINE_METRICS, 1))} FROM lineitem)\n"
    + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, corr({x}, {y}) AS corr FROM c" for x in LINE_METRICS for y in LINE_METRICS),
)
def blocked_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Each measure missing on the lines of one number, so that every pair has rows of its own."""
    holes = {c: F.when(F.col("l_linenumber") != i, F.col(c)) for i, c in enumerate(LINE_METRICS, 1)}
    return correlation_blocks(table(spark, d, "lineitem").withColumns(holes), LINE_METRICS)


@query(
    "a33_price_sensitivity",
    "Product_ID:s corr:6 n:i",
    "SELECT Product_ID, corr(Sales_Units, Price_per_Unit) AS corr, count(*) AS n FROM pw GROUP BY 1",
)
def price_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Sales_Units", "Price_per_Unit"])
    return stats.correlation_by_group(fact, "Product_ID", "Sales_Units", "Price_per_Unit")


def _histogram_sql(column: str, source: str) -> str:
    return f"""WITH v AS (SELECT {column} AS v FROM {source} WHERE {column} IS NOT NULL),
      b AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
      e AS (SELECT i AS bin, lo + i * ((hi - lo) / 40) AS low,
          CASE WHEN i = 39 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 40) END AS high
        FROM b, range(40) AS r(i))
      SELECT bin, low, high, count(v) AS n
      FROM e LEFT JOIN v ON v >= low AND (v < high OR bin = 39) GROUP BY 1, 2, 3"""


@query("a34_price_histogram", "bin:i low:4 high:4 n:i", _histogram_sql("l_extendedprice", "lineitem"))
def price_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(table(spark, d, "lineitem"), "l_extendedprice")


@query(
    "a34_inventory_histogram",
    "bin:i low:4 high:4 n:i",
    _histogram_sql("woi", "(SELECT Inventory / (NULLIF(Sales_Units, 0) + 1e-6) AS woi FROM pw) AS w"),
)
def inventory_histogram(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Inventory", "Sales_Units"])
    return stats.histogram(fact.select(weeks_of_inventory("Inventory", "Sales_Units").alias("woi")), "woi")


# --- cohorts, distinct values, counts ---------------------------------------

COHORT_SQL = """
SELECT Acquisition_Month, "Month", sum(o_totalprice) AS n_sales, date_diff('day', Acquisition_Month, "Month") // 30 AS Cohort_Period
FROM (
  SELECT min("Month") OVER (PARTITION BY o_custkey) AS Acquisition_Month, "Month", o_totalprice
  FROM (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS "Month", o_totalprice FROM orders) AS o
) AS c
GROUP BY Acquisition_Month, "Month" ORDER BY 1, 2"""


def customer_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """Order value per (first order month, month)."""
    orders = R.calendar_rollup(
        table(spark, d, "orders"), "Month", {"o_totalprice": "sum"}, ["o_custkey"], date="o_orderdate"
    )
    known = first_of_group(orders, ["o_custkey"], "Month", "Acquisition_Month")
    return cohort_sums(known, "Acquisition_Month", "Month", "o_totalprice")


@query("a36_cohort_sums", "Acquisition_Month:d Month:d Cohort_Period:i n_sales:2", COHORT_SQL)
def cohort_table(spark: SparkSession, d: str) -> DataFrame:
    return customer_cohorts(spark, d)


@query(
    "a37_distinct_values",
    "Category:s Region:s",
    "SELECT DISTINCT Category, Region FROM lines",
)
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return order_lines(spark, d, ["Category", "Region"]).distinct()


@query(
    "a38_count_guard",
    "Product_ID:s Date:d Sales_Units:2",
    """SELECT Product_ID, "Date", Sales_Units FROM pw
       WHERE Product_ID IN (SELECT Product_ID FROM pw GROUP BY 1 HAVING count(*) >= 357)""",
)
def count_guard(spark: SparkSession, d: str) -> DataFrame:
    return long_enough(product_week(spark, d, ["Sales_Units"]), ["Product_ID"], 357)


@query(
    "a39_scalars",
    "last_year:i smallest:4 largest:4 total:4",
    """SELECT max("Year") AS last_year, min(Revenue) AS smallest, max(Revenue) AS largest, sum(Revenue) AS total FROM pw""",
)
def scalars(spark: SparkSession, d: str) -> DataFrame:
    return product_week(spark, d, ["Year", "Revenue"]).agg(
        F.max("Year").alias("last_year"),
        F.min("Revenue").alias("smallest"),
        F.max("Revenue").alias("largest"),
        F.sum("Revenue").alias("total"),
    )
