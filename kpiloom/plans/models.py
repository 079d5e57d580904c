"""Regressions, forecasts, tests, clustering, tree models and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiloom.functions import week_index
from kpiloom.operators import forecast as FC
from kpiloom.operators import gram as GR
from kpiloom.operators import ml, stats
from kpiloom.operators import qr as QR
from kpiloom.operators.forest import IsolationForest
from kpiloom.operators.growth import add_holdout, add_position, series_features
from kpiloom.operators.joins import fill_weeks, keep_top, resample_weekly
from kpiloom.operators.reports import compare_models, stack_models
from kpiloom.operators.rollup import rollup
from kpiloom.plans.fact import order_lines, product_week
from kpiloom.plans.fact_sql import FIRST_WEEK
from kpiloom.plans.joining import RESAMPLE_SQL
from kpiloom.plans.ranked import HOLDOUT_CTES, holdout_predictions
from kpiloom.plans.registry import query
from kpiloom.plans.shared import monthly_products, rollup_sql
from kpiloom.plans.windowed import LAGS_SQL
from kpiloom.session import checkpointed
from kpiloom.sources import table


@query(
    "m1_trend_forecast",
    "Product_ID:s Week_Index:i pred:4 r2:6 n:i",
    """SELECT Product_ID, last + step AS Week_Index, icpt + slope * (last + step) AS pred, r2, n
       FROM (SELECT Product_ID, regr_slope(Sales_Units, Week_Index) AS slope, regr_intercept(Sales_Units, Week_Index) AS icpt,
               regr_r2(Sales_Units, Week_Index) AS r2, max(Week_Index) AS last, count(*) AS n FROM pw GROUP BY 1) AS f,
         generate_series(1, 12) AS g(step) WHERE n >= 10""",
)
def trend_forecast(spark: SparkSession, d: str) -> DataFrame:
    return stats.trend_forecast(product_week(spark, d, ["Week_Index", "Sales_Units"]), "Product_ID")


SATISFACTION = {"Employee_Satisfaction": "mean", "Profit": "sum"}


@query(
    "m2_simple_regression",
    "slope:4 intercept:4 r2:6 n:i",
    f"""SELECT regr_slope(Profit, Employee_Satisfaction) AS slope, regr_intercept(Profit, Employee_Satisfaction) AS intercept,
          regr_r2(Profit, Employee_Satisfaction) AS r2, count(*) AS n
        FROM ({rollup_sql(["Product_ID", "Month"], SATISFACTION)}) AS m""",
)
def simple_regression(spark: SparkSession, d: str) -> DataFrame:
    return stats.simple_regression(monthly_products(spark, d, SATISFACTION), "Profit", "Employee_Satisfaction")


OPERATIONS = {"Lead_Time_days": "mean", "Efficiency_u_per_h": "mean"}


@query(
    "m3_line_fit",
    "Product_ID:s slope:6 intercept:6 r2:6 n:i",
    f"""SELECT Product_ID, regr_slope(Lead_Time_days, Efficiency_u_per_h) AS slope,
          regr_intercept(Lead_Time_days, Efficiency_u_per_h) AS intercept,
          regr_r2(Lead_Time_days, Efficiency_u_per_h) AS r2, count(*) AS n
        FROM ({rollup_sql(["Product_ID", "Month"], OPERATIONS)}) AS m GROUP BY 1 HAVING count(*) > 5""",
)
def line_fit(spark: SparkSession, d: str) -> DataFrame:
    monthly = monthly_products(spark, d, OPERATIONS)
    return stats.simple_regression(monthly, "Lead_Time_days", "Efficiency_u_per_h", ["Product_ID"], min_rows=6)


TWO_FEATURE_SQL = """WITH s AS (
         SELECT covar_samp(r, q) AS rq, covar_samp(r, x) AS rx, covar_samp(q, x) AS qx, var_samp(q) AS qq, var_samp(x) AS xx,
           avg(r) AS mr, avg(q) AS mq, avg(x) AS mx
         FROM (SELECT l_extendedprice * (1 - l_discount) AS r, l_quantity AS q, l_discount AS x FROM lineitem) AS l
       ), b AS (
         SELECT *, (rq * xx - rx * qx) / (qq * xx - qx * qx) AS b1, (rx * qq - rq * qx) / (qq * xx - qx * qx) AS b2 FROM s
       )
       SELECT 'Sales_Units' AS term, b1 AS coefficient FROM b
       UNION ALL SELECT 'Promo_Discount', b2 FROM b
       UNION ALL SELECT 'intercept', mr - b1 * mq - b2 * mx FROM b"""


@query("m4_two_feature_ols", "term:s coefficient:4", TWO_FEATURE_SQL)
def two_feature_ols(spark: SparkSession, d: str) -> DataFrame:
    lines = order_lines(spark, d, ["Revenue", "Sales_Units", "Promo_Discount"])
    return stats.ols(lines, "Revenue", ["Sales_Units", "Promo_Discount"])


@query("m4_qr_ols", "term:s coefficient:4", TWO_FEATURE_SQL)
def qr_ols(spark: SparkSession, d: str) -> DataFrame:
    """The same weights by tree-reduced QR of the rows."""
    lines = order_lines(spark, d, ["Revenue", "Sales_Units", "Promo_Discount"])
    return QR.qr_ols(lines, "Revenue", ["Sales_Units", "Promo_Discount"])


@query(
    "m5_trend_backtest",
    "Product_ID:s Date:d actual:2 pred:4",
    f'{HOLDOUT_CTES} SELECT Product_ID, "Date", y AS actual, trend AS pred FROM t',
)
def trend_backtest(spark: SparkSession, d: str) -> DataFrame:
    return holdout_predictions(spark, d)["Trend"]


FEATURE_COLUMNS = ["Week_Index", "Sales_Units", *FC.REGRESSORS]


@query("m6_regression_backtest", "Product_ID:s rmse:3 mae:3 mape_pct:3 n:i")
def regression_backtest(spark: SparkSession, d: str) -> DataFrame:
    predicted = FC.regression_backtest(product_week(spark, d, FEATURE_COLUMNS))
    return stats.forecast_metrics(predicted, ["Product_ID"])


EQUATION_TERMS = ["lag_1", "lag_13", "roll_4", "month_sin", "Marketing_Spend", "Inventory"]


@query(
    "m6_normal_equations",
    "Product_ID:s train_weeks:i units:4 " + " ".join(f"x_{c}:2" for c in EQUATION_TERMS),
    f"""WITH f AS (
          SELECT l.*, avg(Sales_Units) OVER (PARTITION BY Product_ID ORDER BY "Date" ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
              AS roll_4, sin(2 * pi() * month("Date") / 12) AS month_sin,
            row_number() OVER (PARTITION BY Product_ID ORDER BY "Date" DESC) AS back, count(*) OVER (PARTITION BY Product_ID) AS n
          FROM ({LAGS_SQL}) AS l
        )
        SELECT Product_ID, count(*) AS train_weeks, avg(f.Sales_Units) AS units,
          {", ".join(f"avg(f.Sales_Units * {c}) AS x_{c}" for c in EQUATION_TERMS)}
        FROM f JOIN (SELECT Product_ID, "Date", Marketing_Spend, Inventory FROM pw) AS r USING (Product_ID, "Date")
        WHERE back > 12 AND n >= 30 GROUP BY 1""",
)
def normal_equations(spark: SparkSession, d: str) -> DataFrame:
    """Means of fitted values, alone and times a feature: least squares leaves
    them as those of the actual values."""
    split = checkpointed(FC.regression_split(product_week(spark, d, FEATURE_COLUMNS)))
    fitted = FC.entity_ols(split, "Product_ID", [*FC.LAG_FEATURES, *FC.REGRESSORS], "Sales_Units", "Week_Index", fitted=True)
    rows = fitted.join(split.select("Product_ID", "Week_Index", *EQUATION_TERMS), ["Product_ID", "Week_Index"])
    products = [F.avg(F.col("pred") * F.col(c)).alias(f"x_{c}") for c in EQUATION_TERMS]
    return rows.groupBy("Product_ID").agg(F.count(F.lit(1)).alias("train_weeks"), F.avg("pred").alias("units"), *products)


@query("m6_honest_backtest", "Product_ID:s Week_Index:i actual:2 pred:3")
def honest_backtest(spark: SparkSession, d: str) -> DataFrame:
    return FC.regression_backtest(product_week(spark, d, FEATURE_COLUMNS), include_current=False)


@query(
    "m6_lag_features",
    "Product_ID:s Date:d lag_1:2 lag_13:2 roll_4:6 roll_13:6 month_sin:6 month_cos:6",
    f"""SELECT l.*, avg(Sales_Units) OVER (PARTITION BY Product_ID ORDER BY "Date" ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
          AS roll_4,
          avg(Sales_Units) OVER (PARTITION BY Product_ID ORDER BY "Date" ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS roll_13,
          sin(2 * pi() * month("Date") / 12) AS month_sin, cos(2 * pi() * month("Date") / 12) AS month_cos
        FROM ({LAGS_SQL}) AS l""",
)
def lag_features(spark: SparkSession, d: str) -> DataFrame:
    return series_features(product_week(spark, d, ["Sales_Units"]))


@query(
    "m7_forecast_metrics",
    "Product_ID:s mse:4 rmse:5 mae:5 mape:6 mape_pct:4 n:i",
    f"""{HOLDOUT_CTES} SELECT Product_ID, avg((y - trend) * (y - trend)) AS mse, sqrt(avg((y - trend) * (y - trend))) AS rmse,
          avg(abs(y - trend)) AS mae, avg(abs((y - trend) / NULLIF(y, 0))) AS mape,
          avg(abs((y - trend) / NULLIF(y, 0))) * 100 AS mape_pct, count(*) AS n
        FROM t GROUP BY 1""",
)
def forecast_metrics(spark: SparkSession, d: str) -> DataFrame:
    return stats.forecast_metrics(holdout_predictions(spark, d)["Trend"], ["Product_ID"])


@query(
    "m8_welch_test",
    "n_a:i n_b:i mean_a:6 mean_b:6 t:6 df:4",
    """WITH g AS (
         SELECT count(value) FILTER (event_type = 'click') AS n_a, count(value) FILTER (event_type = 'view') AS n_b,
           avg(value) FILTER (event_type = 'click') AS mean_a, avg(value) FILTER (event_type = 'view') AS mean_b,
           var_samp(value) FILTER (event_type = 'click') AS var_a, var_samp(value) FILTER (event_type = 'view') AS var_b
         FROM events
       ), v AS (SELECT *, var_a / n_a AS va, var_b / n_b AS vb FROM g)
       SELECT n_a, n_b, mean_a, mean_b, (mean_a - mean_b) / sqrt(va + vb) AS t,
         (va + vb) * (va + vb) / (va * va / (n_a - 1) + vb * vb / (n_b - 1)) AS df FROM v""",
)
def welch_test(spark: SparkSession, d: str) -> DataFrame:
    return stats.welch_test(table(spark, d, "events"), "event_type", "value", "click", "view")


# The two-sided p as 1 less twice the density's integral up to |t|, by Simpson's rule.
WELCH_SQL = """
WITH g AS (
  SELECT count(value) FILTER (event_type = 'click') AS n_a, count(value) FILTER (event_type = 'view') AS n_b,
    avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view') AS diff,
    var_samp(value) FILTER (event_type = 'click') AS var_a, var_samp(value) FILTER (event_type = 'view') AS var_b
  FROM events
), v AS (
  SELECT diff / sqrt(var_a / n_a + var_b / n_b) AS t, pow(var_a / n_a + var_b / n_b, 2)
    / (pow(var_a / n_a, 2) / (n_a - 1) + pow(var_b / n_b, 2) / (n_b - 1)) AS df FROM g
), s AS (
  SELECT t, df, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * abs(t) / 12000
    * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - 0.5 * ln(df * pi()) - (df + 1) / 2 * ln(1 + pow(abs(t) * i / 4000, 2) / df))
    AS area
  FROM v, range(4001) AS r(i)
)
SELECT t, df, 1 - 2 * sum(area) AS p, 1 - 2 * sum(area) < 0.05 AS significant FROM s GROUP BY 1, 2"""


@query("m8_welch_verdict", "t:6 df:4 p:6 significant:b", WELCH_SQL)
def welch_verdict(spark: SparkSession, d: str) -> DataFrame:
    return stats.welch_test(table(spark, d, "events"), "event_type", "value", "click", "view")


def customer_features(spark: SparkSession, d: str) -> DataFrame:
    """Order value and count per customer, with the account balance."""
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("Revenue"), F.count(F.lit(1)).alias("Orders")
    )
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return customer.join(orders, "o_custkey", "left")


def clustered_customers(spark: SparkSession, d: str) -> DataFrame:
    return ml.cluster(customer_features(spark, d), ["Revenue", "Orders", "c_acctbal"])


@query("m9_customer_clusters", "cluster:i customers:i Revenue:2")
def customer_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustered_customers(spark, d).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("customers"), F.avg("Revenue").alias("Revenue")
    )


@query(
    "m9_cluster_check",
    "customers:i clusters:i misplaced:i Revenue:2",
    """SELECT count(DISTINCT c_custkey) AS customers, 3 AS clusters, 0 AS misplaced, sum(o_totalprice) AS Revenue
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey""",
)
def cluster_check(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and sums of the clusters, and customers nearer to another
    cluster's mean than to their own's."""
    rows = checkpointed(clustered_customers(spark, d))
    names = ["Revenue", "Orders", "c_acctbal"]
    zero_filled = [F.avg(F.coalesce(c, F.lit(0.0))).alias(f"{c}_mean") for c in names]
    centres = rows.groupBy("cluster").agg(*zero_filled).withColumnRenamed("cluster", "other")
    places = centres.agg(F.collect_list(F.struct(*centres.columns)).alias("places"))
    listed = rows.withColumn("places", places.scalar())

    def distance(place):
        return sum((place[f"{c}_mean"] - F.coalesce(c, F.lit(0.0))) ** 2 for c in names)

    nearest = F.array_min(F.transform("places", lambda p: F.struct(distance(p).alias("far"), p["other"].alias("other"))))
    return listed.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_distinct("cluster").alias("clusters"),
        F.count_if(nearest["other"] != F.col("cluster")).alias("misplaced"),
        F.sum("Revenue").alias("Revenue"),
    )


PROFIT_FEATURES = ["Downtime_hours", "Marketing_Spend", "Raw_Material_Cost", "Efficiency_u_per_h"]


#: Below the operator's default of 30, with which the fit takes many minutes here.
POOLED_DEPTH = 6


@query("m10_profit_forest", "Product_ID:s mse:4 mae:4 n:i")
def profit_forest(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Profit", *PROFIT_FEATURES])
    return stats.forecast_metrics(ml.forest_regression(fact, "Profit", PROFIT_FEATURES, depth=POOLED_DEPTH), ["Product_ID"], "Profit")


def against_level(model: DataFrame, level: DataFrame) -> DataFrame:
    """Errors of a model beside those of a level, per product; ``better`` tells
    whether the model's error is below the level's over all products."""
    both = model.select("Product_ID", "n", "mse").join(level.select("Product_ID", F.col("mse").alias("level_mse")), "Product_ID")
    pooled = both.agg(F.avg("mse") < F.avg("level_mse")).scalar()
    return both.withColumn("better", pooled)


@query(
    "m10_forest_check",
    "Product_ID:s n:i level_mse:1 better:b",
    "SELECT Product_ID, count(*) AS n, var_pop(Profit) AS level_mse, true AS better FROM pw GROUP BY 1",
)
def forest_check(spark: SparkSession, d: str) -> DataFrame:
    fact = checkpointed(product_week(spark, d, ["Profit", *PROFIT_FEATURES]))
    model = stats.forecast_metrics(ml.forest_regression(fact, "Profit", PROFIT_FEATURES, depth=POOLED_DEPTH), ["Product_ID"], "Profit")
    return against_level(model, fact.groupBy("Product_ID").agg(F.var_pop("Profit").alias("mse")))


def lag_split(spark: SparkSession, d: str) -> DataFrame:
    """Lag features of every product, last 12 weeks flagged."""
    features = series_features(product_week(spark, d, ["Sales_Units"]))
    return add_holdout(features, ["Product_ID"], "Date", 12, 40)


LAG_INPUTS = [f for f in FC.LAG_FEATURES if f != "month"]


def lag_forest_predictions(split: DataFrame) -> DataFrame:
    return ml.series_forest(split, "Product_ID", LAG_INPUTS, "Sales_Units", "Date")


def holdout_level(split: DataFrame) -> DataFrame:
    """Errors of the train mean on the test rows."""
    level = split.where("NOT is_test").groupBy("Product_ID").agg(F.avg("Sales_Units").alias("pred"))
    flat = split.where("is_test").join(level, "Product_ID").withColumnRenamed("Sales_Units", "actual")
    return stats.forecast_metrics(flat, ["Product_ID"])


@query("m11_lag_forest", "Product_ID:s rmse:3 mae:3 mape_pct:3 n:i")
def lag_forest(spark: SparkSession, d: str) -> DataFrame:
    return stats.forecast_metrics(lag_forest_predictions(checkpointed(lag_split(spark, d))), ["Product_ID"])


LEVEL_SQL = """
WITH p AS (
  SELECT Product_ID, Sales_Units AS y, row_number() OVER (PARTITION BY Product_ID ORDER BY "Date" DESC) <= 12 AS is_test,
    count(*) OVER (PARTITION BY Product_ID) AS weeks FROM pw
), f AS (SELECT Product_ID, avg(y) AS level FROM p WHERE NOT is_test GROUP BY 1)
SELECT Product_ID, count(*) AS n, avg((y - level) * (y - level)) AS level_mse, true AS better
FROM p JOIN f USING (Product_ID) WHERE is_test AND weeks >= 40 GROUP BY 1"""


@query("m11_forest_check", "Product_ID:s n:i level_mse:3 better:b", LEVEL_SQL)
def lag_forest_check(spark: SparkSession, d: str) -> DataFrame:
    split = checkpointed(lag_split(spark, d))
    return against_level(stats.forecast_metrics(lag_forest_predictions(split), ["Product_ID"]), holdout_level(split))


@query(
    "m12_standardise_product",
    "Product_ID:s Date:d Sales_Units_std:6 Revenue_std:6",
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY Product_ID ORDER BY "Date" DESC) <= 12 AS is_test FROM pw),
       s AS (SELECT Product_ID, avg(Sales_Units) AS ms, stddev_pop(Sales_Units) AS ss, avg(Revenue) AS mr,
               stddev_pop(Revenue) AS sr FROM p WHERE NOT is_test GROUP BY 1)
       SELECT Product_ID, "Date", (Sales_Units - ms) / coalesce(NULLIF(ss, 0), 1) AS Sales_Units_std,
         (Revenue - mr) / coalesce(NULLIF(sr, 0), 1) AS Revenue_std FROM p LEFT JOIN s USING (Product_ID)""",
)
def standardise_product(spark: SparkSession, d: str) -> DataFrame:
    """The scaler fitted for each product by itself."""
    split = add_holdout(product_week(spark, d, ["Sales_Units", "Revenue"]), ["Product_ID"], "Date", 12)
    return stats.standardise(split, ["Sales_Units", "Revenue"], ~F.col("is_test"), ["Product_ID"])


@query(
    "m12_standardise",
    "Product_ID:s Date:d Sales_Units_std:6 Revenue_std:6",
    """WITH p AS (SELECT *, row_number() OVER (PARTITION BY Product_ID ORDER BY "Date" DESC) <= 12 AS is_test FROM pw),
       s AS (SELECT avg(Sales_Units) AS ms, stddev_pop(Sales_Units) AS ss, avg(Revenue) AS mr, stddev_pop(Revenue) AS sr
             FROM p WHERE NOT is_test)
       SELECT Product_ID, "Date", (Sales_Units - ms) / ss AS Sales_Units_std, (Revenue - mr) / sr AS Revenue_std FROM p, s""",
)
def standardise(spark: SparkSession, d: str) -> DataFrame:
    split = add_holdout(product_week(spark, d, ["Sales_Units", "Revenue"]), ["Product_ID"], "Date", 12)
    return stats.standardise(split, ["Sales_Units", "Revenue"], ~F.col("is_test"))


def with_folds(split: DataFrame) -> DataFrame:
    """Expanding folds over the train rows; test rows have none."""
    folded = FC.add_cv_folds(split, ["Product_ID", "is_test"], "Date", 4)
    return folded.withColumn("fold", F.when(~F.col("is_test"), F.col("fold")))


def folded_split(spark: SparkSession, d: str) -> DataFrame:
    return with_folds(lag_split(spark, d))


@query("m13_boosted_search", "depth:i trees:i rate:2 mse:4")
def boosted_search(spark: SparkSession, d: str) -> DataFrame:
    """Error of every setting over all folds, in units of a product's deviation."""
    train = checkpointed(folded_split(spark, d).where("NOT is_test"))
    found = ml.boosted_search(train, "Product_ID", LAG_INPUTS, "Sales_Units", "Date")
    return spark.createDataFrame(found, "mse double, depth int, trees int, rate double")  # a row per setting


@query(
    "m13_search_check",
    "Product_ID:s settings:i folds:i level_mse:3 better:b",
    """WITH p AS (
         SELECT Product_ID, "Date", Sales_Units AS y, row_number() OVER (PARTITION BY Product_ID ORDER BY "Date") - 1 AS pos,
           count(*) OVER (PARTITION BY Product_ID) - 12 AS n FROM pw
       ), t AS (
         SELECT *, CASE WHEN pos >= n - 4 * (n // 5) THEN (pos - (n - 4 * (n // 5))) // (n // 5) END AS fold
         FROM p WHERE pos < n AND n >= 28
       ), e AS (
         SELECT a.Product_ID, f AS fold, avg((a.y - m.level) * (a.y - m.level)) AS mse
         FROM t AS a JOIN (
           SELECT Product_ID, f, avg(y) AS level FROM t, range(4) AS r(f) WHERE fold IS NULL OR fold < f GROUP BY 1, 2
         ) AS m ON a.Product_ID = m.Product_ID AND a.fold = m.f GROUP BY 1, 2
       )
       SELECT Product_ID, 8 AS settings, count(*) AS folds, avg(mse) AS level_mse, true AS better FROM e GROUP BY 1""",
)
def search_check(spark: SparkSession, d: str) -> DataFrame:
    """Settings and folds of the search, and the error of a fold's train mean."""
    train = checkpointed(folded_split(spark, d).where("NOT is_test"))
    found = ml.boosted_errors(train, "Product_ID", LAG_INPUTS, "Sales_Units", "Date")
    settings = found.groupBy("Product_ID", "depth", "trees", "rate").agg(F.count(F.lit(1)).alias("folds"), F.avg("mse").alias("mse"))
    best = settings.groupBy("Product_ID").agg(
        F.count(F.lit(1)).alias("settings"), F.max("folds").alias("folds"), F.min("mse").alias("mse"), F.lit(12).alias("n")
    )
    sums = train.withColumn("fold", F.coalesce("fold", F.lit(-1))).groupBy("Product_ID", "fold").agg(
        F.sum("Sales_Units").alias("s"), F.sum(F.col("Sales_Units") * F.col("Sales_Units")).alias("q"), F.count(F.lit(1)).alias("c")
    )
    earlier = Window.partitionBy("Product_ID").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    level = F.sum("s").over(earlier) / F.sum("c").over(earlier)
    errors = sums.withColumn("level", level).where("fold >= 0").withColumn(
        "e", (F.col("q") - 2 * F.col("level") * F.col("s") + F.col("c") * F.col("level") * F.col("level")) / F.col("c")
    )
    flat = errors.groupBy("Product_ID").agg(F.avg("e").alias("mse"))
    return against_level(best, flat).join(best.select("Product_ID", "settings", "folds"), "Product_ID")


@query("m13_boosted_backtest", "Product_ID:s rmse:3 mae:3 mape_pct:3 n:i")
def boosted_backtest(spark: SparkSession, d: str) -> DataFrame:
    split = checkpointed(folded_split(spark, d))
    return stats.forecast_metrics(ml.boosted_series(split, "Product_ID", LAG_INPUTS, "Sales_Units", "Date"), ["Product_ID"])


@query(
    "m14_expanding_folds",
    "Product_ID:s Date:d fold:i",
    """WITH p AS (
         SELECT Product_ID, "Date", row_number() OVER (PARTITION BY Product_ID ORDER BY "Date") - 1 AS pos,
           count(*) OVER (PARTITION BY Product_ID) AS n, count(*) OVER (PARTITION BY Product_ID) // 5 AS size
         FROM pw
       )
       SELECT Product_ID, "Date", CASE WHEN size > 0 AND pos >= n - 4 * size THEN (pos - (n - 4 * size)) // size END AS fold
       FROM p""",
)
def expanding_folds(spark: SparkSession, d: str) -> DataFrame:
    return FC.add_cv_folds(product_week(spark, d, []), ["Product_ID"], "Date", 4)


FOLDS_SQL = """WITH p AS (
         SELECT Product_ID, Sales_Units AS y, CAST(Week_Index AS DOUBLE) AS x1, Price_per_Unit AS x2,
           row_number() OVER (PARTITION BY Product_ID ORDER BY "Date") - 1 AS pos,
           count(*) OVER (PARTITION BY Product_ID) AS n, count(*) OVER (PARTITION BY Product_ID) // 5 AS size
         FROM pw
       ), t AS (SELECT *, CASE WHEN size > 0 AND pos >= n - 4 * size THEN (pos - (n - 4 * size)) // size ELSE -1 END AS fold FROM p),
       g AS (SELECT b.Product_ID, r.f, b.* EXCLUDE (Product_ID) FROM t AS b JOIN range(4) AS r(f) ON b.fold < r.f)"""


@query(
    "m14_fold_errors",
    "Product_ID:s fold:i train:i n:i mse:4",
    f"""{FOLDS_SQL}, s AS (
         SELECT Product_ID, f, count(*) AS train, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM g GROUP BY 1, 2
       )
       SELECT t.Product_ID, t.fold, any_value(train) AS train, count(*) AS n, avg((y - a - b * x1) * (y - a - b * x1)) AS mse
       FROM t JOIN s ON t.Product_ID = s.Product_ID AND t.fold = s.f GROUP BY 1, 2""",
)
def fold_errors(spark: SparkSession, d: str) -> DataFrame:
    """Error of the straight line on each expanding fold."""
    return GR.fold_errors(price_folds(spark, d), "Product_ID", ["Week_Index"], "Sales_Units")


@query(
    "m14_fold_errors_two",
    "Product_ID:s fold:i train:i n:i mse:4",
    f"""{FOLDS_SQL}, s AS (
         SELECT Product_ID, f, count(*) AS train, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s11, var_pop(x2) AS s22,
           covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM g GROUP BY 1, 2
       ), w AS (
         SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s
       ), e AS (
         SELECT t.Product_ID, t.fold, train, y - my - b1 * (x1 - m1) - b2 * (x2 - m2) AS e
         FROM t JOIN w ON t.Product_ID = w.Product_ID AND t.fold = w.f
       )
       SELECT Product_ID, fold, any_value(train) AS train, count(*) AS n, avg(e * e) AS mse FROM e GROUP BY 1, 2""",
)
def fold_errors_two(spark: SparkSession, d: str) -> DataFrame:
    """The same with trend and price."""
    return GR.fold_errors(price_folds(spark, d), "Product_ID", ["Week_Index", "Price_per_Unit"], "Sales_Units")


def price_folds(spark: SparkSession, d: str) -> DataFrame:
    return FC.add_cv_folds(product_week(spark, d, ["Week_Index", "Price_per_Unit", "Sales_Units"]), ["Product_ID"], "Date", 4)


# Features of the published anomaly search.
ANOMALY_FEATURES = ["Sales_Units", "Revenue", "Profit", "Defect_Rate", "Downtime_hours", "Efficiency_u_per_h"]


def flagged_weeks(spark: SparkSession, d: str) -> DataFrame:
    fact = checkpointed(product_week(spark, d, ANOMALY_FEATURES))
    return IsolationForest(ANOMALY_FEATURES, ["Product_ID", "Date"]).fit(fact).flag(fact)


@query("m15_isolation_forest", "Product_ID:s Date:d anomaly_score:6 is_anomaly:b")
def isolation_forest(spark: SparkSession, d: str) -> DataFrame:
    return flagged_weeks(spark, d)


@query(
    "m15_flag_summary",
    "flagged:i weeks:i " + " ".join(f"{c}:3" for c in ANOMALY_FEATURES),
    f"""SELECT CAST(ceil(0.01 * (count(*) - 1)) AS BIGINT) AS flagged, count(*) AS weeks,
          {", ".join(f"sum(coalesce({c}, 0)) AS {c}" for c in ANOMALY_FEATURES)} FROM pw""",
)
def flag_summary(spark: SparkSession, d: str) -> DataFrame:
    """Flagged weeks, and the zero-filled features that the scores come from."""
    sums = [F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in ANOMALY_FEATURES]
    flagged = flagged_weeks(spark, d)
    return flagged.agg(F.count_if("is_anomaly").alias("flagged"), F.count(F.lit(1)).alias("weeks"), *sums)


@query("p4_anomaly_filter", "Product_ID:s Date:d Revenue:4 anomaly_score:6")
def anomaly_filter(spark: SparkSession, d: str) -> DataFrame:
    return flagged_weeks(spark, d).where("is_anomaly")


@query("a35_anomalous_weeks", "Date:d Revenue:4")
def anomalous_weeks(spark: SparkSession, d: str) -> DataFrame:
    return rollup(flagged_weeks(spark, d).where("is_anomaly"), ["Date"], {"Revenue": "sum"})


@query(
    "a35_split_weeks",
    "Date:d products:i Revenue:4",
    'SELECT "Date", count(*) AS products, sum(Revenue) AS Revenue FROM pw GROUP BY 1',
)
def split_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Revenue of the flagged and of the other products, added up by week: the
    flag splits every week's rows without loss."""
    flagged = checkpointed(flagged_weeks(spark, d)).withColumn("rows", F.lit(1))
    measures = {"Revenue": "sum", "rows": "sum"}
    halves = [rollup(flagged.where(F.col("is_anomaly") == side), ["Date"], measures) for side in (True, False)]
    return rollup(halves[0].unionByName(halves[1]), ["Date"], measures).withColumnRenamed("rows", "products")


@query("m16_additive_backtest", "Product_ID:s Week_Index:i actual:2 pred:3")
def additive_backtest(spark: SparkSession, d: str) -> DataFrame:
    fact = product_week(spark, d, ["Week_Index", "Sales_Units", "On_Promo", "Marketing_Spend"])
    return FC.additive_backtest(fact)


@query(
    "m16_fit_check",
    "Product_ID:s train_weeks:i units:4",
    """WITH p AS (
         SELECT Product_ID, Sales_Units, row_number() OVER (PARTITION BY Product_ID ORDER BY "Date" DESC) AS back,
           count(*) OVER (PARTITION BY Product_ID) AS n FROM pw
       )
       SELECT Product_ID, count(*) AS train_weeks, avg(Sales_Units) AS units FROM p WHERE back > 12 AND n >= 40 GROUP BY 1""",
)
def additive_fit(spark: SparkSession, d: str) -> DataFrame:
    """The intercept is not penalised, so fitted values average to the actual ones."""
    split, features = FC.additive_split(product_week(spark, d, ["Week_Index", "Sales_Units", "On_Promo", "Marketing_Spend"]))
    fitted = FC.entity_ols(split, "Product_ID", features, "Sales_Units", "Week_Index", 1e-3, fitted=True)
    return fitted.groupBy("Product_ID").agg(F.count(F.lit(1)).alias("train_weeks"), F.avg("pred").alias("units"))


@query("m16_changepoint_backtest", "Product_ID:s Week_Index:i actual:2 pred:3")
def changepoint_backtest(spark: SparkSession, d: str) -> DataFrame:
    """The additive model with a trend that may change its slope."""
    return FC.changepoint_backtest(product_week(spark, d, ["Week_Index", "Sales_Units", "On_Promo", "Marketing_Spend"]))


@query(
    "m16_changepoint_rows",
    "Product_ID:s Week_Index:i actual:2 places:b",
    """WITH p AS (
         SELECT Product_ID, Week_Index, Sales_Units, row_number() OVER (PARTITION BY Product_ID ORDER BY "Date" DESC) AS back,
           count(*) OVER (PARTITION BY Product_ID) AS n FROM pw
       )
       SELECT Product_ID, Week_Index, Sales_Units AS actual, true AS places FROM p WHERE back <= 12 AND n >= 40""",
)
def changepoint_rows(spark: SparkSession, d: str) -> DataFrame:
    """The held-out weeks, and whether every change found lies before them."""
    fact = checkpointed(product_week(spark, d, ["Week_Index", "Sales_Units", "On_Promo", "Marketing_Spend"]))
    last = FC.trend_changes(fact).groupBy("Product_ID").agg(F.max("Week_Index").alias("_last"))
    rows = FC.changepoint_backtest(fact).join(last, "Product_ID", "left")
    sound = (F.coalesce("_last", F.lit(-1)) < F.col("Week_Index")) & (F.abs("pred") < float("inf"))
    return rows.withColumn("places", sound)


def resampled_sales(spark: SparkSession, d: str) -> DataFrame:
    lines = order_lines(spark, d, ["Product_ID", "Date", "Sales_Units"])
    return resample_weekly(lines, ["Product_ID"], "Date", "Sales_Units")


@query("m17_seasonal_arima", "Product_ID:s Week_End:d actual:2 pred:3 error:s")
def seasonal_arima(spark: SparkSession, d: str) -> DataFrame:
    return FC.sarima_backtest(resampled_sales(spark, d), "Product_ID", "Week_End", "Sales_Units")


@query(
    "m17_forecast_rows",
    "Product_ID:s Week_End:d actual:2 predicted:b",
    f"""SELECT Product_ID, Week_End, Sales_Units AS actual, true AS predicted FROM ({RESAMPLE_SQL}) AS r
        QUALIFY row_number() OVER (PARTITION BY Product_ID ORDER BY Week_End DESC) <= 12
          AND count(*) OVER (PARTITION BY Product_ID) >= 60""",
)
def arima_rows(spark: SparkSession, d: str) -> DataFrame:
    """The held-out weeks, and whether each has a finite forecast and no error."""
    found = FC.sarima_backtest(resampled_sales(spark, d), "Product_ID", "Week_End", "Sales_Units")
    sound = F.col("error").isNull() & F.col("pred").isNotNull() & (F.abs("pred") < float("inf"))
    return found.withColumn("predicted", sound)


@query(
    "m17_seasonal_differences",
    "Product_ID:s Week_End:d diff:2",
    f"""SELECT *, Sales_Units - lag(Sales_Units, 1) OVER w - lag(Sales_Units, 12) OVER w + lag(Sales_Units, 13) OVER w AS diff
        FROM ({RESAMPLE_SQL}) AS r WINDOW w AS (PARTITION BY Product_ID ORDER BY Week_End)""",
)
def seasonal_differences(spark: SparkSession, d: str) -> DataFrame:
    return FC.seasonal_differences(resampled_sales(spark, d), ["Product_ID"], "Week_End", "Sales_Units")


@query(
    "m18_model_comparison",
    "Product_ID:s Trend_mse:4 Trend_mape:6 Mean_mse:4 Mean_mape:6",
    f"""{HOLDOUT_CTES} SELECT Product_ID, avg((y - trend) * (y - trend)) AS Trend_mse,
          avg(abs((y - trend) / NULLIF(y, 0))) AS Trend_mape, avg((y - level) * (y - level)) AS Mean_mse,
          avg(abs((y - level) / NULLIF(y, 0))) AS Mean_mape
        FROM t GROUP BY 1""",
)
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    long = stats.forecast_metrics(stack_models(holdout_predictions(spark, d)), ["Product_ID", "Model"])
    return compare_models(long, "Product_ID", ["Trend", "Mean"], ["mse", "mape"])


SUMMARY_MODELS = ("Mean", "LinearTrend", "LinearRegression", "Additive", "SARIMA", "RandomForest", "Boosted")


def summary_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Hold-out predictions of all forecast models for the top three products.

    All models get the same series, weeks without sales included as 0, and hold
    out the same last 12 weeks of it.
    """
    fact = checkpointed(product_week(spark, d, ["Revenue", *FEATURE_COLUMNS]))
    totals = rollup(fact, ["Product_ID"], {"Revenue": "sum"})
    known = keep_top(fact, totals, "Product_ID", "Revenue", 3).drop("Week_Index")
    filled = fill_weeks(known, ["Product_ID"], "Date", ["Revenue", "Sales_Units", "Marketing_Spend"])
    top = checkpointed(filled.withColumn("Week_Index", week_index("Date", FIRST_WEEK)))
    position = add_holdout(add_position(top, ["Product_ID"], "Date"), ["Product_ID"], "Date", 12, 50)
    trend = stats.trend_backtest(position, "Product_ID", "position", "Sales_Units")
    mean = F.avg(F.when(~F.col("is_test"), F.col("Sales_Units"))).over(Window.partitionBy("Product_ID"))
    split = checkpointed(with_folds(add_holdout(series_features(top), ["Product_ID"], "Date", 12, 40)))
    predictions = {
        "Mean": position.withColumn("pred", mean).where("is_test").withColumnRenamed("Sales_Units", "actual"),
        "LinearTrend": trend.withColumnRenamed("Sales_Units", "actual"),
        "LinearRegression": FC.regression_backtest(top),
        "Additive": FC.additive_backtest(top),
        "SARIMA": FC.sarima_backtest(top, "Product_ID", "Date", "Sales_Units"),
        "RandomForest": lag_forest_predictions(split),
        "Boosted": ml.boosted_series(split, "Product_ID", LAG_INPUTS, "Sales_Units", "Date"),
    }
    return stack_models({name: t.select("Product_ID", "actual", "pred") for name, t in predictions.items()})


@query("m18_wide_comparison", "Product_ID:s " + " ".join(f"{m}_mse:3 {m}_mape:4" for m in SUMMARY_MODELS))
def wide_comparison(spark: SparkSession, d: str) -> DataFrame:
    """One row per top product, errors of every model side by side."""
    long = stats.forecast_metrics(summary_predictions(spark, d), ["Product_ID", "Model"])
    return compare_models(long, "Product_ID", SUMMARY_MODELS, ["mse", "mape"])


@query("m18_forecast_summary", "Product_ID:s Model:s rmse:3 mae:3 mape_pct:3")
def forecast_summary(spark: SparkSession, d: str) -> DataFrame:
    """Errors of all forecast models for the top three products, one row each."""
    return stats.forecast_metrics(summary_predictions(spark, d), ["Product_ID", "Model"])


@query(
    "m18_summary_rows",
    "Product_ID:s Model:s n:i actual:4 level_mse:3",
    f"""WITH top AS (SELECT Product_ID FROM pw GROUP BY 1 ORDER BY sum(Revenue) DESC, 1 LIMIT 3), p AS (
         SELECT Product_ID, Sales_Units AS y, row_number() OVER (PARTITION BY Product_ID ORDER BY Week_End DESC) AS back
         FROM ({RESAMPLE_SQL}) AS r WHERE Product_ID IN (SELECT Product_ID FROM top)
       ), s AS (SELECT Product_ID, avg(y) AS level FROM p WHERE back > 12 GROUP BY 1)
       SELECT Product_ID, Model, count(*) AS n, avg(y) AS actual,
         CASE WHEN Model = 'Mean' THEN avg((y - level) * (y - level)) END AS level_mse
       FROM p JOIN s USING (Product_ID), (VALUES {", ".join(f"('{m}')" for m in SUMMARY_MODELS)}) AS m(Model)
       WHERE back <= 12 GROUP BY 1, 2""",
)
def summary_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that every model of the summary is measured on, and the error of the
    train mean on them."""
    rows = summary_predictions(spark, d).where("pred IS NOT NULL")
    found = stats.forecast_metrics(rows, ["Product_ID", "Model"]).select("Product_ID", "Model", "mse")
    level_mse = F.when(F.col("Model") == "Mean", F.col("mse")).alias("level_mse")
    means = rows.groupBy("Product_ID", "Model").agg(F.count(F.lit(1)).alias("n"), F.avg("actual").alias("actual"))
    return means.join(found, ["Product_ID", "Model"]).select("Product_ID", "Model", "n", "actual", level_mse)
