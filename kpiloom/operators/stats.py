"""Descriptive statistics, correlation, group tests and closed-form regressions.

Everything except the quantiles is one aggregate over algebraic moments.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.operators.quantiles import exact_quantiles, known

QUARTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, columns: Sequence[str], method: str = "exact", accuracy: int = 1000) -> DataFrame:
    """count, mean, std, min, quartiles and max of the known values: one row per
    metric. NaN counts as missing, as null does.

    ``method="approximate"`` takes the quartiles from a sketch in the same pass
    as the moments; the exact ones need a few more passes, all columns in each.
    """
    names = [f"p{round(p * 100)}" for p in QUARTILES]

    def profile(c: str) -> Column:
        v = known(c)
        parts = [
            F.lit(c).alias("metric"),
            F.count(v).alias("count"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
        ]
        if method == "approximate":
            sketch = F.percentile_approx(v, list(QUARTILES), accuracy)
            parts += [sketch[i].alias(name) for i, name in enumerate(names)]
        return F.struct(*parts).alias(c)

    moments = df.agg(*[profile(c) for c in columns]).select(F.inline(F.array(*columns)))
    if method != "approximate":
        quantiles = exact_quantiles(df, columns, QUARTILES)
        wide = quantiles.groupBy("metric").agg(
            *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in zip(QUARTILES, names, strict=True)]
        )
        moments = moments.join(F.broadcast(wide), "metric", "left")
    return moments.select("metric", "count", "mean", "std", "min", *names, "max")


def guarded_corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over complete pairs; null on a constant side."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    pair = a.isNotNull() & b.isNotNull()
    spread = F.stddev_samp(F.when(pair, a)) * F.stddev_samp(F.when(pair, b))
    return F.try_divide(F.covar_samp(a, b), spread)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairs as rows (x, y, corr), both triangles and the diagonal.

    The k(k-1)/2 coefficients come from one aggregate over one scan.
    """
    pairs = list(combinations(columns, 2))
    stats = df.agg(
        *[guarded_corr(x, y).alias(f"{x}|{y}") for x, y in pairs],
        *[F.stddev_samp(c).alias(f"{c}|{c}") for c in columns],
    )
    cells = []
    for x, y in pairs:
        value = F.col(f"`{x}|{y}`")
        cells += [(x, y, value), (y, x, value)]
    cells += [(c, c, F.when(F.col(f"`{c}|{c}`") > 0, F.lit(1.0))) for c in columns]
    return stats.select(
        F.inline(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), v.alias("corr")) for x, y, v in cells]))
    )


def correlation_by_group(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    return df.dropna(subset=[key]).groupBy(key).agg(guarded_corr(a, b).alias("corr"), F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Counts of equal bins over [min, max], empty ones included; a value on an
    inner edge belongs to the bin above it, the top edge to the last bin.

    The edges are computed once, and a value is placed by comparing it with
    them, so that a bin holds exactly the values between the edges shown. When
    all values are equal, the range is half a unit to either side of them.
    """
    v = F.col(column)
    finite = df.select(v.cast("double").alias("v")).where(v.isNotNull() & (F.abs(v) != float("inf")) & ~F.isnan(v))
    row = finite.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if row["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin long, low double, high double, n long")
    lo, hi = (row["lo"], row["hi"]) if row["lo"] < row["hi"] else (row["lo"] - 0.5, row["hi"] + 0.5)
    width = (hi - lo) / bins
    edges = [lo + i * width for i in range(bins)] + [hi]
    guess = F.floor((F.col("v") - lo) / width).cast("int")
    near = F.greatest(F.lit(0), F.least(guess, F.lit(bins - 1)))
    table = F.array(*[F.lit(e) for e in edges])
    placed = (
        F.when(F.col("v") < table[near], near - 1)
        .when((near < bins - 1) & (F.col("v") >= table[near + 1]), near + 1)
        .otherwise(near)
    )
    counted = finite.groupBy(placed.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    listed = df.sparkSession.createDataFrame(
        [(i, edges[i], edges[i + 1]) for i in range(bins)], "bin long, low double, high double"
    )
    return listed.join(counted, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def simple_regression(df: DataFrame, y: str, x: str, keys: Sequence[str] = (), min_rows: int = 0) -> DataFrame:
    """Slope, intercept, R2 and row count, overall or per group."""
    fit = df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("n"),
    )
    return fit.where(F.col("n") >= min_rows) if min_rows else fit


def trend_forecast(
    weekly: DataFrame, key: str, week: str = "Week_Index", value: str = "Sales_Units", horizon: int = 12, min_rows: int = 10
) -> DataFrame:
    """Linear trend per entity, continued ``horizon`` weeks: one aggregate for all entities."""
    fit = weekly.groupBy(key).agg(
        F.regr_slope(value, week).alias("slope"),
        F.regr_intercept(value, week).alias("intercept"),
        F.regr_r2(value, week).alias("r2"),
        F.count(F.lit(1)).alias("n"),
        F.max(week).alias("last"),
    )
    ahead = fit.where(F.col("n") >= min_rows).withColumn(
        week, F.explode(F.sequence(F.col("last") + 1, F.col("last") + horizon))
    )
    return ahead.select(key, week, (F.col("intercept") + F.col("slope") * F.col(week)).alias("pred"), "r2", "n")


def trend_backtest(split: DataFrame, key: str, position: str, value: str, is_test: str = "is_test") -> DataFrame:
    """Trend fitted on the train rows, evaluated on the test rows."""
    fit = split.where(~F.col(is_test)).groupBy(key).agg(
        F.regr_slope(value, position).alias("slope"), F.regr_intercept(value, position).alias("intercept")
    )
    return split.where(F.col(is_test)).join(fit, key).withColumn(
        "pred", F.col("intercept") + F.col("slope") * F.col(position)
    ).drop("slope", "intercept")


def ols(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Multiple regression: one row per term.

    One aggregate takes the means and all pairwise covariances of the complete
    rows, in generated code and combined on the map side; the driver solves a
    system whose size is the number of features.
    """
    names = [*features, target]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = (
        df.dropna(subset=names)
        .agg(*[F.avg(c) for c in names], *[F.covar_samp(names[i], names[j]) for i, j in pairs])
        .first()
    )
    means, spread = np.array(row[: len(names)], float), np.zeros((len(names), len(names)))
    for (i, j), value in zip(pairs, row[len(names) :], strict=True):
        spread[i, j] = spread[j, i] = np.nan if value is None else value
    if np.isnan(spread).any():
        raise ValueError("a regression needs at least two complete rows")
    weights = np.linalg.lstsq(spread[:-1, :-1], spread[:-1, -1], rcond=None)[0]
    terms = [("intercept", float(means[-1] - means[:-1] @ weights))]
    terms += [(f, float(w)) for f, w in zip(features, weights, strict=True)]
    return df.sparkSession.createDataFrame(terms, "term string, coefficient double")


def forecast_metrics(df: DataFrame, keys: Sequence[str], actual: str = "actual", pred: str = "pred") -> DataFrame:
    """MSE, RMSE, MAE, MAPE as a fraction and in percent (over non-zero actuals)."""
    error = F.col(actual) - F.col(pred)
    relative = F.abs(F.try_divide(error, F.col(actual)))
    return df.groupBy(*keys).agg(
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(relative).alias("mape"),
        (F.avg(relative) * 100).alias("mape_pct"),
        F.count(F.lit(1)).alias("n"),
    )


def welch_test(df: DataFrame, group: str, value: str, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """Welch's t, degrees of freedom, two-sided p and verdict; nulls are omitted."""
    stats = df.where(F.col(group).isin(a, b)).agg(
        *[
            f(F.when(F.col(group) == g, F.col(value))).alias(f"{name}_{side}")
            for side, g in (("a", a), ("b", b))
            for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
        ]
    )
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    out = stats.withColumns(
        {
            "t": F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(va + vb)),
            "df": F.try_divide(
                (va + vb) * (va + vb),
                va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1),
            ),
        }
    )
    p_value = F.pandas_udf(_two_sided_p, "double")
    return out.withColumn("p", p_value("t", "df")).withColumn("significant", F.col("p") < alpha)


def _two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_t_p(x, v) for x, v in zip(t, df, strict=True)])


def student_t_p(t: float, df: float) -> float:
    """P(|T| > |t|) through the regularised incomplete beta function."""
    if t is None or df is None or math.isnan(t) or math.isnan(df):
        return float("nan")
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b) by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    # Modified Lentz evaluation: terms alternate between the even and odd coefficients.
    tiny, value, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            coefficient = 1.0
        elif i % 2 == 0:
            coefficient = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            coefficient = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + coefficient * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + coefficient / (c if abs(c) > tiny else tiny)
        value *= c * d
        if i and abs(1.0 - c * d) < 1e-15:
            break
    return math.exp(log_front) / a * (value - 1.0)


def standardise(
    df: DataFrame, columns: Mapping[str, str] | Sequence[str], train: Column, keys: Sequence[str] = ()
) -> DataFrame:
    """Centre and scale by the train rows' mean and population deviation, per
    group of ``keys`` or, without keys, pooled over all rows.

    A constant column is only centred; a group without train rows gives null. Returns ``{column}_std`` (or the mapped names) next to the inputs.
    """
    names = dict(columns) if isinstance(columns, Mapping) else {c: f"{c}_std" for c in columns}
    fits = [F.avg(c).alias(f"_m_{c}") for c in names]
    fits += [F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"_s_{c}") for c in names]
    if keys:
        fitted = df.where(train).groupBy(*keys).agg(*fits)
        joined = df.join(fitted, list(keys), "left")
        scaled = {new: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c, new in names.items()}
        return joined.withColumns(scaled).drop(*[f"_{x}_{c}" for c in names for x in "ms"])
    pooled = df.where(train).agg(F.struct(*fits)).scalar()
    return df.withColumns(
        {new: (F.col(c) - pooled.getField(f"_m_{c}")) / pooled.getField(f"_s_{c}") for c, new in names.items()}
    )
