"""Per-entity forecasts that built-in aggregates cannot express.

Features and differences are Spark expressions; the grouped Arrow functions
only solve one small system per entity. A group is one entity's weekly series,
so its size is bounded by the calendar and not by the raw rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kpiloom.operators.growth import add_holdout, add_position, series, series_features
from kpiloom.operators.rollup import regrid_weekly

# Regressors, weekly aggregates and lag features of the published backtests.
REGRESSORS = ("On_Promo", "Marketing_Spend", "Price_per_Unit", "Inventory", "Lead_Time_days")
REGRID = {
    "Sales_Units": "sum",
    "On_Promo": "max",
    "Marketing_Spend": "sum",
    "Price_per_Unit": "mean",
    "Inventory": "mean",
    "Lead_Time_days": "mean",
}
LAG_FEATURES = ("lag_1", "lag_2", "lag_3", "lag_4", "lag_13", "roll_4", "roll_13", "month", "month_sin", "month_cos")
SEASON_WEEKS = 365.25 / 7


def weekly_features(
    fact: DataFrame, key: str = "Product_ID", week: str = "Week_Index", date: str = "Date", include_current: bool = True
) -> DataFrame:
    """Weekly regrid, lag features and regressors (0 when missing)."""
    weekly = regrid_weekly(fact, [key, week, date], REGRID)
    known = [c for c in REGRESSORS if c in weekly.columns]
    weekly = weekly.withColumns({c: F.col(c).cast("double") for c in known}).fillna(0.0, subset=known or None)
    weekly = weekly.withColumns({c: F.lit(0.0) for c in REGRESSORS if c not in known})
    return series_features(weekly, [key], date, "Sales_Units", include_current=include_current)


def entity_ols(
    split: DataFrame,
    key: str,
    features: Sequence[str],
    target: str,
    order: str,
    ridge: float = 0.0,
    is_test: str = "is_test",
    fitted: bool = False,
) -> DataFrame:
    """Least squares per entity on its train rows, evaluated on its test rows,
    or with ``fitted`` on its train rows."""
    features = list(features)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        test = pdf[is_test].to_numpy(bool)
        x, y = pdf[features].to_numpy(float), pdf[target].to_numpy(float)
        centre, level = x[~test].mean(axis=0), y[~test].mean()
        a, b = x[~test] - centre, y[~test] - level
        if ridge:
            a = np.vstack([a, math.sqrt(ridge) * np.eye(a.shape[1])])
            b = np.concatenate([b, np.zeros(a.shape[1])])
        weights = np.linalg.lstsq(a, b, rcond=None)[0]
        shown = ~test if fitted else test
        out = pdf.loc[shown, [key, order]].copy()
        out["actual"] = y[shown]
        out["pred"] = (x[shown] - centre) @ weights + level
        return out

    types = dict(split.dtypes)
    schema = f"{key} {types[key]}, {order} {types[order]}, actual double, pred double"
    needed = split.select(key, order, target, is_test, *features)
    return needed.groupBy(key).applyInPandas(fit, schema)


def regression_split(
    fact: DataFrame, key: str = "Product_ID", horizon: int = 12, min_rows: int = 30, include_current: bool = True
) -> DataFrame:
    """Features of the 15-feature regression, last ``horizon`` weeks flagged."""
    features = weekly_features(fact, key, include_current=include_current)
    return add_holdout(features, [key], "Date", horizon, min_rows)


def regression_backtest(
    fact: DataFrame, key: str = "Product_ID", horizon: int = 12, min_rows: int = 30, include_current: bool = True
) -> DataFrame:
    """15-feature regression per entity, last ``horizon`` weeks held out."""
    split = regression_split(fact, key, horizon, min_rows, include_current)
    return entity_ols(split, key, [*LAG_FEATURES, *REGRESSORS], "Sales_Units", "Week_Index")


def additive_split(
    fact: DataFrame, key: str = "Product_ID", horizon: int = 12, min_rows: int = 40, order: int = 10
) -> tuple[DataFrame, list[str]]:
    """Linear trend, yearly Fourier terms and regressors with a hold-out, and the
    names of these features. Spend is scaled by its largest value in the train
    rows."""
    weekly = regrid_weekly(fact, [key, "Week_Index", "Date"], REGRID)
    angle = F.col("Week_Index") * (2 * math.pi / SEASON_WEEKS)
    waves = {f"{name}_{i}": f(angle * i) for i in range(1, order + 1) for name, f in (("sin", F.sin), ("cos", F.cos))}
    spend = F.coalesce(F.col("Marketing_Spend"), F.lit(0.0))
    data = weekly.withColumns(
        {
            **waves,
            "trend": F.col("Week_Index") / 100.0,
            "promo": F.coalesce(F.col("On_Promo").cast("double"), F.lit(0.0)),
        }
    )
    split = add_holdout(data, [key], "Date", horizon, min_rows)
    largest = F.max(F.when(~F.col("is_test"), spend)).over(W.partitionBy(key))
    split = split.withColumn("spend", F.coalesce(F.try_divide(spend, largest), F.lit(0.0)))
    return split, ["trend", *waves, "promo", "spend"]


def additive_backtest(
    fact: DataFrame, key: str = "Product_ID", horizon: int = 12, min_rows: int = 40, order: int = 10, ridge: float = 1e-3
) -> DataFrame:
    """Ridge regression per entity on the features of ``additive_split``."""
    split, features = additive_split(fact, key, horizon, min_rows, order)
    return entity_ols(split, key, features, "Sales_Units", "Week_Index", ridge)


def changepoint_backtest(
    fact: DataFrame, key: str = "Product_ID", horizon: int = 12, min_rows: int = 40, order: int = 10, changes: int = 25, prior: float = 0.05
) -> DataFrame:
    """``additive_backtest`` with a trend that may change its slope, a row per
    held-out week; ``trend_changes`` gives the changes found."""
    return _changepoints(fact, key, horizon, min_rows, order, changes, prior).where("part = 'test'").select(key, "Week_Index", "actual", "pred")


def trend_changes(
    fact: DataFrame, key: str = "Product_ID", horizon: int = 12, min_rows: int = 40, order: int = 10, changes: int = 25, prior: float = 0.05
) -> DataFrame:
    """Weeks at which the trend's slope changes, and by how many units a week."""
    found = _changepoints(fact, key, horizon, min_rows, order, changes, prior).where("part = 'change'")
    return found.select(key, "Week_Index", F.col("pred").alias("slope_change"))


def _changepoints(fact: DataFrame, key: str, horizon: int, min_rows: int, order: int, changes: int, prior: float) -> DataFrame:
    """Both results of one fit per entity.

    The slope may change at ``changes`` even places in the first 80 % of the
    train weeks. Changes have a Laplace prior of scale ``prior`` (in largest
    values over the train range), so most of them are exactly zero; trend, waves
    and regressors have wide normal ones."""
    split, features = additive_split(fact, key, horizon, min_rows, order)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("Week_Index")
        test = pdf["is_test"].to_numpy(bool)
        y, week = pdf["Sales_Units"].to_numpy(float), pdf["Week_Index"].to_numpy(float)
        x = pdf[features].to_numpy(float)
        first, last = week[~test][0], week[~test][-1]
        place = (week - first) / max(last - first, 1.0)
        x[:, features.index("trend")] = place
        spots = np.unique(np.quantile(place[~test], np.linspace(0, 0.8, changes + 1)[1:]))
        hinges = np.maximum(place[:, None] - spots, 0.0)
        unit = np.abs(y[~test]).max() or 1.0
        wide = np.where(np.array(features) == "trend", 5.0, 10.0)
        level, weights, bends = piecewise_fit(x[~test], hinges[~test], y[~test] / unit, wide, prior)
        pred = unit * (level + x @ weights + hinges @ bends)
        rows = [(k, w, "test", a, p) for k, w, a, p in zip(pdf.loc[test, key], pdf.loc[test, "Week_Index"], y[test], pred[test])]
        slope = unit / max(last - first, 1.0)
        kind = pdf["Week_Index"].dtype.type
        rows += [(pdf[key].iloc[0], kind(round(first + s * (last - first))), "change", math.nan, b * slope) for s, b in zip(spots, bends) if b]
        return pd.DataFrame(rows, columns=[key, "Week_Index", "part", "actual", "pred"])

    types = dict(split.dtypes)
    schema = f"{key} {types[key]}, Week_Index {types['Week_Index']}, part string, actual double, pred double"
    known = split.select(key, "Week_Index", "Sales_Units", "is_test", *features).where("Sales_Units IS NOT NULL")
    return known.groupBy(key).applyInPandas(fit, schema)


def piecewise_fit(
    x: np.ndarray, hinges: np.ndarray, y: np.ndarray, wide: np.ndarray, prior: float, rounds: int = 5, sweeps: int = 2000
) -> tuple[float, np.ndarray, np.ndarray]:
    """(level, weights of ``x``, weights of ``hinges``), the latter sparse.

    Least squares with penalties noise^2 / wide^2 on the squares of the first and
    noise^2 / prior on the sizes of the second; the noise is that of the fit of
    the round before. The first are solved out of the Gram matrix, and the second
    found on what is left of it by coordinate descent."""
    both = np.column_stack([x, hinges])
    means, level, k = both.mean(axis=0), y.mean(), x.shape[1]
    centred, target = both - means, y - level
    gram, cross = centred.T @ centred, centred.T @ target
    weights, noise = np.zeros(len(gram)), float(target @ target) / len(y)
    for _ in range(rounds):
        own = gram[:k, :k] + np.diag(noise / wide**2 + 1e-10)
        solved = np.linalg.solve(own, np.column_stack([gram[:k, k:], cross[:k]]))
        left, aim = gram[k:, k:] - gram[k:, :k] @ solved[:, :-1], cross[k:] - gram[k:, :k] @ solved[:, -1]
        weights[k:] = lasso(left, aim, noise / prior, weights[k:], sweeps)
        weights[:k] = solved[:, -1] - solved[:, :-1] @ weights[k:]
        rest = target - centred @ weights
        noise = max(float(rest @ rest) / len(y), 1e-12)
    return level - float(means @ weights), weights[:k], weights[k:]


def lasso(gram: np.ndarray, cross: np.ndarray, penalty: float, start: np.ndarray, sweeps: int = 2000) -> np.ndarray:
    """Least w'Gw / 2 - c'w + penalty * sum |w| by coordinate descent."""
    w = start.copy()
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(w)):
            if gram[j, j] <= 1e-12:
                continue
            pull = cross[j] - gram[j] @ w + gram[j, j] * w[j]
            new = math.copysign(max(abs(pull) - penalty, 0.0), pull) / gram[j, j]
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < 1e-9:
            break
    return w


def seasonal_differences(
    weekly: DataFrame, keys: Sequence[str], order: str, value: str, season: int = 12, name: str = "diff"
) -> DataFrame:
    """(1 - B)(1 - B^season) of the series: null until enough rows exist."""
    w = series(keys, order)
    y = F.col(value)
    return weekly.withColumn(
        name,
        y - F.lag(y, 1).over(w) - F.lag(y, season).over(w) + F.lag(y, season + 1).over(w),
    )


def sarima_backtest(
    weekly: DataFrame,
    key: str,
    order: str,
    value: str,
    horizon: int = 12,
    season: int = 12,
    min_rows: int = 60,
) -> DataFrame:
    """Seasonal ARIMA (1,1,1)(1,1,1,season) per entity, fitted on train rows only.

    Estimated in two least-squares stages (Hannan and Rissanen 1982): a long
    autoregression gives the innovations, then the differenced series is
    regressed on lags 1, season and season + 1 of itself and of them, the last
    weight being the product of the two factors. A series
    that cannot be fitted gives rows with an ``error`` text and no prediction.
    """
    split = add_holdout(add_position(weekly, [key], order), [key], order, horizon, min_rows)
    data = seasonal_differences(split, [key], order, value, season)
    lags = (1, season, season + 1)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        test = pdf["is_test"].to_numpy(bool)
        out = pdf.loc[test, [key, order]].copy()
        out["actual"] = pdf.loc[test, value].astype(float)
        try:
            y = pdf.loc[~test, value].to_numpy(float)
            out["pred"] = sarima_forecast(y, pdf.loc[~test, "diff"].to_numpy(float)[season + 1 :], lags, int(test.sum()))
            out["error"] = None
        except (np.linalg.LinAlgError, ValueError) as exc:
            out["pred"], out["error"] = np.nan, str(exc)
        return out

    types = dict(weekly.dtypes)
    schema = f"{key} {types[key]}, {order} {types[order]}, actual double, pred double, error string"
    fitted = data.select(key, order, value, "is_test", "diff").groupBy(key).applyInPandas(fit, schema)
    return fitted.withColumn("pred", F.when(~F.isnan("pred"), F.col("pred")))


def fit_arma(w: np.ndarray, lags: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(AR weights, MA weights, innovations) of a differenced series.

    Lags 1, s and s + 1 have the weights a, b and -ab of (1 - aB)(1 - bB^s), and
    of the innovations c, d and cd of (1 + cB)(1 + dB^s): four numbers, found by
    Gauss-Newton steps from the fit with free weights."""
    reach = max(lags)
    long_order = min(reach + 2, len(w) // 3)
    if len(w) < 2 * reach + 6:
        raise ValueError(f"{len(w)} differenced rows are too few")
    columns = np.column_stack([w[long_order - i : len(w) - i] for i in range(1, long_order + 1)])
    long_fit = np.linalg.lstsq(columns, w[long_order:], rcond=None)[0]
    noise = np.zeros(len(w))
    noise[long_order:] = w[long_order:] - columns @ long_fit
    start = max(reach, long_order)
    design = np.column_stack(
        [w[start - i : len(w) - i] for i in lags] + [noise[start - i : len(w) - i] for i in lags]
    )
    gram = design.T @ design
    ridge = 1e-6 * max(np.trace(gram), 1e-12)
    cross, total = design.T @ w[start:], float(w[start:] @ w[start:])

    def spread(p: np.ndarray) -> np.ndarray:
        return np.array([p[0], p[1], -p[0] * p[1], p[2], p[3], p[2] * p[3]])

    def loss(p: np.ndarray) -> float:
        v = spread(p)
        return float(v @ gram @ v - 2 * v @ cross + total + ridge * p @ p)

    p = np.linalg.solve(gram + np.eye(6) * ridge, cross)[[0, 1, 3, 4]]
    for _ in range(50):
        slope = np.zeros((6, 4))
        slope[[0, 1, 3, 4], range(4)] = 1.0
        slope[2, :2], slope[5, 2:] = (-p[1], -p[0]), (p[3], p[2])
        step = np.linalg.solve(slope.T @ gram @ slope + np.eye(4) * ridge, slope.T @ (cross - gram @ spread(p)) - ridge * p)
        now, size = loss(p), 1.0
        while size > 1e-6 and loss(p + size * step) > now:
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-10:
            break
        p = p + size * step
    weights = spread(p)
    return weights[:3], weights[3:], noise


def sarima_forecast(y: np.ndarray, w: np.ndarray, lags: Sequence[int], horizon: int) -> np.ndarray:
    """Forecast the differences, then undo both differencings."""
    if not np.isfinite(w).all() or not np.isfinite(y).all():
        raise ValueError("missing values in the series")
    ar, ma, noise = fit_arma(w, lags)
    diffs, errors, level = list(w), list(noise), list(y)
    season = lags[1]
    for _ in range(horizon):
        step = sum(a * diffs[-i] for a, i in zip(ar, lags, strict=True))
        step += sum(m * errors[-i] for m, i in zip(ma, lags, strict=True))
        diffs.append(step)
        errors.append(0.0)
        level.append(step + level[-1] + level[-season] - level[-season - 1])
    return np.asarray(level[-horizon:])


def add_cv_folds(df: DataFrame, keys: Sequence[str], order: str, folds: int, name: str = "fold") -> DataFrame:
    """Expanding-window folds per series: fold i tests on its own block and
    trains on all earlier rows; the first block has no fold number."""
    position = F.row_number().over(series(keys, order)) - 1
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    counted = df.withColumns({"_pos": position, "_n": n}).withColumn("_size", F.floor(F.col("_n") / (folds + 1)))
    start = F.col("_n") - folds * F.col("_size")
    fold = F.when(
        (F.col("_size") > 0) & (F.col("_pos") >= start),
        F.floor(F.try_divide(F.col("_pos") - start, F.col("_size"))),
    )
    return counted.withColumn(name, fold.cast("long")).drop("_pos", "_n", "_size")
