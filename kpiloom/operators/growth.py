"""Growth rates, rolling means, lags and positions within a series.

A series is the rows of one entity in calendar order. Windows run over rollups,
so an entity has at most one row per calendar period, however many raw rows it
has; company-level series (no keys) have one row per period in all. All columns
of one call share a window, hence one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kpiloom.functions import cyclic_month, is_drop, target_achieved


def series(keys: Sequence[str], order: str) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(order)


def pct_change(value: str, window: WindowSpec, lag: int = 1) -> Column:
    """Change against the row ``lag`` rows back; null without a base."""
    base = F.lag(value, lag).over(window)
    return F.try_divide(F.col(value) - base, base)


def add_growth(
    df: DataFrame, keys: Sequence[str], order: str, columns: Mapping[str, tuple[str, int]]
) -> DataFrame:
    """Add ``{name: (value column, row lag)}``."""
    w = series(keys, order)
    return df.withColumns({name: pct_change(value, w, lag) for name, (value, lag) in columns.items()})


def wow(df: DataFrame, keys: Sequence[str], value: str, name: str, order: str = "Date") -> DataFrame:
    """Week-over-week change as a four-column table."""
    out = add_growth(df, keys, order, {name: (value, 1)})
    return out.select(*keys, order, value, name)


def add_rolling(df: DataFrame, keys: Sequence[str], order: str, columns: Mapping[str, tuple[str, int]]) -> DataFrame:
    """Add ``{name: (value column, rows)}`` rolling means, from the first row on."""
    w = series(keys, order)
    return df.withColumns(
        {name: F.avg(value).over(w.rowsBetween(1 - k, 0)) for name, (value, k) in columns.items()}
    )


def add_lags(
    df: DataFrame, keys: Sequence[str], order: str, value: str, lags: Sequence[int], prefix: str = "lag_"
) -> DataFrame:
    """Row lags whose leading gaps take the next known lag value."""
    w = series(keys, order)
    ahead = W.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    raw = df.withColumns({f"{prefix}{n}": F.lag(value, n).over(w) for n in lags})
    return raw.withColumns({f"{prefix}{n}": F.last(f"{prefix}{n}", ignorenulls=True).over(ahead) for n in lags})


def add_position(df: DataFrame, keys: Sequence[str], order: str, name: str = "position") -> DataFrame:
    """0-based row position within the series."""
    return df.withColumn(name, (F.row_number().over(series(keys, order)) - 1).cast("long"))


def add_holdout(
    df: DataFrame, keys: Sequence[str], order: str, horizon: int, min_rows: int = 0, name: str = "is_test"
) -> DataFrame:
    """Flag the last ``horizon`` rows; drop series shorter than ``min_rows``."""
    latest_first = W.partitionBy(*keys).orderBy(F.desc(order))
    out = df.withColumn(name, F.row_number().over(latest_first) <= horizon)
    return long_enough(out, keys, min_rows) if min_rows else out


def long_enough(df: DataFrame, keys: Sequence[str], min_rows: int) -> DataFrame:
    """Keep the series with at least ``min_rows`` rows."""
    counted = df.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    return counted.where(F.col("_n") >= min_rows).drop("_n")


def last_change(df: DataFrame, keys: Sequence[str], order: str, columns: Mapping[str, str], eps: float = 1e-9) -> DataFrame:
    """Last row against the row before it: ``{name: value column}``, for series of two rows or more."""
    latest_first = W.partitionBy(*keys).orderBy(F.desc(order))
    previous = {name: F.lead(value, 1).over(latest_first) for name, value in columns.items()}
    out = (
        df.withColumns({f"_{name}": c for name, c in previous.items()})
        .withColumns(
            {"_rank": F.row_number().over(latest_first), "_n": F.count(F.lit(1)).over(W.partitionBy(*keys))}
        )
        .where((F.col("_rank") == 1) & (F.col("_n") >= 2))
    )
    changes = [(F.try_divide(F.col(v), F.col(f"_{name}") + eps) - 1).alias(name) for name, v in columns.items()]
    return out.select(*keys, order, *columns.values(), *changes)


def first_of_group(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Give every row its group's first period (acquisition month).

    The group has one row per period here; for raw rows, aggregate and join
    instead (``joins.add_first_period``).
    """
    return df.withColumn(name, F.min(value).over(W.partitionBy(*keys)))


def running_base(df: DataFrame, keys: Sequence[str], order: str, step: str, name: str = "base") -> DataFrame:
    """Sum of the signed steps before this one: where a waterfall bar starts."""
    before = series(keys, order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(step).over(before), F.lit(0.0)))


def add_target(
    weekly: DataFrame, key: str = "Product_ID", value: str = "Sales_Units", uplift: float = 1.05
) -> DataFrame:
    """Integer target per entity on every row: ``rollup.weekly_targets`` without
    a second pass, on the partitioning that the other windows use."""
    mean = F.avg(value).over(W.partitionBy(key))
    return weekly.withColumn("Weekly_Target", F.bround(mean * uplift, 0).cast("long"))


# Columns whose weekly change is shown.
CHANGES = ("Sales_Units", "Revenue", "Lead_Time_days", "Efficiency_u_per_h")


def weekly_history(fact: DataFrame, key: str = "Product_ID", date: str = "Date", changes: Sequence[str] = CHANGES) -> DataFrame:
    """Rolling means and changes of the product-week table: what a row takes
    from the rows before it, at most 52 back."""
    out = add_rolling(
        fact,
        [key],
        date,
        {
            "Rolling_4w_Sales": ("Sales_Units", 4),
            "Rolling_13w_Sales": ("Sales_Units", 13),
            "Rolling_4w_Eff": ("Efficiency_u_per_h", 4),
        },
    )
    return add_growth(
        out,
        [key],
        date,
        {
            **{f"WoW_pct_{c}": (c, 1) for c in changes},
            "pct_4w_Sales": ("Sales_Units", 4),
            "pct_52w_Sales": ("Sales_Units", 52),
        },
    )


def weekly_metrics(
    fact: DataFrame, key: str = "Product_ID", date: str = "Date", uplift: float = 1.05, changes: Sequence[str] = CHANGES
) -> DataFrame:
    """The product-week table with target, rolling means and WoW changes: one exchange."""
    out = weekly_history(add_target(fact, key, uplift=uplift), key, date, changes)
    return out.withColumn("Target_Achieved", target_achieved("Sales_Units", "Weekly_Target"))


def monthly_summary(monthly: DataFrame, key: str = "Product_ID", month: str = "Month", alert: float = 0.10) -> DataFrame:
    """MoM and YoY changes, 3-month mean and drop flag per entity and month."""
    out = add_growth(
        monthly,
        [key],
        month,
        {
            "MoM_Sales_pct": ("Sales_Units", 1),
            "YoY_Sales_pct": ("Sales_Units", 12),
            "MoM_LeadTime_pct": ("Lead_Time_days", 1),
            "MoM_Eff_pct": ("Efficiency_u_per_h", 1),
        },
    )
    out = add_rolling(out, [key], month, {"Rolling_3m_Sales": ("Sales_Units", 3)})
    return out.withColumn("MoM_Drop_Flag", is_drop("MoM_Sales_pct", alert))


def series_features(
    weekly: DataFrame,
    keys: Sequence[str] = ("Product_ID",),
    date: str = "Date",
    value: str = "Sales_Units",
    lags: Sequence[int] = (1, 2, 3, 4, 13),
    windows: Sequence[int] = (4, 13),
    include_current: bool = True,
) -> DataFrame:
    """Lag, rolling and cyclic month features.

    ``include_current`` keeps the current row in the rolling means, as the
    published backtests do; it leaks the target into the features, so pass
    False for an honest forecast (the window then ends one row earlier).
    """
    w = series(keys, date)
    shift = 0 if include_current else 1
    sin, cos = cyclic_month(date)
    out = add_lags(weekly, keys, date, value, lags).withColumns(
        {
            **{f"roll_{k}": F.avg(value).over(w.rowsBetween(1 - k - shift, -shift)) for k in windows},
            "month": F.month(date).cast("double"),
            "month_sin": sin,
            "month_cos": cos,
        }
    )
    if include_current:
        return out
    return out.withColumns({f"roll_{k}": F.coalesce(F.col(f"roll_{k}"), F.col(f"lag_{lags[0]}")) for k in windows})
