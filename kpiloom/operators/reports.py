"""Management tables: matrices, waterfall, alerts, comparisons, dashboard."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kpiloom.functions import cohort_period, percent_text, year_month_label
from kpiloom.operators.growth import last_change, running_base
from kpiloom.operators.rollup import calendar_rollup


def month_labels(df: DataFrame, month: str = "Month", whole_years: bool = False) -> list[str]:
    """All calendar months between the first and the last, or of their years,
    from one row."""
    span = df.agg(F.min(month).alias("lo"), F.max(month).alias("hi")).first()
    if span is None or span["lo"] is None:
        return []
    lo, hi = (d.year * 12 + d.month - 1 for d in span)
    if whole_years:
        lo, hi = lo - lo % 12, hi - hi % 12 + 11
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(lo, hi + 1)]


def require_unique_names(df: DataFrame, key: str, name: str) -> None:
    """Raise when two entities share a name, under which a matrix would mix them."""
    shared = df.groupBy(name).agg(F.count_distinct(key).alias("n")).where("n > 1").limit(3).collect()
    if shared:
        raise ValueError(f"several entities are named {', '.join(str(r[name]) for r in shared)}")


def month_matrix(
    monthly: DataFrame, row: str, value: str, month: str = "Month", months: Sequence[str] | None = None, fill: float = 0.0
) -> DataFrame:
    """One row per entity, one column per month. The month list comes from the
    calendar span, so the pivot needs no distinct job."""
    months = list(months) if months is not None else month_labels(monthly, month)
    labelled = monthly.select(row, year_month_label(month).alias("_label"), value)
    return labelled.groupBy(row).pivot("_label", months).agg(F.max(value)).fillna(fill, subset=months)


def cohort_sums(
    df: DataFrame, cohort: str, month: str, value: str, period: Column | None = None
) -> DataFrame:
    """Sum per (cohort, month), with the cohort period."""
    sums = df.groupBy(cohort, month).agg(F.sum(value).alias("n_sales"))
    return sums.withColumn("Cohort_Period", cohort_period(month, cohort) if period is None else period)


def cohort_matrix(sums: DataFrame, cohort: str, periods: Sequence[int] | None = None) -> DataFrame:
    """Mean of the sums per cohort and period: two months can share a 30-day
    period. Without ``periods`` whole dozens are shown, up to the last one present."""
    if periods is None:
        last = sums.agg(F.max("Cohort_Period")).first()[0]
        periods = range(0 if last is None else (last // 12 + 1) * 12)
    wide = sums.groupBy(cohort).pivot("Cohort_Period", list(periods)).agg(F.avg("n_sales"))
    return wide.select(cohort, *[F.col(str(p)).alias(f"period_{p}") for p in periods])


def waterfall(last_month: DataFrame, key: str, steps: Mapping[str, Column]) -> DataFrame:
    """One row per entity and step, with the base where its bar starts."""
    rows = [
        F.struct(F.lit(i).cast("long").alias("step"), F.lit(label).alias("label"), value.alias("amount"))
        for i, (label, value) in enumerate(steps.items(), start=1)
    ]
    long = last_month.select(key, F.inline(F.array(*rows)))
    return running_base(long, [key], "step", "amount")


def profit_steps(expenses: str = "Expenses") -> dict[str, Column]:
    """Revenue, less cost of goods, less expenses, and the profit."""
    return {
        "Revenue": F.col("Revenue"),
        "COGS": -F.col("COGS"),
        "Expenses": -F.col(expenses),
        "Profit": F.col("Profit"),
    }


def alerts(
    monthly: DataFrame, key: str = "Product_ID", month: str = "Month", threshold: float = 0.10, language: str = "en"
) -> DataFrame:
    """Lead time up, or efficiency down, in the last month by more than the threshold."""
    change = last_change(
        monthly, [key], month, {"lt_pct": "Lead_Time_days", "eff_pct": "Efficiency_u_per_h"}
    )
    rules = F.array(
        F.struct(F.lit("Lead_Time").alias("rule"), F.col("lt_pct").alias("pct"), (F.col("lt_pct") > threshold).alias("hit")),
        F.struct(F.lit("Efficiency").alias("rule"), F.col("eff_pct").alias("pct"), (F.col("eff_pct") < -threshold).alias("hit")),
    )
    fired = change.select(key, month, F.inline(rules)).where("hit").drop("hit")
    return fired.withColumn("line", alert_line(key, language))


# Wording of the alert lines, by language.
ALERT_TEXTS = {
    "en": {
        "Lead_Time": "ALERT: Lead Time increase for product {key} in last month: {pct}%",
        "Efficiency": "ALERT: Efficiency drop for product {key} in last month: {pct}%",
    },
    "fa": {
        "Lead_Time": "هشدار: افزایش Lead Time برای محصول {key} در ماه اخیر: {pct}%",
        "Efficiency": "هشدار: کاهش Efficiency برای محصول {key} در ماه اخیر: {pct}%",
    },
}


def alert_line(key: str, language: str = "en") -> Column:
    texts = ALERT_TEXTS[language]
    template = F.when(F.col("rule") == "Lead_Time", texts["Lead_Time"]).otherwise(texts["Efficiency"])
    return F.replace(F.replace(template, F.lit("{key}"), F.col(key)), F.lit("{pct}"), percent_text("pct"))


def ordered_alerts(fired: DataFrame, totals: DataFrame, key: str, measure: str) -> DataFrame:
    """Alerts in the order of the entities' measure, lead time first. The rows
    are at most two per top entity."""
    ranked = fired.join(totals.select(key, F.col(measure).alias("_rank")), key, "left")
    return ranked.orderBy(F.desc("_rank"), key, F.desc("rule")).drop("_rank")


def stack_models(tables: Mapping[str, DataFrame], column: str = "Model") -> DataFrame:
    """Result rows of several models in one table."""
    named = [t.withColumn(column, F.lit(name)) for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), named)


def compare_models(long: DataFrame, key: str, models: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per entity, one column per model and metric."""
    return long.groupBy(key).agg(
        *[
            F.max(F.when(F.col("Model") == model, F.col(metric))).alias(f"{model}_{metric}")
            for model in models
            for metric in metrics
        ]
    )


def scatter_points(
    df: DataFrame,
    x: str,
    y: str,
    group: str | None = None,
    fraction: float | None = None,
    seed: int = 42,
    keys: Sequence[str] = (),
    most: int | None = None,
) -> DataFrame:
    """Points behind a scatter chart: all of them, about a ``fraction``, or the
    ``most`` of each group with the smallest hashes of their ``keys``, joined by
    ``|``. The last is a random choice, but the same on every run and however the rows
    are cut: every task keeps its own ``most`` before the shuffle. Rows with equal
    keys count by their values."""
    if most is None:
        points = df.select(*[c for c in (x, y, group) if c])
        return points if fraction is None else points.sample(fraction, seed)
    if not keys:
        raise ValueError("a bounded point set needs the keys of a row")
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).cast("binary"))
    ranked = W.partitionBy(group if group else F.lit(0)).orderBy("_hash", x, y)
    points = df.select(*[c for c in (x, y, group) if c], digest.alias("_hash"))
    return points.withColumn("_row", F.row_number().over(ranked)).where(F.col("_row") <= most).drop("_hash", "_row")


def dashboard(
    df: DataFrame, category: str, region: str, date: str = "Date"
) -> tuple[DataFrame, DataFrame]:
    """Monthly money and monthly operations of one category in one region."""
    picked = df.where((F.col("Category") == category) & (F.col("Region") == region))
    money = calendar_rollup(picked, "Month", {"Revenue": "sum", "Profit": "sum"}, date=date)
    work = calendar_rollup(picked, "Month", {"Efficiency_Rate": "mean", "Lead_Time_Days": "mean"}, date=date)
    return money, work
