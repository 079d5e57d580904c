"""Column expressions: calendar buckets, null handling, flags, text labels.

All of them are built-in Spark expressions, so they stay in generated code.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- calendar ---------------------------------------------------------------


def week_start(d: Column | str) -> Column:
    """Monday of the week."""
    return F.trunc(_col(d).cast("date"), "week")


def week_end(d: Column | str) -> Column:
    """Sunday that closes the week: the label of a weekly resample bin."""
    return F.date_add(week_start(d), 6)


def month_start(d: Column | str) -> Column:
    return F.trunc(_col(d).cast("date"), "month")


def quarter_start(d: Column | str) -> Column:
    return F.trunc(_col(d).cast("date"), "quarter")


def week_index(d: Column | str, origin: Column | str) -> Column:
    """Whole weeks since ``origin`` (a date column or an ISO date)."""
    start = F.lit(origin).cast("date") if isinstance(origin, str) else origin
    return F.floor(F.date_diff(_col(d).cast("date"), start) / 7).cast("long")


def cohort_period(month: Column | str, cohort: Column | str) -> Column:
    """30-day periods between two month starts (the published definition)."""
    return F.floor(F.date_diff(_col(month), _col(cohort)) / 30).cast("long")


def cohort_month_no(month: Column | str, cohort: Column | str) -> Column:
    """Calendar months between two month starts."""
    return F.months_between(_col(month), _col(cohort)).cast("long")


def year_month_label(d: Column | str) -> Column:
    return F.date_format(_col(d), "yyyy-MM")


def cyclic_month(d: Column | str) -> tuple[Column, Column]:
    """Month of year as a point on the circle: (sin, cos)."""
    angle = F.month(_col(d)) * F.lit(2 * math.pi) / 12
    return F.sin(angle), F.cos(angle)


# --- nulls and guards -------------------------------------------------------


def null_if(c: Column | str, value: object) -> Column:
    return F.nullif(_col(c), F.lit(value))


def null_if_infinite(c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.abs(c) == F.lit(float("inf")), None).otherwise(c)


def safe_divide(n: Column | str, d: Column | str, default: float | None = None) -> Column:
    """``n / d``; ``default`` (null by default) when the denominator is 0."""
    ratio = F.try_divide(_col(n), _col(d))
    return ratio if default is None else F.coalesce(ratio, F.lit(default))


def keep_when(condition: Column, c: Column | str) -> Column:
    return F.when(condition, _col(c))


def is_drop(pct: Column | str, threshold: float = 0.10) -> Column:
    """True when the change is known and falls by more than ``threshold``."""
    return F.coalesce(_col(pct) < F.lit(-threshold), F.lit(False))


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; null stays null."""
    c = _col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def present_or(df: DataFrame, name: str, default: object = 0) -> Column:
    """The column with nulls as ``default`` when the table has it, else ``default``."""
    value = F.lit(default)
    return (F.coalesce(F.col(name), value) if name in df.columns else value).alias(name)


# --- rounding ---------------------------------------------------------------


def round_half_even(c: Column | str, digits: int = 0) -> Column:
    return F.bround(_col(c), digits)


def truncate(c: Column | str) -> Column:
    """Whole part, towards zero."""
    return _col(c).cast("long")


# --- text -------------------------------------------------------------------


def code_prefix(c: Column | str, length: int = 3) -> Column:
    return F.upper(F.substring(_col(c), 1, length))


def padded_key(prefix: str, number: Column | str, width: int) -> Column:
    """Key such as ``P007``; a longer number keeps all its digits."""
    text = _col(number).cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))


def replace_labels(c: Column | str, labels: Mapping[str, str] | Iterable[tuple[str, str]]) -> Column:
    """Literal replacements, applied in the given order."""
    out = _col(c)
    for old, new in labels.items() if isinstance(labels, Mapping) else labels:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def percent_text(fraction: Column | str, digits: int = 1) -> Column:
    """``0.217`` -> ``21.7``."""
    return F.format_string(f"%.{digits}f", _col(fraction) * 100)
