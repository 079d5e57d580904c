from __future__ import annotations

from pyspark.sql import DataFrame


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def by_key(df: DataFrame, key: str, value: str) -> dict:
    return {r[key]: r[value] for r in df.collect()}


def plan_text(df: DataFrame) -> str:
    """Executed plan; run the query first to see the final adaptive plan."""
    return df._jdf.queryExecution().executedPlan().toString()
