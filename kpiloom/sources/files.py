"""CSV and text sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The line written when there is no alert, by language.
NOTHING_FOUND = {"en": "No critical alerts detected.", "fa": "هشدار مهمی یافت نشد."}


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """CSV with a header row. Give a schema: without one Spark reads the data
    twice, once to infer the types."""
    reader = spark.read.option("header", True)
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return reader.csv(path)


def read_fact_csv(
    spark: SparkSession, path: str | Sequence[str], schema: str, date_columns: Sequence[str] = ("Date",)
) -> DataFrame:
    """CSV whose named columns are dates, whatever time part the text carries."""
    df = read_csv(spark, path, schema)
    return df.withColumns({c: F.to_date(c) for c in date_columns})


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV folder with a header per part file; dates as ISO text."""
    df.write.mode(mode).option("header", True).csv(path)


def write_per_entity(df: DataFrame, path: str, key: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """One folder per entity.

    The rebalance hint brings the rows of an entity together, and lets adaptive
    execution split an entity that is too large for one task.
    """
    out = df.hint("rebalance", F.col(key)).write.mode(mode).partitionBy(key)
    (out.option("header", True) if fmt == "csv" else out).format(fmt).save(path)


def alert_lines(alerts: DataFrame, line: str = "line", nothing: str = NOTHING_FOUND["en"]) -> DataFrame:
    """The alert texts, or one row saying that there are none."""
    spark = alerts.sparkSession
    lines = alerts.select(F.col(line).alias("value"))
    found = alerts.agg(F.count(F.lit(1))).scalar()
    fallback = spark.range(1).select(F.lit(nothing).alias("value")).where(found == 0)
    return lines.unionAll(fallback)


def write_alerts(
    alerts: DataFrame, path: str, line: str = "line", mode: str = "errorifexists", language: str = "en"
) -> None:
    """Alert lines as one text file, in the given order: a few lines per top entity."""
    alert_lines(alerts, line, NOTHING_FOUND[language]).coalesce(1).write.mode(mode).text(path)
