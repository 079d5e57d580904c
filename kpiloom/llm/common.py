"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.session import scratch_path

#: The ASCII blanks that separate words, as a character class.
BLANK = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with the columns it has."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again.

    Cuts the lineage: later passes see the same rows, and a lost executor costs
    a re-read of shared files.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filled(text: str | Column) -> Column:
    """Text with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def whole_digest(text: str | Column) -> Column:
    """SHA-256 of the text as it is; null stays null."""
    return F.unhex(F.sha2((F.col(text) if isinstance(text, str) else text).cast("binary"), 256))


def word_count(text: Column) -> Column:
    """Number of runs of non-blank characters."""
    return F.size(F.regexp_extract_all(filled(text), F.lit(f"[^{BLANK}]+"), F.lit(0))).cast("long")


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition on ``keys`` of both sides; null equals null."""
    condition = left[keys[0]].eqNullSafe(right[keys[0]])
    for key in keys[1:]:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition
