"""Registry of named queries, each with the SQL that checks it.

A query states its output once, as ``"name:type ..."``; both sides are cast
and rounded from that statement. Types: ``s`` text, ``i`` long, ``d`` date,
``b`` boolean, ``t`` timestamp, a digit n = double rounded to n places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.plans.fact_sql import FACT_CTES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SPARK_TYPES = {"s": "string", "i": "bigint", "d": "date", "b": "boolean", "t": "timestamp_ntz"}
_SQL_TYPES = {"s": "VARCHAR", "i": "BIGINT", "d": "DATE", "b": "BOOLEAN", "t": "TIMESTAMP"}


def _fields(out: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in out.split()]


def _spark_column(name: str, kind: str) -> Column:
    """Doubles are rounded half up as decimals: in decimal, a tie is a tie."""
    c = F.col(f"`{name}`")
    if kind.isdigit():
        return F.round(c.cast("double").cast(f"decimal(38,{int(kind) + 3})"), int(kind)).cast("double").alias(name)
    return c.cast(_SPARK_TYPES[kind]).alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind.isdigit():
        return f'CAST(round(TRY_CAST("{name}" AS DECIMAL(38, {int(kind) + 3})), {kind}) AS DOUBLE) AS "{name}"'
    return f'CAST("{name}" AS {_SQL_TYPES[kind]}) AS "{name}"'


def query(name: str, out: str | None, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``out=None`` keeps its columns as they are."""

    def register(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(spark, sf_dir)
            return df if out is None else df.select(*[_spark_column(n, k) for n, k in _fields(out)])

        QUERIES[name] = run
        if sql is not None:
            columns = "*" if out is None else ", ".join(_sql_column(n, k) for n, k in _fields(out))
            ORACLES[name] = f"{FACT_CTES}\nSELECT {columns} FROM (\n{sql.strip()}\n) AS result"
        return build

    return register
