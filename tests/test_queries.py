"""Every registered query with SQL agrees with DuckDB on the small tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


OWN = sorted(n for n in ORACLES if not n.startswith(("op", "pipeline")))  # those have their tests in tests/llm


@pytest.mark.parametrize("name", OWN)
def test_matches_sql(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    want = canonical(cur.fetchall(), columns)
    assert sorted(df.columns) == sorted(columns)
    assert got == want


LIGHT = ["a31_describe_sketched", "m8_welch_verdict", "m6_honest_backtest", "m17_seasonal_arima"]


@pytest.mark.parametrize("name", LIGHT)
def test_runs_without_sql(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["Month", "Revenue", "MoM_Revenue_pct", "MoM_Drop_Flag"]


def test_every_inventory_row_has_a_query():
    wanted = {
        "s": 8, "p": 16, "k": 15, "j": 8, "a": 39, "w": 11, "o": 5, "u": 2,
        "d": 7, "x": 3, "t": 4, "m": 18, "r": 11, "v": 4,
    }
    have = {name.split("_")[0] for name in QUERIES}
    missing = [f"{k}{i}" for k, n in wanted.items() for i in range(1, n + 1) if f"{k}{i}" not in have]
    assert missing == []
