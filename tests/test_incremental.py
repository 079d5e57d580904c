from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from kpiloom.operators import growth as G
from kpiloom.operators import incremental as I
from kpiloom.session import scratch_path
from tests.helpers import rows

COLUMNS = "Product_ID string, Date date, Month date, Sales_Units double, Revenue double, Lead_Time_days double, Efficiency_u_per_h double"
START = dt.date(2022, 1, 3)


def fact(spark, lengths, seed=1, gap=0.1):
    """Products of ``lengths`` weeks with gaps and missing values; all end in the same week."""
    draw, out = random.Random(seed), []
    for p, n in enumerate(lengths):
        for i in range(max(lengths) - n, max(lengths)):
            if draw.random() < gap:
                continue
            day = START + dt.timedelta(days=7 * i)
            values = [float(draw.randint(0, 9)) if draw.random() > 0.05 else None for _ in range(4)]
            out.append((f"P{p}", day, day.replace(day=1), *values))
    return spark.createDataFrame(out, COLUMNS)


def files(path):
    return {os.path.join(at, f): os.path.getmtime(os.path.join(at, f)) for at, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def local(path):
    return path.removeprefix("file:")


def full(df):
    whole = G.add_lags(G.weekly_metrics(df), ["Product_ID"], "Date", "Sales_Units", I.LAGS)
    return sorted(rows(whole, *sorted(whole.columns)), key=repr)


def result(spark, path):
    out = I.read_series(spark, path)
    return sorted(rows(out, *sorted(out.columns)), key=repr)


@pytest.mark.parametrize("steps", [[60], [3, 4, 61, 100], [1, 2, 3, 5, 8, 13, 14, 70]])
def test_extended_equals_written_whole(spark, steps):
    """Products of over 52, of few and of no rows at the first write."""
    df = fact(spark, [110, 80, 20, 9, 3, 1]).cache()
    path, cut = scratch_path(spark, "series"), [None, *[START + dt.timedelta(days=7 * s) for s in steps], None]
    I.write_series(df.where(F.col("Date") < cut[1]), path)
    for low, high in zip(cut[1:], cut[2:]):
        I.extend_series(df.where((F.col("Date") >= low) & (F.col("Date") < high if high else F.lit(True))), path)
    assert result(spark, path) == full(df)


def test_only_the_touched_months_are_written(spark):
    df = fact(spark, [90, 90], gap=0).cache()
    path, cut = scratch_path(spark, "series"), START + dt.timedelta(days=7 * 85)
    I.write_series(df.where(F.col("Date") < cut), path)
    before = files(local(path) + "/weeks")
    I.extend_series(df.where(F.col("Date") >= cut), path)
    after = files(local(path) + "/weeks")
    touched = {f"Month={r[0]}" for r in df.where(F.col("Date") >= cut).select("Month").distinct().collect()}
    changed = {f for f in before if after.get(f) != before[f]}
    assert {f.split("/")[-2] for f in changed} <= touched
    assert len(changed) < len(before) / 4
    state = I._state(spark, path)
    assert state.groupBy("Product_ID").count().where("count > 52").count() == 0


def test_repeated_extension_after_a_failure(spark, monkeypatch):
    df = fact(spark, [40, 10]).cache()
    path, cut = scratch_path(spark, "series"), START + dt.timedelta(days=7 * 33)
    I.write_series(df.where(F.col("Date") < cut), path)
    with monkeypatch.context() as patch:
        patch.setattr(I, "_write_state", lambda *_a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            I.extend_series(df.where(F.col("Date") >= cut), path)
    I.extend_series(df.where(F.col("Date") >= cut), path)
    assert result(spark, path) == full(df)


def test_written_weeks_are_refused(spark):
    df = fact(spark, [40, 10]).cache()
    path = scratch_path(spark, "series")
    I.write_series(df, path)
    with pytest.raises(ValueError, match="written already: P"):
        I.extend_series(df.where("Product_ID = 'P0'"), path)


def test_nothing_new_changes_nothing(spark):
    df = fact(spark, [30, 30]).cache()
    path = scratch_path(spark, "series")
    I.write_series(df, path)
    I.extend_series(df.limit(0), path)
    assert result(spark, path) == full(df)
