from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from kpiloom import functions as K
from tests.helpers import rows


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(expr.alias("out")).first()[0]


def test_zero_denominator(spark):
    assert one(spark, K.safe_divide("n", "d"), n=1.0, d=0.0) is None
    assert one(spark, K.safe_divide("n", "d", 0.0), n=1.0, d=0.0) == 0.0
    assert one(spark, K.safe_divide("n", "d"), n=1.0, d=4.0) == 0.25


@pytest.mark.parametrize(("value", "want"), [(2.5, 2.0), (3.5, 4.0), (-2.5, -2.0)])
def test_half_even(spark, value, want):
    assert one(spark, K.round_half_even("v"), v=value) == want


@pytest.mark.parametrize(("value", "want"), [(2.9, 2), (-2.9, -2)])
def test_truncate(spark, value, want):
    assert one(spark, K.truncate("v"), v=value) == want


def test_cohort_period_of_a_year(spark):
    months = spark.sql("SELECT explode(sequence(date'2022-01-01', date'2022-12-01', interval 1 month)) AS m")
    out = months.orderBy("m").select(K.cohort_period("m", F.lit("2022-01-01").cast("date")))
    assert [r[0] for r in out.collect()] == [0, 1, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11]


def test_calendar_buckets(spark):
    day = dt.date(2022, 11, 17)
    got = one(
        spark,
        F.struct(
            K.week_start("d"), K.week_end("d"), K.month_start("d"), K.quarter_start("d"), K.week_index("d", "2022-11-07")
        ),
        d=day,
    )
    assert tuple(got) == (
        dt.date(2022, 11, 14), dt.date(2022, 11, 20), dt.date(2022, 11, 1), dt.date(2022, 10, 1), 1
    )


def test_drop_flag_is_false_without_a_base(spark):
    assert one(spark, K.is_drop("p"), p=-0.2) is True
    assert one(spark, K.is_drop("p"), p=-0.1) is False
    assert one(spark, K.is_drop(F.lit(None).cast("double")), p=0.0) is False


def test_clip_keeps_null(spark):
    assert one(spark, K.clip("v", 0.0, 1.0), v=3.0) == 1.0
    assert one(spark, K.clip("v", 0.0), v=-3.0) == 0.0
    assert one(spark, K.clip(F.lit(None).cast("double"), 0.0, 1.0), v=0.0) is None


def test_infinite_and_zero_become_null(spark):
    assert one(spark, K.null_if_infinite("v"), v=float("inf")) is None
    assert one(spark, K.null_if_infinite("v"), v=2.0) == 2.0
    assert one(spark, K.null_if("v", 0), v=0) is None


def test_keys_and_labels(spark):
    assert one(spark, K.padded_key("P", "v", 3), v=7) == "P007"
    assert one(spark, K.padded_key("ORD-", "v", 4), v=123456) == "ORD-123456"
    assert one(spark, K.code_prefix("v"), v="Skincare") == "SKI"
    assert one(spark, K.replace_labels("v", {"SKI": "Skin", "_SKU_": " no. "}), v="SKI_SKU_01") == "Skin no. 01"
    assert one(spark, K.percent_text("v"), v=0.2168) == "21.7"


def test_cyclic_month(spark):
    sin, cos = K.cyclic_month("d")
    got = one(spark, F.struct(sin, cos), d=dt.date(2022, 3, 1))
    assert got[0] == pytest.approx(1.0)
    assert got[1] == pytest.approx(0.0, abs=1e-12)



def test_formulas(spark):
    assert one(spark, K.cogs("u", "c", "m", 0.1), u=100, c=2.0, m=50.0) == pytest.approx(205.0)
    assert one(spark, K.profit("r", "a", "b"), r=10.0, a=3.0, b=2.0) == 5.0
    assert one(spark, K.profit_margin("p", "r"), p=1.0, r=3.0) == 0.3333
    assert one(spark, K.profit_margin("p", "r"), p=1.0, r=0.0) == 0.0
    assert one(spark, K.good_units("u", "r"), u=101, r=0.02) == 98
    assert one(spark, K.efficiency("u", "h", "d"), u=100, h=30.0, d=10.0) == pytest.approx(5.0, rel=1e-6)
    assert one(spark, K.weeks_of_inventory("i", "s"), i=10.0, s=0.0) is None
    assert one(spark, K.weeks_of_inventory_unguarded("i", "s"), i=10.0, s=4.0) == 2.5
    assert one(spark, K.fill_rate("b", "s"), b=1.0, s=4.0) == pytest.approx(0.75, rel=1e-6)
    assert one(spark, K.target_achieved("s", "t", 0), s=4.0, t=0) is None
    assert one(spark, K.acquisition_cost("s", "a"), s=100.0, a=8) == 12.5
    assert one(spark, K.campaign_roi("a", "s"), a=0.1, s=50.0) == pytest.approx(0.2)
    assert one(spark, K.discounted_price("p", "d"), p=12.345, d=0.1) == 11.11
    assert one(spark, K.order_cost("u", "c", "a"), u=10, c=2.5, a=5) == 30.0
    assert one(spark, K.churn_rate("r"), r=0.85) == pytest.approx(0.15)


def test_present_or(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0)], "id int, a double")
    out = df.select(K.present_or(df, "a"), K.present_or(df, "b", 1))
    assert rows(out, "a", "b") == [(0.0, 1), (5.0, 1)]


def test_order_sample_total_profit(spark):
    sample = [(70, 80), (150, 45), (73, 95), (152, 50), (82, 100), (165, 55)]
    df = spark.createDataFrame(sample, "per_unit long, volume long")
    assert df.agg(F.sum(K.line_profit("per_unit", "volume"))).first()[0] == 44160
    assert not math.isnan(df.count())
