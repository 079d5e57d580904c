from __future__ import annotations

import pytest

from kpiloom.plans.sql_functions import register_functions
from tests.helpers import plan_text


def test_parameters_by_name_and_default(spark, sf_dir):
    register_functions(spark, sf_dir)
    total = "SELECT sum(Revenue) FROM {}"
    whole = spark.sql(total.format("dashboard_money()")).first()[0]
    assert whole == pytest.approx(spark.sql(total.format("kpi_lines")).first()[0])
    regions = [r[0] for r in spark.sql("SELECT DISTINCT Region FROM kpi_lines").collect()]
    parts = [spark.sql(total.format(f"dashboard_money(region => '{r}')")).first()[0] for r in regions]
    assert sum(parts) == pytest.approx(whole)
    product = spark.sql("SELECT min(Product_ID) FROM kpi_weeks").first()[0]
    one = spark.sql(f"SELECT DISTINCT Product_ID FROM weekly_change(product => '{product}')").collect()
    assert [r[0] for r in one] == [product]


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    register_functions(spark, sf_dir)
    plan = plan_text(spark.sql("SELECT Month, Revenue FROM dashboard_money(category => 'ECONOMY', region => 'ASIA')"))
    assert "EqualTo(r_name,ASIA)" in plan and "EqualTo(p_type,ECONOMY)" in plan
    assert "l_tax" not in plan
