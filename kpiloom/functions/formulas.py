"""Row-level KPI formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kpiloom.functions.columns import _col, null_if, safe_divide, truncate

# Guards added to a denominator, as in the published outputs.
INVENTORY_EPS = 1e-6
TARGET_EPS = 1e-9
HOURS_EPS = 1e-6


def line_profit(per_unit: Column | str, volume: Column | str) -> Column:
    return _col(per_unit) * _col(volume)


def order_cost(produced: Column | str, unit_cost: Column | str, ad_spend: Column | str) -> Column:
    return _col(produced) * _col(unit_cost) + _col(ad_spend)


def churn_rate(retention: Column | str) -> Column:
    return 1 - _col(retention)


def cogs(produced: Column | str, unit_cost: Column | str, material: Column | str, material_factor: float) -> Column:
    """Cost of goods; the material share is 0.2, 0.1 or 1 by data set."""
    return _col(produced) * _col(unit_cost) + _col(material) * material_factor


def profit(revenue: Column | str, *costs: Column | str) -> Column:
    out = _col(revenue)
    for cost in costs:
        out = out - _col(cost)
    return out


def profit_margin(profit_: Column | str, revenue: Column | str, digits: int = 4) -> Column:
    """Profit over revenue, 0 without revenue."""
    p, r = _col(profit_), _col(revenue)
    return F.round(F.when(r > 0, safe_divide(p, r)).otherwise(0.0), digits)


def efficiency(produced: Column | str, hours: Column | str, downtime: Column | str) -> Column:
    return safe_divide(_col(produced).cast("double"), _col(hours) - _col(downtime) + HOURS_EPS)


def good_units(produced: Column | str, defect_rate: Column | str) -> Column:
    return truncate(_col(produced) * (1 - _col(defect_rate)))


def returned_units(sold: Column | str, returns_rate: Column | str) -> Column:
    return truncate(_col(sold) * _col(returns_rate))


def discounted_price(price: Column | str, discount: Column | str) -> Column:
    """Rounded as money: half up on six decimals, free of binary noise."""
    exact = (_col(price) * (1 - _col(discount))).cast("decimal(18,6)")
    return F.round(exact, 2).cast("double")


def weeks_of_inventory(inventory: Column | str, sold: Column | str, eps: float = INVENTORY_EPS) -> Column:
    """Null without sales."""
    return safe_divide(_col(inventory), null_if(sold, 0) + eps)


def weeks_of_inventory_unguarded(inventory: Column | str, sold: Column | str) -> Column:
    """Very large, not null, without sales; two digits."""
    return F.round(_col(inventory) / (_col(sold) + INVENTORY_EPS), 2)


def fill_rate(backorder: Column | str, sold: Column | str, eps: float = INVENTORY_EPS) -> Column:
    return 1 - safe_divide(_col(backorder), null_if(sold, 0) + eps)


def target_achieved(sold: Column | str, target: Column | str, eps: float = TARGET_EPS) -> Column:
    """``eps=0`` gives the plain ratio, null for a zero target."""
    return safe_divide(_col(sold), _col(target) + eps if eps else _col(target))


def acquisition_cost(spend: Column | str, acquired: Column | str) -> Column:
    return F.round(_col(spend) / (_col(acquired) + 1e-6), 2)


def weeks_since(week: Column | str, start_week: Column | str) -> Column:
    return _col(week) - _col(start_week)


def campaign_roi(mean_acquisition: Column | str, total_spend: Column | str) -> Column:
    return safe_divide(_col(mean_acquisition), _col(total_spend)) * 100
