"""The KPI fact over the star-schema tables.

``order_lines`` is the order-level fact, ``product_week`` the product-week one.
Both take the wanted columns and join only the tables those come from, so a
query on lineitem measures scans lineitem alone. No join is hinted: a small
dimension is broadcast on its known size, a large one is shuffled, and hot
keys are split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions import (
    good_units,
    line_profit,
    month_start,
    profit,
    quarter_start,
    safe_divide,
    week_index,
    week_start,
)
from kpiloom.plans.fact_sql import FIRST_WEEK
from kpiloom.sources import table

PRODUCT_TABLES = {"part"}
ORDER_TABLES = {"orders"}
CUSTOMER_TABLES = {"orders", "customer"}
REGION_TABLES = {"orders", "customer", "region"}


def _line_columns() -> dict[str, tuple[Column, set[str]]]:
    """Column -> (expression, tables it needs besides lineitem)."""
    c = F.col
    revenue = c("l_extendedprice") * (1 - c("l_discount"))
    cogs = line_profit("l_quantity", "p_retailprice")
    expenses = c("l_extendedprice") * c("l_tax")
    is_open = c("l_linestatus") == "O"
    lineitem = {
        "Order_Key": c("l_orderkey"),
        "Line_No": c("l_linenumber").cast("long"),
        "Ship_Date": c("l_shipdate").cast("date"),
        "Date": week_start("l_shipdate"),
        "Production_Line": c("l_linestatus"),
        "Sales_Units": c("l_quantity"),
        "Returned_Units": F.when(c("l_returnflag") == "R", c("l_quantity")).otherwise(0.0),
        "Revenue": revenue,
        "Expenses": expenses,
        "Marketing_Spend": c("l_extendedprice") * c("l_discount"),
        "Price_per_Unit": safe_divide("l_extendedprice", "l_quantity"),
        "Promo_Discount": c("l_discount"),
        "On_Promo": c("l_discount") >= 0.08,
        "Acquisition_Rate": c("l_tax"),
        "Efficiency_Rate": c("l_quantity") / 50,
        "Inventory": F.when(is_open, c("l_quantity")).otherwise(0.0),
        "Backorder": F.when(is_open & (c("l_returnflag") == "N"), c("l_quantity")).otherwise(0.0),
        "Freight": c("l_quantity") * c("l_tax"),
    }
    part = {
        "Product_ID": c("p_brand"),
        "Category": c("p_type"),
        "COGS": cogs,
        "Profit": profit(revenue, cogs, expenses),
        "Raw_Material_Cost": c("l_quantity") * c("p_size"),
        "Material": c("p_size").cast("double"),
        "Satisfaction": c("p_size").cast("long"),
    }
    orders = {
        "Customer_Key": c("o_custkey"),
        "Channel": c("o_orderpriority"),
        "Lead_Time_Days": F.date_diff(c("l_shipdate").cast("date"), c("o_orderdate").cast("date")).cast("long"),
    }
    return {
        **{name: (e, set()) for name, e in lineitem.items()},
        **{name: (e, PRODUCT_TABLES) for name, e in part.items()},
        **{name: (e, ORDER_TABLES) for name, e in orders.items()},
        "Campaign": (c("c_mktsegment"), CUSTOMER_TABLES),
        "Region": (c("r_name"), REGION_TABLES),
    }


def order_lines(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    """Order-level fact: one row per order line, with the named columns."""
    known = _line_columns()
    needed = set().union(*(known[name][1] for name in columns))
    df = table(spark, sf_dir, "lineitem")
    if "part" in needed:
        part = table(spark, sf_dir, "part")
        df = df.join(part, df.l_partkey == part.p_partkey)
    if "orders" in needed:
        df = df.join(_orders(spark, sf_dir, needed), F.col("l_orderkey") == F.col("o_orderkey"))
    return df.select(*[known[name][0].alias(name) for name in columns])


def _orders(spark: SparkSession, sf_dir: str, needed: set[str]) -> DataFrame:
    """Orders with their customer attributes: joined before lineitem, on the smaller side."""
    orders = table(spark, sf_dir, "orders")
    if "customer" not in needed:
        return orders
    customer = table(spark, sf_dir, "customer")
    if "region" in needed:
        nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
        places = nation.join(region, nation.n_regionkey == region.r_regionkey)
        customer = customer.join(places, customer.c_nationkey == places.n_nationkey)
    return orders.join(customer, orders.o_custkey == customer.c_custkey)


def brand_number(c: str = "Product_ID") -> Column:
    return F.substring(F.col(c), 7, 10).cast("long")


def product_name(c: str = "Product_ID") -> Column:
    return F.concat(F.lit("Item "), F.substring(F.col(c), 7, 10))


def product_category(c: str = "Product_ID") -> Column:
    return F.concat(F.lit("CAT_"), F.pmod(brand_number(c), F.lit(5)).cast("string"))


def _week_measures() -> dict[str, tuple[Column, tuple[str, ...]]]:
    """Measure -> (aggregate, line columns it reads)."""
    def total(name: str) -> tuple[Column, tuple[str, ...]]:
        return F.sum(name), (name,)

    def mean(name: str) -> tuple[Column, tuple[str, ...]]:
        return F.avg(name), (name,)

    opened = F.sum((F.col("Line_No") == 1).cast("long"))
    won = F.sum(((F.col("Line_No") == 1) & (F.col("Returned_Units") == 0)).cast("long"))
    returns = F.avg((F.col("Returned_Units") > 0).cast("double"))
    produced = F.sum("Sales_Units") + F.sum("Returned_Units")
    defect = safe_divide(F.sum("Returned_Units"), F.sum("Sales_Units"))
    units = ("Sales_Units", "Returned_Units")
    return {
        **{
            c: total(c)
            for c in (
                "Sales_Units",
                "Returned_Units",
                "Revenue",
                "COGS",
                "Expenses",
                "Marketing_Spend",
                "Raw_Material_Cost",
                "Inventory",
                "Backorder",
            )
        },
        "Produced_Units": (produced, units),
        "Defect_Rate": (defect, units),
        "Returns_Rate": (returns, ("Returned_Units",)),
        "Good_Units": (good_units(produced, defect).cast("double"), units),
        "Logistics_Cost": total("Freight"),
        "Profit": (
            profit(F.sum("Revenue"), F.sum("COGS"), F.sum("Expenses")),
            ("Revenue", "COGS", "Expenses"),
        ),
        "Other_Expenses": (F.count(F.lit(1)).cast("double"), ()),
        "Material_kg": total("Material"),
        "Acquisition": (opened, ("Line_No",)),
        "Customer_Acquisition": (won, ("Line_No", "Returned_Units")),
        "NPS": (F.avg("Acquisition_Rate") * 100, ("Acquisition_Rate",)),
        "Employee_Satisfaction": (F.avg("Satisfaction") / 5, ("Satisfaction",)),
        "Downtime_hours": (F.sum("Line_No").cast("double"), ("Line_No",)),
        "Lead_Time_days": (F.avg("Lead_Time_Days"), ("Lead_Time_Days",)),
        "Efficiency_u_per_h": (F.avg("Sales_Units"), ("Sales_Units",)),
        "Price_per_Unit": mean("Price_per_Unit"),
        "Promo_Discount": mean("Promo_Discount"),
        "On_Promo": (F.bool_or("On_Promo"), ("On_Promo",)),
    }


def _week_attributes() -> dict[str, Column]:
    return {
        "Product_Name": product_name(),
        "Category": product_category(),
        "Week_Index": week_index("Date", FIRST_WEEK),
        "Month": month_start("Date"),
        "Quarter": quarter_start("Date"),
        "Year": F.year("Date").cast("long"),
    }


#: Session setting: folder of a written fact that the queries read instead.
FACT_SETTING = "kpiloom.product.week"


def write_product_week(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write the fact with all its columns once; set ``FACT_SETTING`` to the
    folder, and the queries on the fact no longer read and join the raw tables.
    The tables' folder is kept beside it."""
    _built_week(spark, sf_dir, [*_week_measures(), *_week_attributes()]).write.parquet(path)
    spark.createDataFrame([(_folder(sf_dir),)], "folder string").write.parquet(f"{path}-source")


def _folder(sf_dir: str) -> str:
    return sf_dir.rstrip("/").removeprefix("file://").removeprefix("file:")


def _checked_source(spark: SparkSession, sf_dir: str, path: str) -> None:
    source = spark.read.parquet(f"{path}-source").first()["folder"]
    if source != _folder(sf_dir):
        raise ValueError(f"{FACT_SETTING} names a fact of {source}, not of {sf_dir}")


def product_week(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    """Product-week fact: Product_ID, Date and the named columns, from the
    written fact where the session names one; one of other tables raises."""
    path = spark.conf.get(FACT_SETTING, None)
    if path:
        _checked_source(spark, sf_dir, path)
        return spark.read.parquet(path).select("Product_ID", "Date", *columns)
    return _built_week(spark, sf_dir, columns)


def _built_week(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    """One exchange on (Product_ID, Date) after map-side combining; the result
    has at most one row per product and calendar week."""
    measures, attributes = _week_measures(), _week_attributes()
    picked = [c for c in columns if c in measures]
    line_columns = list(dict.fromkeys(["Product_ID", "Date", *(n for c in picked for n in measures[c][1])]))
    lines = order_lines(spark, sf_dir, line_columns)
    aggregates = [measures[c][0].alias(c) for c in picked] or [F.count(F.lit(1)).alias("_n")]
    weekly = lines.groupBy("Product_ID", "Date").agg(*aggregates)
    added = {c: attributes[c] for c in columns if c in attributes}
    return weekly.withColumns(added).select("Product_ID", "Date", *columns)
