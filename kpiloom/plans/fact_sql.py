"""The KPI fact of ``fact.py`` as SQL, for checking."""

FIRST_WEEK = "1995-01-02"

FACT_CTES = f"""
WITH lines AS (
  SELECT l_orderkey AS Order_Key, o_custkey AS Customer_Key, l_linenumber AS Line_No,
    CAST(l_shipdate AS DATE) AS Ship_Date,
    CAST(date_trunc('week', l_shipdate) AS DATE) AS "Date",
    p_brand AS Product_ID, p_type AS Category, r_name AS Region,
    o_orderpriority AS Channel, l_linestatus AS Production_Line, c_mktsegment AS Campaign,
    l_quantity AS Sales_Units,
    CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS Returned_Units,
    l_extendedprice * (1 - l_discount) AS Revenue,
    l_quantity * p_retailprice AS COGS,
    l_extendedprice * l_tax AS Expenses,
    l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice - l_extendedprice * l_tax AS Profit,
    l_extendedprice * l_discount AS Marketing_Spend,
    l_quantity * p_size AS Raw_Material_Cost,
    l_extendedprice / l_quantity AS Price_per_Unit,
    l_discount AS Promo_Discount,
    l_discount >= 0.08 AS On_Promo,
    l_tax AS Acquisition_Rate,
    p_size AS Satisfaction,
    l_quantity / 50 AS Efficiency_Rate,
    l_quantity * l_tax AS Freight,
    CAST(p_size AS DOUBLE) AS Material,
    date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS Lead_Time_Days,
    CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END AS Inventory,
    CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN l_quantity ELSE 0 END AS Backorder
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
),
pw0 AS (
  SELECT Product_ID, "Date",
    date_diff('day', DATE '{FIRST_WEEK}', "Date") // 7 AS Week_Index,
    'Item ' || substr(Product_ID, 7) AS Product_Name,
    'CAT_' || CAST(CAST(substr(Product_ID, 7) AS BIGINT) % 5 AS VARCHAR) AS Category,
    sum(Sales_Units) AS Sales_Units,
    sum(Returned_Units) AS Returned_Units,
    sum(Sales_Units) + sum(Returned_Units) AS Produced_Units,
    sum(Revenue) AS Revenue, sum(COGS) AS COGS, sum(Expenses) AS Expenses, sum(Freight) AS Logistics_Cost,
    sum(Revenue) - sum(COGS) - sum(Expenses) AS Profit,
    CAST(count(*) AS DOUBLE) AS Other_Expenses,
    sum(Marketing_Spend) AS Marketing_Spend,
    sum(Raw_Material_Cost) AS Raw_Material_Cost, sum(Material) AS Material_kg,
    sum(CASE WHEN Line_No = 1 THEN 1 ELSE 0 END) AS Acquisition,
    sum(CASE WHEN Line_No = 1 AND Returned_Units = 0 THEN 1 ELSE 0 END) AS Customer_Acquisition,
    avg(CASE WHEN Returned_Units > 0 THEN 1.0 ELSE 0.0 END) AS Returns_Rate,
    avg(Acquisition_Rate) * 100 AS NPS,
    avg(Satisfaction) / 5 AS Employee_Satisfaction,
    CAST(sum(Line_No) AS DOUBLE) AS Downtime_hours,
    avg(Lead_Time_Days) AS Lead_Time_days,
    sum(Sales_Units) / count(*) AS Efficiency_u_per_h,
    avg(Price_per_Unit) AS Price_per_Unit, avg(Promo_Discount) AS Promo_Discount, bool_or(On_Promo) AS On_Promo,
    sum(Inventory) AS Inventory, sum(Backorder) AS Backorder
  FROM lines GROUP BY Product_ID, "Date"
),
pw AS (
  SELECT *, Returned_Units / NULLIF(Sales_Units, 0) AS Defect_Rate,
    trunc(Produced_Units * (1 - Returned_Units / NULLIF(Sales_Units, 0))) AS Good_Units,
    CAST(date_trunc('month', "Date") AS DATE) AS "Month",
    CAST(date_trunc('quarter', "Date") AS DATE) AS "Quarter",
    year("Date") AS "Year"
  FROM pw0
)"""
