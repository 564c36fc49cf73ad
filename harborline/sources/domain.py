"""Domain tables (inventory, sales, shipments, orders, ...) as SQL views over the star-schema test tables.

Each text runs unchanged in Spark SQL and in an ANSI engine; ``{name}`` stands for another table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# Literals such as 1e2 are DOUBLE in both dialects (100.0 would be DECIMAL).
VIEWS = {
    "v_inventory": """
SELECT CAST(p_partkey AS STRING) AS product_id, p_name AS product_name, p_type AS category,
  'W' || CAST(p_partkey % 8 + 1 AS STRING) AS warehouse_id,
  CAST(p_size * 10 + p_partkey % 97 AS DOUBLE) AS current_stock, CAST(20 + p_partkey % 13 * 5 AS DOUBLE) AS safety_stock,
  CAST(60 + p_partkey % 29 * 5 AS DOUBLE) AS reorder_point, CAST(3 + p_partkey % 20 AS DOUBLE) AS lead_time_days,
  CAST(5 + p_partkey % 40 AS DOUBLE) AS avg_daily_sales, p_retailprice AS unit_cost,
  CAST(15 + p_partkey % 15 AS DOUBLE) / 1e2 AS holding_cost_rate, CAST(50 + p_partkey % 300 AS DOUBLE) AS ordering_cost
FROM {part}""",
    "v_sales": """
SELECT CAST(l_partkey AS STRING) AS product_id, CAST(l_shipdate AS DATE) AS date, r_name AS region, sum(l_quantity) AS daily_sales
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
  JOIN {region} ON n_regionkey = r_regionkey
GROUP BY 1, 2, 3""",
    "v_sales_brand": """
SELECT p_brand AS product_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS daily_sales
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2""",
    "v_suppliers": """
SELECT CAST(s_suppkey AS STRING) AS supplier_id, s_name AS supplier_name, CAST(3 + s_suppkey % 18 AS DOUBLE) AS lead_time_days,
  CAST(60 + s_suppkey * 37 % 40 AS DOUBLE) / 1e2 AS reliability_score
FROM {supplier}""",
    "v_shipments": """
SELECT CAST(l_orderkey AS STRING) AS shipment_id, CAST(l_suppkey AS STRING) AS supplier_id,
  CAST(l_partkey AS STRING) AS product_id, CAST(l_shipdate AS DATE) AS shipment_date,
  CAST(l_shipdate AS DATE) + 20 AS expected_delivery,
  CASE WHEN l_orderkey % 50 = 0 THEN NULL
    ELSE CAST(l_shipdate AS DATE) + CAST(2 + (l_orderkey * 31 + l_partkey * 7) % 20 + l_suppkey % 12 AS INT) END AS actual_delivery,
  l_orderkey * 13 % 30 AS defective_units, l_extendedprice AS total_cost
FROM {lineitem}""",
    "v_warehouses": """
SELECT warehouse_id, 'Site ' || warehouse_id AS warehouse_location,
  CAST(count(*) * (190 + 150 * CAST(substr(warehouse_id, 2) AS INT)) AS DOUBLE) AS capacity
FROM {v_inventory} GROUP BY warehouse_id""",
    "v_orders": """
SELECT CAST(o_orderkey AS STRING) AS order_id,
  CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'canceled' END AS order_status,
  o_orderdate AS order_purchase_timestamp, o_orderdate + INTERVAL '1' HOUR AS order_approved_at,
  o_orderdate + INTERVAL '8' DAY AS order_estimated_delivery_date,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL '1' HOUR * CAST(6 + o_orderkey * 7 % 120 AS INT) END
    AS order_delivered_carrier_date,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '1' HOUR * CAST(30 + o_orderkey * 7 % 120 + o_orderkey * 13 % 113 AS INT) END
    AS order_delivered_customer_date
FROM {orders}""",
    "v_items": """
SELECT CAST(l_orderkey AS STRING) AS order_id, l_linenumber AS order_item_id, CAST(l_partkey AS STRING) AS product_id,
  CAST(l_suppkey * 10 + l_linenumber AS STRING) AS seller_id, l_extendedprice AS price, l_tax * l_quantity AS freight_value
FROM {lineitem}""",
    "v_sellers": """
SELECT DISTINCT CAST(l_suppkey * 10 + l_linenumber AS STRING) AS seller_id, n_name AS seller_state
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""",
    # Low-priority orders have no review, urgent ones have two.
    "v_reviews": """
SELECT o_orderkey * 2 AS review_id, CAST(o_orderkey AS STRING) AS order_id,
  CAST(o_orderkey % 7 % 5 + 1 AS DOUBLE) AS review_score, o_orderdate + INTERVAL '10' DAY AS review_creation_date
FROM {orders} WHERE o_orderpriority <> '5-LOW'
UNION ALL
SELECT o_orderkey * 2 + 1, CAST(o_orderkey AS STRING), CAST(o_orderkey % 3 + 1 AS DOUBLE), o_orderdate + INTERVAL '9' DAY
FROM {orders} WHERE o_orderpriority = '1-URGENT'""",
    "v_products_cat": """
SELECT CAST(p_partkey AS STRING) AS product_id, CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE p_type END AS product_category_name
FROM {part}""",
    "v_translation": """
SELECT DISTINCT p_type AS product_category_name, lower(p_type) AS product_category_name_english FROM {part}""",
    "v_orm_suppliers": """
SELECT CAST(s_suppkey AS STRING) AS supplier_id, s_name AS supplier_name, CAST(3 + s_suppkey % 18 AS DOUBLE) AS lead_time_days,
  CAST(60 + s_suppkey * 37 % 41 AS DOUBLE) AS reliability_score, CAST(s_suppkey * 13 % 45 AS DOUBLE) / 1e2 AS delay_rate,
  CASE WHEN s_suppkey % 7 = 0 THEN 'AT_RISK' WHEN s_suppkey % 11 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status
FROM {supplier}""",
    "v_orm_forecasts": """
SELECT CAST(p_partkey AS STRING) AS product_id, 1e0 + p_size * 5e-1 AS predicted_demand,
  CAST(5 + p_partkey % 40 AS DOUBLE) AS avg_daily_sales, p_partkey % 10 = 0 AS demand_spike,
  CAST(p_size * 10 + p_partkey % 97 AS DOUBLE) / (1e0 + p_partkey % 30) AS days_until_stockout, 8e-1 AS confidence_score
FROM {part}""",
    "v_orm_alerts": """
SELECT event_id AS id, CAST(user_id AS STRING) AS product_id,
  CASE event_type WHEN 'click' THEN 'STOCKOUT' WHEN 'purchase' THEN 'DELAY' WHEN 'error' THEN 'ANOMALY' ELSE 'COST' END AS alert_type,
  CASE WHEN value > 70 THEN 'CRITICAL' WHEN value > 25 THEN 'WARNING' ELSE 'INFO' END AS severity,
  value < 10 AS is_acknowledged, ts AS created_at
FROM {events}""",
    "v_orm_reorders": """
SELECT CAST(p_partkey AS STRING) AS product_id, CAST(p_partkey * 17 % 500 AS DOUBLE) AS reorder_quantity,
  CAST(3 + p_partkey % 20 AS DOUBLE) AS supplier_lead_time, p_partkey % 4 = 0 AS stockout_risk,
  CAST(1 + p_partkey % 3 AS INT) AS priority,
  CAST(p_partkey % (SELECT count(*) FROM {supplier}) AS STRING) AS primary_supplier_id
FROM {part}""",
    "v_live": """
SELECT ts AS timestamp, CAST(user_id AS STRING) AS product_id, 'W' || CAST(user_id % 8 + 1 AS STRING) AS warehouse_id,
  event_type AS change_type, value AS quantity
FROM {events}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One base table or domain view as a DataFrame."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    inputs = {n: view(spark, sf_dir, n) for n in sorted(set(_NAME.findall(text)))}
    return spark.sql(text, **inputs)


def needed_views(*names: str) -> list[str]:
    """The domain views that the named ones read, inputs first."""
    found: list[str] = []
    for name in names:
        for inner in _NAME.findall(VIEWS.get(name, "")):
            found += [n for n in needed_views(inner) if n not in found]
        if name in VIEWS and name not in found:
            found.append(name)
    return found


def view_ctes(*names: str) -> list[str]:
    """The same views as common table expressions for an engine that has the base tables."""
    return [f"{n} AS ({_NAME.sub(lambda m: m.group(1), VIEWS[n]).strip()})" for n in needed_views(*names)]
