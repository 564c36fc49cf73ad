"""The same results in plain SQL, written independently of the DataFrame code, for checks on another engine."""

from __future__ import annotations

import re

from harborline.plans.tables import CHURN_INTERCEPT, CHURN_WEIGHTS
from harborline.sources.domain import BASE_TABLES, VIEWS

_NAME = re.compile(r"\{(\w+)\}")

_Z = " + ".join(f"({w!r}e0) * {f}" for f, w in CHURN_WEIGHTS.items())
_CONTRIBUTIONS = " UNION ALL ".join(
    f"SELECT seller_id, observation_date, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, "
    f"({w!r}e0) * ({f} - (SELECT avg({f}) FROM {{d_dataset}})) AS contribution FROM {{d_dataset}}"
    for f, w in CHURN_WEIGHTS.items()
)

RESULTS = {
    "d_shipments": """SELECT *, CASE WHEN actual_delivery > expected_delivery THEN 'Delayed' ELSE 'OnTime' END AS status FROM {v_shipments}""",
    "d_deliveries": """SELECT *, CAST(actual_delivery - expected_delivery AS INT) AS delay_days, shipment_date AS order_date,
  actual_delivery <= expected_delivery AS on_time FROM {d_shipments} WHERE actual_delivery IS NOT NULL""",
    "d_sales_agg": """SELECT product_id, avg(daily_sales) AS avg_daily_sales, sum(daily_sales) AS total_daily_sales,
  coalesce(stddev_samp(daily_sales), 0) AS stddev_daily_sales FROM {v_sales} GROUP BY product_id""",
    "d_spikes": """SELECT *, daily_sales > 15e-1 * rolling_avg AS is_spike FROM (SELECT *, avg(daily_sales) OVER
  (PARTITION BY product_id ORDER BY date, region ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rolling_avg FROM {v_sales})""",
    "d_spike_counts": """SELECT product_id, count(*) FILTER (WHERE is_spike) AS total_spikes,
  arg_max(is_spike, CAST(date AS VARCHAR) || region) AS demand_spike FROM {d_spikes} GROUP BY product_id""",
    "d_shipment_agg": """SELECT product_id, count(*) FILTER (WHERE actual_delivery > expected_delivery) AS total_delays,
  avg(coalesce(actual_delivery - expected_delivery, 0)) AS avg_delay_days FROM {v_shipments} GROUP BY product_id""",
    "d_merged": """SELECT *, CASE WHEN avg_daily_sales > 0 THEN current_stock / avg_daily_sales ELSE 9999 END AS inventory_days FROM (
  SELECT i.* EXCLUDE (avg_daily_sales), coalesce(s.avg_daily_sales, 1) AS avg_daily_sales, coalesce(s.total_daily_sales, 0) AS total_daily_sales,
    coalesce(s.stddev_daily_sales, 0) AS stddev_daily_sales, coalesce(p.total_spikes, 0) AS total_spikes,
    coalesce(p.demand_spike, FALSE) AS demand_spike, coalesce(h.total_delays, 0) AS total_delays, coalesce(h.avg_delay_days, 0) AS avg_delay_days
  FROM {v_inventory} i LEFT JOIN {d_sales_agg} s USING (product_id) LEFT JOIN {d_spike_counts} p USING (product_id)
    LEFT JOIN {d_shipment_agg} h USING (product_id))""",
    "d_forecast": """SELECT *, current_stock / predicted_demand AS days_until_stockout FROM (
  SELECT *, CASE WHEN avg_daily_sales < 1e-2 THEN 1e-2 ELSE avg_daily_sales END AS predicted_demand FROM {d_merged})""",
    "d_lead": """SELECT s.product_id, avg(u.lead_time_days) AS supplier_lead_time FROM {v_shipments} s
  LEFT JOIN {v_suppliers} u USING (supplier_id) GROUP BY s.product_id""",
    "d_reorder": """SELECT *, CASE WHEN stockout_risk
    THEN 'Product ' || product_id || ' will stockout in ' || CAST(CAST(round_even(days_until_stockout, 0) AS BIGINT) AS VARCHAR) || ' days. Reorder immediately.'
    WHEN reorder_quantity > 0 THEN 'Product ' || product_id || ' reorder recommended. Quantity: ' || CAST(CAST(reorder_quantity AS BIGINT) AS VARCHAR) || '.'
    ELSE 'Product ' || product_id || ' stock level healthy.' END AS alert_message FROM (
  SELECT *, days_until_stockout < supplier_lead_time AS stockout_risk,
    round_even(CASE WHEN need < 0 THEN 0 ELSE need END, 0) AS reorder_quantity FROM (
    SELECT *, predicted_demand * supplier_lead_time + safety_stock - current_stock AS need FROM (
      SELECT f.*, coalesce(l.supplier_lead_time, 7) AS supplier_lead_time FROM {d_forecast} f LEFT JOIN {d_lead} l USING (product_id))))""",
    "d_health": """SELECT product_id, current_stock, predicted_demand, days_until_stockout, reorder_quantity,
  CASE WHEN days_until_stockout < 3 THEN 'CRITICAL' WHEN days_until_stockout <= 7 THEN 'WARNING' ELSE 'GOOD' END AS health_status,
  CASE WHEN days_until_stockout < 3 THEN 20 WHEN days_until_stockout <= 7 THEN 60 ELSE 100 END AS health_score FROM {d_reorder}""",
    "d_cost": """SELECT *, inventory_holding_cost + stockout_cost AS total_cost_impact FROM (SELECT product_id, current_stock * 2 AS inventory_holding_cost,
  CASE WHEN days_until_stockout < 5 THEN predicted_demand * 5 ELSE 0 END AS stockout_cost FROM {d_forecast})""",
    "d_performance": """SELECT *, 100 - reliability_score AS delay_rate, CASE WHEN reliability_score > 85 THEN 'GOOD'
  WHEN reliability_score >= 60 THEN 'WARNING' ELSE 'CRITICAL' END AS supplier_status FROM (SELECT supplier_id, avg(delay_days) AS average_delay,
  count(shipment_id) AS total_shipments, count(*) FILTER (WHERE delay_days <= 0) AS on_time_shipments,
  count(*) FILTER (WHERE delay_days <= 0) / CAST(count(*) AS DOUBLE) * 100 AS reliability_score FROM {d_deliveries} GROUP BY supplier_id)""",
    "d_warehouses": """SELECT *, CASE WHEN utilization_percent > 85 THEN 'HIGH' WHEN utilization_percent >= 40 THEN 'NORMAL' ELSE 'LOW' END AS status
  FROM (SELECT w.*, coalesce(s.total_stock, 0) AS total_stock, coalesce(s.total_stock, 0) / w.capacity * 100 AS utilization_percent
  FROM {v_warehouses} w LEFT JOIN (SELECT warehouse_id, sum(current_stock) AS total_stock FROM {v_inventory} GROUP BY 1) s USING (warehouse_id))""",
    "d_metrics": """SELECT supplier_id, avg(delay_days) AS avg_delay_days, max(delay_days) AS max_delay_days,
  avg(CASE WHEN status = 'Delayed' THEN 1e0 ELSE 0e0 END) AS delay_rate, count(*) AS total_shipments,
  count(*) FILTER (WHERE status = 'Delayed') AS delayed_shipments FROM {d_deliveries} GROUP BY supplier_id""",
    "d_board": """SELECT u.*, m.* EXCLUDE (supplier_id), CASE WHEN reliability_score >= 9e-1 AND delay_rate <= 15e-2 THEN 'LOW_RISK'
  WHEN reliability_score < 75e-2 OR delay_rate >= 3e-1 THEN 'AT_RISK' ELSE 'MEDIUM_RISK' END AS risk_tier
  FROM {v_suppliers} u LEFT JOIN {d_metrics} m ON u.supplier_id = m.supplier_id""",
    "d_supplier_features": """SELECT supplier_id, count(shipment_id) AS total_shipments, avg(delay_days) AS avg_delay_days,
  max(delay_days) AS max_delay_days, avg(CAST(on_time AS INT)) AS on_time_rate, avg(defective_units) AS avg_defect_units,
  sum(total_cost) AS total_spend, avg(total_cost) AS avg_order_value FROM {d_deliveries} GROUP BY supplier_id""",
    "d_recent": """SELECT supplier_id, avg(CAST(on_time AS INT)) AS recent_90d_on_time_rate FROM {d_deliveries}
  WHERE order_date >= (SELECT max(order_date) FROM {d_deliveries}) - 90 GROUP BY supplier_id""",
    "d_supplier_score": """SELECT *, CASE WHEN supplier_risk_score > 0 AND supplier_risk_score <= 2e-1 THEN 'LOW'
  WHEN supplier_risk_score > 2e-1 AND supplier_risk_score <= 4e-1 THEN 'MEDIUM' WHEN supplier_risk_score > 4e-1 AND supplier_risk_score <= 1 THEN 'HIGH' END AS risk_tier
  FROM (SELECT *, (1 - on_time_rate) * 5e-1 + avg_delay_days / (SELECT nullif(max(avg_delay_days), 0) FROM {d_supplier_features}) * 3e-1
    + avg_defect_units / (SELECT nullif(max(avg_defect_units), 0) FROM {d_supplier_features}) * 2e-1 AS supplier_risk_score FROM {d_supplier_features})""",
    "d_profile": """SELECT supplier_id, avg(delay_days) AS avg_supplier_delay, coalesce(stddev_samp(delay_days), 0) AS std_supplier_delay,
  avg(CASE WHEN delay_days > 0 THEN 1e0 ELSE 0e0 END) AS supplier_late_ratio, count(*) AS total_shipments FROM {d_deliveries} GROUP BY supplier_id""",
    "d_rolling": """SELECT *, CASE WHEN count(daily_sales) OVER w7 >= 7 THEN avg(daily_sales) OVER w7 END AS roll_7_mean,
  CASE WHEN count(daily_sales) OVER w30 >= 30 THEN avg(daily_sales) OVER w30 END AS roll_30_mean,
  CASE WHEN count(daily_sales) OVER w7 >= 7 THEN stddev_samp(daily_sales) OVER w7 END AS roll_7_std,
  CASE WHEN count(daily_sales) OVER w90 >= 90 THEN avg(daily_sales) OVER w90 END AS roll_90_mean FROM {v_sales}
  WINDOW w7 AS (PARTITION BY product_id ORDER BY date, region ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
  w30 AS (PARTITION BY product_id ORDER BY date, region ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
  w90 AS (PARTITION BY product_id ORDER BY date, region ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)""",
    "d_brand": """SELECT *, lag(daily_sales, 7) OVER w AS lag_7, lag(daily_sales, 14) OVER w AS lag_14, lag(daily_sales, 30) OVER w AS lag_30,
  roll_30_mean / nullif(lag(roll_30_mean, 30) OVER w, 0) - 1 AS mom_change, daily_sales / nullif(lag(daily_sales, 365) OVER w, 0) - 1 AS yoy_change
  FROM (SELECT *, CASE WHEN count(*) OVER w7 >= 7 THEN avg(daily_sales) OVER w7 END AS roll_7_mean,
    CASE WHEN count(*) OVER w30 >= 30 THEN avg(daily_sales) OVER w30 END AS roll_30_mean,
    CASE WHEN count(*) OVER w7 >= 7 THEN stddev_samp(daily_sales) OVER w7 END AS roll_7_std,
    CASE WHEN count(*) OVER w90 >= 90 THEN avg(daily_sales) OVER w90 END AS roll_90_mean FROM {v_sales_brand}
    WINDOW w7 AS (PARTITION BY product_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
    w30 AS (PARTITION BY product_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW),
    w90 AS (PARTITION BY product_id ORDER BY date ROWS BETWEEN 89 PRECEDING AND CURRENT ROW))
  WINDOW w AS (PARTITION BY product_id ORDER BY date)""",
    "d_stock_risk": """SELECT *, CASE WHEN overstock_ratio > 15e-1 THEN 1 ELSE 0 END AS is_overstock FROM (
  SELECT *, round_even(CASE WHEN days_of_stock < lead_time_days THEN least(1e0, (lead_time_days - days_of_stock) / nullif(lead_time_days, 0)) ELSE 0e0 END, 4) AS stockout_risk,
    least(5e0, greatest(0e0, current_stock / (reorder_point * 3))) AS overstock_ratio,
    CASE WHEN days_of_stock < lead_time_days THEN 1 ELSE 0 END AS is_understocked, current_stock * unit_cost * holding_cost_rate AS annual_holding_cost
  FROM (SELECT *, current_stock / greatest(avg_demand_30d, 1e-1) AS days_of_stock FROM {d_inventory_demand}))""",
    "d_inventory_demand": """SELECT i.*, coalesce(l.m, i.avg_daily_sales) AS avg_demand_30d, coalesce(l.s, i.avg_daily_sales * 2e-1) AS demand_std FROM {v_inventory} i
  LEFT JOIN (SELECT product_id, arg_max(roll_30_mean, CAST(date AS VARCHAR) || region) FILTER (WHERE roll_30_mean IS NOT NULL) AS m,
    arg_max(roll_7_std, CAST(date AS VARCHAR) || region) FILTER (WHERE roll_7_std IS NOT NULL) AS s FROM {d_rolling} GROUP BY 1) l USING (product_id)""",
    "d_daily": """SELECT date, sum(daily_sales) AS total_sales FROM {v_sales} GROUP BY date""",
    "d_daily_stats": """SELECT date, sum(daily_sales) AS total_sales, avg(daily_sales) AS avg_sales, coalesce(stddev_samp(daily_sales), 0) AS std_sales,
  max(daily_sales) AS max_sales FROM {v_sales} GROUP BY date""",
    "d_forecast_rows": """SELECT * FROM (SELECT product_id, date, daily_sales AS y, isodow(date) AS day_of_week, day(date) AS day_of_month, month(date) AS month,
    dayofyear(date) AS day_of_year, CASE WHEN isodow(date) >= 5 THEN 1 ELSE 0 END AS is_weekend, quarter(date) AS quarter,
    lag(daily_sales, 7) OVER w AS lag_7, lag(daily_sales, 14) OVER w AS lag_14, lag(daily_sales, 28) OVER w AS lag_28,
    CASE WHEN count(*) OVER w7 = 7 THEN avg(daily_sales) OVER w7 END AS roll_mean_7, CASE WHEN count(*) OVER w14 = 14 THEN avg(daily_sales) OVER w14 END AS roll_mean_14,
    CASE WHEN count(*) OVER w7 = 7 THEN stddev_samp(daily_sales) OVER w7 END AS roll_std_7, max(daily_sales) OVER w7 AS roll_max_7, min(daily_sales) OVER w7 AS roll_min_7
  FROM {v_sales_brand} WINDOW w AS (PARTITION BY product_id ORDER BY date),
    w7 AS (PARTITION BY product_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
    w14 AS (PARTITION BY product_id ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)) WHERE lag_28 IS NOT NULL""",
    "d_judged": """SELECT product_id, date, y, roll_mean_7 AS prediction FROM {d_forecast_rows}""",
    "d_simulated": """SELECT *, current_stock * 2 * cost + CASE WHEN sim_days_until_stockout < CASE WHEN capacity = 0 THEN 999 ELSE supplier_lead_time + sim_delay_days END
    THEN sim_demand * 5 * cost ELSE 0 END AS sim_financial_impact FROM (
  SELECT *, round_even(CASE WHEN sim_demand > 0 THEN current_stock / sim_demand ELSE 999 END, 1) AS sim_days_until_stockout FROM (
    SELECT r.*, s.*, r.avg_delay_days + s.delay AS sim_delay_days, r.predicted_demand * (1 + s.spike / 1e2) AS sim_demand
    FROM {d_reorder} r CROSS JOIN {d_scenarios} s))""",
    "d_scenarios": """SELECT * FROM (VALUES ('Port Disruption', 21e0, 0e0, 100e0, 1e0), ('Demand Surge', 0e0, 150e0, 100e0, 1e0),
  ('Factory Shutdown', 0e0, 0e0, 0e0, 1e0), ('Energy Crisis', 0e0, 0e0, 100e0, 25e-1)) AS t(scenario, delay, spike, capacity, cost)""",
    # Sellers.
    "d_master": """SELECT *, CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS purchase_month, CAST(date_trunc('week', order_purchase_timestamp) AS DATE) AS purchase_week,
  CAST(year(order_purchase_timestamp) AS INT) AS purchase_year, coalesce(order_status = 'delivered' AND delivery_delay_days > 0, FALSE) AS is_late,
  coalesce(order_status = 'delivered' AND delivery_delay_days <= 0, FALSE) AS on_time FROM (
  SELECT i.*, o.* EXCLUDE (order_id), s.seller_state, r.review_score, r.review_creation_date, c.product_category_name, n.product_category_name_english,
    (epoch_us(order_delivered_carrier_date) - epoch_us(order_approved_at)) / 86400e6 AS dispatch_days,
    (epoch_us(order_delivered_customer_date) - epoch_us(order_approved_at)) / 86400e6 AS delivery_days,
    (epoch_us(order_estimated_delivery_date) - epoch_us(order_approved_at)) / 86400e6 AS estimated_days,
    (epoch_us(order_delivered_customer_date) - epoch_us(order_estimated_delivery_date)) / 86400e6 AS delivery_delay_days
  FROM {v_items} i LEFT JOIN {v_orders} o ON i.order_id = o.order_id LEFT JOIN {v_sellers} s ON i.seller_id = s.seller_id
    LEFT JOIN {d_first_review} r ON i.order_id = r.order_id LEFT JOIN {v_products_cat} c ON i.product_id = c.product_id
    LEFT JOIN {v_translation} n ON c.product_category_name = n.product_category_name)""",
    "d_first_review": """SELECT order_id, review_score, review_creation_date FROM (SELECT *, row_number() OVER
  (PARTITION BY order_id ORDER BY review_creation_date NULLS LAST, review_id) AS rn FROM {v_reviews}) WHERE rn = 1""",
    "d_dates": """SELECT t AS observation_date FROM (SELECT CAST(last_day(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH))) AS DATE) AS t,
  lo, hi FROM (SELECT CAST(min(order_purchase_timestamp) AS DATE) AS lo, CAST(max(order_purchase_timestamp) AS DATE) AS hi FROM {v_orders})) WHERE t BETWEEN lo AND hi""",
    "d_weeks": """SELECT m.*, d.observation_date, CAST(floor((epoch_us(order_purchase_timestamp) - epoch_us(d.observation_date - INTERVAL 56 DAY)) / 6048e8) AS INT) AS week_idx,
  order_purchase_timestamp >= d.observation_date - INTERVAL 30 DAY AS in_30, order_purchase_timestamp >= d.observation_date - INTERVAL 7 DAY AS in_7
  FROM {d_master} m JOIN {d_dates} d ON order_purchase_timestamp >= d.observation_date - INTERVAL 56 DAY AND order_purchase_timestamp < d.observation_date""",
    "d_window_aggs": """SELECT seller_id, observation_date, count(*) FILTER (WHERE in_30) AS orders_30d,
  coalesce(CASE WHEN count(*) FILTER (WHERE in_30 AND on_time) > 0 THEN count(*) FILTER (WHERE in_30 AND on_time) / CAST(count(*) FILTER (WHERE in_30 AND order_status = 'delivered') AS DOUBLE) END, 1) AS rolling_30d_otd_rate,
  coalesce(avg(review_score) FILTER (WHERE in_30), 5) AS rolling_30d_avg_review,
  count(*) FILTER (WHERE in_30 AND review_score <= 2) / CAST(greatest(1, count(*) FILTER (WHERE in_30)) AS DOUBLE) AS high_complaint_rate_30d,
  coalesce(sum(price) FILTER (WHERE in_30 AND review_score <= 2), 0) AS revenue_at_risk_30d,
  count(*) FILTER (WHERE in_30 AND order_status = 'canceled') / CAST(greatest(1, count(*) FILTER (WHERE in_30)) AS DOUBLE) AS cancellation_rate_30d,
  count(DISTINCT product_category_name) FILTER (WHERE in_30) AS product_category_diversity FROM {d_weeks} GROUP BY 1, 2""",
    "d_p50": """SELECT seller_id, observation_date, coalesce(median(dispatch_days) FILTER (WHERE in_7 AND dispatch_days > 0), 0) AS dispatch_time_p50_7d FROM {d_weeks} GROUP BY 1, 2""",
    "d_active_weeks": """SELECT seller_id, observation_date, count(DISTINCT week_idx) AS seller_active_weeks FROM {d_weeks} GROUP BY 1, 2""",
    "d_tenure": """SELECT p.seller_id, p.observation_date, f.seller_state, CAST(floor((epoch_us(CAST(p.observation_date AS TIMESTAMP)) - epoch_us(f.first)) / 86400e6) AS BIGINT) AS seller_tenure_days
  FROM (SELECT DISTINCT seller_id, observation_date FROM {d_weeks}) p
  JOIN (SELECT seller_id, max(seller_state) AS seller_state, min(order_purchase_timestamp) AS first FROM {d_master} GROUP BY 1) f ON p.seller_id = f.seller_id""",
    "d_volume": """SELECT seller_id, observation_date, week_idx, CAST(count(*) AS DOUBLE) AS y FROM {d_weeks} GROUP BY 1, 2, 3""",
    "d_dispatch": """SELECT seller_id, observation_date, week_idx, median(dispatch_days) AS y FROM {d_weeks} WHERE dispatch_days > 0 GROUP BY 1, 2, 3""",
    "d_review": """SELECT seller_id, observation_date, week_idx, avg(review_score) AS y FROM {d_weeks} GROUP BY 1, 2, 3""",
    **{
        f"d_{n}_series": f"""SELECT seller_id, observation_date, week_idx, x, coalesce({value}, {default}) AS y FROM (
  SELECT g.seller_id, g.observation_date, g.week_idx, CAST(dense_rank() OVER (PARTITION BY g.observation_date ORDER BY g.week_idx) - 1 AS INT) AS x, v.y FROM (
    SELECT * FROM (SELECT DISTINCT seller_id, observation_date FROM {{d_{n}}}) JOIN (SELECT DISTINCT observation_date, week_idx FROM {{d_{n}}}) USING (observation_date)) g
  LEFT JOIN {{d_{n}}} v ON g.seller_id = v.seller_id AND g.observation_date = v.observation_date AND g.week_idx = v.week_idx)
  WINDOW ahead AS (PARTITION BY seller_id, observation_date ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    behind AS (PARTITION BY seller_id, observation_date ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
        for n, value, default in (
            ("volume", "y", "0"),
            ("dispatch", "last_value(y IGNORE NULLS) OVER ahead, first_value(y IGNORE NULLS) OVER behind", "0"),
            ("review", "last_value(y IGNORE NULLS) OVER ahead, first_value(y IGNORE NULLS) OVER behind", "5"),
        )
    },
    "d_slopes": """SELECT v.seller_id, v.observation_date, v.s AS order_volume_slope, coalesce(d.s, 0) AS dispatch_delay_slope, coalesce(r.s, 0) AS review_score_slope FROM
  (SELECT seller_id, observation_date, coalesce(regr_slope(y, x), 0) AS s FROM {d_volume_series} GROUP BY 1, 2) v
  LEFT JOIN (SELECT seller_id, observation_date, coalesce(regr_slope(y, x), 0) AS s FROM {d_dispatch_series} GROUP BY 1, 2) d USING (seller_id, observation_date)
  LEFT JOIN (SELECT seller_id, observation_date, coalesce(regr_slope(y, x), 0) AS s FROM {d_review_series} GROUP BY 1, 2) r USING (seller_id, observation_date)""",
    "d_features": """SELECT * FROM {d_tenure} JOIN {d_window_aggs} USING (seller_id, observation_date) JOIN {d_p50} USING (seller_id, observation_date)
  JOIN {d_active_weeks} USING (seller_id, observation_date) JOIN {d_slopes} USING (seller_id, observation_date)""",
    "d_active": """SELECT seller_id, observation_date FROM {d_master} JOIN {d_dates} ON order_purchase_timestamp >= observation_date - INTERVAL 60 DAY
  AND order_purchase_timestamp <= observation_date GROUP BY 1, 2 HAVING count(*) >= 3""",
    "d_future": """SELECT DISTINCT seller_id, observation_date FROM {d_master} JOIN {d_dates} ON order_purchase_timestamp >= observation_date + INTERVAL 1 DAY
  AND order_purchase_timestamp <= observation_date + INTERVAL 45 DAY""",
    "d_labels": """SELECT a.seller_id, a.observation_date, CASE WHEN f.seller_id IS NULL THEN 1 ELSE 0 END AS churned FROM {d_active} a
  LEFT JOIN {d_future} f ON a.seller_id = f.seller_id AND a.observation_date = f.observation_date""",
    "d_dataset": """SELECT * FROM {d_labels} JOIN {d_features} USING (seller_id, observation_date)""",
    "d_scored": """SELECT *, CASE WHEN churn_probability <= 3e-1 THEN 'GOOD' WHEN churn_probability <= 7e-1 THEN 'WARNING' ELSE 'CRITICAL' END AS risk_tier
  FROM (SELECT *, 1 / (1 + exp(-(""" + f"{CHURN_INTERCEPT!r}e0 + {_Z}" + """))) AS churn_probability FROM {d_dataset})""",
    "d_contributions": _CONTRIBUTIONS,
    "d_drivers": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seller_id, observation_date ORDER BY contribution DESC, feature) AS rank
  FROM {d_contributions} WHERE contribution > 0) WHERE rank <= 3""",
}


def ctes(text: str) -> list[str]:
    """Names of the views and results that a text reads, inputs first."""
    found: list[str] = []

    def visit(body: str) -> None:
        for name in _NAME.findall(body):
            inner = RESULTS.get(name) or VIEWS.get(name)
            if inner is None:
                if name not in BASE_TABLES:
                    raise KeyError(name)
                continue
            visit(inner)
            if name not in found:
                found.append(name)

    visit(text)
    return found


def plain(text: str) -> str:
    return _NAME.sub(lambda m: m.group(1), text).strip()
