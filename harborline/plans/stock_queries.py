"""Registered queries over stock, sales, suppliers and warehouses."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborline import fixed_values as fixed
from harborline.functions import columns
from harborline.operators import demand, inventory, ordering, reports, scenario, supplier, warehouse
from harborline.plans.registry import add
from harborline.plans.tables import Tables

# Rules on single rows.

add(
    "inventory_days",
    lambda t: inventory.inventory_days(t.inventory).select("product_id", "current_stock", "avg_daily_sales", "inventory_days"),
    "SELECT product_id, current_stock, avg_daily_sales, CASE WHEN avg_daily_sales > 0 THEN current_stock / avg_daily_sales ELSE 9999 END AS inventory_days FROM {v_inventory}",
    "inventory_days",
)
add(
    "stock_health_sql",
    lambda t: inventory.stock_health(t.inventory),
    """SELECT product_id, product_name, warehouse_id, current_stock, safety_stock, reorder_point, current_stock - safety_stock AS stock_buffer,
  CASE WHEN current_stock <= 0 THEN 'OUT OF STOCK' WHEN current_stock <= safety_stock THEN 'CRITICAL - Below Safety Stock'
    WHEN current_stock <= reorder_point THEN 'WARNING - Needs Reorder' ELSE 'HEALTHY' END AS inventory_health_status
FROM {v_inventory} ORDER BY stock_buffer, product_id""",
)
add(
    "stock_status_nb",
    lambda t: inventory.stock_status(t.inventory).select("product_id", "stock_status"),
    """SELECT product_id, CASE WHEN current_stock <= safety_stock THEN 'Critical' WHEN current_stock <= reorder_point THEN 'Reorder Needed' ELSE 'Healthy' END AS stock_status
FROM {v_inventory}""",
)
add(
    "supplier_tier_sql",
    lambda t: supplier.supplier_tier(t["v_orm_suppliers"]),
    """SELECT supplier_id, supplier_name, status, reliability_score, delay_rate, lead_time_days,
  CASE WHEN reliability_score >= 95 AND delay_rate < 5e-2 THEN 'Tier 1 - Excellent' WHEN reliability_score >= 85 AND delay_rate < 15e-2 THEN 'Tier 2 - Good'
    WHEN reliability_score >= 70 AND delay_rate < 25e-2 THEN 'Tier 3 - Needs Improvement' ELSE 'Tier 4 - High Risk' END AS supplier_tier
FROM {v_orm_suppliers}""",
)
add(
    "supplier_status",
    lambda t: supplier.supplier_status(t["v_orm_suppliers"]).select("supplier_id", "reliability_score", "supplier_status"),
    """SELECT supplier_id, reliability_score, CASE WHEN reliability_score > 85 THEN 'GOOD' WHEN reliability_score >= 60 THEN 'WARNING' ELSE 'CRITICAL' END AS supplier_status
FROM {v_orm_suppliers}""",
)
add(
    "supplier_risk_tier_nb",
    lambda t: t.supplier_board.select("supplier_id", "reliability_score", "delay_rate", "risk_tier"),
    "SELECT supplier_id, reliability_score, delay_rate, risk_tier FROM {d_board}",
    "delay_rate",
)
add(
    "supplier_composite_risk",
    lambda t: supplier.supplier_composite_risk(t.supplier_board).select("supplier_id", "composite_risk", "band"),
    """SELECT supplier_id, composite_risk, CASE WHEN composite_risk < 20 THEN 'SAFE' WHEN composite_risk < 35 THEN 'WATCH' WHEN composite_risk >= 35 THEN 'ALERT' END AS band
FROM (SELECT supplier_id, (1 - reliability_score) * 40 + delay_rate * 35 + lead_time_days / (SELECT max(lead_time_days) FROM {d_board}) * 25 AS composite_risk FROM {d_board})""",
    "composite_risk",
)
add(
    "warehouse_status",
    lambda t: t.warehouses.select("warehouse_id", "utilization_percent", "status"),
    "SELECT warehouse_id, utilization_percent, status FROM {d_warehouses}",
    "utilization_percent",
)
add(
    "health_score",
    lambda t: t.health,
    "SELECT * FROM {d_health}",
    "predicted_demand days_until_stockout",
)
add(
    "stockout_timeline_sql",
    lambda t: inventory.stockout_timeline(t.inventory, t["v_orm_forecasts"]),
    """SELECT i.product_id, i.product_name, i.current_stock, f.predicted_demand, f.avg_daily_sales, f.days_until_stockout, f.demand_spike, f.confidence_score,
  CASE WHEN f.days_until_stockout < 7 THEN 'Immediate Action Required ( < 7 days)' WHEN f.days_until_stockout < 14 THEN 'Short Term Risk ( < 14 days)'
    WHEN f.days_until_stockout < 30 THEN 'Medium Term Planning ( < 30 days)' ELSE 'Adequate Supply ( 30+ days )' END AS stockout_timeline
FROM {v_inventory} i JOIN {v_orm_forecasts} f ON i.product_id = f.product_id WHERE f.days_until_stockout < 30 OR f.demand_spike""",
    "days_until_stockout",
)
add("cost_impact", lambda t: t.cost, "SELECT * FROM {d_cost}", "stockout_cost total_cost_impact")
add(
    "reorder_quantity",
    lambda t: t.reorder.select("product_id", "supplier_lead_time", "reorder_quantity", "stockout_risk"),
    "SELECT product_id, supplier_lead_time, reorder_quantity, stockout_risk FROM {d_reorder}",
    "supplier_lead_time",
)
add("alert_message", lambda t: t.reorder.select("product_id", "alert_message"), "SELECT product_id, alert_message FROM {d_reorder}")
add(
    "stock_alerts",
    lambda t: inventory.stock_alerts(t.merged, F.lit("2024-01-31 00:00:00")),
    """SELECT product_id, warehouse_id, current_stock, round_even(inventory_days, 2) AS inventory_days,
  CASE WHEN inventory_days < 3 THEN 'CRITICAL' ELSE 'WARNING' END AS alert_level, '2024-01-31 00:00:00' AS timestamp FROM {d_merged} WHERE inventory_days <= 7""",
    "inventory_days",
)
add(
    "inventory_risk",
    lambda t: t.stock_risk.select(
        "product_id", "days_of_stock", "stockout_risk", "overstock_ratio", "is_overstock", "is_understocked", "annual_holding_cost"
    ),
    "SELECT product_id, days_of_stock, stockout_risk, overstock_ratio, is_overstock, is_understocked, annual_holding_cost FROM {d_stock_risk}",
    "days_of_stock stockout_risk overstock_ratio annual_holding_cost", 4,
)
add(
    "demand_model_features",
    lambda t: inventory.demand_model_features(t.merged).select("product_id", *fixed.DEMAND_FEATURES, "avg_daily_sales"),
    """SELECT product_id, inventory_days, avg_delay_days, CAST(dense_rank() OVER (ORDER BY warehouse_id) - 1 AS DOUBLE) AS warehouse_encoded,
  CASE WHEN safety_stock > 0 THEN current_stock / safety_stock ELSE current_stock END AS stock_to_safety_ratio,
  CASE WHEN reorder_point > 0 THEN current_stock / reorder_point ELSE current_stock END AS stock_to_reorder_ratio,
  CASE WHEN avg_daily_sales > 0 THEN stddev_daily_sales / avg_daily_sales ELSE 0 END AS demand_volatility,
  CASE WHEN current_stock > reorder_point THEN 1 ELSE 0 END AS is_high_stock, CASE WHEN avg_delay_days > 2 THEN 1 ELSE 0 END AS delay_risk,
  total_delays, total_spikes, CASE WHEN demand_spike THEN 1 ELSE 0 END AS demand_spike_int, current_stock - safety_stock AS excess_stock,
  ln(1 + greatest(current_stock, 0)) AS log_current_stock, safety_stock / (current_stock + 1) AS inventory_pressure, avg_daily_sales FROM {d_merged}""",
    " ".join([*fixed.DEMAND_FEATURES, "avg_daily_sales"]),
)
add(
    "stockout_forecast",
    lambda t: t.forecast.select("product_id", "current_stock", "predicted_demand", "days_until_stockout"),
    "SELECT product_id, current_stock, predicted_demand, days_until_stockout FROM {d_forecast}",
    "predicted_demand days_until_stockout",
)
add(
    "baseline_forecast",
    lambda t: inventory.baseline_forecast(t.inventory),
    """SELECT product_id, round_even(greatest(1e0, current_stock * 1e-1), 2) AS predicted_demand, round_even(greatest(1e-1, current_stock * 2e-2), 2) AS avg_daily_sales,
  FALSE AS demand_spike, round_even(current_stock / greatest(1e0, current_stock * 2e-2), 2) AS days_until_stockout, 8e-1 AS confidence_score, 'v1.0' AS model_version
FROM {v_inventory}""",
    "predicted_demand avg_daily_sales days_until_stockout",
)
add(
    "shipment_calendar",
    lambda t: supplier.shipment_calendar(t.shipments).select(
        "shipment_id", "product_id", "shipment_weekday", "shipment_month", "planned_transit_days"
    ),
    """SELECT shipment_id, product_id, CAST(isodow(shipment_date) AS INT) AS shipment_weekday, CAST(month(shipment_date) AS INT) AS shipment_month,
  CAST(expected_delivery - shipment_date AS INT) AS planned_transit_days FROM {v_shipments}""",
)
add(
    "shipment_delay",
    lambda t: supplier.shipment_delay(t.shipments).select("shipment_id", "product_id", "expected_delivery", "actual_delivery", "delay_days"),
    "SELECT shipment_id, product_id, expected_delivery, actual_delivery, delay_days FROM {d_deliveries}",
)
add(
    "scenario_whatif",
    lambda t: scenario.scenario_whatif(t.reorder).select(
        "product_id", "scenario", "sim_delay_days", "sim_demand", "sim_days_until_stockout", "sim_financial_impact"
    ),
    "SELECT product_id, scenario, sim_delay_days, sim_demand, sim_days_until_stockout, sim_financial_impact FROM {d_simulated}",
    "sim_delay_days sim_demand sim_days_until_stockout sim_financial_impact", 4,
)
add(
    "scenario_presets",
    lambda t: scenario.scenario_presets(t.spark).join(
        scenario.scenario_totals(scenario.scenario_whatif(t.reorder)).withColumnRenamed("scenario", "name"), "name"
    ),
    """SELECT s.scenario AS name, s.delay AS delay_days, s.spike AS demand_spike, s.capacity AS supplier_capacity, s.cost AS cost_multiplier,
  sum(d.sim_financial_impact) AS total_impact, avg(d.sim_days_until_stockout) AS avg_days, count(*) FILTER (WHERE d.sim_days_until_stockout < 7) AS short_products
FROM {d_scenarios} s JOIN {d_simulated} d ON s.scenario = d.scenario GROUP BY ALL""",
    "total_impact avg_days", 3,
)
add(
    "status_multi_filter",
    lambda t: inventory.status_in(t.health, "health_status", ["WARNING", "CRITICAL"]),
    "SELECT * FROM {d_health} WHERE health_status IN ('WARNING', 'CRITICAL')",
    "predicted_demand days_until_stockout",
)

# Joins.

MERGED = "avg_daily_sales total_daily_sales stddev_daily_sales avg_delay_days inventory_days"
add(
    "join_supply_chain",
    lambda t: t.merged.select(
        "product_id", "warehouse_id", "current_stock", *MERGED.split(), "total_spikes", "demand_spike", "total_delays"
    ),
    f"SELECT product_id, warehouse_id, current_stock, {', '.join(MERGED.split())}, total_spikes, demand_spike, total_delays FROM {{d_merged}}",
    MERGED,
)
add(
    "join_lead_time",
    lambda t: inventory.join_lead_time(t.shipments, t.suppliers),
    "SELECT * FROM {d_lead}",
    "supplier_lead_time",
)
add(
    "join_reorder",
    lambda t: inventory.join_reorder(
        t["v_orm_forecasts"], inventory.join_lead_time(t.deliveries, t.suppliers)
    ),
    """SELECT f.*, coalesce(l.lead, 7) AS supplier_lead_time FROM {v_orm_forecasts} f LEFT JOIN (SELECT d.product_id, avg(s.lead_time_days) AS lead
  FROM {d_deliveries} d LEFT JOIN {v_suppliers} s ON d.supplier_id = s.supplier_id GROUP BY 1) l ON f.product_id = l.product_id""",
    "supplier_lead_time days_until_stockout",
)
add(
    "join_warehouse",
    lambda t: warehouse.join_warehouse(t["v_warehouses"], t.inventory),
    """SELECT w.*, coalesce(s.n, 0) AS total_stock FROM {v_warehouses} w LEFT JOIN (SELECT warehouse_id, sum(current_stock) AS n FROM {v_inventory}
  GROUP BY 1) s ON w.warehouse_id = s.warehouse_id""",
    "total_stock",
)
add(
    "join_inventory_demand",
    lambda t: inventory.join_inventory_demand(t.inventory, demand.demand_rolling(t.stored_sales)).select(
        "product_id", "avg_daily_sales", "avg_demand_30d", "demand_std"
    ),
    "SELECT product_id, avg_daily_sales, avg_demand_30d, demand_std FROM {d_inventory_demand}",
    "avg_demand_30d demand_std",
)
PROFILE = "avg_supplier_delay std_supplier_delay supplier_late_ratio"
add(
    "join_profile_back",
    lambda t: supplier.join_profile_back(t.deliveries, supplier.supplier_profile(t.deliveries)).select(
        "shipment_id", "product_id", "supplier_id", "delay_days", *PROFILE.split()
    ),
    f"SELECT d.shipment_id, d.product_id, d.supplier_id, d.delay_days, {', '.join(PROFILE.split())} FROM {{d_deliveries}} d JOIN {{d_profile}} p ON d.supplier_id = p.supplier_id",
    PROFILE,
)
add(
    "join_supplier_metrics",
    lambda t: supplier.join_supplier_metrics(t.suppliers, supplier.supplier_metrics(t.shipments)),
    "SELECT u.*, m.* EXCLUDE (supplier_id) FROM {v_suppliers} u LEFT JOIN {d_metrics} m ON u.supplier_id = m.supplier_id",
    "avg_delay_days delay_rate",
)
add(
    "join_health_reorder",
    lambda t: inventory.join_health_reorder(
        t.health, t.reorder.select("product_id", "reorder_quantity", "supplier_lead_time", "stockout_risk", "alert_message")
    ),
    "SELECT h.*, r.supplier_lead_time, r.stockout_risk, r.alert_message FROM {d_health} h LEFT JOIN {d_reorder} r ON h.product_id = r.product_id",
    "predicted_demand days_until_stockout supplier_lead_time",
)
add(
    "join_health_location",
    lambda t: inventory.join_health_location(t.health, t.inventory).select(
        "product_id", "health_status", "warehouse_id", "lat", "lon", "location_name"
    ),
    """SELECT h.product_id, h.health_status, i.warehouse_id, coalesce(s.lat, 20e0) AS lat, coalesce(s.lon, 78e0) AS lon, coalesce(s.name, 'Unknown') AS location_name
FROM {d_health} h LEFT JOIN {v_inventory} i ON h.product_id = i.product_id LEFT JOIN (VALUES """
    + ", ".join(f"('{w}', {la!r}e0, {lo!r}e0, '{n}')" for w, la, lo, n in fixed.WAREHOUSE_SITES)
    + ") AS s(warehouse_id, lat, lon, name) ON i.warehouse_id = s.warehouse_id",
)
add(
    "demand_join_sql",
    lambda t: inventory.demand_join(t.inventory, t["v_orm_forecasts"]),
    """SELECT i.product_id, i.product_name, i.current_stock, f.predicted_demand, f.avg_daily_sales, f.days_until_stockout, f.demand_spike, f.confidence_score
FROM {v_inventory} i JOIN {v_orm_forecasts} f ON i.product_id = f.product_id""",
    "days_until_stockout",
)
add(
    "alerts_join_sql",
    lambda t: reports.open_alerts(t.inventory, t["v_orm_alerts"]),
    """SELECT i.product_id, i.product_name, i.warehouse_id, a.id, a.alert_type, a.severity, a.is_acknowledged
FROM {v_inventory} i JOIN {v_orm_alerts} a ON i.product_id = a.product_id""",
)
add(
    "reorder_supplier_sql",
    lambda t: supplier.reorder_supplier(t["v_orm_reorders"], t["v_orm_suppliers"]),
    """SELECT r.product_id, r.reorder_quantity, r.stockout_risk, r.priority, r.supplier_lead_time, s.supplier_name, s.status AS supplier_status, s.reliability_score,
  s.delay_rate, r.supplier_lead_time * (1 + s.delay_rate) AS adjusted_expected_lead_time FROM {v_orm_reorders} r LEFT JOIN {v_orm_suppliers} s ON r.primary_supplier_id = s.supplier_id
WHERE r.stockout_risk AND (s.status = 'AT_RISK' OR s.delay_rate > 3e-1) ORDER BY r.priority DESC, adjusted_expected_lead_time DESC, r.product_id LIMIT 50""",
    "adjusted_expected_lead_time",
)
add(
    "semi_top_products",
    lambda t: demand.semi_top_products(t.sales),
    "SELECT * FROM {v_sales} WHERE product_id IN (SELECT product_id FROM {v_sales} GROUP BY 1 ORDER BY sum(daily_sales) DESC, product_id LIMIT 3)",
)

# Aggregates.

add("sales_agg", lambda t: demand.sales_agg(t.sales), "SELECT * FROM {d_sales_agg}", "avg_daily_sales stddev_daily_sales")
add("spike_counts", lambda t: demand.spike_counts(demand.demand_spike(t.stored_sales)), "SELECT * FROM {d_spike_counts}")
add("shipment_agg", lambda t: inventory.shipment_agg(t.shipments), "SELECT * FROM {d_shipment_agg}", "avg_delay_days")
add(
    "supplier_performance", lambda t: t.performance, "SELECT * FROM {d_performance}", "average_delay reliability_score delay_rate"
)
add(
    "supplier_features",
    lambda t: supplier.supplier_features(t.deliveries),
    "SELECT * FROM {d_supplier_features}",
    "avg_delay_days on_time_rate avg_defect_units total_spend avg_order_value", 4,
)
add(
    "supplier_recent_90d", lambda t: supplier.supplier_recent(t.deliveries), "SELECT * FROM {d_recent}", "recent_90d_on_time_rate"
)
add(
    "supplier_risk_score",
    lambda t: supplier.supplier_feature_table(t.deliveries).select(
        "supplier_id", "on_time_rate", "recent_90d_on_time_rate", "supplier_risk_score", "risk_tier"
    ),
    """SELECT s.supplier_id, s.on_time_rate, r.recent_90d_on_time_rate, s.supplier_risk_score, s.risk_tier
FROM {d_supplier_score} s LEFT JOIN {d_recent} r ON s.supplier_id = r.supplier_id""",
    "on_time_rate recent_90d_on_time_rate supplier_risk_score",
)
add("supplier_metrics_nb", lambda t: supplier.supplier_metrics(t.shipments), "SELECT * FROM {d_metrics}", "avg_delay_days delay_rate")
add("supplier_profile", lambda t: supplier.supplier_profile(t.deliveries), "SELECT * FROM {d_profile}", PROFILE)
add("warehouse_utilization", lambda t: t.warehouses, "SELECT * FROM {d_warehouses}", "utilization_percent")
add(
    "warehouse_stock_share",
    lambda t: warehouse.warehouse_stock_share(t.inventory),
    "SELECT warehouse_id, sum(current_stock) AS current_stock FROM {v_inventory} GROUP BY 1",
)
add(
    "global_risk_summary",
    lambda t: reports.global_risk_summary(
        t.spark, inventory.health_score(t.stored_reorder), t.performance, t.warehouses, inventory.cost_impact(t.stored_forecast)
    ),
    """SELECT (SELECT count(*) FROM {d_health} WHERE health_status = 'CRITICAL') AS critical_products, (SELECT count(*) FROM {d_performance} WHERE supplier_status = 'CRITICAL') AS unreliable_suppliers,
  (SELECT count(*) FROM {d_warehouses} WHERE status = 'HIGH') AS overloaded_warehouses, (SELECT count(*) FROM {d_cost} WHERE total_cost_impact > 500) AS high_cost_products""",
)
add(
    "kpi_summary",
    lambda t: reports.kpi_summary(t.stored_forecast, t.stored_reorder),
    """SELECT count(DISTINCT product_id) AS total_products, (SELECT count(DISTINCT product_id) FROM {d_reorder} WHERE stockout_risk) AS at_risk,
  avg(inventory_days) AS avg_inventory_days, (SELECT sum(reorder_quantity) FROM {d_reorder}) AS total_reorder_qty FROM {d_forecast}""",
    "avg_inventory_days total_reorder_qty",
)
add(
    "executive_summary",
    lambda t: reports.executive_summary(inventory.health_score(t.stored_reorder), inventory.cost_impact(t.stored_forecast)),
    """SELECT count(*) AS total_products, count(*) FILTER (WHERE health_status = 'CRITICAL') AS critical, count(*) FILTER (WHERE health_status = 'WARNING') AS warning,
  avg(health_score) AS avg_health_score, (SELECT sum(total_cost_impact) FROM {d_cost}) AS total_exposure FROM {d_health}""",
    "avg_health_score total_exposure", 4,
)
add(
    "cost_totals",
    lambda t: reports.cost_totals(t.cost),
    "SELECT sum(inventory_holding_cost) AS holding, sum(stockout_cost) AS stockout, sum(total_cost_impact) AS exposure FROM {d_cost}",
    "holding stockout exposure", 4,
)
add(
    "inventory_summary",
    lambda t: reports.inventory_summary(t.stock_risk),
    "SELECT count(*) FILTER (WHERE stockout_risk > 5e-1) AS critical, CAST(sum(is_overstock) AS BIGINT) AS overstocked FROM {d_stock_risk}",
)
add(
    "reorder_summary",
    lambda t: reports.reorder_summary(t.reorder),
    "SELECT count(*) AS items, count(*) FILTER (WHERE stockout_risk) AS at_risk, count(*) FILTER (WHERE reorder_quantity > 0) AS reorders FROM {d_reorder}",
)
add(
    "forecast_summary",
    lambda t: reports.forecast_summary(t.forecast),
    "SELECT count(*) AS predictions, avg(predicted_demand) AS avg_predicted_demand, avg(days_until_stockout) AS avg_days_until_stockout FROM {d_forecast}",
    "avg_predicted_demand avg_days_until_stockout",
)
add(
    "low_reliability_share",
    lambda t: reports.low_reliability_share(t.suppliers),
    "SELECT count(*) FILTER (WHERE reliability_score < 75e-2) AS suppliers, avg(CASE WHEN reliability_score < 75e-2 THEN 1e0 ELSE 0e0 END) AS share FROM {v_suppliers}",
    "share",
)
add(
    "risk_ranking_sql",
    lambda t: reports.risk_ranking(t.inventory, t["v_orm_alerts"]),
    """SELECT i.product_id, i.product_name, i.warehouse_id, count(a.id) AS total_active_alerts, count(*) FILTER (WHERE a.severity = 'CRITICAL') AS critical_alerts,
  count(*) FILTER (WHERE a.severity = 'WARNING') AS warning_alerts, string_agg(DISTINCT a.alert_type, ',' ORDER BY a.alert_type) AS alert_types
FROM {v_inventory} i JOIN {v_orm_alerts} a ON i.product_id = a.product_id WHERE NOT a.is_acknowledged GROUP BY 1, 2, 3 HAVING count(a.id) > 0""",
)
add("daily_sales_stats", lambda t: demand.daily_sales_stats(t.sales), "SELECT * FROM {d_daily_stats}", "avg_sales std_sales")
add("daily_total", lambda t: demand.daily_total(t.sales), "SELECT * FROM {d_daily}")
add(
    "product_day_agg",
    lambda t: demand.product_day_agg(t.sales),
    "SELECT product_id, date, sum(daily_sales) AS y FROM {v_sales} GROUP BY 1, 2",
)
add(
    "sales_cv",
    lambda t: demand.sales_cv(demand.daily_total(t.sales)),
    """SELECT avg(total_sales) AS mean_sales, (SELECT date FROM {d_daily} ORDER BY total_sales DESC, date LIMIT 1) AS peak_date, max(total_sales) AS peak_sales,
  stddev_samp(total_sales) / avg(total_sales) AS cv FROM {d_daily}""",
    "mean_sales cv",
)
add(
    "status_distribution",
    lambda t: reports.status_distribution(t.health, "health_status"),
    "SELECT health_status AS status, count(*) AS n FROM {d_health} GROUP BY 1",
)
add(
    "status_lead_time",
    lambda t: reports.status_mean(t.supplier_board, "risk_tier", "lead_time_days", "avg_lead_time"),
    "SELECT risk_tier AS status, avg(lead_time_days) AS avg_lead_time FROM {d_board} GROUP BY 1",
    "avg_lead_time",
)

# Windows over sales.

add(
    "demand_spike",
    lambda t: demand.demand_spike(t.stored_sales),
    "SELECT * FROM {d_spikes}",
    "rolling_avg",
)
BRAND = {
    "demand_lags": "lag_7 lag_14 lag_30",
    "demand_rolling": "roll_7_mean roll_30_mean roll_7_std roll_90_mean",
    "demand_pct_change": "mom_change yoy_change",
}
for _key, _cols in BRAND.items():
    add(
        _key,
        lambda t, f=getattr(demand, _key): f(t.brand_sales),
        f"SELECT product_id, date, daily_sales, {', '.join(_cols.split())} FROM {{d_brand}}",
        _cols,
    )
add(
    "demand_features",
    lambda t: demand.demand_features(t.brand_sales),
    """SELECT *, CAST(isodow(date) - 1 AS INT) AS day_of_week, CAST(month(date) AS INT) AS month, CAST(quarter(date) AS INT) AS quarter,
  CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN last_day(date) = date THEN 1 ELSE 0 END AS is_month_end FROM {d_brand}""",
    " ".join(BRAND.values()),
)
FORECAST = "y lag_7 lag_14 lag_28 roll_mean_7 roll_mean_14 roll_std_7 roll_max_7 roll_min_7"
add(
    "forecast_features_nb",
    lambda t: demand.forecast_features(demand.product_day_agg(t.brand_sales)).withColumn("product_enc", F.col("product_enc").cast("bigint")),
    """SELECT f.*, e.product_enc FROM {d_forecast_rows} f JOIN (SELECT product_id, dense_rank() OVER (ORDER BY product_id) - 1 AS product_enc
  FROM (SELECT DISTINCT product_id FROM {v_sales_brand})) e ON f.product_id = e.product_id""",
    FORECAST,
)
add(
    "smoothed_sales",
    lambda t: demand.smoothed_sales(
        demand.semi_top_products(t.brand_sales).select("product_id", "date", F.col("daily_sales").alias("total_sales")).unionByName(
            demand.daily_total(t.sales).select(F.lit("ALL").alias("product_id"), "date", "total_sales")
        ),
        "total_sales", keys=["product_id"],
    ),
    """SELECT product_id, date, total_sales, avg(total_sales) OVER (PARTITION BY product_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma FROM (
  SELECT 'ALL' AS product_id, date, total_sales FROM {d_daily} UNION ALL SELECT product_id, date, daily_sales FROM {v_sales_brand} WHERE product_id IN
    (SELECT product_id FROM {v_sales_brand} GROUP BY 1 ORDER BY sum(daily_sales) DESC, product_id LIMIT 3))""",
    "ma",
)
add(
    "latest_nonnull",
    lambda t: ordering.latest_nonnull(demand.demand_pct_change(t.brand_sales), ["product_id"], "date", ["mom_change", "yoy_change"]),
    """SELECT product_id, arg_max(mom_change, date) FILTER (WHERE mom_change IS NOT NULL) AS mom_change,
  arg_max(yoy_change, date) FILTER (WHERE yoy_change IS NOT NULL) AS yoy_change FROM {d_brand} GROUP BY 1""",
    "mom_change yoy_change",
)
add(
    "label_encode",
    lambda t: ordering.label_encode(t.shipments.select("shipment_id", "product_id", "supplier_id"), "supplier_id"),
    """SELECT shipment_id, product_id, s.supplier_id, e.code AS supplier_id_enc FROM {v_shipments} s JOIN (SELECT supplier_id, dense_rank() OVER (ORDER BY supplier_id) - 1 AS code
  FROM (SELECT DISTINCT supplier_id FROM {v_shipments})) e ON s.supplier_id = e.supplier_id""",
)

# Top lists.

add(
    "top_products",
    lambda t: demand.top_products(t.sales),
    "SELECT product_id, sum(daily_sales) AS total FROM {v_sales} GROUP BY 1 ORDER BY total DESC, product_id LIMIT 3",
)
add(
    "top_demand",
    lambda t: reports.top_demand(t.forecast),
    "SELECT product_id, predicted_demand FROM {d_forecast} ORDER BY predicted_demand DESC, product_id LIMIT 15",
    "predicted_demand",
)
add(
    "worst_suppliers",
    lambda t: reports.worst_suppliers(t.supplier_board).select("supplier_id", "supplier_name", "delay_rate"),
    "SELECT supplier_id, supplier_name, delay_rate FROM {d_board} ORDER BY delay_rate DESC, supplier_id LIMIT 3",
    "delay_rate",
)
add(
    "supplier_league",
    lambda t: reports.supplier_league(t.performance),
    "SELECT supplier_id, reliability_score, delay_rate FROM {d_performance} ORDER BY reliability_score DESC, supplier_id LIMIT 5",
    "reliability_score delay_rate",
)
add(
    "critical_products",
    lambda t: reports.critical_products(t.health),
    "SELECT product_id, current_stock, days_until_stockout FROM {d_health} WHERE health_status = 'CRITICAL' ORDER BY days_until_stockout, product_id LIMIT 5",
    "days_until_stockout",
)
add(
    "urgent_actions",
    lambda t: reports.urgent_actions(t.reorder),
    "SELECT product_id, alert_message FROM {d_reorder} WHERE stockout_risk ORDER BY days_until_stockout, product_id LIMIT 5",
)
add(
    "reorder_list",
    lambda t: inventory.reorder_list(t.reorder),
    "SELECT product_id, reorder_quantity, alert_message FROM {d_reorder} WHERE reorder_quantity > 0",
)
add(
    "alert_history",
    lambda t: reports.alert_history(t["v_orm_alerts"]),
    "SELECT * FROM {v_orm_alerts} WHERE severity IN ('CRITICAL', 'WARNING') ORDER BY created_at DESC, id DESC LIMIT 10",
)
add(
    "scenario_melt",
    lambda t: scenario.scenario_melt(scenario.scenario_whatif(t.reorder)).select(
        "product", F.col("case"), "scenario", "days_until_stockout"
    ),
    """SELECT product_id AS product, scenario AS case, 'Before' AS scenario, days_until_stockout FROM {d_simulated}
UNION ALL SELECT product_id, scenario, 'After', sim_days_until_stockout FROM {d_simulated}""".replace(" AS case", ' AS "case"'),
    "days_until_stockout",
)

# Text and calendar functions.

add(
    "fn_supplier_short_name",
    lambda t: t["part"].select(
        F.col("p_partkey").alias("part"), columns.short_name(F.concat_ws("  ", "p_name", "p_type", "p_brand")).alias("short_name")
    ),
    "SELECT p_partkey AS part, array_to_string(list_slice(regexp_split_to_array(trim(p_name || '  ' || p_type || '  ' || p_brand), '\\s+'), 1, 2), ' ') AS short_name FROM {part}",
)
add(
    "fn_calendar",
    lambda t: t.sales.select("product_id", "date", "region").withColumns(columns.calendar("date")).withColumns(
        {f"iso_{n}": c for n, c in columns.iso_calendar("date").items()}
    ),
    """SELECT product_id, date, region, CAST(isodow(date) - 1 AS INT) AS day_of_week, CAST(month(date) AS INT) AS month, CAST(quarter(date) AS INT) AS quarter,
  CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend, CASE WHEN last_day(date) = date THEN 1 ELSE 0 END AS is_month_end, CAST(isodow(date) AS INT) AS iso_day_of_week,
  CAST(day(date) AS INT) AS iso_day_of_month, CAST(month(date) AS INT) AS iso_month, CAST(dayofyear(date) AS INT) AS iso_day_of_year,
  CASE WHEN isodow(date) >= 5 THEN 1 ELSE 0 END AS iso_is_weekend, CAST(quarter(date) AS INT) AS iso_quarter FROM {v_sales}""",
)
add(
    "fn_feature_title",
    lambda t: t["part"].select(
        F.col("p_partkey").alias("part"), columns.feature_title(F.concat_ws("_", F.translate("p_name", " ", "_"), F.concat("p_size", F.lit("d")), "p_type")).alias("title")
    ),
    """SELECT p_partkey AS part, array_to_string(list_transform(chars, lambda c, i: CASE WHEN i > 1 AND regexp_matches(chars[i - 1], '[A-Za-z]') THEN lower(c) ELSE upper(c) END), '') AS title
FROM (SELECT p_partkey, string_split(replace(replace(p_name, ' ', '_') || '_' || p_size || 'd_' || p_type, '_', ' '), '') AS chars FROM {part})""",
)
add(
    "fn_lenient_parse",
    lambda t: t["documents"].select(
        "doc_id",
        columns.lenient_number(F.regexp_extract("text", r"(\S+)", 1)).alias("first_number"),
        columns.lenient_date(F.regexp_extract("text", r"([0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9])", 1)).alias("first_date"),
        columns.lenient_number(F.when(F.col("n_chars") > 500, F.col("n_chars").cast("string")).otherwise(F.col("source"))).alias("long_chars"),
    ),
    r"""SELECT doc_id, TRY_CAST(regexp_extract(text, '(\S+)', 1) AS DOUBLE) AS first_number, TRY_CAST(regexp_extract(text, '([0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9])', 1) AS DATE) AS first_date,
  TRY_CAST(CASE WHEN n_chars > 500 THEN CAST(n_chars AS VARCHAR) ELSE source END AS DOUBLE) AS long_chars FROM {documents}""",
    "first_number long_chars",
)

# Stock policy.


def _with_moq(t: Tables):
    return t.stock_risk.withColumn("moq", F.col("safety_stock"))


add(
    "safety_stock",
    lambda t: inventory.safety_stock(t.stock_risk).select("product_id", "safety_stock_level"),
    "SELECT product_id, 165e-2 * demand_std * sqrt(lead_time_days) AS safety_stock_level FROM {d_stock_risk}",
    "safety_stock_level",
)
add(
    "reorder_trigger",
    lambda t: inventory.reorder_trigger(t.stock_risk).select("product_id", "forecast_14d", "needs_reorder"),
    "SELECT product_id, avg_demand_30d * 14 AS forecast_14d, current_stock < 12e-1 * (avg_demand_30d * 14) AS needs_reorder FROM {d_stock_risk}",
    "forecast_14d",
)
add(
    "moq_order",
    lambda t: inventory.moq_order(_with_moq(t)).select("product_id", "moq", "order_quantity"),
    "SELECT product_id, safety_stock AS moq, ceil(avg_demand_30d * 14 / safety_stock) * safety_stock AS order_quantity FROM {d_stock_risk}",
    "order_quantity",
)
add(
    "eoq",
    lambda t: inventory.eoq(t.stock_risk).select("product_id", "eoq"),
    "SELECT product_id, sqrt(2 * (avg_demand_30d * 365) * ordering_cost / (unit_cost * holding_cost_rate)) AS eoq FROM {d_stock_risk}",
    "eoq",
)
add(
    "daily_report_row",
    lambda t: reports.daily_report_row(
        t.health, t.cost, t.performance, columns.total_of(t.sales, F.max("date"))
    ),
    """SELECT (SELECT max(date) FROM {v_sales}) AS report_date, (SELECT count(*) FROM {d_health} WHERE health_status = 'CRITICAL') AS critical_products_count,
  (SELECT product_id FROM {d_health} WHERE health_status = 'CRITICAL' ORDER BY days_until_stockout, product_id LIMIT 1) AS top_critical_item,
  (SELECT product_id FROM {d_cost} ORDER BY total_cost_impact DESC, product_id LIMIT 1) AS top_cost_impact_item,
  (SELECT supplier_id FROM {d_performance} ORDER BY reliability_score, supplier_id LIMIT 1) AS worst_supplier""",
)
