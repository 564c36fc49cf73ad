"""Values that results depend on and that are given from outside."""

# Columns that identify each kind of uploaded table (first match wins, header in any case).
DATASET_COLUMNS = {
    "inventory": ["product_id", "current_stock", "safety_stock"],
    "sales": ["product_id", "daily_sales", "date"],
    "suppliers": ["supplier_id", "supplier_name", "lead_time_days"],
    "shipments": ["shipment_id", "supplier_id", "product_id", "actual_delivery"],
    "warehouses": ["warehouse_id", "warehouse_location", "capacity"],
}
GEO_COLUMNS = ["country", "state", "city", "latitude", "longitude", "lat", "lon"]
TIME_COLUMNS = ["date", "timestamp", "time", "year", "month"]
VALUE_COLUMNS = ["amount", "value", "price", "revenue", "cost"]

# Looser column sets of the schema check (header case matters).
EXPECTED_COLUMNS = {
    "inventory": ["product_id", "current_stock", "safety_stock"],
    "sales": ["product_id", "daily_sales"],
    "suppliers": ["supplier_id", "lead_time_days"],
    "shipments": ["shipment_id", "supplier_id", "product_id"],
    "warehouses": ["warehouse_id", "capacity"],
}

# Warehouse sites (id, latitude, longitude, name) and what an unknown site gets.
WAREHOUSE_SITES = [
    ("W1", 19.0760, 72.8777, "Mumbai Terminal"),
    ("W2", 28.6139, 77.2090, "Delhi Terminal"),
    ("W3", 13.0827, 80.2707, "Chennai Terminal"),
    ("W4", 35.6762, 139.6503, "Tokyo Hub"),
    ("W5", 34.6937, 135.5023, "Osaka Hub"),
    ("W6", 31.2304, 121.4737, "Shanghai Port"),
    ("W7", 50.1109, 8.6821, "Frankfurt Depot"),
    ("W8", 41.8781, -87.6298, "Chicago Center"),
]
UNKNOWN_SITE = (20.0, 78.0, "Unknown")

# Ready-made scenarios (name, delay days, demand change %, supplier capacity %, cost factor).
SCENARIO_PRESETS = [
    ("Port Disruption", 21.0, 0.0, 100.0, 1.0),
    ("Demand Surge", 0.0, 150.0, 100.0, 1.0),
    ("Factory Shutdown", 0.0, 0.0, 0.0, 1.0),
    ("Energy Crisis", 0.0, 0.0, 100.0, 2.5),
]

# Label texts of the analyst reports.
STOCK_HEALTH = ("OUT OF STOCK", "CRITICAL - Below Safety Stock", "WARNING - Needs Reorder", "HEALTHY")
STOCKOUT_TIMELINE = (
    "Immediate Action Required ( < 7 days)",
    "Short Term Risk ( < 14 days)",
    "Medium Term Planning ( < 30 days)",
    "Adequate Supply ( 30+ days )",
)
SUPPLIER_TIERS = ("Tier 1 - Excellent", "Tier 2 - Good", "Tier 3 - Needs Improvement", "Tier 4 - High Risk")

# Model inputs, in the order the feature vector has them.
DEMAND_FEATURES = [
    "inventory_days", "avg_delay_days", "warehouse_encoded", "stock_to_safety_ratio", "stock_to_reorder_ratio",
    "demand_volatility", "is_high_stock", "delay_risk", "total_delays", "total_spikes", "demand_spike_int",
    "excess_stock", "log_current_stock", "inventory_pressure",
]
SALES_FEATURES = [
    "product_enc", "day_of_week", "day_of_month", "month", "day_of_year", "is_weekend", "quarter",
    "lag_7", "lag_14", "lag_28", "roll_mean_7", "roll_mean_14", "roll_std_7", "roll_max_7", "roll_min_7",
]
DELAY_FEATURES = [
    "supplier_enc", "product_enc", "avg_supplier_delay", "std_supplier_delay", "supplier_late_ratio",
    "total_shipments", "reliability_score", "lead_time_days", "planned_transit_days", "shipment_weekday",
    "shipment_month",
]
SELLER_FEATURES = [
    "seller_tenure_days", "orders_30d", "rolling_30d_otd_rate", "rolling_30d_avg_review", "high_complaint_rate_30d",
    "revenue_at_risk_30d", "cancellation_rate_30d", "product_category_diversity", "dispatch_time_p50_7d",
    "seller_active_weeks", "order_volume_slope", "dispatch_delay_slope", "review_score_slope",
]

# Features that are compared between churned and surviving sellers, and columns that are correlated.
COMPARED_FEATURES = [
    "rolling_30d_otd_rate", "rolling_30d_avg_review", "dispatch_delay_slope", "review_score_slope", "cancellation_rate_30d",
    "high_complaint_rate_30d",
]
CORRELATED_COLUMNS = ["reliability_score", "lead_time_days", "delay_rate", "avg_delay_days", "delayed_shipments", "total_shipments"]

# The texts of stock messages, around the product's name and a number.
MESSAGE_NAME = "Product "
MESSAGE_STOCKOUT = (" will stockout in ", " days. Reorder immediately.")
MESSAGE_REORDER = (" reorder recommended. Quantity: ", ".")
MESSAGE_HEALTHY = " stock level healthy."
