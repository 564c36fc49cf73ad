"""Registered queries for streams, model fits and whole jobs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from harborline import fixed_values as fixed
from harborline.operators import demand, modeling, ordering, quality, sampling, saved_models, sellers, supplier
from harborline.plans import jobs
from harborline.plans.registry import add
from harborline.plans.tables import SELLER_KEYS, Tables
from harborline.session import fresh_path, stored
from harborline.sources.versions import VersionedTable
from harborline.streaming import stock

TEST_FROM = date(1999, 1, 1)

# Streams: the events are laid out as a folder of files, a stream runs over it to its end, its table is read.


def _event_records(t: Tables) -> str:
    """The events as lines of JSON, and behind each event of quantity 0 or less a line that is torn in the middle."""
    folder = fresh_path(t.spark, "events")
    line = F.to_json(F.struct("*"), {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    torn = F.when(F.col("quantity") <= 0, line.substr(F.lit(1), F.length(line) - 12))
    t["v_live"].select(F.explode(F.array_compact(F.array(line, torn))).alias("value")).write.text(folder)
    return folder


def _event_stream(t: Tables) -> DataFrame:
    return stock.stream_source(t.spark, "text", path=_event_records(t))


def _split_events(t: Tables) -> DataFrame:
    """How many records of each change type are events, and how many are quarantined."""
    spark, events, bad = t.spark, fresh_path(t.spark, "live"), fresh_path(t.spark, "quarantine")
    records = spark.readStream.format("text").load(_event_records(t))
    stock.events_and_quarantine(records, events, bad, fresh_path(spark, "progress")).awaitTermination()
    good = spark.read.parquet(events).groupBy("change_type").agg(F.count("*").alias("records")).withColumn("reason", F.lit(None).cast("string"))
    # A torn record still names its change type.
    kind = F.regexp_extract("text", '"change_type":"([^"]*)"', 1)
    torn = spark.read.parquet(bad).groupBy(kind.alias("change_type"), "reason").agg(F.count("*").alias("records"))
    return good.unionByName(torn.select("change_type", "records", "reason"))


def _window_table(t: Tables) -> DataFrame:
    """All windows of the events, open ones too, from a table that every batch merged into."""
    table = VersionedTable(t.spark, fresh_path(t.spark, "windows"))
    stream = stock.stream_metrics(_event_stream(t), t.inventory)
    stock.keep_windows(stream, table, stock.WINDOW_KEY, fresh_path(t.spark, "progress"), "stock").awaitTermination()
    return table.read().withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def _finished(stream: DataFrame, *times: str) -> DataFrame:
    spark = stream.sparkSession
    out = stock.run_to_end(stream, fresh_path(spark, "out"), fresh_path(spark, "progress"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


def _stock_stream(t: Tables) -> DataFrame:
    """Events as live stock rows: the stock of the product against the quantity of the event."""
    stock_now = t.inventory.select("product_id", "current_stock")
    days = F.try_divide("current_stock", "quantity")
    return _event_stream(t).join(stock_now, "product_id").withColumn("inventory_days", days)


def _alert_table(t: Tables) -> DataFrame:
    """One row for each alert that the stream lets out, with the earliest of its window and how often it came."""
    alerts = stock.stream_alerts(_stock_stream(t), F.col("timestamp"))
    let_out = _finished(stock.stream_dedup(alerts)).select(*stock.ALERT_KEY)
    table = VersionedTable(t.spark, fresh_path(t.spark, "alerts"))
    stock.keep_windows(stock.alert_repeats(alerts), table, stock.ALERT_KEY, fresh_path(t.spark, "progress"), "alerts").awaitTermination()
    if table.version() is None:  # no event, so no batch
        return t.spark.createDataFrame([], stock.alert_repeats(alerts).schema)
    found = ordering.join_on(table.read(), let_out, stock.ALERT_KEY)
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end", "timestamp")})


LIVE_ALERTS = """SELECT l.product_id, l.warehouse_id, i.current_stock, round_even(i.current_stock / nullif(l.quantity, 0), 2) AS inventory_days,
  CASE WHEN i.current_stock / nullif(l.quantity, 0) < 3 THEN 'CRITICAL' ELSE 'WARNING' END AS alert_level, l.timestamp
FROM {v_live} l JOIN {v_inventory} i ON l.product_id = i.product_id WHERE i.current_stock / nullif(l.quantity, 0) <= 7"""

add("stream_source", lambda t: _finished(_event_stream(t), "timestamp"), "SELECT * FROM {v_live}")
add(
    "stream_metrics",
    _window_table,
    """SELECT w.*, i.current_stock / nullif(w.moving_avg_demand, 0) AS days_until_stockout, CASE WHEN i.current_stock / nullif(w.moving_avg_demand, 0) < 3 THEN 'CRITICAL'
    WHEN i.current_stock / nullif(w.moving_avg_demand, 0) <= 7 THEN 'WARNING' ELSE 'GOOD' END AS health_status FROM (
  SELECT date_trunc('day', l.timestamp) - k * INTERVAL 1 DAY AS window_start, date_trunc('day', l.timestamp) - k * INTERVAL 1 DAY + INTERVAL 7 DAY AS window_end, product_id, warehouse_id,
    avg(quantity) AS moving_avg_demand, stddev_samp(quantity) / nullif(avg(quantity), 0) AS demand_volatility FROM {v_live} l, (SELECT unnest(range(7)) AS k) GROUP BY 1, 2, 3, 4) w
JOIN {v_inventory} i ON w.product_id = i.product_id""",
    "moving_avg_demand demand_volatility days_until_stockout",
)
add("stream_alerts", lambda t: _finished(stock.stream_alerts(_stock_stream(t), F.col("timestamp")), "timestamp"), LIVE_ALERTS, "inventory_days")
add(
    "stream_dedup",
    _alert_table,
    f"""SELECT date_trunc('day', timestamp) AS window_start, date_trunc('day', timestamp) + INTERVAL 1 DAY AS window_end, product_id, warehouse_id, alert_level,
  min(timestamp) AS timestamp, first(inventory_days ORDER BY timestamp, inventory_days, current_stock) AS inventory_days,
  first(current_stock ORDER BY timestamp, inventory_days, current_stock) AS current_stock, count(*) AS repeats
FROM ({LIVE_ALERTS}) GROUP BY 1, 2, 3, 4, 5""",
    "inventory_days",
)
add(
    "stream_quarantine",
    _split_events,
    """SELECT change_type, count(*) AS records, NULL AS reason FROM {v_live} GROUP BY 1
UNION ALL SELECT change_type, count(*), 'no event' FROM {v_live} WHERE quantity <= 0 GROUP BY 1""",
)

# Fits. Their results depend on Spark's ML library, so there is no SQL for them.

add(
    "demand_model",
    lambda t: jobs.demand_forecast_job(t.merged)["forecast"].select("product_id", "current_stock", "predicted_demand", "days_until_stockout"),
)


def _sales_fit(t: Tables) -> DataFrame:
    rows = demand.time_split(demand.forecast_features(demand.product_day_agg(t.brand_sales)))
    rows = stored(rows, "sales_model")
    model = modeling.fit_regression(rows.where("split = 'train'"), fixed.SALES_FEATURES, "y")
    return modeling.regression_metrics(modeling.predict(model, rows.where("split = 'test'"), floor=0.0))


add("sales_model", _sales_fit)


def _delay_fit(t: Tables) -> DataFrame:
    rows = supplier.delay_model_rows(t.shipments, t.suppliers)
    rows = ordering.label_encode(ordering.label_encode(rows, "supplier_id", "supplier_enc"), "product_id", "product_enc")
    rows = quality.drop_incomplete(rows, [*fixed.DELAY_FEATURES, "delay_days"])
    rows = stored(sampling.random_split(rows, ["shipment_id", "product_id"]), "delays")
    model = modeling.search_regression(rows.where("split = 'train'"), fixed.DELAY_FEATURES, "delay_days")
    return modeling.regression_metrics(modeling.predict(model, rows.where("split = 'test'")), "delay_days", "prediction")


add("delay_model", _delay_fit)


def _train_test(t: Tables) -> tuple[DataFrame, DataFrame]:
    later = F.col("observation_date") >= F.lit(TEST_FROM)
    return t.stored_dataset.where(~later), t.stored_dataset.where(later)


def _churn_fit(t: Tables) -> DataFrame:
    """The linear model and the boosted trees side by side on the test rows."""
    train, test = _train_test(t)
    fits = {"linear": modeling.fit_churn(train, fixed.SELLER_FEATURES), "boosted": modeling.fit_boosted_churn(train, fixed.SELLER_FEATURES)}
    out = None
    for name, model in fits.items():
        trees = model.stages[-1].getNumTrees if name == "boosted" else None
        row = modeling.churn_judgement(modeling.score_sellers(model, test)).select(F.lit(name).alias("model"), F.lit(trees).cast("int").alias("trees"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def _scored(t: Tables) -> DataFrame:
    """The test rows, scored by a model that was saved and loaded again."""
    train, test = _train_test(t)
    path, model = fresh_path(t.spark, "churn"), modeling.fit_churn(train, fixed.SELLER_FEATURES)
    judged = modeling.churn_judgement(modeling.score_sellers(model, test))
    saved_models.save_model(path, model, "churn, linear", train, fixed.SELLER_FEATURES, "churned", judged)
    scored = modeling.score_sellers(saved_models.load_model(t.spark, path), test)
    return scored.select(*SELLER_KEYS, "churned", "revenue_at_risk_30d", "churn_probability", "risk_tier")


add("churn_model", _churn_fit)
add("score_sellers", _scored)
add("cv_by_time", lambda t: modeling.cv_by_time(_train_test(t)[0], fixed.SELLER_FEATURES))

# Jobs.


def _inputs(t: Tables) -> dict[str, DataFrame]:
    return {"inventory": t.inventory, "sales": t.stored_sales, "shipments": t.shipments, "suppliers": t.suppliers, "warehouses": t["v_warehouses"]}


def _marketplace(t: Tables) -> dict[str, DataFrame]:
    return {
        "orders": t["v_orders"], "items": t["v_items"], "sellers": t["v_sellers"], "reviews": t["v_reviews"], "products": t["v_products_cat"],
        "category_translation": t["v_translation"],
    }


add(
    "job_operations_overview",
    lambda t: jobs.job_operations_overview(_inputs(t))["products"],
    """SELECT r.product_id, r.warehouse_id, r.reorder_quantity, r.stockout_risk, r.alert_message, h.health_status, h.health_score, h.days_until_stockout, c.inventory_holding_cost,
  c.stockout_cost, c.total_cost_impact FROM {d_reorder} r JOIN {d_health} h ON r.product_id = h.product_id JOIN {d_cost} c ON r.product_id = c.product_id""",
    "days_until_stockout stockout_cost total_cost_impact",
)
add(
    "job_feature_tables",
    lambda t: jobs.job_feature_tables(t.stored_sales, t.inventory, t.deliveries)["inventory"],
    "SELECT * FROM {d_stock_risk}",
    "avg_demand_30d demand_std days_of_stock stockout_risk overstock_ratio annual_holding_cost", 4,
)


def _dataset_job(t: Tables) -> DataFrame:
    sets = jobs.job_seller_dataset(_marketplace(t), t.dates, TEST_FROM)
    return sets["train"].withColumn("part", F.lit("train")).unionByName(sets["test"].withColumn("part", F.lit("test")))


FEATURES = (
    "rolling_30d_otd_rate rolling_30d_avg_review high_complaint_rate_30d revenue_at_risk_30d cancellation_rate_30d dispatch_time_p50_7d " + " ".join(sellers.TRENDS)
)
add(
    "job_seller_dataset",
    _dataset_job,
    f"SELECT *, CASE WHEN observation_date < DATE '{TEST_FROM}' THEN 'train' ELSE 'test' END AS part FROM {{d_dataset}}",
    FEATURES,
)
add(
    "job_seller_scoring",
    lambda t: jobs.job_seller_scoring(*_train_test(t))["profiles"],
)
add(
    "job_daily_report",
    lambda t: jobs.job_daily_report(jobs.job_operations_overview(_inputs(t))),
    """SELECT 'summary' AS section, 'Total Products' AS name, CAST(count(*) AS VARCHAR) AS value FROM {d_health}
UNION ALL SELECT 'summary', 'Critical Products', CAST(count(*) FILTER (WHERE health_status = 'CRITICAL') AS VARCHAR) FROM {d_health}
UNION ALL SELECT 'summary', 'Warning Products', CAST(count(*) FILTER (WHERE health_status = 'WARNING') AS VARCHAR) FROM {d_health}
UNION ALL SELECT 'summary', 'Avg Health Score', CAST(CAST(round(avg(health_score), 2) AS DECIMAL(30,2)) AS VARCHAR) FROM {d_health}
UNION ALL (SELECT 'critical', product_id, CAST(CAST(round(days_until_stockout, 2) AS DECIMAL(30,2)) AS VARCHAR) FROM {d_health} WHERE health_status = 'CRITICAL' ORDER BY days_until_stockout, product_id LIMIT 5)
UNION ALL (SELECT 'suppliers', supplier_id, CAST(CAST(round(reliability_score, 2) AS DECIMAL(30,2)) AS VARCHAR) FROM {d_performance} ORDER BY reliability_score DESC, supplier_id LIMIT 5)
UNION ALL SELECT 'warehouses', warehouse_id, status FROM {d_warehouses}
UNION ALL SELECT 'exposure', 'Total Financial Exposure', CAST(CAST(round(sum(total_cost_impact), 2) AS DECIMAL(30,2)) AS VARCHAR) FROM {d_cost}
UNION ALL (SELECT 'actions', product_id, alert_message FROM {d_reorder} WHERE stockout_risk ORDER BY days_until_stockout, product_id LIMIT 5)""",
)
