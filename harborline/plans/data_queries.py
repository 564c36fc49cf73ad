"""Registered queries for sources and sinks, data quality, statistics, sampling and retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from harborline import fixed_values as fixed
from harborline.operators import demand, inventory, modeling, quality, retrieval, sampling, scenario, sellers, stats
from harborline.plans.registry import add
from harborline.plans.tables import Tables
from harborline.session import fresh_path
from harborline.sources import files, schemas
from harborline.sources.versions import VersionedTable

# Sources and sinks: a table is written to the shared folder and read back.

ORDER_DATES = [
    "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
]


def _written(t: Tables, df: DataFrame, name: str, sink: Callable[[DataFrame, str], None]) -> str:
    path = fresh_path(t.spark, name)
    sink(df, path)
    return path


def _plain_times(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


SALES = "SELECT product_id, date, daily_sales, region FROM {v_sales}"
add("scan_csv", lambda t: files.scan_csv(t.spark, _written(t, t.sales, "sales", files.sink_csv), schemas.TABLES["sales"]), SALES)


def _torn_sales(df: DataFrame, path: str) -> None:
    """The sales, and behind each sale of more than 40 units a line without its last two fields and one whose units are a word."""
    line = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("product_id", "date", "daily_sales", "region")]
    whole, torn, word = F.concat_ws(",", *line), F.concat_ws(",", *line[:2]), F.concat_ws(",", *line[:2], F.lit("many"), line[3])
    more = F.when(F.col("daily_sales") > 40, F.array(whole, torn, word)).otherwise(F.array(whole))
    df.select(F.explode(more).alias("product_id,date,daily_sales,region")).write.option("header", True).option("sep", "\u0001").csv(path)


def _sales_and_quarantine(t: Tables) -> DataFrame:
    good, bad = files.scan_csv_checked(t.spark, _written(t, t.sales, "sales", _torn_sales), schemas.TABLES["sales"])
    day = F.split("text", ",")
    torn = bad.select(day[0].alias("product_id"), day[1].cast("date").alias("date"), "reason")
    return good.select("product_id", "date", F.lit(None).cast("string").alias("reason")).unionByName(torn)


add(
    "scan_csv_quarantine",
    _sales_and_quarantine,
    """SELECT product_id, date, NULL AS reason FROM {v_sales}
UNION ALL SELECT product_id, date, unnest(['not 4 fields', 'daily_sales is no double']) FROM {v_sales} WHERE daily_sales > 40""",
)
add(
    "sink_csv",
    lambda t: files.scan_csv(
        t.spark, _written(t, t.sales, "sales", lambda df, p: files.sink_csv(df, p, ("region",))), schemas.TABLES["sales"]
    ).select("product_id", "date", "daily_sales", "region"),
    SALES,
)
add(
    "scan_csv_dates",
    lambda t: _plain_times(
        files.scan_csv_dates(t.spark, _written(t, t["v_orders"], "orders", files.sink_csv), schemas.MARKETPLACE["orders"].schema, ORDER_DATES),
        ORDER_DATES,
    ).select("order_id", "order_status", *ORDER_DATES),
    f"SELECT order_id, order_status, {', '.join(ORDER_DATES)} FROM {{v_orders}}",
)
SHIPMENT = "shipment_id supplier_id product_id shipment_date expected_delivery actual_delivery status".split()
add(
    "scan_json",
    lambda t: files.scan_json(t.spark, _written(t, t.shipments.select(*SHIPMENT), "shipments", files.sink_json), schemas.TABLES["shipments"]),
    f"SELECT {', '.join(SHIPMENT)} FROM {{d_shipments}}",
)
MASTER = "order_id order_item_id product_id seller_id price order_status on_time purchase_month".split()
add(
    "scan_parquet",
    lambda t: files.scan_parquet(t.spark, _written(t, t.whole_master, "master", files.sink_parquet), t.whole_master.schema).select(*MASTER),
    f"SELECT {', '.join(MASTER)} FROM {{d_master}}",
)
add(
    "sink_parquet",
    lambda t: files.scan_parquet(
        t.spark, _written(t, _orders_by_year(t), "orders", lambda df, p: files.sink_parquet(df, p, ("purchase_year",)))
    ).select("order_id", "order_status", "purchase_year"),
    "SELECT order_id, order_status, CAST(year(order_purchase_timestamp) AS INT) AS purchase_year FROM {v_orders}",
)


def _orders_by_year(t: Tables) -> DataFrame:
    return sellers.purchase_buckets(t["v_orders"])


add(
    "sink_json_metrics",
    lambda t: files.scan_json(
        t.spark, _written(t, modeling.regression_metrics(t.judged), "metrics", files.sink_json_metrics),
        modeling.regression_metrics(t.judged).schema,
    ),
    """SELECT avg(abs(y - prediction)) AS mae, sqrt(avg((y - prediction) * (y - prediction))) AS rmse, 1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(*)) AS r2,
  avg(abs((y - prediction) / y)) FILTER (WHERE y <> 0) * 100 AS mape, count(*) AS n_samples FROM {d_judged}""",
    "mae rmse r2 mape",
)


def _relational(t: Tables) -> DataFrame:
    t.inventory.createOrReplaceTempView("harborline_products")
    return files.scan_table(t.spark, "harborline_products").select("product_id", "warehouse_id", "current_stock")


add("scan_relational", _relational, "SELECT product_id, warehouse_id, current_stock FROM {v_inventory}")
def _two_orders(df: DataFrame, path: str) -> None:
    """Part files of two kinds: half of the rows with the columns as they are, half the other way round."""
    half = F.pmod(F.xxhash64(*df.columns), F.lit(2)) == 0
    for rows, columns in ((df.where(half), df.columns), (df.where(~half), df.columns[::-1])):
        rows.select(*columns).write.mode("append").option("header", True).csv(path)


add(
    "scan_dir_union",
    lambda t: files.scan_dir_union(
        t.spark, _written(t, t.merged.select("product_id", "warehouse_id", "current_stock", "inventory_days").repartition(4), "live", _two_orders),
        schemas.struct(product_id=schemas.TEXT, warehouse_id=schemas.TEXT, current_stock=schemas.NUMBER, inventory_days=schemas.NUMBER),
    ),
    "SELECT product_id, warehouse_id, current_stock, inventory_days FROM {d_merged}",
    "inventory_days",
)


def _appended(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "alerts")
    alerts = t["v_orm_alerts"].select("id", "product_id", "alert_type", "severity")
    critical = F.coalesce(F.col("severity") == "CRITICAL", F.lit(False))
    for part in (critical, ~critical):
        files.sink_append(alerts.where(part), path)
    return files.scan_parquet(t.spark, path, alerts.schema)


add("sink_append", _appended, "SELECT id, product_id, alert_type, severity FROM {v_orm_alerts}")


def _raw_marketplace(t: Tables) -> str:
    """The nine raw tables as CSV."""
    root = fresh_path(t.spark, "raw")
    raw = {
        "orders": t["v_orders"].join(
            t["orders"].select(F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_custkey").cast("string").alias("customer_id")), "order_id"
        ),
        "items": t["v_items"],
        "reviews": t["v_reviews"],
        "sellers": t["v_sellers"].select("seller_id", F.col("seller_state").alias("seller_zip_code_prefix"), F.col("seller_state").alias("seller_city"), "seller_state"),
        "products": t["v_products_cat"],
        "customers": t["customer"].select(
            F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("customer_zip_code_prefix"), F.col("c_mktsegment").alias("customer_state")
        ),
        "payments": t["orders"].select(F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("payment_type"), F.col("o_totalprice").alias("payment_value")),
        "geolocation": t["nation"].select(
            F.col("n_nationkey").alias("geolocation_zip_code_prefix"), F.col("n_nationkey").alias("geolocation_lat"),
            F.col("n_regionkey").alias("geolocation_lng"), F.col("n_name").alias("geolocation_state"),
        ),
        "category_translation": t["v_translation"],
    }
    for name, df in raw.items():
        files.sink_csv(df, f"{root}/{schemas.MARKETPLACE[name].folder}")
    return root


def _nulls(cols: list[str], of: str, width: int) -> str:
    return "(" + " + ".join(f"avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END)" for c in cols) + f") / {width} * 100 AS null_pct FROM {of}"


_FULL = {
    "items": ("{v_items}", 6), "reviews": ("{v_reviews}", 4), "sellers": ("{v_sellers}", 4), "customers": ("{customer}", 3),
    "payments": ("{orders}", 3), "geolocation": ("{nation}", 4), "category_translation": ("{v_translation}", 2),
}
add(
    "load_registry",
    lambda t: files.registry_summary(files.load_registry(t.spark, _raw_marketplace(t), schemas.MARKETPLACE)),
    "SELECT 'orders' AS name, count(*) AS rows, 8 AS cols, " + _nulls(["order_delivered_carrier_date", "order_delivered_customer_date"], "{v_orders}", 8)
    + " UNION ALL SELECT 'products', count(*), 2, " + _nulls(["product_category_name"], "{v_products_cat}", 2)
    + "".join(f" UNION ALL SELECT '{n}', count(*), {w}, 0e0 FROM {src}" for n, (src, w) in _FULL.items()),
    "null_pct",
)

KINDS = {
    "v_inventory": ("inventory", "inventory"), "v_sales": ("sales", "sales"), "v_suppliers": ("suppliers", "suppliers"),
    "v_shipments": ("shipments", "shipments"), "v_warehouses": ("warehouses", "warehouses"), "v_live": ("generic", None),
    "events": ("generic", None), "v_orm_alerts": ("generic", None), "v_orm_suppliers": ("suppliers", "suppliers"), "v_items": ("generic", None),
}


def _by_header(t: Tables, rule: Callable[[list[str]], str | None], name: str) -> DataFrame:
    """What a rule says about each table's header, with the table's size."""
    out = None
    for table in KINDS:
        df = t[table]
        row = df.agg(F.lit(table).alias("table"), F.lit(rule(df.columns)).cast("string").alias(name), F.count(F.lit(1)).alias("rows"))
        out = row if out is None else out.unionByName(row)
    return out


def _kinds_sql(index: int, name: str) -> str:
    def text(kind: str | None) -> str:
        return "NULL" if kind is None else f"'{kind}'"

    return " UNION ALL ".join(
        f"SELECT '{table}' AS \"table\", {text(kinds[index])} AS {name}, count(*) AS rows FROM {{{table}}}" for table, kinds in KINDS.items()
    )


add("detect_dataset_type", lambda t: _by_header(t, schemas.detect_dataset_type, "type"), _kinds_sql(0, "type"))
add("schema_match", lambda t: _by_header(t, schemas.schema_match, "type"), _kinds_sql(1, "type"))


def _workspace(t: Tables) -> str:
    """A folder of uploads: the live rows as JSON, the others as CSV."""
    root = fresh_path(t.spark, "workspace")
    for name, view in UPLOADS.items():
        (files.sink_json if name == "live" else files.sink_csv)(t[view], f"{root}/{name}")
    return root


UPLOADS = {"stock": "v_inventory", "sold": "v_sales", "partners": "v_suppliers", "moves": "v_shipments", "sites": "v_warehouses", "live": "v_live"}
add(
    "workspace_catalog",
    lambda t: files.workspace_catalog(t.spark, _workspace(t)),
    " UNION ALL ".join(
        f"SELECT '{n}' AS filename, '{KINDS[v][0]}' AS type, count(*) AS rows, {w} AS cols FROM {{{v}}}"
        for (n, v), w in zip(UPLOADS.items(), (12, 4, 4, 8, 3, 5))
    ),
)


def _three_uploads(t: Tables) -> DataFrame:
    """Suppliers twice, the newer with its columns the other way round, and then something else."""
    root = fresh_path(t.spark, "uploads")
    files.sink_csv(t.suppliers.withColumn("lead_time_days", F.lit(0.0)), f"{root}/first")
    files.sink_csv(t.suppliers.select(*t.suppliers.columns[::-1]), f"{root}/second")
    files.sink_csv(t["v_warehouses"], f"{root}/third")
    # The canonical table holds the first upload until the second one takes its place; a third look changes nothing.
    table, schema = VersionedTable(t.spark, fresh_path(t.spark, "suppliers")), schemas.TABLES["suppliers"]
    table.replace(files.scan_csv(t.spark, f"{root}/first", schema))
    taken = table.sync_latest(root, schema, "suppliers")
    if table.sync_latest(root, schema, "suppliers") != taken:
        raise ValueError("the same upload was taken twice")
    return table.read().select(*t.suppliers.columns)


add("sync_latest", _three_uploads, "SELECT * FROM {v_suppliers}")


def _updates(t: Tables) -> DataFrame:
    """New versions of the suppliers at risk (a blank lead time where delays are rare) and new suppliers, each also older and undated."""
    rows = t["v_orm_suppliers"].where(F.col("status") != "ACTIVE")
    newest = rows.select(
        F.when(F.col("status") == "AT_RISK", F.col("supplier_id")).otherwise(F.concat(F.lit("N"), F.col("supplier_id"))).alias("supplier_id"),
        F.concat(F.lit("New "), F.col("supplier_name")).alias("supplier_name"),
        F.when(F.col("delay_rate") < 0.2, F.lit(" ")).otherwise(F.col("lead_time_days").cast("string")).alias("lead_time_days"),
        F.lit("2024-01-03").alias("updated"),
    )
    stale = newest.withColumn("lead_time_days", F.lit("99"))
    return newest.unionByName(stale.withColumn("updated", F.lit("2024-01-02"))).unionByName(stale.withColumn("updated", F.lit(None).cast("string")))


def _upserted(t: Tables) -> DataFrame:
    """A table that is read and replaced by its own upsert."""
    table = VersionedTable(t.spark, fresh_path(t.spark, "suppliers"))
    table.replace(t.suppliers)
    table.upsert(_updates(t), "supplier_id", {"lead_time_days": 7.0, "reliability_score": 90.0}, "updated")
    return table.read()


add(
    "upsert_by_key",
    _upserted,
    """SELECT coalesce(n.id, s.supplier_id) AS supplier_id, coalesce(n.name, s.supplier_name) AS supplier_name, CASE WHEN n.id IS NULL THEN s.lead_time_days ELSE n.lead END AS lead_time_days,
  coalesce(s.reliability_score, 90) AS reliability_score FROM {v_suppliers} s FULL JOIN (SELECT CASE WHEN status = 'AT_RISK' THEN supplier_id ELSE 'N' || supplier_id END AS id,
    'New ' || supplier_name AS name, CASE WHEN delay_rate < 2e-1 THEN 7 ELSE lead_time_days END AS lead FROM {v_orm_suppliers} WHERE status <> 'ACTIVE') n ON s.supplier_id = n.id""",
)


def _replaced(t: Tables) -> DataFrame:
    table = VersionedTable(t.spark, fresh_path(t.spark, "forecasts"))
    table.replace(t["v_orm_forecasts"].select("product_id", "predicted_demand"))
    table.replace(t.forecast.select("product_id", "predicted_demand"))
    return table.read()


add("replace_all", _replaced, "SELECT product_id, predicted_demand FROM {d_forecast}", "predicted_demand")

# Data quality, on shipments with a delay column.

DQ = "supplier_id shipment_date actual_delivery delay_days defective_units".split()


def _dq(t: Tables) -> DataFrame:
    return t.shipments.withColumn("delay_days", F.date_diff("actual_delivery", "expected_delivery")).select(*DQ)


DQ_ROWS = "SELECT supplier_id, shipment_date, actual_delivery, CAST(actual_delivery - expected_delivery AS INT) AS delay_days, defective_units FROM {v_shipments}"
DQ_TYPES = ("string", "date", "date", "int", "bigint")
add(
    "dq_column_profile",
    lambda t: quality.dq_column_profile(_dq(t), DQ),
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{ty}' AS type, count(*) FILTER (WHERE {c} IS NULL) AS nulls, round_even(count(*) FILTER (WHERE {c} IS NULL) / CAST(count(*) AS DOUBLE) * 100, 1) AS null_pct, "
        f"(SELECT CAST({c} AS VARCHAR) FROM ({DQ_ROWS}) ORDER BY {', '.join(f'{o} NULLS FIRST' for o in DQ)} LIMIT 1) AS sample FROM ({DQ_ROWS})"
        for c, ty in zip(DQ, DQ_TYPES)
    ),
    "null_pct",
)
add(
    "dq_range_issues",
    lambda t: quality.dq_range_issues(_dq(t)),
    f"SELECT 'delay_days' AS \"column\", 'negative values' AS issue FROM ({DQ_ROWS}) HAVING count(*) FILTER (WHERE delay_days < 0) > 0 "
    f"UNION ALL SELECT 'delay_days', 'values > 365' FROM ({DQ_ROWS}) HAVING count(*) FILTER (WHERE delay_days > 365) > 0 "
    f"UNION ALL SELECT 'defective_units', 'negative values' FROM ({DQ_ROWS}) HAVING count(*) FILTER (WHERE defective_units < 0) > 0",
)
add(
    "dq_fix_suggestions",
    lambda t: quality.dq_fix_suggestions(_dq(t)),
    f"SELECT 'actual_delivery' AS \"column\", count(*) FILTER (WHERE actual_delivery IS NULL) AS nulls, 'UNKNOWN' AS fill_with FROM ({DQ_ROWS}) HAVING nulls > 0 "
    f"UNION ALL SELECT 'delay_days', count(*) FILTER (WHERE delay_days IS NULL) AS nulls, '0' FROM ({DQ_ROWS}) HAVING nulls > 0",
)
DQ_SCORE = f"""SELECT greatest(0, 100 - (n - d) / CAST(n AS DOUBLE) * 50 - nulls / CAST(n * 5 AS DOUBLE) * 50 - 5 * issues) AS score, n, n - d AS duplicates, missing FROM (
  SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM ({DQ_ROWS}))) AS d, 2 * count(*) FILTER (WHERE actual_delivery IS NULL) AS nulls,
    count(*) FILTER (WHERE actual_delivery IS NULL) AS missing, CASE WHEN min(delay_days) < 0 THEN 1 ELSE 0 END + CASE WHEN max(delay_days) > 365 THEN 1 ELSE 0 END AS issues FROM ({DQ_ROWS}))"""
add("duplicate_count", lambda t: quality.duplicate_count(_dq(t)), f"SELECT duplicates FROM ({DQ_SCORE})")
add("dq_score", lambda t: quality.dq_score(_dq(t)), f"SELECT score FROM ({DQ_SCORE})", "score")
add("dq_null_pct", lambda t: quality.dq_null_pct(_dq(t)), "SELECT " + _nulls(DQ, f"({DQ_ROWS})", 5), "null_pct")
add(
    "dq_report",
    lambda t: quality.dq_report(_dq(t), "shipments").select(
        "filename", "total_rows", "total_columns", "duplicate_rows", "quality_score",
        F.col("null_counts")["delay_days"].alias("delay_nulls"), F.col("null_counts")["supplier_id"].alias("supplier_nulls"),
        F.array_join("issues", "; ").alias("issues"),
    ),
    f"""SELECT 'shipments' AS filename, n AS total_rows, 5 AS total_columns, duplicates AS duplicate_rows, score AS quality_score, missing AS delay_nulls, 0 AS supplier_nulls,
  'delay_days contains negative values' AS issues FROM ({DQ_SCORE})""",
    "quality_score",
)
add(
    "dq_referential",
    lambda t: quality.dq_referential(t["v_items"], "order_id", t["v_reviews"].select("order_id").distinct(), "order_id"),
    """SELECT 'order_id' AS fk, count(DISTINCT order_id) AS orphans, count(*) AS orphan_rows FROM {v_items} WHERE order_id NOT IN (SELECT order_id FROM {v_reviews})""",
)

# Statistics.

CORR = fixed.CORRELATED_COLUMNS
add(
    "corr_matrix",
    lambda t: stats.corr_matrix(t.supplier_board, CORR),
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM {{d_board}}" for i, a in enumerate(CORR) for b in CORR[i + 1:]
    ),
    "corr",
)
add("corr_pair", lambda t: stats.corr_pair(t.supplier_board, "delay_rate", "reliability_score"), "SELECT corr(delay_rate, reliability_score) AS corr FROM {d_board}", "corr")
add(
    "linear_trend",
    lambda t: stats.linear_trend(t.supplier_board, "delay_rate", "reliability_score"),
    "SELECT regr_slope(reliability_score, delay_rate) AS slope, regr_intercept(reliability_score, delay_rate) AS intercept FROM {d_board}",
    "slope intercept",
)
add(
    "histogram",
    lambda t: stats.histogram(t.inventory, "current_stock", 30).withColumn("of", F.lit("stock")).unionByName(
        stats.histogram(t.master.where(F.col("dispatch_days") > 0), "dispatch_days", 50, 0.0, 20.0).withColumn("of", F.lit("dispatch"))
    ),
    """SELECT bucket, lo + bucket * w AS lo, lo + (bucket + 1) * w AS hi, n, 'stock' AS of FROM (SELECT CAST(least(floor((current_stock - lo) / w), 29) AS INT) AS bucket, lo, w, count(*) AS n
  FROM {v_inventory}, (SELECT min(current_stock) AS lo, (max(current_stock) - min(current_stock)) / 30 AS w FROM {v_inventory}) GROUP BY 1, 2, 3)
UNION ALL SELECT bucket, bucket * (20e0 / 50), (bucket + 1) * (20e0 / 50), n, 'dispatch' FROM (SELECT CAST(least(floor(dispatch_days / (20e0 / 50)), 49) AS INT) AS bucket, count(*) AS n
  FROM {d_master} WHERE dispatch_days > 0 AND dispatch_days <= 20 GROUP BY 1)""",
    "lo hi",
)
add(
    "box_stats",
    lambda t: stats.box_stats(t.supplier_board, "risk_tier", "lead_time_days"),
    """SELECT risk_tier, min(lead_time_days) AS min, quantile_cont(lead_time_days, 25e-2) AS q1, median(lead_time_days) AS median, quantile_cont(lead_time_days, 75e-2) AS q3,
  max(lead_time_days) AS max, avg(lead_time_days) AS mean FROM {d_board} GROUP BY 1""",
    "min q1 median q3 max mean",
)
add(
    "high_delay_rows",
    lambda t: stats.above_quantile(t.deliveries, "delay_days").select("shipment_id", "product_id", "supplier_id", "delay_days"),
    "SELECT shipment_id, product_id, supplier_id, delay_days FROM {d_deliveries} WHERE delay_days > (SELECT quantile_cont(delay_days, 85e-2) FROM {d_deliveries})",
)
STATS = ["total_sales", "avg_sales", "std_sales", "max_sales"]


def _anomalies(t: Tables) -> DataFrame:
    """Scores of the daily figures to six digits, so that equal days tie in every engine."""
    daily = demand.daily_sales_stats(t.sales).withColumns({f: F.round(f, 6) for f in STATS})
    return stats.anomaly_scores(daily, "date", STATS)


def _ecod_sql(tail: str) -> str:
    cells = " UNION ALL ".join(f"SELECT date, '{f}' AS feature, round(CAST({f} AS DOUBLE), 6) AS value FROM {{d_daily_stats}}" for f in STATS)
    shape = " UNION ALL ".join(f"SELECT '{f}' AS feature, sign(coalesce(skewness({f}), 0)) AS skew FROM {{d_daily_stats}}" for f in STATS)
    return f"""WITH cells AS ({cells}), shape AS ({shape}),
tails AS (SELECT c.date, s.skew, -ln(cume_dist() OVER (PARTITION BY c.feature ORDER BY c.value)) AS l, -ln(cume_dist() OVER (PARTITION BY c.feature ORDER BY c.value DESC)) AS r
  FROM cells c JOIN shape s ON c.feature = s.feature),
scored AS (SELECT date, greatest(sum(l), sum(r), sum(CASE WHEN skew < 0 THEN l WHEN skew > 0 THEN r ELSE l + r END)) AS anomaly_score FROM tails GROUP BY 1),
labelled AS (SELECT *, CASE WHEN anomaly_score > (SELECT quantile_cont(anomaly_score, 9e-1) FROM scored) THEN 1 ELSE 0 END AS is_anomaly FROM scored) {tail}"""


add("anomaly_ecod", _anomalies, f"SELECT * FROM ({_ecod_sql('SELECT * FROM labelled')})", "anomaly_score")
add(
    "anomaly_summary",
    lambda t: stats.anomaly_summary(_anomalies(t)),
    f"SELECT * FROM ({_ecod_sql('SELECT count(*) AS total_records, CAST(sum(is_anomaly) AS BIGINT) AS anomalies_detected, avg(is_anomaly) AS anomaly_ratio FROM labelled')})",
    "anomaly_ratio",
)

SEEN_UNTIL = "1997-01-01"


def _unseen_anomalies(t: Tables) -> DataFrame:
    """The days from a date on, scored by the distribution of the days before it, which is kept as a table."""
    daily = demand.daily_sales_stats(t.sales).withColumns({f: F.round(f, 6) for f in STATS})
    kept = _written(t, stats.anomaly_tails(daily.where(F.col("date") < SEEN_UNTIL), "date", STATS), "tails", files.sink_parquet)
    return stats.tail_scores(daily.where(F.col("date") >= SEEN_UNTIL), files.scan_parquet(t.spark, kept), "date", STATS)


def _unseen_sql() -> str:
    cells = " UNION ALL ".join(f"SELECT date, '{f}' AS feature, round(CAST({f} AS DOUBLE), 6) AS value FROM {{d_daily_stats}}" for f in STATS)
    shape = " UNION ALL ".join(f"SELECT '{f}' AS feature, sign(coalesce(skewness({f}), 0)) AS skew FROM {{d_daily_stats}} WHERE date < DATE '{SEEN_UNTIL}'" for f in STATS)
    return f"""WITH cells AS ({cells}), shape AS ({shape}),
fitted AS (SELECT * FROM cells WHERE date < DATE '{SEEN_UNTIL}'), days AS (SELECT count(DISTINCT date) AS n FROM fitted),
met AS (SELECT c.date, c.feature, c.value, count(*) FILTER (WHERE f.value < c.value) AS below, count(*) FILTER (WHERE f.value <= c.value) AS upto
  FROM cells c JOIN fitted f ON c.feature = f.feature WHERE c.date >= DATE '{SEEN_UNTIL}' AND c.value IS NOT NULL GROUP BY ALL),
tails AS (SELECT m.date, s.skew, -ln(CASE WHEN upto > below THEN upto / n ELSE (upto + 1) / (n + 1) END) AS l,
  -ln(CASE WHEN upto > below THEN (n - below) / n ELSE (n - upto + 1) / (n + 1) END) AS r FROM met m JOIN shape s ON m.feature = s.feature, days)
SELECT date, greatest(sum(l), sum(r), sum(CASE WHEN skew < 0 THEN l WHEN skew > 0 THEN r ELSE l + r END)) AS anomaly_score FROM tails GROUP BY 1"""


add("anomaly_unseen", _unseen_anomalies, f"SELECT * FROM ({_unseen_sql()})", "anomaly_score")

# Splits and samples: all choices follow from the seed and the row.

UNIFORM = "(CAST('0x' || substr(md5('42:' || product_id || ':' || CAST(date AS VARCHAR) || ':' || region), 1, 8) AS BIGINT) + 5e-1) / 4294967296e0"
SALE = ["product_id", "date", "region"]
add(
    "random_split",
    lambda t: sampling.random_split(t.sales, SALE),
    f"SELECT *, CASE WHEN {UNIFORM} < 2e-1 THEN 'test' ELSE 'train' END AS split FROM {{v_sales}}",
)
add("sample_rows", lambda t: sampling.sample_rows(t.sales, SALE), f"SELECT * FROM {{v_sales}} ORDER BY {UNIFORM}, product_id, date, region LIMIT 10000")
add(
    "time_split",
    lambda t: demand.time_split(demand.product_day_agg(t.brand_sales)),
    "SELECT product_id, date, daily_sales AS y, CASE WHEN date > (SELECT max(date) FROM {v_sales_brand}) - 30 THEN 'test' ELSE 'train' END AS split FROM {v_sales_brand}",
)

# Retrieval.

add(
    "rows_to_documents",
    lambda t: retrieval.rows_to_documents(t.health.select("product_id", "current_stock", "reorder_quantity", "health_status", "health_score"), "health", "product_id"),
    """SELECT 'health' AS source, product_id AS row_key, '{"product_id":"' || product_id || '","current_stock":' || CAST(current_stock AS VARCHAR) || ',"reorder_quantity":' || CAST(reorder_quantity AS VARCHAR)
  || ',"health_status":"' || health_status || '","health_score":' || CAST(health_score AS VARCHAR) || '}' AS text FROM {d_health}""",
)


# The result tables that questions are asked about, with the columns that go into a document.
DOCUMENTS = {
    "health": ("d_health", "product_id current_stock reorder_quantity health_status health_score"),
    "reorder": ("d_reorder", "product_id warehouse_id reorder_quantity stockout_risk alert_message"),
    "suppliers": ("d_performance", "supplier_id total_shipments on_time_shipments supplier_status"),
    "warehouses": ("d_warehouses", "warehouse_id warehouse_location status"),
    "forecast": ("d_forecast", "product_id warehouse_id current_stock"),
}


def _all_documents(t: Tables) -> DataFrame:
    results = {"health": inventory.health_score(t.stored_reorder), "reorder": t.stored_reorder, "suppliers": t.performance, "warehouses": t.warehouses, "forecast": t.stored_forecast}
    return retrieval.tables_to_documents({n: (results[n].select(*cols.split()), cols.split()[0]) for n, (_, cols) in DOCUMENTS.items()})


add(
    "rows_to_documents_all",
    _all_documents,
    " UNION ALL ".join(
        f"SELECT '{n}' AS source, {cols.split()[0]} AS row_key, CAST(json_object(" + ", ".join(f"'{c}', {c}" for c in cols.split()) + f") AS VARCHAR) AS text FROM {{{view}}}"
        for n, (view, cols) in DOCUMENTS.items()
    ),
)


def _label_examples(t: Tables) -> DataFrame:
    """One question per label: its first vector."""
    return t["embeddings"].groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(F.col("label").alias("query_id"), "embedding")


add(
    "vector_topk",
    lambda t: retrieval.vector_topk(_label_examples(t), t["embeddings"]),
    """SELECT query_id, vec_id, score, rank FROM (SELECT q.query_id, c.vec_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score,
  CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) DESC, c.vec_id) AS INT) AS rank
  FROM (SELECT label AS query_id, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS e FROM {embeddings} GROUP BY 1) q, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM {embeddings}) c) WHERE rank <= 3""",
    "score", 5,
)
