"""Sources, data quality, metrics and streams."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from harborline.operators import modeling, quality, stats
from harborline.sources import files, schemas
from harborline.streaming import stock


def test_kinds_of_tables():
    assert schemas.detect_dataset_type(["Product_ID", "CURRENT_STOCK", "safety_stock", "x"]) == "inventory"
    assert schemas.schema_match(["Product_ID", "CURRENT_STOCK", "safety_stock"]) is None
    assert schemas.schema_match(["product_id", "daily_sales"]) == "sales"
    assert schemas.detect_dataset_type(["product_id", "daily_sales"]) == "generic"
    assert schemas.detect_dataset_type(["City", "x"]) == "geospatial"
    assert schemas.detect_dataset_type(["month", "Revenue"]) == "timeseries"
    assert schemas.detect_dataset_type([]) == "unknown"


def test_csv_is_read_by_column_name(spark, tmp_path):
    (tmp_path / "s.csv").write_text("region,daily_sales,product_id,extra,date\nN,4.5,p1,e,2024-01-02\nS,many,p2,f,soon\n")
    got = files.scan_csv(spark, str(tmp_path / "s.csv"), schemas.TABLES["sales"]).orderBy("product_id").collect()
    assert (got[0].product_id, got[0].daily_sales, got[0].region, got[0].extra) == ("p1", 4.5, "N", "e")
    assert (got[1].daily_sales, got[1].date) == (None, None)
    dated = files.scan_csv_dates(spark, str(tmp_path / "s.csv"), schemas.TABLES["sales"], ["date"]).orderBy("product_id").collect()
    assert dated[0].date == datetime(2024, 1, 2) and dated[1].date is None


def test_registry_reports_all_errors_at_once(spark, tmp_path):
    (tmp_path / "sellers").mkdir()
    (tmp_path / "sellers" / "a.csv").write_text("seller_id,seller_city\n1,x\n")
    registry = {k: schemas.MARKETPLACE[k] for k in ("sellers", "products")}
    with pytest.raises(ValueError) as e:
        files.load_registry(spark, str(tmp_path), registry)
    assert "sellers: missing columns" in str(e.value) and "products:" in str(e.value)


def test_upsert_keeps_a_zero(table):
    old = table("id string, name string, lead double, rel double", ("a", "A", 5.0, 80.0), ("b", "B", 6.0, 70.0))
    new = table("id string, name string, lead string", ("a", "A2", "0"), ("c", "C", ""))
    got = {r.id: (r.name, r.lead, r.rel) for r in files.upsert_by_key(old, new, "id", {"lead": 7.0, "rel": 90.0}).collect()}
    assert got == {"a": ("A2", 0.0, 80.0), "b": ("B", 6.0, 70.0), "c": ("C", 7.0, 90.0)}


def test_upsert_takes_the_newest_of_equal_keys(table):
    old = table("id string, lead double", ("a", 5.0))
    new = table("id string, lead double, at timestamp", ("a", 1.0, datetime(2024, 1, 1)), ("a", 2.0, datetime(2024, 1, 3)), ("a", 3.0, datetime(2024, 1, 2)))
    assert [tuple(r) for r in files.upsert_by_key(old, new, "id", {}, "at").collect()] == [("a", 2.0)]


def test_quality_score_by_formula(table):
    df = table("id string, delay_days double, n int", ("a", 400.0, 1), ("a", 400.0, 1), ("b", None, -1), (None, 3.0, 2))
    got = quality.dq_report(df, "f").first()
    assert (got.total_rows, got.total_columns, got.duplicate_rows, got.null_counts) == (4, 3, 1, {"id": 1, "delay_days": 1, "n": 0})
    assert got.quality_score == pytest.approx(100 - 1 / 4 * 50 - 2 / 12 * 50 - 2 * 5)
    assert got.issues == ["delay_days contains values > 365", "n contains negative values"]
    assert {(r.column, r.fill_with) for r in quality.dq_fix_suggestions(df).collect()} == {("id", "UNKNOWN"), ("delay_days", "0")}
    profile = {r.column: r for r in quality.dq_column_profile(df.na.drop(), ["id"]).collect()}
    assert (profile["id"].nulls, profile["id"].null_pct, profile["id"].sample) == (0, 0.0, "a")
    assert quality.dq_score(table("x string", ("a",))).first().score == 100.0


def test_outlier_scores_need_rows_and_find_the_outlier(table):
    rows = [(i, float(i % 5), float(i % 3)) for i in range(40)] + [(99, 50.0, 40.0)]
    got = stats.anomaly_scores(table("k int, a double, b double", *rows), "k", ["a", "b"], contamination=0.02)
    assert [r.k for r in got.where("is_anomaly = 1").collect()] == [99]
    assert stats.anomaly_scores(table("k int, a double", *[(i, 1.0) for i in range(9)]), "k", ["a"]).count() == 0


def test_metrics_equal_the_ml_library(table):
    rng = np.random.default_rng(2)
    rows = [(float(y), float(y + e)) for y, e in zip(rng.integers(0, 20, 200), rng.normal(size=200))]
    df = table("y double, prediction double", *rows)
    got = modeling.regression_metrics(df).first()
    for name, metric in (("mae", "mae"), ("rmse", "rmse"), ("r2", "r2")):
        assert got[name] == pytest.approx(RegressionEvaluator(labelCol="y", metricName=metric).evaluate(df))
    assert got.n_samples == 200


def test_average_precision_by_hand(table):
    df = table("label int, p double", (1, 0.9), (0, 0.8), (1, 0.7), (0, 0.7), (0, 0.1), (1, 0.05))
    # Scores 0.9, 0.7 (a tie) and 0.05 gain a third of the recall each, at precisions 1, 2/4 and 3/6.
    assert modeling.average_precision(df, "label", "p").first().ap == pytest.approx((1 + 0.5 + 0.5) / 3)
    assert modeling.average_precision(df.where("label = 0"), "label", "p").first().ap == 0.0
    assert modeling.class_weight(df.where("label = 0"), "label").first().weight == 1.0


def test_folds(spark):
    df = spark.range(20).select(F.expr("date'2020-01-01' + CAST(id / 7 AS INT)").alias("observation_date"), F.format_string("%02d", "id").alias("seller_id"))
    got = {(r.fold, r.role): r["rows"] for r in modeling.time_series_folds(df).collect()}
    assert got == {(f, role): (3 if role == "test" else 5 + 3 * (f - 1)) for f in range(1, 6) for role in ("train", "test")}
    blocks = modeling.fold_blocks(df).orderBy("seller_id").collect()
    assert [r.fold_block for r in blocks] == [0] * 5 + [b for b in range(1, 6) for _ in range(3)]


def test_linear_attribution_adds_up(table):
    df = table("id string, x double, y double", ("a", 1.0, 4.0), ("b", 3.0, 0.0))
    got = {(r.id, r.feature): r.contribution for r in modeling.feature_attribution(df, ["id"], {"x": 2.0, "y": -1.0}).collect()}
    assert got == {("a", "x"): -2.0, ("b", "x"): 2.0, ("a", "y"): -2.0, ("b", "y"): 2.0}
    text = modeling.attribution_explain(modeling.feature_attribution(df, ["id"], {"x": 2.0}), ["id"]).where("id = 'b'").first()
    assert (text["rank"], text.text) == (1, "x = 3.00 -> INCREASES by 2.00")


def test_json_events_are_parsed(spark):
    good = json.dumps({"timestamp": "2024-01-01T00:00:00Z", "product_id": "p", "warehouse_id": "W1", "change_type": "sale", "quantity": 3})
    got = stock.parse_events(spark.createDataFrame([(good.encode(),), (b"broken",)], "value binary")).collect()
    assert len(got) == 1 and (got[0].product_id, got[0].quantity) == ("p", 3.0)


def test_streams_in_many_batches_equal_the_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=5 * i), f"p{i % 3}", "W1", "sale", float(i % 11)) for i in range(120)]
    for part in range(6):
        df = spark.createDataFrame(rows[part * 20:(part + 1) * 20], "timestamp timestamp, product_id string, warehouse_id string, change_type string, quantity double")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    inventory = spark.createDataFrame([(f"p{i}", 30.0) for i in range(3)], "product_id string, current_stock double")
    stream = stock.stream_source(spark, "parquet", path=str(tmp_path / "in"), maxFilesPerTrigger="1")
    live = stock.run_to_end(stock.stream_metrics(stream, inventory), str(tmp_path / "out"), str(tmp_path / "progress"))
    batch = stock.stream_metrics(spark.read.parquet(str(tmp_path / "in")), inventory)
    closed = rows[-1][0] - timedelta(days=1)
    want = batch.where(F.col("window_end") <= F.lit(closed))

    def clean(df):
        return df.select(*[F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

    assert live.count() > 50 and clean(live).exceptAll(clean(want)).count() == 0 and clean(want).exceptAll(clean(live)).count() == 0


def test_stream_alerts_append_each_input_once(spark, tmp_path):
    schema = "timestamp timestamp, product_id string, warehouse_id string, current_stock double, inventory_days double"
    rows = [(datetime(2024, 1, 1), "a", "W1", 1.0, 2.0), (datetime(2024, 1, 1), "b", "W1", 1.0, 5.0), (datetime(2024, 1, 1), "c", "W1", 1.0, 50.0)]

    def run():
        stream = stock.stream_alerts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), F.col("timestamp"))
        return stock.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "progress"))

    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    assert {(r.product_id, r.alert_level) for r in run().collect()} == {("a", "CRITICAL"), ("b", "WARNING")}
    spark.createDataFrame([(datetime(2024, 1, 2), "d", "W1", 1.0, 1.0)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert run().count() == 3


def test_files_are_read_by_their_own_header(spark, tmp_path, rows):
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a.csv").write_text("x,y\n1,one\n")
    (tmp_path / "u" / "b.csv").write_text("y,x\ntwo,2\n")
    (tmp_path / "u" / "c.csv").write_text("y\nthree\n")
    (tmp_path / "u" / "d.csv").write_text("")
    schema = schemas.struct(x=schemas.NUMBER, y=schemas.TEXT)
    want = [(1.0, "one"), (2.0, "two"), (None, "three")]
    assert rows(files.scan_dir_union(spark, str(tmp_path / "u"), schema), "x", "y") == want
    assert rows(files.scan_csv(spark, str(tmp_path / "u"), schema), "x", "y") == want


def test_an_empty_upload_can_be_the_newest(spark, tmp_path):
    import os

    for n, (name, text) in enumerate([("old", "x,y\n1,one\n"), ("new", "x,y\n")]):
        (tmp_path / name).mkdir()
        (tmp_path / name / "p.csv").write_text(text)
        os.utime(tmp_path / name / "p.csv", (1_000_000 + n, 1_000_000 + n))
    schema = schemas.struct(x=schemas.NUMBER, y=schemas.TEXT)
    assert files.sync_latest(spark, str(tmp_path), schema).count() == 0
    assert files.sync_latest(spark, str(tmp_path), schema, "suppliers").count() == 0


def test_upsert_with_undated_and_repeated_updates(table):
    old = table("id string, lead double", ("a", 1.0))
    new = table("id string, lead double, at string", ("a", 5.0, "2024-01-02"), ("a", 9.0, None), ("a", 7.0, "2024-01-03"))
    for n in (1, 3):
        assert [tuple(r) for r in files.upsert_by_key(old, new.repartition(n), "id", {}, "at").collect()] == [("a", 7.0)]
    with pytest.raises(Exception, match="repeated key a"):
        files.upsert_by_key(old, new, "id", {}).collect()


def test_no_row_is_lost_to_a_missing_feature(spark):
    from harborline.operators import modeling

    data = [(float(n), float(n % 7), float(n * 2)) for n in range(60)]
    train = spark.createDataFrame(data, "a double, b double, y double")
    holes = spark.createDataFrame([(None, 1.0, 2.0), (float("nan"), None, 1.0), (3.0, 3.0, 6.0)], "a double, b double, y double")
    assert modeling.predict(modeling.fit_regression(train, ["a", "b"], "y", trees=2), holes).where("prediction is not null").count() == 3
    churn = train.withColumn("churned", (F.col("a") > 30).cast("int")).withColumn("observation_date", F.current_date())
    scored = modeling.score_sellers(modeling.fit_churn(churn, ["a", "b"]), holes)
    assert scored.where("churn_probability between 0 and 1").count() == 3 and scored.columns == ["a", "b", "y", "churn_probability", "risk_tier"]


def test_latest_of_rows_that_share_a_date(table):
    from harborline.operators.inventory import join_inventory_demand

    stock = table("product_id string, avg_daily_sales double", ("p", 1.0))
    seen = table("product_id string, date string, region string, roll_30_mean double, roll_7_std double", ("p", "d", "a", 1.0, 1.0), ("p", "d", "b", 2.0, 2.0))
    for order in ("region", "-roll_30_mean"):
        shuffled = seen.orderBy(F.expr(order)).coalesce(1)
        assert [tuple(r)[2:] for r in join_inventory_demand(stock, shuffled).collect()] == [(2.0, 2.0)]


def test_features_of_a_row_are_ranked_in_the_row(spark):
    from harborline.operators import reports

    weights = {"x": 2.0, "y": -1.0, "z": 0.5}
    df = spark.createDataFrame([("a", 1.0, 4.0, None), ("b", 5.0, 4.0, 2.0), ("c", 3.0, -8.0, 8.0)], "id string, x double, y double, z double")
    rows, records = modeling.feature_attribution(df, ["id"], weights), modeling.attributed(df, weights)
    for found, same in (
        (modeling.attribution_explain(records, ["id"], 2), modeling.attribution_explain(rows, ["id"], 2)),
        (reports.top_drivers(records, ["id"], 2).select("id", "top_drivers"), reports.top_drivers(rows, ["id"], 2)),
    ):
        assert sorted(found.collect()) == sorted(same.collect()) and found.columns == same.columns
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r["rank"]): (r.feature, r.direction, r.amount) for r in modeling.attribution_explain(records, ["id"], 2).collect()}
    assert got[("a", 1)] == ("x", "DECREASES", 4.0) and got[("a", 2)] == ("y", "DECREASES", 4.0) and got[("c", 1)] == ("y", "INCREASES", 8.0)
    assert {r.id: [d.feature for d in r.top_drivers] for r in reports.top_drivers(records, ["id"], 2).collect()} == {"a": [], "b": ["x"], "c": ["y", "z"]}
