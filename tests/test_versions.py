"""Versioned tables, quarantine of bad records, and the streams that use them."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from harborline.operators import stats
from harborline.sources import files, schemas, versions
from harborline.streaming import stock

PAIRS = "id string, v double"


@pytest.fixture
def kept(spark, tmp_path):
    return versions.VersionedTable(spark, str(tmp_path / "table"))


def pairs(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_table_replaces_what_it_is_read_from(kept, table):
    with pytest.raises(FileNotFoundError):
        kept.read()
    assert kept.replace(table(PAIRS, ("a", 1.0), ("b", 2.0))).number == 1
    before = kept.read()
    kept.replace(kept.read().withColumn("v", F.col("v") * 10))
    kept.upsert(table(PAIRS, ("b", 7.0), ("c", 8.0)), "id", {})
    assert pairs(kept.read()) == [("a", 10.0), ("b", 7.0), ("c", 8.0)]
    # Who read an earlier version goes on with it.
    assert pairs(before) == pairs(kept.read(1)) == [("a", 1.0), ("b", 2.0)]
    assert [(r.number, r.operation) for r in kept.history().orderBy("number").collect()] == [(1, "replace"), (2, "replace"), (3, "upsert")]


def test_a_failed_write_leaves_the_table_as_it_was(kept, table):
    kept.replace(table(PAIRS, ("a", 1.0)))
    failing = table(PAIRS, ("a", 2.0)).withColumn("v", F.when(F.col("v") > 1, F.raise_error(F.lit("no"))).otherwise(F.col("v")).cast("double"))
    with pytest.raises(Exception, match="no"):
        kept.replace(failing)
    assert pairs(kept.read()) == [("a", 1.0)] and kept.version().number == 1


def test_of_two_writers_one_fails(kept, table):
    first = kept.replace(table(PAIRS, ("a", 1.0)))
    kept.replace(table(PAIRS, ("a", 2.0)))
    with pytest.raises(versions.Conflict):
        kept.replace(table(PAIRS, ("a", 3.0)), after=first)
    assert pairs(kept.read()) == [("a", 2.0)]
    assert not [n for n in os.listdir(f"{kept.root}/commits") if not n.startswith("0") and not n.startswith(".0")]


def test_merges_write_only_their_rows(kept, table, monkeypatch):
    monkeypatch.setattr(versions, "MOST_PARTS", 3)
    for n in range(3):
        kept.merge(table(PAIRS, ("a", float(n)), (f"k{n}", 1.0), (None, float(n))), ["id"], "s", n)
    assert len(kept.version().parts) == 3
    assert pairs(kept.read()) == [("a", 2.0), ("k0", 1.0), ("k1", 1.0), ("k2", 1.0), (None, 2.0)]
    # A batch that runs again changes nothing, whatever it brings.
    assert kept.merge(table(PAIRS, ("a", 99.0)), ["id"], "s", 2).number == kept.version().number == 3
    kept.merge(table(PAIRS, ("a", 5.0)), ["id"], "s", 3)
    assert len(kept.version().parts) == 1 and kept.version().batches == {"s": 3}
    assert ("a", 5.0) in pairs(kept.read()) and kept.read().count() == 5
    with pytest.raises(ValueError):
        kept.merge(table(PAIRS, ("a", 5.0)), ["v"])
    assert kept.forget() == 4 and kept.read().count() == 5 and kept.numbers() == [kept.version().number]


def test_the_newest_upload_takes_the_tables_place_once(spark, tmp_path, kept):
    schema = schemas.struct(x=schemas.NUMBER, y=schemas.TEXT)
    (tmp_path / "up" / "empty").mkdir(parents=True)
    assert kept.sync_latest(str(tmp_path / "up"), schema) is None
    for n, (name, text) in enumerate([("old", "x,y\n1,one\n"), ("new", "y,x\ntwo,2\nthree,3\n")]):
        (tmp_path / "up" / name).mkdir()
        (tmp_path / "up" / name / "p.csv").write_text(text)
        os.utime(tmp_path / "up" / name / "p.csv", (1_000_000 + n, 1_000_000 + n))
        assert kept.sync_latest(str(tmp_path / "up"), schema).number == n + 1
        assert kept.sync_latest(str(tmp_path / "up"), schema).number == n + 1
    assert pairs(kept.read().select("x", "y")) == [(2.0, "two"), (3.0, "three")]


def test_updates_without_a_key(table):
    old = table("id string, v double, w double", ("a", 1.0, 1.0), (None, 2.0, 2.0))
    new = table("id string, v double, at string", (None, 9.0, "2024-01-02"), (None, 8.0, "2024-01-01"), ("b", 3.0, None))
    want = [("a", 1.0, 1.0), ("b", 3.0, None), (None, 9.0, 2.0)]
    assert pairs(files.upsert_by_key(old, new, "id", {}, "at")) == want
    assert pairs(files.upsert_by_key(old, new.where("at IS NULL OR v = 9.0"), "id", {})) == want
    assert pairs(files.upsert_by_key(old.where("id = 'a'"), new, "id", {}, "at")) == [("a", 1.0, 1.0), ("b", 3.0, None), (None, 9.0, None)]


def test_box_of_the_group_without_a_name(table):
    df = table("g string, v double", ("a", 1.0), ("a", 3.0), (None, 5.0), (None, None))
    assert pairs(stats.box_stats(df, "g", "v").select("g", "min", "median", "max", "mean")) == [("a", 1.0, 2.0, 3.0, 2.0), (None, 5.0, 5.0, 5.0, 5.0)]


def test_every_line_is_a_row_or_in_quarantine(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.csv").write_text('x,y,z\n1,one,2024-01-02\n2\n3,a,b,c\n\nfour,"q, q",2024-01-02\n5,,\n6,six,soon\n')
    (tmp_path / "c" / "b.csv").write_text("y,x\nseven,7\neight\n")
    (tmp_path / "c" / "c.csv").write_text("")
    good, bad = files.scan_csv_checked(spark, str(tmp_path / "c"), schemas.struct(x=schemas.NUMBER, y=schemas.TEXT, z=schemas.DAY))
    assert sorted((r.x, r.y) for r in good.collect()) == [(1.0, "one"), (5.0, None), (7.0, "seven")]
    assert good.select("y").count() == 3 and good.count() == 3
    assert {(r.text, r.reason) for r in bad.collect()} == {
        ("2", "not 3 fields"), ("3,a,b,c", "not 3 fields"), ('four,"q, q",2024-01-02', "x is no double"), ("6,six,soon", "z is no date"), ("eight", "not 2 fields"),
    }
    assert {r.file.rsplit("/", 1)[1] for r in bad.collect()} == {"a.csv", "b.csv"}
    (tmp_path / "none").mkdir()
    assert [df.count() for df in files.scan_csv_checked(spark, str(tmp_path / "none"), schemas.TABLES["sales"])] == [0, 0]


def test_every_record_is_an_event_or_in_quarantine(spark, tmp_path):
    event = {"timestamp": "2024-01-01T00:00:00Z", "product_id": "p", "warehouse_id": "W1", "change_type": "sale", "quantity": 3}
    lines = [json.dumps(event), json.dumps(event)[:-9], "nonsense", json.dumps(event | {"timestamp": None}), json.dumps(event | {"quantity": "many"})]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(str(tmp_path / "in"))
    for _ in range(2):
        records = spark.readStream.format("text").load(str(tmp_path / "in"))
        stock.events_and_quarantine(records, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "at")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "ok")).count() == 1
        bad = {r.text: r.reason for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
        assert bad == {lines[1]: "no event", lines[2]: "no event", lines[3]: "no timestamp", lines[4]: "no event"}


EVENT = "timestamp timestamp, product_id string, warehouse_id string, change_type string, quantity double"


def test_a_kept_table_has_all_windows(spark, tmp_path, kept):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=5 * i), f"p{i % 3}", "W1", "sale", float(i % 11)) for i in range(120)]
    for part in range(4):
        spark.createDataFrame(rows[part * 30:(part + 1) * 30], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    inventory = spark.createDataFrame([(f"p{i}", 30.0) for i in range(3)], "product_id string, current_stock double")
    stream = stock.stream_source(spark, "parquet", path=str(tmp_path / "in"), maxFilesPerTrigger="1")
    stock.keep_windows(stock.stream_metrics(stream, inventory), kept, stock.WINDOW_KEY, str(tmp_path / "at"), "s").awaitTermination()
    batch = stock.stream_metrics(spark.read.parquet(str(tmp_path / "in")), inventory)

    def clean(df):
        return {tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in df.select(*batch.columns).collect()}

    assert clean(kept.read()) == clean(batch) and kept.read().count() == batch.count()
    # The same batches again, as after a lost checkpoint.
    before = kept.version()
    stream = stock.stream_source(spark, "parquet", path=str(tmp_path / "in"), maxFilesPerTrigger="1")
    stock.keep_windows(stock.stream_metrics(stream, inventory), kept, stock.WINDOW_KEY, str(tmp_path / "again"), "s").awaitTermination()
    assert kept.version() == before


def test_the_first_alert_comes_out_at_once(spark, tmp_path):
    schema = "timestamp timestamp, product_id string, warehouse_id string, alert_level string, inventory_days double, current_stock double"
    batches = [
        [(datetime(2024, 1, 1, 8), "a", "W1", "CRITICAL", 1.0, 1.0)],
        [(datetime(2024, 1, 1, 9), "a", "W1", "CRITICAL", 2.0, 2.0), (datetime(2024, 1, 1, 9), "a", "W1", "WARNING", 5.0, 5.0)],
        [(datetime(2024, 1, 2, 7), "a", "W1", "CRITICAL", 3.0, 3.0)],
    ]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stock.stream_dedup(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        seen.append(sorted(r.inventory_days for r in stock.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "at")).collect()))
    assert seen == [[1.0], [1.0, 5.0], [1.0, 3.0, 5.0]]
    alerts = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    assert stock.stream_dedup(alerts).count() == 3 and stock.stream_dedup(alerts).columns[:2] == ["window_start", "window_end"]


def test_repeats_of_alerts_are_counted_with_the_earliest(spark, tmp_path):
    schema = "timestamp timestamp, product_id string, warehouse_id string, alert_level string, inventory_days double, current_stock double"
    batches = [
        [(datetime(2024, 1, 1, 8), "a", "W1", "CRITICAL", 1.0, 1.0), (datetime(2024, 1, 1, 9), None, "W1", "WARNING", 5.0, 5.0)],
        [(datetime(2024, 1, 1, 7), "a", "W1", "CRITICAL", 2.0, 4.0), (datetime(2024, 1, 1, 7), "a", "W1", "CRITICAL", 2.5, 3.0)],
        [(datetime(2024, 1, 2, 7), "a", "W1", "CRITICAL", 3.0, 3.0)],
    ]
    table = versions.VersionedTable(spark, str(tmp_path / "alerts"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stock.alert_repeats(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stock.keep_windows(stream, table, stock.ALERT_KEY, str(tmp_path / "at"), "alerts").awaitTermination()
    got = {(r.window_start.day, r.product_id, r.alert_level): (r.timestamp.day, r.timestamp.hour, r.inventory_days, r.current_stock, r.repeats) for r in table.read().collect()}
    # The last window is there although nothing came after it.
    assert got == {(1, "a", "CRITICAL"): (1, 7, 2.0, 4.0, 3), (1, None, "WARNING"): (1, 9, 5.0, 5.0, 1), (2, "a", "CRITICAL"): (2, 7, 3.0, 3.0, 1)}
    batch = stock.alert_repeats(spark.read.schema(schema).parquet(str(tmp_path / "in")))
    assert sorted(batch.collect(), key=repr) == sorted(table.read().select(*batch.columns).collect(), key=repr)
