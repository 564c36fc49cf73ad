"""Live stock events and alerts. Every stream has a batch twin made of the same expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from harborline.operators.inventory import health_of_days, stock_alerts
from harborline.sources.files import CORRUPT
from harborline.sources.schemas import STOCK_EVENT
from harborline.sources.versions import VersionedTable

# Sources whose records hold JSON text in the column ``value``.
RECORDS = ("kafka", "text")
WINDOW_KEY = ["window_start", "product_id", "warehouse_id"]
ALERT_KEY = ["window_start", "product_id", "warehouse_id", "alert_level"]


def stream_source(spark: SparkSession, fmt: str, **options: str) -> DataFrame:
    """Stock events from Kafka or text files (JSON in the record or line) or from a folder of typed files."""
    if fmt in RECORDS:
        return parse_events(spark.readStream.format(fmt).options(**options).load())
    return typed(spark.readStream.format(fmt).schema(STOCK_EVENT).options(**options).load())


def read_records(records: DataFrame) -> DataFrame:
    """The events in the JSON text of records, with ``text`` and, for a record that is no event, the ``reason``."""
    schema = StructType([*STOCK_EVENT.fields, StructField(CORRUPT, StringType())])
    text = F.col("value").cast("string")
    event = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    read = records.select(text.alias("text"), event.alias("e")).select("text", "e.*")
    reason = F.when(F.col("text").isNull(), "no text").when(F.col(CORRUPT).isNotNull(), "no event").when(F.col("timestamp").isNull(), "no timestamp")
    return read.withColumn("reason", reason).drop(CORRUPT)


def parse_events(records: DataFrame) -> DataFrame:
    """The events of ``read_records``; what is none is left out, see ``quarantined``."""
    return typed(good_events(read_records(records)))


def good_events(read: DataFrame) -> DataFrame:
    return read.where(F.col("reason").isNull()).select(*STOCK_EVENT.fieldNames())


def quarantined(read: DataFrame) -> DataFrame:
    """The records that are no events: text, reason."""
    return read.where(F.col("reason").isNotNull()).select("text", "reason")


def events_and_quarantine(records: DataFrame, events: str, quarantine: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append the events of a stream of records to one Parquet table and the other records to another.

    Each batch is read once and has a folder of its own in both tables, so a batch that runs again replaces what it wrote.
    """
    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for part, path in ((good_events(kept), events), (quarantined(kept), quarantine)):
                part.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            kept.unpersist()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return read_records(records).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def typed(events: DataFrame) -> DataFrame:
    """Events with a time-zoned timestamp, as watermarks need it."""
    return events.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def demand_windows(events: DataFrame, size: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Mean demand and its volatility per product, warehouse and sliding window.

    Works on streams and tables. On a stream in append mode a window comes out once it is ``late`` past its end, in update
    mode (``keep_windows``) with every batch that changes it; events that arrive after its end by more are dropped. Events are combined before the shuffle, so a hot product
    sends one row per task and window.
    """
    grouped = typed(events).withWatermark("timestamp", late).groupBy(F.window("timestamp", size, slide), "product_id", "warehouse_id")
    mean = F.avg("quantity")
    stats = grouped.agg(mean.alias("moving_avg_demand"), F.try_divide(F.stddev_samp("quantity"), mean).alias("demand_volatility"))
    return stats.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "product_id", "warehouse_id", "moving_avg_demand", "demand_volatility")


def stream_metrics(events: DataFrame, inventory: DataFrame, **window: str) -> DataFrame:
    """Demand windows joined with the stock table: days until stock-out and health status."""
    stock = inventory.select("product_id", "current_stock")
    joined = demand_windows(events, **window).join(stock, "product_id")
    days = F.try_divide("current_stock", "moving_avg_demand")
    status, _ = health_of_days(F.col("days_until_stockout"))
    return joined.withColumn("days_until_stockout", days).withColumn("health_status", status).drop("current_stock")


def stream_alerts(rows: DataFrame, at: Column | None = None) -> DataFrame:
    """Alerts of live rows that carry ``inventory_days``; each input row is looked at once."""
    return stock_alerts(rows, at)


def stream_dedup(alerts: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """One alert of each product, warehouse and level in every window of time: the first to arrive.

    The alert comes out with the batch that brings it; later ones of its window meet its key in the state store, which
    forgets a key once the watermark has passed its alert by ``late`` (no shorter than ``size``, so a window's alerts all
    meet it). On a table any one of the alerts stays. The columns of the alert follow those of the window.
    """
    windowed = typed(alerts).withColumn("_window", F.window("timestamp", size))
    windowed = windowed.select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *typed(alerts).columns)
    keys = ALERT_KEY
    if windowed.isStreaming:
        return windowed.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(keys)
    return windowed.dropDuplicates(keys)


def alert_repeats(alerts: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """The earliest alert of each product, warehouse and level in every window of time, and how many there were.

    Works on streams and tables. On a stream use update mode (``keep_windows``, by ``ALERT_KEY``): every batch brings the
    windows that it changed, open ones too.
    """
    grouped = typed(alerts).withWatermark("timestamp", late).groupBy(F.window("timestamp", size), "product_id", "warehouse_id", "alert_level")
    first = F.min(F.struct("timestamp", "inventory_days", "current_stock")).alias("first")
    return grouped.agg(first, F.count(F.lit(1)).alias("repeats")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "product_id", "warehouse_id", "alert_level",
        "first.timestamp", "first.inventory_days", "first.current_stock", "repeats",
    )


def keep_windows(stream: DataFrame, table: VersionedTable, key: list[str], checkpoint: str, name: str, every: str | None = None) -> StreamingQuery:
    """Keep a keyed table of a stream's windows up to date, open ones included: every batch merges the windows that it changed.

    The table remembers the last batch of the stream ``name``, so a batch that runs again changes nothing.
    """
    def merge(batch: DataFrame, number: int) -> None:
        table.merge(batch, key, name, number)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = stream.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def append_to(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream's rows to a Parquet table: all that is available now, or ``every`` so often."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start(path)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now and read its table."""
    append_to(stream, path, checkpoint).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
