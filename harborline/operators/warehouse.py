"""Warehouse load."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def warehouse_stock_share(df: DataFrame) -> DataFrame:
    return df.groupBy("warehouse_id").agg(F.sum("current_stock").alias("current_stock"))


def join_warehouse(warehouses: DataFrame, inventory: DataFrame) -> DataFrame:
    """Warehouses with their stock; empty ones stay, with 0."""
    stock = inventory.groupBy("warehouse_id").agg(F.sum("current_stock").alias("total_stock"))
    return warehouses.join(stock, "warehouse_id", "left").withColumn("total_stock", F.coalesce("total_stock", F.lit(0.0)))


def warehouse_status(df: DataFrame, high: float = 85.0, normal: float = 40.0) -> DataFrame:
    used = F.col("utilization_percent")
    return df.withColumn("status", F.when(used > high, "HIGH").when(used.between(normal, high), "NORMAL").otherwise("LOW"))


def warehouse_utilization(warehouses: DataFrame, inventory: DataFrame) -> DataFrame:
    used = F.try_divide("total_stock", "capacity") * 100
    return warehouse_status(join_warehouse(warehouses, inventory).withColumn("utilization_percent", used))
