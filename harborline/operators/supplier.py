"""Supplier performance, profiles and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from harborline import fixed_values as fixed
from harborline.functions.columns import flag, lenient_date, total_of
from harborline.session import stored


def shipment_delay(shipments: DataFrame) -> DataFrame:
    """Days late (negative: early); shipments still under way are dropped."""
    dated = shipments.withColumns({c: lenient_date(c) for c in ("expected_delivery", "actual_delivery")})
    delay = F.date_diff("actual_delivery", "expected_delivery")
    return dated.withColumn("delay_days", delay).where(F.col("delay_days").isNotNull())


def shipment_calendar(shipments: DataFrame) -> DataFrame:
    return shipments.withColumns({
        "shipment_weekday": F.weekday("shipment_date") + 1,
        "shipment_month": F.month("shipment_date"),
        "planned_transit_days": F.date_diff("expected_delivery", "shipment_date"),
    })


def supplier_status(df: DataFrame, good: float = 85.0, warn: float = 60.0) -> DataFrame:
    score = F.col("reliability_score")
    return df.withColumn("supplier_status", F.when(score > good, "GOOD").when(score.between(warn, good), "WARNING").otherwise("CRITICAL"))


def supplier_performance(shipments: DataFrame) -> DataFrame:
    delivered = shipment_delay(shipments)
    totals = delivered.groupBy("supplier_id").agg(
        F.avg("delay_days").alias("average_delay"),
        F.count("shipment_id").alias("total_shipments"),
        F.count_if(F.col("delay_days") <= 0).alias("on_time_shipments"),
    )
    share = F.try_divide("on_time_shipments", "total_shipments") * 100
    return supplier_status(totals.withColumn("reliability_score", share).withColumn("delay_rate", 100 - share))


def _feature_columns() -> list[Column]:
    return [
        F.count("shipment_id").alias("total_shipments"),
        F.avg("delay_days").alias("avg_delay_days"),
        F.max("delay_days").alias("max_delay_days"),
        F.avg(F.col("on_time").cast("int")).alias("on_time_rate"),
        F.avg("defective_units").alias("avg_defect_units"),
        F.sum("total_cost").alias("total_spend"),
        F.avg("total_cost").alias("avg_order_value"),
    ]


def supplier_features(shipments: DataFrame) -> DataFrame:
    return shipments.groupBy("supplier_id").agg(*_feature_columns())


def supplier_recent(shipments: DataFrame, date: str = "order_date", days: int = 90) -> DataFrame:
    """On-time rate of every supplier over the last ``days`` days before the newest order of all."""
    start = F.date_sub(total_of(shipments, F.max(date)), days)
    recent = shipments.where(F.col(date) >= start).groupBy("supplier_id")
    return recent.agg(F.avg(F.col("on_time").cast("int")).alias(f"recent_{days}d_on_time_rate"))


def supplier_feature_table(shipments: DataFrame, date: str = "order_date", days: int = 90) -> DataFrame:
    """All supplier features with the recent on-time rate, score and tier.

    The shipments are aggregated once; the result, one row per supplier, is stored, as the score reads it for its maxima too.
    """
    recent = F.col(date) >= F.date_sub(total_of(shipments, F.max(date)), days)
    rate = F.avg(F.when(recent, F.col("on_time").cast("int"))).alias(f"recent_{days}d_on_time_rate")
    return supplier_risk_score(stored(shipments.groupBy("supplier_id").agg(*_feature_columns(), rate), "supplier-features"))


def supplier_risk_score(features: DataFrame, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """Weighted score with a tier from left-open bins: a score of 0 or less, or above 1, has no tier."""
    late, delay, defect = weights
    score = (
        (1 - F.col("on_time_rate")) * late
        + F.try_divide(F.col("avg_delay_days"), total_of(features, F.max("avg_delay_days"))) * delay
        + F.try_divide(F.col("avg_defect_units"), total_of(features, F.max("avg_defect_units"))) * defect
    )
    s = F.col("supplier_risk_score")
    tier = F.when((s > 0) & (s <= 0.2), "LOW").when((s > 0.2) & (s <= 0.4), "MEDIUM").when((s > 0.4) & (s <= 1), "HIGH")
    return features.withColumn("supplier_risk_score", score).withColumn("risk_tier", tier)


def supplier_metrics(shipments: DataFrame) -> DataFrame:
    """Delay figures and the share of shipments whose status is ``Delayed``."""
    delayed = flag(F.col("status") == "Delayed")
    return shipment_delay(shipments).groupBy("supplier_id").agg(
        F.avg("delay_days").alias("avg_delay_days"),
        F.max("delay_days").alias("max_delay_days"),
        F.avg(delayed.cast("int")).alias("delay_rate"),
        F.count(F.lit(1)).alias("total_shipments"),
        F.count_if(delayed).alias("delayed_shipments"),
    )


def supplier_profile(delays: DataFrame) -> DataFrame:
    return delays.groupBy("supplier_id").agg(
        F.avg("delay_days").alias("avg_supplier_delay"),
        F.coalesce(F.stddev_samp("delay_days"), F.lit(0.0)).alias("std_supplier_delay"),
        F.avg((F.col("delay_days") > 0).cast("int")).alias("supplier_late_ratio"),
        F.count(F.lit(1)).alias("total_shipments"),
    )


def join_profile_back(facts: DataFrame, profile: DataFrame, key: str = "supplier_id") -> DataFrame:
    """Facts with the profile of their key.

    An aggregate and a join, not a window: a window would bring all rows of a hot key into one task.
    """
    return facts.join(profile, key, "left")


def join_supplier_metrics(suppliers: DataFrame, metrics: DataFrame) -> DataFrame:
    return suppliers.join(metrics, "supplier_id", "left")


def supplier_risk_tier(df: DataFrame) -> DataFrame:
    rel, late = F.col("reliability_score"), F.col("delay_rate")
    tier = F.when((rel >= 0.90) & (late <= 0.15), "LOW_RISK").when((rel < 0.75) | (late >= 0.30), "AT_RISK")
    return df.withColumn("risk_tier", tier.otherwise("MEDIUM_RISK"))


def supplier_composite_risk(df: DataFrame, weights: tuple[float, float, float] = (40.0, 35.0, 25.0)) -> DataFrame:
    rel, late, lead = weights
    risk = (
        (1 - F.col("reliability_score")) * rel
        + F.col("delay_rate") * late
        + F.try_divide(F.col("lead_time_days"), total_of(df, F.max("lead_time_days"))) * lead
    )
    score = F.col("composite_risk")
    band = F.when(score < 20, "SAFE").when(score < 35, "WATCH").when(score >= 35, "ALERT")
    return df.withColumn("composite_risk", risk).withColumn("band", band)


def supplier_tier(suppliers: DataFrame) -> DataFrame:
    """Supplier list with tier; reliability in percent, delay rate as a fraction."""
    first, second, third, last = fixed.SUPPLIER_TIERS

    def reaches(reliability: float, delay: float) -> Column:
        return (F.col("reliability_score") >= reliability) & (F.col("delay_rate") < delay)

    tier = F.when(reaches(95, 0.05), first).when(reaches(85, 0.15), second).when(reaches(70, 0.25), third).otherwise(last)
    return suppliers.select(
        "supplier_id", "supplier_name", "status", "reliability_score", "delay_rate", "lead_time_days", tier.alias("supplier_tier")
    ).orderBy(F.desc("reliability_score"), "delay_rate", "supplier_id")


def reorder_supplier(reorders: DataFrame, suppliers: DataFrame, limit: int = 50) -> DataFrame:
    """Urgent reorders that depend on a risky supplier, most urgent first."""
    lead = F.col("supplier_lead_time") * (1 + F.col("delay_rate"))
    risky = (F.col("supplier_status") == "AT_RISK") | (F.col("delay_rate") > 0.3)
    supplier_side = suppliers.select(
        F.col("supplier_id").alias("primary_supplier_id"), "supplier_name", F.col("status").alias("supplier_status"),
        "reliability_score", "delay_rate",
    )
    rows = reorders.where("stockout_risk").join(supplier_side, "primary_supplier_id", "left").where(risky)
    return rows.select(
        "product_id", "reorder_quantity", "stockout_risk", "priority", "supplier_lead_time", "supplier_name",
        "supplier_status", "reliability_score", "delay_rate", lead.alias("adjusted_expected_lead_time"),
    ).orderBy(F.desc("priority"), F.desc("adjusted_expected_lead_time"), "product_id").limit(limit)


def delay_model_rows(shipments: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Delivered shipments with supplier profile, supplier master data and calendar."""
    delays = shipment_delay(shipments)
    rows = join_profile_back(delays, supplier_profile(delays))
    return shipment_calendar(rows.join(suppliers.select("supplier_id", "reliability_score", "lead_time_days"), "supplier_id", "left"))
