"""Summaries, distributions and top lists over result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harborline.functions.columns import feature_title, flag, total_of


def count_where(df: DataFrame | None, condition: Column) -> Column:
    """Rows that satisfy a condition, 0 for a table that does not exist."""
    return F.lit(0).cast("bigint") if df is None else total_of(df, F.count_if(condition))


def global_risk_summary(
    spark: SparkSession, health: DataFrame | None, suppliers: DataFrame | None, warehouses: DataFrame | None,
    cost: DataFrame | None, cost_cut: float = 500.0,
) -> DataFrame:
    return spark.range(1).select(
        count_where(health, F.col("health_status") == "CRITICAL").alias("critical_products"),
        count_where(suppliers, F.col("supplier_status") == "CRITICAL").alias("unreliable_suppliers"),
        count_where(warehouses, F.col("status") == "HIGH").alias("overloaded_warehouses"),
        count_where(cost, F.col("total_cost_impact") > cost_cut).alias("high_cost_products"),
    )


def kpi_summary(demand: DataFrame, reorder: DataFrame) -> DataFrame:
    return demand.agg(F.count_distinct("product_id").alias("total_products"), F.avg("inventory_days").alias("avg_inventory_days")).select(
        "total_products",
        total_of(reorder, F.count_distinct(F.when(F.col("stockout_risk"), F.col("product_id")))).alias("at_risk"),
        "avg_inventory_days",
        total_of(reorder, F.sum("reorder_quantity")).alias("total_reorder_qty"),
    )


def executive_summary(health: DataFrame, cost: DataFrame) -> DataFrame:
    return health.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(F.col("health_status") == "CRITICAL").alias("critical"),
        F.count_if(F.col("health_status") == "WARNING").alias("warning"),
        F.coalesce(F.avg("health_score"), F.lit(0.0)).alias("avg_health_score"),
    ).withColumn("total_exposure", total_of(cost, F.coalesce(F.sum("total_cost_impact"), F.lit(0.0))))


def cost_totals(cost: DataFrame) -> DataFrame:
    return cost.agg(
        F.sum("inventory_holding_cost").alias("holding"), F.sum("stockout_cost").alias("stockout"),
        F.sum("total_cost_impact").alias("exposure"),
    )


def inventory_summary(risk: DataFrame) -> DataFrame:
    return risk.agg(F.count_if(F.col("stockout_risk") > 0.5).alias("critical"), F.sum("is_overstock").alias("overstocked"))


def reorder_summary(reorder: DataFrame) -> DataFrame:
    return reorder.agg(
        F.count(F.lit(1)).alias("items"), F.count_if("stockout_risk").alias("at_risk"),
        F.count_if(F.col("reorder_quantity") > 0).alias("reorders"),
    )


def forecast_summary(forecast: DataFrame) -> DataFrame:
    return forecast.agg(
        F.count(F.lit(1)).alias("predictions"), F.avg("predicted_demand").alias("avg_predicted_demand"),
        F.avg("days_until_stockout").alias("avg_days_until_stockout"),
    )


def low_reliability_share(suppliers: DataFrame, cut: float = 0.75) -> DataFrame:
    low = F.col("reliability_score") < cut
    return suppliers.agg(F.count_if(low).alias("suppliers"), F.avg(flag(low).cast("int")).alias("share"))


def open_alerts(products: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts with the name and warehouse of their product."""
    return products.select("product_id", "product_name", "warehouse_id").join(
        alerts.select("id", "product_id", "alert_type", "severity", "is_acknowledged"), "product_id"
    )


def risk_ranking(products: DataFrame, alerts: DataFrame) -> DataFrame:
    """Products by their unacknowledged alerts, most severe first.

    The alerts are counted per product and type before the join; the few types are listed at the end.
    """
    def of(severity: str) -> Column:
        return F.count_if(F.col("severity") == severity)

    by_type = alerts.where(~F.col("is_acknowledged")).groupBy("product_id", "alert_type").agg(
        F.count("id").alias("n"), of("CRITICAL").alias("c"), of("WARNING").alias("w")
    )
    by_product = by_type.groupBy("product_id").agg(
        F.sum("n").alias("total_active_alerts"), F.sum("c").alias("critical_alerts"), F.sum("w").alias("warning_alerts"),
        F.array_join(F.sort_array(F.collect_set("alert_type")), ",").alias("alert_types"),
    )
    named = products.select("product_id", "product_name", "warehouse_id").join(by_product.where("total_active_alerts > 0"), "product_id")
    return named.orderBy(F.desc("critical_alerts"), F.desc("warning_alerts"), F.desc("total_active_alerts"), "product_id")


def status_distribution(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def status_mean(df: DataFrame, col: str, value: str, name: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("status")).agg(F.avg(value).alias(name))


def top(df: DataFrame, k: int, *order: Column | str, where: Column | None = None) -> DataFrame:
    """The first ``k`` rows; the last order column has to make the order unique."""
    return (df if where is None else df.where(where)).orderBy(*order).limit(k)


def top_demand(demand: DataFrame, k: int = 15) -> DataFrame:
    return top(demand, k, F.desc("predicted_demand"), "product_id").select("product_id", "predicted_demand")


def worst_suppliers(suppliers: DataFrame, k: int = 3) -> DataFrame:
    return top(suppliers, k, F.desc("delay_rate"), "supplier_id")


def supplier_league(performance: DataFrame, k: int = 5) -> DataFrame:
    return top(performance, k, F.desc("reliability_score"), "supplier_id").select("supplier_id", "reliability_score", "delay_rate")


def critical_products(health: DataFrame, k: int = 5) -> DataFrame:
    rows = top(health, k, "days_until_stockout", "product_id", where=F.col("health_status") == "CRITICAL")
    return rows.select("product_id", "current_stock", "days_until_stockout")


def urgent_actions(reorder: DataFrame, k: int = 5) -> DataFrame:
    return top(reorder, k, "days_until_stockout", "product_id", where=F.col("stockout_risk")).select("product_id", "alert_message")


def hardest_products(mae: DataFrame, k: int = 10) -> DataFrame:
    return top(mae, k, F.desc("mae"), "product_id")


def alert_history(alerts: DataFrame, k: int = 10) -> DataFrame:
    """The newest critical and warning alerts."""
    return top(alerts, k, F.desc("created_at"), F.desc("id"), where=F.col("severity").isin("CRITICAL", "WARNING"))


def daily_report_row(health: DataFrame, cost: DataFrame, performance: DataFrame, day: Column) -> DataFrame:
    """One row: critical products, the most critical and the most expensive item and the worst supplier."""
    critical = F.when(F.col("health_status") == "CRITICAL", F.struct("days_until_stockout", "product_id"))
    return health.agg(
        F.count_if(F.col("health_status") == "CRITICAL").alias("critical_products_count"),
        F.min_by("product_id", critical).alias("top_critical_item"),
    ).select(
        day.alias("report_date"), "critical_products_count", "top_critical_item",
        total_of(cost, F.min_by("product_id", F.struct(-F.col("total_cost_impact"), F.col("product_id")))).alias("top_cost_impact_item"),
        total_of(performance, F.min_by("supplier_id", F.struct("reliability_score", "supplier_id"))).alias("worst_supplier"),
    )


# Scored sellers.

def churn_risk_tier(df: DataFrame, cuts: tuple[float, float] = (0.3, 0.7)) -> DataFrame:
    """Tier of a probability; a value on a cut belongs to the lower tier."""
    p = F.col("churn_probability")
    return df.withColumn("risk_tier", F.when(p <= cuts[0], "GOOD").when(p <= cuts[1], "WARNING").when(p > cuts[1], "CRITICAL"))


def by_risk(df: DataFrame) -> list[Column]:
    return [F.desc("churn_probability"), F.col("seller_id"), F.col("observation_date")]


def churn_tier_filter(profiles: DataFrame, tier: str | None = None, limit: int = 100) -> DataFrame:
    where = F.col("risk_tier") == tier.upper() if tier else None
    return top(profiles, limit, *by_risk(profiles), where=where)


def seller_lookup(profiles: DataFrame, seller_id: str) -> DataFrame:
    """The most at-risk record of one seller, if there is one."""
    return top(profiles, 1, *by_risk(profiles), where=F.col("seller_id") == seller_id)


def riskiest_seller(scored: DataFrame) -> DataFrame:
    return top(scored, 1, *by_risk(scored))


def critical_impact(scored: DataFrame) -> DataFrame:
    critical = F.col("risk_tier") == "CRITICAL"
    return scored.agg(
        F.count_if(critical).alias("flagged"),
        F.coalesce(F.sum(F.when(critical, F.col("churned"))), F.lit(0)).alias("true_churn"),
        F.coalesce(F.sum(F.when(critical, F.col("revenue_at_risk_30d"))), F.lit(0.0)).alias("revenue_at_risk"),
    )


def by_record(contributions: DataFrame, keys: list[str]) -> DataFrame:
    """One row per record with its ``contributions`` as an array; rows that have it stay as they are, unshuffled."""
    if "contributions" in contributions.columns:
        return contributions
    return contributions.groupBy(*keys).agg(F.collect_list(F.struct("feature", "value", "contribution")).alias("contributions"))


def top_drivers(contributions: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """Per record the ``k`` features that push its risk up most, largest first, as an array of structs.

    A record has one contribution per model feature, so its array is short. Attributed records keep their other columns.
    """
    rising = F.transform(F.filter("contributions", lambda c: c["contribution"] > 0), lambda c: F.struct(
        (-c["contribution"]).alias("o"), c["feature"].alias("feature"), c["value"].alias("value"), c["contribution"].alias("shap_impact"),
    ))
    picked = F.transform(
        F.slice(F.sort_array(rising), 1, k),
        lambda d: F.struct(d["feature"].alias("feature"), d["value"].alias("value"), d["shap_impact"].alias("shap_impact")),
    )
    return by_record(contributions, keys).withColumn("top_drivers", picked).drop("contributions")


def seller_risk_profiles(scored: DataFrame, drivers: DataFrame | None = None) -> DataFrame:
    """The nested record of a scored seller: key figures, metrics and drivers.

    Without ``drivers`` the scored rows carry their own ``top_drivers``, and nothing is joined.
    """
    keys = ["seller_id", "observation_date"]
    metrics = F.struct(
        F.col("orders_30d").cast("double").alias("orders_30d"),
        F.col("rolling_30d_otd_rate").alias("otd_rate"),
        F.col("rolling_30d_avg_review").alias("review_score"),
        F.col("dispatch_delay_slope").alias("dispatch_delay_slope"),
    )
    return (scored if drivers is None else scored.join(drivers, keys, "left")).select(
        *keys, "seller_state", "churn_probability", "risk_tier",
        F.col("revenue_at_risk_30d").alias("revenue_at_risk"),
        (F.col("churned") == 1).alias("actual_churn"),
        metrics.alias("metrics"), "top_drivers",
    )


def driver_impact(profiles: DataFrame, k: int = 5) -> DataFrame:
    """The features with the largest mean impact among all listed drivers."""
    drivers = profiles.select(F.explode("top_drivers").alias("d"))
    means = drivers.groupBy(F.col("d.feature").alias("feature")).agg(F.avg("d.shap_impact").alias("impact"))
    return top(means, k, F.desc("impact"), "feature")


def titled_features(importance: DataFrame) -> DataFrame:
    return importance.withColumn("title", feature_title("feature"))
