"""End-to-end jobs: the operators chained from the input tables to the tables a team looks at."""

from __future__ import annotations

from datetime import date
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from harborline import fixed_values as fixed
from harborline.operators import demand, inventory, modeling, reports, sellers, supplier, warehouse
from harborline.operators.sampling import random_split
from harborline.session import stored

SELLER_KEYS = sellers.POINT


def job_operations_overview(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Inventory, sales, shipments, suppliers and warehouses to reorders, health, cost, ratings and risk counts.

    Mean demand stands in for a fitted forecast. The merged stock table and the reorder plan are stored because every
    product result reads them.
    """
    spikes = demand.spike_counts(demand.demand_spike(tables["sales"]))
    sold = demand.sales_agg(tables["sales"]).join(spikes, "product_id", "left")
    merged = inventory.inventory_days(
        inventory.join_supply_chain(tables["inventory"], sold, inventory.shipment_agg(tables["shipments"]))
    )
    forecast = inventory.mean_demand_forecast(stored(merged, "merged"))
    reorder = stored(inventory.reorder_plan(forecast, tables["shipments"], tables["suppliers"]), "reorder")
    health, cost = inventory.health_score(reorder), inventory.cost_impact(forecast)
    performance = supplier.supplier_performance(tables["shipments"])
    load = warehouse.warehouse_utilization(tables["warehouses"], tables["inventory"])
    return {
        "forecast": forecast,
        "reorder": reorder,
        "health": health,
        "cost": cost,
        "suppliers": performance,
        "warehouses": load,
        "summary": reports.global_risk_summary(merged.sparkSession, health, performance, load, cost),
        "products": reorder.select("product_id", "warehouse_id", "reorder_quantity", "stockout_risk", "alert_message")
        .join(health.select("product_id", "health_status", "health_score", "days_until_stockout"), "product_id")
        .join(cost, "product_id"),
    }


def job_feature_tables(sales: DataFrame, inventory_table: DataFrame, shipments: DataFrame) -> dict[str, DataFrame]:
    """Demand features per sales row, supplier features, and inventory features that use the latest demand."""
    demand_rows = demand.demand_features(sales)
    return {
        "demand": demand_rows,
        "suppliers": supplier.supplier_feature_table(shipments),
        "inventory": inventory.inventory_risk(inventory.join_inventory_demand(inventory_table, demand_rows)),
    }


def job_seller_dataset(
    raw: dict[str, DataFrame], dates: DataFrame, test_from: date
) -> dict[str, DataFrame]:
    """Marketplace tables to stored master, training rows and test rows (observation dates from ``test_from`` on)."""
    master = stored(
        sellers.master_build(
            raw["orders"], raw["items"], raw["sellers"], raw["reviews"], raw["products"], raw["category_translation"], partial(stored, name="items")
        ),
        "master",
    )
    rows = stored(sellers.seller_dataset(master, dates), "sellers")
    later = F.col("observation_date") >= F.lit(test_from)
    return {"master": master, "train": rows.where(~later), "test": rows.where(later)}


def job_seller_scoring(train: DataFrame, test: DataFrame, iterations: int = 100) -> dict[str, DataFrame]:
    """Fit on the training rows, score the test rows, explain every score and build the seller records."""
    features = fixed.SELLER_FEATURES
    model = modeling.fit_churn(train, features, iterations=iterations)
    scored = stored(modeling.score_sellers(model, test), "scored")
    weights = modeling.churn_weights(model, features)
    contributions = modeling.feature_attribution(scored, SELLER_KEYS, weights)
    drivers = reports.top_drivers(modeling.attributed(scored, weights), SELLER_KEYS)
    return {
        "scored": scored,
        "metrics": modeling.classification_metrics(scored, "churned", "churn_probability"),
        "average_precision": modeling.average_precision(scored, "churned", "churn_probability"),
        "importance": modeling.attribution_importance(contributions),
        "profiles": reports.seller_risk_profiles(drivers),
    }


def _lines(section: str, df: DataFrame, name: Column, value: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("string").alias("value"))


def job_daily_report(results: dict[str, DataFrame]) -> DataFrame:
    """The six tables of the daily report as lines of section, name and value."""
    def rounded(c: str) -> Column:
        return F.round(c, 2).cast("decimal(30,2)")

    summary = reports.executive_summary(results["health"], results["cost"])
    figures = F.map_from_arrays(
        F.array(*[F.lit(n) for n in ("Total Products", "Critical Products", "Warning Products", "Avg Health Score")]),
        F.array(F.col("total_products").cast("string"), F.col("critical").cast("string"), F.col("warning").cast("string"),
                rounded("avg_health_score").cast("string")),
    )
    parts = [
        _lines("summary", summary.select(F.explode(figures).alias("k", "v")), F.col("k"), F.col("v")),
        _lines("critical", reports.critical_products(results["health"]), F.col("product_id"), rounded("days_until_stockout")),
        _lines("suppliers", reports.supplier_league(results["suppliers"]), F.col("supplier_id"), rounded("reliability_score")),
        _lines("warehouses", results["warehouses"], F.col("warehouse_id"), F.col("status")),
        _lines("exposure", results["cost"].agg(F.sum("total_cost_impact").alias("t")), F.lit("Total Financial Exposure"), rounded("t")),
        _lines("actions", reports.urgent_actions(results["reorder"]), F.col("product_id"), F.col("alert_message")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def demand_forecast_job(merged: DataFrame, features: list[str] = fixed.DEMAND_FEATURES, **params) -> dict[str, DataFrame]:
    """Fit demand on four fifths of the products, judge it on the rest and forecast every product."""
    rows = stored(random_split(inventory.demand_model_features(merged), ["product_id"]), "demand")
    model = modeling.fit_regression(rows.where("split = 'train'"), features, "avg_daily_sales", **params)
    scored = modeling.predict(model, rows)
    forecast = inventory.stockout_forecast(scored.withColumnRenamed("prediction", "predicted_demand"))
    judged = scored.where("split = 'test'")
    return {"forecast": forecast, "metrics": modeling.regression_metrics(judged, "avg_daily_sales", "prediction")}
