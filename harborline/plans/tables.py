"""The domain tables and the results built from them, each defined once and computed only when used."""

from __future__ import annotations

from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from harborline.functions.columns import flag
from harborline.operators import demand, inventory, modeling, reports, sellers, supplier, warehouse
from harborline.session import apply_settings, stored
from harborline.sources.domain import view

# A given linear churn model, for everything that explains or reports scores.
CHURN_WEIGHTS = {
    "seller_tenure_days": -0.0004,
    "orders_30d": -0.15,
    "rolling_30d_otd_rate": -0.8,
    "rolling_30d_avg_review": -0.2,
    "high_complaint_rate_30d": 0.9,
    "revenue_at_risk_30d": 0.0001,
    "cancellation_rate_30d": 0.7,
    "product_category_diversity": -0.05,
    "dispatch_time_p50_7d": 0.1,
    "seller_active_weeks": -0.25,
    "order_volume_slope": -1.5,
    "dispatch_delay_slope": 0.6,
    "review_score_slope": -0.3,
}
CHURN_INTERCEPT = 2.5
SELLER_KEYS = ["seller_id", "observation_date"]


class Tables:
    """Lazy access to one data directory: ``Tables(spark, path).reorder``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = apply_settings(spark)
        self.sf_dir = sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    # Stock and suppliers.

    @cached_property
    def inventory(self) -> DataFrame:
        return self["v_inventory"]

    @cached_property
    def sales(self) -> DataFrame:
        return self["v_sales"]

    @cached_property
    def stored_sales(self) -> DataFrame:
        """The sales as a table, for what reads them several times."""
        return stored(self.sales, "sales")

    @cached_property
    def brand_sales(self) -> DataFrame:
        return self["v_sales_brand"]

    @cached_property
    def shipments(self) -> DataFrame:
        late = flag(F.col("actual_delivery") > F.col("expected_delivery"))
        return self["v_shipments"].withColumn("status", F.when(late, "Delayed").otherwise("OnTime"))

    @cached_property
    def deliveries(self) -> DataFrame:
        """Delivered shipments with order date and on-time flag."""
        return supplier.shipment_delay(self.shipments).withColumns(
            {"order_date": F.col("shipment_date"), "on_time": F.col("delay_days") <= 0}
        )

    @cached_property
    def suppliers(self) -> DataFrame:
        return self["v_suppliers"]

    @cached_property
    def supplier_board(self) -> DataFrame:
        """Suppliers with their delay figures and risk tier."""
        return supplier.supplier_risk_tier(supplier.join_supplier_metrics(self.suppliers, supplier.supplier_metrics(self.shipments)))

    @cached_property
    def sales_by_product(self) -> DataFrame:
        spikes = demand.spike_counts(demand.demand_spike(self.stored_sales))
        return demand.sales_agg(self.stored_sales).join(spikes, "product_id", "left")

    @cached_property
    def merged(self) -> DataFrame:
        joined = inventory.join_supply_chain(self.inventory, self.sales_by_product, inventory.shipment_agg(self.shipments))
        return inventory.inventory_days(joined)

    @cached_property
    def forecast(self) -> DataFrame:
        return inventory.mean_demand_forecast(self.merged)

    @cached_property
    def reorder(self) -> DataFrame:
        return inventory.reorder_plan(self.forecast, self.shipments, self.suppliers)

    @cached_property
    def stored_forecast(self) -> DataFrame:
        """The forecast as a table, for summaries that read several results made from it."""
        return stored(self.forecast, "forecast")

    @cached_property
    def stored_reorder(self) -> DataFrame:
        return stored(inventory.reorder_plan(self.stored_forecast, self.shipments, self.suppliers), "reorder")

    @cached_property
    def health(self) -> DataFrame:
        return inventory.health_score(self.reorder)

    @cached_property
    def cost(self) -> DataFrame:
        return inventory.cost_impact(self.forecast)

    @cached_property
    def performance(self) -> DataFrame:
        return supplier.supplier_performance(self.shipments)

    @cached_property
    def warehouses(self) -> DataFrame:
        return warehouse.warehouse_utilization(self["v_warehouses"], self.inventory)

    @cached_property
    def stock_risk(self) -> DataFrame:
        """Inventory with demand of the last 30 rows and the risk columns."""
        demand_cols = demand.demand_rolling(self.stored_sales)
        return inventory.inventory_risk(inventory.join_inventory_demand(self.inventory, demand_cols))

    # Sellers.

    @property
    def _marketplace(self) -> list[DataFrame]:
        return [self[n] for n in ("v_orders", "v_items", "v_sellers", "v_reviews", "v_products_cat", "v_translation")]

    @cached_property
    def master(self) -> DataFrame:
        return sellers.master_build(*self._marketplace)

    @cached_property
    def whole_master(self) -> DataFrame:
        """The same for what reads all columns; part of it is written down on the way, so that its shuffles do not add up."""
        return sellers.master_build(*self._marketplace, keep=partial(stored, name="items"))

    @cached_property
    def dates(self) -> DataFrame:
        return sellers.observation_dates_of(self["v_orders"])

    @cached_property
    def stored_master(self) -> DataFrame:
        """The master as a table, for what reads it several times."""
        return stored(self.whole_master, "master")

    @cached_property
    def seller_rows(self) -> DataFrame:
        """The columns of the master that features and labels read, as a table; they read it several times."""
        return stored(sellers.feature_rows(self.master), "seller-rows")

    @cached_property
    def seller_items(self) -> DataFrame:
        """The same without the sellers' own, so that no row is shuffled by seller before features are made of it."""
        inputs = self["v_orders"], self["v_items"], self["v_reviews"], self["v_products_cat"], self["v_translation"]
        return stored(sellers.feature_rows(sellers.item_rows(*inputs)), "seller-items")

    @cached_property
    def seller_names(self) -> DataFrame:
        return stored(self["v_sellers"].select("seller_id", "seller_state"), "seller-names")

    def seller_columns(self, *cols: str) -> DataFrame:
        """Seller, time of purchase and the given columns of the master, as a table; no other columns are shuffled for it."""
        return stored(self.master.select("seller_id", sellers.BOUGHT, *cols), "seller-columns")

    @cached_property
    def weeks(self) -> DataFrame:
        """The master's rows for each date; not stored, so that only the columns that are asked for are shuffled."""
        return sellers.eight_weeks(self.master, self.dates)

    @cached_property
    def dataset(self) -> DataFrame:
        return sellers.seller_dataset(self.seller_items, self.dates, self.seller_names)

    @cached_property
    def stored_dataset(self) -> DataFrame:
        # Without an order: to cut ranges, Spark would compute every row twice and shuffle it once more.
        return stored(self.dataset, "sellers")

    @cached_property
    def scored(self) -> DataFrame:
        return modeling.linear_score(self.stored_dataset, CHURN_WEIGHTS, CHURN_INTERCEPT)

    @cached_property
    def contributions(self) -> DataFrame:
        return modeling.feature_attribution(self.stored_dataset, SELLER_KEYS, CHURN_WEIGHTS)

    @cached_property
    def attributed(self) -> DataFrame:
        """The dataset with the contributions of every row in the row, for what ranks them."""
        return modeling.attributed(self.stored_dataset, CHURN_WEIGHTS)

    @cached_property
    def profiles(self) -> DataFrame:
        return reports.seller_risk_profiles(reports.top_drivers(modeling.attributed(self.scored, CHURN_WEIGHTS), SELLER_KEYS))

    # A forecast to be judged: the mean of the last seven rows as the prediction.

    @cached_property
    def judged(self) -> DataFrame:
        rows = demand.forecast_features(demand.product_day_agg(self.brand_sales), encode=False)
        return rows.select("product_id", "date", "y", F.col("roll_mean_7").alias("prediction"))
