"""Stock, reorder, health and cost rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from harborline import fixed_values as fixed
from harborline.functions.columns import clip, days_as_text, flag, lenient_date
from harborline.operators.ordering import label_encode, latest_nonnull


def inventory_days(df: DataFrame, default: float = 9999.0) -> DataFrame:
    days = F.when(F.col("avg_daily_sales") > 0, F.try_divide("current_stock", "avg_daily_sales")).otherwise(F.lit(default))
    return df.withColumn("inventory_days", days)


def shipment_agg(shipments: DataFrame) -> DataFrame:
    """Late shipments and mean delay per product; a pending shipment counts as no delay."""
    late = F.date_diff(lenient_date("actual_delivery"), lenient_date("expected_delivery"))
    rows = shipments.withColumn("_delay", F.coalesce(late, F.lit(0)))
    return rows.groupBy("product_id").agg(
        F.count_if(F.col("_delay") > 0).alias("total_delays"), F.avg("_delay").alias("avg_delay_days")
    )


def join_supply_chain(inventory: DataFrame, sales: DataFrame, shipments: DataFrame) -> DataFrame:
    """Inventory with the sales and shipment figures of each product, defaults where there are none.

    ``sales`` and ``shipments`` are aggregated to one row per product before they get here.
    """
    fills = {
        "avg_daily_sales": 1.0, "total_daily_sales": 0.0, "stddev_daily_sales": 0.0, "total_spikes": 0,
        "demand_spike": False, "total_delays": 0, "avg_delay_days": 0.0,
    }
    own = [c for c in inventory.columns if c not in fills]
    stock = {c: F.coalesce(c, F.lit(0.0)) for c in ("current_stock", "safety_stock", "reorder_point") if c in own}
    joined = inventory.select(*own).withColumns(stock).join(sales, "product_id", "left").join(shipments, "product_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fills.items()})


def stock_health(products: DataFrame) -> DataFrame:
    empty, critical, warning, healthy = fixed.STOCK_HEALTH
    stock = F.col("current_stock")
    status = (
        F.when(stock <= 0, empty).when(stock <= F.col("safety_stock"), critical).when(stock <= F.col("reorder_point"), warning)
    )
    return products.select(
        "product_id", "product_name", "warehouse_id", "current_stock", "safety_stock", "reorder_point",
        (stock - F.col("safety_stock")).alias("stock_buffer"),
        status.otherwise(healthy).alias("inventory_health_status"),
    ).orderBy("stock_buffer", "product_id")


def stock_status(df: DataFrame) -> DataFrame:
    stock = F.col("current_stock")
    low = F.when(stock <= F.col("safety_stock"), "Critical").when(stock <= F.col("reorder_point"), "Reorder Needed")
    return df.withColumn("stock_status", low.otherwise("Healthy"))


def health_of_days(days: Column) -> tuple[Column, Column]:
    """Status and score of so many days until stock-out; unknown days are good."""
    status = F.when(days < 3, "CRITICAL").when(days.between(3, 7), "WARNING").otherwise("GOOD")
    score = F.when(days < 3, 20).when(days.between(3, 7), 60).otherwise(100)
    return status, score


def health_score(reorder: DataFrame) -> DataFrame:
    status, score = health_of_days(F.col("days_until_stockout"))
    return reorder.select(
        "product_id", "current_stock", "predicted_demand", "days_until_stockout", "reorder_quantity",
        status.alias("health_status"), score.alias("health_score"),
    )


def stockout_timeline(products: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Products that run out within 30 days or have a demand spike, soonest first."""
    week, fortnight, month, later = fixed.STOCKOUT_TIMELINE
    days = F.col("days_until_stockout")
    horizon = F.when(days < 7, week).when(days < 14, fortnight).when(days < 30, month).otherwise(later)
    return (
        demand_join(products, forecasts)
        .where((days < 30) | F.col("demand_spike"))
        .withColumn("stockout_timeline", horizon)
        .orderBy("days_until_stockout", "product_id")
    )


def demand_join(products: DataFrame, forecasts: DataFrame) -> DataFrame:
    return products.select("product_id", "product_name", "current_stock").join(
        forecasts.select(
            "product_id", "predicted_demand", "avg_daily_sales", "days_until_stockout", "demand_spike", "confidence_score"
        ),
        "product_id",
    )


def cost_impact(df: DataFrame, hold: float = 2.0, out: float = 5.0, days: float = 5.0) -> DataFrame:
    holding = F.col("current_stock") * hold
    stockout = F.when(F.col("days_until_stockout") < days, F.col("predicted_demand") * out).otherwise(0.0)
    return df.select(
        "product_id", holding.alias("inventory_holding_cost"), stockout.alias("stockout_cost"),
        (holding + stockout).alias("total_cost_impact"),
    )


def join_lead_time(shipments: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Mean stated lead time per product, weighted by shipments.

    Shipments are counted per product and supplier first, so the join sees each pair once.
    """
    pairs = shipments.groupBy("product_id", "supplier_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = pairs.join(suppliers.select("supplier_id", "lead_time_days"), "supplier_id", "left")
    known = F.when(F.col("lead_time_days").isNotNull(), F.col("_n"))
    mean = F.try_divide(F.sum(F.col("lead_time_days") * F.col("_n")), F.sum(known))
    return rows.groupBy("product_id").agg(mean.alias("supplier_lead_time"))


def join_reorder(demand: DataFrame, lead_times: DataFrame, default: float = 7.0) -> DataFrame:
    joined = demand.join(lead_times, "product_id", "left")
    return joined.withColumn("supplier_lead_time", F.coalesce("supplier_lead_time", F.lit(default)))


def reorder_quantity(df: DataFrame) -> DataFrame:
    need = F.col("predicted_demand") * F.col("supplier_lead_time") + F.col("safety_stock") - F.col("current_stock")
    return df.withColumns({
        "reorder_quantity": F.bround(clip(need, low=0.0), 0),
        "stockout_risk": flag(F.col("days_until_stockout") < F.col("supplier_lead_time")),
    })


def alert_message(df: DataFrame) -> DataFrame:
    name = F.concat(F.lit(fixed.MESSAGE_NAME), F.col("product_id").cast("string"))

    def message(around: tuple[str, str], number: str) -> Column:
        return F.concat(name, F.lit(around[0]), days_as_text(F.col(number)), F.lit(around[1]))

    text = (
        F.when(F.col("stockout_risk"), message(fixed.MESSAGE_STOCKOUT, "days_until_stockout"))
        .when(F.col("reorder_quantity") > 0, message(fixed.MESSAGE_REORDER, "reorder_quantity"))
        .otherwise(F.concat(name, F.lit(fixed.MESSAGE_HEALTHY)))
    )
    return df.withColumn("alert_message", text)


def reorder_plan(demand: DataFrame, shipments: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Reorder quantities, risk flags and messages for a demand forecast."""
    return alert_message(reorder_quantity(join_reorder(demand, join_lead_time(shipments, suppliers))))


def stock_alerts(df: DataFrame, at: Column | None = None) -> DataFrame:
    """Rows with fewer than 3 (critical) or 3 to 7 (warning) days of stock; other rows are dropped."""
    days = F.col("inventory_days") if "inventory_days" in df.columns else F.lit(999.0)
    level = F.when(days < 3, "CRITICAL").when(days.between(3, 7), "WARNING")
    return df.select(
        "product_id", "warehouse_id", "current_stock", F.bround(days, 2).alias("inventory_days"),
        level.alias("alert_level"), (F.current_timestamp() if at is None else at).alias("timestamp"),
    ).where(F.col("alert_level").isNotNull())


def join_inventory_demand(inventory: DataFrame, demand_features: DataFrame) -> DataFrame:
    """Inventory with the latest known 30-row mean and 7-row deviation of demand, or estimates for them."""
    order = F.struct("date", *[c for c in ("region",) if c in demand_features.columns])
    latest = latest_nonnull(demand_features, ["product_id"], order, ["roll_30_mean", "roll_7_std"])
    joined = inventory.join(latest, "product_id", "left")
    return joined.withColumns({
        "avg_demand_30d": F.coalesce("roll_30_mean", "avg_daily_sales"),
        "demand_std": F.coalesce("roll_7_std", F.col("avg_daily_sales") * 0.2),
    }).drop("roll_30_mean", "roll_7_std")


def inventory_risk(df: DataFrame) -> DataFrame:
    stock, lead = F.col("current_stock"), F.col("lead_time_days")
    days = stock / clip(F.col("avg_demand_30d"), low=0.1)
    short = F.col("days_of_stock") < lead
    gap = clip(F.try_divide(lead - F.col("days_of_stock"), lead), high=1.0)
    # Stock without a reorder point is infinitely overstocked, which the upper limit turns into 5.
    ratio = F.when((F.col("reorder_point") == 0) & (stock > 0), 5.0).otherwise(
        clip(F.try_divide(stock, F.col("reorder_point") * 3), 0.0, 5.0)
    )
    return (
        df.withColumn("days_of_stock", days)
        .withColumns({
            "stockout_risk": F.bround(F.when(short, gap).otherwise(0.0), 4),
            "overstock_ratio": ratio,
            "is_understocked": flag(short).cast("int"),
            "annual_holding_cost": stock * F.col("unit_cost") * F.col("holding_cost_rate"),
        })
        .withColumn("is_overstock", flag(F.col("overstock_ratio") > 1.5).cast("int"))
    )


def demand_model_features(merged: DataFrame) -> DataFrame:
    """Add the 14 inputs of the demand model; columns the table lacks get their defaults."""
    have = set(merged.columns)
    df = merged
    if "avg_daily_sales" not in have:
        df = df.withColumn("avg_daily_sales", F.coalesce("daily_demand", F.lit(1.0)))
    if "avg_delay_days" not in have:
        df = df.withColumn("avg_delay_days", F.lit(0.0))
    if "inventory_days" not in have:
        df = inventory_days(df)
    stock = F.col("current_stock")

    def ratio(level: str) -> Column:
        return F.when(F.col(level) > 0, F.try_divide(stock, F.col(level))).otherwise(stock)

    has_safety, has_reorder = "safety_stock" in have, "reorder_point" in have
    new = {
        "stock_to_safety_ratio": ratio("safety_stock") if has_safety else F.lit(1.0),
        "excess_stock": stock - F.col("safety_stock") if has_safety else stock,
        "inventory_pressure": F.try_divide(F.col("safety_stock"), stock + 1) if has_safety else F.lit(0.0),
        "stock_to_reorder_ratio": ratio("reorder_point") if has_reorder else F.lit(1.0),
        "is_high_stock": (stock > F.col("reorder_point")) if has_reorder else F.lit(1),
        "demand_volatility": F.when(
            F.col("avg_daily_sales") > 0, F.try_divide("stddev_daily_sales", "avg_daily_sales")
        ).otherwise(0.0) if "stddev_daily_sales" in have else F.lit(0.0),
        "delay_risk": F.col("avg_delay_days") > 2,
        "demand_spike_int": F.col("demand_spike") if "demand_spike" in have else F.lit(0),
        "log_current_stock": F.log1p(clip(stock, low=0.0)),
        **{c: F.lit(0) for c in ("total_delays", "total_spikes") if c not in have},
    }
    df = df.withColumns(new)
    if "warehouse_id" in have:
        df = label_encode(df, "warehouse_id", "warehouse_encoded")
    else:
        df = df.withColumn("warehouse_encoded", F.lit(0))
    return df.withColumns({
        c: F.coalesce(F.nanvl(F.col(c).cast("int").cast("double") if t == "boolean" else F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
        for c, t in df.select(*fixed.DEMAND_FEATURES, "avg_daily_sales").dtypes
    })


def stockout_forecast(df: DataFrame, floor: float = 0.01) -> DataFrame:
    """Days until the stock is used up at the predicted demand; model helper columns go."""
    helpers = set(fixed.DEMAND_FEATURES) - {"inventory_days", "avg_delay_days", "total_delays", "total_spikes"}
    kept = df.withColumn("predicted_demand", clip(F.col("predicted_demand"), low=floor))
    return kept.withColumn("days_until_stockout", F.col("current_stock") / F.col("predicted_demand")).drop(*helpers)


def mean_demand_forecast(merged: DataFrame) -> DataFrame:
    """A forecast without a model: mean daily sales."""
    return stockout_forecast(merged.withColumn("predicted_demand", F.col("avg_daily_sales")))


def baseline_forecast(products: DataFrame, n: int | None = None) -> DataFrame:
    """Rule-of-thumb forecast from the stock level, for all products or the first ``n`` by id."""
    rows = products if n is None else products.orderBy("product_id").limit(n)
    stock = F.col("current_stock")
    return rows.select(
        "product_id",
        F.bround(F.greatest(F.lit(1.0), stock * 0.1), 2).alias("predicted_demand"),
        F.bround(F.greatest(F.lit(0.1), stock * 0.02), 2).alias("avg_daily_sales"),
        F.lit(False).alias("demand_spike"),
        F.bround(stock / F.greatest(F.lit(1.0), stock * 0.02), 2).alias("days_until_stockout"),
        F.lit(0.8).alias("confidence_score"),
        F.lit("v1.0").alias("model_version"),
    )


def reorder_list(reorder: DataFrame) -> DataFrame:
    return reorder.where(F.col("reorder_quantity") > 0).select("product_id", "reorder_quantity", "alert_message")


def join_health_reorder(health: DataFrame, reorder: DataFrame) -> DataFrame:
    """Health rows with those columns of the reorder table that they lack."""
    extra = [c for c in reorder.columns if c not in health.columns]
    return health.join(reorder.select("product_id", *extra), "product_id", "left")


def join_health_location(health: DataFrame, inventory: DataFrame) -> DataFrame:
    """Health rows with warehouse and site; warehouses that are not on the site list get the default site."""
    lat0, lon0, name0 = fixed.UNKNOWN_SITE
    located = health.join(inventory.select("product_id", "warehouse_id"), "product_id", "left")

    def lookup(index: int, default) -> Column:
        sites = F.create_map(*[F.lit(v) for s in fixed.WAREHOUSE_SITES for v in (s[0], s[index])])
        return F.coalesce(F.try_element_at(sites, F.col("warehouse_id")), F.lit(default))

    return located.withColumns({"lat": lookup(1, lat0), "lon": lookup(2, lon0), "location_name": lookup(3, name0)})


def status_in(df: DataFrame, col: str, statuses: list[str]) -> DataFrame:
    return df.where(F.col(col).isin(*statuses))


# Stock-policy formulas.

def safety_stock(df: DataFrame, z: float = 1.65) -> DataFrame:
    """z times demand deviation times the root of the lead time."""
    return df.withColumn("safety_stock_level", z * F.col("demand_std") * F.sqrt("lead_time_days"))


def reorder_trigger(df: DataFrame, days: int = 14, factor: float = 1.2) -> DataFrame:
    """Flag stock below ``factor`` times the demand of the next ``days`` days."""
    need = F.col("avg_demand_30d") * days
    return df.withColumn("forecast_14d", need).withColumn("needs_reorder", flag(F.col("current_stock") < factor * need))


def moq_order(df: DataFrame, moq: str = "moq", days: int = 14) -> DataFrame:
    """Demand of the next ``days`` days rounded up to whole minimum order quantities."""
    need = F.col("avg_demand_30d") * days
    return df.withColumn("order_quantity", F.ceil(F.try_divide(need, F.col(moq))) * F.col(moq))


def eoq(df: DataFrame, days_per_year: int = 365) -> DataFrame:
    """Economic order quantity from yearly demand, cost per order and yearly holding cost per unit."""
    yearly = F.col("avg_demand_30d") * days_per_year
    holding = F.col("unit_cost") * F.col("holding_cost_rate")
    return df.withColumn("eoq", F.sqrt(F.try_divide(2 * yearly * F.col("ordering_cost"), holding)))
