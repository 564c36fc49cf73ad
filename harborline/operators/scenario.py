"""What-if scenarios over the stock table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harborline import fixed_values as fixed
from harborline.functions.columns import clip

Scenario = tuple[str, float, float, float, float]


def scenario_presets(spark: SparkSession) -> DataFrame:
    schema = "name string, delay_days double, demand_spike double, supplier_capacity double, cost_multiplier double"
    return spark.createDataFrame(fixed.SCENARIO_PRESETS, schema)


def with_scenarios(df: DataFrame, scenarios: Iterable[Scenario]) -> DataFrame:
    """Each row once per scenario. The scenarios are a short list written into the plan; nothing is joined."""
    structs = [
        F.struct(
            F.lit(name).alias("scenario"), F.lit(float(delay)).alias("_delay"), F.lit(float(spike)).alias("_spike"),
            F.lit(float(capacity)).alias("_capacity"), F.lit(float(cost)).alias("_cost"),
        )
        for name, delay, spike, capacity, cost in scenarios
    ]
    return df.select("*", F.inline(F.array(*structs)))


def scenario_whatif(df: DataFrame, scenarios: Iterable[Scenario] = fixed.SCENARIO_PRESETS) -> DataFrame:
    """Simulated delay, demand, days until stock-out and cost of every product in every scenario.

    Missing columns have defaults: no delay, a demand of 100, a lead time of 7 days. Without supplier
    capacity the lead time is endless (999).
    """
    have = df.columns
    delay = F.col("avg_delay_days") if "avg_delay_days" in have else F.lit(0.0)
    demand = F.col("predicted_demand") if "predicted_demand" in have else F.lit(100.0)
    lead = F.col("supplier_lead_time") if "supplier_lead_time" in have else F.lit(7.0)
    stock = F.col("current_stock")
    out = with_scenarios(df, scenarios).withColumns({
        "sim_delay_days": delay + F.col("_delay"), "sim_demand": demand * (1 + F.col("_spike") / 100),
    })
    days = F.when(F.col("sim_demand") > 0, F.try_divide(stock, F.col("sim_demand"))).otherwise(999.0)
    out = out.withColumn("sim_days_until_stockout", F.bround(days, 1))
    reach = F.when(F.col("_capacity") == 0, 999.0).otherwise(lead + F.col("sim_delay_days"))
    stockout = F.when(F.col("sim_days_until_stockout") < reach, F.col("sim_demand") * 5.0 * F.col("_cost")).otherwise(0.0)
    impact = stock * 2.0 * F.col("_cost") + stockout
    return out.withColumn("sim_financial_impact", impact).drop("_delay", "_spike", "_capacity", "_cost")


def scenario_totals(simulated: DataFrame) -> DataFrame:
    return simulated.groupBy("scenario").agg(
        F.sum("sim_financial_impact").alias("total_impact"), F.avg("sim_days_until_stockout").alias("avg_days"),
        F.count_if(F.col("sim_days_until_stockout") < 7).alias("short_products"),
    )


def scenario_melt(simulated: DataFrame) -> DataFrame:
    """Before and after values of each simulated row below each other."""
    pairs = simulated.select(
        F.col("product_id").alias("product"), F.col("scenario").alias("case"),
        F.col("days_until_stockout").alias("Before"), F.col("sim_days_until_stockout").alias("After"),
    )
    return pairs.unpivot(["product", "case"], ["Before", "After"], "scenario", "days_until_stockout")


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in (0, 1) fixed by the seed and the given values.

    The same row gets the same number on every run, whatever the partitioning and however often a lost
    task is repeated.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0

