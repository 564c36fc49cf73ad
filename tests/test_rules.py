"""Hand-worked cases of the single-row rules and aggregates."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from harborline.functions import columns
from harborline.operators import demand, inventory, reports, scenario, supplier, warehouse


def test_chain_on_a_small_plant(table, rows):
    stock = table(
        "product_id string, warehouse_id string, current_stock double, safety_stock double, reorder_point double",
        ("a", "W1", 1000.0, 200.0, 300.0), ("b", "W2", 90.0, 10.0, 40.0), ("c", "W2", None, None, 5.0),
    )
    sales = table(
        "product_id string, date date, daily_sales string",
        ("a", date(2024, 1, 1), "100"), ("a", date(2024, 1, 2), "300"), ("b", date(2024, 1, 1), "oops"), ("b", date(2024, 1, 2), "30"),
    )
    moves = table(
        "shipment_id string, supplier_id string, product_id string, expected_delivery string, actual_delivery string",
        ("1", "s1", "a", "2024-01-05", "2024-01-08"), ("2", "s1", "a", "2024-01-05", None), ("3", "s2", "b", "2024-01-05", "2024-01-05"),
    )
    partners = table("supplier_id string, lead_time_days double", ("s1", 10.0), ("s2", 4.0))
    sold = demand.sales_agg(sales).join(demand.spike_counts(demand.demand_spike(demand.clean_sales(sales))), "product_id", "left")
    merged = inventory.inventory_days(inventory.join_supply_chain(stock, sold, inventory.shipment_agg(moves)))
    got = {r.product_id: r for r in merged.collect()}
    assert (got["a"].avg_daily_sales, got["a"].total_daily_sales, round(got["a"].stddev_daily_sales, 4)) == (200.0, 400.0, 141.4214)
    assert (got["a"].total_delays, got["a"].avg_delay_days, got["a"].inventory_days) == (1, 1.5, 5.0)
    # Text that is no number counts as 0, so 30 is above 1.5 times the mean of 0 and 30.
    assert (got["b"].avg_daily_sales, got["b"].total_spikes, got["b"].demand_spike) == (15.0, 1, True)
    # No sales and no shipments: the defaults.
    assert (got["c"].current_stock, got["c"].avg_daily_sales, got["c"].total_daily_sales, got["c"].total_delays) == (0.0, 1.0, 0.0, 0)
    plan = {r.product_id: r for r in inventory.reorder_plan(inventory.mean_demand_forecast(merged), moves, partners).collect()}
    assert (plan["a"].reorder_quantity, plan["a"].stockout_risk) == (1200.0, True)
    assert plan["a"].alert_message == "Product a will stockout in 5 days. Reorder immediately."
    assert (plan["b"].supplier_lead_time, plan["b"].reorder_quantity, plan["b"].stockout_risk) == (4.0, 0.0, False)
    assert plan["b"].alert_message == "Product b stock level healthy."
    assert (plan["c"].supplier_lead_time, plan["c"].reorder_quantity) == (7.0, 7.0)
    cost = {r.product_id: r.total_cost_impact for r in inventory.cost_impact(inventory.mean_demand_forecast(merged)).collect()}
    assert cost == {"a": 2000.0, "b": 180.0, "c": 5.0}


def test_bounds_are_closed_as_given(table, rows):
    scores = table("reliability_score double", (85.0,), (85.1,), (60.0,), (59.9,), (None,))
    assert rows(supplier.supplier_status(scores), "reliability_score", "supplier_status") == [
        (59.9, "CRITICAL"), (60.0, "WARNING"), (85.0, "WARNING"), (85.1, "GOOD"), (None, "CRITICAL")
    ]
    load = table("utilization_percent double", (85.0,), (40.0,), (39.0,), (90.0,), (None,))
    assert rows(warehouse.warehouse_status(load), "utilization_percent", "status") == [
        (39.0, "LOW"), (40.0, "NORMAL"), (85.0, "NORMAL"), (90.0, "HIGH"), (None, "LOW")
    ]
    days = table("d double", (2.9,), (3.0,), (7.0,), (7.1,), (None,))
    status, score = inventory.health_of_days(F.col("d"))
    assert rows(days.select("d", status.alias("s"), score.alias("n")), "d", "s", "n") == [
        (2.9, "CRITICAL", 20), (3.0, "WARNING", 60), (7.0, "WARNING", 60), (7.1, "GOOD", 100), (None, "GOOD", 100)
    ]
    p = table("churn_probability double", (0.3,), (0.31,), (0.7,), (0.71,))
    assert [t for _, t in rows(reports.churn_risk_tier(p), "churn_probability", "risk_tier")] == ["GOOD", "WARNING", "WARNING", "CRITICAL"]


def test_score_of_zero_has_no_tier(table):
    perfect = table(
        "supplier_id string, on_time_rate double, avg_delay_days double, avg_defect_units double", ("a", 1.0, 0.0, 0.0), ("b", 0.0, 4.0, 2.0)
    )
    got = {r.supplier_id: (r.supplier_risk_score, r.risk_tier) for r in supplier.supplier_risk_score(perfect).collect()}
    assert got == {"a": (0.0, None), "b": (1.0, "HIGH")}


def test_inventory_risk_known_rows(table):
    stock = table(
        "product_id string, current_stock double, reorder_point double, lead_time_days double, avg_demand_30d double, unit_cost double, holding_cost_rate double",
        ("1", 237.0, 112.0, 3.0, 38.48066666666667, 321.52, 0.18), ("2", 4721.0, 158.0, 20.0, 67.23466666666667, 339.97, 0.15),
        ("3", 10.0, 0.0, 8.0, 5.0, 1.0, 0.1),
    )
    got = {r.product_id: r for r in inventory.inventory_risk(stock).collect()}
    assert got["1"].days_of_stock == pytest.approx(6.1589369553542035) and got["1"].overstock_ratio == pytest.approx(0.7053571428571429)
    assert got["1"].annual_holding_cost == pytest.approx(13716.0432) and (got["1"].is_overstock, got["1"].is_understocked) == (0, 0)
    assert got["2"].days_of_stock == pytest.approx(70.216753262206) and (got["2"].overstock_ratio, got["2"].is_overstock) == (5.0, 1)
    assert (got["3"].overstock_ratio, got["3"].stockout_risk, got["3"].is_understocked) == (5.0, 0.75, 1)


def test_no_sales_and_empty_warehouse(table):
    stock = table("product_id string, warehouse_id string, current_stock double, avg_daily_sales double", ("a", "W1", 5.0, 0.0))
    assert inventory.inventory_days(stock).first().inventory_days == 9999.0
    sites = table("warehouse_id string, capacity double", ("W1", 10.0), ("W9", 10.0))
    got = {r.warehouse_id: (r.utilization_percent, r.status) for r in warehouse.warehouse_utilization(sites, stock).collect()}
    assert got == {"W1": (50.0, "NORMAL"), "W9": (0.0, "LOW")}


def test_pending_shipments_do_not_rate_a_supplier(table):
    moves = table(
        "shipment_id string, supplier_id string, expected_delivery date, actual_delivery date",
        ("1", "a", date(2024, 1, 5), date(2024, 1, 5)), ("2", "a", date(2024, 1, 5), None), ("3", "b", date(2024, 1, 5), date(2024, 1, 8)),
    )
    got = {r.supplier_id: (r.total_shipments, r.reliability_score, r.delay_rate, r.supplier_status) for r in supplier.supplier_performance(moves).collect()}
    assert got == {"a": (1, 100.0, 0.0, "GOOD"), "b": (1, 0.0, 100.0, "CRITICAL")}


def test_scenario_without_capacity(table):
    stock = table("product_id string, current_stock double, predicted_demand double, supplier_lead_time double", ("a", 100.0, 10.0, 5.0))
    runs = scenario.scenario_whatif(stock, [("calm", 0, 0, 100, 1.0), ("shut", 0, 0, 0, 1.0), ("surge", 0, 150, 100, 2.0)])
    got = {r.scenario: (r.sim_days_until_stockout, r.sim_financial_impact) for r in runs.collect()}
    assert got == {"calm": (10.0, 200.0), "shut": (10.0, 250.0), "surge": (4.0, 650.0)}
    bare = scenario.scenario_whatif(stock.select("product_id", "current_stock"), [("late", 3, 0, 100, 1.0)]).first()
    assert (bare.sim_delay_days, bare.sim_demand, bare.sim_days_until_stockout, bare.sim_financial_impact) == (3.0, 100.0, 1.0, 700.0)


def test_last_known_value(table):
    from harborline.operators.ordering import latest_nonnull

    seen = table("k string, t int, x double, y double", ("a", 1, 1.0, 5.0), ("a", 2, 2.0, None), ("a", 3, None, None), ("b", 1, None, None))
    assert {r.k: (r.x, r.y) for r in latest_nonnull(seen, ["k"], "t", ["x", "y"]).collect()} == {"a": (2.0, 5.0), "b": (None, None)}


def test_text_and_parsing(table):
    one = table("s string, n string, d string", ("  Global  Tech Supply", "otd_rate_30d", "2024-13-01"))
    got = one.select(
        columns.short_name("s"), columns.feature_title("n"), columns.lenient_date("d"), columns.lenient_number(F.lit("x1")), columns.lenient_number(F.lit("NaN"))
    ).first()
    assert tuple(got) == ("Global Tech", "Otd Rate 30D", None, None, None)


def test_baseline_forecast_may_stop_at_n(table):
    stock = table("product_id string, current_stock double", ("a", 100.0), ("b", 0.0), ("c", 1000.0))
    assert [r.product_id for r in inventory.baseline_forecast(stock, 2).collect()] == ["a", "b"]
    got = {r.product_id: (r.predicted_demand, r.avg_daily_sales, r.days_until_stockout) for r in inventory.baseline_forecast(stock).collect()}
    assert got == {"a": (10.0, 2.0, 50.0), "b": (1.0, 0.1, 0.0), "c": (100.0, 20.0, 50.0)}


def test_model_inputs_without_optional_columns(table):
    bare = table("product_id string, current_stock double, daily_demand double", ("a", 10.0, 2.0), ("b", -3.0, None))
    got = {r.product_id: r for r in inventory.demand_model_features(bare).collect()}
    assert (got["a"].inventory_days, got["a"].is_high_stock, got["a"].excess_stock, got["a"].warehouse_encoded) == (5.0, 1.0, 10.0, 0.0)
    assert (got["b"].avg_daily_sales, got["b"].log_current_stock) == (1.0, 0.0)


def test_missing_result_tables_count_as_zero(spark, table):
    health = table("health_status string", ("CRITICAL",), ("GOOD",))
    assert tuple(reports.global_risk_summary(spark, health, None, None, None).first()) == (1, 0, 0, 0)
