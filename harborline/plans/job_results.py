"""The other results of the whole-chain jobs, each checked by the SQL of the operator that makes it."""

from __future__ import annotations

from harborline.plans import jobs
from harborline.plans.job_queries import _inputs, _train_test
from harborline.plans.registry import QUERIES, add

OVERVIEW = {
    "health": "health_score", "cost": "cost_impact", "suppliers": "supplier_performance", "warehouses": "warehouse_utilization", "summary": "global_risk_summary",
}

for _result, _operator in OVERVIEW.items():
    _query = QUERIES[_operator]
    add(
        f"job_operations_overview_{_result}", lambda t, name=_result: jobs.job_operations_overview(_inputs(t))[name],
        _query.sql, " ".join(_query.doubles), _query.digits,
    )

add(
    "job_feature_tables_suppliers", lambda t: jobs.job_feature_tables(t.stored_sales, t.inventory, t.deliveries)["suppliers"],
    """SELECT s.*, r.recent_90d_on_time_rate FROM {d_supplier_score} s LEFT JOIN {d_recent} r ON s.supplier_id = r.supplier_id""",
    "avg_delay_days on_time_rate avg_defect_units total_spend avg_order_value recent_90d_on_time_rate supplier_risk_score", 4,
)
_query = QUERIES["demand_features"]
add(
    "job_feature_tables_demand", lambda t: jobs.job_feature_tables(t.brand_sales, t.inventory, t.deliveries)["demand"],
    _query.sql, " ".join(_query.doubles), _query.digits,
)
for _result in ("metrics", "importance", "scored", "average_precision"):
    add(f"job_seller_scoring_{_result}", lambda t, name=_result: jobs.job_seller_scoring(*_train_test(t))[name])
