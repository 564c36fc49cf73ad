"""The relational tables as temporary views, so that analysts' statements run as plain ``spark.sql`` text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harborline.plans.registry import QUERIES, add
from harborline.plans.tables import Tables

# View name: the domain table it shows in the registered queries.
RELATIONS = {
    "products": "v_inventory", "suppliers": "v_orm_suppliers", "forecasts": "v_orm_forecasts", "alerts": "v_orm_alerts", "reorders": "v_orm_reorders",
}


def register(spark: SparkSession, **tables: DataFrame) -> None:
    """Make DataFrames from any input known by name in this session."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def _statement(t: Tables, text: str) -> DataFrame:
    register(t.spark, **{name: t[source] for name, source in RELATIONS.items()})
    return t.spark.sql(text)


def _over_views(text: str) -> str:
    for name, source in RELATIONS.items():
        text = text.replace(f"{{{source}}}", name)
    return text


RISK_RANKING = """SELECT p.product_id, p.product_name, p.warehouse_id, count(a.id) AS total_active_alerts, count_if(a.severity = 'CRITICAL') AS critical_alerts,
  count_if(a.severity = 'WARNING') AS warning_alerts, array_join(array_sort(collect_set(a.alert_type)), ',') AS alert_types
FROM products p JOIN alerts a ON p.product_id = a.product_id WHERE NOT a.is_acknowledged GROUP BY 1, 2, 3 HAVING count(a.id) > 0"""

for _name in ("stock_health_sql", "supplier_tier_sql", "stockout_timeline_sql", "risk_ranking_sql", "reorder_supplier_sql"):
    _query = QUERIES[_name]
    _text = RISK_RANKING if _name == "risk_ranking_sql" else _over_views(_query.sql)
    add(_name.replace("_sql", "_text"), lambda t, text=_text: _statement(t, text), _query.sql, " ".join(_query.doubles))
