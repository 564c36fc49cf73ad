"""Registered queries over marketplace orders: master table, seller features, churn labels and scores."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import partial

from pyspark.sql import DataFrame, functions as F

from harborline import fixed_values as fixed
from harborline.operators import modeling, ordering, quality, reports, sellers
from harborline.plans.registry import add
from harborline.plans.tables import SELLER_KEYS, Tables

ROW = "order_id order_item_id product_id seller_id price".split()
ROW_SQL = ", ".join(ROW)
TEST_FROM = date(1999, 1, 1)

# Master table.

MASTER = [
    *ROW, "freight_value", "order_status", "order_purchase_timestamp", "order_approved_at", "order_estimated_delivery_date",
    "order_delivered_carrier_date", "order_delivered_customer_date", "seller_state", "review_score", "review_creation_date",
    "product_category_name", "product_category_name_english", "dispatch_days", "delivery_days", "estimated_days", "delivery_delay_days",
    "is_late", "on_time", "purchase_month", "purchase_week", "purchase_year",
]
INTERVALS = "dispatch_days delivery_days estimated_days delivery_delay_days"

add("master_build", lambda t: t.whole_master.select(*MASTER), f"SELECT {', '.join(MASTER)} FROM {{d_master}}", f"freight_value {INTERVALS}")
add(
    "first_review",
    lambda t: sellers.first_review(t["v_reviews"]),
    "SELECT * FROM {d_first_review}",
)


def _orders(t: Tables) -> DataFrame:
    return sellers.purchase_buckets(sellers.delivery_flags(sellers.dispatch_intervals(t["v_orders"])))


ORDER_SQL = """SELECT order_id, (epoch_us(order_delivered_carrier_date) - epoch_us(order_approved_at)) / 86400e6 AS dispatch_days,
  (epoch_us(order_delivered_customer_date) - epoch_us(order_approved_at)) / 86400e6 AS delivery_days,
  (epoch_us(order_estimated_delivery_date) - epoch_us(order_approved_at)) / 86400e6 AS estimated_days,
  (epoch_us(order_delivered_customer_date) - epoch_us(order_estimated_delivery_date)) / 86400e6 AS delivery_delay_days FROM {v_orders}"""
add("dispatch_intervals", lambda t: _orders(t).select("order_id", *INTERVALS.split()), ORDER_SQL, INTERVALS)
add(
    "delivery_flags",
    lambda t: _orders(t).select("order_id", "is_late", "on_time"),
    """SELECT order_id, order_status = 'delivered' AND coalesce(order_delivered_customer_date > order_estimated_delivery_date, FALSE) AS is_late,
  order_status = 'delivered' AND coalesce(order_delivered_customer_date <= order_estimated_delivery_date, FALSE) AS on_time FROM {v_orders}""",
)
add(
    "purchase_buckets",
    lambda t: _orders(t).select("order_id", "purchase_month", "purchase_week", "purchase_year"),
    """SELECT order_id, CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS purchase_month, CAST(date_trunc('week', order_purchase_timestamp) AS DATE) AS purchase_week,
  CAST(year(order_purchase_timestamp) AS INT) AS purchase_year FROM {v_orders}""",
)
add(
    "drop_incomplete",
    lambda t: quality.drop_incomplete(t.master, ["review_score", "product_category_name", "dispatch_days"]).select(*ROW, "review_score"),
    f"SELECT {ROW_SQL}, review_score FROM {{d_master}} WHERE review_score IS NOT NULL AND product_category_name IS NOT NULL AND dispatch_days IS NOT NULL",
)
add(
    "master_summary",
    lambda t: sellers.master_summary(t.master),
    """SELECT count(*) AS rows, avg(CASE WHEN order_status = 'delivered' THEN 1e0 ELSE 0e0 END) AS delivered_share, avg(CASE WHEN is_late THEN 1e0 ELSE 0e0 END) AS late_share,
  count(DISTINCT seller_id) AS sellers, CAST(min(order_purchase_timestamp) AS DATE) AS first_date, CAST(max(order_purchase_timestamp) AS DATE) AS last_date,
  avg(review_score) AS mean_review FROM {d_master}""",
    "delivered_share late_share mean_review",
)
add(
    "state_concentration",
    lambda t: sellers.state_concentration(t.master),
    """SELECT seller_state, count(DISTINCT seller_id) AS sellers, count(DISTINCT seller_id) / CAST((SELECT count(DISTINCT seller_id) FROM {d_master}) AS DOUBLE) AS share
FROM {d_master} GROUP BY 1""",
    "share",
)
add(
    "dispatch_percentiles",
    lambda t: sellers.dispatch_percentiles(t.master),
    "SELECT quantile_cont(dispatch_days, 5e-1) AS p50, quantile_cont(dispatch_days, 95e-2) AS p95 FROM {d_master} WHERE dispatch_days > 0",
    "p50 p95",
)
add(
    "review_distribution",
    lambda t: sellers.review_distribution(t.master),
    """SELECT review_score, count(DISTINCT order_id) AS orders, count(DISTINCT order_id) / CAST((SELECT count(DISTINCT order_id) FROM {d_master} WHERE review_score IS NOT NULL) AS DOUBLE) AS share
FROM {d_master} WHERE review_score IS NOT NULL GROUP BY 1""",
    "share",
)
add(
    "monthly_otd",
    lambda t: sellers.monthly_otd(t.master),
    """SELECT purchase_month, count(*) AS total_orders, count(*) FILTER (WHERE on_time) AS on_time_orders, count(*) FILTER (WHERE on_time) / CAST(count(*) AS DOUBLE) AS otd_rate
FROM {d_master} WHERE order_status = 'delivered' GROUP BY 1""",
    "otd_rate",
)

# Windows, features, labels.

add("observation_dates", lambda t: t.dates, "SELECT * FROM {d_dates}")
add(
    "window_range_join",
    lambda t: t.weeks.select(*ROW, "observation_date"),
    f"SELECT {ROW_SQL}, observation_date FROM {{d_weeks}}",
)


def _per_week(t: Tables, *cols: str, **figures: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Figures of sellers from their rows of eight weeks, with the given columns."""
    def of_weeks(made: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        return lambda rows: made(sellers.eight_weeks(rows, t.dates))

    return sellers.per_seller(t.seller_columns(*cols), **{name: of_weeks(made) for name, made in figures.items()})


def _tenure(t: Tables) -> DataFrame:
    rows = t.seller_columns("seller_state")
    points = sellers.per_seller(rows, lambda some: sellers.eight_weeks(some, t.dates).select(*SELLER_KEYS).distinct())
    return sellers.seller_tenure(rows, points)


def _gone(t: Tables) -> DataFrame:
    """Sellers that are active at a date and have no order after it."""
    return sellers.per_seller(
        t.seller_columns(), lambda rows: sellers.anti_survivors(sellers.active_sellers(rows, t.dates), sellers.future_sellers(rows, t.dates))
    )


def _dispatch_series(t: Tables) -> DataFrame:
    return _per_week(t, "dispatch_days", figures=partial(sellers.weekly_dispatch, together=True), of_many=sellers.weekly_dispatch)


RECENT = ["order_status", "on_time", "review_score", "price", "product_category_name"]
WINDOW = "rolling_30d_otd_rate rolling_30d_avg_review high_complaint_rate_30d revenue_at_risk_30d cancellation_rate_30d"
add("seller_window_aggs", lambda t: _per_week(t, *RECENT, figures=sellers.seller_window_aggs), "SELECT * FROM {d_window_aggs}", WINDOW)
add("seller_tenure", _tenure, "SELECT * FROM {d_tenure}")
add(
    "seller_dispatch_p50_7d",
    lambda t: _per_week(t, "dispatch_days", figures=partial(sellers.seller_dispatch_p50, together=True), of_many=sellers.seller_dispatch_p50),
    "SELECT * FROM {d_p50}",
    "dispatch_time_p50_7d",
)
add("seller_active_weeks", lambda t: _per_week(t, figures=sellers.seller_active_weeks), "SELECT * FROM {d_active_weeks}")
add("active_sellers", lambda t: sellers.per_seller(t.seller_columns(), lambda rows: sellers.active_sellers(rows, t.dates)), "SELECT * FROM {d_active}")
add(
    "anti_survivors",
    _gone,
    "SELECT seller_id, observation_date FROM {d_active} EXCEPT SELECT seller_id, observation_date FROM {d_future}",
)
add("churn_labels", lambda t: sellers.churn_labels(t.seller_columns(), t.dates), "SELECT * FROM {d_labels}")
add(
    "weekly_fill",
    lambda t: sellers.weekly_fill(_dispatch_series(t), True, 0.0),
    "SELECT * FROM {d_dispatch_series}",
    "y",
)
SLOPES = " ".join(sellers.TRENDS)
add("trend_slopes", lambda t: sellers.trend_slopes(t.seller_columns("review_score", "dispatch_days"), t.dates), "SELECT * FROM {d_slopes}", SLOPES)
add(
    "weekly_pivot",
    lambda t: sellers.weekly_pivot(_per_week(t, figures=sellers.weekly_volume)),
    "SELECT seller_id, observation_date, " + ", ".join(f"max(y) FILTER (WHERE week_idx = {i}) AS w{i}" for i in range(8)) + " FROM {d_volume} GROUP BY 1, 2",
)
FEATURES = f"{WINDOW} dispatch_time_p50_7d {SLOPES}"
add("labels_join_features", lambda t: t.dataset, "SELECT * FROM {d_dataset}", FEATURES)
add(
    "union_sets",
    lambda t: t.stored_dataset.where(F.col("observation_date") < TEST_FROM).withColumn("part", F.lit("train")).unionByName(
        t.stored_dataset.where(F.col("observation_date") >= TEST_FROM).withColumn("part", F.lit("test"))
    ).select(*SELLER_KEYS, "part", "churned", "orders_30d"),
    f"SELECT seller_id, observation_date, CASE WHEN observation_date < DATE '{TEST_FROM}' THEN 'train' ELSE 'test' END AS part, churned, orders_30d FROM {{d_dataset}}",
)
add(
    "seller_weekly_profile",
    lambda t: sellers.seller_weekly_profile(t.master, date(1998, 5, 1)),
    """SELECT w.week_idx, coalesce(s.orders, 0) AS orders, coalesce(s.m, 0) AS median_dispatch, coalesce(s.r, 0) AS mean_review
FROM (SELECT CAST(unnest(range(8)) AS INT) AS week_idx) w LEFT JOIN (
  SELECT CAST(floor((epoch_us(order_purchase_timestamp) - epoch_us(TIMESTAMP '1998-03-06')) / 6048e8) AS INT) AS week_idx, count(*) AS orders, median(dispatch_days) AS m, avg(review_score) AS r
  FROM {d_master} WHERE order_purchase_timestamp >= TIMESTAMP '1998-03-06' AND order_purchase_timestamp < TIMESTAMP '1998-05-01'
    AND seller_id = (SELECT seller_id FROM {d_master} WHERE order_purchase_timestamp >= TIMESTAMP '1998-03-06' AND order_purchase_timestamp < TIMESTAMP '1998-05-01'
      GROUP BY 1 ORDER BY count(*) DESC, seller_id LIMIT 1) GROUP BY 1) s ON w.week_idx = s.week_idx""",
    "median_dispatch mean_review",
)
add(
    "churn_rate",
    lambda t: sellers.churn_rate(sellers.churn_labels(t.seller_columns(), t.dates), ["observation_date"]),
    "SELECT observation_date, count(*) AS total, CAST(sum(churned) AS BIGINT) AS churned, avg(churned) AS churn_rate FROM {d_labels} GROUP BY 1",
    "churn_rate",
)
COMPARED = fixed.COMPARED_FEATURES
add(
    "churned_vs_surviving",
    lambda t: sellers.churned_vs_surviving(t.dataset, COMPARED),
    "SELECT feature, surviving, churned, round_even((churned - surviving) / nullif(surviving, 0) * 100, 1) AS pct_difference FROM ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, avg({f}) FILTER (WHERE churned = 0) AS surviving, avg({f}) FILTER (WHERE churned = 1) AS churned FROM {{d_dataset}}" for f in COMPARED
    ) + ")",
    "surviving churned pct_difference",
)

# Scores.

SCORED = "SELECT seller_id, observation_date, churn_probability, risk_tier FROM {d_scored}"


def _brief(df: DataFrame) -> DataFrame:
    return df.select(*SELLER_KEYS, "churn_probability", "risk_tier")


add("churn_risk_tier", lambda t: _brief(t.scored), SCORED, "churn_probability")
add(
    "churn_tier_filter",
    lambda t: _brief(reports.churn_tier_filter(t.scored, "critical")),
    f"{SCORED} WHERE risk_tier = 'CRITICAL' ORDER BY churn_probability DESC, seller_id, observation_date LIMIT 100",
    "churn_probability",
)
add(
    "seller_lookup",
    lambda t: _brief(reports.seller_lookup(t.scored, "11")),
    f"{SCORED} WHERE seller_id = '11' ORDER BY churn_probability DESC, seller_id, observation_date LIMIT 1",
    "churn_probability",
)
add(
    "riskiest_seller",
    lambda t: _brief(reports.riskiest_seller(t.scored)),
    f"{SCORED} ORDER BY churn_probability DESC, seller_id, observation_date LIMIT 1",
    "churn_probability",
)
add(
    "critical_impact",
    lambda t: reports.critical_impact(t.scored),
    """SELECT count(*) AS flagged, CAST(sum(churned) AS BIGINT) AS true_churn, sum(revenue_at_risk_30d) AS revenue_at_risk FROM {d_scored} WHERE risk_tier = 'CRITICAL'""",
    "revenue_at_risk", 4,
)
add(
    "feature_attribution",
    lambda t: t.contributions,
    "SELECT * FROM {d_contributions}",
    "value contribution",
)
add(
    "attribution_importance",
    lambda t: modeling.attribution_importance(t.contributions),
    "SELECT feature, avg(abs(contribution)) AS importance FROM {d_contributions} GROUP BY 1",
    "importance",
)
# Numbers of the sentences are told apart from their words: two engines may round a last digit differently.
NUMBER = r"-?\d+\.\d\d"
add(
    "attribution_explain",
    lambda t: modeling.attribution_explain(t.attributed, SELLER_KEYS).withColumn("text", F.regexp_replace("text", NUMBER, "#")),
    """SELECT *, feature || ' = # -> ' || direction || ' by #' AS text FROM (
  SELECT seller_id, observation_date, rank, feature, CASE WHEN contribution > 0 THEN 'INCREASES' ELSE 'DECREASES' END AS direction, abs(contribution) AS amount FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY seller_id, observation_date ORDER BY abs(contribution) DESC, feature) AS INT) AS rank FROM {d_contributions}) WHERE rank <= 5)""",
    "amount",
)
add(
    "top_drivers",
    lambda t: reports.top_drivers(t.attributed, SELLER_KEYS).select(
        *SELLER_KEYS, F.posexplode_outer("top_drivers").alias("place", "d")
    ).select(*SELLER_KEYS, "place", "d.feature", "d.value", "d.shap_impact"),
    """SELECT k.seller_id, k.observation_date, CAST(d.rank - 1 AS INT) AS place, d.feature, d.value, d.contribution AS shap_impact FROM (SELECT DISTINCT seller_id, observation_date FROM {d_contributions}) k
  LEFT JOIN {d_drivers} d ON k.seller_id = d.seller_id AND k.observation_date = d.observation_date""",
    "value shap_impact",
)
add(
    "seller_risk_profiles",
    lambda t: t.profiles.select(
        *SELLER_KEYS, "seller_state", "churn_probability", "risk_tier", "revenue_at_risk", "actual_churn", "metrics.*",
        F.array_join(F.transform("top_drivers", lambda d: d["feature"]), ",").alias("drivers"),
    ),
    """SELECT s.seller_id, s.observation_date, s.seller_state, s.churn_probability, s.risk_tier, s.revenue_at_risk_30d AS revenue_at_risk, s.churned = 1 AS actual_churn,
  CAST(s.orders_30d AS DOUBLE) AS orders_30d, s.rolling_30d_otd_rate AS otd_rate, s.rolling_30d_avg_review AS review_score, s.dispatch_delay_slope,
  coalesce(d.drivers, '') AS drivers FROM {d_scored} s LEFT JOIN (SELECT seller_id, observation_date, string_agg(feature, ',' ORDER BY rank) AS drivers FROM {d_drivers} GROUP BY 1, 2) d
  ON s.seller_id = d.seller_id AND s.observation_date = d.observation_date""",
    "churn_probability revenue_at_risk otd_rate review_score dispatch_delay_slope",
)
add(
    "driver_impact",
    lambda t: reports.driver_impact(t.profiles),
    "SELECT feature, avg(contribution) AS impact FROM {d_drivers} GROUP BY 1 ORDER BY impact DESC, feature LIMIT 5",
    "impact",
)

# Metrics of scores and forecasts.

add(
    "class_weight",
    lambda t: modeling.class_weight(sellers.churn_labels(t.seller_columns(), t.dates), "churned"),
    "SELECT coalesce(count(*) FILTER (WHERE churned = 0) / CAST(nullif(count(*) FILTER (WHERE churned = 1), 0) AS DOUBLE), 1) AS weight FROM {d_labels}",
    "weight",
)
add(
    "classification_metrics",
    lambda t: modeling.classification_metrics(t.scored, "churned", "churn_probability"),
    """SELECT tp, fp, tn, fn, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS precision, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS recall FROM (
  SELECT count(*) FILTER (WHERE churn_probability >= 5e-1 AND churned = 1) AS tp, count(*) FILTER (WHERE churn_probability >= 5e-1 AND churned = 0) AS fp,
    count(*) FILTER (WHERE churn_probability < 5e-1 AND churned = 0) AS tn, count(*) FILTER (WHERE churn_probability < 5e-1 AND churned = 1) AS fn FROM {d_scored})""",
    "precision recall",
)


def _rated(t: Tables) -> DataFrame:
    """Scores to six digits, so that equal sellers tie in every engine."""
    return t.scored.withColumn("churn_probability", F.round("churn_probability", 6))


add(
    "average_precision",
    lambda t: modeling.average_precision(_rated(t), "churned", "churn_probability"),
    """SELECT sum(tp * run_tp / CAST(run_n AS DOUBLE)) / (SELECT sum(churned) FROM {d_scored}) AS ap FROM (
  SELECT tp, sum(tp) OVER w AS run_tp, sum(n) OVER w AS run_n FROM (SELECT round(churn_probability, 6) AS p, sum(churned) AS tp, count(*) AS n FROM {d_scored} GROUP BY 1)
  WINDOW w AS (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "ap",
)
add(
    "time_series_folds",
    lambda t: modeling.time_series_folds(sellers.churn_labels(t.seller_columns(), t.dates)),
    """SELECT f.fold, CASE WHEN b.block = f.fold THEN 'test' ELSE 'train' END AS role, CAST(sum(b.n) AS BIGINT) AS rows FROM (SELECT CAST(unnest(range(1, 6)) AS INT) AS fold) f JOIN (
  SELECT CASE WHEN pos < total - 5 * size THEN 0 ELSE 1 + (pos - (total - 5 * size)) // size END AS block, count(*) AS n FROM (
    SELECT row_number() OVER (ORDER BY observation_date, seller_id) - 1 AS pos, count(*) OVER () AS total, count(*) OVER () // 6 AS size FROM {d_labels}) GROUP BY 1) b
  ON b.block <= f.fold GROUP BY 1, 2""",
)
add(
    "regression_metrics",
    lambda t: modeling.regression_metrics(t.judged),
    """SELECT avg(abs(y - prediction)) AS mae, sqrt(avg((y - prediction) * (y - prediction))) AS rmse,
  1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(*)) AS r2, avg(abs((y - prediction) / y)) FILTER (WHERE y <> 0) * 100 AS mape, count(*) AS n_samples FROM {d_judged}""",
    "mae rmse r2 mape",
)
add(
    "per_product_mae",
    lambda t: modeling.per_product_mae(t.judged),
    "SELECT product_id, avg(abs(y - prediction)) AS mae FROM {d_judged} GROUP BY 1",
    "mae",
)
add(
    "hardest_products",
    lambda t: reports.hardest_products(modeling.per_product_mae(t.judged)),
    "SELECT product_id, avg(abs(y - prediction)) AS mae FROM {d_judged} GROUP BY 1 ORDER BY mae DESC, product_id LIMIT 10",
    "mae",
)
add(
    "residual_stats",
    lambda t: modeling.residual_stats(t.judged),
    "SELECT avg(y - prediction) AS mean_residual, stddev_samp(y - prediction) AS std_residual FROM {d_judged}",
    "mean_residual std_residual",
)
add(
    "dedup_rows",
    lambda t: ordering.first_per_key(t["v_items"].select("order_id", "order_item_id", "product_id", "seller_id"), ["order_id"],
                                     [F.col("order_item_id"), F.col("product_id"), F.col("seller_id")]),
    """SELECT order_id, order_item_id, product_id, seller_id FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY order_item_id, product_id, seller_id) AS rn FROM {v_items}) WHERE rn = 1""",
)
