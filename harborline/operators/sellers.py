"""Marketplace sellers: item-grain master, point-in-time windows, features and churn labels.

All observation dates are handled in one job: every master row is copied to the dates whose window it
falls into, and one aggregate per (seller, observation date) does the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from harborline.fixed_values import SELLER_FEATURES
from harborline.functions.columns import elapsed_days, flag, whole_days
from harborline.functions.quantiles import many_rows, quantiles
from harborline.operators.ordering import first_per_key

POINT = ["seller_id", "observation_date"]
BOUGHT = "order_purchase_timestamp"
# The columns of the master that features and labels read.
FEATURE_ROW = ["seller_id", "seller_state", BOUGHT, "order_status", "on_time", "review_score", "price", "product_category_name", "dispatch_days"]
# Width, in days, of the buckets that turn the time-range join into an equi-join.
BUCKET_DAYS = 64


# Master table.

def dispatch_intervals(df: DataFrame) -> DataFrame:
    approved, customer, promised = "order_approved_at", "order_delivered_customer_date", "order_estimated_delivery_date"
    return df.withColumns({
        "dispatch_days": elapsed_days(approved, "order_delivered_carrier_date"),
        "delivery_days": elapsed_days(approved, customer),
        "estimated_days": elapsed_days(approved, promised),
        "delivery_delay_days": elapsed_days(promised, customer),
    })


def delivery_flags(df: DataFrame) -> DataFrame:
    """Late / on time for delivered orders; an order without a delivery date is neither."""
    delivered, delay = F.col("order_status") == "delivered", F.col("delivery_delay_days")
    return df.withColumns({"is_late": flag(delivered & (delay > 0)), "on_time": flag(delivered & (delay <= 0))})


def purchase_buckets(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "purchase_month": F.trunc(BOUGHT, "month"),
        "purchase_week": F.date_trunc("week", BOUGHT).cast("date"),
        "purchase_year": F.year(BOUGHT),
    })


def first_review(reviews: DataFrame) -> DataFrame:
    """The earliest review of each order; undated ones come last, equal dates go by review id."""
    order = [F.col("review_creation_date").isNull(), F.col("review_creation_date"), F.col("review_id")]
    return first_per_key(reviews, ["order_id"], order).select("order_id", "review_score", "review_creation_date")


def master_build(
    orders: DataFrame, items: DataFrame, sellers: DataFrame, reviews: DataFrame, products: DataFrame, translation: DataFrame,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per order item with everything known about its order, seller, review and product.

    The items meet what adds least to a row first. Orders and reviews are the wide ones, so they come last, in one shuffle of
    the items, and what follows from an order is added to its rows after that. ``keep`` (such as ``stored``) may write down the
    items with their sellers and products, so that the files of those shuffles are gone before the last one.
    """
    named = named_items(items.join(sellers, "seller_id", "left"), products, translation)
    return with_orders(keep(named) if keep else named, orders, reviews)


def named_items(items: DataFrame, products: DataFrame, translation: DataFrame) -> DataFrame:
    names = products.select("product_id", "product_category_name").join(translation, "product_category_name", "left")
    return items.join(names, "product_id", "left")


def with_orders(items: DataFrame, orders: DataFrame, reviews: DataFrame) -> DataFrame:
    rows = items.join(orders, "order_id", "left").join(first_review(reviews), "order_id", "left")
    return delivery_flags(purchase_buckets(dispatch_intervals(rows)))


def item_rows(orders: DataFrame, items: DataFrame, reviews: DataFrame, products: DataFrame, translation: DataFrame) -> DataFrame:
    """The master without what is known about its sellers."""
    return with_orders(named_items(items, products, translation), orders, reviews)


def feature_rows(master: DataFrame) -> DataFrame:
    """The columns that features and labels are made of, as far as they are there."""
    return master.select(*[c for c in FEATURE_ROW if c in master.columns])


def master_summary(master: DataFrame) -> DataFrame:
    return master.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((F.col("order_status") == "delivered").cast("int")).alias("delivered_share"),
        F.avg(F.col("is_late").cast("int")).alias("late_share"),
        F.count_distinct("seller_id").alias("sellers"),
        F.min(BOUGHT).cast("date").alias("first_date"),
        F.max(BOUGHT).cast("date").alias("last_date"),
        F.avg("review_score").alias("mean_review"),
    )


# Observation dates and windows.

def observation_dates(spark: SparkSession, start: date, end: date) -> DataFrame:
    """The month ends from ``start`` to ``end``."""
    return _month_ends(spark.range(1).select(F.lit(start).cast("date").alias("lo"), F.lit(end).cast("date").alias("hi")))


def observation_dates_of(df: DataFrame, col: str = BOUGHT) -> DataFrame:
    """The month ends of the time that a table covers."""
    return _month_ends(df.agg(F.min(col).cast("date").alias("lo"), F.max(col).cast("date").alias("hi")))


def _month_ends(span: DataFrame) -> DataFrame:
    months = F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month"))
    ends = span.select(F.explode(months).alias("m"), "lo", "hi").select(F.last_day("m").alias("observation_date"), "lo", "hi")
    return ends.where(F.col("observation_date").between(F.col("lo"), F.col("hi"))).select("observation_date")


def window_range_join(
    rows: DataFrame, dates: DataFrame, before: int, after: int = 0, closed: bool = False, ts: str = BOUGHT
) -> DataFrame:
    """Copy each row to the observation dates T with T - ``before`` days <= ts < T + ``after`` days (<= if closed).

    A row names the few time buckets in which such dates can lie and meets the dates there, so this is a
    hash join on the bucket with an exact filter, not a comparison of all rows with all dates. The dates are
    few and go to every task; the rows stay where they are.
    """
    day = F.unix_date(F.col(ts).cast("date"))
    low, high = F.floor((day - after) / BUCKET_DAYS), F.floor((day + before + 1) / BUCKET_DAYS)
    placed = rows.withColumn("_bucket", F.explode(F.sequence(low, high)))
    targets = dates.select("observation_date", F.floor(F.unix_date("observation_date") / BUCKET_DAYS).alias("_bucket"))
    t = F.col("observation_date").cast(rows.schema[ts].dataType)
    start, end = t - F.expr(f"interval {before} days"), t + F.expr(f"interval {after} days")
    inside = (F.col(ts) >= start) & (F.col(ts) <= end if closed else F.col(ts) < end)
    return placed.join(F.broadcast(targets), "_bucket").where(inside).drop("_bucket")


def _by_seller(master: DataFrame, hot: DataFrame | None, names: DataFrame | None = None) -> list[DataFrame]:
    """The rows with those of a seller in one task, so that windows and aggregates of sellers and dates follow without another
    shuffle; the rows of ``hot`` sellers, if there are any, apart and left where they are. Rows without the columns of their
    sellers meet the ``names`` there, once for each name of the seller."""
    if hot is None:
        parts = [master.repartition("seller_id")]
    else:
        few = F.broadcast(hot)
        parts = [master.join(few, "seller_id", "left_anti").repartition("seller_id"), master.join(few, "seller_id", "left_semi")]
    return parts if names is None else [rows.join(names.select("seller_id"), "seller_id", "left") for rows in parts]


def per_seller(
    master: DataFrame, figures: Callable[[DataFrame], DataFrame], of_many: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``figures``, a function of rows of the master, with the rows of a seller in one task, so that it need not shuffle them by
    seller and date; there they are as many times as dates see them. The rows of sellers with very many stay where they are
    and go to ``of_many``, if that is another function.

    ``master`` is read twice, so pass a stored table of the columns that are needed.
    """
    together, *apart = _by_seller(master, hot_sellers(master))
    out = figures(together)
    for rows in apart:
        out = out.unionByName((of_many or figures)(rows))
    return out


def _since(days: int) -> Column:
    return F.col(BOUGHT) >= F.col("observation_date") - F.expr(f"interval {days} days")


# Features; they read the rows of the 56 days before the observation date ("eight weeks").

def eight_weeks(master: DataFrame, dates: DataFrame) -> DataFrame:
    return window_range_join(master, dates, 56)


def _recent_parts() -> dict[str, Column]:
    """Counts and sums over the last 30 days."""
    recent = _since(30)
    complaint = flag(recent & (F.col("review_score") <= 2))
    delivered = recent & (F.col("order_status") == "delivered")
    return {
        "_n": F.count_if(recent),
        "_delivered": F.count_if(delivered),
        "_on_time": F.count_if(delivered & F.col("on_time")),
        "_review": F.avg(F.when(recent, F.col("review_score"))),
        "_complaints": F.count_if(complaint),
        "_revenue": F.sum(F.when(complaint, F.col("price"))),
        "_canceled": F.count_if(recent & (F.col("order_status") == "canceled")),
        "product_category_diversity": F.count_distinct(F.when(recent, F.col("product_category_name"))),
    }


def _recent_features(zero_otd_is_one: bool) -> list[Column]:
    rate = F.try_divide("_on_time", "_delivered")
    if zero_otd_is_one:
        rate = F.when(F.col("_on_time") > 0, rate)
    per_order = F.greatest(F.col("_n"), F.lit(1))
    return [
        F.col("_n").alias("orders_30d"),
        F.coalesce(rate, F.lit(1.0)).alias("rolling_30d_otd_rate"),
        F.coalesce("_review", F.lit(5.0)).alias("rolling_30d_avg_review"),
        (F.col("_complaints") / per_order).alias("high_complaint_rate_30d"),
        F.coalesce("_revenue", F.lit(0.0)).alias("revenue_at_risk_30d"),
        (F.col("_canceled") / per_order).alias("cancellation_rate_30d"),
        F.col("product_category_diversity"),
    ]


def seller_window_aggs(weeks: DataFrame, zero_otd_is_one: bool = True) -> DataFrame:
    """Volume, on-time rate, reviews, complaints, cancellations and categories of the last 30 days.

    With ``zero_otd_is_one`` a seller with deliveries of which none was on time gets the rate 1.0, like a
    seller without deliveries; without it, 0.0.
    """
    parts = weeks.groupBy(*POINT).agg(*[c.alias(n) for n, c in _recent_parts().items()])
    return parts.select(*POINT, *_recent_features(zero_otd_is_one))


def seller_tenure(master: DataFrame, points: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """State and completed days since the first order, for the given sellers and dates; the state from ``names``, if given."""
    state = F.max("seller_state").alias("seller_state")
    if names is None:
        first = master.groupBy("seller_id").agg(F.min(BOUGHT).alias("_first"), state)
    else:
        first = master.groupBy("seller_id").agg(F.min(BOUGHT).alias("_first")).join(names.groupBy("seller_id").agg(state), "seller_id", "left")
    days = whole_days("_first", F.col("observation_date").cast("timestamp_ntz"))
    return points.join(first, "seller_id").withColumn("seller_tenure_days", days).drop("_first")


def seller_dispatch_p50(weeks: DataFrame, approximate: bool = False, together: bool = False) -> DataFrame:
    """Median of the positive dispatch times of the last 7 days; 0 for sellers without any. ``together`` as in ``quantiles``."""
    recent = weeks.where(_since(7) & (F.col("dispatch_days") > 0))
    medians = quantiles(recent, POINT, "dispatch_days", {"dispatch_time_p50_7d": 0.5}, approximate, together)
    points = weeks.select(*POINT).distinct()
    return points.join(medians, POINT, "left").withColumn("dispatch_time_p50_7d", F.coalesce("dispatch_time_p50_7d", F.lit(0.0)))


def with_week(weeks: DataFrame) -> DataFrame:
    """Add the week index 0..7 inside the eight weeks."""
    start = F.col("observation_date").cast("timestamp_ntz") - F.expr("interval 56 days")
    week = F.floor(whole_days(start, F.col(BOUGHT)) / 7)
    return weeks.withColumn("week_idx", F.least(F.greatest(week, F.lit(0)), F.lit(7)).cast("int"))


def seller_active_weeks(weeks: DataFrame) -> DataFrame:
    return with_week(weeks).groupBy(*POINT).agg(F.count_distinct("week_idx").alias("seller_active_weeks"))


def weekly_volume(weeks: DataFrame) -> DataFrame:
    return with_week(weeks).groupBy(*POINT, "week_idx").agg(F.count(F.lit(1)).cast("double").alias("y"))


def weekly_dispatch(weeks: DataFrame, approximate: bool = False, together: bool = False) -> DataFrame:
    """Median dispatch time per week; waiting times are whole seconds, so even a hot seller has few different ones."""
    positive = with_week(weeks).where(F.col("dispatch_days") > 0)
    return quantiles(positive, [*POINT, "week_idx"], "dispatch_days", {"y": 0.5}, approximate, together)


def weekly_review(weeks: DataFrame) -> DataFrame:
    return with_week(weeks).groupBy(*POINT, "week_idx").agg(F.avg("review_score").alias("y"))


WEEKS = range(8)
TRENDS = ["order_volume_slope", "dispatch_delay_slope", "review_score_slope"]


def weeks_present(weekly: DataFrame, **series: str) -> DataFrame:
    """Per observation date and named series (a name and the condition a row of it fulfils), for each of the
    8 weeks: whether any seller has such a row (``<name>_m0``..``m7``) and the number of the week among those
    weeks (``<name>_x0``..``x7``); with the count of weeks, the sum of their numbers and of the squares."""
    marks = weekly.groupBy("observation_date").agg(*[
        F.expr(f"coalesce(max(CASE WHEN week_idx = {k} AND ({where}) THEN 1 END), 0)").alias(f"{n}_m{k}")
        for n, where in series.items() for k in WEEKS
    ])
    number = {f"{n}_x{k}": F.expr(" + ".join(["0", *[f"{n}_m{j}" for j in range(k)]])) for n in series for k in WEEKS}

    def total(n: str, term: str):
        return F.expr(" + ".join(f"{n}_m{k} * " + term.format(x=f"{n}_x{k}") for k in WEEKS)).cast("double")

    sums = {f"{n}_{s}": total(n, term) for n in series for s, term in (("n", "1"), ("sx", "{x}"), ("sxx", "{x} * {x}"))}
    return marks.withColumns(number).withColumns(sums)


def _week_columns(value: str, name: str) -> list[Column]:
    """The weekly values of a series as the columns ``name0`` to ``name7``."""
    return [F.expr(f"max(CASE WHEN week_idx = {k} THEN {value} END)").alias(f"{name}{k}") for k in WEEKS]


def _filled(name: str, carry: bool, default: float) -> dict[str, Column]:
    """Weekly columns without gaps. With ``carry`` the nearest earlier value fills a gap, else the nearest later one."""
    out = {}
    for k in WEEKS:
        nearest = [*range(k, -1, -1), *range(k + 1, 8)] if carry else [k]
        out[f"{name}{k}"] = F.expr(f"coalesce({', '.join(f'{name}{j}' for j in nearest)}, {default}D)")
    return out


def _slope(name: str, on: str) -> Column:
    """Least-squares slope over the weeks present; 0 if there is one week only or all values are equal."""
    sy = " + ".join(f"{on}_m{k} * {name}{k}" for k in WEEKS)
    sxy = " + ".join(f"{on}_m{k} * {on}_x{k} * {name}{k}" for k in WEEKS)
    shown = ", ".join(f"CASE WHEN {on}_m{k} = 1 THEN {name}{k} END" for k in WEEKS)
    slope = f"try_divide({on}_n * ({sxy}) - {on}_sx * ({sy}), {on}_n * {on}_sxx - {on}_sx * {on}_sx)"
    return F.expr(f"CASE WHEN least({shown}) = greatest({shown}) THEN 0D ELSE coalesce({slope}, 0D) END")


def weekly_fill(weekly: DataFrame, carry: bool, default: float) -> DataFrame:
    """Dense weekly series: one row for every seller of a date and every week that any seller has on that date.

    ``x`` counts those weeks from 0. Missing values get ``default``; with ``carry`` first the value of the
    nearest week before, then that of the nearest week after. A series has 8 values at most. The weeks present are one row
    for each date and go to every task; the series stay where they are.
    """
    wide = weekly.groupBy(*POINT).agg(*_week_columns("y", "y")).join(F.broadcast(weeks_present(weekly, w="true")), "observation_date")
    cells = ", ".join(f"struct({k} AS week_idx, w_x{k} AS x, y{k} AS y, w_m{k} AS _m)" for k in WEEKS)
    dense = wide.withColumns(_filled("y", carry, default)).select(*POINT, F.expr(f"inline(array({cells}))"))
    return dense.where("_m = 1").drop("_m")


def trend_slopes(master: DataFrame, dates: DataFrame, approximate: bool = False) -> DataFrame:
    """Weekly trends of volume, dispatch time and review score; 0 where a seller has no such series.

    Of the master only the seller, the time of purchase, the dispatch time and the review score are read.
    """
    return _points(master, dates, approximate, hot_sellers(master), recent=False).select(*POINT, *TRENDS)


def hot_sellers(master: DataFrame) -> DataFrame | None:
    """The sellers whose rows are too many for one task, or None."""
    return many_rows(master, ["seller_id"])


def _week_sums() -> list[Column]:
    """Per week the number of rows and the sum and number of the review scores."""
    return [
        F.expr(f"{agg}(CASE WHEN week_idx = {k} THEN {value} END)").alias(f"{name}{k}")
        for name, agg, value in (("_v", "count", "1"), ("_rs", "sum", "review_score"), ("_rn", "count", "review_score")) for k in WEEKS
    ]


def _ranked_figures(waited: DataFrame, recent: bool) -> DataFrame:
    """Figures of the weeks and, with ``recent``, of the last 30 days per seller and date, for rows that lie together by seller.

    Medians come from places among the sorted waiting times of a week, the number of categories from the first recent
    row of each, so nothing is collected for a group and no row is shuffled again.
    """
    week = Window.partitionBy(*POINT, "week_idx").orderBy(F.col("_waited").asc_nulls_last())
    ranked = waited.withColumns({
        "_place": F.row_number().over(week),
        "_of": F.count("_waited").over(week.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    parts = {}
    if recent:
        category = Window.partitionBy(*POINT, "product_category_name").orderBy(F.desc("_recent"))
        counted = F.col("_recent") & F.col("product_category_name").isNotNull() & (F.row_number().over(category) == 1)
        ranked = ranked.withColumn("_recent", flag(_since(30))).withColumn("_new_category", counted)
        parts = _recent_parts() | {"product_category_diversity": F.count_if("_new_category")}
    # An odd number of values has one in the middle, an even one two that count half.
    middle = "CASE WHEN 2 * _place = _of + 1 THEN _waited WHEN 2 * _place = _of OR 2 * _place = _of + 2 THEN _waited / 2 END"
    medians = [F.expr(f"sum(CASE WHEN week_idx = {k} THEN {middle} END)").alias(f"d{k}") for k in WEEKS]
    return ranked.groupBy(*POINT).agg(*_week_sums(), *medians, *[c.alias(n) for n, c in parts.items()])


def _counted_figures(weeks: DataFrame, recent: bool) -> DataFrame:
    """The same for rows of sellers with very many: aggregates that shrink before the shuffle, medians counted across tasks."""
    counted = weekly_dispatch(weeks).groupBy(*POINT).agg(*_week_columns("y", "d"))
    parts = _recent_parts() if recent else {}
    sums = with_week(weeks).groupBy(*POINT).agg(*_week_sums(), *[c.alias(n) for n, c in parts.items()])
    return sums.join(counted, POINT, "left")


def _approximate_figures(waited: DataFrame, recent: bool) -> DataFrame:
    parts = _recent_parts() if recent else {}
    medians = [F.expr(f"percentile_approx(CASE WHEN week_idx = {k} THEN _waited END, 0.5, 100000)").alias(f"d{k}") for k in WEEKS]
    return waited.groupBy(*POINT).agg(*_week_sums(), *medians, *[c.alias(n) for n, c in parts.items()])


def _points(
    master: DataFrame, dates: DataFrame, approximate: bool, hot: DataFrame | None = None, names: DataFrame | None = None, recent: bool = True
) -> DataFrame:
    """One row per seller and date: trends, active weeks, dispatch time of the last week and, with ``recent``, 30-day figures.

    One pass over the rows of the eight weeks gives the weekly volumes, reviews and median dispatch times as columns. The
    medians of ``hot`` sellers, those with very many rows, are counted across tasks instead.
    """
    def waited(rows: DataFrame) -> DataFrame:
        return with_week(eight_weeks(rows, dates)).withColumn("_waited", F.when(F.col("dispatch_days") > 0, F.col("dispatch_days")))

    if approximate:
        main = _approximate_figures(waited(master), recent)
    else:
        together, *apart = _by_seller(master, hot, names)
        main = _ranked_figures(waited(together), recent)
        for rows in apart:
            main = main.unionByName(_counted_figures(eight_weeks(rows, dates), recent))
    # All boundaries between weeks are at midnight, so the days on which anyone has a row tell the weeks present.
    days = master.groupBy(F.date_trunc("day", BOUGHT).cast("timestamp_ntz").alias(BOUGHT)).agg(
        F.coalesce(F.max(F.col("dispatch_days") > 0), F.lit(False)).alias("dispatched")
    )
    present = weeks_present(with_week(eight_weeks(days, dates)), any="true", disp="dispatched")
    wide = main.join(F.broadcast(present), "observation_date").withColumns({
        "seller_active_weeks": F.expr(" + ".join(f"CAST(_v{k} > 0 AS BIGINT)" for k in WEEKS)),
        "_last_dispatch": F.col("d7"),
        "_any_dispatch": F.expr(f"coalesce({', '.join(f'd{k}' for k in WEEKS)}) IS NOT NULL"),
        **{f"v{k}": F.col(f"_v{k}").cast("double") for k in WEEKS},
        **{f"r{k}": F.try_divide(f"_rs{k}", f"_rn{k}") for k in WEEKS},
    })
    dense = wide.withColumns({**_filled("d", True, 0.0), **_filled("r", True, 5.0)})
    return dense.select(
        *POINT, *(_recent_parts() if recent else ()), "seller_active_weeks", "_last_dispatch", _slope("v", "any").alias("order_volume_slope"),
        F.when(F.col("_any_dispatch"), _slope("d", "disp")).otherwise(0.0).alias("dispatch_delay_slope"),
        _slope("r", "any").alias("review_score_slope"),
    )


def seller_features(master: DataFrame, dates: DataFrame, zero_otd_is_one: bool = True, approximate: bool = False) -> DataFrame:
    """All features of every seller and date; nothing from the observation date on is read.

    The dispatch time of the last 7 days is that of the last of the eight weeks. ``master`` is read four
    times, with few columns each, so pass a stored table rather than the joins that make it.
    """
    return _features(master, dates, zero_otd_is_one, approximate, None if approximate else hot_sellers(master))


def _features(
    master: DataFrame, dates: DataFrame, zero_otd_is_one: bool, approximate: bool, hot: DataFrame | None, names: DataFrame | None = None
) -> DataFrame:
    points = _points(master, dates, approximate, hot, names).withColumn("dispatch_time_p50_7d", F.coalesce("_last_dispatch", F.lit(0.0)))
    out = points.select(*POINT, *_recent_features(zero_otd_is_one), "dispatch_time_p50_7d", "seller_active_weeks", *TRENDS)
    return seller_tenure(master, out, names).select(*POINT, "seller_state", *SELLER_FEATURES)


# Labels.

def active_sellers(master: DataFrame, dates: DataFrame, days: int = 60, min_rows: int = 3) -> DataFrame:
    """Sellers with at least ``min_rows`` order items in the closed window of ``days`` days up to the date."""
    counts = window_range_join(master, dates, days, closed=True).groupBy(*POINT).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") >= min_rows).select(*POINT)


def future_sellers(master: DataFrame, dates: DataFrame, gap: int = 1, horizon: int = 45) -> DataFrame:
    """Sellers with an order from ``gap`` to ``horizon`` days after the date, both ends included."""
    after = window_range_join(master, dates, -gap, horizon, closed=True)
    return after.select(*POINT).distinct()


def anti_survivors(active: DataFrame, future: DataFrame) -> DataFrame:
    return active.join(future, POINT, "left_anti")


def churn_labels(
    master: DataFrame, dates: DataFrame, gap: int = 1, horizon: int = 45, days: int = 60, min_rows: int = 3
) -> DataFrame:
    """Active sellers with 1 where no order follows from ``gap`` to ``horizon`` days after the date, else 0.

    Past and future are counted in one pass over the rows around each date.
    """
    return _labels(master, dates, hot_sellers(master), gap, horizon, days, min_rows)


def _labels(
    master: DataFrame, dates: DataFrame, hot: DataFrame | None, gap: int = 1, horizon: int = 45, days: int = 60, min_rows: int = 3,
    names: DataFrame | None = None,
) -> DataFrame:
    t = F.col("observation_date").cast("timestamp_ntz")
    later = F.col(BOUGHT) >= t + F.expr(f"interval {gap} days")

    def labelled(rows: DataFrame) -> DataFrame:
        around = window_range_join(rows, dates, days, horizon, closed=True)
        counts = around.groupBy(*POINT).agg(F.count_if(F.col(BOUGHT) <= t).alias("_before"), F.count_if(later).alias("_after"))
        return counts.where(F.col("_before") >= min_rows).select(*POINT, (F.col("_after") == 0).cast("int").alias("churned"))

    together, *apart = _by_seller(master.select("seller_id", BOUGHT), hot, names)
    out = labelled(together)
    for rows in apart:
        out = out.unionByName(labelled(rows))
    return out


def labels_join_features(labels: DataFrame, features: DataFrame) -> DataFrame:
    return labels.join(features, POINT)


def seller_dataset(master: DataFrame, dates: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Features and label of every active seller at every observation date.

    ``master`` may come without the columns of the sellers, as from ``item_rows``; then ``names`` are the sellers (seller_id,
    seller_state), a stored table, as they are read three times. The shuffle by seller then serves for them, too.
    """
    hot = hot_sellers(master)
    return labels_join_features(_labels(master, dates, hot, names=names), _features(master, dates, True, False, hot, names))


# Reports.

def churn_rate(dataset: DataFrame, by: list[str] | None = None) -> DataFrame:
    return dataset.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("churned"), F.lit(0)).alias("churned"),
        F.avg("churned").alias("churn_rate"),
    )


def state_concentration(master: DataFrame) -> DataFrame:
    """Sellers per state with their share of all sellers."""
    one = master.groupBy("seller_id").agg(F.max("seller_state").alias("seller_state"))
    counts = one.where(F.col("seller_state").isNotNull()).groupBy("seller_state").agg(F.count(F.lit(1)).alias("sellers"))
    return counts.withColumn("share", F.col("sellers") / counts.agg(F.sum("sellers")).scalar())


def dispatch_percentiles(master: DataFrame, approximate: bool = False) -> DataFrame:
    return quantiles(master.where(F.col("dispatch_days") > 0), [], "dispatch_days", {"p50": 0.5, "p95": 0.95}, approximate)


def review_distribution(master: DataFrame) -> DataFrame:
    """Orders per review score with their share among reviewed orders."""
    one = master.groupBy("order_id").agg(F.max("review_score").alias("review_score"))
    counts = one.where(F.col("review_score").isNotNull()).groupBy("review_score").agg(F.count(F.lit(1)).alias("orders"))
    return counts.withColumn("share", F.col("orders") / counts.agg(F.sum("orders")).scalar())


def monthly_otd(master: DataFrame) -> DataFrame:
    delivered = master.where(F.col("order_status") == "delivered").groupBy("purchase_month")
    counts = delivered.agg(F.count(F.lit(1)).alias("total_orders"), F.count_if("on_time").alias("on_time_orders"))
    return counts.withColumn("otd_rate", F.col("on_time_orders") / F.col("total_orders"))


def churned_vs_surviving(dataset: DataFrame, features: list[str]) -> DataFrame:
    """Mean of each feature for surviving and churned sellers and the difference in percent."""
    means = dataset.agg(*[
        F.avg(F.when(F.col("churned") == c, F.col(f))).alias(f"{f}|{c}") for f in features for c in (0, 1)
    ])
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}|0").alias("surviving"), F.col(f"{f}|1").alias("churned")) for f in features
    ])
    change = F.bround(F.try_divide(F.col("churned") - F.col("surviving"), F.col("surviving")) * 100, 1)
    return means.select(F.inline(rows)).withColumn("pct_difference", change)


def seller_weekly_profile(master: DataFrame, day: date) -> DataFrame:
    """Orders, median dispatch time and mean review of the busiest seller in each of the eight weeks."""
    dates = observation_dates_on(master.sparkSession, day)
    weeks = eight_weeks(master, dates)
    top = weeks.groupBy("seller_id").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "seller_id").limit(1)
    rows = with_week(weeks.join(top.select("seller_id"), "seller_id", "left_semi"))
    stats = rows.groupBy("week_idx").agg(F.count(F.lit(1)).alias("orders"), F.avg("review_score").alias("mean_review"))
    medians = quantiles(rows, ["week_idx"], "dispatch_days", {"median_dispatch": 0.5})
    grid = master.sparkSession.range(8).select(F.col("id").cast("int").alias("week_idx"))
    out = grid.join(stats, "week_idx", "left").join(medians, "week_idx", "left")
    return out.select("week_idx", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("orders", "median_dispatch", "mean_review")])


def observation_dates_on(spark: SparkSession, *days: date) -> DataFrame:
    """The given observation dates, whatever their day of the month."""
    return spark.createDataFrame([(d,) for d in days], "observation_date date")


def weekly_pivot(weekly: DataFrame, value: str = "y") -> DataFrame:
    """Seller by week matrix with the columns w0 to w7."""
    cells = [F.max(F.when(F.col("week_idx") == i, F.col(value))).alias(f"w{i}") for i in range(8)]
    return weekly.groupBy(*POINT).agg(*cells)
