"""Hand-worked cases of the seller master, windows, labels and features."""

import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from harborline.operators import sellers
from harborline.plans.catalog import QUERIES
from harborline.plans.tables import Tables

T = date(2018, 3, 31)
AT = datetime(2018, 3, 31)
MASTER = (
    "seller_id string, order_id string, order_purchase_timestamp timestamp_ntz, order_status string, on_time boolean, review_score double, "
    "price double, product_category_name string, dispatch_days double, seller_state string"
)


def row(seller, days, **over):
    """An order item ``days`` days before the observation date."""
    base = dict(status="delivered", on_time=True, review=5.0, price=10.0, category="toys", dispatch=2.0)
    base.update(over)
    return (
        seller, f"{seller}{days}", AT - timedelta(days=days), base["status"], base["on_time"], base["review"], base["price"],
        base["category"], base["dispatch"], "SP",
    )


@pytest.fixture
def dates(spark):
    return sellers.observation_dates_on(spark, T)


def test_month_ends(spark):
    got = [r.observation_date for r in sellers.observation_dates(spark, date(2017, 1, 31), date(2017, 10, 31)).orderBy("observation_date").collect()]
    assert len(got) == 10 and got[0] == date(2017, 1, 31) and got[1] == date(2017, 2, 28) and got[-1] == date(2017, 10, 31)


def test_label_windows(table, dates):
    rows = [row("kept", d) for d in (60, 30, 0)] + [row("kept", -45)]
    rows += [row("gap", d) for d in (3, 2, 1)] + [row("gap", -0.5)]
    rows += [row("late", d) for d in (3, 2, 1)] + [row("late", -46)]
    rows += [row("two", d) for d in (3, 2)]
    rows += [row("old", d) for d in (61, 2, 1)]
    labels = sellers.churn_labels(table(MASTER, *rows), dates)
    # An order half a day after the date is in neither window; 46 days later is too late; 61 days before too early.
    assert {r.seller_id: r.churned for r in labels.collect()} == {"kept": 0, "gap": 1, "late": 1}
    active, future = sellers.active_sellers(table(MASTER, *rows), dates), sellers.future_sellers(table(MASTER, *rows), dates)
    assert {r.seller_id for r in sellers.anti_survivors(active, future).collect()} == {"gap", "late"}


def test_sellers_outside_the_eight_weeks_drop_out(table, dates):
    rows = [row("early", d) for d in (60, 59, 58)] + [row("now", d) for d in (20, 10, 5)]
    master = table(MASTER, *rows)
    assert {r.seller_id for r in sellers.churn_labels(master, dates).collect()} == {"early", "now"}
    assert {r.seller_id for r in sellers.seller_dataset(master, dates).collect()} == {"now"}


def test_on_time_rate_without_on_time_deliveries(table, dates):
    weeks = sellers.eight_weeks(table(MASTER, row("a", 3, on_time=False), row("a", 2, on_time=False)), dates)
    assert sellers.seller_window_aggs(weeks).first().rolling_30d_otd_rate == 1.0
    assert sellers.seller_window_aggs(weeks, zero_otd_is_one=False).first().rolling_30d_otd_rate == 0.0


def test_features_by_hand(table, dates):
    rows = [
        row("a", 50, dispatch=1.0), row("a", 43, dispatch=3.0, review=None), row("a", 5, dispatch=5.0, review=1.0, price=30.0, category="books"),
        row("a", 4, dispatch=9.0, status="canceled", on_time=False, review=2.0, price=5.0), row("a", 200), row("b", 20, review=None, dispatch=None),
    ]
    got = {r.seller_id: r for r in sellers.seller_features(table(MASTER, *rows), dates).collect()}
    a, b = got["a"], got["b"]
    assert (a.seller_tenure_days, a.orders_30d, a.rolling_30d_otd_rate, a.rolling_30d_avg_review) == (200, 2, 1.0, 1.5)
    assert (a.high_complaint_rate_30d, a.revenue_at_risk_30d, a.cancellation_rate_30d, a.product_category_diversity) == (1.0, 35.0, 0.5, 2)
    assert (a.dispatch_time_p50_7d, a.seller_active_weeks, a.seller_state) == (7.0, 3, "SP")
    # Weeks 0, 1, 5 and 7 have rows: volumes 1, 1, 0, 2 of seller a; dispatch weeks are 0, 1 and 7: 1, 3, 7; reviews 5, 5, 5, 1.5.
    assert a.order_volume_slope == pytest.approx(0.2) and a.dispatch_delay_slope == pytest.approx(3.0)
    assert a.review_score_slope == pytest.approx(-1.05)
    assert (b.rolling_30d_avg_review, b.dispatch_time_p50_7d, b.dispatch_delay_slope, b.review_score_slope) == (5.0, 0.0, 0.0, 0.0)


def test_future_rows_do_not_change_features(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    master = t.stored_master
    dates = sellers.observation_dates_on(spark, date(1998, 5, 31), date(1998, 6, 30))
    cut = master.where(F.col("order_purchase_timestamp") < F.lit(datetime(1998, 6, 30)))

    def clean(df):
        return df.select(*[F.round(c, 8).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])

    whole, past = clean(sellers.seller_features(master, dates)), clean(sellers.seller_features(cut, dates))
    assert whole.count() > 0 and whole.exceptAll(past).count() == 0 and past.exceptAll(whole).count() == 0


def test_master_keeps_the_item_rows(spark, table):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert t.master.count() == t["v_items"].count()
    reviews = table(
        "review_id long, order_id string, review_score double, review_creation_date timestamp_ntz",
        (2, "o", 1.0, AT), (1, "o", 4.0, AT), (0, "o", 3.0, None), (9, "p", 2.0, None),
    )
    assert {r.order_id: r.review_score for r in sellers.first_review(reviews).collect()} == {"o": 4.0, "p": 2.0}


def test_delivered_without_date_is_neither(table):
    orders = table("order_status string, delivery_delay_days double", ("delivered", None), ("delivered", 0.0), ("delivered", 0.1), ("shipped", -1.0))
    got = [(r.is_late, r.on_time) for r in sellers.delivery_flags(orders).collect()]
    assert got == [(False, False), (False, True), (True, False), (False, False)]


def test_range_join_equals_brute_force(spark):
    rows = [(i, AT + timedelta(hours=37 * i)) for i in range(-80, 80)]
    df = spark.createDataFrame(rows, "i int, order_purchase_timestamp timestamp_ntz")
    days = [T + timedelta(days=d) for d in (-70, -31, -30, 0, 1, 45)]
    dates = sellers.observation_dates_on(spark, *days)
    for before, after, closed in ((56, 0, False), (60, 0, True), (-1, 45, True), (60, 45, True)):
        got = {(r.i, r.observation_date) for r in sellers.window_range_join(df, dates, before, after, closed).collect()}
        want = set()
        for i, ts in rows:
            for d in days:
                at = datetime(d.year, d.month, d.day)
                lo, hi = at - timedelta(days=before), at + timedelta(days=after)
                if lo <= ts and (ts <= hi if closed else ts < hi):
                    want.add((i, d))
        assert got == want


def test_dataset_leaves_sellers_together(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = sellers.seller_dataset(t.seller_rows, t.dates)._jdf.queryExecution().executedPlan().toString()
    # No row is shuffled by seller and date, and neither medians nor categories are collected for a group.
    assert "hashpartitioning(seller_id" in plan and "ObjectHashAggregate" not in plan
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(seller_id" in line and "observation_date" in line]


def test_sellers_with_very_many_rows_get_the_same_figures(spark, table, dates, monkeypatch):
    rows = [row("hot", d * 0.25, dispatch=d % 7 - 1.0, category="abc"[d % 3], review=d % 5 + 1.0) for d in range(-40, 230)]
    rows += [row("few", d, category=None, dispatch=d / 4) for d in (50, 33, 31, 30, 6, 5, 1)] + [row(None, 3)]
    master, days = table(MASTER, *rows), [T, T - timedelta(days=31)]
    dates = sellers.observation_dates_on(spark, *days)
    usual = sorted(sellers.seller_dataset(master, dates).collect())
    slopes = sorted(sellers.trend_slopes(master, dates).collect(), key=repr)
    monkeypatch.setattr("harborline.functions.quantiles.FEW_ROWS", 100)
    assert len(sellers.hot_sellers(master).collect()) == 1
    apart = sorted(sellers.seller_dataset(master, dates).collect())
    assert len(usual) == 4 and [r[:4] for r in usual] == [r[:4] for r in apart]
    assert all(tuple(a)[4:] == pytest.approx(tuple(b)[4:]) for a, b in zip(usual, apart))
    assert all(tuple(a)[2:] == pytest.approx(tuple(b)[2:]) for a, b in zip(slopes, sorted(sellers.trend_slopes(master, dates).collect(), key=repr)))
    few = next(r for r in usual if r.seller_id == "few" and r.observation_date == T)
    assert (few.dispatch_time_p50_7d, few.product_category_diversity) == (1.25, 0)


def test_sellers_are_met_where_their_rows_lie(spark, table, dates, monkeypatch):
    rows = [row("twice", d, category="abc"[d % 3]) for d in (2, 9)] + [row("once", d) for d in (1, 8, 20)] + [row("none", d) for d in (3, 4, 5)] + [row(None, 3)]
    items = table(MASTER, *rows).drop("seller_state")
    # A seller with two states has each row twice, so two rows are enough to be active.
    names = spark.createDataFrame([("twice", "RJ"), ("twice", "SP"), ("once", "MG"), (None, "BA")], "seller_id string, seller_state string")
    want = sorted(sellers.seller_dataset(items.join(names, "seller_id", "left"), dates).collect())
    assert [(r.seller_id, r.seller_state, r.orders_30d) for r in want] == [("none", None, 3), ("once", "MG", 3), ("twice", "SP", 4)]
    assert sorted(sellers.seller_dataset(items, dates, names).collect()) == want
    monkeypatch.setattr("harborline.functions.quantiles.FEW_ROWS", 2)
    assert sorted(sellers.seller_dataset(items, dates, names).collect()) == want


def shuffled(df):
    """The keys and columns of the shuffles in a plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    keys = [line.split("hashpartitioning(")[1].split(", ENSURE")[0].split(", REPARTITION")[0] for line in lines if "Exchange hashpartitioning" in line]
    return [[c.split("#")[0] for c in k.split(", ") if "#" in c] for k in keys]


def test_wide_columns_are_shuffled_once(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = t.master._jdf.queryExecution().optimizedPlan().toString()
        keys = shuffled(t.master)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Items meet their seller and product before anything of an order or review is with them, and its figures come after all joins.
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert [next(k for k in ("order_id", "product_id", "seller_id", "product_category_name") if k in line) for line in joins][:4] == [
        "order_id", "order_id", "product_id", "seller_id"
    ]
    assert plan.index("dispatch_days") < plan.index("Join LeftOuter") and plan[plan.index("Join LeftOuter"):].count(" AS dispatch_days") == 0
    assert keys.count(["seller_id"]) >= 1 and ["product_id"] in keys and ["order_id"] in keys


def test_whole_master_written_on_the_way(spark, rows):
    t = Tables(spark, "/root/testdata/sf0.001")
    assert t.whole_master.columns == t.master.columns and rows(t.whole_master, *t.master.columns) == rows(t.master, *t.master.columns)


@pytest.mark.parametrize("name", [
    "seller_window_aggs", "seller_active_weeks", "seller_dispatch_p50_7d", "weekly_fill", "weekly_pivot", "anti_survivors", "churn_labels", "trend_slopes",
])
def test_seller_figures_shuffle_rows_by_seller_only(spark, name):
    keys = shuffled(QUERIES[name].run(spark, "/root/testdata/sf0.001"))
    # No row of eight weeks is shuffled; rows go to their seller once they are read, before they are there for each date.
    assert ["seller_id"] in keys and not [k for k in keys if "seller_id" in k and "observation_date" in k]


def test_per_seller_with_sellers_of_very_many_rows(spark, table, dates, rows, monkeypatch):
    data = [row("hot", d * 0.25, dispatch=d % 7 - 1.0, category="abc"[d % 3], review=d % 5 + 1.0) for d in range(-40, 270)]
    data += [row("few", d, category=None, dispatch=d / 4) for d in (50, 33, 31, 30, 6, 5, 1)] + [row(None, d) for d in (1, 2, 3, 3)]
    master = table(MASTER, *data)
    dates = sellers.observation_dates_on(spark, T, T - timedelta(days=31))
    weeks = sellers.eight_weeks(master, dates)
    whole = {
        "p50": sellers.seller_dispatch_p50(weeks), "series": sellers.weekly_dispatch(weeks), "aggs": sellers.seller_window_aggs(weeks),
        "gone": sellers.anti_survivors(sellers.active_sellers(master, dates), sellers.future_sellers(master, dates)),
    }

    def parts():
        def weekly(figures, **more):
            return lambda some: figures(sellers.eight_weeks(some, dates), **more)

        return {
            "p50": sellers.per_seller(master, weekly(sellers.seller_dispatch_p50, together=True), weekly(sellers.seller_dispatch_p50)),
            "series": sellers.per_seller(master, weekly(sellers.weekly_dispatch, together=True), weekly(sellers.weekly_dispatch)),
            "aggs": sellers.per_seller(master, weekly(sellers.seller_window_aggs)),
            "gone": sellers.per_seller(master, lambda some: sellers.anti_survivors(sellers.active_sellers(some, dates), sellers.future_sellers(some, dates))),
        }

    want = {name: rows(df, *df.columns) for name, df in whole.items()}
    assert len(want["p50"]) == 5 and len(want["gone"]) >= 1
    for few in (1_000_000, 100):
        monkeypatch.setattr("harborline.functions.quantiles.FEW_ROWS", few)
        assert {name: rows(df, *whole[name].columns) for name, df in parts().items()} == want


def test_trends_need_four_columns_of_the_master(table, dates, rows):
    master = table(MASTER, *[row("a", d, dispatch=d / 3, review=float(d % 5 + 1)) for d in (50, 43, 30, 29, 5, 4)], row("b", 3, dispatch=None))
    got = sellers.trend_slopes(master.select("seller_id", "order_purchase_timestamp", "dispatch_days", "review_score"), dates)
    assert rows(got, *got.columns) == rows(sellers.seller_features(master, dates), *got.columns)


def test_stored_tables_leave_no_shuffle_files(spark):
    from harborline.session import DROP_SHUFFLES, stored

    marks = []
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("id").alias("n"))
    set_before = spark.conf.get(DROP_SHUFFLES)
    status = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = status.shuffleStatuses().size()
    kept = stored(df, "marks")
    for _ in range(50):
        marks.append(status.shuffleStatuses().size())
        if marks[-1] <= before:
            break
        time.sleep(0.1)
    assert marks[-1] <= before and kept.count() == 7 and df.count() == 7 and spark.conf.get(DROP_SHUFFLES) == set_before


def test_rows_of_eight_weeks_shuffle_no_other_columns(spark):
    plan = QUERIES["window_range_join"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "o_orderdate" in plan and not [c for c in ("o_orderstatus", "l_tax", "o_orderpriority") if c in plan]
