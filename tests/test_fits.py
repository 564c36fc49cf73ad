"""What is built on fitted models, held against a recomputation by another engine from the written scores and weights."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from harborline import fixed_values as fixed
from harborline.operators import modeling, ordering, saved_models, stats
from harborline.plans import jobs
from harborline.plans.job_queries import _train_test
from harborline.plans.tables import SELLER_KEYS, Tables

SF_DIR = "/root/testdata/sf0.001"
FEATURES = fixed.SELLER_FEATURES
TIER = "CASE WHEN churn_probability <= 0.3 THEN 'GOOD' WHEN churn_probability <= 0.7 THEN 'WARNING' ELSE 'CRITICAL' END"


@pytest.fixture(scope="module")
def parts(spark):
    return _train_test(Tables(spark, SF_DIR))


@pytest.fixture(scope="module")
def linear(parts):
    return modeling.fit_churn(parts[0], FEATURES)


@pytest.fixture(scope="module")
def results(parts):
    return jobs.job_seller_scoring(*parts)


@pytest.fixture(scope="module")
def scored(results, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("scored") / "rows")
    results["scored"].withColumn("order_no", F.monotonically_increasing_id()).write.parquet(path)
    return f"'{path}/*.parquet'"


def average_precision(rows):
    """From the definition: over the distinct scores, highest first."""
    return duckdb.sql(f"""WITH s AS (SELECT churn_probability AS p, count(*) FILTER (WHERE churned = 1) AS tp, count(*) AS n FROM {rows} GROUP BY 1),
    r AS (SELECT tp, sum(tp) OVER (ORDER BY p DESC) AS tps, sum(n) OVER (ORDER BY p DESC) AS ns FROM s)
    SELECT sum(tp * tps / ns) / sum(tp) FROM r""").fetchall()[0][0]


def test_scores_are_those_of_the_weights(linear, parts, scored):
    weights = modeling.churn_weights(linear, FEATURES)
    assert list(weights) == FEATURES and "revenue_at_risk_30d" in weights and len(weights) == 13
    scaler, regression = linear.stages[2], linear.stages[3]
    intercept = float(regression.intercept - sum(w * m for w, m in zip(weights.values(), scaler.mean.toArray())))
    z = " + ".join(f"({w!r}) * coalesce({f}, 0)" for f, w in weights.items())
    far = duckdb.sql(f"SELECT max(abs(churn_probability - 1 / (1 + exp(-({intercept!r} + {z}))))), count(*) FILTER (WHERE risk_tier <> {TIER}), count(*) FROM {scored}").fetchall()[0]
    assert far[0] < 1e-9 and far[1] == 0 and far[2] == parts[1].count()


def test_metrics_of_the_scores(results, scored):
    want = duckdb.sql(f"""SELECT count(*) FILTER (WHERE p AND churned = 1), count(*) FILTER (WHERE p AND churned = 0), count(*) FILTER (WHERE NOT p AND churned = 0),
    count(*) FILTER (WHERE NOT p AND churned = 1) FROM (SELECT churned, churn_probability >= 0.5 AS p FROM {scored})""").fetchall()[0]
    got = results["metrics"].first()
    assert (got.tp, got.fp, got.tn, got.fn) == want
    assert np.isclose(got.precision, want[0] / max(1, want[0] + want[1])) and np.isclose(got.recall, want[0] / max(1, want[0] + want[3]))
    assert np.isclose(results["average_precision"].first().ap, average_precision(scored))


def test_importance_and_profiles_of_the_scores(linear, results, scored):
    # The job fits on the same rows, so its weights are these.
    weights = modeling.churn_weights(linear, FEATURES)
    want = {f: duckdb.sql(f"SELECT avg(abs(({w!r}) * ({f} - m))) FROM {scored}, (SELECT avg({f}) AS m FROM {scored})").fetchall()[0][0] for f, w in weights.items()}
    got = {r.feature: r.importance for r in results["importance"].collect()}
    assert set(got) == set(FEATURES) and all(np.isclose(got[f], want[f], rtol=1e-6, atol=1e-9) for f in FEATURES)
    profiles = {(r.seller_id, r.observation_date): r for r in results["profiles"].collect()}
    rows = duckdb.sql(f"SELECT seller_id, observation_date, churn_probability, risk_tier FROM {scored}").fetchall()
    assert len(profiles) == len(rows)
    assert all(profiles[s, d].risk_tier == tier for s, d, _, tier in rows)


def test_precision_of_each_fold(parts, tmp_path):
    train = parts[0]
    blocks = modeling.fold_blocks(train, n=3)
    got = {r.fold: r.ap for r in modeling.cv_by_time(train, FEATURES, n=3).collect()}
    for fold in (1, 2, 3):
        model = modeling.fit_churn(blocks.where(F.col("fold_block") < fold), FEATURES)
        path = str(tmp_path / f"fold{fold}")
        modeling.score_sellers(model, blocks.where(F.col("fold_block") == fold)).select("churned", "churn_probability").write.parquet(path)
        assert np.isclose(got[fold], average_precision(f"'{path}/*.parquet'"), atol=1e-9)
    assert np.isclose(got[None], np.mean([got[n] for n in (1, 2, 3)]))


def test_a_loaded_model_scores_as_the_fitted_one(spark, linear, parts, tmp_path):
    train, test = parts
    judged = modeling.churn_judgement(modeling.score_sellers(linear, test))
    saved = saved_models.save_model(str(tmp_path / "m"), linear, "churn, linear", train, FEATURES, "churned", judged)
    loaded = saved_models.load_model(spark, str(tmp_path / "m"))
    assert (loaded.features, loaded.kind, loaded.rows, loaded.digest, loaded.metrics) == (saved.features, saved.kind, train.count(), saved.digest, saved.metrics)
    keys = [*SELLER_KEYS, "churn_probability", "risk_tier"]
    want, got = (sorted(map(tuple, modeling.score_sellers(m, test).select(*keys).collect())) for m in (linear, loaded))
    assert want == got and len(got) == test.count()
    with pytest.raises(ValueError, match="orders_30d"):
        loaded.transform(test.drop("orders_30d"))
    # The digest follows the rows, not their order.
    assert saved_models.input_digest(train.repartition(3), [*FEATURES, "churned"]) == (saved.rows, saved.digest)
    assert saved_models.input_digest(train.limit(5), [*FEATURES, "churned"])[1] != saved.digest
    saved_models.save_model(str(tmp_path / "m"), modeling.fit_churn(train, FEATURES[:2]), "small", train, FEATURES[:2], "churned", judged)
    assert saved_models.load_model(spark, str(tmp_path / "m")).features == FEATURES[:2]
    assert saved_models.load_model(spark, str(tmp_path / "m"), 1).features == FEATURES


def test_boosting_stops_before_its_limit(spark, parts):
    rng = np.random.default_rng(5)
    rows = [(int(n // 20), f"s{n:05d}", float(a), float(b), int(a + 0.3 * e > 0.5)) for n, (a, b, e) in enumerate(rng.random((2000, 3)))]
    df = spark.createDataFrame(rows, "observation_date int, seller_id string, a double, b double, churned int")
    model = modeling.fit_boosted_churn(df, ["a", "b"], trees=60, depth=3, rate=0.3)
    assert 0 < model.stages[-1].getNumTrees < 60
    judged = modeling.churn_judgement(modeling.score_sellers(model, df)).first()
    assert judged.ap > 0.9 and judged.tp > judged.fn


def test_metrics_of_regressions(spark, tmp_path):
    t = Tables(spark, SF_DIR)
    got = jobs.demand_forecast_job(t.merged, trees=5)
    forecast = got["forecast"]
    assert forecast.count() == t.merged.count()
    wrong = forecast.where(~F.col("days_until_stockout").eqNullSafe(F.try_divide("current_stock", "predicted_demand")))
    assert wrong.where(F.abs(F.col("days_until_stockout") - F.try_divide("current_stock", "predicted_demand")) > 1e-9).count() == 0
    rows = [(float(n), float(n) + (-1) ** n * 0.5) for n in range(40)]
    df = spark.createDataFrame(rows, "y double, prediction double")
    m = modeling.regression_metrics(df).first()
    y, p = np.array(rows).T
    assert np.allclose([m.mae, m.rmse, m.r2], [np.abs(y - p).mean(), np.sqrt(((y - p) ** 2).mean()), 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()])


def test_as_of_lookup(spark):
    rng = np.random.default_rng(2)
    steps = sorted({(str(k), float(v)) for k, v in zip(rng.integers(0, 3, 60), rng.integers(0, 50, 60))})
    rows = [(n, str(k), float(v) / 2) for n, (k, v) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(-10, 120, 300)))] + [(999, "0", None), (1000, None, 1.0)]
    table = spark.createDataFrame([(k, v, n) for n, (k, v) in enumerate(steps)], "k string, v double, n int")
    got = ordering.as_of(spark.createDataFrame(rows, "id int, k string, v double").repartition(5), table, ["k"], "v", "step")
    assert got.columns == ["id", "k", "v", "step"] and got.count() == len(rows)
    for r in got.collect():
        below = [(v, n) for n, (k, v) in enumerate(steps) if k == r.k and r.v is not None and v <= r.v]
        assert (tuple(r.step) if r.step else None) == (max(below) if below else None)


def test_training_days_score_as_in_the_fit(spark):
    rng = np.random.default_rng(4)
    rows = [(n, float(a), float(b)) for n, (a, b) in enumerate(zip(rng.integers(0, 20, 80), rng.normal(size=80)))]
    df = spark.createDataFrame(rows, "day int, a double, b double")
    tails = stats.anomaly_tails(df, "day", ["a", "b"])
    want = {r.day: r.anomaly_score for r in stats.anomaly_scores(df, "day", ["a", "b"]).collect()}
    got = {r.day: r.anomaly_score for r in stats.tail_scores(df, tails, "day", ["a", "b"]).collect()}
    assert got.keys() == want.keys() and np.allclose([got[d] for d in got], [want[d] for d in got])
    odd = spark.createDataFrame([(1, 10.0, 0.01), (2, 1e9, 1e9), (3, None, None)], "day int, a double, b double")
    new = {r.day: r.anomaly_score for r in stats.tail_scores(odd, tails, "day", ["a", "b"]).collect()}
    assert new[2] > max(want.values()) > new[1] > 0 == new[3] and np.isfinite(list(new.values())).all()


def test_a_search_writes_its_rows_down_every_few_trees(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(float(a), float(b), float(a + 0.1 * b)) for a, b in rng.random((60, 2))], "a double, b double, y double")
    model = modeling.search_regression(df, ["a", "b"], "y", trials=1, trees=(12, 12), depths=(2, 2))
    booster = model.stages[-1]
    # Every job of a tree carries the trees since the rows were last written down.
    assert booster.getNumTrees == 12 and booster.getOrDefault("checkpointInterval") <= 10
    assert model.transform(df).count() == 60
