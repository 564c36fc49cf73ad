"""Model fits with Spark's ML library, their metrics and per-row attributions."""

from __future__ import annotations

import math
from random import Random

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import TrainValidationSplit
from pyspark.sql import Column, DataFrame, functions as F

from harborline.operators.ordering import running_totals
from harborline.operators.reports import by_record, churn_risk_tier
from harborline.session import stored, with_checkpoints

FOLD_ORDER = ["observation_date", "seller_id"]
# Rows of one partition of the table that the trials of a search go over.
TRIAL_ROWS = 250_000
# Trees after which boosting writes its rows down: every tree adds to their lineage.
TREES_A_CHECKPOINT = 50
# The same in a search: each level of a tree is a job that carries all trees since, and those of a trial may be deep.
TRIAL_TREES_A_CHECKPOINT = 10


# Folds.

def fold_blocks(df: DataFrame, order: list[str] | None = None, n: int = 5) -> DataFrame:
    """Add ``fold_block``: 0 for the oldest rows, then 1..n for the test block of each fold.

    The ``n`` test blocks have floor(N / (n + 1)) rows each and end with the newest row.
    """
    order = order or FOLD_ORDER
    placed = running_totals(df, [], order, {"_pos": F.lit(1)})
    total = placed.agg(F.coalesce(F.max("_pos"), F.lit(0))).scalar()
    size = F.floor(total / (n + 1))
    into = F.col("_pos") - 1 - (total - n * size)
    block = F.when((size == 0) | (into < 0), 0).otherwise(F.floor(F.try_divide(into, size)) + 1)
    return placed.withColumn("fold_block", block.cast("int")).drop("_pos")


def time_series_folds(df: DataFrame, order: list[str] | None = None, n: int = 5) -> DataFrame:
    """Rows per fold and role: each fold tests one block and trains on everything before it."""
    sizes = fold_blocks(df, order, n).groupBy("fold_block").agg(F.count(F.lit(1)).alias("rows"))
    folds = sizes.withColumn("fold", F.explode(F.sequence(F.greatest(F.col("fold_block"), F.lit(1)), F.lit(n))))
    role = F.when(F.col("fold_block") == F.col("fold"), "test").otherwise("train")
    return folds.groupBy("fold", role.alias("role")).agg(F.sum("rows").alias("rows"))


# Fits. No row is lost for a missing feature: it counts as 0, when fitting and when scoring.

def filled(features: list[str]) -> SQLTransformer:
    columns = ", ".join(f"coalesce(nanvl(CAST(`{f}` AS DOUBLE), NULL), 0D) AS `_{f}_filled`" for f in features)
    return SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__")


def assembled(features: list[str], out: str) -> VectorAssembler:
    return VectorAssembler(inputCols=[f"_{f}_filled" for f in features], outputCol=out)


def without_filled(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_") and c.endswith("_filled")])


def regression_pipeline(features: list[str], target: str, trees: int = 100, depth: int = 5, rate: float = 0.1, seed: int = 42) -> Pipeline:
    booster = GBTRegressor(
        featuresCol="features", labelCol=target, maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, seed=seed
    )
    return Pipeline(stages=[filled(features), assembled(features, "features"), booster])


def fit_regression(train: DataFrame, features: list[str], target: str, **params) -> PipelineModel:
    return regression_pipeline(features, target, **params).fit(train)


def predict(model: Model, df: DataFrame, floor: float | None = None) -> DataFrame:
    scored = without_filled(model.transform(df)).drop("features", "rawPrediction", "probability")
    if floor is not None:
        scored = scored.withColumn("prediction", F.greatest(F.col("prediction"), F.lit(float(floor))))
    return scored


def drawn_trials(
    booster: GBTRegressor, trials: int, trees: tuple[int, int], depths: tuple[int, int], rates: tuple[float, float], shares: tuple[float, float], seed: int
) -> list[dict[Param, object]]:
    """Parameters of each trial, drawn from the ranges by the seed alone; rates are even on a log scale."""
    draw = Random(seed)
    return [
        {
            booster.maxIter: draw.randint(*trees),
            booster.maxDepth: draw.randint(*depths),
            booster.stepSize: min(max(math.exp(draw.uniform(*map(math.log, rates))), rates[0]), rates[1]),
            booster.subsamplingRate: draw.uniform(*shares),
            booster.featureSubsetStrategy: f"{draw.uniform(*shares):.4f}",
        }
        for _ in range(trials)
    ]


def search_regression(
    train: DataFrame, features: list[str], target: str, trials: int = 20, trees: tuple[int, int] = (50, 300), depths: tuple[int, int] = (3, 9),
    rates: tuple[float, float] = (0.001, 0.1), shares: tuple[float, float] = (0.6, 1.0), parallelism: int | None = None, seed: int = 42,
) -> PipelineModel:
    """Of ``trials`` drawn from the ranges, the regression with the smallest RMSE on a fifth of the training rows.

    ``shares``: of the rows for each tree and of the features for each split. The features are assembled once, into a table
    of few large partitions, as every level of every tree is a job over it; ``parallelism`` trials (default: one for each
    core) go over it at the same time.
    """
    with_checkpoints(train.sparkSession)
    vectors = Pipeline(stages=[filled(features), assembled(features, "features")]).fit(train)
    table = stored(vectors.transform(train).select("features", F.col(target).cast("double").alias(target)), "search")
    table = table.coalesce(-(-table.count() // TRIAL_ROWS) or 1)
    booster = GBTRegressor(featuresCol="features", labelCol=target, seed=seed, checkpointInterval=TRIAL_TREES_A_CHECKPOINT)
    search = TrainValidationSplit(
        estimator=booster, estimatorParamMaps=drawn_trials(booster, trials, trees, depths, rates, shares, seed),
        evaluator=RegressionEvaluator(labelCol=target, metricName="rmse"), trainRatio=0.8, seed=seed,
        parallelism=parallelism or min(trials, train.sparkSession.sparkContext.defaultParallelism),
    )
    return PipelineModel(stages=[*vectors.stages, search.fit(table).bestModel])


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive, 1 where there are no positives."""
    ratio = F.try_divide(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1))
    return df.agg(F.coalesce(ratio, F.lit(1.0)).alias("weight"))


def fit_churn(train: DataFrame, features: list[str], label: str = "churned", iterations: int = 100) -> PipelineModel:
    """Weighted logistic regression: positives weigh as much as all negatives together."""
    weighted = train.withColumn("_weight", F.when(F.col(label) == 1, class_weight(train, label).scalar()).otherwise(1.0))
    stages = [
        filled(features),
        assembled(features, "raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(featuresCol="features", labelCol=label, weightCol="_weight", maxIter=iterations, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(weighted)


def fit_boosted_churn(
    train: DataFrame, features: list[str], label: str = "churned", order: list[str] | None = None, trees: int = 300, depth: int = 4, rate: float = 0.1,
    blocks: int = 5, least_gain: float = 0.001, seed: int = 42,
) -> PipelineModel:
    """Boosted trees for churn that stop early; positives weigh as much as all negatives together.

    The newest of ``blocks`` + 1 blocks of rows (by ``order``, as in ``fold_blocks``) is not fitted on: no tree is added any
    more once the loss on it has not become smaller by ``least_gain`` of itself.
    """
    weighted = train.withColumn("_weight", F.when(F.col(label) == 1, class_weight(train, label).scalar()).otherwise(1.0))
    judged = fold_blocks(weighted, order, blocks).withColumn("_judges", F.col("fold_block") == blocks).withColumn(label, F.col(label).cast("double"))
    with_checkpoints(train.sparkSession)
    rows = stored(judged.drop("fold_block"), "boosting")
    booster = GBTClassifier(
        featuresCol="features", labelCol=label, weightCol="_weight", validationIndicatorCol="_judges", validationTol=least_gain,
        maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, seed=seed, checkpointInterval=TREES_A_CHECKPOINT,
    )
    return Pipeline(stages=[filled(features), assembled(features, "features"), booster]).fit(rows.coalesce(-(-rows.count() // TRIAL_ROWS) or 1))


def score_sellers(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with churn probability and risk tier."""
    scored = without_filled(model.transform(df)).withColumn("churn_probability", vector_to_array("probability")[1])
    return churn_risk_tier(scored.drop("raw", "features", "rawPrediction", "probability", "prediction"))


def churn_judgement(scored: DataFrame, label: str = "churned") -> DataFrame:
    """One row of classification metrics and average precision of scored rows."""
    kept = stored(scored, "scored")
    precision = average_precision(kept, label, "churn_probability").scalar()
    return classification_metrics(kept, label, "churn_probability").withColumn("ap", precision)


def churn_weights(model: PipelineModel, features: list[str]) -> dict[str, float]:
    """Weight of one unit of each feature in the log-odds."""
    scaler, regression = model.stages[2], model.stages[3]
    return {
        f: float(w) / float(s) if s else 0.0 for f, w, s in zip(features, regression.coefficients.toArray(), scaler.std.toArray())
    }


def linear_score(df: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    """Churn probability from given weights, with risk tier."""
    z = sum((F.col(f) * w for f, w in weights.items()), F.lit(intercept))
    return churn_risk_tier(df.withColumn("churn_probability", 1 / (1 + F.exp(-z))))


def cv_by_time(df: DataFrame, features: list[str], label: str = "churned", n: int = 5, iterations: int = 100) -> DataFrame:
    """Average precision of each time-ordered fold, and their mean in the row without a fold."""
    blocks = stored(fold_blocks(df, n=n), "folds")
    out = None
    for fold in range(1, n + 1):
        model = fit_churn(blocks.where(F.col("fold_block") < fold), features, label, iterations)
        test = score_sellers(model, blocks.where(F.col("fold_block") == fold))
        row = average_precision(test, label, "churn_probability").select(F.lit(fold).alias("fold"), "ap")
        out = row if out is None else out.unionByName(row)
    folds = stored(out, "fold-precision")
    return folds.unionByName(folds.agg(F.lit(None).cast("int").alias("fold"), F.avg("ap").alias("ap")))


# Metrics.

def regression_metrics(df: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    """MAE, RMSE, R2 and, over the rows with a value other than 0, MAPE."""
    actual, error = F.col(y), F.col(y) - F.col(p)
    squares = F.sum(error * error)
    spread = F.var_pop(actual) * F.count(F.lit(1))
    return df.agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(squares / F.count(F.lit(1))).alias("rmse"),
        F.coalesce(1 - F.try_divide(squares, spread), F.lit(0.0)).alias("r2"),
        F.coalesce(F.avg(F.when(actual != 0, F.abs(F.try_divide(error, actual)))) * 100, F.lit(0.0)).alias("mape"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def per_product_mae(df: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    return df.groupBy("product_id").agg(F.avg(F.abs(F.col(y) - F.col(p))).alias("mae"))


def residual_stats(df: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    error = F.col(y) - F.col(p)
    return df.agg(F.avg(error).alias("mean_residual"), F.stddev_samp(error).alias("std_residual"))


def classification_metrics(df: DataFrame, label: str, p: str, cut: float = 0.5) -> DataFrame:
    """Confusion counts, precision (the share of flagged rows that are right) and recall."""
    flagged, positive = F.col(p) >= cut, F.col(label) == 1
    counts = df.agg(
        F.count_if(flagged & positive).alias("tp"), F.count_if(flagged & ~positive).alias("fp"),
        F.count_if(~flagged & ~positive).alias("tn"), F.count_if(~flagged & positive).alias("fn"),
    )
    return counts.withColumns({
        "precision": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)),
        "recall": F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0)),
    })


def average_precision(df: DataFrame, label: str, p: str) -> DataFrame:
    """Sum over the distinct scores, highest first, of the gain in recall times the precision so far."""
    by_score = df.groupBy(F.col(p).alias("_score")).agg(F.count_if(F.col(label) == 1).alias("_tp"), F.count(F.lit(1)).alias("_n"))
    run = running_totals(by_score, [], [F.desc("_score")], {"_tp_run": F.col("_tp"), "_n_run": F.col("_n")})
    gain = F.sum(F.col("_tp") * F.col("_tp_run") / F.col("_n_run"))
    return run.agg(F.coalesce(F.try_divide(gain, F.sum("_tp")), F.lit(0.0)).alias("ap"))


# Attribution of a linear model.

def attributed(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Add ``contributions``: what each feature adds to the row's score compared with a row of mean values, weight * (value - mean).

    ``df`` is read twice, once for the means. The few features of a row stay in the row, so ranking them needs no shuffle.
    """
    means = df.agg(F.struct(*[F.avg(f).alias(f) for f in weights]).alias("m")).scalar()
    parts = [
        F.struct(
            F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
            (w * (F.col(f) - F.col("_means")[f])).alias("contribution"),
        )
        for f, w in weights.items()
    ]
    return df.withColumn("_means", means).withColumn("contributions", F.array(*parts)).drop("_means")


def feature_attribution(df: DataFrame, keys: list[str], weights: dict[str, float]) -> DataFrame:
    """The contributions of ``attributed`` as rows of their own."""
    return attributed(df, weights).select(*keys, F.inline("contributions"))


def attribution_importance(contributions: DataFrame) -> DataFrame:
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance")).orderBy(F.desc("importance"), "feature")


def attribution_explain(contributions: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The ``k`` features that move each row most, as sentences, from rows that are ``attributed`` or from rows of contributions."""
    ranked = F.transform("contributions", lambda c: F.struct(
        F.abs(c["contribution"]).isNull().alias("n"), (~F.isnan(c["contribution"])).alias("o"), (-F.abs(c["contribution"])).alias("s"),
        c["feature"].alias("feature"), c["value"].alias("value"), c["contribution"].alias("contribution"),
    ))
    first = by_record(contributions, keys).select(*keys, F.posexplode(F.slice(F.sort_array(ranked), 1, k)).alias("_pos", "_c"))
    rows = first.select(*keys, (F.col("_pos") + 1).alias("rank"), "_c.feature", "_c.value", "_c.contribution")
    size = F.abs("contribution")
    direction = F.when(F.col("contribution") > 0, "INCREASES").otherwise("DECREASES")

    def two_digits(c: Column) -> Column:
        return F.bround(c, 2).cast("decimal(20,2)").cast("string")

    text = F.concat(
        F.col("feature"), F.lit(" = "), two_digits(F.col("value")), F.lit(" -> "), direction, F.lit(" by "), two_digits(size)
    )
    return rows.select(*keys, "rank", "feature", direction.alias("direction"), size.alias("amount"), text.alias("text"))
