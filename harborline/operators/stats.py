"""Correlations, histograms, quantile reports and outlier scores."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from harborline.functions.columns import total_of
from harborline.functions.quantiles import quantiles
from harborline.operators.ordering import as_of, join_on, running_totals
from harborline.session import durable


def corr_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.corr(a, b).alias("corr"))


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, each pair once, all in one aggregate."""
    pairs = list(combinations(cols, 2))
    facts = df.agg(*[F.corr(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return facts.select(F.inline(F.array(*rows)))


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def histogram(df: DataFrame, col: str, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Counts in ``bins`` equal intervals, the last one closed. Bounds default to the smallest and largest value."""
    low: Column = F.lit(float(lo)) if lo is not None else total_of(df, F.min(col)).cast("double")
    high: Column = F.lit(float(hi)) if hi is not None else total_of(df, F.max(col)).cast("double")
    rows = df.select(F.col(col).cast("double").alias("v")).withColumns({"_lo": low, "_hi": high})
    rows = rows.where((F.col("v") >= F.col("_lo")) & (F.col("v") <= F.col("_hi")))
    width = (F.col("_hi") - F.col("_lo")) / bins
    bucket = F.least(F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("_lo"), width)), F.lit(0)), F.lit(bins - 1))
    counts = rows.groupBy(bucket.cast("int").alias("bucket"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "bucket", (F.col("_lo") + F.col("bucket") * width).alias("lo"), (F.col("_lo") + (F.col("bucket") + 1) * width).alias("hi"), "n"
    )


def box_stats(df: DataFrame, group: str, col: str, approximate: bool = False) -> DataFrame:
    """Five-number summary and mean of a column per group."""
    probs = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    means = df.where(F.col(col).isNotNull()).groupBy(group).agg(F.avg(col).alias("mean"))
    return join_on(quantiles(df, [group], col, probs, approximate), means, [group])


def above_quantile(df: DataFrame, col: str, q: float = 0.85) -> DataFrame:
    """The rows above a quantile of a column."""
    return df.where(F.col(col) > quantiles(df, [], col, {"cut": q}).scalar())


def anomaly_tails(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """The empirical distribution of each feature as steps: feature, value, below, upto, rows, skew.

    ``below`` and ``upto`` count the rows with a smaller value and with one not greater. Written down, this is all that
    later rows need to be scored (``tail_scores``).
    """
    table = durable(df.select(key, *[F.col(f).cast("double").alias(f) for f in features]))
    counts = table.unpivot([key], features, "feature", "value").where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counts, ["feature"], ["value"], {"upto": F.col("_n")})
    shape = table.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.skewness(f), F.lit(0.0)).alias(f"{f}_skew") for f in features])
    skews = shape.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.signum(F.col(f"{f}_skew")).alias("skew"), F.col("n").alias("rows")) for f in features
    ])))
    return ranked.join(skews, "feature").select("feature", "value", (F.col("upto") - F.col("_n")).alias("below"), "upto", "rows", "skew")


def tail_scores(df: DataFrame, tails: DataFrame, key: str, features: list[str]) -> DataFrame:
    """The outlier score of each row of ``df`` against fitted ``tails``: key, anomaly_score.

    A value that the fit has seen has the probabilities of the fit. Any other one counts as one more row beside the fitted
    ones, at its place between two steps, so that no probability is 0. A missing value adds nothing.
    """
    cells = df.select(key, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([key], features, "feature", "value")
    about = tails.groupBy("feature").agg(F.max("rows").alias("_rows"), F.max("skew").alias("_skew"))
    met = as_of(cells, tails.select("feature", "value", "below", "upto"), ["feature"], "value", "step").join(about, "feature")
    seen = F.col("step.value") == F.col("value")
    upto = F.coalesce(F.col("step.upto"), F.lit(0))
    left = F.when(seen, upto / F.col("_rows")).otherwise((upto + 1) / (F.col("_rows") + 1))
    right = F.when(seen, (F.col("_rows") - F.col("step.below")) / F.col("_rows")).otherwise((F.col("_rows") - upto + 1) / (F.col("_rows") + 1))
    present = F.col("value").isNotNull()
    met = met.withColumns({"_left": F.when(present, -F.log(left)), "_right": F.when(present, -F.log(right))})
    chosen = F.when(F.col("_skew") < 0, F.col("_left")).when(F.col("_skew") > 0, F.col("_right")).otherwise(F.col("_left") + F.col("_right"))
    sums = [F.coalesce(F.sum(c), F.lit(0.0)) for c in (F.col("_left"), F.col("_right"), chosen)]
    return met.groupBy(key).agg(F.greatest(*sums).alias("anomaly_score"))


def anomaly_scores(
    df: DataFrame, key: str, features: list[str], contamination: float = 0.1, min_rows: int = 10
) -> DataFrame:
    """Empirical-CDF outlier score per row and a 0/1 label for the top ``contamination`` share.

    For every feature the tail probabilities P(X <= x) and P(X >= x) are taken from the data. The score is
    the largest of three sums over the features of -ln: left tails, right tails, and for each feature the
    tail its skewness points to. Fewer than ``min_rows`` rows give no result.
    """
    # Read several times below; a sum repeated in another order could differ in its last digit.
    table = durable(df.select(key, *[F.col(f).cast("double").alias(f) for f in features]))
    cells = table.unpivot([key], features, "feature", "value")
    counts = cells.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counts, ["feature"], ["value"], {"_upto": F.col("_n")})
    shape = table.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.skewness(f), F.lit(0.0)).alias(f"{f}_skew") for f in features])
    skews = shape.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.signum(F.col(f"{f}_skew")).alias("_skew"), F.col("n").alias("_rows")) for f in features
    ])))
    left = -F.log(F.col("_upto") / F.col("_rows"))
    right = -F.log((F.col("_rows") - F.col("_upto") + F.col("_n")) / F.col("_rows"))
    chosen = F.when(F.col("_skew") < 0, F.col("_left")).when(F.col("_skew") > 0, F.col("_right")).otherwise(F.col("_left") + F.col("_right"))
    tails = ranked.join(skews, "feature").where(F.col("_rows") >= min_rows).select("feature", "value", left.alias("_left"), right.alias("_right"), "_skew")
    tails = tails.withColumn("_chosen", chosen)
    scored = cells.join(tails, ["feature", "value"]).groupBy(key).agg(
        F.greatest(F.sum("_left"), F.sum("_right"), F.sum("_chosen")).alias("anomaly_score")
    )
    scored = durable(scored)
    cut = quantiles(scored, [], "anomaly_score", {"cut": 1 - contamination}).scalar()
    return scored.withColumn("is_anomaly", (F.col("anomaly_score") > cut).cast("int"))


def anomaly_summary(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.coalesce(F.sum("is_anomaly"), F.lit(0)).alias("anomalies_detected"),
        F.avg("is_anomaly").alias("anomaly_ratio"),
    )
