"""Sales aggregates and time-series features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec, functions as F

from harborline.functions.columns import calendar, iso_calendar, lenient_number
from harborline.operators.ordering import label_encode
from harborline.operators.series import BLOCK_ROWS, full, over_rows, trailing


def clean_sales(sales: DataFrame) -> DataFrame:
    """Sales with a numeric ``daily_sales``; what is not a number counts as 0."""
    return sales.withColumn("daily_sales", F.coalesce(lenient_number("daily_sales"), F.lit(0.0)))


def sales_agg(sales: DataFrame) -> DataFrame:
    return clean_sales(sales).groupBy("product_id").agg(
        F.avg("daily_sales").alias("avg_daily_sales"),
        F.sum("daily_sales").alias("total_daily_sales"),
        F.coalesce(F.stddev_samp("daily_sales"), F.lit(0.0)).alias("stddev_daily_sales"),
    )


def demand_spike(sales: DataFrame, window: int = 7, factor: float = 1.5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mark sales above ``factor`` times the mean of the last ``window`` rows, the current one included."""

    def columns(w: WindowSpec) -> dict[str, Column]:
        mean = F.avg("daily_sales").over(trailing(w, window))
        return {"rolling_avg": mean, "is_spike": F.col("daily_sales") > factor * mean}

    return over_rows(clean_sales(sales), ["product_id"], "date", window - 1, columns, ("region",), block_rows)


def spike_counts(spikes: DataFrame) -> DataFrame:
    """Per product the number of spikes and whether its latest row is one."""
    latest = F.struct(*[c for c in ("date", "region") if c in spikes.columns])
    return spikes.groupBy("product_id").agg(
        F.count_if("is_spike").alias("total_spikes"),
        F.coalesce(F.max_by("is_spike", latest), F.lit(False)).alias("demand_spike"),
    )


def _lags(w: WindowSpec, lags: tuple[int, ...], value: str = "daily_sales") -> dict[str, Column]:
    return {f"lag_{n}": F.lag(value, n).over(w) for n in lags}


def _rolling(w: WindowSpec, value: str = "daily_sales") -> dict[str, Column]:
    return {
        "roll_7_mean": full(value, F.avg(value), trailing(w, 7), 7),
        "roll_30_mean": full(value, F.avg(value), trailing(w, 30), 30),
        "roll_7_std": full(value, F.stddev_samp(value), trailing(w, 7), 7),
        "roll_90_mean": full(value, F.avg(value), trailing(w, 90), 90),
    }


def _changes(w: WindowSpec, value: str = "daily_sales") -> dict[str, Column]:
    # The 30-row mean of 30 rows ago is the mean of the rows 59..30 back. A base of 0 gives NULL.
    now = full(value, F.avg(value), trailing(w, 30), 30)
    before = full(value, F.avg(value), trailing(w, 30, before=30), 30)
    return {
        "mom_change": F.try_divide(now, before) - 1,
        "yoy_change": F.try_divide(F.col(value), F.lag(value, 365).over(w)) - 1,
    }


def demand_lags(sales: DataFrame, lags: tuple[int, ...] = (7, 14, 30), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Values of so many rows (not days) earlier."""
    return over_rows(sales, ["product_id"], "date", max(lags), lambda w: _lags(w, lags), ("region",), block_rows)


def demand_rolling(sales: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return over_rows(sales, ["product_id"], "date", 89, _rolling, ("region",), block_rows)


def demand_pct_change(sales: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return over_rows(sales, ["product_id"], "date", 365, _changes, ("region",), block_rows)


def demand_features(sales: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Lags, trailing statistics, changes and calendar parts, all from one sort."""

    def columns(w: WindowSpec) -> dict[str, Column]:
        return {**_lags(w, (7, 14, 30)), **_rolling(w), **_changes(w)}

    out = over_rows(sales, ["product_id"], "date", 365, columns, ("region",), block_rows)
    return out.withColumns(calendar("date"))


def daily_sales_stats(sales: DataFrame) -> DataFrame:
    return sales.groupBy("date").agg(
        F.sum("daily_sales").alias("total_sales"),
        F.avg("daily_sales").alias("avg_sales"),
        F.coalesce(F.stddev_samp("daily_sales"), F.lit(0.0)).alias("std_sales"),
        F.max("daily_sales").alias("max_sales"),
    )


def daily_total(sales: DataFrame) -> DataFrame:
    return sales.groupBy("date").agg(F.sum("daily_sales").alias("total_sales"))


def product_day_agg(sales: DataFrame) -> DataFrame:
    return sales.groupBy("product_id", "date").agg(F.sum("daily_sales").alias("y"))


def sales_cv(daily: DataFrame) -> DataFrame:
    """Mean, peak day (the earliest of equals) and coefficient of variation of daily totals."""
    peak = F.max_by("date", F.struct("total_sales", -F.unix_date("date")))
    return daily.agg(
        F.avg("total_sales").alias("mean_sales"),
        peak.alias("peak_date"),
        F.max("total_sales").alias("peak_sales"),
        F.try_divide(F.stddev_samp("total_sales"), F.avg("total_sales")).alias("cv"),
    )


def smoothed_sales(daily: DataFrame, value: str, n: int = 7, keys: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Moving mean over the last ``n`` rows of each series (fewer at its start)."""
    return over_rows(daily, keys or [], "date", n - 1, lambda w: {"ma": F.avg(value).over(trailing(w, n))}, (), block_rows)


def top_products(sales: DataFrame, k: int = 3) -> DataFrame:
    return sales.groupBy("product_id").agg(F.sum("daily_sales").alias("total")).orderBy(F.desc("total"), "product_id").limit(k)


def semi_top_products(sales: DataFrame, k: int = 3) -> DataFrame:
    """The sales rows of the ``k`` best-selling products."""
    return sales.join(top_products(sales, k), "product_id", "left_semi")


def forecast_features(product_day: DataFrame, encode: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Features for a daily forecast: everything about past sales comes from strictly earlier rows.

    Rows whose history is too short for a feature are dropped.
    """

    def columns(w: WindowSpec) -> dict[str, Column]:
        week, fortnight = trailing(w, 7, before=1), trailing(w, 14, before=1)
        return {
            **_lags(w, (7, 14, 28), "y"),
            "roll_mean_7": full("y", F.avg("y"), week, 7),
            "roll_mean_14": full("y", F.avg("y"), fortnight, 14),
            "roll_std_7": full("y", F.stddev_samp("y"), week, 7),
            "roll_max_7": full("y", F.max("y"), week, 7),
            "roll_min_7": full("y", F.min("y"), week, 7),
        }

    out = over_rows(product_day, ["product_id"], "date", 28, columns, (), block_rows).withColumns(iso_calendar("date"))
    if encode:
        out = label_encode(out, "product_id", "product_enc")
    return out.na.drop()


def time_split(df: DataFrame, date: str = "date", days: int = 30) -> DataFrame:
    """Tag the rows of the last ``days`` days as test."""
    cutoff = F.date_sub(df.agg(F.max(date)).scalar(), days)
    return df.withColumn("split", F.when(F.col(date) > cutoff, "test").otherwise("train"))
