"""Splits and samples that are the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from harborline.operators.scenario import uniform


def random_split(df: DataFrame, key: list[str], pct: int = 20, seed: int = 42, col: str = "split") -> DataFrame:
    """Tag about ``pct`` percent of the rows as test, decided by the row's key alone."""
    return df.withColumn(col, F.when(uniform(seed, *key) < pct / 100, "test").otherwise("train"))


def sample_rows(df: DataFrame, key: list[str], n: int = 10000, seed: int = 42) -> DataFrame:
    """``n`` rows in a random but repeatable choice.

    A threshold slightly above n of all rows leaves few to be put in order, however many partitions there are. Rows with one key share one
    draw, so where keys repeat, fewer than ``n`` rows may pass; the threshold then rises until enough do.
    """
    rows = df.count()
    drawn = df.withColumn("_u", uniform(seed, *key))
    enough = (n + 10 * n**0.5 + 100) / max(rows, 1)
    while enough < 1 and drawn.where(F.col("_u") <= enough).count() < n:
        enough *= 4
    return (drawn.where(F.col("_u") <= enough) if enough < 1 else drawn).orderBy("_u", *key).limit(n).drop("_u")
