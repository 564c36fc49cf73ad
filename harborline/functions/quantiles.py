"""Exact quantiles that survive hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from harborline.operators.ordering import join_on, running_totals

# Rows of a key whose values one task may count in memory.
FEW_ROWS = 1_000_000


def many_rows(df: DataFrame, key: list[str], few: int | None = None) -> DataFrame | None:
    """The keys with more than ``few`` rows (FEW_ROWS), or None if there are none (one aggregate over ``df`` tells)."""
    found = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > (FEW_ROWS if few is None else few)).select(*key)
    return None if found.isEmpty() else found


def quantiles(
    df: DataFrame, by: list[str], value: str, probs: dict[str, float], approximate: bool = False, together: bool = False
) -> DataFrame:
    """Linearly interpolated quantiles per group, one column for each entry of ``probs``.

    Equal values are counted first, spread over all tasks by (group, value). Running counts over these rows
    then show which values hold the wanted ranks. They are range-partitioned by group and value, so however
    large a group is, no task has to see all of it. ``approximate`` uses the mergeable sketch: one pass, fixed
    memory. Rows with a NULL in ``by`` are groups like any other. With ``together`` the rows of a group are few and already
    lie in one task, so they are numbered there and nothing is shuffled.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("_value", F.col(value).cast("double"))
    if approximate:
        return rows.groupBy(*by).agg(*[F.percentile_approx("_value", p, 100000).alias(n) for n, p in probs.items()])
    if together:
        group = Window.partitionBy(*by).orderBy("_value")
        whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ranked = rows.withColumns({"_upto": F.row_number().over(group), "_total": F.count("_value").over(whole)})
    else:
        counted = rows.groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("_n"))
        placed = running_totals(counted, by, ["_value"], {"_upto": F.col("_n")})
        totals = placed.groupBy(*by).agg(F.max("_upto").alias("_total"))
        ranked = join_on(placed, totals, by) if by else placed.withColumn("_total", totals.scalar())

    def at(rank: Column) -> Column:
        """The value at a rank counted from 0: the smallest one with more rows up to it."""
        return F.min(F.when(F.col("_upto") > rank, F.col("_value")))

    parts = []
    for i, p in enumerate(probs.values()):
        rank = (F.col("_total") - 1) * F.lit(p)
        parts += [at(F.floor(rank)).alias(f"_lo{i}"), at(F.ceil(rank)).alias(f"_hi{i}"), F.max(rank - F.floor(rank)).alias(f"_f{i}")]
    found = ranked.groupBy(*by).agg(*parts)
    return found.select(*by, *[F.expr(f"_lo{i} + (_hi{i} - _lo{i}) * _f{i}").alias(n) for i, n in enumerate(probs)])
