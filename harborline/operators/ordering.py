"""Running totals and numbering along a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from harborline.session import durable


def running_totals(df: DataFrame, keys: list[str], order: list[str | Column], totals: dict[str, Column]) -> DataFrame:
    """Add, for each entry of ``totals``, its running sum along ``order`` within ``keys``.

    The rows are range-partitioned by key and order, which also cuts a hot key into many partitions. Each
    partition sums up its own part, the few partition sums give every partition its starting value, and a
    window inside the partition does the rest. Rows that tie in ``order`` share a partition, so aggregate
    equal values first.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    measured = df.select("*", *[c.alias(f"_{n}_step") for n, c in totals.items()])
    placed = measured.repartitionByRange(*[F.col(k) for k in keys], *order_cols).withColumn("_part", F.spark_partition_id())
    # Both reads below must see the same partitions.
    placed = durable(placed)
    part_sums = placed.groupBy(*keys, "_part").agg(*[F.sum(f"_{n}_step").alias(f"_{n}_sum") for n in totals])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per partition, plus one per key.
    starts = part_sums.select(
        *keys, "_part", *[F.coalesce(F.sum(f"_{n}_sum").over(earlier), F.lit(0)).alias(f"_{n}_start") for n in totals]
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", *[F.sum(f"_{n}_step").over(inside).alias(f"_{n}_run") for n in totals])
    return join_on(summed, starts, [*keys, "_part"]).select(
        *[F.col(c) for c in df.columns], *[(F.col(f"_{n}_start") + F.col(f"_{n}_run")).alias(n) for n in totals]
    )


def as_of(rows: DataFrame, steps: DataFrame, keys: list[str], on: str, found: str) -> DataFrame:
    """Add ``found``: the row of ``steps`` (as a struct) with the same ``keys`` and the greatest ``on`` not above the row's own.

    NULL if there is none. ``steps`` has each (keys, on) once and no NULL in ``on``; a row with a NULL in ``on`` finds nothing.
    Both tables are range-partitioned together by key and place, so one key may hold any share of the rows; every partition
    starts from the last step of the partitions before it.
    """
    step = F.struct(*[F.col(c) for c in steps.columns if c not in keys])
    own = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    both = rows.select(*keys, F.col(on).alias("_on"), F.lit(1).alias("_side"), own.alias("_row"), F.lit(None).cast(steps.select(step.alias("s")).schema["s"].dataType).alias("_step"))
    both = both.unionByName(
        steps.select(*keys, F.col(on).cast(rows.schema[on].dataType).alias("_on"), F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), step.alias("_step"))
    )
    placed = durable(both.repartitionByRange(*[F.col(k) for k in keys], F.col("_on")).withColumn("_part", F.spark_partition_id()))
    # At most one row for each partition, and one more for each key.
    last = placed.groupBy(*keys, "_part").agg(F.max_by("_step", F.when(F.col("_side") == 0, F.col("_on"))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = last.select(*keys, "_part", F.last("_last", ignorenulls=True).over(before).alias("_start"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_on", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = placed.withColumn("_met", F.last("_step", ignorenulls=True).over(inside)).where("_side = 1")
    out = join_on(met, starts, [*keys, "_part"]).withColumn(found, F.when(F.col("_on").isNotNull(), F.coalesce("_met", "_start")))
    return out.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns], found)


def join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which NULL equals NULL; the right side's keys are dropped."""
    if not keys:
        raise ValueError("no keys to join on")
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    return left.join(renamed, match).drop(*[f"_right_{k}" for k in keys])


def label_codes(df: DataFrame, col: str, code: str | None = None) -> DataFrame:
    """Codes 0, 1, ... of the distinct values of a column in text order."""
    code = code or f"{col}_enc"
    distinct = df.where(F.col(col).isNotNull()).select(F.col(col)).distinct()
    return running_totals(distinct, [], [col], {code: F.lit(1)}).withColumn(code, (F.col(code) - 1).cast("bigint"))


def label_encode(df: DataFrame, col: str, code: str | None = None) -> DataFrame:
    """Add the code of each row's value (see ``label_codes``)."""
    return df.join(label_codes(df, col, code), col, "left")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, as an aggregate (a hot key shrinks before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def latest_nonnull(df: DataFrame, keys: list[str], order: str | Column, cols: list[str]) -> DataFrame:
    """Per key and column, the value of the last row in which that column is not NULL.

    ``order`` must tell any two rows of a key apart; give a struct where one column does not.
    """
    at = F.col(order) if isinstance(order, str) else order
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in cols])
