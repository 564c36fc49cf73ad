"""Row-based windows (lags, trailing means) along a key's series, cut so that no key needs one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from harborline.functions.quantiles import many_rows

BLOCK_ROWS = 1_000_000


def with_position(df: DataFrame, keys: list[str], date: str, order: list[str]) -> DataFrame:
    """Add ``pos`` (1, 2, ... within the key) and ``series_rows`` (rows of the key).

    Rows are numbered inside each key and week; the weekly row counts tell where a week starts. Undated
    rows come last; rows without a key belong to no series and are left out. ``df`` is read twice.
    """
    undated = F.lit("9999-12-31").cast("timestamp")
    rows = df.withColumn("_week", F.coalesce(F.date_trunc("week", F.col(date)).cast("timestamp"), undated))
    counts = rows.groupBy(*keys, "_week").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*keys)
    starts = counts.select(
        *keys,
        "_week",
        F.coalesce(F.sum("_n").over(by_key.orderBy("_week").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        F.sum("_n").over(by_key).alias("series_rows"),
    )
    inside = Window.partitionBy(*keys, "_week").orderBy(*order)
    numbered = rows.withColumn("_rn", F.row_number().over(inside))
    return numbered.join(starts, [*keys, "_week"]).withColumn("pos", F.col("_start") + F.col("_rn")).drop("_week", "_rn", "_start")


def over_rows(
    df: DataFrame,
    keys: list[str],
    date: str,
    lookback: int,
    make: Callable[[WindowSpec], dict[str, Column]],
    tiebreak: tuple[str, ...] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add window columns that read at most ``lookback`` rows before the current one.

    A series of up to ``block_rows`` rows has one window, after one shuffle by key. A longer one is cut into blocks of
    so many consecutive rows, and each block also gets copies of the ``lookback`` rows before it. Windows then run per key
    and block and the copies are dropped again, so the result equals that of one window per key however many rows one
    key has. ``make`` gets the window and returns the new columns; all of them share one sort. ``pos`` may be used in
    them. ``df`` is read once more to count the rows of its keys.
    """
    whole = [*keys] or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    order = [date, *[c for c in tiebreak if c in df.columns]]
    hot = many_rows(rows.select(*whole), whole, block_rows)
    if hot is None:
        return _over_whole(rows, whole, order, make, df.columns)
    short, long = (rows.join(F.broadcast(hot), whole, kind) for kind in ("left_anti", "left_semi"))
    return _over_whole(short, whole, order, make, df.columns).unionByName(_over_blocks(long, whole, date, order, lookback, make, block_rows, df.columns))


def _over_whole(rows: DataFrame, keys: list[str], order: list[str], make: Callable[[WindowSpec], dict[str, Column]], columns: list[str]) -> DataFrame:
    """One window for each key; undated rows come last, rows without a key belong to no series."""
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    window = Window.partitionBy(*keys).orderBy(F.col(order[0]).asc_nulls_last(), *order[1:])
    placed = rows.withColumn("pos", F.row_number().over(window))
    new = make(window)
    return placed.select("*", *[c.alias(n) for n, c in new.items()]).select(*columns, *new)


def _over_blocks(
    rows: DataFrame, whole: list[str], date: str, order: list[str], lookback: int, make: Callable[[WindowSpec], dict[str, Column]], block_rows: int,
    columns: list[str],
) -> DataFrame:
    placed = with_position(rows, whole, date, order)
    own = F.floor((F.col("pos") - 1) / block_rows)
    last = F.floor((F.least(F.col("pos") + lookback, F.col("series_rows")) - 1) / block_rows)
    copies = placed.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(own, last)))
    window = Window.partitionBy(*whole, "_block").orderBy("pos")
    new = make(window)
    out = copies.select("*", *[c.alias(n) for n, c in new.items()]).where(F.col("_block") == F.col("_own"))
    return out.select(*columns, *new)


def trailing(window: WindowSpec, rows: int, before: int = 0) -> WindowSpec:
    """The last ``rows`` rows, ending ``before`` rows ahead of the current one."""
    return window.rowsBetween(-(rows - 1) - before, -before)


def full(value: str, agg: Column, frame: WindowSpec, rows: int) -> Column:
    """A window aggregate that is NULL until the frame holds ``rows`` values."""
    return F.when(F.count(value).over(frame) >= rows, agg.over(frame))
