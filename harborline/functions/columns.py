"""Column helpers shared by the operators. All of them are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def lenient_number(col: Column | str) -> Column:
    """The value as a double; NULL where it is not a number (NaN counts as missing too)."""
    number = _col(col).try_cast("double")
    return F.when(~F.isnan(number), number)


def lenient_timestamp(col: Column | str) -> Column:
    return _col(col).try_cast("timestamp")


def lenient_date(col: Column | str) -> Column:
    return _col(col).try_cast("date")


def clip(col: Column, low: float | None = None, high: float | None = None) -> Column:
    """Limit a value to a range; NULL stays NULL (``greatest``/``least`` would skip it)."""
    out = col
    if low is not None:
        out = F.when(out < low, F.lit(float(low))).otherwise(out)
    if high is not None:
        out = F.when(out > high, F.lit(float(high))).otherwise(out)
    return out


def elapsed_days(start: Column | str, end: Column | str) -> Column:
    """Fractional days from ``start`` to ``end``."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / F.lit(86400e6)


def whole_days(start: Column | str, end: Column | str) -> Column:
    """Completed days of elapsed time, rounded down (not the difference of calendar dates)."""
    return F.floor(F.timestamp_diff("MICROSECOND", _col(start), _col(end)) / F.lit(86400e6)).cast("bigint")


def flag(condition: Column) -> Column:
    """A condition as a boolean that is never NULL."""
    return F.coalesce(condition, F.lit(False))


def days_as_text(col: Column) -> Column:
    """A number with no decimals, halves to even, as text."""
    return F.bround(col, 0).cast("bigint").cast("string")


def short_name(col: Column | str) -> Column:
    """First two words of a name."""
    return F.array_join(F.slice(F.split(F.trim(_col(col)), r"\s+"), 1, 2), " ")


def feature_title(col: Column | str) -> Column:
    """``otd_rate_30d`` as ``Otd Rate 30D``: a letter is upper case unless it follows a letter."""
    chars = F.split(F.translate(_col(col), "_", " "), "")
    return F.array_join(
        F.transform(
            chars, lambda c, i: F.when((i > 0) & F.get(chars, i - 1).rlike("[A-Za-z]"), F.lower(c)).otherwise(F.upper(c))
        ),
        "",
    )


def calendar(date: Column | str) -> dict[str, Column]:
    """Calendar parts of a date, week days counted from Monday = 0."""
    d = _col(date)
    return {
        "day_of_week": F.weekday(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
        "is_month_end": (F.last_day(d) == d.cast("date")).cast("int"),
    }


def iso_calendar(date: Column | str) -> dict[str, Column]:
    """Calendar parts with ISO week days (Monday = 1), where ``is_weekend`` therefore starts on Friday."""
    d = _col(date)
    iso = F.weekday(d) + 1
    return {
        "day_of_week": iso,
        "day_of_month": F.dayofmonth(d),
        "month": F.month(d),
        "day_of_year": F.dayofyear(d),
        "is_weekend": (iso >= 5).cast("int"),
        "quarter": F.quarter(d),
    }


def total_of(df: DataFrame, value: Column) -> Column:
    """An aggregate over a whole table as a value usable in another query (a scalar subquery)."""
    return df.agg(value).scalar()


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
