"""Data-quality checks of any table, all columns in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def dq_column_profile(df: DataFrame, order: list[str]) -> DataFrame:
    """Per column: type, missing values, their percentage and the value in the first row by ``order``."""
    first = F.struct(*order)
    facts = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(df.columns):
        facts += [F.count_if(F.col(c).isNull()).alias(f"_nulls{i}"), F.min_by(F.col(c).cast("string"), first).alias(f"_first{i}")]
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"_nulls{i}").alias("nulls"),
            F.bround(F.try_divide(F.col(f"_nulls{i}"), F.col("_n")) * 100, 1).alias("null_pct"),
            F.col(f"_first{i}").alias("sample"),
        )
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return df.agg(*facts).select(F.inline(F.array(*rows)))


def _issue_facts(df: DataFrame) -> list[tuple[str, str, Column]]:
    """Column, issue text and the count of offending rows."""
    out = []
    for c in numeric_columns(df):
        out.append((c, "negative values", F.count_if(F.col(c) < 0)))
        if "delay" in c:
            out.append((c, "values > 365", F.count_if(F.col(c) > 365)))
    return out


def dq_range_issues(df: DataFrame) -> DataFrame:
    facts = _issue_facts(df)
    if not facts:
        return df.sparkSession.createDataFrame([], "column string, issue string")
    counted = df.agg(*[f.alias(f"_{i}") for i, (_, _, f) in enumerate(facts)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("issue"), F.col(f"_{i}").alias("_n")) for i, (c, t, _) in enumerate(facts)]
    return counted.select(F.inline(F.array(*rows))).where("_n > 0").drop("_n")


def dq_fix_suggestions(df: DataFrame) -> DataFrame:
    """What to fill into each column that has missing values: 0 into numbers, UNKNOWN into the rest."""
    numbers = set(numeric_columns(df))
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("nulls"), F.lit("0" if c in numbers else "UNKNOWN").alias("fill_with"))
        for i, c in enumerate(df.columns)
    ]
    return counted.select(F.inline(F.array(*rows))).where("nulls > 0")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one. Equal rows shrink to one before the shuffle."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def _one_row(df: DataFrame) -> DataFrame:
    """Row count, missing values per column, issue counts and duplicates of a table, in one row."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"_nulls{i}") for i, c in enumerate(df.columns)]
    issues = [f.alias(f"_issue{i}") for i, (_, _, f) in enumerate(_issue_facts(df))]
    facts = df.agg(F.count(F.lit(1)).alias("total_rows"), *nulls, *issues)
    return facts.withColumn("duplicate_rows", duplicate_count(df).scalar())


def _score(df: DataFrame) -> Column:
    width = len(df.columns)
    nulls = sum((F.col(f"_nulls{i}") for i in range(width)), F.lit(0))
    found = sum((F.when(F.col(f"_issue{i}") > 0, 1).otherwise(0) for i in range(len(_issue_facts(df)))), F.lit(0))
    n = F.greatest(F.col("total_rows"), F.lit(1))
    score = 100.0 - F.col("duplicate_rows") / n * 50 - nulls / (n * width) * 50 - found * 5.0
    return F.greatest(F.lit(0.0), score)


def dq_score(df: DataFrame) -> DataFrame:
    """0 to 100: points off for duplicate rows, missing values and range issues."""
    return _one_row(df).select(_score(df).alias("score"))


def dq_null_pct(df: DataFrame) -> DataFrame:
    """Mean percentage of missing values over all columns."""
    parts = sum((F.avg(F.col(c).isNull().cast("int")) for c in df.columns), F.lit(0.0))
    return df.agg((parts / len(df.columns) * 100).alias("null_pct"))


def dq_report(df: DataFrame, filename: str) -> DataFrame:
    cols = df.columns
    texts = [
        F.when(F.col(f"_issue{i}") > 0, F.lit(f"{c} contains {t}")) for i, (c, t, _) in enumerate(_issue_facts(df))
    ]
    issues = F.filter(F.array(*texts), lambda x: x.isNotNull()) if texts else F.array().cast("array<string>")
    nulls = F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), F.array(*[F.col(f"_nulls{i}") for i in range(len(cols))]))
    return _one_row(df).select(
        F.lit(filename).alias("filename"), "total_rows", F.lit(len(cols)).alias("total_columns"), nulls.alias("null_counts"),
        "duplicate_rows", _score(df).alias("quality_score"), issues.alias("issues"),
    )


def dq_referential(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Distinct values of a foreign key without a parent, and the rows that carry them."""
    used = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    orphans = used.join(parent.select(F.col(pk).alias("_key")), "_key", "left_anti")
    return orphans.agg(
        F.lit(fk).alias("fk"), F.count(F.lit(1)).alias("orphans"), F.coalesce(F.sum("_n"), F.lit(0)).alias("orphan_rows")
    )


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(subset=cols)
