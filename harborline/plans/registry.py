"""Named queries: how Spark computes them and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from harborline.plans.sql import ctes, plain, RESULTS
from harborline.plans.tables import Tables
from harborline.sources.domain import VIEWS


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None
    doubles: tuple[str, ...]
    digits: int

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The result; doubles are rounded, as sums differ in their last digits with the order of addition."""
        df = self.build(Tables(spark, sf_dir))
        if not self.doubles:
            return df
        rounded = {c: F.round(c, self.digits) for c in self.doubles}
        return df.withColumns({c: F.when(r == 0, F.lit(0.0)).otherwise(r) for c, r in rounded.items()})

    def statement(self) -> str | None:
        if self.sql is None:
            return None
        parts = [f"{n} AS MATERIALIZED ({plain(RESULTS.get(n) or VIEWS[n])})" for n in ctes(self.sql)]
        rounded = ", ".join(
            f"CASE WHEN round(CAST({c} AS DOUBLE), {self.digits}) = 0 THEN 0e0 ELSE round(CAST({c} AS DOUBLE), {self.digits}) END AS {c}"
            for c in self.doubles
        )
        body = plain(self.sql)
        if rounded:
            parts.append(f"answer AS ({body})")
            body = f"SELECT * REPLACE ({rounded}) FROM answer"
        return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


QUERIES: dict[str, Query] = {}


def add(key: str, build: Callable[[Tables], DataFrame], sql: str | None = None, doubles: str = "", digits: int = 6) -> None:
    if key in QUERIES:
        raise ValueError(f"{key} is registered twice")
    QUERIES[key] = Query(build, sql, tuple(doubles.split()), digits)
