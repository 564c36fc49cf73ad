"""Small helpers the operators of this package share."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if they do not have it themselves."""
    place, known = str(Path(__file__).parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if place not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, place]))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores in front where ``df`` has such a column (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found
