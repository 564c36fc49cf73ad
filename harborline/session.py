"""Session set-up and the shared folder that long jobs write their intermediate tables to."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Session settings the library's results or plans rely on.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key's partition also where that costs one more exchange above the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows that lie together by one key of a join (sellers) are not shuffled again by all of them (sellers and dates).
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Rows that are sorted by group are added up as they come, not in a table of all groups.
    "spark.sql.execution.replaceHashWithSortAgg": "true",
    # The JVM does not compile methods above 8000 bytes; run wide aggregates as several small ones instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
# With this, a finished execution leaves no shuffle files behind.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "harborline", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return apply_settings(builder.getOrCreate())


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the SQL settings on a session that somebody else built."""
    for key, value in SQL_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session, as in tests, may go without: it then gets a temporary folder. On a cluster
    a machine-local folder would be lost with its machine, so the setting is required there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    # ``local-cluster`` has executors of its own, so it counts as a cluster.
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="harborline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and go on from there, with its lineage cut.

    Needed where a plan reads one result twice and both reads must see the very same rows in the very
    same partitions (range partitioning samples, so a second run may cut elsewhere).
    """
    with_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """The session with a folder for checkpoints, which iterative fits cut their lineage with."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return spark


@contextmanager
def without_old_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go when what made them is written; otherwise they lie beside those of all later steps."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def stored(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it from there.

    For tables that several queries read with different columns. With ``order`` the files hold ranges of
    those columns, so a filter on them skips files.
    """
    path = fresh_path(df.sparkSession, name)
    with without_old_shuffles(df.sparkSession):
        (df.repartitionByRange(*order) if order else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
