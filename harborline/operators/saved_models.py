"""Fitted models on storage: a job fits and saves, other jobs load and score."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from harborline.sources.versions import VersionedTable

MANIFEST = "folder string, kind string, label string, features array<string>, metrics string, rows bigint, digest bigint"


@dataclass(frozen=True)
class SavedModel:
    """A loaded model and what was written down about it; ``digest`` tells the training rows apart from any others."""

    model: PipelineModel
    kind: str
    label: str
    features: list[str]
    metrics: dict[str, float]
    rows: int
    digest: int

    def transform(self, df: DataFrame) -> DataFrame:
        """The rows with the model's columns; a feature that is missing altogether is an error, before anything runs."""
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"the model needs the columns {missing}")
        return self.model.transform(df)


def input_digest(train: DataFrame, columns: list[str]) -> tuple[int, int]:
    """Number of rows and a digest of their values that does not depend on their order or partitions."""
    # Values as text, so that the same number of another type is the same value; a sum of halves cannot overflow.
    row = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    found = train.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod(row, F.lit(1 << 31))), F.lit(0)).alias("s")).first()
    # Rows that come twice cancel out in the first half only.
    return found["rows"], found["x"] ^ found["s"]


def save_model(path: str, model: PipelineModel, kind: str, train: DataFrame, features: list[str], label: str, metrics: DataFrame) -> SavedModel:
    """Write ``model`` below ``path`` as its newest version; ``metrics`` has one row. A reader meets it in full or not at all."""
    spark = train.sparkSession
    folder = f"{path}/models/{uuid.uuid4().hex}"
    rows, digest = input_digest(train, [*features, label])
    judged = {k: float(v) for k, v in metrics.first().asDict().items() if v is not None}
    model.write().save(folder)
    manifest = spark.createDataFrame([(folder, kind, label, features, json.dumps(judged, sort_keys=True), rows, digest)], MANIFEST)
    VersionedTable(spark, f"{path}/manifest").replace(manifest.coalesce(1), f"save {kind}")
    return SavedModel(model, kind, label, features, judged, rows, digest)


def load_model(spark: SparkSession, path: str, version: int | None = None) -> SavedModel:
    """The newest model below ``path``, or an earlier version of it."""
    saved = VersionedTable(spark, f"{path}/manifest").read(version).first()
    return SavedModel(
        PipelineModel.load(saved["folder"]), saved["kind"], saved["label"], list(saved["features"]), json.loads(saved["metrics"]), saved["rows"], saved["digest"]
    )
