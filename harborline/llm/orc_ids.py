"""Token ids as ORC files: run-length encoded integers, row indexes and Bloom filters on the document id.

Files hold ranges of the document id in ascending order, one row per document, with the ids as an integer list that
ORC stores as run-length runs per stripe. Readers take stripes in parallel; a search by document id skips
files and stripes by their statistics and row groups by the row index and the Bloom filter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from harborline.llm.common import on_workers
from harborline.llm.tokens import encoder, vocabulary_path
from harborline.llm.words import by_bytes, with_ends

END_ID = 1
ROW_GROUP = 1_000
STRIPE_BYTES = 32 << 20
# Bytes of text that a task encodes and hands on together.
CHUNK_BYTES = 4 << 20

FILE_SCHEMA = "doc_id bigint, first_id bigint, n_tokens bigint, ids array<int>"


def write_ids(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode every whole text of ``docs`` (doc_id, text) and write the ids, ``end_id`` after each document.

    ``first_id`` counts the ids that stand before the document in its own file. A null text is an empty one;
    rows with a null id come first; rows with the same id stand in the order of their texts. Other columns
    are left out; an empty table gives no rows.
    """
    on_workers(docs.sparkSession)
    vocabulary = vocabulary or vocabulary_path()

    def encode(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, before = encoder(vocabulary), 0
        for batch in by_bytes(rows, 1, CHUNK_BYTES):
            ids, ends = with_ends(*words.encode_all(batch.column(1).fill_null("")), [], [end_id])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(ids))
            yield pa.record_batch(
                [batch.column(0).cast(pa.int64()), pa.array(before + ends[:-1]), pa.array(np.diff(ends)), lists], names=["doc_id", "first_id", "n_tokens", "ids"]
            )
            before += int(ends[-1])

    # The texts are ranged before they are encoded: ranging looks at its input twice.
    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ranged.mapInArrow(encode, FILE_SCHEMA).write
        .option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(ROW_GROUP)).option("orc.stripe.size", str(STRIPE_BYTES)).option("maxRecordsPerFile", "0")
        .orc(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """All documents of the files: doc_id, file, first_id, n_tokens, ids."""
    return spark.read.schema(FILE_SCHEMA).orc(path).select("doc_id", F.col("_metadata.file_path").alias("file"), "first_id", "n_tokens", "ids")


def with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Replace ``file`` and ``first_id`` by ``start``, the number of ids of all documents before a row's.

    Give rows that no longer carry ids: they may be shuffled to meet the files' sums.
    """
    # One row per file.
    sizes = read_ids(spark, path).groupBy("file").agg(
        F.min("doc_id").alias("lowest"), F.bool_or(F.col("doc_id").isNull()).alias("first"), F.sum("n_tokens").alias("held")
    )
    earlier = Window.orderBy(F.desc("first"), "lowest").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    return rows.join(bases, "file").withColumn("start", F.col("base") + F.col("first_id")).drop("file", "base", "first_id")


def find_ids(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The documents with these ids; the filter reaches the files' statistics, row indexes and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def with_crc(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by their number and ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers)."""
    on_workers(rows.sparkSession)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
            crcs = [zlib.crc32(np.ascontiguousarray(flat[a:b], "<i4")) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.record_batch(
                [*batch.columns[:3], pa.array(np.diff(ends).astype("i8")), pa.array(crcs, pa.int64())],
                names=["doc_id", "file", "first_id", "n_tokens", "ids_crc32"],
            )

    return rows.select("doc_id", "file", "first_id", "ids").mapInArrow(sums, "doc_id bigint, file string, first_id bigint, n_tokens bigint, ids_crc32 bigint")


def through_files(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` written to ``path`` and read back: doc_id, n_tokens, ids_crc32 and start of every document."""
    spark = docs.sparkSession
    write_ids(docs, path)
    return with_start(spark, path, with_crc(read_ids(spark, path)))
