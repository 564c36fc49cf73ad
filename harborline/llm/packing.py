"""Packing documents into sequences of a fixed number of tokens.

The plan works on the histogram of piece lengths, which has at most one entry per length however many documents
there are. Martello and Toth's dominance criterion fixes sequences first: where no sequence with the longest
piece can beat a certain partner, that pair is part of some best packing and leaves the instance. What remains
goes to the sequence that it fills best, longest pieces first. Equal pieces and equal sequences are
handled together, so a plan is a short list of runs; the pieces find their places by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from harborline.llm.common import on_workers
from harborline.llm.tokens import encoder, vocabulary_path
from harborline.llm.words import by_bytes, with_ends
from harborline.session import stored

CAPACITY = 2048
# Bytes of text that a task encodes together; its arrays take about twenty times as much of the worker's memory.
CHUNK_BYTES = 1 << 20
END_ID = 0
# Groups into which the pieces of one length are dealt for ranking, so that a frequent length is no single task.
RANK_BLOCKS = 1024

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The token pieces of every whole text: the document's ids and ``end_id``, cut only where longer than ``capacity``.

    A null text is an empty one and gives the end id alone; repeated rows give their pieces again.
    """
    on_workers(docs.sparkSession)
    vocabulary = vocabulary or vocabulary_path()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut_texts(batches, vocabulary, capacity, end_id)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE_SCHEMA)


def cut_texts(batches: Iterable[pa.RecordBatch], vocabulary: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``pieces`` for batches of (doc_id, text), about ``CHUNK_BYTES`` of text at a time."""
    words = encoder(vocabulary)
    for batch in by_bytes(batches, 1, CHUNK_BYTES):
        ids, ends = with_ends(*words.encode_all(batch.column(1).fill_null("")), [], [end_id])
        size = np.diff(ends)
        count = -(-size // capacity)
        row = np.repeat(np.arange(len(size)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * capacity
        length = np.minimum(capacity, size[row] - start)
        data, at = memoryview(ids.tobytes()), 4 * (ends[row] + start)
        crcs = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
        yield pa.record_batch(
            [batch.column(0).cast(pa.int64()).take(pa.array(row)), pa.array(piece.astype("i4")), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )


@dataclass(frozen=True)
class Run:
    """Pieces of one length, by rank: ``each`` of them in every sequence from ``first`` on, at ``offset`` and after."""

    length: int
    rank: int
    first: int
    each: int
    offset: int


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[tuple[int, int | None, int]]:
    """Take the sequences out of ``counts`` that some best packing has: (length, partner or None, how many).

    With the longest piece, and whatever else fits beside it, a partner dominates if it fills the sequence, if
    no two pieces fit beside the longest, or if at most two do and no two of them are together longer
    than the partner. No piece that fits beside it: it stays alone.
    """
    fixed = []
    sizes = sorted(counts)
    changed = True
    while changed:
        changed = False
        for longest in reversed(list(sizes)):
            while counts.get(longest):
                partner, alone = _dominating(counts, sizes, longest, capacity - longest)
                if not alone and partner is None:
                    break
                if alone:
                    many = counts[longest]
                else:
                    many = counts[longest] // 2 if partner == longest else min(counts[longest], counts[partner])
                fixed.append((longest, partner, many))
                for length in {longest, partner} - {None}:
                    counts[length] -= many * (2 if partner == longest else 1)
                    if not counts[length]:
                        del counts[length]
                        sizes.remove(length)
                changed = True
    return fixed


def _dominating(counts: dict[int, int], sizes: list[int], longest: int, room: int) -> tuple[int | None, bool]:
    """The partner that dominates, or whether nothing fits beside one piece of length ``longest``."""
    def left(length: int) -> int:
        return counts[length] - (length == longest)

    fitting = bisect_right(sizes, room)
    top = fitting - 1
    while top >= 0 and not left(sizes[top]):
        top -= 1
    if top < 0:
        return None, True
    partner = sizes[top]
    if partner == room:
        return partner, False
    smallest = []
    for length in sizes[:top + 1]:
        smallest += [length] * min(left(length), 3 - len(smallest))
        if len(smallest) == 3:
            break
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return partner, False
    if len(smallest) == 3 and sum(smallest) <= room:
        return None, False
    # At most two fit: the longest pair that does.
    best, low, high = 0, 0, top
    while low <= high:
        if low == high and left(sizes[low]) < 2:
            break
        total = sizes[low] + sizes[high]
        if total > room:
            high -= 1
            continue
        if not left(sizes[high]):
            high -= 1
            continue
        if left(sizes[low]):
            best = max(best, total)
        low += 1
    return (partner, False) if partner >= best else (None, False)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Where the pieces of each length go; ``counts`` has how many pieces there are of each."""
    left, used, next_sequence, runs = {k: v for k, v in counts.items() if v}, {}, 0, []

    def put(length: int, many: int, first: int, each: int, offset: int) -> None:
        runs.append(Run(length, used.get(length, 0), first, each, offset))
        used[length] = used.get(length, 0) + many

    for longest, partner, many in reduce_by_dominance(left, capacity):
        put(longest, many, next_sequence, 1, 0)
        if partner is not None:
            put(partner, many, next_sequence, 1, longest)
        next_sequence += many
    # Sequences that still have room, as (room, first, how many); equal ones stand together.
    open_groups: list[tuple[int, int, int]] = []
    for length in sorted(left, reverse=True):
        many = left[length]
        while many:
            at = bisect_right(open_groups, (length, -1, -1))
            if at < len(open_groups):
                room, first, size = open_groups.pop(at)
            else:
                room, first, size = capacity, next_sequence, -(-many // (capacity // length))
                next_sequence += size
            each = min(room // length, many)
            filled = min(size, many // each)
            put(length, filled * each, first, each, capacity - room)
            many -= filled * each
            if room > each * length:
                insort(open_groups, (room - each * length, first, filled))
            if filled < size:
                insort(open_groups, (room, first + filled, size - filled))
    return runs


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of ``pieces``; offsets in a sequence are gapless from 0.

    ``cut`` is read three times, so give a stored table. Ties in rank go by document, piece and checksum; equal rows
    are interchangeable. An empty table gives no rows.
    """
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    runs = sorted(plan(counts, capacity), key=lambda r: (r.length, r.rank))
    lengths, ranks, firsts, eachs, offsets = (np.array([getattr(r, n) for r in runs], "i8") for n in ("length", "rank", "first", "each", "offset"))
    keys = (lengths << 44) + ranks

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, (length.to_numpy() << 44) + rank.to_numpy(), "right") - 1
        step = rank.to_numpy() - ranks[at]
        return pd.DataFrame({"sequence_id": firsts[at] + step // eachs[at], "offset": offsets[at] + step % eachs[at] * length.to_numpy()})

    dealt = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_BLOCKS)))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # At most RANK_BLOCKS rows for each length.
    starts = dealt.groupBy("length", "block").count().select("length", "block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("inside", F.row_number().over(inside)).join(starts, ["length", "block"])
    return ranked.withColumn("at", place("length", F.col("before") + F.col("inside") - 1)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset"
    )


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Encode, cut and pack ``docs`` (doc_id, text): one row per piece with its place."""
    return pack(stored(pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)


def sequences(placed: DataFrame, docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The packed ids themselves: ``sequence_id``, ``ids`` and ``documents`` (start offset of each piece).

    ``docs`` must have one row per document id, none of them null.
    """
    vocabulary = vocabulary or vocabulary_path()

    @F.pandas_udf("array<int>")
    def encode(text: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
        words, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        return pd.Series([
            np.frombuffer((words.encode(t) + end)[4 * s:4 * (s + n)], "<i4") for t, s, n in zip(text, start, length)
        ], dtype=object)

    ids = placed.join(docs.select("doc_id", "text"), "doc_id").withColumn("ids", encode("text", "start", "length"))
    # A sequence holds at most its capacity, so its group is small.
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return ids.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: F.struct(p["doc_id"], p["offset"])).alias("documents")
    )
