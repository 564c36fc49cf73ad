"""Runs of words: maximal stretches with a smallest period, from suffix trees of a text and of its reversal.

Every run holds a Lyndon root: at some place of its first period, the longest Lyndon word (in the order of the symbols or
in the opposite order) has the run's period as length. The longest Lyndon word at a place ends before the next smaller
suffix, which the tree's leaf order gives. So two candidates per place, extended to the right by the tree of the text and
to the left by the tree of its reversal, give all runs.

Trees are grown only over stretches that can hold a run: a run of at least 12 words and two periods is covered by
phrases of six words that occur a second time in the same stretch, so stretches without such phrases hold none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from harborline.llm.common import on_workers
from harborline.llm.suffix_trees import SuffixTree

LEAST_LENGTH = 12
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
FOUND = f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string"
# Rows that are searched and handed on together.
ROWS = 256
# Odd factor of the rolling phrase code.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def repeating(codes: np.ndarray, phrase: int) -> list[tuple[int, int]]:
    """The stretches of ``codes`` each of whose words is in a phrase of ``phrase`` words that the stretch holds twice.

    Phrases are told apart by rolling codes; two different ones with the same code only make a stretch longer.
    """
    if len(codes) < 2 * phrase:
        return []
    grams = np.zeros(len(codes) - phrase + 1, "u8")
    for n in range(phrase):
        grams = grams * FACTOR + codes[n:len(grams) + n]
    kept, open_ = [], [(0, len(codes))]
    while open_:
        first, last = open_.pop()
        if last - first < 2 * phrase:
            continue
        some = grams[first:last - phrase + 1]
        order = np.argsort(some, kind="stable")
        same = some[order[1:]] == some[order[:-1]]
        twice = np.zeros(len(some) + 1, bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        edges = np.zeros(last - first + 1, "i4")
        edges[:len(some)] += twice[:-1]
        edges[phrase:phrase + len(some)] -= twice[:-1]
        covered = np.concatenate([[False], np.cumsum(edges[:-1]) > 0, [False]])
        turns = (np.flatnonzero(covered[1:] != covered[:-1]) + first).reshape(-1, 2).tolist()
        if turns == [[first, last]]:
            kept.append((first, last))
        else:
            open_ += map(tuple, turns)
    return sorted(kept)


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller rank, or the end."""
    found, waiting = [len(rank)] * len(rank), []
    for at, value in enumerate(rank.tolist()):
        while waiting and waiting[-1][0] > value:
            found[waiting.pop()[1]] = at
        waiting.append((value, at))
    return np.array(found)


def runs_of(symbols: list[int], least: int = LEAST_LENGTH) -> np.ndarray:
    """All runs (start, length, smallest period) of ``symbols`` (numbers from 0), by start, then period."""
    size = len(symbols)
    ahead, back = SuffixTree([*symbols, -1]), SuffixTree([*reversed(symbols), -1])
    places = np.arange(size)
    first = np.concatenate([places, places])
    # Up to the next suffix that is smaller, in the order of the symbols and in the opposite one.
    second = np.concatenate([next_smaller(ahead.rank)[:size], next_smaller(-ahead.rank)[:size]])
    inside = second < size
    first, second = first[inside], second[inside]
    period = second - first
    before = np.where(first > 0, back.common(size - first, size - second), 0)
    start = first - before
    length = second + ahead.common(first, second) - start
    found = np.stack([start, length, period], axis=1)[(length >= least) & (length >= 2 * period)]
    found = np.unique(found, axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_in(words: list[bytes], least: int = LEAST_LENGTH) -> np.ndarray:
    """All runs of ``words``, by start, then period."""
    codes = np.fromiter(map(hash, words), "i8", len(words)).view("u8")
    found = []
    for first, last in repeating(codes, max(1, least // 2)):
        numbers: dict[bytes, int] = {}
        runs = runs_of([numbers.setdefault(w, len(numbers)) for w in words[first:last]], least)
        runs[:, 0] += first
        found.append(runs)
    return np.concatenate(found) if found else np.empty((0, 3), "i8")


def find_runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """The runs of every whole text of ``docs`` (doc_id, text): doc_id, n_words, runs, collapsed.

    A run has at least ``least`` words and twice its period. ``collapsed`` has the text's words, one space between them,
    without those that any run contains after its first period. A null text is an empty one, without words and runs; rows
    stay as they are, also repeated ones and those with a null id; other columns are left out; an empty table gives no rows.
    Memory grows with the longest stretch of one text that repeats itself, about 1 kB a word.
    """
    on_workers(docs.sparkSession)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sizes, spans, texts = [], [], []
                for text in part.column(1):
                    words = (text.as_py() or "").encode().split()
                    runs = runs_in(words, least)
                    kept = words
                    if len(runs):
                        edges = np.zeros(len(words) + 1, "i8")
                        np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
                        np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
                        kept = [w for w, inside in zip(words, np.cumsum(edges)) if not inside]
                    sizes.append(len(words))
                    spans.append(runs)
                    texts.append(b" ".join(kept).decode())
                every = np.concatenate(spans)
                columns = [pa.array(np.ascontiguousarray(every[:, n])) for n in range(3)]
                ends = np.cumsum([0, *map(len, spans)]).astype("i4")
                yield pa.record_batch(
                    [part.column(0), pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["start", "length", "period"])),
                     pa.array(texts, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(search, FOUND)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with a periodic end in about every tenth text; its place and period follow from the id.

    With h the id's CRC-32 and g = floor(h / 10), texts with h % 10 = 0 repeat from word a = g % n on their next
    1 + floor((n - a) / (3 + g % 8)) words. Texts without words, with another h or with a null id stay as they are.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    chosen = F.col("h") % 10 == 0
    cut = rows.withColumn("words", F.when(chosen, F.regexp_extract_all("text", F.lit(f"({WORD})"))))
    placed = cut.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    placed = placed.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    placed = placed.withColumn("p", F.expr("CAST(1 + floor((n - a) / (3 + g % 8)) AS int)"))
    periodic = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[a + (i - a) % p])), ' ')")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))


def longest(runs: Column) -> Column:
    """The run with the greatest length; ties: the smallest start, then the smallest period."""
    keyed = F.transform(runs, lambda r: F.struct(-r["length"], r["start"], r["period"], r["length"].alias("length")))
    return F.array_min(keyed)


def digests(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` with planted runs: doc_id, n_runs, the longest run's start, length, period and
    exponent_milli (nulls without runs), runs_sha256 and collapsed_sha256, n_words."""
    found = find_runs(with_planted_runs(docs)).withColumn("best", longest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
