"""Near copies by ProbMinHash on weighted word shingles, banding and verification.

A document is the multiset of its five-word shingles, each weighted by how often it occurs. Every shingle sends the arrivals
of a Poisson process whose rate is its weight to random registers; a register keeps the shingle that came first, so
two documents agree in a register with the probability Jaccard similarity of their weights. A process ends
as soon as its next arrival is later than all registers of its document, which is soon for nearly all shingles.

Documents whose signatures agree in a band are candidates, and only exact similarity links them. No bucket is
ever paired out: first each member is compared with one centre of its bucket, which unites nearly all of a group of copies;
then the buckets that still hold several groups are searched in blocks, where only pairs of different groups are compared.
Equal word sequences count once throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from harborline.llm.common import on_workers
from harborline.session import stored

SHINGLE_WORDS = 5
THRESHOLD = 0.8
REGISTERS = 64
BAND_ROWS = 4
SEED = 0x9E3779B97F4A7C15
# Word hashes a worker remembers, shingles handled together, members of a block; none changes a result.
MEMORY_WORDS = 400_000
BATCH_SHINGLES = 400_000
BLOCK = 500
# In a block, pairs whose signatures agree in less than this share are not verified: five standard deviations below the threshold.
LEAST_AGREEMENT = THRESHOLD - 5 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


WORD_HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A scrambled copy of 64-bit integers (the finaliser of a public generator, SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def shingles(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text, ascending, and how often each occurs; fewer than five words are one shingle."""
    hashes = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE_WORDS, len(words))
    if not k:
        return np.empty(0, np.uint64), np.empty(0)
    total = np.zeros(len(words) - k + 1, np.uint64)
    for n in range(k):
        total = mixed(total + hashes[n:len(hashes) - k + 1 + n])
    found, counts = np.unique(total, return_counts=True)
    return found, counts.astype(float)


def signatures(documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row of REGISTERS 32-bit values per document (each has a shingle)."""
    element = np.concatenate([d[0] for d in documents])
    weight = np.concatenate([d[1] for d in documents])
    owner = np.repeat(np.arange(len(documents)), [len(d[0]) for d in documents])
    first = np.full(len(documents) * REGISTERS, np.inf)
    winner = np.zeros(len(first), np.uint64)
    time, step = np.zeros(len(element)), 0
    while len(element):
        step += 1
        draw = mixed(element + np.uint64(step * SEED & (1 << 64) - 1))
        time = time - np.log1p((draw >> np.uint64(11)) * -(2.0**-53)) / weight
        cell = owner * REGISTERS + (mixed(draw + np.uint64(SEED)) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(first, cell, time)
        won = time == first[cell]
        winner[cell[won]] = element[won]
        # Early termination: later arrivals only come later.
        going = time < first.reshape(-1, REGISTERS).max(1)[owner]
        element, weight, owner, time = element[going], weight[going], owner[going], time[going]
    return (mixed(winner) & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(-1, REGISTERS)


def similarity(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets, exactly; 0 if one is empty."""
    if left[1].sum() == len(left[1]) and right[1].sum() == len(right[1]):
        # No shingle repeats: shared ones of all.
        shared = len(np.intersect1d(left[0], right[0], assume_unique=True))
        return shared / max(len(left[0]) + len(right[0]) - shared, 1)
    _, a, b = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
    if not len(a):
        return 0.0
    x, y = left[1][a], right[1][b]
    alone_x, alone_y = left[1].sum() - x.sum(), right[1].sum() - y.sum()
    pairs, times = np.unique(np.stack([x, y]), axis=1, return_counts=True)
    return float(sum(n / (np.maximum(x / p, y / q).sum() + alone_x / p + alone_y / q) for (p, q), n in zip(pairs.T, times)))


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (of the exact text), content (of the word sequence; null if there is no word) and signature."""
    on_workers(docs.sparkSession)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, contents, signed = batch.column(2), [], []
            found: list[tuple[np.ndarray, np.ndarray]] = []
            held = 0
            for text in texts:
                words = words_of(text.as_py())
                if not words:
                    contents.append(None)
                    continue
                contents.append(hashlib.blake2b("\n".join(words).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
                found.append(shingles(words))
                held += len(found[-1][0])
                if held >= BATCH_SHINGLES:
                    signed.append(signatures(found))
                    found, held = [], 0
            if found:
                signed.append(signatures(found))
            flat = iter(np.concatenate(signed).view(np.int32)) if signed else iter(())
            values = [None if c is None else next(flat) for c in contents]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(contents, pa.string()), pa.array(values, pa.list_(pa.int32()))],
                names=["doc_id", "text_key", "content", "signature"],
            )

    keyed = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"), "text")
    return keyed.mapInArrow(rows, "doc_id bigint, text_key string, content string, signature array<int>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (content, centre) whose texts are at least THRESHOLD alike."""

    @F.pandas_udf("double")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        known: tuple[str, tuple] = ("", shingles([]))
        found = []
        for a, b in zip(left, right):
            if known[0] != b:
                known = (b, shingles(words_of(b)))
            found.append(similarity(shingles(words_of(a)), known[1]))
        return pd.Series(found, dtype=float)

    left = texts.select(F.col("content"), F.col("text").alias("left"))
    right = texts.select(F.col("content").alias("centre"), F.col("text").alias("right"))
    joined = pairs.join(left, "content").join(right, "centre")
    return joined.where(alike("left", "right") >= THRESHOLD).select("content", "centre")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the edges (a, b): root is the least node of the connected component.

    Alternating star steps: nodes link their larger neighbours to their least one, then all their smaller ones. Each step
    is written to the shared folder, which cuts the lineage, and there are about log(length of the longest chain) steps.
    """
    def measure(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges")
    before = measure(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e"))
        edges = stored(small.select("e.*").where(F.col("a") != F.col("b")).distinct(), "edges")
        after = measure(edges)
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def search_blocks(members: DataFrame) -> DataFrame:
    """Links (content, centre) between different groups of the same bucket.

    ``members`` has band, bucket, n (its size), content, root, signature and text. A bucket is dealt into blocks of about BLOCK members and
    each pair of blocks is one group, so a group is small however large the bucket. Two documents are compared in the
    first band they share, from the most alike signatures down, and only while their groups are still apart.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("content"), blocks).cast("int")
    dealt = members.withColumn("mine", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumns({"low": F.least("mine", "other"), "high": F.greatest("mine", "other")})
    key = ["bucket", "low", "high"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "content")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                signed = batch.column(7).values.to_numpy().reshape(-1, REGISTERS)[batch.column(7).offset:]
                yield from zip(*(batch.column(n).to_pylist() for n in range(7)), signed, batch.column(8))

        found: list[tuple[str, str]] = []
        for _, group in groupby(rows(), key=lambda r: r[:3]):
            found += links(list(group))
            if len(found) > 10_000:
                yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*found)], names=["content", "centre"])
                found = []
        if found:
            yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*found)], names=["content", "centre"])

    wanted = dealt.select(*key, "mine", "band", "content", "root", "signature", "text")
    return wanted.mapInArrow(search, "content string, centre string")


def links(group: list[tuple]) -> list[tuple[str, str]]:
    """The links that join the groups of one pair of blocks; rows as ``search_blocks`` orders them."""
    parent = {row[6]: row[6] for row in group}
    if len(parent) < 2:
        return []

    def root(node: str) -> str:
        while parent[node] != node:
            parent[node] = node = parent[parent[node]]
        return node

    signed = np.stack([row[7] for row in group])
    mine, band, apart = np.array([row[3] for row in group]), group[0][4], group[0][1] != group[0][2]
    roots = np.unique([row[6] for row in group], return_inverse=True)[1]
    candidates = []
    for i in range(len(group) - 1):
        others = np.flatnonzero((roots[i + 1:] != roots[i]) & ((mine[i + 1:] != mine[i]) if apart else True)) + i + 1
        if not len(others):
            continue
        same = signed[others] == signed[i]
        agree = same.mean(1)
        first = same.reshape(len(others), -1, BAND_ROWS).all(2).argmax(1) == band
        near = first & (agree >= LEAST_AGREEMENT)
        candidates += [(-a, i, int(j)) for a, j in zip(agree[near].tolist(), others[near])]
    known: dict[int, tuple] = {}
    found = []
    for _, i, j in sorted(candidates):
        a, b = root(group[i][6]), root(group[j][6])
        if a == b:
            continue
        for n in (i, j):
            if n not in known:
                known[n] = shingles(words_of(group[n][8].as_py()))
        if similarity(known[i], known[j]) >= THRESHOLD:
            parent[max(a, b)] = min(a, b)
            found.append((group[i][5], group[j][5]))
    return found


def classes(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, text_key) its ``content`` and ``class_content``, the least content of its class.

    Documents are in one class if a chain of verified links, or an equal word sequence, joins them. A document without a word
    (null, empty, white space) is like no other and has neither content nor class.
    """
    described = stored(describe(docs), "described")
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    # One row per word sequence; a group of copies shrinks before the shuffle.
    unique = described.where(F.col("content").isNotNull()).groupBy("content").agg(first, F.any_value("signature").alias("signature"))
    unique = stored(unique.select("content", "first.*", "signature"), "contents")
    bands = REGISTERS // BAND_ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("signature", b * BAND_ROWS + 1, BAND_ROWS)))
    buckets = unique.select("content", F.posexplode(keys).alias("band", "bucket"))
    centres = buckets.groupBy("bucket").agg(F.min("content").alias("centre"), F.count("*").alias("n")).where(F.col("n") > 1)
    shared = stored(buckets.join(centres, "bucket"), "buckets")
    pairs = shared.where(F.col("content") != F.col("centre")).select("content", "centre").distinct()
    # Whole texts of the documents that share a bucket with another one.
    wanted = unique.join(shared.select("content").distinct(), "content").select("content", "doc_id", "text_key")
    keyed = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"), "text").alias("d")
    match = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_key") == F.col("w.text_key"))
    texts = keyed.join(wanted.alias("w"), match).select("content", "text").dropDuplicates(["content"])
    texts = stored(texts, "texts")
    links = stored(verified(pairs, texts), "links").select(F.col("content").alias("a"), F.col("centre").alias("b"))
    roots = components(links)
    grouped = shared.join(roots, F.col("content") == F.col("node"), "left").select("band", "bucket", "n", "content", F.coalesce("root", "content").alias("root"))
    grouped = stored(grouped, "grouped")
    divided = grouped.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") != F.col("high")).select("bucket")
    members = grouped.join(divided, "bucket").join(unique.select("content", "signature"), "content").join(texts, "content")
    more = stored(search_blocks(members), "more-links").select(F.col("content").alias("a"), F.col("centre").alias("b"))
    # The second search only joins groups, so only groups are in its graph.
    joined = components(
        more.join(roots.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("root", "a").alias("a"), "b")
        .join(roots.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("root", "b").alias("b"))
    ).select(F.col("node").alias("old"), F.col("root").alias("new"))
    alone = joined.join(roots, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    moved = roots.join(joined, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    roots = moved.unionByName(alone)
    return described.join(roots, F.col("content") == F.col("node"), "left").select(
        "doc_id", "text_key", "content", F.coalesce("root", "content").alias("class_content")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id and ``class_id`` (the least doc_id of its class; its own without a word) for every row of ``docs``."""
    found = stored(classes(docs), "classes")
    least = found.where(F.col("class_content").isNotNull()).groupBy(F.col("class_content").alias("of")).agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    rows = found.join(least, F.col("class_content") == F.col("of"), "left")
    return rows.select("doc_id", F.when(F.col("class_content").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without the near copies of an earlier document: of each class the one with the least doc_id, then text key.

    All columns stay as they are. Rows that repeat both id and text are one document; documents without a word stay.
    """
    found = stored(classes(docs), "classes")
    key = F.struct("doc_id", "text_key")
    firsts = found.where(F.col("class_content").isNotNull()).groupBy("class_content").agg(F.min(key).alias("first")).select("first.*")
    kept = firsts.unionByName(found.where(F.col("class_content").isNull()).select("doc_id", "text_key").distinct())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(F.col("doc_id").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_key"), row).alias("d")
    match = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.text_key") == F.col("k.text_key"))
    same = keyed.join(kept.alias("k"), match, "left_semi")
    repeated = found.groupBy("doc_id", "text_key").count().where(F.col("count") > 1)
    if not repeated.isEmpty():  # else another shuffle of whole rows would change nothing
        same = same.dropDuplicates(["doc_id", "text_key"])
    return same.select("row.*")
