"""Phrases that occur often, by dynamic itemset counting, and how closely their words belong together.

The texts are dealt into shards that are scanned in turn, cycle after cycle. Single words are counted from the first shard
on. A longer phrase is counted from the first scan on before which both phrases that lack its first or its last word had
reached the threshold, through one full cycle of shards; so lengths are counted side by side and the scans end when no
phrase is in its cycle.

Each scan writes the counts of its shard once. A phrase that occurs ``least`` times has at least ``least / shards`` of them in
one shard, so only phrases that are that heavy in some shard are added up: after every scan over the shards where they are
heavy (a phrase that reaches the threshold there is activated at once), at the end of every cycle over all shards, exactly.
A shard that is scanned again gives the same counts again, so each phrase's count of a shard is taken once.

Tasks learn which phrases have reached the threshold from a bit filter of bounded size. A bit that two phrases share
makes a task count phrases that need not be counted; it changes no result, as counts themselves are kept by phrase. From
the third cycle on only stretches of text are scanned in which all pairs (then triples, and so on) have reached it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from harborline.llm.common import on_workers
from harborline.llm.words import byte_table, by_bytes, cut_words, lower_table
from harborline.session import fresh_path

SHARDS = 4
LEAST_COUNT = 100
LONGEST = 5
TOP = 2_000
NO_LANG = "und"
# Bits of the filter for each phrase in it, and the most bits (as a power of two).
BITS_A_PHRASE = 16
MOST_FILTER_BITS = 26
SPOT_BITS = 30
# Languages up to which their word counts are handed to every task.
MOST_LANGS = 100_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Bytes of text that are counted together, and rows handed on together.
CHUNK_BYTES = 8 << 20
ROWS = 50_000
MIX = np.uint64(0x9E3779B97F4A7C15)

BYTES = byte_table(blanks=b" \t", breaks=b".,;:!?\n\x0b\x0c\r")
# ``key``: language, tab, phrase; words hold no tabs. The key without a phrase counts all words of the language.
COUNTED = "key string, spot int, n bigint"


def spots(codes: np.ndarray) -> np.ndarray:
    """A number below 2**30 for each phrase code; a filter of fewer bits uses its leading bits."""
    mixed = (codes ^ (codes >> np.uint64(29))) * MIX
    return (mixed >> np.uint64(64 - SPOT_BITS)).astype("i8")


def hashes(texts: Iterable[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t in texts], "u8")


class Filter:
    """Bits of the phrases that have reached the threshold, and of those that did so within the last cycle."""

    def __init__(self, power: int, reached: np.ndarray, recent: np.ndarray):
        self.power, self.reached, self.recent = power, reached, recent

    def has(self, bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.has_spots(bits, spots(codes))

    def has_spots(self, bits: np.ndarray, spot: np.ndarray) -> np.ndarray:
        bit = spot.astype("i8") >> (SPOT_BITS - self.power)
        return (bits[bit >> 6] >> (bit & 63).astype("u8")) & np.uint64(1) != 0


class Chunk:
    """The words of some texts and, length by length, their phrases that a filter lets through."""

    def __init__(self, batch: pa.RecordBatch):
        self.langs = batch.column(0).fill_null(NO_LANG).dictionary_encode()
        self.code, self.forms, self.row, self.opens = cut_words(batch.column(1).fill_null(""), BYTES, lower_table())
        self.lang = self.langs.indices.to_numpy().astype("i8")[self.row]
        names = len(self.langs.dictionary)
        word = self.code * names + self.lang
        # Numbers of the (word, language) pairs that occur, through a table where that is not much larger than the texts.
        if len(self.forms) * names <= 8 * len(word) + 1_000:
            counts = np.bincount(word, minlength=len(self.forms) * names)
            self.pairs = np.flatnonzero(counts)
            number = np.zeros(len(counts), "i8")
            number[self.pairs] = np.arange(len(self.pairs))
            self.word, self.counts = number[word], counts[self.pairs]
        else:
            self.pairs, self.word, self.counts = np.unique(word, return_inverse=True, return_counts=True)
        self.of_word = hashes(self.forms.to_pylist())[self.pairs // max(names, 1)]
        self.codes = (hashes(self.langs.dictionary.to_pylist())[self.pairs % max(names, 1)] ^ self.of_word) * MIX

    def lengths(self, known: Filter, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each length from 2: the length, the places where both shorter phrases have reached the threshold, a number of
        the phrase at each place, whether one of the two is recent, and for each number a place and the phrase's code."""
        at, ids, codes, size = np.arange(len(self.word)), self.word, self.codes, 1
        while size < longest and len(at):
            kept = known.has(known.reached, codes)[ids]
            at, ids = at[kept], ids[kept]
            recent = known.has(known.recent, codes)[ids]
            # Phrases side by side overlap in all but their ends; single words must stand in one piece.
            beside = at[1:] == at[:-1] + 1
            if size == 1:
                beside &= ~self.opens[at[1:]]
            recent = (recent[1:] | recent[:-1])[beside]
            at, size = at[:-1][beside], size + 1
            coded = pa.array(ids[:-1][beside] * len(self.pairs) + self.word[at + size - 1]).dictionary_encode()
            ids, keys = coded.indices.to_numpy().astype("i8"), coded.dictionary.to_numpy()
            codes = (codes[keys // len(self.pairs)] ^ self.of_word[keys % len(self.pairs)]) * MIX
            places = np.empty(len(keys), "i8")
            places[ids] = at
            yield size, at, ids, recent, places, codes

    def rows(self, size: int, at: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counted rows of the phrases of ``size`` words that stand at the places ``at``."""
        for n in range(0, len(at), ROWS):
            some = at[n:n + ROWS]
            words = [self.forms.take(pa.array(self.code[some + k])) for k in range(size)]
            phrase = pc.binary_join_element_wise(*words, " ") if size > 1 else words[0]
            yield self.counted(self.lang[some], phrase, codes[n:n + ROWS], counts[n:n + ROWS])

    def counted(self, lang: np.ndarray, phrase: pa.Array, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        key = pc.binary_join_element_wise(self.langs.dictionary.take(pa.array(lang)), phrase, "\t")
        return pa.record_batch([key, pa.array(spots(codes).astype("i4")), pa.array(counts.astype("i8"))], names=["key", "spot", "n"])


def count_chunk(batch: pa.RecordBatch, singles: bool, known: Filter | None, longest: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of one chunk of (lang, text): single words if asked, and what the filter lets through."""
    chunk = Chunk(batch)
    if singles and len(chunk.word):
        places = np.empty(len(chunk.pairs), "i8")
        places[chunk.word] = np.arange(len(chunk.word))
        yield from chunk.rows(1, places, chunk.codes, chunk.counts)
        present, found = np.unique(chunk.lang, return_counts=True)
        yield chunk.counted(present, pa.array([""] * len(present)), np.zeros(len(present), "u8"), found)
    for size, _, ids, recent, places, codes in chunk.lengths(known, longest) if known else ():
        counts = np.bincount(ids[recent], minlength=len(places))
        some = counts > 0
        yield from chunk.rows(size, places[some], codes[some], counts[some])


def scan(shard: DataFrame, singles: bool, known: Filter | None, longest: int) -> DataFrame:
    """Counts of one shard's phrases: key, spot, n."""
    return each_chunk(shard, known, lambda chunk, bits: count_chunk(chunk, singles, bits, longest), COUNTED).groupBy("key", "spot").agg(F.sum("n").alias("n"))


def each_chunk(
    texts: DataFrame, known: Filter | None, make: Callable[[pa.RecordBatch, Filter | None], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    spark = texts.sparkSession
    on_workers(spark)
    handed = spark.sparkContext.broadcast(known)

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in by_bytes(batches, 1, CHUNK_BYTES):
            yield from make(chunk, handed.value)

    return texts.mapInArrow(chunks, schema)


def shrink_chunk(batch: pa.RecordBatch, known: Filter, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows with only the stretches, one a line, whose phrases of ``size`` words have all reached the threshold and
    that hold a longer phrase; rows without any are left out."""
    chunk = Chunk(batch)
    # Places of the phrases with one word more whose first and last ``size`` words have reached it.
    at = next((at for n, at, *_ in chunk.lengths(known, size + 1) if n == size + 1), np.empty(0, "i8"))
    inside = np.zeros(len(chunk.word) + 1, "i8")
    np.add.at(inside, at, 1)
    np.add.at(inside, at + size + 1, -1)
    kept = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(kept):
        return
    # A stretch ends before a word that no phrase holds together with the one before it.
    joined = np.zeros(len(chunk.word) + 1, bool)
    joined[(at[:, None] + np.arange(1, size + 1)).ravel()] = True
    words, row = chunk.forms.take(pa.array(chunk.code[kept])), chunk.row[kept]
    words = pc.binary_join_element_wise(pc.if_else(pa.array(joined[kept]), " ", "\n"), words, "")
    rows, first = np.unique(row, return_index=True)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype("i4")), words)
    yield pa.record_batch([batch.column(0).take(pa.array(rows)), pc.binary_join(lists, ""), batch.column(2).take(pa.array(rows))], names=["lang", "text", "shard"])


def read_filter(phrases: DataFrame, oldest: int, count: int) -> Filter:
    """The filter of ``count`` ``phrases`` (spot, since); ``recent`` are those since step ``oldest``."""
    power = min(max(6, (count * BITS_A_PHRASE).bit_length()), MOST_FILTER_BITS)
    one = F.expr("shiftleft(1L, bit & 63)")
    # At most 2**20 rows, however many phrases there are.
    cells = (
        phrases.select(F.shiftright("spot", SPOT_BITS - power).alias("bit"), "since").groupBy(F.shiftright("bit", 6).alias("cell"))
        .agg(F.bit_or(one).alias("reached"), F.bit_or(F.when(F.col("since") >= oldest, one).otherwise(F.lit(0).cast("long"))).alias("recent"))
        .toArrow()
    )
    both = np.zeros((2, 1 << (power - 6)), "u8")
    at = cells.column("cell").to_numpy()
    for n, name in enumerate(("reached", "recent")):
        both[n, at] = cells.column(name).to_numpy().view("u8")
    return Filter(power, both[0], both[1])


class Counting:
    """The counts of all scans so far, in one folder a scan; phrases that are heavy in a scan's shard once more in another."""

    SCHEMA = "key string, spot int, n bigint, step int"

    def __init__(self, spark: SparkSession, least: int, shards: int):
        self.spark, self.least, self.shards = spark, least, shards
        self.root, self.steps, self.reached, self.counts = fresh_path(spark, "phrase-counts"), 0, None, None

    def add(self, found: DataFrame) -> None:
        path = f"step={self.steps}"
        found.write.parquet(f"{self.root}/all/{path}")
        heavy = self.spark.read.schema("key string, spot int, n bigint").parquet(f"{self.root}/all/{path}")
        heavy.where((F.col("n") >= -(-self.least // self.shards)) | F.col("key").endswith("\t")).write.parquet(f"{self.root}/heavy/{path}")
        self.steps += 1

    def rows(self, which: str) -> DataFrame:
        rows = self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/{which}")
        return rows.withColumn("shard", F.col("step") % self.shards).drop("step")

    @staticmethod
    def totals(rows: DataFrame) -> DataFrame:
        """Counts over all shards; scans of the same shard give the same count."""
        once = rows.groupBy("key", "spot", "shard").agg(F.max("n").alias("n"))
        return once.groupBy("key", "spot").agg(F.sum("n").alias("n"))

    def exact(self) -> DataFrame:
        """Counts over all shards scanned: exact for phrases that are heavy somewhere, that is all that may have reached the
        threshold. Rows that share no bit with such a phrase are left out before anything is shuffled."""
        heavy = self.rows("heavy")
        known = read_filter(heavy.select("spot", F.lit(0).alias("since")), 0, heavy.count())
        # One row with all cells of the filter, so that rows are compared where they are read and only those that pass are copied.
        cells = pa.table({"cells": pa.array([known.reached.view("i8")], pa.list_(pa.int64()))})
        bit = F.shiftright("spot", SPOT_BITS - known.power)
        passes = F.getbit(F.get("cells", F.shiftright(bit, 6)), bit.bitwiseAND(63)) == 1
        return self.totals(self.rows("all").join(F.broadcast(self.spark.createDataFrame(cells)), passes).drop("cells"))

    def settle(self, final: bool) -> DataFrame:
        """``reached``: the phrases known to have reached the threshold, with the step that showed it."""
        totals = (self.exact() if final else self.totals(self.rows("heavy"))).where((F.col("n") >= self.least) | F.col("key").endswith("\t"))
        if final:
            path = f"{self.root}/exact/{self.steps}"
            totals.write.parquet(path)
            totals = self.counts = self.spark.read.schema(totals.schema).parquet(path)
        now = totals.where(~F.col("key").endswith("\t")).select("key", "spot", F.lit(self.steps - 1).alias("since"))
        both = now if self.reached is None else now.unionByName(self.reached).groupBy("key", "spot").agg(F.min("since").alias("since"))
        path = f"{self.root}/reached/{self.steps}"
        both.write.parquet(path)
        self.reached = self.spark.read.schema("key string, spot int, since int").parquet(path)
        return self.reached


def count_phrases(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """All phrases of up to ``longest`` words that occur ``least`` times or more in a language: lang, size, phrase, n.

    Texts (lang, text; null: `und` and empty) are cut into pieces at ``.,;:!?`` and line ends, and those into words at
    blanks and tabs; A to Z count as a to z. Rows of size 0 have the number of all words of a language. Repeated rows count
    each; other columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    # Every scan writes what it finds, so the shuffle files of one scan need not be there in the next.
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return scan_cycles(docs, least, longest, shards)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def scan_cycles(docs: DataFrame, least: int, longest: int, shards: int) -> DataFrame:
    """What ``count_phrases`` gives, scan by scan."""
    spark = docs.sparkSession
    dealt = fresh_path(spark, "phrase-shards")
    shard = F.pmod(F.xxhash64("text", "lang"), F.lit(shards)).cast("int")
    docs.select("lang", "text", shard.alias("shard")).write.partitionBy("shard").parquet(f"{dealt}/0")
    texts, counting, known, step = f"{dealt}/0", Counting(spark, least, shards), None, 0
    phrase = F.substring_index("key", "\t", -1)
    size = F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.translate(phrase, " ", "")) + 1)
    while True:
        counting.add(scan(read_shard(spark, texts, step % shards), step < shards, known, longest))
        step += 1
        ended = step % shards == 0
        extensible = counting.settle(ended).where(size < longest)
        phrases, recent = extensible.agg(F.count("*"), F.count(F.when(F.col("since") >= step - shards, 1))).first()
        if ended and not recent:
            lang = F.expr("substring(key, 1, length(key) - length(substring_index(key, '\t', -1)) - 1)")
            return counting.counts.select(lang.alias("lang"), size.cast("int").alias("size"), phrase.alias("phrase"), "n")
        known = read_filter(extensible, step - shards, phrases) if phrases else None
        cycle = step // shards
        if ended and 2 <= cycle < longest and known:
            # Phrases of ``cycle`` words have all had their cycle: what the filter does not have will not come.
            before = spark.read.schema("lang string, text string, shard int").parquet(texts)
            texts = f"{dealt}/{cycle}"
            shrunk = each_chunk(before, known, lambda chunk, bits: shrink_chunk(chunk, bits, cycle), "lang string, text string, shard int")
            shrunk.write.partitionBy("shard").parquet(texts)


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    return spark.read.schema("lang string, text string, shard int").parquet(path).where(F.col("shard") == shard).select("lang", "text")


def words_of(phrase: str, first: str, size: str) -> str:
    return f"array_join(slice(split({phrase}, ' '), {first}, {size}), ' ')"


def collocations(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language whose words occur together most beyond chance.

    lang, rank, phrase, a, l, r, n, score: ``a`` occurrences of the phrase, ``l`` and ``r`` of its two parts at its weakest
    cut, ``n`` words of the language, score floor(1000 a n / (l r)). A phrase inside a longer one that occurs as often is left
    out. Nulls, repeated rows, other columns and empty tables are as in ``count_phrases``.
    """
    counts = count_phrases(docs, least)
    phrases = counts.where("size >= 2").withColumnRenamed("n", "a")
    # Occurrences only grow as a phrase gets shorter, so the phrases with one word more decide for all longer ones.
    longer = phrases.where("size >= 3").select(
        F.col("lang").alias("in_lang"), F.explode(F.array(F.expr(words_of("phrase", "1", "size - 1")), F.expr(words_of("phrase", "2", "size - 1")))).alias("part"), "a",
    ).groupBy("in_lang", "part").agg(F.max("a").alias("longer"))
    held = (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("part")) & (F.col("longer") >= F.col("a"))
    cuts = phrases.join(longer, held, "left_anti").select("lang", "phrase", "a", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("cut"))
    cuts = cuts.withColumn("left", F.expr(words_of("phrase", "1", "cut"))).withColumn("right", F.expr(words_of("phrase", "cut + 1", "size - cut")))
    sizes = counts.where("size = 0").select("lang", "n")
    # One row for each language: few enough for every task, so candidates need not be shuffled by language to meet them.
    if sizes.count() <= MOST_LANGS:
        sizes = F.broadcast(sizes)
    lefts = counts.where("size > 0").select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    rights = counts.where("size > 0").select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    # Counts have at most 16 digits, so 38 digits hold each product.
    score = F.expr("(CAST(a AS decimal(16,0)) * CAST(n AS decimal(16,0)) * CAST(1000 AS decimal(4,0))) DIV (CAST(l AS decimal(16,0)) * CAST(r AS decimal(16,0)))")
    scored = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(sizes, "lang").withColumn("score", score)
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("weakest"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.select("lang", "phrase", "a", "weakest.l", "weakest.r", "n", "weakest.score").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
