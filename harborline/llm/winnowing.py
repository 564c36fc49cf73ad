"""Document fingerprints by winnowing, and how alike two fingerprints are.

Words are hashed, every run of K_WORDS words has a hash of its words' hashes, and of every WINDOW runs the least hash
is selected, the rightmost where several are least. Any passage of K_WORDS + WINDOW - 1 words that two texts share is
thus found in both fingerprints, wherever it stands.

A selected run is one integer: the upper 40 bits of its hash above the 24 bits of its position, the position counted
down, so that the least integer of a window is its least hash at the rightmost place. (In a text of more than 2^24 words
positions are told modulo 2^24.) All of it is built-in array functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

K_WORDS = 5
WINDOW = 4
POSITION_BITS = 24
POSITIONS = (1 << POSITION_BITS) - 1
# Documents per block of the descending order of ids, and the most blocks there are.
BLOCK_ROWS = 500
MOST_BLOCKS = 10_000


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def run_hashes(text: Column, k: int = K_WORDS) -> Column:
    """A hash for each run of ``k`` words; a text of fewer words has one run, an empty one none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")

    def runs(hashed: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(hashed) - k, F.lit(0)))
        found = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashed, i + n) for n in range(k)]))
        return F.when(F.size(hashed) > 0, found).otherwise(F.array().cast("array<bigint>"))

    return bind(F.transform(words, lambda w: F.xxhash64(w)), runs)


def select_runs(hashes: Column, window: int = WINDOW) -> Column:
    """The selected runs of a text, in the order of their places; its last window is all runs if it has fewer."""
    def marked(h: Column, i: Column) -> Column:
        place = (F.lit(POSITIONS) - i.bitwiseAND(F.lit(POSITIONS))).cast("bigint")
        return F.shiftleft(F.shiftright(h, POSITION_BITS), POSITION_BITS).bitwiseOR(place)

    def least(runs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(runs) - window, F.lit(0)))
        found = F.array_distinct(F.transform(starts, lambda i: F.least(*[F.get(runs, i + n) for n in range(window)])))
        return F.when(F.size(runs) > 0, found).otherwise(runs)

    return bind(F.transform(hashes, marked), least)


def positions(selected: Column) -> Column:
    return F.transform(selected, lambda s: F.lit(POSITIONS) - s.bitwiseAND(F.lit(POSITIONS)))


def hash_set(selected: Column) -> Column:
    return F.array_distinct(F.transform(selected, lambda s: F.shiftright(s, POSITION_BITS)))


def digest(selected: Column) -> Column:
    """A fingerprint as one short text (128 bits): equal for equal selections."""
    halves = [F.xxhash64(selected), F.xxhash64(F.lit(1), selected)]
    return F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves]))


def likeness(left: Column, right: Column) -> Column:
    """Shared part of two hash sets (1 if both are empty)."""
    def of(shared: Column) -> Column:
        either = F.size(left) + F.size(right) - shared
        return F.when(either == 0, F.lit(1.0)).otherwise(shared / either)

    return bind(F.size(F.array_intersect(left, right)), of)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id with the selected hashes and their places in words, for every text (null: empty, which has none)."""
    chosen = docs.select("doc_id", select_runs(run_hashes(F.col("text"))).alias("selected"))
    return chosen.select("doc_id", F.transform("selected", lambda s: F.shiftright(s, POSITION_BITS)).alias("hashes"), positions(F.col("selected")).alias("positions"))


def _long_array(values: list[int]) -> Column:
    """A constant array; one literal however many values."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _count_upto(bounds: list[int], value: Column) -> Column:
    """How many of the ascending ``bounds`` are not above ``value``, by halving."""
    held = _long_array(bounds)
    steps = F.array(*[F.lit(1 << n) for n in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda at, step: F.when((at + step <= len(bounds)) & (F.get(held, at + step - 1) <= value), at + step).otherwise(at)
    )


def with_next(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, text and selected runs, with those of the next document by descending id (after the last: the first).

    Ids are cut into blocks of about equal numbers of rows. The first row of each block is copied to the end of the
    block before it, so each block knows the next of all its rows. Null ids come last; rows with the same id go by their text.
    """
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    keyed = docs.select(key.alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = keyed.count()
    n_blocks = max(1, min(rows // block_rows, MOST_BLOCKS))
    # At most MOST_BLOCKS values come to the driver, here and below.
    cuts = keyed.agg(F.percentile_approx("key", [n / n_blocks for n in range(1, n_blocks)] or [0.5], 20 * MOST_BLOCKS)).first()[0] or []
    block = _count_upto(sorted(set(cuts)), F.col("key")) if n_blocks > 1 and cuts else F.lit(0)
    placed = keyed.withColumn("block", block)
    firsts = sorted(placed.groupBy("block").agg(F.max("key").alias("key")).collect())
    # The first row of a block follows the last row of the block above; that of the highest follows the lowest's.
    above = {r["block"]: firsts[(n + 1) % len(firsts)]["block"] for n, r in enumerate(firsts)}
    n_all = max(above, default=0) + 1
    first_of = dict(firsts)
    first, target = (_long_array([d.get(n, 0) for n in range(n_all)]) for d in (first_of, above))
    is_first = F.col("key") == F.get(first, F.col("block"))
    here = F.struct(F.col("block").cast("bigint").alias("block"), F.lit(False).alias("copied"))
    copies = F.when(is_first, F.array(here, F.struct(F.get(target, F.col("block")).alias("block"), F.lit(True).alias("copied")))).otherwise(F.array(here))
    spread = placed.withColumn("at", F.explode(copies)).select("key", "doc_id", "text", "at.block", "at.copied").repartition("block")
    chosen = spread.withColumn("selected", select_runs(run_hashes(F.col("text"))))
    order = Window.partitionBy("block").orderBy("copied", F.desc("key"), "text")
    following = chosen.withColumn("next", F.lead(F.struct("text", "selected")).over(order))
    return following.where(~F.col("copied")).select("doc_id", "text", "selected", F.col("next.text").alias("next_text"), F.col("next.selected").alias("next_selected"))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last third replaced by as many code points, or all, from the start of the next one."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - third), F.substr(following, F.lit(1), third))


def compare_with_next(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The fingerprints of each text and of its edited text, and how alike the first is to the second and to the next document's."""
    rows = with_next(docs, block_rows)
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "selected", "next_selected",
        select_runs(run_hashes(F.col("edited"))).alias("edited_selected"),
    )
    sets = rows.withColumns({f"{c}_set": hash_set(F.col(c)) for c in ("selected", "next_selected", "edited_selected")})
    return sets.select(
        "doc_id", "n_chars", "edited_sha256",
        digest(F.col("selected")).alias("fingerprint"), digest(F.col("edited_selected")).alias("edited_fingerprint"),
        likeness(F.col("selected_set"), F.col("edited_selected_set")).alias("near_edited"),
        likeness(F.col("selected_set"), F.col("next_selected_set")).alias("near_next"),
    )
