"""Mixing sources to target weights by weighted fair queueing.

Every source queues its documents, shuffled, twice over. A document's virtual finish time is the source's
tokens up to and with it, divided by the source's weight; taking documents in the order of these
times serves the sources in proportion to their weights, and what an exhausted source leaves goes to the
others by weight. The mix is what stands before the total budget in that global order.

No text moves: the shuffle key is a digest of the document id, a source's documents are dealt into blocks by that key,
and block sums give each block its starting value, so that one source may hold any share of the rows. The
global order is cut twice: slices of virtual time are summed up, and only the slice in which the budget ends is put
in order. A mix takes a prefix of each source's queue, so it is told by the last key that each source takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from harborline.llm.common import free_names
from harborline.session import stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
# Hexadecimal digits of the shuffle key that name a block of a source's queue: 4096 blocks.
BLOCK_DIGITS = 3
TIME_SLICES = 65_536
# Up to so many sources the plan (a row of some 200 bytes each) is broadcast to the documents.
MOST_SENT_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def shuffle_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """Per source its size, weight and target from (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn. The level to which all sources are filled, per unit of
    weight, is what is left after the sources that end below it: a running sum in the order in which they end.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")))
    ends = weighted.withColumn("most", passes * F.col("source_size")).withColumn("ends_at", F.col("most") / F.col("weight"))
    earlier = Window.orderBy("ends_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    budget = share * F.sum("source_size").over(everything)
    filled = ends.withColumn(
        "level",
        (budget - F.coalesce(F.sum("most").over(earlier), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))),
    )
    # The first source that the level does not fill sets it for all that follow.
    level = F.min(F.when(F.col("level") < F.col("ends_at"), F.struct("ends_at", F.col("level").alias("level")))).over(everything)["level"]
    reached = F.when(level.isNull() | (F.col("ends_at") <= level), F.col("most").cast("double")).otherwise(F.col("weight") * level)
    return filled.select("source", "source_size", "weight", reached.alias("target"), F.floor(budget).alias("budget"))


def plan_mix(docs: DataFrame, **setting) -> DataFrame:
    """Per source: size, weight, target and ``last_1`` ..., the last key its passes take (null: none).

    Keys are (shuffle key, document id, size); rows that agree in all three are taken together or not at all. The
    order across sources is (finish time, pass, source, key).
    """
    passes = setting.get("passes", PASSES)
    entries = stored(
        docs.select("source", "doc_id", words(F.col("text")).alias("size"), shuffle_key(F.col("doc_id")).alias("key")), "mix-entries"
    )
    block = F.substring("key", 1, BLOCK_DIGITS)
    blocks = entries.groupBy("source", block.alias("block")).agg(F.sum("size").alias("held"))
    plan = targets(blocks.groupBy("source").agg(F.sum("held").alias("source_size")), **setting)
    # At most 4096 rows per source.
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0))).drop("held")
    starts = starts.join(plan, starts["source"].eqNullSafe(plan["source"])).select(
        starts["source"].alias("of"), "block", "before", "weight", "source_size"
    )
    key = ["key", "doc_id", "size"]
    inside = Window.partitionBy("source", "block").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    queued = entries.withColumn("block", block).withColumn("run", F.sum("size").over(inside))
    queued = queued.join(starts, queued["source"].eqNullSafe(starts["of"]) & (queued["block"] == starts["block"]))
    finish = (F.col("turn") * F.col("source_size") + F.col("before") + F.col("run")) / F.col("weight")
    timed = queued.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).select("source", *key, "turn", finish.alias("finish"))
    bounds = plan.agg(F.max("budget").alias("budget"), (passes * F.max(F.col("source_size") / F.col("weight"))).alias("horizon")).first()
    if not bounds["budget"]:
        return plan.withColumns({f"last_{n + 1}": F.lit(None).cast("struct<key: string, doc_id: bigint, size: bigint>") for n in range(passes)})
    slice_of = F.floor(F.col("finish") / bounds["horizon"] * TIME_SLICES)
    return _cut(stored(timed.withColumn("slice", slice_of), "mix-times"), plan, key, passes, bounds["budget"])


def _cut(timed: DataFrame, plan: DataFrame, key: list[str], passes: int, budget: int) -> DataFrame:
    # At most TIME_SLICES + 1 rows.
    slices = timed.groupBy("slice").agg(F.sum("size").alias("held"))
    upto = slices.withColumn("upto", F.sum("held").over(Window.orderBy("slice")))
    # The slice in which the budget ends, and what stands before it.
    ending = upto.where(F.col("upto") > budget).agg(F.min("slice").alias("last"), F.min_by(F.col("upto") - F.col("held"), "slice").alias("before")).first()
    if ending["last"] is None:
        taken = timed
    else:
        order = Window.orderBy("finish", "turn", F.col("source").asc_nulls_last(), *key)
        last = timed.where(F.col("slice") == ending["last"]).withColumn("upto", ending["before"] + F.sum("size").over(order))
        taken = timed.where(F.col("slice") < ending["last"]).unionByName(last.where(F.col("upto") <= budget).drop("upto"))
    lasts = taken.groupBy(F.col("source").alias("of")).agg(
        *[F.max(F.when(F.col("turn") == n, F.struct(*key))).alias(f"last_{n + 1}") for n in range(passes)]
    )
    return plan.join(lasts, plan["source"].eqNullSafe(lasts["of"]), "left").drop("of")


def met_by_source(plan: DataFrame) -> DataFrame:
    """The plan as a side to join by source: sent to all tasks if it has few sources, so that no row of a hot source moves; else Spark decides."""
    plan = stored(plan, "mix-plan")
    return F.broadcast(plan) if plan.count() <= MOST_SENT_SOURCES else plan


def times_taken(key: Column, lasts: list[Column]) -> Column:
    """How often the mix takes the document with this key, from the last keys of its source."""
    return sum((F.coalesce((key <= last).cast("int"), F.lit(0)) for last in lasts), F.lit(0))


def mix(docs: DataFrame, **setting) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target and ``taken`` words.

    Null and empty texts have size 0. A null source is a source. An empty table gives no rows.
    """
    plan = met_by_source(plan_mix(docs, **setting).withColumnRenamed("source", "of"))
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("size"), shuffle_key(F.col("doc_id")).alias("key"))
    found = rows.join(plan, rows["source"].eqNullSafe(plan["of"]))
    lasts = [F.col(c) for c in plan.columns if c.startswith("last_")]
    taken = F.col("size") * times_taken(F.struct("key", "doc_id", "size"), lasts)
    return found.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def apply_mix(docs: DataFrame, **setting) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all their columns as they are.

    A row without words costs nothing and stays once.
    """
    plan = met_by_source(plan_mix(docs, **setting))
    renamed = dict(zip(plan.columns, free_names(docs, *[f"mix_{c}" for c in plan.columns])))
    plan = plan.withColumnsRenamed(renamed)
    times, turn = free_names(docs, "mix_times", "mix_turn")
    size = words(docs["text"])
    key = F.struct(shuffle_key(docs["doc_id"]).alias("key"), docs["doc_id"].alias("doc_id"), size.alias("size"))
    lasts = [F.col(new) for old, new in renamed.items() if old.startswith("last_")]
    rows = docs.join(plan, docs["source"].eqNullSafe(plan[renamed["source"]]))
    kept = rows.withColumn(times, F.when(size == 0, F.lit(1)).otherwise(times_taken(key, lasts))).where(F.col(times) > 0)
    return kept.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
