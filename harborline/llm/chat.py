"""Rendering a dialogue once for every participant, with that participant as the assistant.

A participant is a speaker with at least one turn that is no system turn. In a participant's rendering its own turns
are the assistant's and are trained on; all other turns are those of users, named by their speaker, and masked, and
system turns stay system turns. A long dialogue is rendered in parts of a fixed span of turn numbers, each a row
of its own, so that no row, task or group grows with a dialogue; the parts in order are the whole rendering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

PART_TURNS = 64
SYSTEM = "system"
UNNAMED = "unknown"
# The marks of the chat format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per (conv_id, perspective, part): n_turns, rendered, mask and trained characters.

    ``turns`` has conv_id, turn, role and text. ``mask`` lists the spans to train on, as start-end in characters of this part
    (the text of the perspective's own turns with its closing mark), joined by semicolons; empty if there is none.
    Null text is empty, a null role is the speaker "unknown", a null conv_id is a conversation. Turns without a number
    come first, in a part numbered -1; turns that tie go by speaker and text, and repeated rows are rendered each. A conversation of
    system turns alone, and an empty table, give no rows.
    """
    said = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(UNNAMED)).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).alias("part"),
    )
    # Pre-aggregated before the shuffle: a row per conversation and speaker.
    views = said.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    seen = said.join(views, said["conv_id"].eqNullSafe(views["of"])).drop("of")
    own = F.col("speaker") == F.col("perspective")
    head = F.concat(
        F.lit(OPEN),
        F.when(own, F.lit("assistant")).when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), F.col("speaker"))),
        F.lit("\n"),
    )
    lines = seen.withColumn("own", own).withColumn("head", head).withColumn("body", F.concat("text", F.lit(CLOSE)))
    key = ["conv_id", "perspective", "part"]
    order = ["turn", "speaker", "text"]
    upto = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = lines.withColumn("end", F.sum(F.length("head") + F.length("body")).over(upto))
    span = F.when(F.col("own"), F.concat_ws("-", (F.col("end") - F.length("body")).cast("string"), F.col("end").cast("string")))
    # A group holds the turns of one part.
    parts = ends.groupBy(*key).agg(
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("end", F.concat("head", "body").alias("line"), span.alias("span")))).alias("lines"),
        F.sum(F.when(F.col("own"), F.length("body")).otherwise(0)).alias("trained_chars"),
    )
    return parts.select(
        *key, "n_turns", F.concat_ws("", "lines.line").alias("rendered"), F.concat_ws(";", "lines.span").alias("mask"), "trained_chars"
    )
