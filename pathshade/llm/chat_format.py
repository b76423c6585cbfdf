"""Preference formatting of conversations (native expressions only).

The longest common prefix of turns of a chosen and a rejected conversation is
rendered once as prompt; what follows it in either is rendered as a completion,
with the character spans that train (assistant turns) as its mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def rendered_turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered_turn), "")


def mask(turns: Column) -> Column:
    """[start, end) character spans of the trained turns' text and end mark in
    the rendering of ``turns``; spans are in order and never touch."""
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.char_length(t["role"]) + len(OPEN) + len(CLOSE)
        stop = start + F.char_length(t["text"]) + len(END)
        own = F.array(F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop")))
        return F.struct(stop.cast("long").alias("at"), F.when(t["role"] == TRAINED, F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, empty, step, lambda s: s["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns with the same role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    differs = F.array_position(same, F.lit(False)).cast("int")
    return F.when(differs == 0, F.size(same)).otherwise(differs - 1)


def format_preferences(turns: DataFrame, pair: Column, rejected: Column) -> DataFrame:
    """One row per pair from the turns (conv_id, turn, role, text): pair_id,
    chosen_id, rejected_id, prompt_turns, prompt, chosen, rejected, chosen_mask,
    rejected_mask.

    ``pair`` numbers the pair that a row's conversation belongs to and
    ``rejected`` says which side it is. Turns are ordered by turn, then role and
    text; repeated rows are repeated turns. Null roles and texts are empty, rows
    with a null conv_id or pair take no part. A missing side counts as a
    conversation without turns and has a null id. Texts of any length are rendered whole,
    an empty table gives no rows, and other columns are not looked at, whatever their
    names. One shuffle, by pair.
    """
    rows = turns.select(
        pair.alias("pair_id"),
        rejected.alias("_rejected"),
        "conv_id",
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("_t"),
    ).where("pair_id is not null and conv_id is not null")
    sides = rows.groupBy("pair_id").agg(
        F.max(F.when(~F.col("_rejected"), F.col("conv_id"))).alias("chosen_id"),
        F.max(F.when(F.col("_rejected"), F.col("conv_id"))).alias("rejected_id"),
        F.array_sort(F.collect_list(F.when(~F.col("_rejected"), F.col("_t")))).alias("_c"),
        F.array_sort(F.collect_list(F.when(F.col("_rejected"), F.col("_t")))).alias("_r"),
    )
    cut = sides.withColumn("prompt_turns", common_turns(F.col("_c"), F.col("_r")))
    cut = cut.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.col("prompt_turns").cast("long").alias("prompt_turns"),
        F.slice("_c", F.lit(1), F.col("prompt_turns")).alias("_p"),
        *[F.slice(x, F.col("prompt_turns") + 1, F.greatest(F.size(x), F.lit(1))).alias(x) for x in ("_c", "_r")],
    )
    return cut.select("pair_id", "chosen_id", "rejected_id", "prompt_turns", rendered(F.col("_p")).alias("prompt"), rendered(F.col("_c")).alias("chosen"), rendered(F.col("_r")).alias("rejected"), mask(F.col("_c")).alias("chosen_mask"), mask(F.col("_r")).alias("rejected_mask"))
