"""Preference formatting: a common prompt, rendered once, and a masked completion for each side.

Everything is DataFrame functions. The only shuffle brings the turns of a conversation together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = ("<|", "|>\n")
FOOTER = "<|end|>\n"
TRAINED = "assistant"


def conversations(turns: DataFrame, key: str = "conv_id", name: str = "chosen") -> DataFrame:
    """One row per conversation: its key and the array of its turns (role, text) by turn, then role, then text.

    Null roles and texts count as empty; null turns come first; a null key is a conversation of its own. Rows that occur
    twice are turns that occur twice.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(turn))
    return turns.groupBy(key).agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(name))


def parroted(turns: Column) -> Column:
    """A worse version of a conversation: its last trained turn only repeats the turn before it, or nothing."""
    last = F.size(turns) - F.array_position(F.reverse(F.transform(turns, lambda t: t["role"])), TRAINED)
    replaced = F.transform(
        turns,
        lambda t, i: F.when(i == last, F.struct(t["role"].alias("role"), F.when(i > 0, F.get(turns, i - 1)["text"]).otherwise("").alias("text"))).otherwise(t),
    )
    return F.when(F.exists(turns, lambda t: t["role"] == TRAINED), replaced).otherwise(turns)


def common_turns(left: Column, right: Column) -> Column:
    """How many turns two conversations share from the start."""
    same = F.zip_with(F.slice(left, 1, F.least(F.size(left), F.size(right))), F.slice(right, 1, F.least(F.size(left), F.size(right))), lambda a, b: a.eqNullSafe(b))
    differs = F.array_position(same, False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(same)).cast("long")


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(HEADER[0]), t["role"], F.lit(HEADER[1]), t["text"], F.lit(FOOTER))), "")


def mask(turns: Column) -> Column:
    """Run lengths in characters over the rendered turns, `length:1` where a model is trained and `length:0` elsewhere."""
    fixed = len(HEADER[0]) + len(HEADER[1])

    def runs(t: Column) -> Column:
        flag = F.when(t["role"] == TRAINED, ":1,").otherwise(":0,")
        return F.concat((F.length(t["role"]) + fixed).cast("string"), F.lit(":0,"), F.length(t["text"]).cast("string"), flag, F.lit(f"{len(FOOTER)}:0"))

    return F.array_join(F.transform(turns, runs), ",")


def preference_pairs(pairs: DataFrame, key: str = "conv_id") -> DataFrame:
    """Key, n_common, prompt, and text and mask of the chosen and the rejected completion.

    `pairs` has arrays `chosen` and `rejected` of (role, text); a null array counts as empty. Equal conversations have
    empty completions. Columns besides these are not carried.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    sides = pairs.select(key, F.coalesce("chosen", empty).alias("chosen"), F.coalesce("rejected", empty).alias("rejected"))
    split = sides.withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")))
    first = F.col("n_common").cast("int")
    rest = {side: F.slice(F.col(side), first + 1, F.size(side)) for side in ("chosen", "rejected")}
    return split.select(
        key,
        "n_common",
        rendered(F.slice("chosen", F.lit(1), first)).alias("prompt"),
        rendered(rest["chosen"]).alias("chosen"),
        mask(rest["chosen"]).alias("chosen_mask"),
        rendered(rest["rejected"]).alias("rejected"),
        mask(rest["rejected"]).alias("rejected_mask"),
    )
