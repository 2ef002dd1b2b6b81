"""Preference pairs from chosen and rejected conversations.

The longest common prefix of turns is rendered once as the prompt. What follows is rendered for
both as completions. The spans of a completion that are trained on are the texts of the
assistant's turns with their end marks; what else is in it is masked. Turns are equal if role
and text are equal, nulls included; a null role or text renders as empty.

Offsets count code points from the start of the completion, the end left out. Equal conversations
have empty completions; without a common turn the prompt is empty. Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
ASSISTANT = "assistant"


def conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns): the turns of each conversation as an array of (turn, role, text) in order.

    Order is by turn, then role and text; null turns come first. A conversation is one row, so
    its length bounds the row.
    """
    turn = F.struct("turn", "role", "text")
    return turns.groupBy(id_col).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _common(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in both arrays."""
    same = F.zip_with(
        a,
        b,
        lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]),
    )
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first > 0, first - 1).otherwise(F.size(same))


def _shown(turn: Column) -> Column:
    role, text = F.coalesce(turn["role"], F.lit("")), F.coalesce(turn["text"], F.lit(""))
    return F.concat(F.lit(START), role, F.lit(MIDDLE), text, F.lit(END))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _shown), "")


def _spans(turns: Column) -> Column:
    """(start, stop) of the assistant's texts and end marks in the rendered turns."""

    def add(acc, turn):
        size = F.length(_shown(turn))
        head = F.lit(len(START) + len(MIDDLE)) + F.length(F.coalesce(turn["role"], F.lit("")))
        span = F.struct((acc["at"] + head).cast("int").alias("start"), (acc["at"] + size).cast("int").alias("stop"))
        mine = turn["role"].eqNullSafe(F.lit(ASSISTANT))
        spans = F.when(mine, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + size).cast("int").alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))
    return F.aggregate(turns, zero, add, lambda acc: acc["spans"])


def preference_pairs(pairs: DataFrame, chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """Replace two arrays of turns by ``n_prompt`` (turns), ``prompt``, and for both sides the
    completion (under the column's name) and ``<name>_spans``. Null arrays count as empty."""
    keys = [F.col(f"`{c}`") for c in pairs.columns if c not in (chosen_col, rejected_col)]
    empty = F.array().cast(pairs.schema[chosen_col].dataType)
    sides = {c: F.coalesce(F.col(c), empty) for c in (chosen_col, rejected_col)}
    counted = pairs.select(*keys, *[v.alias(c) for c, v in sides.items()]).withColumn(
        "n_prompt", _common(F.col(chosen_col), F.col(rejected_col))
    )
    def rest(c):
        return F.slice(F.col(c), F.col("n_prompt") + 1, F.size(c))

    return counted.select(
        *keys,
        "n_prompt",
        _rendered(F.slice(F.col(chosen_col), F.lit(1), F.col("n_prompt"))).alias("prompt"),
        *[_rendered(rest(c)).alias(c) for c in sides],
        *[_spans(rest(c)).alias(f"{c}_spans") for c in sides],
    )
