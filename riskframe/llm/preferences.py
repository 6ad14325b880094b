"""Preference pairs: one prompt, two completions, and the characters of each that are trained on.

A pair's chosen and rejected conversations are compared turn by turn; the longest common prefix, by
role and text, is rendered once as the prompt, the rest of either as its completion.  Spans mark the
text and end mark of the assistant's turns inside a completion; all else is masked.

One shuffle brings the turns of a pair together; equal rows are merged before it.  A pair is one
output row, so all its turns must fit one task.

Defined results: turns are ordered by turn, role and text, and exactly repeated rows count once; a null
text is empty, a null role is ``user``, and a null turn comes first; rows without a pair identifier are
left out; a pair with one side only has an empty completion on the other and ``paired`` false;
two equal conversations have two empty completions; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>\n"


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit(END))), "")


def _spans(turns: Column) -> Column:
    """Character spans, ``end`` exclusive, of what is trained on in the rendered turns."""

    def add(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(_head(t["role"]))
        end = start + F.length(t["text"]) + F.lit(len(END))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(t["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    first = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")
    )
    return F.aggregate(turns, first, add, lambda s: s["spans"])


def preference_pairs(
    chosen: DataFrame,
    rejected: DataFrame,
    pair_col: str = "pair_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per pair: ``(<pair_col>, n_prefix, prompt, chosen, rejected, chosen_spans, rejected_spans, paired)``."""

    def turns(df: DataFrame, side: str) -> DataFrame:
        turn = F.struct(
            df[turn_col].alias("turn"),
            F.coalesce(df[role_col], F.lit("user")).alias("role"),
            F.coalesce(df[text_col], F.lit("")).alias("text"),
        )
        return df.filter(df[pair_col].isNotNull()).select(
            df[pair_col].alias("__pair"), F.lit(side).alias("side"), turn.alias("t")
        )

    both = turns(chosen, "c").unionByName(turns(rejected, "r"))

    def side(name: str) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("side") == name, F.col("t")))).alias(name)

    pairs = both.groupBy("__pair").agg(side("c"), side("r"))
    equal = F.zip_with(
        "c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False))
    )
    first = F.array_position(equal, False)
    n = F.when(first > 0, first - 1).otherwise(F.size(equal)).cast("int")
    rest = {s: F.slice(s, F.col("n_prefix") + 1, F.greatest(F.size(s), F.lit(1))) for s in ("c", "r")}
    return pairs.withColumn("n_prefix", n).select(
        F.col("__pair").alias(pair_col),
        "n_prefix",
        _rendered(F.slice("c", 1, F.col("n_prefix"))).alias("prompt"),
        _rendered(rest["c"]).alias("chosen"),
        _rendered(rest["r"]).alias("rejected"),
        _spans(rest["c"]).alias("chosen_spans"),
        _spans(rest["r"]).alias("rejected_spans"),
        ((F.size("c") > 0) & (F.size("r") > 0)).alias("paired"),
    )


def stale_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides made from plain conversations, with ``pair_id`` for ``conv_id``.

    Chosen is a conversation up to its last reply.  Rejected repeats the assistant's reply before
    that instead (with no earlier reply, it echoes the turn before).  Without a reply there is a
    chosen side only.
    """
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    reply = F.col("role") == "assistant"
    turns = conversations.select(
        F.col("conv_id").alias("pair_id"),
        "turn",
        "role",
        "text",
        F.max(F.when(reply, F.col("turn"))).over(whole).alias("last"),
        F.coalesce(
            F.last(F.when(reply, F.col("text")), ignorenulls=True).over(earlier),
            F.last("text").over(earlier),
            F.lit(""),
        ).alias("stale"),
    )
    kept = turns.filter(F.col("last").isNull() | (F.col("turn") <= F.col("last")))
    again = F.when(reply & (F.col("turn") == F.col("last")), F.col("stale")).otherwise(F.col("text"))
    rejected = kept.filter(F.col("last").isNotNull()).withColumn("text", again)
    names = ["pair_id", "turn", "role", "text"]
    return kept.select(*names), rejected.select(*names)
