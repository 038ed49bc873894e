"""Preference formatting: one prompt for a chosen and a rejected conversation, and two masked completions.

A pair's prompt is the longest common prefix of turns (same role and text); it is rendered once.  Each
completion is what follows in its conversation, with a mask of the code points that count for the loss:
the texts of the assistant's turns, with the marker that ends them.

Pairs are given as turns (`preference_pairs`) or made from plain conversations (`with_other_answers`): a
conversation is chosen; rejected is the same up to one of the assistant's turns, which another
conversation's last answer replaces.

Nulls: turns without a conversation id are left out; a null role or text renders as empty, and null
equals null and nothing else.  Turns are ordered by number (null first), then role and text; repeated
turns stay.  A pair with one conversation has nulls for the other, and an empty prompt.  Markers inside
texts are broken by a space, so that a text can't end its turn.  A conversation is one row of the
result, so its turns must fit one row.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def _piece(turn: Column) -> Column:
    clean = lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("<|"), F.lit("< |"))
    head = F.concat(F.lit(START), clean(turn["role"]), F.lit(MIDDLE))
    body = F.concat(clean(turn["text"]), F.lit(END))
    return F.struct(F.concat(head, body).alias("text"), F.length(head).alias("skip"), F.length(body).alias("n"), F.coalesce(turn["role"] == "assistant", F.lit(False)).alias("counts"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: _piece(t)["text"]), "")


def _mask(turns: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        p = _piece(t)
        a, b = acc["at"] + p["skip"], acc["at"] + p["skip"] + p["n"]
        span = F.struct(a.alias("start"), b.alias("end"))
        return F.struct(b.alias("at"), F.when(p["counts"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_pairs(turns: DataFrame) -> DataFrame:
    """turns(pair_id, side, conv_id, turn, role, text), side 0 chosen and 1 rejected: a row per pair."""
    turn = F.struct("turn", "role", "text")
    of = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, turn)))
    idof = lambda side: F.min(F.when(F.col("side") == side, F.col("conv_id")))
    return formatted(turns.groupBy("pair_id").agg(of(0).alias("c"), of(1).alias("r"), idof(0).alias("chosen_id"), idof(1).alias("rejected_id")))


def formatted(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, chosen_id, rejected_id, c, r), c and r the turns (turn, role, text) in order: a row per pair."""
    n = F.least(F.size("c"), F.size("r"))
    same = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get("c", k)["role"].eqNullSafe(F.get("r", k)["role"]) & F.get("c", k)["text"].eqNullSafe(F.get("r", k)["text"]))
    differ = F.array_position(F.when(n > 0, same).otherwise(F.array().cast("array<boolean>")), False)
    pairs = pairs.withColumn("n_prompt_turns", F.when(differ > 0, differ - 1).otherwise(n).cast("int"))
    rest = lambda side: F.when(F.size(side) > 0, F.slice(side, F.col("n_prompt_turns") + 1, F.size(side)))
    pairs = pairs.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", F.slice("c", F.lit(1), F.col("n_prompt_turns")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return pairs.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", _rendered(F.col("p")).alias("prompt"), _rendered(F.col("c")).alias("chosen"), _rendered(F.col("r")).alias("rejected"), _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"))


def with_other_answers(conversations: DataFrame) -> DataFrame:
    """Pairs for formatted(), one for each conversation: it is chosen; rejected is it up to the assistant's turn number conv_id modulo
    their number (from 0), in place of which comes the last answer of the neighbour, the conversation whose id differs in the last bit.

    Without an assistant's turn, or a neighbour that has one, there is no rejected conversation.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", "role", "text").alias("t"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("c"))
    every = F.sequence(F.lit(1), F.size("c"))
    rows = rows.withColumn("at", F.filter(every, lambda k: F.coalesce(F.element_at("c", k)["role"] == "assistant", F.lit(False))))
    last = rows.where(F.size("at") > 0).select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("of"), F.col("conv_id").alias("other"), F.element_at("c", F.element_at("at", -1))["text"].alias("answer"))
    both = rows.join(last, F.col("conv_id") == F.col("of"), "left")
    place = F.element_at("at", (F.pmod("conv_id", F.size("at")) + 1).cast("int"))
    turn = F.struct(F.element_at("c", place)["turn"].alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"))
    paired = (F.size("at") > 0) & F.col("other").isNotNull()
    rejected = F.when(paired, F.concat(F.slice("c", F.lit(1), place - 1), F.array(turn))).otherwise(F.slice("c", 1, 0))
    return both.select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), F.when(paired, F.col("other")).alias("rejected_id"), "c", rejected.alias("r"))


def op8_preference(conversations: DataFrame) -> DataFrame:
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), " ")
    pairs = formatted(with_other_answers(conversations))
    return pairs.withColumn("chosen_mask", spans("chosen_mask")).withColumn("rejected_mask", spans("rejected_mask"))
