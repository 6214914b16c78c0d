"""Preference formatting of conversations, all in DataFrame expressions.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (equal role and text) is
rendered once, as the prompt; what follows in each is its completion, given as text and as segments with a mask
that is 1 on what assistants say and 0 on everything else (role marks, other roles), so that only the assistants'
words count in training. A pair is usable if both completions have an assistant's turn.

Turns are ordered by their number; a conversation's turns are gathered, the conversations of a table are not.
Null texts are empty, a null role is ``user``; marks inside a text are broken up, so no text can forge a turn.
Turns with one number follow by role and text; repeated rows stay repeated turns. A conversation with a null id
is left out. A conversation without a counterpart comes out with no rejected side and is not usable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "|>"


def _turn(*first: Column) -> Column:
    return F.struct(*first, F.col("turn").alias("n"), F.coalesce(F.col("role"), F.lit("user")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _in_order(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def conversations_of(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns): one row a conversation, its turns in order as (role, text)."""
    gathered = turns.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(_turn())).alias("all"))
    return gathered.select("conv_id", _in_order(F.col("all")).alias("turns"))


def _segments(turns: Column) -> Column:
    """Each turn as (text, mask) segments: its mark, what is said, its end."""

    def of(t: Column) -> Column:
        said = F.replace(t["text"], F.lit(OPEN), F.lit("< |"))
        trained = (t["role"] == "assistant").cast("int")
        mark = F.concat(F.lit(OPEN), F.replace(t["role"], F.lit(OPEN), F.lit("< |")), F.lit(f"{CLOSE}\n"))
        return F.array(F.struct(mark.alias("text"), F.lit(0).alias("mask")), F.struct(said.alias("text"), trained.alias("mask")), F.struct(F.lit(f"{OPEN}end{CLOSE}\n").alias("text"), F.lit(0).alias("mask")))

    return F.flatten(F.transform(turns, of))


def _rendered(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def _trained(turns: Column) -> Column:
    return F.exists(turns, lambda t: t["role"] == "assistant")


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, chosen, rejected: arrays of (role, text)) with prefix_turns, prompt, completions, segments and usable."""
    a, b = F.col("chosen"), F.coalesce(F.col("rejected"), F.array().cast(pairs.schema["chosen"].dataType))
    shorter = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(0), F.greatest(shorter - 1, F.lit(0))), lambda i: (i >= shorter) | ~F.get(a, i).eqNullSafe(F.get(b, i)))
    out = pairs.withColumn("prefix_turns", F.coalesce(F.array_min(differs), shorter))
    n = F.col("prefix_turns")
    rest = lambda t: F.slice(t, n + 1, F.greatest(F.size(t) - n, F.lit(0)))
    out = out.withColumns({"chosen_segments": _segments(rest(a)), "rejected_segments": F.when(F.col("rejected").isNotNull(), _segments(rest(b)))})
    return out.select(
        "pair_id", "prefix_turns", _rendered(_segments(F.slice(a, F.lit(1), n))).alias("prompt"),
        _rendered(F.col("chosen_segments")).alias("chosen"), _rendered(F.col("rejected_segments")).alias("rejected"), "chosen_segments", "rejected_segments",
        F.coalesce(_trained(rest(a)) & _trained(rest(b)) & F.col("rejected").isNotNull(), F.lit(False)).alias("usable"),
    )


def pair_neighbours(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected), gathered in one step by the pair's number."""
    named = turns.filter(F.col(id_col).isNotNull()).withColumn("__id", F.col(id_col).cast("long"))
    both = named.groupBy(F.expr("shiftright(__id, 1)").alias("pair_id")).agg(F.sort_array(F.collect_list(_turn(F.expr("__id & 1").cast("int").alias("side")))).alias("all"))
    side = lambda k: _in_order(F.filter("all", lambda t: t["side"] == k))
    alone = F.col("all")[0]["side"] == 1
    return both.select("pair_id", F.when(alone, side(1)).otherwise(side(0)).alias("chosen"), F.when(~alone & F.exists("all", lambda t: t["side"] == 1), side(1)).alias("rejected"))


def masks(segments: Column) -> Column:
    """Segments as ``length:mask`` in characters."""
    return F.array_join(F.transform(segments, lambda s: F.concat_ws(":", F.char_length(s["text"]).cast("string"), s["mask"].cast("string"))), ",")
