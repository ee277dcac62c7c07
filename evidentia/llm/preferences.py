"""Preference pairs: the longest common turn prefix rendered once, and two masked completions.

Turns are compared by number, role and text.  The first turn at which the conversations differ, or that only one has,
begins the completions.  A completion's mask lists the spans, as start-end in its code points, that are trained on: text
and closing mark of the assistant's turns.  Turns are grouped once, into one array a conversation.

Defined results: a null role or text counts as empty; a null turn number comes first; turns that repeat a number are
ordered by role and text, and compared as a list; equal conversations give two empty completions; a pair of which one
side has no turn gives an empty prompt; rows without an identifier are ignored; extra columns are ignored; an empty table
gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .mixing import ranked

CLOSE = "\n<|end|>\n"


def head_of(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _turn(number: Column) -> Column:
    return F.struct(number.cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def format_arrays(pairs: DataFrame, trained: str = "assistant") -> DataFrame:
    """From (pair_id, a, b), the turns of the chosen and the rejected side in order, one row a pair."""
    shorter = F.least(F.size("a"), F.size("b"))
    differs = F.filter(F.sequence(F.lit(1), shorter), lambda i: ~F.element_at("a", i).eqNullSafe(F.element_at("b", i)))
    first = F.when(shorter == 0, F.lit(1)).otherwise(F.coalesce(F.get(differs, F.lit(0)), shorter + 1))
    pairs = pairs.withColumn("first", first)

    def shown(turns: Column) -> Column:
        return F.array_join(F.transform(turns, lambda t: F.concat(head_of(t["role"]), t["text"], F.lit(CLOSE))), "")

    def rest(name: str) -> Column:
        return F.slice(F.col(name), F.col("first"), F.greatest(F.size(name) - F.col("first") + 1, F.lit(0)))

    def mask(turns: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("spans"))

        def step(acc: Column, t: Column) -> Column:
            begin = acc["at"] + F.length(head_of(t["role"]))
            end = begin + F.length(t["text"]) + F.length(F.lit(CLOSE))
            span = F.concat(F.when(acc["spans"] == "", "").otherwise(","), begin.cast("string"), F.lit("-"), end.cast("string"))
            return F.struct(end.cast("long").alias("at"), F.when(t["role"] == trained, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(turns, start, step, lambda acc: acc["spans"])

    return pairs.select(
        "pair_id", (F.col("first") - 1).cast("long").alias("n_prompt_turns"), shown(F.slice(F.col("a"), F.lit(1), F.col("first") - 1)).alias("prompt"),
        shown(rest("a")).alias("chosen"), shown(rest("b")).alias("rejected"), mask(rest("a")).alias("chosen_mask"), mask(rest("b")).alias("rejected_mask"))


def format_pairs(chosen: DataFrame, rejected: DataFrame, trained: str = "assistant") -> DataFrame:
    """Both sides have (pair_id, turn, role, text); gives one row a pair."""
    clean = lambda df, side: df.where("pair_id is not null").select("pair_id", F.lit(side).alias("side"), _turn(F.col("turn")).alias("t"))
    turns = clean(chosen, 0).unionByName(clean(rejected, 1))
    return format_arrays(turns.groupBy("pair_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("t")))).alias(n) for s, n in ((0, "a"), (1, "b"))]), trained)


def exchange_tails(conversations: DataFrame) -> DataFrame:
    """Preference data (pair_id, a, b) from plain conversations (conv_id, turn, role, text): each is preferred to itself with
    a tail of the next conversation (by ascending conv_id; after the last comes the first).  Of the n turns of a
    conversation the first ``conv_id mod n`` stay, then come the next one's turns from that place on, if it has so many.
    Turns are numbered by their place."""
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("pair_id"), _turn(F.col("turn")).alias("t"))
    ordered = turns.groupBy("pair_id").agg(F.array_sort(F.collect_list("t")).alias("own"))
    placed = F.transform("own", lambda t, i: F.struct(i.cast("long").alias("turn"), t["role"].alias("role"), t["text"].alias("text")))
    whole = cut(ordered.select("pair_id", placed.alias("own")))
    ids = ranked(whole.select("pair_id"), F.col("pair_id")).select("pair_id", "rank")
    count = ids.count()
    after = ids.select(F.col("pair_id").alias("next_id"), F.pmod(F.col("rank") - 1, F.lit(max(count, 1))).alias("rank"))
    pairs = ids.join(after, "rank").select("pair_id", "next_id")
    both = whole.join(pairs, "pair_id").join(whole.select(F.col("pair_id").alias("next_id"), F.col("own").alias("theirs")), "next_id")
    keep = F.pmod("pair_id", F.size("own")).cast("int")
    tail = F.slice(F.col("theirs"), keep + 1, F.greatest(F.size("theirs") - keep, F.lit(0)))
    return both.select("pair_id", F.col("own").alias("a"), F.concat(F.slice(F.col("own"), F.lit(1), keep), tail).alias("b"))
