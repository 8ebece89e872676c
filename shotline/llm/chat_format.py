"""Preference formatting of conversation pairs.

For a chosen and a rejected conversation the longest common prefix of turns (role and text) is rendered once as the
prompt; what follows in each becomes its completion, with the places that a loss may count: the assistant's words and
their closing mark. A conversation is gathered by one shuffle on its pair; places come from a running sum over its turns
before they are gathered, so the work is linear in the turns, and the rest is expressions of one row.

Defined results: turns go by number, then role and text, so repeated turns stand one after another; a null role or text
is rendered as nothing and equals only another null; a pair that lacks one side gives that side's columns as null and
the other whole, after an empty prompt; rows without a conversation id belong to no pair; an empty table gives none.
The template's own marks inside a text are broken up, so that no turn can forge another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def _clean(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _clean(turn["role"]), F.lit("\n"))


def _rendered(turn: Column) -> Column:
    return F.concat(_head(turn), _clean(turn["text"]), F.lit(CLOSE + "\n"))


def _common(a: Column, b: Column) -> Column:
    """How many turns the two begin with alike."""
    differs = lambda i: ~(F.get(a, i)["role"].eqNullSafe(F.get(b, i)["role"]) & F.get(a, i)["text"].eqNullSafe(F.get(b, i)["text"]))
    shorter = F.least(F.size(a), F.size(b))
    return F.when(shorter < 1, F.lit(0)).otherwise(F.coalesce(F.get(F.filter(F.sequence(F.lit(0), shorter - 1), differs), F.lit(0)), shorter))


def _completion(turns: Column, skip: Column) -> Column:
    """The text after the first ``skip`` turns, and its trained spans as ``begin:end`` in characters."""

    def spans(rest: Column) -> Column:
        before = F.get(rest, F.lit(0))["begin"]
        span = lambda t: F.concat((t["begin"] - before + F.length(_head(t))).cast("string"), F.lit(":"), (t["begin"] - before + F.length(_rendered(t)) - 1).cast("string"))
        mask = F.array_join(F.transform(F.filter(rest, lambda t: t["role"] == TRAINED), span), ",")
        return F.struct(F.array_join(F.transform(rest, _rendered), "").alias("text"), mask.alias("mask"))

    return let(F.slice(turns, skip + 1, F.greatest(F.size(turns) - skip, F.lit(0))), spans)


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column, id_col: str = "conv_id") -> DataFrame:
    """A row for each pair of conversations: ``pair`` names the pair of a turn's row, ``chosen`` whether it is the chosen side.

    Columns: pair_id, chosen_id, rejected_id, n_common, prompt, chosen, rejected and the masks of the two.
    """
    turn = F.struct("turn", "role", "text")
    rows = turns.filter(F.col(id_col).isNotNull()).select(pair.alias("pair_id"), chosen.alias("side"), F.col(id_col).alias("id"), "turn", "role", "text")
    here = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.repartition("pair_id").withColumn("begin", F.coalesce(F.sum(F.length(_rendered(turn)).cast("long")).over(here), F.lit(0).cast("long")))
    sides = {"chosen": F.col("side"), "rejected": ~F.col("side")}
    placed = F.struct("turn", "role", "text", "begin")
    rows = rows.groupBy("pair_id").agg(*[F.min(F.when(s, F.col("id"))).alias(f"{n}_id") for n, s in sides.items()], *[F.array_sort(F.collect_list(F.when(s, placed))).alias(f"{n}_turns") for n, s in sides.items()])
    rows = rows.withColumn("n_common", _common(F.col("chosen_turns"), F.col("rejected_turns")))
    out = rows.select("*", F.array_join(F.transform(F.slice("chosen_turns", F.lit(1), F.col("n_common")), _rendered), "").alias("prompt"), *[F.when(F.col(f"{n}_id").isNotNull(), _completion(F.col(f"{n}_turns"), F.col("n_common"))).alias(f"{n}_part") for n in sides])
    return out.select("pair_id", "chosen_id", "rejected_id", F.col("n_common").cast("long").alias("n_common"), "prompt", *[F.col(f"{n}_part.text").alias(n) for n in sides], *[F.col(f"{n}_part.mask").alias(f"{n}_mask") for n in sides])


def borrowed_replies(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Turns of pairs that share their history: (pair_id, chosen, id, turn, role, text) with the names ``pair_id`` and ``chosen``.

    Each conversation with an assistant's turn is a pair of its own. Chosen is what leads to its last such turn, with
    that turn; rejected is the same history, answered by the last assistant's turn of the conversation with the next
    number. Where that one is missing or has none, the pair lacks its rejected side. Of several assistant's turns of one
    number the last by text counts.
    """
    own = turns.select(F.col(id_col).alias("id"), "turn", "role", "text").filter("id IS NOT NULL")
    last = own.filter(F.col("role") == TRAINED).groupBy("id").agg(F.max(F.struct("turn", "role", "text")).alias("reply"))
    heads = last.join(last.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("reply").alias("answer")), "id", "left")
    # the history goes twice, the replies once
    both = own.join(heads, "id").select(F.col("id").alias("pair_id"), "turn", "role", "text", F.col("reply.turn").alias("upto"), "id", "other")
    side = lambda chosen, of: F.struct(F.lit(chosen).alias("chosen"), F.col(of).alias("id"))
    sides = F.filter(F.array(F.when(F.col("turn") <= F.col("upto"), side(True, "id")), F.when((F.col("turn") < F.col("upto")) & F.col("other").isNotNull(), side(False, "other"))), lambda x: x.isNotNull())
    history = both.select("pair_id", F.inline(sides), "turn", "role", "text")
    answers = heads.filter("other IS NOT NULL").select(F.col("id").alias("pair_id"), F.lit(False).alias("chosen"), F.col("other").alias("id"), F.col("reply.turn").alias("turn"), "answer.role", "answer.text")
    return history.unionByName(answers)
