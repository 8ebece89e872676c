"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the number of times the mix should take it. Of all rates between 0 and ``MOST`` whose words
meet every source's target, those nearest to one copy each in relative entropy are exponentials of the document's
size, held at ``MOST``: ``rate = min(MOST, exp(tilt * size / mean size))`` with one tilt a source, the dual variable of
its token constraint. The dual is convex; damped Newton steps solve it, each step one aggregate over the counts of
documents by source and size. Rates are then rounded into whole copies so that the words taken follow the rates: sizes
of a source are walked in order and the part of a copy that one size is owed is carried to the next.

Everything stays in DataFrames: sources, tilts and counts are tables, and a source of any share is pre-aggregated
before it is moved.

Defined results: a null source is a source of its own, last in order; null and blank texts have size 0, are taken once
and add nothing; rows that repeat another are documents like any other; without words every target is 0; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, n_words, stored

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
TOLERANCE, STEPS = 1e-9, 100
BLOCK_ROWS = 1000  # documents of one source and size that are ranked in one group
HOT_GROUPS = 256  # at most so many groups of one source and size are broadcast


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(skey, source_size, documents, target) from (skey, source, words, documents) with one row a source.

    Sources in order of code points, null last, take ``weights`` in turn and split ``share`` of all words; a target
    stops at ``most`` times its source, and what is over goes to the others by weight until none is above. That is the
    level L with ``sum(min(L * weight, cap))`` equal to the total, the largest that any cut of the sources by cap to
    weight gives. One row a source comes together here, never documents.
    """
    place = F.expr("row_number() OVER (ORDER BY source ASC NULLS LAST)")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights)).cast("int"))
    ranked = sizes.select("*", weight.alias("weight"), (F.lit(float(most)) * F.col("words")).alias("cap"), (F.lit(float(share)) * F.expr("sum(words) OVER ()")).alias("total"))
    order = "ORDER BY cap / weight, skey ROWS BETWEEN"
    under = F.expr(f"coalesce(sum(cap) OVER ({order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    rest = F.expr(f"sum(weight) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING)")
    levels = ranked.withColumn("level", (F.col("total") - under) / rest).withColumn("level", F.expr("max(level) OVER ()"))
    return levels.select("skey", F.col("words").alias("source_size"), "documents", F.least(F.col("level") * F.col("weight"), F.col("cap")).alias("target"))


def tilts(counts: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """(skey, tilt, full, none) of every source: Newton steps on the dual, kept inside a bracket that halves where a step leaves it.

    ``counts``: (skey, size, n). A source at its cap is ``full`` (every rate ``most``), one without words or target is
    ``none`` (rates 1 and 0, for it has nothing to meet); neither needs a tilt.
    """
    start = F.when(F.col("target") > 0, F.log(F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    state = goals.select(
        "skey", "target", (F.col("source_size") / F.col("documents")).alias("mean"),
        (F.col("target") >= F.col("source_size") * (most * (1 - 1e-12))).alias("full"),
        start.alias("tilt"), F.lit(-700.0).alias("lo"), F.lit(700.0).alias("hi"),
    )
    state = cut(state.withColumn("done", F.col("full") | (F.col("target") <= 0)))
    for _ in range(STEPS):
        if state.filter(~F.col("done")).isEmpty():
            break
        x = F.col("size") / F.col("mean")
        raw = F.exp(F.least(F.col("tilt") * x, F.lit(700.0)))
        words = F.col("n") * F.col("size")
        sums = (
            counts.join(state.filter(~F.col("done")), "skey")
            .groupBy("skey")
            .agg(F.sum(words * F.least(raw, F.lit(float(most)))).alias("got"), F.sum(F.when(raw < most, words * raw * x).otherwise(F.lit(0.0))).alias("slope"))
        )
        off = F.col("got") - F.col("target")
        lo, hi = F.when(off < 0, F.col("tilt")).otherwise(F.col("lo")), F.when(off > 0, F.col("tilt")).otherwise(F.col("hi"))
        step = F.col("tilt") - off / F.when(F.col("slope") > 0, F.col("slope"))
        met = F.abs(off) <= TOLERANCE * F.col("target")
        moved = state.join(sums, "skey", "left").select("skey", "target", "mean", "full", "tilt", "done", lo.alias("lo"), hi.alias("hi"), step.alias("step"), F.coalesce(met, F.lit(False)).alias("met"))
        inside = (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
        tilt = F.when(F.col("done") | F.col("met"), F.col("tilt")).when(inside, F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = cut(moved.select("skey", "target", "mean", "full", tilt.alias("tilt"), "lo", "hi", (F.col("done") | F.col("met")).alias("done")))
    return state


def _row(*names: str) -> Column:
    """A hash of the columns that tells null from other values in each place."""
    return F.xxhash64(*[c for n in names for c in (F.col(n).isNull(), F.col(n))])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, copies, taken, rate, row) for every row of ``docs``; ``row`` hashes its id, source and text.

    The choice of who gets a further copy goes by a hash of the id, so that reruns agree.
    """
    skey = F.coalesce(F.concat(F.lit("s"), source_col), F.lit("n"))
    narrow = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), skey.alias("skey"), n_words(F.col(text_col)).alias("size"), _row(id_col, source_col, text_col).alias("row")), "words")
    counts = cut(narrow.groupBy("skey", "size").agg(F.count("*").alias("n"), F.min("source").alias("source")))
    goals = cut(targets(counts.groupBy("skey").agg(F.min("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("documents")), weights, share, most))
    state = tilts(counts.select("skey", "size", "n"), goals, most)

    raw = F.when(F.col("full"), F.lit(float(most))).when(F.col("size") == 0, F.lit(1.0)).when(F.col("target") <= 0, F.lit(0.0)).otherwise(F.least(F.exp(F.col("tilt") * F.col("size") / F.col("mean")), F.lit(float(most))))
    rates = counts.join(state, "skey").select("skey", "size", "n", F.round(raw, 7).alias("rate"))
    owed = F.expr("sum(n * (rate - floor(rate))) OVER (PARTITION BY skey ORDER BY size)")
    rates = rates.withColumn("owed", F.floor(owed + 0.5)).withColumn("extra", F.col("owed") - F.expr("coalesce(lag(owed) OVER (PARTITION BY skey ORDER BY size), 0)"))
    # What is still off then is near the size of some document: one copy more or less of that size meets it.
    copies = F.col("n") * F.floor("rate") + F.col("extra")
    rates = rates.join(goals.select("skey", "source_size", "target"), "skey").withColumn("copies", copies)
    rates = rates.withColumn("off", F.col("target") - F.expr("sum(copies * size) OVER (PARTITION BY skey)"))
    room = F.when(F.col("off") > 0, (F.col("rate") < most) & (F.col("extra") < F.col("n"))).otherwise(F.col("extra") > 0)
    rates = rates.withColumn("gap", F.when(room, F.abs(F.abs("off") - F.col("size")))).withColumn("best", F.expr("min(CASE WHEN gap IS NOT NULL THEN struct(gap, size) END) OVER (PARTITION BY skey)"))
    fix = (F.col("best.gap") < F.abs("off")) & (F.col("best.size") == F.col("size")) & (F.col("size") > 0)
    rates = rates.withColumn("extra", F.col("extra") + F.when(fix, F.signum("off")).otherwise(F.lit(0.0)).cast("long"))
    rates = cut(rates.select("skey", "size", "source_size", "target", "n", "rate", "extra", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks")))

    # In a group of one block `extra` documents get a copy more; a larger group deals its share to blocks, each rounded by a hash.
    # Groups with over 1 / HOT_GROUPS of all documents, hence fewer than HOT_GROUPS of them, are dealt by block from the start.
    luck = F.xxhash64("id", F.lit("mix"))
    block = F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = (F.col("blocks") > 1) & (F.col("n") > total / HOT_GROUPS)
    hot = cut(rates.filter(large).select("skey", "size", "blocks"))
    salted = narrow.drop("source").join(F.broadcast(hot), ["skey", "size"], "left").withColumn("salt", F.coalesce(block, F.lit(0).cast("long"))).drop("blocks")
    dealt = rates.withColumn("salt", F.explode(F.when(large, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.lit(0).cast("long")))))
    rows = salted.join(dealt, ["skey", "size", "salt"]).withColumn("block", block).withColumn("luck", luck)
    here = "(PARTITION BY skey, size, salt, block"
    rows = rows.select("*", F.expr(f"row_number() OVER {here} ORDER BY luck, id, row)").alias("place"), F.expr(f"count(*) OVER {here})").alias("together"))
    chance = F.pmod(F.xxhash64("skey", "size", "block"), F.lit(1 << 20)) / float(1 << 20)
    quota = F.when(F.col("blocks") == 1, F.col("extra")).otherwise(F.floor(F.col("together") * F.col("extra") / F.col("n") + chance))
    copies = (F.floor("rate") + (F.col("place") <= quota).cast("long")).cast("long")
    return rows.withColumn("copies", copies).select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "rate", "row")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options: object) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``.

    Rows that agree in id, source and text share their copies as evenly as whole copies allow.
    """
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    taken = taken.groupBy(F.col("row").alias("__row")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")).filter("__copies > 0")
    taken = stored(taken, "copies")
    own = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("__doc")
    rows = docs.select(own, _row(id_col, source_col, text_col).alias("__row"))
    each = lambda of, copies: of.select("__doc", F.explode(F.sequence(F.lit(1), copies))).select("__doc.*")
    even = rows.join(taken.filter("__copies % __rows = 0"), "__row")
    out = each(even, (F.col("__copies") / F.col("__rows")).cast("int"))
    uneven = taken.filter("__copies % __rows <> 0")
    if uneven.isEmpty():
        return out
    # rows that are equal in every column are counted first, so that one that repeats very often is no burden to one task
    alike = rows.join(uneven, "__row").withColumn("__full", F.xxhash64(F.to_json("__doc")))
    alike = alike.groupBy("__row", "__full", "__copies", "__rows").agg(F.count("*").alias("n"), F.first("__doc").alias("__doc"))
    upto = F.expr("sum(n) OVER (PARTITION BY __row ORDER BY __full)")
    share = lambda k: F.floor(F.col("__copies") * k / F.col("__rows"))
    alike = alike.withColumn("upto", upto).withColumn("due", (share(F.col("upto")) - share(F.col("upto") - F.col("n"))).cast("int")).filter("due > 0")
    return out.unionByName(each(alike, F.col("due")))
