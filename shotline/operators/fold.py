"""The ordered fold that turns pair scores into cuts: the thresholds depend on how long ago the last cut was.

Both thresholds fall with the distance from the last cut and rest from ``FAR`` steps on. So of a pair's scores only one small number
matters, the least distance at which it cuts (``cuts_from``), most pairs cut at none and drop out at once, and what
a chunk of a video does depends on ``FAR + 1`` distances at its start. ``fold_chunks`` makes of each chunk a table of these, composes the
tables, and replays all chunks, each in a task of its own; ``fold_cuts`` follows a video in one row, whatever its numbers are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import adaptive_intra, adaptive_score

FAR = 30  # steps from the last cut on which thresholds stay as they are
BLOCK = 256  # steps whose cuts are gathered at once, so that lists of cuts are not copied at each cut


def is_cut(intra_key: Column, score: Column, since_cut: Column, base: tuple[int, int] = (2000, 90)) -> Column:
    return F.coalesce(intra_key > adaptive_intra(since_cut, base[0]), F.lit(False)) | (score > adaptive_score(since_cut, base[1]))


def fold_cuts(scores: DataFrame, base: tuple[int, int] = (2000, 90), keys: tuple[str, ...] = ("video_id",), order: str = "frame_number", carry: tuple[str, ...] = ()) -> DataFrame:
    """(keys, frame_number, carry) of every cut. A few numbers a frame are shuffled, once, by video; the fold runs in the JVM.

    ``carry`` names further columns of the scores that a cut keeps.
    """
    step = F.struct(F.col(order).cast("long").alias("at"), F.col("intra_key").cast("int").alias("k"), F.col("ssad_score").cast("int").alias("s"), *carry)
    kind = ", ".join([f"`{order}`: bigint", *[f"`{c}`: {scores.schema[c].dataType.simpleString()}" for c in carry]])
    none = F.array().cast(f"array<struct<{kind}>>")

    def follow(state: Column, x: Column) -> Column:
        cut = is_cut(x["k"], x["s"], state["ic"], base)
        here = F.struct(x["at"].alias(order), *[x[c].alias(c) for c in carry])
        return F.struct(
            F.when(cut, F.lit(1)).otherwise(state["ic"] + 1).alias("ic"),
            F.when(cut, F.concat(state["cuts"], F.array(here))).otherwise(state["cuts"]).alias("cuts"),
        )

    def follow_block(state: Column, at: Column) -> Column:
        found = F.aggregate(F.slice("steps", at, BLOCK), F.struct(state["ic"].alias("ic"), none.alias("cuts")), follow)
        return F.transform(F.array(found), lambda x: F.struct(x["ic"].alias("ic"), F.concat(state["cuts"], F.array(x["cuts"])).alias("cuts")))[0]

    rows = scores.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    start = F.struct(F.lit(1).alias("ic"), F.array().cast(f"array<array<struct<{kind}>>>").alias("cuts"))
    blocks = F.sequence(F.lit(1), F.size("steps"), F.lit(BLOCK))
    return rows.select(*keys, F.inline(F.flatten(F.aggregate(blocks, start, follow_block, lambda s: s["cuts"]))))


def cuts_from(intra_key: Column, score: Column, base: tuple[int, int] = (2000, 90)) -> Column:
    """The least number of steps since the last cut at which a pair is a cut; ``FAR + 1`` where it never is one."""
    over, never = intra_key - base[0], F.lit(FAR + 1)
    by_intra = F.coalesce(*[F.when(over > 15 * (10 - k) ** 2, F.lit(k)) for k in range(1, 11)], never)
    by_score = F.when(score > base[1], F.greatest(F.lit(1), FAR + 1 - F.ceil((score - base[1]) / 4))).otherwise(never)
    return F.least(by_intra, by_score.cast("int"))


def fold_chunks(scores: DataFrame, base: tuple[int, int] = (2000, 90), keys: tuple[str, ...] = ("video_id",), order: str = "frame_number", carry: tuple[str, ...] = (), skip: int = 0, chunk: int = 1 << 12) -> DataFrame:
    """``fold_cuts`` of scores numbered ``skip + 1``, twice that, and so on, with each ``chunk`` of a video in a task of its own.

    A video is one row only for its chunks' tables, 31 small numbers for each chunk that has pairs which may be cuts.
    """
    if chunk < FAR:
        raise ValueError(f"a chunk has at least {FAR} steps")
    place = (F.col(order) / (skip + 1)).cast("long")
    # a key that is never null: both uses of the steps then have one plan, so scores are computed and shuffled once
    key = F.struct(*keys).alias("key")
    kept = scores.select(key, order, *carry, place.alias("at"), cuts_from(F.col("intra_key"), F.col("ssad_score"), base).alias("c")).filter(F.col("c") <= FAR)
    kept = kept.withColumn("chunk", F.coalesce(F.expr(f"at div {chunk}"), F.lit(-1).cast("long")))
    steps = kept.groupBy("key", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "c", F.col(order).alias("__number"), *[F.col(c).alias(f"__{c}") for c in carry]))).alias("steps"))
    begin, end = F.col("chunk") * chunk, (F.col("chunk") + 1) * chunk
    follow = lambda last, x: F.when(x["at"] - last >= x["c"], x["at"]).otherwise(last)
    exits = F.transform(F.sequence(F.lit(0), F.lit(FAR)), lambda e: F.least(F.lit(FAR), end - F.aggregate("steps", begin - e, follow)).cast("int"))
    tables = steps.select("key", "chunk", exits.alias("exits"))

    # the distance at the start of each chunk; a chunk without a row leaves more than FAR steps behind
    def entered(state: Column, x: Column) -> Column:
        distance = F.when(x["chunk"] == state["next"], state["distance"]).otherwise(F.lit(FAR))
        here = F.struct(x["chunk"].alias("chunk"), distance.alias("distance"))
        return F.struct((x["chunk"] + 1).alias("next"), F.get(x["exits"], distance).alias("distance"), F.concat(state["all"], F.array(here)).alias("all"))

    none = F.array().cast("array<struct<chunk: bigint, distance: int>>")
    start = F.struct(F.lit(0).cast("long").alias("next"), F.lit(0).alias("distance"), none.alias("all"))
    rows = tables.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "exits"))).alias("tables"))
    starts = rows.select("key", F.inline(F.aggregate("tables", start, entered, lambda s: s["all"])))

    def replay(state: Column, x: Column) -> Column:
        hit = x["at"] - state["last"] >= x["c"]
        return F.struct(F.when(hit, x["at"]).otherwise(state["last"]).alias("last"), F.when(hit, F.concat(state["cuts"], F.array(x))).otherwise(state["cuts"]).alias("cuts"))

    first = F.struct((begin - F.col("distance")).alias("last"), F.slice("steps", 1, 0).alias("cuts"))
    found = steps.join(starts, ["key", "chunk"]).select("key.*", F.inline(F.aggregate("steps", first, replay, lambda s: s["cuts"])))
    return found.select(*keys, F.col("__number").alias(order), *[F.col(f"__{c}").alias(c) for c in carry])


def passes(base: tuple[int, int] = (2000, 90)) -> Column:
    """Whether a pair passes a base threshold, however far the last cut is."""
    return F.coalesce(F.col("intra_key") > base[0], F.lit(False)) | (F.col("ssad_score") > base[1])


def with_hits(scores: DataFrame, window: int, base: tuple[int, int] = (2000, 90), keys: tuple[str, ...] = ("video_id",), order: str = "frame_number") -> DataFrame:
    """``scores`` with ``hits``: how many of the ``window`` frames that end with each pass a base threshold."""
    return scores.withColumn("hits", F.sum(passes(base).cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - window, 0)))


def with_streaks(scores: DataFrame, window: int, base: tuple[int, int] = (2000, 90), keys: tuple[str, ...] = ("video_id",), order: str = "frame_number") -> DataFrame:
    """``scores`` with ``streak``: the longest run of consecutive frames that pass a base threshold among the ``window`` frames that end with each.

    Runs are islands between frames that don't pass; one that began before the window counts from its first frame in it.
    """
    own = Window.partitionBy(*keys).orderBy(order)
    gap = scores.withColumns({"__pass": passes(base), "__place": F.row_number().over(own)})
    gap = gap.withColumn("__gap", F.max(F.when(~F.col("__pass"), F.col("__place"))).over(own))
    rows = gap.withColumn("__run", F.when(F.col("__pass"), F.col("__place") - F.coalesce("__gap", F.lit(0))).otherwise(0))
    near = F.collect_list(F.struct("__place", "__run")).over(own.rowsBetween(1 - window, 0))
    inside = lambda x: F.least(x["__run"], x["__place"] - (F.col("__place") - window))
    return rows.withColumn("__near", near).withColumn("streak", F.array_max(F.transform("__near", inside))).drop("__pass", "__place", "__gap", "__run", "__near")
