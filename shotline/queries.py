"""Queries over the shared test tables, one or more for each operator, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .motion_sql import motion, pair_numbers
from .operators import pixels
from .operators.buffers import held_at, pool_stats, ring
from .operators.fold import fold_chunks, fold_cuts, with_streaks
from .operators.pairs import code_for, frame_problem, numbers_of_blocks, previous, sample, score_frames, score_pairs
from .plans.detect import progress, scenes_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- scalar functions ----------------------------------------------------------------------------------------------

_TIMECODE = "printf('%02d:%02d:%02d.%03d', CAST(floor({0} / 3600) AS BIGINT), CAST(floor(({0} % 3600.0) / 60) AS BIGINT), CAST(floor({0} % 60.0) AS BIGINT), CAST(floor(({0} % 1.0) * 1000) AS BIGINT))"


@query(f"SELECT event_id, pts, {_TIMECODE.format('pts')} AS timecode FROM (SELECT event_id, CAST(event_id * 37 AS DOUBLE) / CAST(23.976 AS DOUBLE) AS pts FROM events)")
def timecode_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = S.pts(F.col("event_id") * 37, F.lit(23.976))
    return table(spark, sf_dir, "events").select("event_id", at.alias("pts")).withColumn("timecode", S.timecode(F.col("pts")))


@query("""
SELECT p_partkey, rate, CASE WHEN position('/' IN rate) > 0 THEN CAST(split_part(rate, '/', 1) AS DOUBLE) / CAST(split_part(rate, '/', 2) AS DOUBLE) ELSE CAST(rate AS DOUBLE) END AS fps
FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN concat(p_size * 1000, '/1001') WHEN 1 THEN concat(p_size, '/1') WHEN 2 THEN concat(p_size, '.5') ELSE '30/1' END AS rate FROM part)""")
def parse_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    given = F.when(size % 4 == 0, F.concat((size * 1000).cast("string"), F.lit("/1001"))).when(size % 4 == 1, F.concat(size.cast("string"), F.lit("/1"))).when(size % 4 == 2, F.concat(size.cast("string"), F.lit(".5"))).otherwise("")
    rows = table(spark, sf_dir, "part").select("p_partkey", given.alias("given"))
    return rows.select("p_partkey", F.coalesce(F.nullif("given", F.lit("")), F.lit("30/1")).alias("rate"), S.frame_rate(F.col("given"), F.lit("")).alias("fps"))


_SIZES = "(SELECT o_orderkey, CAST(16 + o_orderkey % 4000 AS BIGINT) AS w, CAST(16 + o_custkey % 2500 AS BIGINT) AS h FROM orders)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", (16 + F.col("o_orderkey") % 4000).cast("int").alias("w"), (16 + F.col("o_custkey") % 2500).cast("int").alias("h"))


@query(f"""SELECT o_orderkey, (w + 15) // 16 AS mb_width, (h + 15) // 16 AS mb_height, (w + 15) // 16 * 16 + 128 AS edged_width, (h + 15) // 16 * 16 + 128 AS edged_height,
((w + 15) // 16 * 16 + 128) * ((h + 15) // 16 * 16 + 128) AS bytes FROM {_SIZES}""")
def mb_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sizes(spark, sf_dir).select("*", S.mb_param(F.col("w"), F.col("h")).alias("p"))
    return rows.select("o_orderkey", *[F.col(f"p.{c}") for c in ("mb_width", "mb_height", "edged_width", "edged_height")], S.frame_memory(F.col("w"), F.col("h")).alias("bytes"))


_RANGE = "CASE o_orderkey % 5 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' WHEN 2 THEN 'large' WHEN 3 THEN 'auto' ELSE 'other' END"
_FCODE = f"CASE {_RANGE} WHEN 'small' THEN 2 WHEN 'large' THEN 6 WHEN 'auto' THEN CASE WHEN w * h <= 345600 THEN 3 WHEN w * h <= 2073600 THEN 4 ELSE 5 END ELSE 4 END"


@query(f"SELECT o_orderkey, {_RANGE} AS search_range, {_FCODE} AS fcode FROM {_SIZES}")
def fcode_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.get(F.array(*[F.lit(n) for n in ("small", "medium", "large", "auto", "other")]), (F.col("o_orderkey") % 5).cast("int"))
    rows = _sizes(spark, sf_dir).withColumn("search_range", names)
    return rows.select("o_orderkey", "search_range", S.fcode(F.col("search_range"), F.col("w"), F.col("h")).alias("fcode"))


@query(f"""SELECT o_orderkey, greatest(-r, -16 * (x + 1)) AS min_dx, least(r - 1, w - 16 * x) AS max_dx, greatest(-r, -16 * (y + 1)) AS min_dy, least(r - 1, h - 16 * y) AS max_dy
FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 32 WHEN 1 THEN 128 ELSE 512 END AS r, (w // 16) // 2 AS x, (h // 16) // 3 AS y FROM {_SIZES})""")
def search_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (2 + 2 * (F.col("o_orderkey") % 3)).cast("int")
    x, y = F.expr("cast((w div 16) div 2 as int)"), F.expr("cast((h div 16) div 3 as int)")
    return _sizes(spark, sf_dir).select("o_orderkey", S.search_bounds(code, x, y, F.col("w"), F.col("h")).alias("b")).select("o_orderkey", "b.*")


@query("""SELECT p_partkey, ic, 2000 + CASE WHEN ic > 0 AND ic < 10 THEN 15 * (10 - ic) * (10 - ic) ELSE 0 END AS t1, 90 + CASE WHEN ic > 0 AND ic < 30 THEN 4 * (30 - ic) ELSE 0 END AS t2,
CASE p_size % 4 WHEN 0 THEN 3000 WHEN 2 THEN 1000 ELSE 2000 END AS base1, CASE p_size % 4 WHEN 0 THEN 150 WHEN 2 THEN 50 ELSE 90 END AS base2 FROM (SELECT *, p_partkey % 40 AS ic FROM part)""")
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.get(F.array(*[F.lit(n) for n in ("low", "medium", "high", "custom")]), (F.col("p_size") % 4).cast("int"))
    ic = F.col("p_partkey") % 40
    rows = table(spark, sf_dir, "part").select("p_partkey", ic.alias("ic"), S.adaptive_intra(ic).alias("t1"), S.adaptive_score(ic).alias("t2"), S.sensitivity_thresholds(level).alias("base"))
    return rows.select("p_partkey", "ic", "t1", "t2", F.col("base.intra_thresh").alias("base1"), F.col("base.intra_thresh2").alias("base2"))


@query(f"SELECT o_orderkey, o_orderkey / (CAST(60 AS DOUBLE) / (w * h / CAST(2073600 AS DOUBLE))) AS seconds FROM {_SIZES}")
def estimate_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).select("o_orderkey", S.processing_time(F.col("o_orderkey"), F.col("w"), F.col("h")).alias("seconds"))


@query("""SELECT event_id, CASE WHEN h > 0 THEN concat(h, 'h ', m, 'm ', s, 's') WHEN m > 0 THEN concat(m, 'm ', s, 's') ELSE concat(s, 's') END AS took, concat('[', repeat('█', k), repeat('░', 30 - k), ']') AS bar, printf('%.2f', b / CAST(1048576 AS DOUBLE)) AS mb
FROM (SELECT event_id, event_id * 13 // 3600 AS h, event_id * 13 % 3600 // 60 AS m, event_id * 13 % 60 AS s, CAST(floor((event_id % 101) / CAST(100 AS DOUBLE) * 30 + 0.5) AS BIGINT) AS k, event_id * 12345 AS b FROM events)""")
def console_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", S.duration_text((e * 13).cast("double")).alias("took"), S.progress_bar(e % 101).alias("bar"), S.megabytes(e * 12345).alias("mb"))


# -- frames of events: each user a video, frames by time -----------------------------------------------------------

_LUMA = "(SELECT CAST(user_id AS VARCHAR) AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_number, event_id, CAST(floor(abs(value) * 7) AS BIGINT) % 200 AS luma FROM events)"


def _luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1").cast("long")
    luma = F.floor(F.abs("value") * 7) % 200
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video_id"), number.alias("frame_number"), "event_id", luma.alias("luma"))


_VIDEOS = f"(SELECT video_id, count(*) AS total_frames FROM {_LUMA} GROUP BY video_id)"


@query(f"""SELECT video_id, frame_number AS current_frame, total_frames, CAST(floor(CAST(100 AS DOUBLE) * frame_number / total_frames + 0.5) AS BIGINT) AS percent,
CASE WHEN frame_number > 0 THEN (total_frames - frame_number) / (frame_number / (frame_number / CAST(25 AS DOUBLE))) END AS eta FROM {_LUMA} JOIN {_VIDEOS} USING (video_id) WHERE frame_number % 3 = 0 AND frame_number % 30 = 0""")
def progress_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _luma(spark, sf_dir).withColumn("pts", S.pts(F.col("frame_number"), F.lit(25.0)))
    videos = frames.groupBy("video_id").agg(F.count("*").alias("total_frames"))
    return progress(frames, videos, skip=2).withColumn("percent", F.col("percent").cast("long"))


@query(f"SELECT video_id, frame_number, prev_frame_number, luma - prev_luma AS step FROM (SELECT *, lag(frame_number) OVER w AS prev_frame_number, lag(luma) OVER w AS prev_luma FROM {_LUMA} WHERE frame_number % 3 = 0 WINDOW w AS (PARTITION BY video_id ORDER BY frame_number)) WHERE prev_frame_number IS NOT NULL")
def skip_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sample(_luma(spark, sf_dir), 2).withColumns(previous(("luma", "frame_number"))).filter("prev_frame_number IS NOT NULL")
    return kept.select("video_id", "frame_number", "prev_frame_number", (F.col("luma") - F.col("prev_luma")).alias("step"))


@query(f"SELECT video_id, event_id, luma FROM {_LUMA} WHERE frame_number = 7")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _luma(spark, sf_dir).filter("frame_number = 7").select("video_id", "event_id", "luma")


@query(f"""SELECT video_id, frame_number, luma AS current, lag(luma) OVER w AS previous, lag(luma) OVER w IS NOT NULL AS has_pair, lag(luma, 3) OVER w AS evicted, count(luma) OVER (PARTITION BY video_id ORDER BY frame_number ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS held,
count(luma) OVER (PARTITION BY video_id ORDER BY frame_number ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AS is_full, lag(luma, 2) OVER w AS second FROM {_LUMA} WINDOW w AS (PARTITION BY video_id ORDER BY frame_number)""")
def frame_buffer_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, order = ("video_id",), "frame_number"
    shown = ring("luma", 3, keys, order) | {"second": held_at("luma", 2, 3, keys, order)}
    return _luma(spark, sf_dir).select("video_id", "frame_number", *[c.alias(n) for n, c in shown.items()])


@query("SELECT size, least(count(*), 4) AS buffers, size * least(count(*), 4) AS total_bytes FROM (SELECT CAST(l_quantity AS BIGINT) * 1024 AS size FROM lineitem) GROUP BY size")
def pool_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool_stats(table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("long") * 1024).alias("size")))


@query("""SELECT o_orderkey, CASE WHEN n = 0 THEN 'empty' WHEN w <= 0 OR h <= 0 OR w > 8192 OR h > 8192 THEN 'dimensions' WHEN n < w * h THEN 'short' END AS problem,
NOT (pw = w AND ph = h) AS size_changed FROM (SELECT *, lag(w) OVER o AS pw, lag(h) OVER o AS ph FROM (SELECT o_orderkey, o_custkey, o_orderkey % 9000 AS w, o_custkey % 64 AS h, CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE (o_orderkey % 9000) * 32 END AS n FROM orders) WINDOW o AS (PARTITION BY o_custkey ORDER BY o_orderkey))""")
def validate_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (key % 9000).cast("int").alias("w"), (F.col("o_custkey") % 64).cast("int").alias("h"), F.when(key % 17 == 0, 0).otherwise((key % 9000) * 32).alias("n"))
    rows = rows.withColumns(previous(("w", "h"), ("o_custkey",), "o_orderkey"))
    return rows.select("o_orderkey", frame_problem(F.col("w"), F.col("h"), F.col("n")).alias("problem"), (~((F.col("prev_w") == F.col("w")) & (F.col("prev_h") == F.col("h")))).alias("size_changed"))


# -- pixel kernels on 8 by 8 pictures ------------------------------------------------------------------------------

_PIXEL = "CAST(floor(greatest(0, least(255, (CAST({0} AS DOUBLE) + 0.55) * 220))) AS BIGINT)"
_UNNEST = f"(SELECT vec_id, label, i, {_PIXEL.format('v')} AS px FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v.cast("double") + 0.55) * 220)))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", px).alias("px"))


@query(f"SELECT vec_id, sum(px)::BIGINT AS total, min(px) AS low, max(px) AS high FROM {_UNNEST} GROUP BY vec_id")
def pixel_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).select("vec_id", F.aggregate("px", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_min("px").alias("low"), F.array_max("px").alias("high"))


@query(f"SELECT vec_id, sum(abs(px - m))::BIGINT AS dev FROM (SELECT *, CAST(floor(sum(px) OVER (PARTITION BY vec_id) / 64) AS BIGINT) AS m FROM {_UNNEST}) GROUP BY vec_id")
def block_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).select("vec_id", pixels.dev(F.col("px")).alias("dev"))


@query(f"""SELECT vec_id, sum(d)::BIGINT AS total, sum(d) FILTER (WHERE q = 0)::BIGINT AS upper_left, sum(d) FILTER (WHERE q = 1)::BIGINT AS upper_right, sum(d) FILTER (WHERE q = 2)::BIGINT AS lower_left, sum(d) FILTER (WHERE q = 3)::BIGINT AS lower_right
FROM (SELECT a.vec_id, abs(a.px - b.px) AS d, a.i // 32 * 2 + a.i // 4 % 2 AS q FROM {_UNNEST} a JOIN (SELECT vec_id, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings) l USING (vec_id) JOIN {_UNNEST} b ON b.vec_id = l.p AND b.i = a.i) GROUP BY vec_id""")
def block_sad_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pixels(spark, sf_dir).withColumns(previous(("px",), ("label",), "vec_id")).filter("prev_px IS NOT NULL")
    a, b = F.col("px"), F.col("prev_px")
    names = ("upper_left", "upper_right", "lower_left", "lower_right")
    return rows.select("vec_id", pixels.sad(a, b).alias("total"), *[c.alias(n) for n, c in zip(names, pixels.quarter_sads(a, b, 8), strict=True)])


@query(f"SELECT vec_id, string_agg(px, ',' ORDER BY r, c) AS padded FROM (SELECT r.range AS r, c.range AS c, p.vec_id, p.px FROM range(12) r, range(12) c JOIN {_UNNEST} p ON p.i = greatest(0, least(r.range - 2, 7)) * 8 + greatest(0, least(c.range - 2, 7))) GROUP BY vec_id")
def clamp_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).select("vec_id", F.array_join(F.transform(pixels.clamp_pad(F.col("px"), 8, 8, 2), lambda x: x.cast("string")), ",").alias("padded"))


_TRIPLES = "(SELECT l_orderkey, l_linenumber, l_partkey % 64 - 32 AS a, l_suppkey % 48 - 24 AS b, l_orderkey % 56 - 28 AS c FROM lineitem)"


@query(f"SELECT l_orderkey, l_linenumber, greatest(least(a, b), least(greatest(a, b), c)) AS median, a = b AS second_repeats, c = a OR c = b AS third_repeats FROM {_TRIPLES}")
def median_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 64 - 32).alias("a"), (F.col("l_suppkey") % 48 - 24).alias("b"), (F.col("l_orderkey") % 56 - 28).alias("c"))
    rows = rows.withColumn("again", pixels.repeats(F.array("a", "b", "c")))
    return rows.select("l_orderkey", "l_linenumber", pixels.median(F.col("a"), F.col("b"), F.col("c")).alias("median"), F.get("again", F.lit(1)).alias("second_repeats"), F.get("again", F.lit(2)).alias("third_repeats"))


# -- scores and scenes ---------------------------------------------------------------------------------------------

_BLOCKS = "(SELECT CAST(l_suppkey AS VARCHAR) AS video_id, CAST(l_orderkey // 64 AS BIGINT) AS frame_number, l_partkey * 37 % 4000 AS sad16, CAST(floor(l_extendedprice) AS BIGINT) % 4500 AS dev, l_partkey % 3 - 1 AS vx, l_orderkey % 2 AS vy FROM lineitem)"


@query(f"""SELECT video_id, frame_number, max(CASE WHEN rn = 3 THEN d END)::BIGINT AS intra_key, (sum(CASE WHEN dev < 3000 THEN sad16 ELSE sad16 // 2 END + CASE WHEN vx = 0 AND vy = 0 AND dev > 1000 AND sad16 < 1000 THEN 512 ELSE 0 END) // (sum(greatest(dev, 300)) // 128 + 4 * (10 + 10 * (count(*) // 4))))::BIGINT AS ssad_score
FROM (SELECT *, sad16 - dev AS d, row_number() OVER (PARTITION BY video_id, frame_number ORDER BY sad16 - dev DESC) AS rn FROM {_BLOCKS}) GROUP BY video_id, frame_number""")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    mv = F.struct((F.col("l_partkey") % 3 - 1).alias("x"), (F.col("l_orderkey") % 2).alias("y"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("video_id"), F.expr("l_orderkey div 64").alias("frame_number"), (F.col("l_partkey") * 37 % 4000).alias("sad16"), (F.floor("l_extendedprice") % 4500).alias("dev"), mv.alias("mv"))
    return numbers_of_blocks(rows, 2)


_SCORES = f"(SELECT video_id, frame_number, luma * 29 AS intra_key, luma AS ssad_score FROM {_LUMA} WHERE frame_number > 0)"


def _folded(scores: str) -> str:
    return f"""
WITH RECURSIVE s AS MATERIALIZED (SELECT * FROM {scores}),
f AS (
  SELECT video_id, CAST(0 AS BIGINT) AS frame_number, CAST(1 AS BIGINT) AS ic, false AS cut FROM (SELECT DISTINCT video_id FROM s)
  UNION ALL
  SELECT s.video_id, s.frame_number, CASE WHEN c THEN 1 ELSE ic + 1 END, c FROM (
    SELECT s.video_id, s.frame_number, f.ic, (coalesce(s.intra_key > 2000 + CASE WHEN f.ic < 10 THEN 15 * (10 - f.ic) * (10 - f.ic) ELSE 0 END, false) OR s.ssad_score > 90 + CASE WHEN f.ic < 30 THEN 4 * (30 - f.ic) ELSE 0 END) AS c
    FROM f JOIN s ON s.video_id = f.video_id AND s.frame_number = f.frame_number + 1) s
)"""


@query(f"{_folded(_SCORES)} SELECT video_id, frame_number FROM f WHERE cut")
def scene_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _luma(spark, sf_dir).filter("frame_number > 0").select("video_id", "frame_number", (F.col("luma") * 29).alias("intra_key"), F.col("luma").alias("ssad_score"))
    return fold_cuts(scores)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _luma(spark, sf_dir).filter("frame_number > 0").select("video_id", "frame_number", (F.col("luma") * 29).alias("intra_key"), F.col("luma").alias("ssad_score"))


@query(f"{_folded(_SCORES)} SELECT video_id, frame_number FROM f WHERE cut")
def scene_fold_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold by tables of chunks, 32 steps each, which are composed and replayed."""
    return fold_chunks(_scores(spark, sf_dir), chunk=32)


@query(f"""WITH p AS (SELECT video_id, frame_number, (luma * 29 > 2000 OR luma > 90) AS pass FROM {_LUMA} WHERE frame_number > 0),
r AS (SELECT *, CASE WHEN pass THEN frame_number - coalesce(max(CASE WHEN NOT pass THEN frame_number END) OVER (PARTITION BY video_id ORDER BY frame_number), 0) ELSE 0 END AS run FROM p)
SELECT a.video_id, a.frame_number, max(least(b.run, b.frame_number - a.frame_number + 5))::BIGINT AS streak FROM r a JOIN r b ON a.video_id = b.video_id AND b.frame_number BETWEEN a.frame_number - 4 AND a.frame_number GROUP BY a.video_id, a.frame_number""")
def smoothing_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of passing frames among the five that end with each."""
    return with_streaks(_scores(spark, sf_dir), 5).select("video_id", "frame_number", F.col("streak").cast("long").alias("streak"))


_SCENES = f"(SELECT video_id, frame_number, frame_number / CAST(25 AS DOUBLE) AS timestamp FROM f WHERE cut UNION ALL SELECT video_id, 0, CAST(0 AS DOUBLE) FROM {_VIDEOS})"


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _luma(spark, sf_dir)
    times = frames.select("video_id", "frame_number", S.pts(F.col("frame_number"), F.lit(25.0)).alias("pts"))
    return scenes_of(scene_fold(spark, sf_dir), times, frames.select("video_id").distinct())


@query(f"{_folded(_SCORES)} SELECT video_id, frame_number, timestamp, {_TIMECODE.format('timestamp')} AS timecode, CAST(NULL AS DOUBLE) AS confidence FROM {_SCENES}")
def scenes_with_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scenes(spark, sf_dir)


@query(f"{_folded(_SCORES)} SELECT video_id, frame_number, concat(frame_number, ',', CASE WHEN timestamp = floor(timestamp) THEN CAST(CAST(timestamp AS BIGINT) AS VARCHAR) ELSE CAST(timestamp AS VARCHAR) END, ',', {_TIMECODE.format('timestamp')}) AS line FROM {_SCENES}")
def export_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sinks import csv_rows

    return csv_rows(_scenes(spark, sf_dir))


@query(f"{_folded(_SCORES)} SELECT video_id, concat('# keyframe format v1', chr(10), 'fps 25', chr(10), string_agg(CAST(frame_number AS VARCHAR), chr(10) ORDER BY frame_number), chr(10)) AS text FROM {_SCENES} GROUP BY video_id")
def export_keyframe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = F.array_join(F.transform(F.array_sort(F.collect_list("frame_number")), lambda x: x.cast("string")), "\n")
    return _scenes(spark, sf_dir).groupBy("video_id").agg(F.concat(F.lit("# keyframe format v1\nfps 25\n"), numbers, F.lit("\n")).alias("text"))


_FLAT = f"(SELECT video_id, frame_number, 256 * d AS intra_key, 1024 * d // 89 AS ssad_score FROM (SELECT video_id, frame_number, abs(luma - lag(luma) OVER (PARTITION BY video_id ORDER BY frame_number)) AS d FROM {_LUMA}) WHERE d IS NOT NULL)"


@query(f"{_folded(_FLAT)} SELECT video_id, frame_number, timestamp, {_TIMECODE.format('timestamp')} AS timecode FROM {_SCENES}")
def flat_video_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat 64 by 64 frames through the real kernel; the scores of a step of D are known: 256 D and 1024 D / 89."""
    frames = _luma(spark, sf_dir).select("video_id", "frame_number", S.pts(F.col("frame_number"), F.lit(25.0)).alias("pts"), F.lit(64).alias("width"), F.lit(64).alias("height"), F.lit(64).alias("stride"), F.col("luma").alias("data"))
    scores = score_frames(frames, frame_bytes=64 * 64, chunk_bytes=1 << 20, times=True, picture=lambda luma: F.unhex(F.repeat(_byte(luma), 64 * 64)))
    videos = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("video_id")).distinct()
    return scenes_of(fold_cuts(scores, carry=("pts",)), None, videos).drop("confidence")


def _byte(x: Column) -> Column:
    return F.lpad(F.hex(x), 2, "0")


def texture_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video for each label, its vectors in order; ``data`` are the bytes of their 8 by 8 tiles, of which ``textured`` makes the picture."""
    number = F.expr("row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1").cast("long")
    tiles = _pixels(spark, sf_dir).select("vec_id", "label", F.unhex(F.array_join(F.transform("px", _byte), "")).alias("data"))
    side = [F.lit(160).alias(c) for c in ("width", "height", "stride")]
    return tiles.select(F.col("label").cast("string").alias("video_id"), number.alias("frame_number"), "data").select("video_id", "frame_number", S.pts(F.col("frame_number"), F.lit(25.0)).alias("pts"), *side, "data")


def textured(tiles: Column) -> Column:
    """A picture of 160 by 160 pixels from 8 by 8 bytes: each is a tile of 20 by 20."""
    eight = F.sequence(F.lit(0), F.lit(7))
    row = lambda r: F.array_join(F.transform(eight, lambda c: F.repeat(F.substring(F.hex(tiles), 16 * r + 2 * c + 1, F.lit(2)), 20)), "")
    return F.unhex(F.array_join(F.transform(eight, lambda r: F.repeat(row(r), 20)), ""))


# the pictures' search as a recursive query over groups and displacements, apart from the kernel
_MOTION = motion(_UNNEST, "128")
_TEXTURE_SCENES = "(SELECT video_id, frame_number, frame_number / CAST(25 AS DOUBLE) AS timestamp FROM f WHERE cut UNION ALL SELECT DISTINCT label::VARCHAR, 0, CAST(0 AS DOUBLE) FROM embeddings)"


@query(f"WITH RECURSIVE {_MOTION}, {pair_numbers()} SELECT * FROM scores")
def texture_video_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texture_scores(spark, sf_dir).drop("pts")


def _texture_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_frames(texture_tiles(spark, sf_dir), frame_bytes=160 * 160, chunk_bytes=4 << 20, times=True, picture=textured)


@query(f"{_folded('scores').replace('WITH RECURSIVE', f'WITH RECURSIVE {_MOTION}, {pair_numbers()},', 1)} SELECT video_id, frame_number, timestamp, {_TIMECODE.format('timestamp')} AS timecode, CAST(NULL AS DOUBLE) AS confidence FROM {_TEXTURE_SCENES}")
def texture_video_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    videos = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("video_id")).distinct()
    return scenes_of(fold_cuts(_texture_scores(spark, sf_dir), carry=("pts",)), None, videos)


@query(f"WITH RECURSIVE {_MOTION} SELECT * FROM blocks")
def texture_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block rows of the pairs of every video."""
    pairs = texture_tiles(spark, sf_dir).withColumns(previous(("data",))).filter("prev_data IS NOT NULL")
    rows = score_pairs(pairs, code_for("medium", 160, 160), blocks=True, picture=textured)
    return rows.select("video_id", "frame_number", "mb_x", "mb_y", F.col("mv.x").alias("mv_x"), F.col("mv.y").alias("mv_y"), "sad16", "dev")
