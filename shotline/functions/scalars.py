"""Scalar functions as column expressions: timecodes, rates, geometry, search range, thresholds, progress, text.

Everything stays in generated code; ``register`` gives the names to SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def timecode(seconds: Column) -> Column:
    """HH:MM:SS.mmm with every part rounded down; hours take as many digits as they need."""
    whole = F.floor(seconds)
    parts = [F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600.0)) / 60), F.floor(F.pmod(seconds, F.lit(60.0))), F.floor(F.pmod(seconds, F.lit(1.0)) * 1000)]
    return F.when(whole.isNotNull(), F.format_string("%02d:%02d:%02d.%03d", *parts))


def parse_fps(text: Column) -> Column:
    """``a/b`` as a ratio of integers (0/0 is NaN, a/0 infinite), anything else as a number; null where it is none."""
    parts = F.split(text, "/")
    top, bottom = (F.regexp_extract(F.get(parts, F.lit(k)), r"^\s*([+-]?\d+)", 1).try_cast("double") for k in (0, 1))
    ratio = F.when(bottom != 0, top / F.nullif(bottom, F.lit(0.0))).when(top == 0, F.lit(float("nan"))).otherwise(F.signum(top) * F.lit(float("inf")))
    return F.when(F.size(parts) == 2, ratio).otherwise(F.regexp_extract(text, r"^\s*([+-]?\d*\.?\d+(?:[eE][+-]?\d+)?)", 1).try_cast("double"))


def frame_rate(real: Column, average: Column) -> Column:
    """The first rate given, else 30."""
    return parse_fps(F.coalesce(F.nullif(real, F.lit("")), F.nullif(average, F.lit("")), F.lit("30/1")))


def total_frames(duration: Column, fps: Column) -> Column:
    return F.floor(duration * fps)


def pts(frame_number: Column, fps: Column) -> Column:
    return frame_number.cast("double") / fps


def macroblocks(side: Column) -> Column:
    return F.ceil(side / 16).cast("int")


def mb_param(width: Column, height: Column) -> Column:
    """Geometry of the padded picture: blocks of 16 and an edge of 64 on every side."""
    across, down = macroblocks(width), macroblocks(height)
    fields = {"width": width.cast("int"), "height": height.cast("int"), "mb_width": across, "mb_height": down, "edged_width": across * 16 + 128, "edged_height": down * 16 + 128, "edge_size": F.lit(64)}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def frame_memory(width: Column, height: Column) -> Column:
    """Bytes of the padded picture."""
    return (macroblocks(width) * 16 + 128).cast("long") * (macroblocks(height) * 16 + 128)


def fcode(search_range: Column, width: Column, height: Column) -> Column:
    """Search range code: by name, or for ``auto`` by the number of pixels; unknown names count as medium."""
    pixels = width.cast("long") * height
    auto = F.when(pixels <= 345_600, 3).when(pixels <= 2_073_600, 4).otherwise(5)
    return F.when(search_range == "small", 2).when(search_range == "large", 6).when(search_range == "auto", auto).otherwise(4)


def search_bounds(code: Column, mb_x: Column, mb_y: Column, width: Column, height: Column) -> Column:
    """Inclusive bounds of displacements from block (mb_x, mb_y)."""
    radius = F.pow(F.lit(2), code + 3).cast("int")
    side = lambda at, size: (F.greatest(-radius, -16 * (at + 1)), F.least(radius - 1, size - 16 * at))
    (x0, x1), (y0, y1) = side(mb_x, width), side(mb_y, height)
    return F.struct(x0.cast("int").alias("min_dx"), x1.cast("int").alias("max_dx"), y0.cast("int").alias("min_dy"), y1.cast("int").alias("max_dy"))


def sensitivity_thresholds(level: Column) -> Column:
    pick = lambda low, high, other: F.when(level == "low", low).when(level == "high", high).otherwise(other)
    return F.struct(pick(3000, 1000, 2000).alias("intra_thresh"), pick(150, 50, 90).alias("intra_thresh2"))


def adaptive_intra(since_cut: Column, base: int = 2000) -> Column:
    """Threshold of the intra test: higher just after a cut."""
    return F.lit(base) + F.when((since_cut > 0) & (since_cut < 10), 15 * (10 - since_cut) * (10 - since_cut)).otherwise(0)


def adaptive_score(since_cut: Column, base: int = 90) -> Column:
    """Threshold of the frame score: higher for a while after a cut."""
    return F.lit(base) + F.when((since_cut > 0) & (since_cut < 30), 4 * (30 - since_cut)).otherwise(0)


def processing_time(frames: Column, width: Column, height: Column, fps: float = 60.0) -> Column:
    """Estimated seconds at ``fps`` for full-HD frames."""
    return frames / (F.lit(fps) / (width * height / F.lit(2073600.0)))


def percent(current: Column, total: Column) -> Column:
    """Rounded half up; null where there is no total."""
    return F.floor(100.0 * current / F.nullif(total, F.lit(0)) + 0.5)


def eta(current: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the pace so far; null before the first frame."""
    return F.when((current > 0) & (elapsed > 0), (total - current) / (current / F.when(elapsed > 0, elapsed)))


def duration_text(seconds: Column) -> Column:
    """``1h 2m 3s``, without leading parts that are zero."""
    h, m, s = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600.0)) / 60), F.floor(F.pmod(seconds, F.lit(60.0)))
    text = lambda *p: F.concat_ws(" ", *[F.concat(x.cast("string"), F.lit(u)) for x, u in p])
    return F.when(h > 0, text((h, "h"), (m, "m"), (s, "s"))).when(m > 0, text((m, "m"), (s, "s"))).otherwise(text((s, "s")))


def progress_bar(pct: Column, cells: int = 30) -> Column:
    full = F.floor(pct / 100.0 * cells + 0.5).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(cells) - full), F.lit("]"))


def megabytes(size: Column) -> Column:
    """Two decimals of the exact value, ties to even as C's and DuckDB's printf has them; ``format_string`` rounds ties up."""
    return F.call_function("format_number", size / 1048576.0, F.lit("0.00"))


def js_number(x: Column) -> Column:
    """Shortest decimal text, integers without a point, no exponent between 1e-6 and 1e21."""
    plain = F.regexp_replace(F.format_string("%.22f", x), r"0+$", "")
    short = x.cast("string")
    digits = F.regexp_extract(short, r"^-?([\d.]+)E", 1)
    small = F.concat(F.when(x < 0, "-").otherwise(""), F.lit("0."), F.repeat(F.lit("0"), -F.regexp_extract(short, r"E(-\d+)$", 1).try_cast("int") - 1), F.regexp_replace(F.regexp_replace(digits, r"\.0$", ""), r"\.", ""))
    whole = x == F.floor(x)
    return F.when(whole & (F.abs(x) < 1e15), x.cast("long").cast("string")).when((F.abs(x) < 1e-3) & (F.abs(x) >= 1e-6), small).when(short.contains("E"), plain).otherwise(F.regexp_replace(short, r"\.0$", ""))


# name: parameters, body
SQL_FUNCTIONS = {
    "shot_timecode": ("s DOUBLE", "format_string('%02d:%02d:%02d.%03d', floor(s / 3600), floor(pmod(s, 3600.0D) / 60), floor(pmod(s, 60.0D)), floor(pmod(s, 1.0D) * 1000))"),
    "shot_threshold": ("s INT", "2000 + CASE WHEN s > 0 AND s < 10 THEN 15 * (10 - s) * (10 - s) ELSE 0 END"),
    "shot_score_threshold": ("s INT", "90 + CASE WHEN s > 0 AND s < 30 THEN 4 * (30 - s) ELSE 0 END"),
    "shot_percent": ("at BIGINT, total BIGINT", "floor(100.0D * at / nullif(total, 0) + 0.5D)"),
    "shot_eta": ("at BIGINT, total BIGINT, elapsed DOUBLE", "CASE WHEN at > 0 AND elapsed > 0 THEN (total - at) / (at / elapsed) END"),
    "shot_is_cut": ("intra INT, score INT, s INT", "coalesce(intra > 2000 + CASE WHEN s > 0 AND s < 10 THEN 15 * (10 - s) * (10 - s) ELSE 0 END, false) OR score > 90 + CASE WHEN s > 0 AND s < 30 THEN 4 * (30 - s) ELSE 0 END"),
    "shot_megabytes": ("bytes BIGINT", "format_number(bytes / 1048576.0D, '0.00')"),
}
_RETURNS = {"shot_timecode": "STRING", "shot_threshold": "INT", "shot_score_threshold": "INT", "shot_percent": "BIGINT", "shot_eta": "DOUBLE", "shot_is_cut": "BOOLEAN", "shot_megabytes": "STRING"}


def register(spark: SparkSession) -> None:
    """The scalars under SQL names, as SQL expressions rather than user functions."""
    for name, (parameters, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {_RETURNS[name]} RETURN {body}")
