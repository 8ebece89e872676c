"""Sampling, validation, pairing and scoring of frames.

Frame bytes are the only heavy column, so they are read once and move at most once, and not at all where they are made from
less (``picture``). ``score_frames`` deals frames to chunks of bounded size and sends a chunk's last frame along with the next chunk: a long
video is many chunks. A task's chunks come in order and are scored as one run of rows, a bounded number at once whatever chunks they are of, and what
leaves the kernel is two integers a frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BLOCKS, PAIR_SCORES
from .kernel import EDGE, analyse, pair_numbers

MOST_SIDE = 8192
SPREAD = 4  # partitions of chunks for each shuffle partition


def sample(frames: DataFrame, skip: int) -> DataFrame:
    """Every (skip + 1)-th frame by its own number; numbers and times stay as they are."""
    return frames.filter(F.col("frame_number") % (skip + 1) == 0) if skip else frames


def frame_problem(width: Column, height: Column, size: Column) -> Column:
    """Why a frame can't be scored, or null."""
    bad_side = (width <= 0) | (height <= 0) | (width > MOST_SIDE) | (height > MOST_SIDE)
    return F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(width.isNull() | height.isNull() | bad_side, "dimensions").when(size < width.cast("long") * height, "short")


def validate(frames: DataFrame) -> DataFrame:
    """``frames`` unchanged; a frame that can't be scored fails the query with its name."""
    problem = frame_problem(F.col("width"), F.col("height"), F.length("data"))
    told = F.concat_ws(" ", F.lit("frame"), F.col("video_id"), F.col("frame_number").cast("string"), problem)
    return frames.withColumn("data", F.when(problem.isNull(), F.col("data")).otherwise(F.raise_error(told).cast("binary")))


def previous(columns: tuple[str, ...], keys: tuple[str, ...] = ("video_id",), order: str = "frame_number", back: int = 1) -> dict[str, Column]:
    """Columns of the frame ``back`` places before in its video."""
    w = Window.partitionBy(*keys).orderBy(order)
    return {f"prev_{c}": F.lag(c, back).over(w) for c in columns}


def pair_frames(frames: DataFrame, skip: int = 0) -> DataFrame:
    """Each kept frame but a video's first, with its predecessor. Sorts frame bytes by video: for small frames and gaps in numbering."""
    kept = sample(frames, skip)
    return kept.withColumns(previous(("data", "width", "height", "frame_number"))).filter("prev_frame_number IS NOT NULL")


def _pictures(data: list[bytes], width: int, height: int, stride: list[int | None]) -> np.ndarray:
    if not (0 < width <= MOST_SIDE and 0 < height <= MOST_SIDE):
        raise ValueError(f"frame dimensions {width} x {height} are outside 1 to {MOST_SIDE}")
    out = np.empty((len(data), height, width), np.uint8)
    for k, (d, s) in enumerate(zip(data, stride, strict=True)):
        s = s or width
        if d is None or len(d) < s * (height - 1) + width:
            raise ValueError("frame data is empty or shorter than its picture")
        raw = np.frombuffer(d, np.uint8)
        out[k] = raw[: s * height].reshape(height, s)[:, :width] if len(d) >= s * height else np.lib.stride_tricks.as_strided(raw, (height, width), (s, 1), writeable=False)
    return out


def _at_once(width: int, height: int, pixels: int = 24_000_000) -> int:
    """Pairs that the kernel takes at once, by the size of the padded picture, which for small ones is most of it."""
    return max(1, pixels // ((max(0, width) + 2 * EDGE) * (max(0, height) + 2 * EDGE)))


def _batches(width: int, height: int, n: int) -> Iterator[tuple[int, int]]:
    step = _at_once(width, height)
    for at in range(0, n, step):
        yield at, min(n, at + step)


def _scored(cur: np.ndarray, prev: np.ndarray, code: int, want_blocks: bool):
    _, h, w = cur.shape
    keys, scores, blocks = [], [], []
    for a, b in _batches(w, h, len(cur)):
        found = analyse(prev[a:b], cur[a:b], code)
        k, s = pair_numbers(found, b - a, w, h)
        keys += k
        scores += s
        if want_blocks:
            found["f"] = found["f"] + a
            blocks.append(found)
    return keys, scores, blocks


def scores_of(cur: np.ndarray, prev: np.ndarray, code: int) -> tuple[list[int | None], list[int]]:
    """intra_key and ssad_score of pairs of (n, h, w) pictures."""
    return _scored(cur, prev, code, False)[:2]


def code_for(search_range: str, width: int, height: int) -> int:
    if search_range == "auto":
        return 3 if width * height <= 345_600 else 4 if width * height <= 2_073_600 else 5
    return {"small": 2, "large": 6}.get(search_range, 4)


def _same_side(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of one width and height, and of no more rows than the kernel takes pairs at once."""
    sides = list(zip(batch["width"].to_pylist(), batch["height"].to_pylist(), strict=True))
    at = 0
    while at < len(sides):
        w, h = sides[at]
        end, most = at + 1, at + _at_once(w or 0, h or 0)
        while end < min(most, len(sides)) and sides[end] == (w, h):
            end += 1
        yield batch.slice(at, end - at)
        at = end


def _score_chunks(search_range: str, step: int, times: bool):
    """Scores of rows that come sorted by video, chunk and number: each row against the one before it, if that is of its chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # video, chunk, number, side and picture of the row before
        for part in (p for batch in batches for p in _same_side(batch)):
            video, chunk, number, halo = (part[c].to_pylist() for c in ("video_id", "chunk", "frame_number", "halo"))
            side = (part["width"][0].as_py(), part["height"][0].as_py())
            before = last[:3] if last else None
            goes_on = []
            for k, (v, c, at) in enumerate(zip(video, chunk, number, strict=True)):
                goes_on.append(before is not None and (v, c) == before[:2])
                if not goes_on[k]:
                    if c and not halo[k]:
                        raise ValueError(f"video {v}: no frame comes just before number {at}; numbers must be without gaps")
                elif at - before[2] != step:
                    raise ValueError(f"video {v}: frame numbers {before[2]} to {at} have gaps or repeat")
                elif k == 0 and last[3] != side:
                    raise ValueError(f"video {v}: a frame and its predecessor differ in size: {sorted((last[3], side))}")
                before = (v, c, at)
            pictures = _pictures(part["data"].to_pylist(), *side, part["stride"].to_pylist())
            pairs = np.flatnonzero(goes_on)
            if len(pairs):
                prev = pictures[pairs - 1]
                if pairs[0] == 0:
                    prev[0] = last[4]
                keys, scores = scores_of(pictures[pairs], prev, code_for(search_range, *side))
                names = ["video_id", "frame_number"] + ["pts"] * times
                told = [part[c].take(pa.array(pairs)) for c in names]
                yield pa.RecordBatch.from_arrays([*told[:2], pa.array(keys, pa.int32()), pa.array(scores, pa.int32()), *told[2:]], [*names[:2], "intra_key", "ssad_score", *names[2:]])
            last = (*before, side, pictures[-1].copy())

    return run


def score_frames(frames: DataFrame, search_range: str = "medium", skip: int = 0, chunk_bytes: int = 64 << 20, frame_bytes: int | None = None, times: bool = False, picture: Callable[[Column], Column] | None = None) -> DataFrame:
    """(video_id, frame_number, intra_key, ssad_score) of every kept frame but a video's first; with ``times`` also its pts.

    Frames of a video are numbered from 0 without gaps. A chunk stays within ``chunk_bytes``, or two frames; the bytes of
    a frame are ``frame_bytes``, else each frame's rows by its stride, so no scan looks for the largest. With ``picture``,
    ``data`` is what a frame's bytes are made from, by this expression, after frames are dealt.
    """
    kept = sample(frames, skip)
    own_bytes = F.lit(frame_bytes) if frame_bytes else F.coalesce("stride", "width").cast("long") * F.col("height")
    size = F.greatest(F.lit(2), F.floor(F.lit(chunk_bytes) / F.greatest(own_bytes, F.lit(1)))).cast("long")
    place = (F.col("frame_number") / (skip + 1)).cast("long")
    own = F.floor(place / size)
    homes = F.when((place + 1) % size == 0, F.array(F.struct(own.alias("chunk"), F.lit(False).alias("halo")), F.struct((own + 1).alias("chunk"), F.lit(True).alias("halo")))).otherwise(F.array(F.struct(own.alias("chunk"), F.lit(False).alias("halo"))))
    pts = [F.col("pts").cast("double").alias("pts")] if times else []
    dealt = kept.select("video_id", F.col("frame_number").cast("long").alias("frame_number"), "width", "height", "stride", "data", *pts, F.inline(homes))
    dealt = dealt.repartition(_parts(frames), "video_id", "chunk").sortWithinPartitions("video_id", "chunk", "frame_number")
    return _unpacked(dealt, picture).mapInArrow(_score_chunks(search_range, skip + 1, times), PAIR_SCORES + ", pts double" * times)


def _parts(frames: DataFrame) -> int:
    """A chunk is seconds of work: more partitions than usual, so that few tasks get several chunks while others have none."""
    spark = frames.sparkSession
    return SPREAD * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _unpacked(frames: DataFrame, picture: Callable[[Column], Column] | None, columns: tuple[str, ...] = ("data",)) -> DataFrame:
    return frames.withColumns({c: picture(F.col(c)) for c in columns}) if picture else frames


def score_pairs(pairs: DataFrame, code: int = 4, blocks: bool = False, picture: Callable[[Column], Column] | None = None) -> DataFrame:
    """Scores, or block rows, of arbitrary pairs with columns video_id, frame_number, width, height, prev_data, data.

    With ``picture``, both data are what bytes are made from, by this expression, after pairs are dealt evenly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pydict()
                groups: dict[tuple[int, int], list[int]] = {}
                for k, wh in enumerate(zip(part["width"], part["height"], strict=True)):
                    groups.setdefault(wh, []).append(k)
                for (w, h), rows in groups.items():
                    prev, cur = (_pictures([part[c][k] for k in rows], w, h, [None] * len(rows)) for c in ("prev_data", "data"))
                    keys, scores, found = _scored(cur, prev, code, blocks)
                    video, number = [part["video_id"][k] for k in rows], [part["frame_number"][k] for k in rows]
                    if not blocks:
                        yield pa.RecordBatch.from_arrays([pa.array(video, pa.string()), pa.array(number, pa.int64()), pa.array(keys, pa.int32()), pa.array(scores, pa.int32())], ["video_id", "frame_number", "intra_key", "ssad_score"])
                        continue
                    for b in found:
                        mv = pa.StructArray.from_arrays([pa.array(b["vx"], pa.int32()), pa.array(b["vy"], pa.int32())], ["x", "y"])
                        names = ["video_id", "frame_number", "mb_x", "mb_y", "mv", "sad16", "dev"]
                        yield pa.RecordBatch.from_arrays([pa.array([video[f] for f in b["f"]], pa.string()), pa.array([number[f] for f in b["f"]], pa.int64()), pa.array(b["x"], pa.int32()), pa.array(b["y"], pa.int32()), mv, pa.array(b["sad"], pa.int32()), pa.array(b["dev"], pa.int32())], names)

    own = pairs.select("video_id", F.col("frame_number").cast("long").alias("frame_number"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "prev_data", "data")
    if picture:
        own = _unpacked(own.repartition(_parts(pairs), "video_id", "frame_number"), picture, ("prev_data", "data"))
    return own.mapInArrow(run, BLOCKS if blocks else PAIR_SCORES)


def numbers_of_blocks(blocks: DataFrame, limit: Column | int, keys: tuple[str, ...] = ("video_id", "frame_number")) -> DataFrame:
    """The two deciding integers from block rows (sad16, dev, mv), by one aggregate."""
    still = (F.col("mv.x") == 0) & (F.col("mv.y") == 0) & (F.col("dev") > 1000) & (F.col("sad16") < 1000)
    part = F.when(F.col("dev") < 3000, F.col("sad16")).otherwise(F.floor(F.col("sad16") / 2)) + F.when(still, 512).otherwise(0)
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    ranked = F.sort_array(F.collect_list(F.col("sad16") - F.col("dev")), asc=False)
    rows = blocks.groupBy(*keys).agg(ranked.alias("ranked"), F.sum(part).alias("s"), F.sum(F.greatest("dev", F.lit(300))).alias("c"), F.count("*").alias("n"))
    detail = F.floor(F.col("c") / 128) + 4 * (10 + 10 * F.floor(F.col("n") / 4))
    return rows.select(*keys, F.get("ranked", limit.cast("int")).alias("intra_key"), F.floor(F.col("s") / detail).alias("ssad_score"))
