"""Detection end to end: sample, pair, score, fold, seed, and the facts around it."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import eta, percent, timecode
from ..operators.fold import fold_chunks, fold_cuts, with_streaks
from ..operators.pairs import sample, score_frames, validate
from ..options import Options


def scenes_of(cuts: DataFrame, times: DataFrame | None, videos: DataFrame) -> DataFrame:
    """Scenes of every video: frame 0, also where no frame was read, and each cut with the time of its frame.

    ``times``: (video_id, frame_number, pts); None where cuts have a pts of their own.
    """
    seed = videos.select("video_id", F.lit(0).cast("long").alias("frame_number"), F.lit(0.0).alias("timestamp"))
    timed = cuts if times is None else cuts.join(times, ["video_id", "frame_number"])
    found = timed.select("video_id", "frame_number", F.col("pts").alias("timestamp"))
    return seed.unionByName(found).select("*", timecode(F.col("timestamp")).alias("timecode"), F.lit(None).cast("double").alias("confidence"))


def detect(frames: DataFrame, videos: DataFrame | None = None, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Scenes of all videos in ``frames``; order by video_id and frame_number to read them.

    With ``videos`` given, ``frames`` is read once: times go along with the scores. With smoothing, a cut stays if
    ``smoothing_min`` consecutive frames of the ``smoothing_window`` that end with it pass a base threshold.
    """
    videos = videos if videos is not None else frames.select("video_id").distinct()
    scores = score_frames(validate(frames), options.search_range, options.skip_frames, options.chunk_bytes, times=True)
    return scenes_of(cuts_of(scores, options, fold_cuts), None, videos)


def cuts_of(scores: DataFrame, options: Options, fold: Callable[..., DataFrame]) -> DataFrame:
    """(video_id, frame_number, pts) of the cuts among timed scores, by a fold of a video or of its chunks."""
    if not (options.extended and options.smoothing_window > 1):
        return fold(scores, options.thresholds(), carry=("pts",))
    scores = with_streaks(scores, options.smoothing_window, options.thresholds())
    return fold(scores, options.thresholds(), carry=("pts", "streak")).filter(F.col("streak") >= options.smoothing_min)


def detect_files(spark: SparkSession, path: str, options: Options = Options(), measured: Observation | None = None) -> DataFrame:  # noqa: B008
    """Scenes of the uncompressed videos that ``path`` names: pairs are scored inside the scan, and no frame is shuffled.

    ``measured`` gets ``pairs``, the number of pairs scored.
    """
    from ..sources import read_scores, read_videos

    scores = read_scores(spark, path, skipFrames=options.skip_frames, searchRange=options.search_range)
    if measured is not None:
        scores = scores.observe(measured, F.count(F.lit(1)).alias("pairs"))
    return scenes_of(cuts_of(scores, options, partial(fold_chunks, skip=options.skip_frames)), None, read_videos(spark, path))


def progress(frames: DataFrame, videos: DataFrame, every: int = 30, skip: int = 0, elapsed: Column | None = None) -> DataFrame:
    """A row for each kept frame that progress is told of, with the percentage; seconds are ``elapsed``, else those of the video."""
    kept = sample(frames.select("video_id", "frame_number", "pts"), skip).filter(F.col("frame_number") % every == 0)
    rows = kept.join(videos.select("video_id", "total_frames"), "video_id")
    current, total = F.col("frame_number"), F.col("total_frames")
    return rows.select("video_id", current.alias("current_frame"), total, percent(current, total).cast("int").alias("percent"), eta(current, total, F.col("pts") if elapsed is None else elapsed).alias("eta"))


def result(scenes: DataFrame, videos: DataFrame) -> DataFrame:
    """One row a video: its scenes in order and its metadata."""
    scene = F.struct("frame_number", "timestamp", "timecode")
    return scenes.groupBy("video_id").agg(F.array_sort(F.collect_list(scene)).alias("scenes")).join(videos, "video_id")


def detect_scene_changes(spark: SparkSession, path: str, options: Options = Options(), on_scene: Callable[[dict], None] | None = None, on_progress: Callable[[dict], None] | None = None) -> dict:  # noqa: B008
    """Scenes, metadata and timing of one video file, as plain values.

    ``on_scene`` gets each cut, not the first frame, and ``on_progress`` how far the scoring is, both while the video is
    still being read (``plans.live``).
    """
    from ..sources import read_videos
    from .live import follow_video

    began = time.perf_counter()
    meta = read_videos(spark, path).first()
    if on_scene or on_progress:
        scenes, processed = follow_video(spark, path, meta, options, on_scene, on_progress, began)
    else:
        measured = Observation("scored")
        rows = detect_files(spark, path, options, measured).orderBy("frame_number").collect()
        scenes = [{"frameNumber": r["frame_number"], "timestamp": r["timestamp"], "timecode": r["timecode"]} for r in rows]
        processed = measured.get["pairs"] + (meta["total_frames"] > 0)  # the first frame has no pair
    took = time.perf_counter() - began
    return {
        "scenes": scenes,
        "metadata": {"totalFrames": meta["total_frames"], "duration": meta["duration"], "fps": meta["fps"], "resolution": meta["resolution"].asDict()},
        "stats": {"processingTime": took, "framesPerSecond": processed / took if took else 0.0},
    }
