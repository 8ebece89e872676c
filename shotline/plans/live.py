"""Detection that tells while it runs: scores as a stream of micro-batches, folded with keyed state, told in order by the driver.

The stream reads ``frames_a_batch`` frames at a time, so a scene is told before the frames behind it are read. What
reaches the driver of a batch are its cuts and every thirtieth frame.
"""

from __future__ import annotations

import tempfile
import threading
import time
import uuid
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import timecode
from ..options import Options
from ..sources import stream_scores
from ..streaming.scenes import followed

EVERY = 30  # kept frames from one call of on_progress to the next, by their numbers


def _half_up(part: int, whole: int) -> int:
    return int(Fraction(100 * part, whole) + Fraction(1, 2))


def told_progress(current: int, total: int, elapsed: float) -> dict:
    """Progress at a frame after ``elapsed`` seconds; without an ETA at frame 0, when no rate is known."""
    return {"current_frame": current, "total_frames": total, "percent": _half_up(current, total), "eta": (total - current) / (current / elapsed) if current and elapsed else None}


def _folder(spark: SparkSession) -> str:
    """Where the stream keeps its offsets and state: in the folder that all executors share, in a local session in one of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="shotline-")
    return f"{shared.rstrip('/')}/shotline-live-{uuid.uuid4().hex}"


def follow_video(spark: SparkSession, path: str, meta: Row, options: Options, on_scene: Callable[[dict], None] | None = None, on_progress: Callable[[dict], None] | None = None, began: float | None = None, frames_a_batch: int = 240) -> tuple[list[dict], int]:
    """Scenes of one video, and how many frames were processed. ``meta`` is its row of metadata.

    With smoothing, which looks at scores that are not kept, the scenes are those of ``detect_files``, told at the end.
    """
    from .detect import detect_files

    began = time.perf_counter() if began is None else began
    by, total = options.skip_frames + 1, meta["total_frames"]
    final = (total - 1) // by * by
    scenes = [{"frameNumber": 0, "timestamp": 0.0, "timecode": "00:00:00.000"}]
    smoothed = options.extended and options.smoothing_window > 1
    reached, processed, done, broken = -1, 0, threading.Event(), []

    def tell_progress(upto: int) -> None:
        nonlocal reached
        for number in range(0, upto + 1, by):
            if number > reached and number % EVERY == 0 and on_progress:
                on_progress(told_progress(number, total, time.perf_counter() - began))
        reached = max(reached, upto)

    def tell(batch: DataFrame, _: int) -> None:
        nonlocal processed
        # a batch that is run again tells nothing twice: its rows are at or before the frame that was reached
        rows = batch.select("frame_number", F.col("pts"), "cut", "folded", timecode(F.col("pts")).alias("timecode")).orderBy("frame_number").collect()
        try:
            for r in rows:
                if r["frame_number"] <= reached:
                    continue
                if r["cut"] and not smoothed:
                    scenes.append({"frameNumber": r["frame_number"], "timestamp": r["pts"], "timecode": r["timecode"]})
                    if on_scene:
                        on_scene(scenes[-1])
                tell_progress(r["frame_number"])
                processed = r["folded"] + 1
        except BaseException as e:  # a callback's error ends the run and reaches the caller as it is
            broken.append(e)
            done.set()
            raise
        if reached >= final:
            done.set()

    if total:
        tell_progress(0)
        processed = 1
    if final > 0:
        scores = stream_scores(spark, path, skipFrames=options.skip_frames, searchRange=options.search_range, maxFramesPerTrigger=frames_a_batch)
        rows = followed(scores, options.thresholds(), options.skip_frames, every=EVERY)
        query = rows.writeStream.foreachBatch(tell).outputMode("append").option("checkpointLocation", _folder(spark)).trigger(processingTime="0 seconds").start()
        try:
            while query.isActive and not done.wait(0.05):
                pass
            if not done.is_set():
                query.awaitTermination()
        finally:
            query.stop()
        if broken:
            raise broken[0]
    if smoothed:
        rows = detect_files(spark, path, options).orderBy("frame_number").collect()
        scenes = [{"frameNumber": r["frame_number"], "timestamp": r["timestamp"], "timecode": r["timecode"]} for r in rows]
        for scene in scenes[1:] if on_scene else ():
            on_scene(scene)
    return scenes, processed
