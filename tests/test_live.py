"""Streams of growing files, live callbacks, the fold by chunks, pushdown and the frame index."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotline.operators.fold import FAR, cuts_from, fold_chunks, fold_cuts, with_streaks
from shotline.operators.pairs import score_frames
from shotline.options import Options
from shotline.plans import detect, detect_files, detect_scene_changes
from shotline.plans.live import follow_video, told_progress
from shotline.sources import frames_where, read_frames, read_scores, read_videos, stream_frames, stream_scores
from shotline.streaming import stream_cuts
from shotline.streaming.scenes import step

from . import model
from .test_engine import clip, expected, y4m

SCORES = "video_id string, frame_number long, intra_key int, ssad_score int"


def random_scores(n, seed, by=1, rate=260):
    rng = np.random.default_rng(seed)
    return [("v", k * by, None if rng.random() < 0.1 else int(rng.integers(0, 4000)), int(rng.integers(0, rate))) for k in range(1, n + 1)]


def test_least_distance_of_a_cut(spark):
    rows = [("v", 0, k, s) for k in (None, 1990, 2000, 2001, 2015, 2016, 2500, 3214, 3215, 3216, 9000) for s in (0, 90, 91, 93, 94, 95, 150, 205, 206, 207, 400)]
    for base in ((2000, 90), (1000, 50)):
        got = spark.createDataFrame(rows, SCORES).select("*", cuts_from(F.col("intra_key"), F.col("ssad_score"), base).alias("c")).collect()
        for r in got:
            assert r["c"] == next((d for d in range(1, FAR + 1) if step(d, r["intra_key"], r["ssad_score"], base)), FAR + 1), r


@pytest.mark.parametrize(("n", "chunk", "by", "rate"), [(1, 30, 1, 260), (500, 30, 1, 260), (500, 31, 3, 120), (3000, 64, 2, 100), (300, 4096, 1, 260)])
def test_chunks_fold_like_a_video(spark, n, chunk, by, rate):
    rows = random_scores(n, n + chunk, by, rate)
    quiet = [(v, k, s) if not 4 * chunk < k // by < 9 * chunk else (v, k, 0) for v, k, _, s in rows]
    df = spark.createDataFrame([*rows, *[("w", k, None, s) for _, k, s in quiet], (None, by, 9000, 0)], SCORES).withColumn("pts", F.col("frame_number") / 25)
    got = fold_chunks(df, carry=("pts",), skip=by - 1, chunk=chunk).collect()
    assert all(r["pts"] == r["frame_number"] / 25 for r in got) and sorted(map(str, got)) == sorted(map(str, fold_cuts(df, carry=("pts",)).collect()))
    assert sorted(r["frame_number"] for r in got if r["video_id"] == "v") == [k * by for k in model.cuts([(k // by, a, b) for _, k, a, b in rows])]
    with pytest.raises(ValueError, match="steps"):
        fold_chunks(df, chunk=FAR - 1)


def test_a_long_video_is_many_tasks(spark):
    """300,000 scores equal the fold in one row, are computed once, and replay in more than one task."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    ids = spark.range(1, 300_001)
    rows = ids.select(F.lit("v").alias("video_id"), F.col("id").alias("frame_number"), F.pmod(F.xxhash64("id"), F.lit(2100)).cast("int").alias("intra_key"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(95)).cast("int").alias("ssad_score"))
    found = fold_chunks(rows.mapInArrow(count, SCORES))
    got = {r["frame_number"] for r in found.collect()}
    assert seen.value == 300_000 and got == {r["frame_number"] for r in fold_cuts(rows).collect()} and len(got) > 1000
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_streaks_are_consecutive(spark):
    marks = [0, 1, 1, 0, 1, 1, 1, 1, 0, 0, 1]
    df = spark.createDataFrame([("v", k, None, 91 * m) for k, m in enumerate(marks, 1)], SCORES)
    for window in (1, 3, 4):
        want = []
        for k in range(len(marks)):
            near, best, run = marks[max(0, k - window + 1) : k + 1], 0, 0
            for m in near:
                run = run + 1 if m else 0
                best = max(best, run)
            want.append(best)
        assert [r["streak"] for r in with_streaks(df, window).orderBy("frame_number").collect()] == want


@pytest.mark.parametrize("skip", [0, 1, 3])
def test_scores_inside_the_scan(spark, tmp_path, monkeypatch, skip):
    from shotline.sources import scored, video

    y4m(tmp_path / "a.y4m", clip(), "25:1")
    path = str(tmp_path / "a.y4m")
    want = sorted(map(tuple, score_frames(read_frames(spark, path, skipFrames=skip), skip=skip).collect()))
    for split in (1, 3 * 96 * 112 * 2, 1 << 30):
        ranges = video._Ranges({"path": path, "skipframes": str(skip)}, split, halo=True).all()
        options = {"skipframes": str(skip)}
        got = [tuple(r.values()) for part in ranges for batch in scored.scored_range(part, options) for r in batch.to_pylist()]
        assert sorted((v, n, k, s) for v, n, _, k, s in got) == want
    plan = detect_files(spark, path, Options(skip_frames=skip))
    assert plan.orderBy("frame_number").select("frame_number", "timecode").collect() == detect(read_frames(spark, path), options=Options(skip_frames=skip)).orderBy("frame_number").select("frame_number", "timecode").collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan frame_scores" in text and "data#" not in text


def test_filters_choose_what_is_read(spark, tmp_path):
    for name in "ab":
        y4m(tmp_path / f"{name}.y4m", clip(), "25:1")
    chosen = lambda text: frames_where(spark, str(tmp_path), text)
    numbers = lambda text: sorted((r["video_id"][-5], r["frame_number"]) for r in chosen(text).collect())
    one = chosen(f"frame_number = 5 AND video_id = '{tmp_path}/a.y4m'")
    assert [r["frame_number"] for r in one.collect()] == [5] and one.rdd.getNumPartitions() == 1
    assert numbers("frame_number IN (1, 13, 99)") == [("a", 1), ("a", 13), ("b", 1), ("b", 13)]
    assert numbers("frame_number > 3 AND frame_number <= 5") == [("a", 4), ("a", 5), ("b", 4), ("b", 5)]
    assert numbers("frame_number < 1 AND width = 112") == [("a", 0), ("b", 0)] and numbers("frame_number = 99") == [] and numbers("frame_number >= 13 OR pts = 0")[0] == ("a", 0)
    assert numbers(f"video_id = '{tmp_path}/c.y4m'") == [] and numbers("frame_number = -1") == [] and numbers("frame_number >= -5 AND frame_number < 1") == [("a", 0), ("b", 0)]
    assert chosen("frame_number = 5").join(chosen("frame_number = 6").select("video_id"), "video_id").count() == 2


def test_index_reads_headers_of_any_length(spark, tmp_path, monkeypatch):
    from shotline.sources import video

    y4m(tmp_path / "a.y4m", clip(), "25:1")
    whole = (tmp_path / "a.y4m").read_bytes()
    mixed = whole.replace(b"FRAME\n", b"FRAME Ip\n", 1).replace(b"FRAME\n", b"FRAME XCOMMENT=longer\n", 3)
    (tmp_path / "m.y4m").write_bytes(mixed)
    path = str(tmp_path / "m.y4m")
    assert [bytes(r["data"]) for r in read_frames(spark, path, index=True).orderBy("frame_number").collect()] == [p.tobytes() for p in clip()]
    assert [r["frame_number"] for r in read_frames(spark, path, index=True, skipFrames=4).orderBy("frame_number").collect()] == [0, 5, 10]
    assert read_videos(spark, path, index=True).first()["total_frames"] == 14
    parts = video._Ranges({"path": path, "index": "true"}, 3 * 96 * 112 * 2).all()
    assert len(parts) > 3 and all(len(p.luma) == p.last - p.first for p in parts)
    assert sorted(tuple(r)[1:] for r in read_scores(spark, path, index=True).collect()) == sorted(tuple(r)[1:] for r in read_scores(spark, str(tmp_path / "a.y4m")).collect())
    (tmp_path / "bad.y4m").write_bytes(whole.replace(b"FRAME\n", b"FRAMES\n", 1))
    with pytest.raises(Exception, match="no frame header at frame 0"):
        read_frames(spark, str(tmp_path / "bad.y4m"), index=True).collect()


def test_a_growing_file_equals_a_batch(spark, tmp_path):
    """Frames and cuts of a file that grows, over restarts and half frames, are those of the whole file, each once."""
    y4m(tmp_path / "whole.y4m", clip(), "25:1")
    whole = (tmp_path / "whole.y4m").read_bytes()
    path, out = tmp_path / "g.y4m", str(tmp_path)
    for size in (20, len(whole) // 3, len(whole) // 3 + 99, len(whole)):
        path.write_bytes(whole[:size])
        for name, stream in (("cuts", stream_cuts(stream_scores(spark, str(path)))), ("frames", stream_frames(spark, str(path), maxFramesPerTrigger=4))):
            query = stream.writeStream.format("parquet").option("path", f"{out}/{name}").option("checkpointLocation", f"{out}/{name}-at").start()
            query.processAllAvailable()
            query.stop()
    assert sorted(r["frame_number"] for r in spark.read.parquet(f"{out}/cuts").collect()) == model.cuts(expected(clip()))
    assert [bytes(r["data"]) for r in spark.read.parquet(f"{out}/frames").orderBy("frame_number").collect()] == [p.tobytes() for p in clip()]


def test_callbacks_come_while_frames_are_read(spark, tmp_path):
    """A scene and progress are told while the last frame is not yet in the file."""
    y4m(tmp_path / "whole.y4m", clip(), "25:1")
    whole = (tmp_path / "whole.y4m").read_bytes()
    meta = read_videos(spark, str(tmp_path / "whole.y4m")).first()
    path = tmp_path / "g.y4m"
    path.write_bytes(whole[: len(whole) * 2 // 3])
    scenes, moved, short = [], [], []

    def scene(s):
        scenes.append(s)
        short.append(path.stat().st_size < len(whole))
        path.write_bytes(whole)

    found, processed = follow_video(spark, str(path), meta, Options(), scene, moved.append, frames_a_batch=3)
    numbers = [0, *model.cuts(expected(clip()))]
    assert [s["frameNumber"] for s in found] == numbers and [s["frameNumber"] for s in scenes] == numbers[1:] and processed == 14
    assert short[0] and moved[0] == told_progress(0, 14, 1.0) and scenes[0]["timecode"].startswith("00:00:00.")


def test_progress_has_the_time_taken(spark, tmp_path):
    pictures = np.repeat(clip(), 5, axis=0)
    y4m(tmp_path / "a.y4m", pictures, "25:1")
    began, moved = time.perf_counter(), []
    found = detect_scene_changes(spark, str(tmp_path / "a.y4m"), Options(skip_frames=1), on_progress=lambda p: moved.append((p, time.perf_counter() - began)))
    assert [p["current_frame"] for p, _ in moved] == [0, 30, 60] and moved[0][0]["eta"] is None
    for p, elapsed in moved[1:]:
        assert 0 < p["eta"] <= (70 - p["current_frame"]) / (p["current_frame"] / elapsed) and p["total_frames"] == 70
    stats = found["stats"]
    assert stats["framesPerSecond"] * stats["processingTime"] == pytest.approx(35)
    quiet = detect_scene_changes(spark, str(tmp_path / "a.y4m"), Options(skip_frames=1))
    assert quiet["scenes"] == found["scenes"] and quiet["stats"]["framesPerSecond"] * quiet["stats"]["processingTime"] == pytest.approx(35)


def test_an_error_of_a_callback_reaches_the_caller(spark, tmp_path):
    y4m(tmp_path / "a.y4m", clip(), "25:1")

    def scene(_):
        raise KeyError("mine")

    with pytest.raises(KeyError, match="mine"):
        detect_scene_changes(spark, str(tmp_path / "a.y4m"), on_scene=scene)
    assert not spark.streams.active


def test_state_of_waiting_and_idle_videos(spark, tmp_path):
    """Late and replayed scores; an idle video leaves the state, and one with a gap fails the query."""
    rows = random_scores(60, 5)
    for k, part in enumerate((rows[40:], rows[:20], rows[:20], rows[20:40])):
        spark.createDataFrame(part, SCORES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda folder: spark.readStream.schema(SCORES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / folder))
    query = stream_cuts(read("in"), idle_ms=600_000).writeStream.format("memory").queryName("waiting").option("checkpointLocation", str(tmp_path / "ck")).start()
    want, until = model.cuts([r[1:] for r in rows]), time.time() + 60
    while query.isActive and time.time() < until and spark.table("waiting").count() < len(want):
        time.sleep(0.3)
    query.stop()
    assert sorted(r["frame_number"] for r in spark.table("waiting").collect()) == want
    spark.createDataFrame(rows[1:3], SCORES).coalesce(1).write.parquet(str(tmp_path / "gap"))
    query = stream_cuts(read("gap"), idle_ms=1).writeStream.format("memory").queryName("gap").option("checkpointLocation", str(tmp_path / "ck2")).start()
    with pytest.raises(Exception, match="2 scores wait for frame 1"):
        query.awaitTermination(30)
        assert not query.isActive
    query.stop()
