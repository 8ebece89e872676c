"""One file of exact bytes a video; a failed task leaves none."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shotline import sinks
from shotline.scene_files import write_scene_files

SCENES = "video_id string, frame_number long, timestamp double, timecode string"
VIDEOS = "video_id string, total_frames long, duration double, fps double, resolution struct<width: int, height: int>"


def tables(spark, n=12):
    names = [f"/a/v{k}.y4m" for k in range(n)] + ["/b/v0.y4m"]
    scenes = [(v, 25 * j, j + k / 8, f"00:00:0{j}.000") for k, v in enumerate(names) for j in range(1 + k % 4)]
    videos = [(v, 100, 4.0, 25.0, (64, 48)) for v in names]
    return names, scenes, spark.createDataFrame(scenes[::-1], SCENES).repartition(5), spark.createDataFrame(videos, VIDEOS)


@pytest.mark.parametrize("kind", ["csv", "aegisub", "tc", "edl", "json"])
def test_bytes_of_many_videos(spark, tmp_path, kind):
    names, rows, scenes, videos = tables(spark)
    write_scene_files(scenes, videos, str(tmp_path / "out"), kind)
    texts = sorted(p.read_text() for p in (tmp_path / "out").iterdir())
    meta = {"totalFrames": 100, "duration": 4.0, "fps": 25.0, "resolution": {"width": 64, "height": 48}}
    want = [sinks.format_result({"scenes": [{"frameNumber": n, "timestamp": t, "timecode": c} for v, n, t, c in rows if v == name], "metadata": meta}, kind) for name in names]
    assert texts == sorted(want)
    files = {p.name for p in (tmp_path / "out").iterdir()}
    assert Path(sinks.default_output("/a/v5.y4m", kind)).name in files and sum(f.startswith("v0_keyframes-") for f in files) == 2
    if kind == "json":
        assert json.loads(texts[0])["metadata"]["totalFrames"] == 100


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    _, _, scenes, videos = tables(spark)
    bad = scenes.withColumn("timestamp", F.when(F.col("video_id") == "/a/v7.y4m", F.raise_error("broken").cast("double")).otherwise(F.col("timestamp")))
    with pytest.raises(Exception, match="broken"):
        write_scene_files(bad, videos, str(tmp_path / "out"), "csv")
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
    write_scene_files(scenes.limit(0), videos, str(tmp_path / "none"), "csv")
    assert not (tmp_path / "none").exists() or not list((tmp_path / "none").iterdir())
