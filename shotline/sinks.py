"""Writers of scene lists with exact bytes. Scenes of one video are few; they are formatted on the driver, in order."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.scalars import js_number

EXTENSIONS = {"json": ".json", "csv": ".csv", "edl": ".edl"}


def number_text(x: float) -> str:
    """Shortest decimal text; whole numbers have no point."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(x)
    if "e-0" in text and abs(x) >= 1e-6:
        text = f"{x:.{16 - int(text[text.index('e') + 1 :])}f}".rstrip("0")
        text = text if float(text) == x else f"{x:.25f}".rstrip("0")
    return text.replace("e-0", "e-")


def csv_text(scenes: list[dict]) -> str:
    return "frame,timestamp,timecode\n" + "".join(f"{s['frameNumber']},{number_text(s['timestamp'])},{s['timecode']}\n" for s in scenes)


def keyframe_text(scenes: list[dict], fps: float) -> str:
    return f"# keyframe format v1\nfps {number_text(fps)}\n" + "".join(f"{s['frameNumber']}\n" for s in scenes)


def timecode_text(scenes: list[dict]) -> str:
    return "".join(f"{s['timecode']}\n" for s in scenes)


def edl_text(scenes: list[dict], fps: float, title: str = "scenes") -> str:
    """CMX 3600 events, one a scene; the last ends where it begins."""
    rate = max(1, round(fps))
    code = lambda n: f"{n // rate // 3600:02d}:{n // rate // 60 % 60:02d}:{n // rate % 60:02d}:{n % rate:02d}"
    out = f"TITLE: {title}\nFCM: NON-DROP FRAME\n\n"
    for k, s in enumerate(scenes):
        a, b = code(s["frameNumber"]), code(scenes[k + 1]["frameNumber"] if k + 1 < len(scenes) else s["frameNumber"])
        out += f"{k + 1:03d}  AX       V     C        {a} {b} {a} {b}\n"
    return out


def _plain(x: object) -> object:
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    return int(x) if isinstance(x, float) and x.is_integer() else x


def format_result(result: dict, kind: str) -> str:
    """The text of a result; an unknown kind is JSON."""
    scenes, fps = result["scenes"], result["metadata"]["fps"]
    if kind == "csv":
        return csv_text(scenes)
    if kind in ("aegisub", "txt"):
        return keyframe_text(scenes, fps)
    if kind in ("timecode", "tc"):
        return timecode_text(scenes)
    if kind == "edl":
        return edl_text(scenes, fps)
    return json.dumps(_plain(result), indent=2, ensure_ascii=False)


def default_output(video: str, kind: str) -> str:
    return Path(video).stem + "_keyframes" + EXTENSIONS.get(kind, ".txt")


def fixed_extension(path: str, kind: str) -> str:
    """An output named .json for another kind gets that kind's extension, at its first ``.json``."""
    if kind == "json" or kind not in ("csv", "aegisub", "txt", "timecode", "tc", "edl") or not path.endswith(".json"):
        return path
    return path.replace(".json", EXTENSIONS.get(kind, ".txt"), 1)


def csv_rows(scenes: DataFrame) -> DataFrame:
    """CSV lines of the scenes of many videos, to be written by Spark."""
    return scenes.select("video_id", "frame_number", F.concat_ws(",", F.col("frame_number").cast("string"), js_number(F.col("timestamp")), "timecode").alias("line"))


def write_csv(scenes: DataFrame, path: str, header: bool = True, delimiter: str = ",") -> None:
    """A folder of CSV files, one partition a video, for lakes of many videos."""
    rows = scenes.select("video_id", F.col("frame_number").alias("frame"), "timestamp", "timecode")
    rows.repartition("video_id").sortWithinPartitions("video_id", "frame").write.partitionBy("video_id").option("header", header).option("sep", delimiter).csv(path)
