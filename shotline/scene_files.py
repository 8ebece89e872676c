"""A sink that writes one file of exact bytes for each video: two phases, so a failed job leaves no file.

Tasks write each video's text under a temporary folder and tell the driver; when all have succeeded the driver moves the
files to their names, and when one fails it removes the folder. A video's scenes come to one task, in order; what it
holds at once is one video's text.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .sinks import default_output, format_result

COLUMNS = "video_id string, frame_number long, timestamp double, timecode string, total_frames long, duration double, fps double, width int, height int"


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # video, and where its text lies


class _SceneWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.kind = options["path"], options.get("kind", "json")
        self.temporary = f"_temporary-{uuid.uuid4().hex}"

    def _folder(self) -> tuple[fs.FileSystem, str]:
        store, own = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return store, own.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> _Written:
        store, folder = self._folder()
        files = []
        for video, rows in groupby(iterator, key=lambda r: r["video_id"]):
            rows = list(rows)
            scenes = [{"frameNumber": r["frame_number"], "timestamp": r["timestamp"], "timecode": r["timecode"]} for r in rows]
            first = rows[0]
            meta = {"totalFrames": first["total_frames"], "duration": first["duration"], "fps": first["fps"], "resolution": {"width": first["width"], "height": first["height"]}}
            at = f"{folder}/{self.temporary}/{uuid.uuid4().hex}"
            store.create_dir(f"{folder}/{self.temporary}", recursive=True)
            with store.open_output_stream(at) as out:
                out.write(format_result({"scenes": scenes, "metadata": meta}, self.kind).encode())
            files.append((video, at))
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        store, folder = self._folder()
        files = sorted(x for m in messages if m for x in m.files)
        names = Counter(default_output(video, self.kind) for video, _ in files)
        for video, at in files:
            name = default_output(video, self.kind)
            if names[name] > 1:  # videos of one name in several folders
                stem, dot, end = name.rpartition(".")
                name = f"{stem}-{zlib.crc32(video.encode()):08x}{dot}{end}"
            store.move(at, f"{folder}/{name}")
        self._clear(store, folder)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*self._folder())

    def _clear(self, store: fs.FileSystem, folder: str) -> None:
        if store.get_file_info(f"{folder}/{self.temporary}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.temporary}")


class SceneFiles(DataSource):
    """``write.format("scene_files")``: options path and kind (a format of ``sinks.format_result``)."""

    @classmethod
    def name(cls) -> str:
        return "scene_files"

    def schema(self) -> str:
        return COLUMNS

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _SceneWriter({k.lower(): v for k, v in self.options.items()})


def write_scene_files(scenes: DataFrame, videos: DataFrame, path: str, kind: str = "json") -> None:
    """A file for each video of ``scenes`` (video_id, frame_number, timestamp, timecode) under ``path``, which is left as it is if a task fails."""
    scenes.sparkSession.dataSource.register(SceneFiles)
    meta = videos.select("video_id", "total_frames", "duration", "fps", "resolution.width", "resolution.height")
    rows = scenes.select("video_id", "frame_number", "timestamp", "timecode").join(meta, "video_id").select("video_id", "frame_number", "timestamp", "timecode", "total_frames", "duration", "fps", "width", "height")
    rows = rows.repartition(F.col("video_id")).sortWithinPartitions("video_id", "frame_number")
    rows.write.format("scene_files").mode("append").option("kind", kind).save(path)
