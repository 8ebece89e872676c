"""Scores of frame pairs from files: the kernel runs inside the scan.

A task reads its range of frames and the kept frame before it, so pairs need no shuffle and no frame leaves the task that
reads it: five numbers a pair do. As a stream, the same over files that still grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader
from pyspark.sql.types import StructType

from ..operators.pairs import MOST_SIDE, code_for, scores_of
from .video import FrameStream, Layout, _Range, _Ranges, frames_in, register

SCORES = "video_id string, frame_number long, pts double, intra_key int, ssad_score int"
AT_ONCE = 24_000_000  # pixels that are scored at once
SPLIT_BYTES = 32 << 20


def scored_range(part: _Range, options: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Scores of the frames of a range but its first, which is the halo or a video's first frame."""
    step = int(options.get("skipframes", 0)) + 1
    at = Layout.of(part.path, options | {"index": "false"})
    if at.width > MOST_SIDE or at.height > MOST_SIDE:
        raise ValueError(f"{part.path}: frame dimensions {at.width} x {at.height} are outside 1 to {MOST_SIDE}")
    code = code_for(options.get("searchrange", "medium"), at.width, at.height)
    most = max(2, AT_ONCE // (at.width * at.height) + 1)
    numbers: list[int] = []
    pictures = np.empty((most, at.height, at.width), np.uint8)

    def scored() -> pa.RecordBatch:
        n = len(numbers)
        keys, scores = scores_of(pictures[1:n], pictures[: n - 1], code)
        columns = [pa.array([part.path] * (n - 1), pa.string()), pa.array(numbers[1:], pa.int64()), pa.array([k / at.fps for k in numbers[1:]], pa.float64()), pa.array(keys, pa.int32()), pa.array(scores, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["video_id", "frame_number", "pts", "intra_key", "ssad_score"])

    for number, data in frames_in(part, at, step):
        pictures[len(numbers)] = np.frombuffer(data, np.uint8).reshape(at.height, at.width)
        numbers.append(number)
        if len(numbers) == most:
            yield scored()
            pictures[0], numbers = pictures[most - 1], numbers[-1:]
    if len(numbers) > 1:
        yield scored()


class _ScoreReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[_Range]:
        return _Ranges(self.options, SPLIT_BYTES, halo=True).all()

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        return scored_range(part, self.options) if part.path else iter(())


class _ScoreStream(FrameStream):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options, SPLIT_BYTES, halo=True)

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        return scored_range(part, self.options)


class ScoreSource(DataSource):
    """``format("frame_scores")``: a row for each pair of kept frames; options of ``frames``, and searchRange."""

    @classmethod
    def name(cls) -> str:
        return "frame_scores"

    def schema(self) -> str:
        return SCORES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ScoreReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _ScoreStream({k.lower(): v for k, v in self.options.items()})


def read_scores(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(video_id, frame_number, pts, intra_key, ssad_score) of every kept frame but a video's first."""
    register(spark)
    return spark.read.format("frame_scores").options(**{k: str(v) for k, v in options.items()}).load(path)


def stream_scores(spark: SparkSession, path: str, **options: object) -> DataFrame:
    register(spark)
    return spark.readStream.format("frame_scores").options(**{k: str(v) for k, v in options.items()}).load(path)
