"""Frames of compressed video, by a decoder program that is installed on the executors.

The program gets a file's path and writes Y4M to its standard output; a file is one task, since decoding runs from front
to back, and frames go on in batches of bounded bytes.
"""

from __future__ import annotations

import shlex
import subprocess
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..schema import FRAMES
from .video import SPLIT_BYTES, files_of, y4m_header

DECODER = "ffmpeg -v error -i {path} -an -f yuv4mpegpipe -pix_fmt gray -strict -1 -"


def _rows(stream, path: str, step: int) -> Iterator[pa.RecordBatch]:
    w, h, fps, chroma = y4m_header(stream.readline().rstrip(b"\n"), path)
    numbers: list[int] = []
    data: list[bytes] = []

    def batch() -> pa.RecordBatch:
        n = len(numbers)
        sides = [pa.array([s] * n, pa.int32()) for s in (w, h, w)]
        return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(numbers, pa.int64()), pa.array([k / fps for k in numbers], pa.float64()), *sides, pa.array(data, pa.binary())], FRAMES.names)

    k = 0
    while marker := stream.readline():
        if not marker.startswith(b"FRAME"):
            raise ValueError(f"{path}: no frame header at frame {k} of what the decoder wrote")
        luma = stream.read(w * h)
        if len(luma) < w * h or len(stream.read(chroma)) < chroma:
            break
        if k % step == 0:
            numbers.append(k)
            data.append(luma)
        k += 1
        if len(data) * w * h >= SPLIT_BYTES:
            yield batch()
            numbers, data = [], []
    if data:
        yield batch()


def read_decoded(spark: SparkSession, path: str, decoder: str = DECODER, skip: int = 0) -> DataFrame:
    """Frames, every (skip + 1)-th, of all files that ``path`` names. ``{path}`` in a word of ``decoder`` is the file's path.

    A decoder that fails, or is not there, fails the query with what it wrote to its standard error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names in batches:
            for name in names.column(0).to_pylist():
                with tempfile.TemporaryFile() as told:
                    command = [word.replace("{path}", name) for word in shlex.split(decoder)]
                    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=told, stdin=subprocess.DEVNULL) as p:
                        try:
                            yield from _rows(p.stdout, name, skip + 1)
                            failed = p.wait() != 0
                        except ValueError:
                            failed = p.wait() != 0
                            if not failed:
                                raise
                        finally:
                            p.kill()
                    if failed:
                        told.seek(0)
                        raise ValueError(f"{name}: the decoder failed: {told.read()[-2000:].decode('utf-8', 'replace')}")

    return decoded_files(spark, path).mapInArrow(run, FRAMES)


def decoded_files(spark: SparkSession, path: str) -> DataFrame:
    """(video_id) of the files, each a task of its own; the videos to give ``detect``, so that it decodes once."""
    names = files_of(path)
    return spark.createDataFrame([(n,) for n in names], "video_id string").repartitionByRange(max(1, len(names)), "video_id")
