"""Readers of uncompressed video as Spark data sources.

A file is split into ranges of frames by offset arithmetic, so one video is read by many tasks and skipped frames are
never read; with ``index`` the offsets come from one pass over the frame headers. Y4M gives its own geometry and rate; raw gray files need ``width``, ``height`` and ``fps``. Only the luma
plane is read. A trailing partial frame is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from fractions import Fraction

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..schema import FRAMES, VIDEOS

SPLIT_BYTES = 32 << 20
HEADER_BYTES = 256  # of a frame's header, at most, with an index
_PLANES = {"mono": Fraction(0), "420": Fraction(1, 2), "420jpeg": Fraction(1, 2), "420mpeg2": Fraction(1, 2), "420paldv": Fraction(1, 2), "422": Fraction(1), "444": Fraction(2)}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _open(path: str):
    store, own = _store(path)
    return store.open_input_file(own)


def files_of(path: str) -> list[str]:
    """The files that ``path`` names: a file, the files of a folder, a pattern in a folder's names, or several parted by commas."""
    store, own = _store(path)
    head = path.removesuffix(own) if path != own else ""
    kind = store.get_file_info(own).type
    folder, _, pattern = own.rpartition("/")
    if kind == fs.FileType.Directory:
        folder, pattern = own.rstrip("/"), "*"
    elif kind == fs.FileType.NotFound and "," in path:
        return [f for p in path.split(",") for f in files_of(p)]
    elif kind != fs.FileType.NotFound or not any(c in pattern for c in "*?["):
        return [path]
    found = store.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
    names = sorted(i.base_name for i in found if i.type == fs.FileType.File and i.base_name[0] not in "._")
    return [f"{head}{folder}/{n}" if folder else n for n in names if fnmatchcase(n, pattern)]


def y4m_header(line: bytes, path: str) -> tuple[int, int, float, int]:
    """Width, height, frames a second, and bytes of a frame after its luma, of a stream header."""
    tags = {t[:1]: t[1:] for t in line.decode("ascii", "replace").split(" ")[1:] if t}
    if not line.startswith(b"YUV4MPEG2") or not {"W", "H"} <= tags.keys():
        raise ValueError(f"{path}: the Y4M header has no size")
    w, h = int(tags["W"]), int(tags["H"])
    a, _, b = tags.get("F", "30:1").partition(":")
    color = tags.get("C", "420")
    if color not in _PLANES:
        raise ValueError(f"{path}: color space {color} is not read")
    chroma = 2 * (-(-w // 2)) * (-(-h // 2)) if color.startswith("420") else 2 * (-(-w // 2)) * h if color == "422" else int(_PLANES[color] * w * h)
    return w, h, int(a) / int(b or 1) if int(a) and int(b or 1) else 30.0, chroma  # unknown as 0:0


@dataclass
class Layout:
    """Where the frames of a file lie: at equal distances, or, with an index, each where its own header ends."""

    width: int
    height: int
    fps: float
    begin: int
    skip: int  # bytes before the luma of each frame
    record: int  # bytes from one frame to the next
    frames: int
    luma: list[int] | None = None  # where each frame's luma begins, with an index

    @classmethod
    def of(cls, path: str, options: dict[str, str]) -> Layout:
        with _open(path) as f:
            size = f.size()
            head = f.read(min(size, 4096))
            if head.startswith(b"YUV4MPEG2"):
                line, whole, rest = head.partition(b"\n")
                if not whole:
                    raise ValueError(f"{path}: the Y4M header is not whole")
                w, h, fps, chroma = y4m_header(line, path)
                if options.get("index", "false").lower() == "true":
                    luma = _luma_offsets(f, path, len(line) + 1, size, w * h + chroma)
                    return cls(w, h, fps, len(line) + 1, 0, w * h + chroma, len(luma), luma)
                # frame headers with parameters are read if all are as long as the first one
                skip = rest.find(b"\n") + 1 if rest.startswith(b"FRAME ") and b"\n" in rest else 6
                record = skip + w * h + chroma
                return cls(w, h, fps, len(line) + 1, skip, record, (size - len(line) - 1) // record)
        if not {"width", "height"} <= options.keys():
            raise ValueError(f"{path}: no video stream that can be read; raw frames need the options width and height")
        w, h = int(options["width"]), int(options["height"])
        if w <= 0 or h <= 0:
            raise ValueError(f"{path}: dimensions {w} x {h}")
        return cls(w, h, float(options.get("fps", 30)), 0, 0, w * h, size // (w * h))


def _luma_offsets(f, path: str, at: int, size: int, payload: int) -> list[int]:
    """Where the luma of each whole frame begins: one pass from header to header, each of any length, that reads nothing else."""
    out = []
    while at < size:
        f.seek(at)
        head = f.read(min(HEADER_BYTES, size - at))
        end = head.find(b"\n")
        if end < 0 and len(head) < HEADER_BYTES:
            break  # a part of a header is a part of a frame
        if end < 0 or head[:5] != b"FRAME" or head[5:6] not in (b"\n", b" "):
            raise ValueError(f"{path}: no frame header at frame {len(out)}, byte {at}")
        if at + end + 1 + payload > size:
            break
        out.append(at + end + 1)
        at += end + 1 + payload
    return out


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    last: int
    luma: list[int] | None = None  # with an index: where the frames from ``first`` on begin


def frames_in(part: _Range, at: Layout, step: int) -> Iterator[tuple[int, bytes]]:
    """(number, luma) of the frames of a range that sampling keeps."""
    with _open(part.path) as f:
        for n in range(part.first + -part.first % step, part.last, step):
            if part.luma is not None:
                f.seek(part.luma[n - part.first])
            else:
                f.seek(at.begin + n * at.record)
                marker = f.read(at.skip)
                if at.skip and not (marker[:6] in (b"FRAME\n", b"FRAME ") and marker.find(b"\n") == at.skip - 1):
                    raise ValueError(f"{part.path}: no frame header of {at.skip} bytes, like the first one, at frame {n}; the option index reads headers of any length")
            yield n, f.read(at.width * at.height)


class _Ranges:
    """The ranges of frames that a read is split into, after what its filters say of file and number."""

    def __init__(self, options: dict[str, str], split: int = SPLIT_BYTES, halo: bool = False) -> None:
        self.options = options
        self.step = int(options.get("skipframes", 0)) + 1
        self.split, self.halo = split, halo
        self.low, self.high = (int(options["frame"]), int(options["frame"])) if "frame" in options else (0, None)
        self.numbers: set[int] | None = None
        self.videos: set[str] | None = None

    def take(self, x: Filter) -> bool:
        """Whether a filter is applied here in full."""
        name = x.attribute if hasattr(x, "attribute") else ()
        if name == ("video_id",) and isinstance(x, (EqualTo, In)):
            values = {x.value} if isinstance(x, EqualTo) else set(x.value)
            self.videos = values if self.videos is None else self.videos & values
            return True
        if name != ("frame_number",):
            return False
        if isinstance(x, (EqualTo, In)):
            values = {x.value} if isinstance(x, EqualTo) else set(x.value)
            self.numbers = values if self.numbers is None else self.numbers & values
        elif isinstance(x, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, x.value + isinstance(x, GreaterThan))
        elif isinstance(x, (LessThan, LessThanOrEqual)):
            top = x.value - isinstance(x, LessThan)
            self.high = top if self.high is None else min(self.high, top)
        else:
            return False
        return True

    def of(self, path: str, at: Layout, low: int = 0, high: int | None = None) -> list[_Range]:
        """Ranges of ``path`` from frame ``low`` to before ``high``. With a halo each also reads the kept frame before its first."""
        low, high = max(low, self.low), min(at.frames if high is None else high, at.frames, at.frames if self.high is None else self.high + 1)
        size = max(self.step, self.split // at.record * self.step)
        bounds = [(k, min(k + size, high)) for k in range(low, high, size)]
        if self.numbers is not None:
            bounds = [(n, n + 1) for n in sorted(self.numbers) if low <= n < high]
        out = []
        for first, last in bounds:
            begin = max(0, first - self.step) if self.halo else first
            out.append(_Range(path, begin, last, at.luma[begin:last] if at.luma is not None else None))
        return out

    def all(self) -> list[_Range]:
        out = []
        for path in files_of(self.options["path"]):
            if self.videos is None or path in self.videos:
                out += self.of(path, Layout.of(path, self.options))
        return out or [_Range("", 0, 0)]


class _FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.ranges = options, _Ranges(options)

    def partitions(self) -> list[_Range]:
        return self.ranges.all()

    def read(self, part: _Range):
        if part.path:
            # with an index the range says where its frames are
            at = Layout.of(part.path, self.options | {"index": "false"})
            for n, data in frames_in(part, at, self.ranges.step):
                yield part.path, n, n / at.fps, at.width, at.height, at.width, data


class _ChosenReader(_FrameReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [x for x in filters if not self.ranges.take(x)]


def growing(options: dict[str, str], before: dict) -> dict[str, int]:
    """Whole frames that each file has now; a file may still be written to, and what is there never gets less."""
    out = {}
    for path in files_of(options["path"]):
        try:
            out[path] = Layout.of(path, options).frames
        except ValueError:
            if path in before:
                raise
            out[path] = 0  # its header is not whole yet
    return {path: max(n, before.get(path, 0)) for path, n in ({p: 0 for p in before} | out).items()}


class FrameStream(DataSourceStreamReader):
    """Frames of growing files. An offset says for each file how many frames have been given.

    ``maxFramesPerTrigger`` bounds a micro-batch; after a restart the first batch takes all that has come meanwhile.
    """

    def __init__(self, options: dict[str, str], split: int = SPLIT_BYTES, halo: bool = False) -> None:
        self.options, self.split, self.halo = options, split, halo
        self.most = int(options.get("maxframespertrigger", 0))
        self.given: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        self.given = {}
        return {}

    def latestOffset(self) -> dict:
        there = growing(self.options, self.given or {})
        if self.most and self.given is not None:
            there = {path: min(n, self.given.get(path, 0) + self.most) for path, n in there.items()}
        self.given = there
        return there

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        ranges, out = _Ranges(self.options, self.split, self.halo), []
        for path, last in end.items():
            first = start.get(path, 0)
            if last > first:
                out += ranges.of(path, Layout.of(path, self.options), first, last)
        return out

    def read(self, part: _Range):
        return _FrameReader(self.options).read(part)

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    """``format("frames")``: a row for each frame, read or as a stream of growing files.

    Options: width, height, fps (raw files), skipFrames, frame, index (Y4M with frame headers of several lengths), and for
    streams maxFramesPerTrigger.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> StructType:
        return FRAMES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FrameReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FrameStream({k.lower(): v for k, v in self.options.items()})


class ChosenFrameSource(FrameSource):
    """``format("frames_where")``: ``frames`` whose filters on frame_number and video_id choose what is read."""

    @classmethod
    def name(cls) -> str:
        return "frames_where"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ChosenReader({k.lower(): v for k, v in self.options.items()})


class _VideoReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[_Range]:
        return [_Range(p, 0, 0) for p in files_of(self.options["path"])] or [_Range("", 0, 0)]

    def read(self, part: _Range):
        if not part.path:
            return
        at = Layout.of(part.path, self.options)
        yield part.path, at.frames, at.frames / at.fps, at.fps, (at.width, at.height)


class VideoSource(DataSource):
    """``spark.read.format("video_meta")``: a row for each file, from its header and size."""

    @classmethod
    def name(cls) -> str:
        return "video_meta"

    def schema(self) -> StructType:
        return VIDEOS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _VideoReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    from .scored import ScoreSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FrameSource, ChosenFrameSource, VideoSource, ScoreSource):
        spark.dataSource.register(source)


def _read(spark: SparkSession, kind: str, path: str, options: dict) -> DataFrame:
    register(spark)
    return spark.read.format(kind).options(**{k: str(v) for k, v in options.items()}).load(path)


def read_frames(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return _read(spark, "frames", path, options)


def frames_where(spark: SparkSession, path: str, condition: str | Column, **options: object) -> DataFrame:
    """The frames that meet ``condition``; its parts on frame_number and video_id (=, IN, <, <=, >, >=) choose the ranges that are read.

    Each call is a relation of its own, for Spark keeps with a relation the ranges that its last filters chose. Give the whole condition
    here: further filters on frame_number or video_id of one result, in several branches or queries, would mix up their ranges.
    """
    return _read(spark, "frames_where", path, options).filter(condition).filter("frame_number >= 0")


def stream_frames(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Frames of files that still grow, each once."""
    register(spark)
    return spark.readStream.format("frames").options(**{k: str(v) for k, v in options.items()}).load(path)


def extract_frame(spark: SparkSession, path: str, number: int, **options: object) -> DataFrame:
    """One frame by its number, read alone; no row where there is none."""
    return _read(spark, "frames", path, options | {"frame": number})


def read_videos(spark: SparkSession, path: str, **options: object) -> DataFrame:
    return _read(spark, "video_meta", path, options)


def read_frame_table(spark: SparkSession, path: str) -> DataFrame:
    """Frames kept as Parquet with the columns of the frame schema."""
    return spark.read.schema(FRAMES).parquet(path)


_PGM = re.compile(rb"\AP5(?:\s+(?:#[^\n]*\n)?)+(\d+)\s+(\d+)\s+(\d+)\s")


def read_pgm(spark: SparkSession, pattern: str, fps: float, video_id: str) -> DataFrame:
    """An image sequence of binary 8-bit PGM files; the last number in a file's name is the frame's."""

    def run(batches):
        for batch in batches:
            number, width, height, data = [], [], [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head, found = _PGM.match(content), re.findall(r"\d+", path.rsplit("/", 1)[-1])
                if not head or int(head[3]) > 255 or not found:
                    raise ValueError(f"{path} is no numbered 8-bit PGM file")
                w, h = int(head[1]), int(head[2])
                number.append(int(found[-1]))
                width.append(w)
                height.append(h)
                data.append(content[head.end() : head.end() + w * h])
            sizes = [pa.array(v, pa.int32()) for v in (width, height, width)]
            yield pa.RecordBatch.from_arrays([pa.array([video_id] * len(number)), pa.array(number, pa.int64()), pa.array([n / fps for n in number]), *sizes, pa.array(data, pa.binary())], FRAMES.names)

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(run, FRAMES).filter(F.col("frame_number") >= 0)
