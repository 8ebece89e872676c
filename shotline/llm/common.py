"""Helpers shared by the text operators: tokens, bound expressions, and scratch space that executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def n_words(text: Column) -> Column:
    """Number of words as long; 0 for null."""
    return F.size(words(text)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where ``body`` holds lambdas of its own."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session, as in tests, gets a temporary folder; on a cluster it must be set.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shotline-")
        sc.setCheckpointDir(found)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: a cut of the lineage that survives lost executors.

    With ``clean`` the shuffle files of the write go as soon as it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shotline-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    if clean:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A small ``df`` in a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that a loop has left behind.

    Spark drops them once the driver's objects are collected, which a driver at rest does only every half hour.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# -- vectorised tokens for Arrow batches ---------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = np.ones(1, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd multiplier modulo 2**64."""
    global _POW
    if len(_POW) < n:
        out = np.full(max(n, 64, 2 * len(_POW)), np.uint64(0x9E3779B97F4A7C15), np.uint64)
        out[0] = 1
        _POW = np.multiply.accumulate(out)
    return _POW


def word_hashes(texts: list[bytes], separator: np.ndarray = _SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts, in order, and for each text the index of its first word (one more at the end).

    ``separator`` says for each byte value whether it parts words; ``lower`` folds A-Z.
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        buf = _LOWER[buf]
    gap = separator[buf]
    edge = np.flatnonzero(np.diff(gap, prepend=True))  # starts and ends in turn, for the last byte is a gap
    begin, end = edge[0::2], edge[1::2]
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(begin, starts)
    if not len(begin):
        return np.empty(0, np.uint64), first
    size = end - begin
    at = np.flatnonzero(~gap)
    within = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    terms = _BYTE[buf[at]] * powers(int(size.max()) + 1)[within]
    return mix(np.add.reduceat(terms, np.cumsum(size) - size) + size.astype(np.uint64)), first


def in_chunks(rows: list, size: Callable[[object], int], limit: int = 1_000_000):
    """Index ranges of consecutive rows of at most ``limit`` bytes in all, or one row."""
    begin = total = 0
    for k, row in enumerate(rows):
        n = size(row)
        if k > begin and total + n > limit:
            yield begin, k
            begin, total = k, 0
        total += n
    if begin < len(rows):
        yield begin, len(rows)
