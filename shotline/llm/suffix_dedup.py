"""Repeated passages, found in the suffix order of shards by external induced sorting.

A byte goes if a string of ``least`` bytes covers it that also starts earlier: in a document before, or earlier in the same
one. Strings are judged on the input, and matches never cross documents.

1. Every string of ``least`` bytes has an anchor: among its stretches of ``CONTEXT`` bytes the one of smallest hash, the leftmost
   of equal ones. Consecutive strings with one anchor make a segment. Equal strings have equal anchors, so a string that
   repeats does so within the segments of one anchor.
2. Anchors that occur once are passed over: one pass counts them, a second makes the segments of the others. Segments that
   equal an earlier one as a whole repeat as a whole; this is an aggregate, combined batch by batch before it is shuffled, so that
   a passage in very many documents is no burden to one task.
3. Different segments of one anchor meet in a shard. Its suffixes are sorted by induction (``induced_sort``), with the prefixes
   they share; neighbours that share ``least`` bytes are one string, of which all starts but the first go.
   An anchor with more than ``CROWD`` different segments is parted into its single strings, which meet by an aggregate.
4. A document's starts become spans, and its text is read once more to give what is left.

Order is by id, then (where ids repeat) by a hash of the text; documents without an id come last. Defined results: null
and empty texts have no bytes and lose none; of rows that repeat id and text the others lose all that they can lose, as
copies do; texts shorter than ``least`` lose nothing; an empty table gives no rows. What is left is bytes, for a span may
begin or end within a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, cut, in_chunks, mix, powers, shared_dir, stored
from .induced_sort import suffix_order

LEAST = 100  # bytes of a string that counts
CONTEXT = 16  # bytes of an anchor
CROWD = 20_000  # different segments of one anchor that a shard takes
SHARD_BYTES = 16 << 20  # of segments in a shard, about
NO_ID = 2**63 - 1
SEGMENTS = "key long, part long, doc long, row long, begin int, n int, at int, others array<struct<doc: long, row: long, begin: int>>"
STARTS = "doc long, row long, begin int, n int"

_back = np.ones(1, np.uint64)


def _inverses(n: int) -> np.ndarray:
    """The first ``n`` powers of the inverse of what ``powers`` multiplies by."""
    global _back
    if len(_back) < n:
        step = np.full(max(n, 64, 2 * len(_back)), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), np.uint64)
        step[0] = 1
        _back = np.multiply.accumulate(step)
    return _back


def _window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.append(x, np.full(blocks * width - len(x), np.iinfo(np.uint64).max, np.uint64)).reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments_of(texts: list[bytes], least: int, context: int = CONTEXT) -> tuple[np.ndarray, ...]:
    """(text, begin, number of strings, place of the anchor, key of the anchor, hash of the segment) of the segments of several texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buf) - least + 1
    if n <= 0:
        return (*[np.empty(0, np.int64)] * 4, *[np.empty(0, np.uint64)] * 2)
    sums = np.append(np.uint64(0), np.cumsum(_BYTE[buf] * powers(len(buf))[: len(buf)], dtype=np.uint64))
    inverse = _inverses(len(buf) + 1)
    places = len(buf) - context + 1
    hashes = mix((sums[context:] - sums[:places]) * inverse[:places])
    low = np.uint64(0xFFFFFFFF)
    anchor = (_window_minima((hashes & ~low) | np.arange(places, dtype=np.uint64), least - context + 1) & low).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)[:n]
    whole = ends[owner] - np.arange(n) >= least
    edge = np.flatnonzero(np.diff(np.where(whole, anchor, -1), prepend=-2))
    edge = edge[whole[edge]] if len(edge) else edge
    stop = np.append(edge[1:], n)
    # a segment ends where its anchor changes or its text's last string begins
    stop = np.minimum(stop, ends[owner[edge]] - least + 1)
    at = anchor[edge]
    own = (sums[stop + least - 1] - sums[edge]) * inverse[edge]
    part = mix(own + mix((at - edge).astype(np.uint64) * np.uint64(1 << 20) + (stop - edge).astype(np.uint64)))
    return owner[edge], edge - (ends - sizes)[owner[edge]], stop - edge, at - edge, hashes[at], part


def _batch_segments(batch: pa.RecordBatch, least: int) -> tuple[np.ndarray, ...]:
    """The segments of a batch (doc, row, text) in order of key, part, document and place: doc, row, begin, n, at, key, part."""
    doc, row = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(2).to_pylist()]
    found = []
    for begin, end in in_chunks(texts, len, 1 << 16):
        owner, *rest = segments_of(texts[begin:end], least)
        found.append((doc[begin + owner], row[begin + owner], *rest))
    doc, row, begin, n, at, key, part = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 7
    by = np.lexsort((begin, row, doc, part, key))
    # rows that repeat are one document
    doc, row, begin, n, at, key, part = (x[by] for x in (doc, row, begin, n, at, key.astype(np.uint64), part.astype(np.uint64)))
    fresh = np.ones(len(by), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (begin[1:] != begin[:-1])
    return tuple(x[fresh] for x in (doc, row, begin, n, at, key, part))


def _counted(least: int):
    """(key, n): how often each anchor occurs in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _batch_segments(batch, least)[5]
            edge = np.flatnonzero(np.diff(key, prepend=~key[:1]))
            yield pa.RecordBatch.from_arrays([pa.array(key[edge].view(np.int64)), pa.array(np.diff(np.append(edge, len(key))), pa.int32())], ["key", "n"])

    return run


def _combined(least: int):
    """The first of each group of equal segments of a batch, with the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row, begin, n, at, key, part = _batch_segments(batch, least)
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
            head = np.flatnonzero(fresh)
            more = np.diff(np.append(head, len(key))) - 1
            others = pa.StructArray.from_arrays([pa.array(doc[~fresh]), pa.array(row[~fresh]), pa.array(begin[~fresh], pa.int32())], ["doc", "row", "begin"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(more)), pa.int32()), others)
            own = [pa.array(key[head].view(np.int64)), pa.array(part[head].view(np.int64)), pa.array(doc[head]), pa.array(row[head]), pa.array(begin[head], pa.int32()), pa.array(n[head], pa.int32()), pa.array(at[head], pa.int32())]
            yield pa.RecordBatch.from_arrays([*own, lists], ["key", "part", "doc", "row", "begin", "n", "at", "others"])

    return run


def _cut_out(least: int):
    """(key, doc, row, begin, n, at, c, held) of the segments asked for of (text, wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                held = (batch.column(0)[k].as_py() or "").encode("utf-8", "surrogatepass")
                for x in batch.column(1)[k].as_py():
                    rows.append((*x.values(), held[x["begin"] : x["begin"] + x["n"] + least - 1]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True) if rows else [()] * 8, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "doc", "row", "begin", "n", "at", "c", "held"])

    return run


def _pieces(key: np.ndarray, n: np.ndarray, at: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first string, number of strings) of the parts of segments that may repeat within the shard.

    Strings whose anchors lie equally far from their starts, by blocks of a tenth of ``least``, all hold the bytes in the
    middle of that block; where these come once in the shard, no string of the block comes twice.
    """
    block = max(1, least // 10)
    width = n + least - 1
    first = np.cumsum(width) - width
    low, high = (at - n + 1) // block, at // block  # blocks of distances from the start to the anchor
    blocks = high - low + 1
    owner = np.repeat(np.arange(len(n)), blocks)
    m = high[owner] - (np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    core = np.empty(len(owner), np.uint64)
    for begin, end in in_chunks(width.tolist(), int, 1 << 16):
        own = slice(*np.searchsorted(owner, (begin, end)))
        part = text[first[begin] : first[end - 1] + width[end - 1]]
        middle = first[owner[own]] - first[begin] + at[owner[own]] - block * m[own]
        sums = np.append(np.uint64(0), np.cumsum(_BYTE[part] * powers(len(part))[: len(part)], dtype=np.uint64))
        hashed = (sums[middle + least - block + 1] - sums[middle]) * _inverses(len(part) + 1)[middle]
        core[own] = mix(hashed + mix(key[owner[own]].astype(np.uint64) + m[own].astype(np.uint64)))
    _, where, count = np.unique(core, return_inverse=True, return_counts=True)
    keep = count[where] > 1
    begin, end = np.maximum(at[owner] - block * m - block + 1, 0), np.minimum(at[owner] - block * m, n[owner] - 1) + 1
    owner, begin, end = owner[keep], begin[keep], end[keep]
    fresh = np.append(True, (owner[1:] != owner[:-1]) | (begin[1:] != end[:-1])) if len(owner) else np.zeros(0, bool)
    head = np.flatnonzero(fresh)
    return owner[head], begin[head], end[np.append(head[1:], len(owner)) - 1] - begin[head] if len(head) else end


def _repeats(least: int, folder: str, resident: int):
    """Of a shard's segments the starts whose string has an earlier start, as runs of consecutive starts."""

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("doc", "ascending"), ("row", "ascending"), ("begin", "ascending")]).combine_chunks()
        doc, row, begin = (shard.column(c).to_numpy() for c in ("doc", "row", "begin"))
        shard = shard.filter(pa.array(np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (begin[1:] != begin[:-1])))).combine_chunks()
        key, doc, row, begin, n, at = (shard.column(c).to_numpy() for c in ("key", "doc", "row", "begin", "n", "at"))
        held = shard.column("held").to_pylist()
        owner, offset, n = _pieces(key, n.astype(np.int64), at.astype(np.int64), np.frombuffer(b"".join(held), np.uint8), least)
        text = np.frombuffer(b"".join([held[k][b : b + m + least - 1] for k, b, m in zip(owner.tolist(), offset.tolist(), n.tolist(), strict=True)]), np.uint8)
        doc, row, begin = doc[owner], row[owner], begin[owner] + offset
        width = n + least - 1
        first = np.cumsum(width) - width
        within = np.arange(len(text)) - np.repeat(first, width)
        start = within < np.repeat(n, width)  # the others are the tails of the last strings
        order, shared = suffix_order(text, least, folder, resident)
        group = np.cumsum(shared < least)
        mine = start[order]
        order, group = order[mine], group[mine]
        least_at = np.full(int(group.max(initial=0)) + 1, len(text), np.int64)
        np.minimum.at(least_at, group, order)
        again = np.zeros(len(text) + 1, bool)
        again[order[order != least_at[group]]] = True
        # segments lie one behind the other, and between two there are tails: a run is of one segment
        edge = np.flatnonzero(np.diff(again, prepend=False))
        at, size = edge[0::2], edge[1::2] - edge[0::2]
        owner = np.searchsorted(first, at, side="right") - 1
        return pa.table({"doc": doc[owner], "row": row[owner], "begin": (begin[owner] + within[at]).astype(np.int32), "n": size.astype(np.int32)})

    return run


def repeated_starts(docs: DataFrame, least: int = LEAST, crowd: int = CROWD, shard_bytes: int = SHARD_BYTES, resident: int = 1 << 22) -> DataFrame:
    """(doc, row, begin, n): ``n`` consecutive strings of ``docs`` (doc, row, text), from ``begin`` on, that also start earlier."""
    spark = docs.sparkSession
    several = docs.mapInArrow(_counted(least), "key long, n int").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")
    found = docs.mapInArrow(_combined(least), SEGMENTS).join(several, "key", "left_semi")
    # batches combine equal segments, so a passage comes once a batch, however many documents hold it
    found = found.withColumn("lo", F.expr("min(struct(doc, row, begin)) OVER (PARTITION BY key, part)"))
    found = stored(found.withColumn("first", F.expr("lo = struct(doc, row, begin)")), "segments", clean=True)
    own, later = F.struct("doc", "row", "begin"), F.filter("others", lambda x: x != F.col("lo"))
    again = found.filter("NOT first OR size(others) > 0").select("n", F.explode(F.when(F.col("first"), later).otherwise(F.concat(F.array(own), later))).alias("x"))
    again = again.select("x.doc", "x.row", "x.begin", "n")

    firsts = found.filter("first").select("key", "doc", "row", "begin", "n", "at")
    counts = firsts.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    wanted = firsts.join(counts, "key").groupBy("doc", "row").agg(F.collect_list(F.struct("key", "doc", "row", "begin", "n", "at", "c")).alias("wanted"))
    wanted = wanted.withColumnsRenamed({"doc": "__doc", "row": "__row"})
    texts = docs.join(wanted, (F.col("doc") == F.col("__doc")) & (F.col("row") == F.col("__row"))).select("text", "wanted")
    held = stored(texts.mapInArrow(_cut_out(least), "key long, doc long, row long, begin int, n int, at int, c long, held binary"), "held", clean=True)
    few = held.filter(F.col("c") <= crowd)
    n_shards = max(1, ceil((few.agg(F.sum(F.length("held"))).first()[0] or 0) / shard_bytes))
    sorted_ = few.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int")).groupBy("shard").applyInArrow(_repeats(least, shared_dir(spark), resident), STARTS)
    many = held.filter(F.col("c") > crowd)
    single = many.select("doc", "row", F.posexplode(F.transform(F.sequence(F.lit(1), "n"), lambda i: F.substring("held", i, F.lit(least)))).alias("i", "string"), "begin")
    single = single.select("doc", "row", (F.col("begin") + F.col("i")).alias("begin"), "string")
    first = single.groupBy("string").agg(F.min(F.struct("doc", "row", "begin")).alias("lo"), F.max(F.struct("doc", "row", "begin")).alias("hi")).filter("lo < hi").select("string", "lo")
    crowded = single.join(first, "string").filter("struct(doc, row, begin) > lo").select("doc", "row", "begin", F.lit(1).alias("n"))
    return again.unionByName(sorted_).unionByName(crowded)


def _left(least: int):
    """The spans that go, and what is left, of each row of (..., text, starts, copy)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            text, starts, copy = (batch.column(names.index(c)) for c in ("__text", "__starts", "__copy"))
            spans, kept, sizes = [], [], []
            for k in range(batch.num_rows):
                held = (text[k].as_py() or "").encode("utf-8", "surrogatepass")
                sizes.append(len(held))
                if copy[k].as_py() > 1 and len(held) >= least:
                    mine = [(0, len(held))]
                elif starts[k].is_valid:
                    x = starts[k].values
                    begin, n = (x.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                    by = np.argsort(begin, kind="stable")
                    begin, end = begin[by], np.maximum.accumulate((begin + n + least - 1)[by])
                    fresh = np.append(True, begin[1:] > end[:-1])
                    at = np.flatnonzero(fresh)
                    mine = list(zip(begin[at].tolist(), end[np.append(at[1:], len(end)) - 1].tolist(), strict=True))
                else:
                    mine = []
                spans.append([{"begin": b, "end": e} for b, e in mine])
                bounds = [0, *[x for span in mine for x in span], len(held)]
                kept.append(b"".join(held[b:e] for b, e in zip(bounds[0::2], bounds[1::2], strict=True)))
            own = [batch.column(k) for k, c in enumerate(names) if c not in ("__text", "__starts", "__copy")]
            more = [pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*own, *more], [*[c for c in names if c not in ("__text", "__starts", "__copy")], "n_bytes", "spans", "kept_bytes"])

    return run


def without_repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, shard_bytes: int = SHARD_BYTES, resident: int = 1 << 22) -> DataFrame:
    """(id, n_bytes, spans, kept_bytes) for every row of ``docs``: the maximal spans of bytes that go, and the bytes that are left."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    repeats = not cut(narrow.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 OR id IS NULL").limit(1)).isEmpty()
    row = F.xxhash64("text") if repeats else F.lit(0).cast("long")
    narrow = narrow.select("id", F.coalesce("id", F.lit(NO_ID)).alias("doc"), row.alias("row"), "text")
    starts = repeated_starts(narrow.select("doc", "row", "text"), least, crowd, shard_bytes, resident)
    starts = stored(starts.groupBy("doc", "row").agg(F.collect_list(F.struct("begin", "n")).alias("__starts")), "starts", clean=True)
    copy = F.expr("row_number() OVER (PARTITION BY doc, row ORDER BY doc)") if repeats else F.lit(1)
    both = narrow.join(starts, ["doc", "row"], "left").select("id", F.col("text").alias("__text"), "__starts", copy.alias("__copy"))
    out = both.mapInArrow(_left(least), "id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept_bytes binary")
    return out.withColumnRenamed("id", id_col)
