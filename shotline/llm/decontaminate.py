"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some word places of a window and ignore the others, so a copy whose words were substituted here and
there still shares a seed with its source. The benchmark's seeds are joined with the seeds at every place of every
document, and around each hit the two word sequences are laid side by side: an overlap counts where ``WINDOW``
consecutive words (the whole item, if shorter) agree in at least ``SHARE`` of their places. Items shorter than a window
have masks of their own, which leave out every choice of places that may differ; those under five words are found as
they stand. Hits come in pieces of ``HITS`` and are first held against the words next to them, whole pieces at once, so a
phrase that many items share costs little where nothing else agrees.

The benchmark goes to the executors in blocks of at most ``BLOCK_WORDS`` words, each a broadcast of bounded size; a
larger benchmark takes more passes over the documents, never a larger broadcast. Documents are scanned whole and never
shuffled, by the filter neither. Words are runs of letters, digits and non-ASCII characters of the lower-cased text.

Defined results: a null or empty text holds nothing; items without words give no evidence, and one of a single word marks every text that has it (``least_words`` leaves such out); equal items count
as the one of the smallest item_id; repeated documents are reported once each; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _ODD, cut, in_chunks, mix, word_hashes

#: Every window of 13 words with at most two substitutions holds one of the spaced masks in full.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
WINDOW, SHARE = 13, 0.8
SEGMENT = 4096  # words of an item that are laid out at once; longer items become overlapping segments
BLOCK_WORDS = 400_000  # words of the benchmark in one broadcast, about 40 MB with their seeds
HITS = 50_000  # that are held against their surroundings at once, about 50 MB
SCAN_COLUMNS = "id long, item_id long, doc_begin long, doc_end long, n_matched long, item_words long"

_PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts], _PARTS, lower=False)


def seeds(hashes: np.ndarray, mask: tuple[int, ...], salt: int) -> np.ndarray:
    """The seed hash that begins at each place, as far as the mask fits."""
    n = max(len(hashes) - mask[-1], 0)
    out = np.full(n, np.uint64(salt + 1))
    for k, at in enumerate(mask):
        out += hashes[at : at + n] * _ODD[24 + k]
    return mix(out)


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Places of an item of ``n`` words, under a window: one choice at least is whole where SHARE of the words are equal.

    With ``m`` words that may differ, two of any ``m + 2`` parts are untouched; of five words, four of the five.
    """
    m = n - ceil(SHARE * n)
    if n == len(MASKS[0]):
        return list(combinations(range(n), n - m))
    parts = np.array_split(np.arange(n), m + 2)
    return [tuple(np.concatenate(two).tolist()) for two in combinations(parts, 2)]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word hashes of items, long ones in overlapping pieces."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for begin, end in in_chunks(texts, lambda t: len(t or "")):
            hashes, first = _words(texts[begin:end])
            rows = []
            for k in range(end - begin):
                own = hashes[first[k] : first[k + 1]]
                for at in range(0, max(len(own) - WINDOW + 1, 1), SEGMENT - WINDOW + 1):
                    if len(own):
                        rows.append((ids[begin + k], len(own), own[at : at + SEGMENT].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["item_id", "item_words", "hashes"]
            )


class Index:
    """The seeds of one block of the benchmark."""

    def __init__(self, rows: list) -> None:
        self.item = [r["item_id"] for r in rows]
        self.item_words = [r["item_words"] for r in rows]
        parts = [np.array(r["hashes"], np.int64).view(np.uint64) for r in rows]
        self.words = np.concatenate(parts)
        self.first = np.cumsum([0] + [len(p) for p in parts])
        self.tables = []
        placed: dict[tuple[int, ...], list] = {mask: [(seeds(p, mask, salt), self.first[k] + np.arange(max(len(p) - mask[-1], 0))) for k, p in enumerate(parts)] for salt, mask in enumerate(MASKS)}
        for k, p in enumerate(parts):
            for places in short_masks(len(p)) if len(p) < WINDOW else ():
                mask = tuple(x - places[0] for x in places)
                if mask not in MASKS:
                    placed.setdefault(mask, []).append((seeds(p[places[0] : places[-1] + 1], mask, len(MASKS)), self.first[k : k + 1] + places[0]))
        for mask, found in placed.items():
            salt = MASKS.index(mask) if mask in MASKS else len(MASKS)
            keys, at = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            bits = max(16, int(np.ceil(np.log2(len(keys) * 16 + 1))))
            filled = np.zeros(1 << bits, bool)
            filled[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
            at = at[order]
            # where the place before holds another seed, or another segment begins
            lead = np.ones(len(at), bool)
            lead[1:] = (keys[1:] != keys[:-1]) | (at[1:] != at[:-1] + 1) | np.isin(at[1:], self.first)
            self.tables.append((mask, salt, keys, at, filled, np.uint64(64 - bits), keys[lead], at[lead]))

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of equal seeds, piece by piece: in ``hashes``, and in the block's words, and whether the hit stands for a run of hits.

        Where a text repeats a seed from one word to the next, hits run along diagonals: a hit behind another one of its
        diagonal tells nothing new and is left out, so repeated words cost as many hits as there are diagonals.
        """
        for mask, salt, keys, at, filled, shift, lead_keys, lead_at in self.tables:
            own = seeds(hashes, mask, salt)
            again = np.zeros(len(own) + 1, bool)
            again[1:-1] = own[1:] == own[:-1]
            again[first[first < len(again)]] = False
            maybe = np.flatnonzero(filled[(own >> shift).astype(np.int64)])
            for places, known, where in ((maybe[~again[maybe]], keys, at), (maybe[again[maybe]], lead_keys, lead_at)):
                low, high = (np.searchsorted(known, own[places], side) for side in ("left", "right"))
                many = high - low
                upto = np.cumsum(many)
                begin = 0
                while begin < len(places):
                    end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + HITS, "right")))
                    n = many[begin:end]
                    p = np.repeat(places[begin:end], n)
                    yield p, where[np.repeat(low[begin:end] - np.cumsum(n) + n, n) + np.arange(n.sum())], again[p] | again[p + 1]
                    begin = end


def _agree(index: Index, hashes: np.ndarray, first: np.ndarray, p: np.ndarray, q: np.ndarray, text: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Whether some window around each hit has enough equal words; places beyond the text or the segment differ."""
    around = np.arange(1 - WINDOW, WINDOW)
    ours, theirs = p[:, None] + around, q[:, None] + around
    same = (ours >= first[text][:, None]) & (ours < first[text + 1][:, None]) & (theirs >= index.first[segment][:, None]) & (theirs < index.first[segment + 1][:, None])
    same &= hashes[np.clip(ours, 0, len(hashes) - 1)] == index.words[np.clip(theirs, 0, len(index.words) - 1)]
    upto = np.concatenate([np.zeros((len(p), 1), np.int8), np.cumsum(same, axis=1, dtype=np.int8)], axis=1)
    window = np.minimum(WINDOW, (index.first[segment + 1] - index.first[segment]))
    out = np.zeros(len(p), bool)
    for w in np.unique(window).tolist():
        own = window == w
        out[own] = ((upto[own, w:] - upto[own, :-w]) >= ceil(SHARE * w)).any(axis=1)
    return out


def overlaps(index: Index, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(text, segment, begin, end, matched, item words) of the best overlap of each text with each segment; of equal ones the last."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    done: set[tuple[int, int, int]] = set()
    for p, q, run in index.hits(hashes, first):
        text, segment = np.searchsorted(first, p, "right") - 1, np.searchsorted(index.first, q, "right") - 1
        near = run.copy()
        near[~run] = _agree(index, hashes, first, p[~run], q[~run], text[~run], segment[~run])
        for t, s, shift in np.unique(np.stack([text, segment, p - q])[:, near], axis=1).T.tolist():
            if (t, s, shift) in done:
                continue
            done.add((t, s, shift))
            begin, end = max(first[t], index.first[s] + shift), min(first[t + 1], index.first[s + 1] + shift)
            window = min(WINDOW, int(index.first[s + 1] - index.first[s]))
            if end - begin < window:
                continue
            same = np.concatenate([[0], np.cumsum(hashes[begin:end] == index.words[begin - shift : end - shift])])
            good = np.flatnonzero(same[window:] - same[:-window] >= ceil(SHARE * window))
            if len(good):
                low, high = int(good[0]), int(good[-1]) + window
                found = (int(same[high] - same[low]), int(begin - first[t]) + low, int(begin - first[t]) + high)
                best[t, s] = max(best.get((t, s), (0, 0, 0)), found)
    return [(t, s, b, e, n, index.item_words[s]) for (t, s), (n, b, e) in sorted(best.items())]


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_words: int, least_words: int) -> list[Broadcast]:
    """The benchmark's indexes, each of at most ``block_words`` words."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    items = items.mapInArrow(_segments, "item_id long, item_words long, hashes array<long>").filter(F.col("item_words") >= least_words)
    items = cut(items.groupBy("hashes", "item_words").agg(F.min("item_id").alias("item_id")))
    words = items.agg(F.sum(F.size("hashes"))).first()[0] or 0
    n_blocks = max(1, ceil(2 * words / block_words))  # blocks by hash: half full on average
    block = F.pmod(F.xxhash64("hashes"), F.lit(n_blocks))
    out = []
    for k in range(n_blocks):
        rows, held = [], 0
        parts = []
        for row in items.filter(block == k).orderBy("item_id", "hashes").toLocalIterator():
            if held + len(row["hashes"]) > block_words and rows:
                parts.append(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row["hashes"])
        out += [spark.sparkContext.broadcast(vars(Index(part))) for part in [*parts, rows] if part]
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS, least_words: int = 1) -> DataFrame:
    """A row for each document row and benchmark item (each segment of a very long one) that overlap.

    Columns: the id, item_id, doc_begin and doc_end (places in the document's words), n_matched (equal words there)
    and item_words. Items under ``least_words`` words are left out.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = None
    for block in _blocks(benchmark, item_col, item_text_col, block_words, least_words):
        found = narrow.mapInArrow(_scan(block), SCAN_COLUMNS)
        out = found if out is None else out.unionAll(found)
    out = out if out is not None else docs.sparkSession.createDataFrame([], SCAN_COLUMNS)
    return out.withColumnRenamed("id", id_col)


def _shared(shared: Broadcast) -> Index:
    index = Index.__new__(Index)
    vars(index).update(shared.value)
    return index


def _scan(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _shared(shared)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, end in in_chunks(texts, lambda t: len(t or "")):
                found = overlaps(index, *_words(texts[begin:end]))
                if found:
                    rows = [(ids[begin + t], index.item[s], b, e, n, w) for t, s, b, e, n, w in found]
                    names = ["id", "item_id", "doc_begin", "doc_end", "n_matched", "item_words"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return run


def _clean(shared: Broadcast, text_at: int):
    """Passes on the rows without an overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _shared(shared)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            clean = np.ones(len(texts), bool)
            for begin, end in in_chunks(texts, lambda t: len(t or "")):
                clean[[begin + t for t, *_ in overlaps(index, *_words(texts[begin:end]))]] = False
            yield batch.filter(pa.array(clean))

    return run


def decontamination_filter(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS, least_words: int = 1) -> DataFrame:
    """The rows of ``docs`` without an overlap, with the columns of ``docs``; each row stands or falls by its own text.

    One block of the benchmark after the other passes on what it leaves, so rows are neither shuffled nor joined.
    """
    for block in _blocks(benchmark, item_col, item_text_col, block_words, least_words):
        docs = docs.mapInArrow(_clean(block, docs.columns.index(text_col)), docs.schema)
    return docs
