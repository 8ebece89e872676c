"""Ranked lexical search over a clustered index whose documents are put in order by recursive graph bisection.

Queries are a stated set of items, taken in blocks of ``BLOCK_CHARS`` characters. For each block:

1. One pass over the whole texts counts every term for the statistics, and keeps of each document the terms that some
   item holds (no other can change a score), with their counts. Texts are not shuffled.
2. Recursive graph bisection brings documents with the same terms together. The upper levels are fitted on a sample of at
   most ``SAMPLE`` documents: each cut leaves term weights, and every document walks down the tree by them. A part of the
   tree is dealt to blocks of about ``PART`` documents, by a hash where the part is larger, and each block is bisected further
   on all its documents, swapping those that gain most, down to clusters of at most ``CLUSTER``.
3. The index has a row a cluster: its postings, and for each term the most it can add to a score there. The sum of these
   over an item's terms is the cluster's bound.
4. Each item visits the ``FIRST`` clusters of highest bound, which gives a score that its last rank can't fall below.
   Then, in one pass, tasks visit by descending bound the others that may still reach that score, and stop exactly:
   a cluster is left out only if its bound is below the ``k``-th score found. Equal scores are ranked by ``doc_id``.

Defined results: null and blank texts have no term; an item without terms, or whose terms no document holds, gives no row;
rows that repeat an item or a document count each on its own; a document without an id is ranked behind equal scores;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_chunks, stored, word_hashes

BLOCK_CHARS = 1 << 18  # of items that are searched for together
SAMPLE = 8192  # documents that the tree is fitted on, at most
MOST_WEIGHTS = 1 << 23  # of the tree, in all
PART, CLUSTER = 4096, 256  # documents that one task bisects at once; of a cluster, at most
FIRST = 4  # clusters that an item visits at first
ROUNDS = 10  # of swaps in a cut, at most

_GAP = np.ones(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _GAP[_low:_high] = False

VECTORS = "doc_id long, n long, terms array<int>, tfs array<int>"
CLUSTERS = "cluster long, doc_ids array<long>, m array<long>, sizes array<int>, terms array<int>, tfs array<int>, bound_terms array<int>, bounds array<long>"


def term_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the terms of several texts, and the index of each text's first term (one more at the end)."""
    return word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts], _GAP)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, kind))


def _vectors(vocabulary: Broadcast):
    """(doc_id, n, terms, tfs) of each (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        bits = 20
        maybe = np.zeros(1 << bits, bool)
        maybe[(known >> np.uint64(64 - bits)).astype(np.int64)] = True
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in in_chunks(texts, lambda t: len(t or "")):
                hashes, first = term_hashes(texts[begin:end])
                at = np.flatnonzero(maybe[(hashes >> np.uint64(64 - bits)).astype(np.int64)])
                term = np.minimum(np.searchsorted(known, hashes[at]), max(len(known) - 1, 0))
                hit = known[term] == hashes[at] if len(known) else np.zeros(0, bool)
                doc = np.searchsorted(first, at[hit], side="right") - 1
                keys, tfs = np.unique(doc * len(known) + term[hit], return_counts=True)
                sizes = np.bincount(keys // max(len(known), 1), minlength=end - begin)
                columns = [pa.array(np.diff(first), pa.int64()), _lists(keys % max(len(known), 1), sizes, pa.int32()), _lists(tfs, sizes, pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), *columns], ["doc_id", "n", "terms", "tfs"])

    return run


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of the task hold each term."""
    held: np.ndarray = np.zeros(0, np.int64)
    for batch in batches:
        more = np.bincount(batch.column(0).flatten().to_numpy())
        held, more = (held, more) if len(held) >= len(more) else (more, held)
        held[: len(more)] += more
    at = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], ["term", "df"])


# -- recursive graph bisection -------------------------------------------------------------------------------------


def _degrees(cell: np.ndarray, doc: np.ndarray, term: np.ndarray, cells: int, n_terms: int) -> np.ndarray:
    """(cells, terms): documents of each cell that hold each term."""
    return np.bincount(cell[doc] * n_terms + term, minlength=cells * n_terms).reshape(cells, n_terms).astype(np.float64)


def bisected(sizes: np.ndarray, terms: np.ndarray, levels: int) -> np.ndarray:
    """The order of documents after so many levels of bisection; document ``k`` holds ``sizes[k]`` of ``terms``.

    All nodes of a level are cut at once. A cut starts from the order at hand; then documents of both halves that gain most
    by changing sides are swapped in pairs, as long as a pair gains.
    """
    n = len(sizes)
    names, term = np.unique(terms, return_inverse=True)
    doc = np.repeat(np.arange(n), sizes)
    order = np.arange(n)
    for level in range(levels):
        edges = np.arange((2 << level) + 1) * n // (2 << level)  # of the halves of all nodes
        cell = np.empty(n, np.int64)
        cell[order] = np.repeat(np.arange(2 << level), np.diff(edges))
        count = np.diff(edges).astype(np.float64)[:, None]
        for _ in range(ROUNDS):
            deg = _degrees(cell, doc, term, 2 << level, len(names))
            other = deg.reshape(-1, 2, len(names))[:, ::-1].reshape(deg.shape)
            n_other = count.reshape(-1, 2, 1)[:, ::-1].reshape(count.shape)
            cost = lambda d, size: d * np.log2(np.maximum(size, 1) / (np.maximum(d, 0) + 1))
            gain = cost(deg, count) + cost(other, n_other) - cost(deg - 1, count) - cost(other + 1, n_other)
            own = np.bincount(doc, gain[cell[doc], term], minlength=n)
            ranked = np.lexsort((-own, cell))
            at = cell[ranked]
            partner = np.arange(n) - edges[at] + edges[np.minimum(at + 1, len(edges) - 1)]
            # the halves of a node may differ by one document, which then has no partner
            paired = (at % 2 == 0) & (partner < edges[np.minimum(at + 2, len(edges) - 1)])
            a, b = ranked[paired], ranked[partner[paired]]
            swap = own[a] + own[b] > 1e-9
            if not swap.any():
                break
            a, b = a[swap], b[swap]
            cell[a], cell[b] = cell[b], cell[a]
        order = np.lexsort((np.argsort(order), cell))
    return order


def _tree(sizes: np.ndarray, terms: np.ndarray, n_terms: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Term weights and a threshold for each inner node of the bisection of a sample, the root first, then level by level."""
    n = len(sizes)
    order = bisected(sizes, terms, levels)
    doc = np.repeat(np.arange(n), sizes)
    weights, thresholds = np.zeros(((1 << levels) - 1, n_terms), np.float32), np.zeros((1 << levels) - 1)
    for level in range(levels):
        edges = np.arange((2 << level) + 1) * n // (2 << level)
        cell = np.empty(n, np.int64)
        cell[order] = np.repeat(np.arange(2 << level), np.diff(edges))
        share = (_degrees(cell, doc, terms, 2 << level, n_terms) + 0.5) / (np.diff(edges)[:, None] + 1)
        nodes = slice((1 << level) - 1, (2 << level) - 1)
        weights[nodes] = np.log2(share[1::2] / share[::2])
        fit = np.bincount(doc, weights[nodes][cell[doc] // 2, terms], minlength=n)
        thresholds[nodes] = [np.median(fit[order[edges[2 * k] : edges[2 * k + 2]]]) if edges[2 * k + 2] > edges[2 * k] else 0 for k in range(1 << level)]
    return weights, thresholds


def _parts(tree: Broadcast):
    """The vectors with the part of the tree that each falls into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = tree.value
        for batch in batches:
            lists = batch.column(2)
            sizes, terms = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
            doc, node = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(sizes), np.int64)
            while len(node) and node[0] < len(thresholds):
                fit = np.bincount(doc, weights[node[doc], terms], minlength=len(sizes))
                node = 2 * node + 1 + (fit > thresholds[node])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node - len(thresholds), pa.int32())], [*batch.schema.names, "part"])

    return run


def _clusters(statistics: Broadcast):
    """A part's block of documents as clusters, bisected in their own right."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        n_docs, n_all, weight = statistics.value
        group = group.combine_chunks()
        column = lambda c: group.column(c).chunk(0)
        sizes, terms, tfs = column("terms").value_lengths().to_numpy().astype(np.int64), column("terms").flatten().to_numpy(), column("tfs").flatten().to_numpy()
        levels = max(0, ceil(np.log2(len(sizes) / CLUSTER)))
        order = bisected(sizes, terms, levels)
        m = 25 + (75 * n_docs * column("n").to_numpy()) // n_all
        starts = np.cumsum(sizes) - sizes
        name = (key[0].as_py() << 40) + (key[1].as_py() << 12)
        rows = []
        for k in range(1 << levels):
            docs = order[k * len(order) >> levels : (k + 1) * len(order) >> levels]
            if not len(docs):
                continue
            at = np.repeat(starts[docs] - (np.cumsum(sizes[docs]) - sizes[docs]), sizes[docs]) + np.arange(sizes[docs].sum())
            own = weight[terms[at]] * ((1_000_000_000 * tfs[at].astype(np.int64)) // (1000 * tfs[at].astype(np.int64) + 8 * np.repeat(m[docs], sizes[docs])))
            names, inverse = np.unique(terms[at], return_inverse=True)
            most = np.zeros(len(names), np.int64)
            np.maximum.at(most, inverse, own)
            small = [x.astype(np.int32) for x in (sizes[docs], terms[at], tfs[at], names)]
            rows.append((name + k, column("doc_id").take(pa.array(docs)).to_pylist(), m[docs], *small, most))
        names = ["cluster", "doc_ids", "m", "sizes", "terms", "tfs", "bound_terms", "bounds"]
        kinds = [pa.int64(), *[pa.list_(x) for x in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())]]
        return pa.table([pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def clustered_index(vectors: DataFrame, n_terms: int, n_docs: int, n_all: int, weight: np.ndarray) -> DataFrame:
    """The clusters of ``vectors`` with their bounds, stored; ``n_docs`` documents have ``n_all`` terms, ``weight`` is a term's."""
    spark = vectors.sparkSession
    held = vectors.filter(F.size("terms") > 0)
    n_held = held.count()
    levels = max(0, min(ceil(np.log2(max(n_held, 1) / PART)), int(np.log2(MOST_WEIGHTS / max(n_terms, 1))), int(np.log2(SAMPLE)) - 5))
    sample = held.select("terms").orderBy(F.xxhash64("doc_id", "n", "terms", "tfs")).limit(SAMPLE if levels else 0).toArrow().combine_chunks()
    tree = np.zeros((0, n_terms), np.float32), np.zeros(0)
    if levels:
        lists = sample.column(0).chunk(0)
        tree = _tree(lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy(), n_terms, levels)
    parts = stored(held.mapInArrow(_parts(spark.sparkContext.broadcast(tree)), VECTORS + ", part int"), "parts")
    blocks = {r["part"]: ceil(r["count"] / PART) for r in parts.groupBy("part").count().collect()}
    n_blocks = F.get(F.array(*[F.lit(blocks.get(k, 1)) for k in range(1 << levels)]), F.col("part"))
    # a hash by id and position in the file, so that copies of one document fall to all blocks of their part
    dealt = parts.withColumn("block", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), n_blocks).cast("int"))
    statistics = spark.sparkContext.broadcast((n_docs, n_all, weight))
    return stored(dealt.groupBy("part", "block").applyInArrow(_clusters(statistics), CLUSTERS), "clusters")


# -- search --------------------------------------------------------------------------------------------------------


def _bounds(row_terms: np.ndarray, row_bounds: np.ndarray, items: tuple) -> np.ndarray:
    """What each item can score at most in a cluster."""
    first, terms, counts, n_terms = items
    most = np.zeros(n_terms, np.int64)
    most[row_terms] = row_bounds
    sums = np.append(0, np.cumsum(most[terms] * counts))
    return sums[first[1:]] - sums[first[:-1]]


def _bounded(items: Broadcast):
    """(item, cluster, bound) where the bound is above 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, cluster in enumerate(batch.column(0).to_pylist()):
                bound = _bounds(batch.column(1)[k].values.to_numpy(), batch.column(2)[k].values.to_numpy(), items.value)
                at = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.full(len(at), cluster), pa.int64()), pa.array(bound[at])], ["item", "cluster", "bound"])

    return run


class _Cluster:
    """A cluster's postings, read when an item visits it."""

    def __init__(self, batch: pa.RecordBatch, k: int, weight: np.ndarray) -> None:
        values = lambda c: batch.column(c)[k].values
        self.doc_ids, self.terms = values(1), values(4).to_numpy()
        sizes, tfs = values(3).to_numpy().astype(np.int64), values(5).to_numpy().astype(np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.adds = weight[self.terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(values(2).to_numpy(), sizes)))

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.adds * counts[self.terms], self.starts)


def _visited(items: Broadcast, weight: Broadcast, first: Broadcast, least: Broadcast | None, k: int):
    """(item, doc_id, score): of each item what may be among its ``k`` best.

    Without ``least`` the item visits its clusters of ``first``; with it all others whose bound reaches ``least``, by
    descending bound, until a bound falls below the ``k``-th score found here or that of ``least``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, terms, term_counts, n_terms = items.value
        counts = np.zeros(n_terms, np.int64)
        for batch in batches:
            names = batch.column(0).to_pylist()
            if not names:
                continue
            if least is None:
                visits = {}
                for row, name in enumerate(names):
                    for item in first.value.get(name, ()):
                        visits.setdefault(item, []).append((0, row))
            else:
                bound = np.stack([_bounds(batch.column(6)[row].values.to_numpy(), batch.column(7)[row].values.to_numpy(), items.value) for row in range(len(names))])
                for row, name in enumerate(names):
                    bound[row, first.value.get(name, [])] = 0
                row, item = np.nonzero((bound >= least.value) & (bound > 0))
                by = np.lexsort((-bound[row, item], item))
                visits = {}
                for r, i in zip(row[by].tolist(), item[by].tolist(), strict=True):
                    visits.setdefault(i, []).append((int(bound[r, i]), r))
            opened: dict[int, _Cluster] = {}
            for item, rows in visits.items():
                at = slice(begins[item], begins[item + 1])
                counts[terms[at]] = term_counts[at]
                floor = 0 if least is None else int(least.value[item])
                scores, owners = np.zeros(0, np.int64), []
                for most, row in rows:
                    if least is not None and most < floor:
                        break
                    if row not in opened:
                        opened[row] = _Cluster(batch, row, weight.value)
                    found = opened[row].scores(counts)
                    here = np.flatnonzero((found >= max(floor, 1)))
                    scores = np.append(scores, found[here])
                    owners.append(opened[row].doc_ids.take(pa.array(here)))
                    if len(scores) >= k:
                        floor = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                counts[terms[at]] = 0
                best = scores >= max(floor, 1)
                if best.any():
                    ids = pa.concat_arrays(owners).filter(pa.array(best))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item), pa.int32()), ids, pa.array(scores[best])], ["item", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.expr("row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST)")).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, rows: pa.Table, k: int) -> DataFrame:
    """(item, rank, doc_id, score) for a block of items; ``docs`` has doc_id and text, ``item`` is a row of ``rows``."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    hashes, first = term_hashes(rows.column("text").to_pylist())
    known = np.unique(hashes)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keys, counts = np.unique(owner * max(len(known), 1) + np.searchsorted(known, hashes), return_counts=True)
    begins = np.append(0, np.cumsum(np.bincount(keys // max(len(known), 1), minlength=len(first) - 1)))
    items = send((begins, keys % max(len(known), 1), counts, len(known)))

    vectors = stored(docs.mapInArrow(_vectors(send(known)), VECTORS), "vectors")
    n_docs, n_all = vectors.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(known), np.int64)
    held = vectors.select("terms").mapInArrow(_holders, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df[held.column("term").to_numpy()] = held.column("df").to_numpy()
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    index = clustered_index(vectors, len(known), n_docs, max(n_all, 1), weight)

    bounds = index.select("cluster", "bound_terms", "bounds").mapInArrow(_bounded(items), "item int, cluster long, bound long")
    place = F.expr("row_number() OVER (PARTITION BY item ORDER BY bound DESC, cluster)")
    visits: dict[int, list[int]] = {}
    for r in bounds.withColumn("place", place).filter(F.col("place") <= FIRST).collect():  # FIRST rows an item of the block
        visits.setdefault(r["cluster"], []).append(r["item"])
    first_visits, weights, schema = send(visits), send(weight), "item int, doc_id long, score long"
    early = stored(_ranked(index.mapInArrow(_visited(items, weights, first_visits, None, k), schema), k).drop("rank"), "early")
    least = np.zeros(len(first) - 1, np.int64)
    for r in early.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).collect():
        least[r["item"]] = r["least"]
    late = index.mapInArrow(_visited(items, weights, first_visits, send(least), k), schema)
    return _ranked(early.unionByName(late), k)


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, id, score) of the ``k`` documents of highest score above 0 for each row of ``queries``.

    A term's weight is ``floor(1000 ln((2 N + 2) / (2 df + 1)))``; a document's length part ``m`` is ``25 + 75 n N div L``; the
    score sums ``weight * (10^9 tf div (1000 tf + 8 m))`` over the item's terms, repeats included.
    """
    spark = docs.sparkSession
    queries = queries.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_blocks = max(1, ceil((queries.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK_CHARS))
    out = []
    for block in range(n_blocks):
        mine = queries.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block) if n_blocks > 1 else queries
        rows = mine.toArrow()
        names = spark.createDataFrame(pa.table({"item": pa.array(range(rows.num_rows), pa.int32()), "item_id": rows.column("item_id")}))
        found = _search_block(docs, rows, k).join(F.broadcast(names), "item")
        out.append(found.select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score"))
    return reduce(DataFrame.unionByName, out)
