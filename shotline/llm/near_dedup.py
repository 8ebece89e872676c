"""Near-duplicates by one-permutation MinHash with optimal densification, banded buckets and star-shaped candidate edges.

1. One pass over the texts makes each document's set of word shingles, one hash per bin of a single permutation, and
   fills empty bins from the first bin that holds a value in an order of its own for each bin (optimal densification).
2. Equal sets collapse to one node before anything is paired; a node is named by a 64-bit hash of its set.
3. Runs of bins form bands; equal bands form buckets. A bucket sends edges from one centre to its other members, so its
   pairs grow with its size, not with the square. Each band draws centres in an order of its own.
4. Every edge is confirmed on the full sets, and components come from alternating star contractions.
5. What a star may have missed are links inside buckets whose members are still of several components. In buckets of at
   most ``FEW`` others each member meets the rest. Larger ones, such as pages around one boilerplate, are searched by
   shingles instead: a shingle is rare if at most ``FEW`` of their documents hold it, and by the prefix rule a linked pair
   that shares any rare shingle shares one among the rarest ``n - ceil(t n) + 1`` of both. A pair without one shares at
   most the ``c`` other shingles of either, so it can reach the similarity ``t`` only if ``c >= t n`` in both and
   ``c >= 2 t / (1 + t) n`` in one of the two; those few are further centres of their buckets, those with the fewest
   rare shingles first, which leave them when they have met all. No pair that shares a bucket is passed over by this; before
   full sets are seen, pairs whose hash bytes agree less often than ``ALIKE`` under the similarity are turned away by that estimate.

Texts are never shuffled: a second scan fetches the sets of documents that share a bucket. Nothing is collected to the driver
but counts and a bitmap of bounded size.

Defined results: a null or blank text has an empty set and is linked with nothing; a null id is linked with nothing,
gets a null component and is kept; rows that repeat an id are one document, which has one component even if their
texts differ; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _ODD, cut, in_chunks, mix, release, stored, word_hashes

WIDTH = 5  # words in a shingle
BANDS, ROWS = 32, 8  # at similarity 0.85, one pair in 25,000 shares no bucket
BINS = BANDS * ROWS
FEW = 20  # members of a bucket, or holders of a shingle, that meet pair by pair
MORE_CENTRES = 16  # further centres of a large bucket at first, and how their number grows from round to round
PLACES = 4  # of a document in the bitmap
MOST_WANTED = 1 << 22  # documents that a bitmap picks, of 16 bits each (8 MB); more are picked by a join
ALIKE = 0.12  # how far the share of equal hash bytes may lie under the similarity asked for; over five standard deviations

_order = np.random.default_rng(7)
_PROBE = np.stack([_order.permutation(BINS) for _ in range(BINS)]).astype(np.int16)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 8)
_SALT = mix(np.arange(1, 2 + BANDS, dtype=np.uint64))


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; with fewer words than ``width`` the whole sequence is one."""
    hashes, first = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    n = max(len(hashes) - width + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += hashes[k : k + n] * _ODD[k]
    rolled = mix(rolled)
    out = []
    for begin, end in zip(first[:-1], first[1:], strict=True):
        if end - begin >= width:
            out.append(np.unique(rolled[begin : end - width + 1]))
        elif end > begin:
            part = hashes[begin:end]
            out.append(mix(np.array([(part * _ODD[8 : 8 + len(part)]).sum(dtype=np.uint64)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def bands_of(found: np.ndarray) -> np.ndarray:
    """A long for each band of a non-empty sorted set: the last bytes of its one-permutation hashes, densified."""
    at = np.searchsorted(found, _EDGES)
    full = np.append(at[1:], len(found)) > at
    value = found[np.minimum(at, len(found) - 1)]
    if not full.all():
        empty = np.flatnonzero(~full)
        probes = _PROBE[empty]
        value[empty] = value[probes[np.arange(len(empty)), full[probes].argmax(axis=1)]]
    return value.astype(np.uint8).view(np.int64)


def node_of(found: np.ndarray) -> int:
    """The name of a non-empty set: a long that depends on nothing but its shingles."""
    return int(mix(found ^ _SALT[0]).sum(dtype=np.uint64).astype(np.int64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for begin, end in in_chunks(texts, lambda t: len(t or "")):
            sets = shingle_sets(texts[begin:end])
            own = [pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([bands_of(s) if len(s) else None for s in sets], pa.list_(pa.int64()))]
            keys = [batch.column(k).slice(begin, end - begin) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, *own], ["id", "row", "n_shingles", "node", "bands"])


def _sets(wanted: Broadcast | None):
    """The sets of the documents all whose bits are set, of all without a bitmap; columns: text, bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8) if wanted else None
        for batch in batches:
            if wanted:
                places = [batch.column(1 + k).to_numpy(zero_copy_only=False) for k in range(PLACES)]
                batch = batch.filter(pa.array(np.logical_and.reduce([bits[at >> 3] >> (at & 7) & 1 for at in places])))
            texts = batch.column(0).to_pylist()
            for begin, end in in_chunks(texts, lambda t: len(t or "")):
                sets = [s for s in shingle_sets(texts[begin:end]) if len(s)]
                columns = [
                    pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([bands_of(s) for s in sets], pa.list_(pa.int64())),
                    pa.array([np.unique(s.astype(np.uint16).view(np.int16)) for s in sets], pa.list_(pa.int16())), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "bands", "marks", "shingles"])

    return run


def _wanted_sets(narrow: DataFrame, need: DataFrame) -> DataFrame:
    """(node, n, bands, marks, shingles) of at least the nodes in ``need`` (id, node): ``id`` is a document with that set.

    Up to ``MOST_WANTED`` nodes a bitmap of hashed ids lets a scan of the texts pass over nearly all others without
    moving a text; for more, the texts are joined with the ids.
    """
    n_need = need.count()
    schema = "node long, n int, bands array<long>, marks array<smallint>, shingles array<long>"
    if n_need > MOST_WANTED:
        sets = narrow.join(need.select("id").distinct(), "id", "left_semi").select("text").mapInArrow(_sets(None), schema)
    else:
        n_bits = 1 << max(16 * n_need, 1 << 16).bit_length()
        places = [F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n_bits)) for k in range(PLACES)]
        bits = np.zeros(n_bits >> 3, np.uint8)
        bit = need.select(F.explode(F.array(*places)).alias("bit"))
        words = bit.groupBy(F.shiftright("bit", 5).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 AS int)))").alias("value"))
        found = words.toArrow()
        bits.view(np.uint32)[found["word"].to_numpy()] = found["value"].to_numpy().astype(np.uint32)
        wanted = narrow.sparkSession.sparkContext.broadcast(bits.tobytes())
        sets = narrow.filter("id IS NOT NULL").select("text", *[x.alias(f"bit{k}") for k, x in enumerate(places)]).mapInArrow(_sets(wanted), schema)
    sets = stored(sets, "sets")
    if sets.count() > 1.1 * n_need:  # rows that repeat an id; a set that comes twice costs time, but changes nothing
        sets = stored(sets.dropDuplicates(["node"]), "sets")
    return sets


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), ``root`` the smallest node reachable.

    Alternating large-star and small-star steps contract every component to a star around its smallest node. Each step
    is an aggregate by node and a join that Spark can split, so a node with very many links is no burden to one task.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = cut(small)
        del both, least, large, low, small
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
        release(links.sparkSession)
    return cut(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def _confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * shared >= per_cent * joint.

    Pairs first meet in sizes, in the bytes of their hashes, and in marks of 16 bits a shingle, a quarter of the bytes.
    What the marks share, and what they may have lost to equal marks within a set, bounds the shared shingles from
    above, so they only turn away pairs that fail; the others are confirmed on the full sets.
    """

    def joined(rows: DataFrame, *columns: str) -> DataFrame:
        for side in ("b", "a"):
            rows = rows.join(sets.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
        return rows

    def enough(shared: Column) -> Column:
        return 100 * shared >= per_cent * (F.col("n_a") + F.col("n_b") - shared)

    def equal_bytes(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for bits, kept in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            z = z.bitwiseOR(F.shiftrightunsigned(z, bits)).bitwiseAND(F.lit(kept))
        return F.lit(8) - F.bit_count(z)

    sizes = 100 * F.least("n_a", "n_b") >= per_cent * F.greatest("n_a", "n_b")
    alike = F.aggregate(F.zip_with("bands_a", "bands_b", equal_bytes), F.lit(0), lambda a, x: a + x) >= int((per_cent / 100 - ALIKE) * BINS)
    bound = F.size(F.array_intersect("marks_a", "marks_b")) + F.least(F.col("n_a") - F.size("marks_a"), F.col("n_b") - F.size("marks_b"))
    maybe = cut(joined(pairs, "n", "bands", "marks").filter(sizes & alike & enough(bound)).select("a", "b"))
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return joined(maybe, "n", "shingles").filter(enough(shared)).select("a", "b")


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the component of their node."""
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")


def _open(here: DataFrame) -> DataFrame:
    """The rows in buckets with members of several components, and how many members these have."""
    spread = here.groupBy("band", "value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members")).filter("lo < hi").select("band", "value", "members")
    return cut(here.join(cut(spread), ["band", "value"]))


def _met(x: DataFrame, y: DataFrame, on: list[str], may: str = "true") -> DataFrame:
    """Pairs of different components that meet in ``on``; columns of ``y`` have the prefix ``o_``."""
    other = y.select(*on, *[F.col(c).alias(f"o_{c}") for c in y.columns if c not in on])
    return x.join(other, on).filter("label <> o_label").filter(may).select(*_ordered("node", "o_node")).distinct()


def _by_rare_shingles(hard: DataFrame, sets: DataFrame, per_cent: int) -> tuple[DataFrame, DataFrame]:
    """(shingle, node, label) of the prefixes of ``hard`` (node, label), and (node, n, common) where few shingles are rare."""
    own = sets.select("node", "n", "shingles").join(hard, "node")
    held = own.select("node", F.explode("shingles").alias("shingle"))
    # only rare shingles are joined, so none is the key of more than FEW rows
    rare = held.groupBy("shingle").agg(F.count("*").alias("df")).filter(F.col("df") <= FEW)
    ranked = held.join(rare, "shingle").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("rare"))
    ranked = stored(own.select("node", "label", "n").join(ranked, "node", "left").withColumn("n_rare", F.greatest(F.size("rare"), F.lit(0))), "rare")
    prefix = F.col("n") - F.ceil(F.col("n") * per_cent / 100) + 1
    # an item more guards the prefix against rounding
    lists = ranked.select("node", "label", F.explode(F.slice("rare", F.lit(1), (prefix + 1).cast("int"))).alias("x")).filter("x.df > 1")
    counts = ranked.select("node", "n", (F.col("n") - F.col("n_rare")).alias("common"))
    return lists.select(F.col("x.shingle").alias("shingle"), "node", "label"), counts.filter(100 * F.col("common") >= per_cent * F.col("n"))


def _stars(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("a"), F.col("root").alias("b"))


def _labels(nodes: DataFrame, narrow: DataFrame, per_cent: int) -> DataFrame:
    """(node, root) of all nodes that are linked."""
    keys = nodes.select(F.posexplode("bands").alias("band", "value"), "node")
    salt = F.get(F.array(*[F.lit(int(x)) for x in _SALT[1:].view(np.int64)]), F.col("band"))
    centres = keys.groupBy("band", "value").agg(F.count("*").alias("c"), F.min(F.col("node").bitwiseXOR(salt)).alias("first")).filter("c > 1")
    centres = cut(centres.select("band", "value", F.col("first").bitwiseXOR(salt).alias("c_node")))
    members = stored(keys.join(centres, ["band", "value"]), "members")
    need = nodes.select("first", "node").join(members.select("node").distinct(), "node").select(F.col("first").alias("id"), "node")
    sets = _wanted_sets(narrow, cut(need))

    rest = members.filter("node <> c_node")
    labels = components(_confirmed(cut(rest.select(*_ordered("node", "c_node")).distinct()), sets, per_cent))
    here = _open(_labelled(rest.select("band", "value", "node"), labels))
    if here.isEmpty():
        return labels
    small, large = here.filter(F.col("members") <= FEW), here.filter(F.col("members") > FEW).drop("members")
    pairs = _met(small, small, ["band", "value"])
    hard = cut(large.select("node", "label").distinct())
    if hard.isEmpty():
        return components(_stars(labels).union(_confirmed(cut(pairs), sets, per_cent)))
    may = f"{100 + per_cent} * least(common, o_common) >= {per_cent} * (n + o_n) AND 100 * least(n, o_n) >= {per_cent} * greatest(n, o_n)"

    def centres(rows: DataFrame, most: int) -> DataFrame:
        """Of the members that may be centres those with the fewest rare shingles."""
        slim = rows.filter((100 + per_cent) * F.col("common") >= 2 * per_cent * F.col("n"))
        place = F.expr("row_number() OVER (PARTITION BY band, value ORDER BY n - common, node)")
        return cut(slim.withColumn("place", place).filter(F.col("place") <= most).drop("place"))

    lists, slim = _by_rare_shingles(hard, sets, per_cent)
    large = cut(large.join(cut(slim), "node"))
    most = MORE_CENTRES
    middle = centres(large, most)
    pairs = pairs.union(_met(lists, lists, ["shingle"])).union(_met(large, middle, ["band", "value"], may)).distinct()
    labels = components(_stars(labels).union(_confirmed(cut(pairs), sets, per_cent)))
    while True:
        rest = large.drop("label").join(middle.select("band", "value", "node"), ["band", "value", "node"], "left_anti")
        large = _open(_labelled(rest, labels)).drop("members")
        most *= MORE_CENTRES
        middle = centres(large, most)
        if middle.isEmpty():
            return labels
        found = cut(_confirmed(cut(_met(large, middle, ["band", "value"], may)), sets, per_cent))
        if not found.isEmpty():
            labels = components(_stars(labels).union(found))
        del rest, found
        release(sets.sparkSession)


def _found(docs: DataFrame, per_cent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """A row for each row of ``docs`` (id, row, n_shingles, node), and (node, root) of the nodes that are linked."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    marks = stored(narrow.mapInArrow(_signatures, "id long, row long, n_shingles long, node long, bands array<long>"), "marks")
    known = marks.filter("id IS NOT NULL AND node IS NOT NULL")
    nodes = known.groupBy("node").agg(F.min(F.struct("id", "bands")).alias("x")).select("node", F.col("x.id").alias("first"), "x.bands")
    nodes = stored(nodes, "nodes")
    return marks.drop("bands"), _labels(nodes, narrow.drop("row"), per_cent)


def near_duplicates(docs: DataFrame, per_cent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``; links have ``100 * shared >= per_cent * joint`` shingles."""
    marks, labels = _found(docs, per_cent, id_col, text_col)
    # a blank row of an id is a node of its own; all nodes of an id are one document
    rows = marks.withColumn("node", F.when(F.col("id").isNotNull(), F.coalesce("node", F.xxhash64("id", F.lit("blank")))))
    several = cut(rows.filter("node IS NOT NULL").groupBy("id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("id", "lo"))
    if not several.isEmpty():
        same = rows.join(several, "id").filter("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct()
        labels = components(_stars(labels).union(same))
    firsts = _labelled(rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("first")), labels)
    smallest = firsts.groupBy("label").agg(F.min("first").alias("component_id"))
    component = cut(firsts.join(smallest, "label").select("node", "component_id"))
    out = rows.join(component, "node", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def dedup_filter(docs: DataFrame, per_cent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each group of linked texts, that of the smallest id, with the columns of ``docs``.

    Rows fall each by its own text: where an id repeats with different texts, no text goes unless one it is linked with
    stays, and of rows that repeat id and text one stays. Rows without an id or a word stay.
    """
    marks, labels = _found(docs, per_cent, id_col, text_col)
    rows = marks.filter("id IS NOT NULL AND node IS NOT NULL").groupBy("node", "id", "row").agg(F.count("*").alias("n"))
    rows = stored(_labelled(rows, labels), "rows")
    # the smallest id of a group, then the smallest hash of a text of that id
    first = rows.groupBy("label").agg(F.min("id").alias("id"))
    first = cut(rows.join(first, ["label", "id"]).groupBy("label", "id").agg(F.min("row").alias("row")))
    gone = rows.join(first, ["label", "id", "row"], "left_anti").select("id", "row")
    own_id, own_row = docs[id_col].cast("long"), F.xxhash64(docs[text_col])
    gone = gone.select(F.col("id").alias("__gone_id"), F.col("row").alias("__gone_row"))
    kept = docs.join(gone, (own_id == F.col("__gone_id")) & (own_row == F.col("__gone_row")), "left_anti")
    again = rows.filter("n > 1").join(first, ["label", "id", "row"], "left_semi").select(F.col("id").alias("__again_id"), F.col("row").alias("__again_row"))
    if again.isEmpty():
        return kept
    again = cut(again)
    same = (own_id == F.col("__again_id")) & (own_row == F.col("__again_row"))
    own = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    repeats = kept.join(again, same, "left_semi").select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("t"), own.alias("__doc"), F.to_json(own).alias("order"))
    one = repeats.groupBy("i", "t").agg(F.min_by("__doc", "order").alias("__doc")).select("__doc.*")
    return kept.join(again, same, "left_anti").unionByName(one)
