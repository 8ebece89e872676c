"""Sharding by a k-d tree over metadata.

A node that must yield more than one shard is split along its widest dimension, at the key where the bytes below reach
the share of the shards on that side (the weighted median for an even number). A number is as wide as its range, a
category as the share of all categories it holds, each of the whole table's. Keys are a scaled metadata value followed
by a hash of the row, so rows that tie on the value still part cleanly; rows that are equal and together outweigh the
slack of a cut part by a running number of rows. Cuts are found by refining a histogram of bytes: each pass is one
aggregate over narrow rows, for up to ``CELLS / 4`` nodes of a level at once, and brings at most ``CELLS`` sums to the
driver, whatever the number of documents. The driver holds a few numbers for each leaf. No text is moved.

Defined results: a null or empty text has size 1 and checksum 0; null metadata sorts lowest; rows that repeat another
are rows like any other and part, the number of them on each side being what counts; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import cut, let, stored

CELLS = 1 << 16  # sums that one pass may bring to the driver
SCALE_BITS, TIE_BITS = 30, 30
SLACK = 1e-4  # of a shard's bytes, within which a cut may miss
BLOCK_ROWS = 4096  # rows that are numbered in one group, on average


@dataclass
class _Node:
    shards: int
    first: int  # its first shard
    dim: int = 0
    low: int = 0  # the cut lies in low .. low + span
    span: int = 0
    below: int = 0  # bytes under low
    goal: float = 0.0
    cut: int | None = None
    seat: int = 0  # of rows at the cut itself, those with a lower number stay below


def _pick(node: Column, values: list[int]) -> Column:
    """The node's entry; the values are one literal, folded into an array when the query is planned."""
    return F.get(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), node)


@dataclass
class Tree:
    """A fitted tree: the range of each dimension, then the dimension, cut and seat of every node, level by level."""

    dims: tuple[str, ...]
    ranges: list[tuple[float | None, float | None]]
    levels: list[tuple[list[int], list[int], list[int]]]
    first: list[int]  # the shard of each leaf
    rows: int


def _measured(docs: DataFrame, dims: tuple[str, ...], id_col: str, text_col: str) -> dict[str, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    values = [F.col(d).cast("double") if isinstance(docs.schema[d].dataType, NumericType) else F.crc32(F.col(d).cast("binary")).cast("double") for d in dims]
    seat = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << TIE_BITS))
    out = {"id": F.col(id_col), "size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text.cast("binary")), "seat": seat}
    return out | {f"v{k}": v for k, v in enumerate(values)}


def _categories(docs: DataFrame, dims: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(d for d in dims if not isinstance(docs.schema[d].dataType, NumericType))


def _placed(rows: DataFrame, tree: Tree) -> DataFrame:
    """``rows`` of measures with ``at``, ``tie`` and ``node`` as far as the tree's levels go."""

    def scaled(k: int) -> Column:
        low, high = tree.ranges[k]
        if low is None or not high > low:
            return F.lit(0).cast("long")
        at = (F.col(f"v{k}") - F.lit(low)) / F.lit(high - low) * F.lit(float((1 << SCALE_BITS) - 1))
        return F.when(F.isnan(at), F.lit(0)).otherwise(F.coalesce(at, F.lit(0.0))).cast("long")

    tie = F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(1 << TIE_BITS))
    rows = rows.withColumns({"tie": tie, "at": F.array(*[scaled(k) for k in range(len(tree.ranges))]), "node": F.lit(0).cast("int")})
    for level in tree.levels:
        rows = _descend(rows, *level)
    return rows


def _key(dims: list[int], node: Column) -> Column:
    return F.get(F.col("at"), _pick(node, dims).cast("int")) * F.lit(1 << TIE_BITS) + F.col("tie")


def _descend(rows: DataFrame, dims: list[int], cuts: list[int], seats: list[int]) -> DataFrame:
    """``node`` one level deeper; each level is bound once, so that the plan grows by a step a level."""

    def half(node: Column) -> Column:
        cut = _pick(node, cuts)
        above = _key(dims, node) >= cut
        if any(seats):
            above = let(_key(dims, node), lambda key: (key > cut) | ((key == cut) & (F.col("seat") >= _pick(node, seats))))
        return 2 * node + above.cast("int")

    return rows.withColumn("node", let(F.col("node"), half))


def fit(sizes: DataFrame, dims: tuple[str, ...], shards: int | None = None, target_bytes: int | None = None, categories: tuple[str, ...] = ()) -> Tree:
    """The tree for a table of measures, with ``shards`` leaves or as many as ``target_bytes`` asks for."""
    names = [f"v{k}" for k in range(len(dims))]
    kinds = {k: f"v{k}" for k, d in enumerate(dims) if d in categories}
    whole = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("n"), *[f(v).alias(f"{f.__name__}_{v}") for v in names for f in (F.min, F.max)], *[F.approx_count_distinct(v).alias(f"kinds_{v}") for v in kinds.values()]).first()
    kinds = {k: whole[f"kinds_{v}"] for k, v in kinds.items()}
    leaves = shards or max(1, ceil(whole["bytes"] / target_bytes))
    tree = Tree(dims, [(whole[f"min_{v}"], whole[f"max_{v}"]) for v in names], [], [0], whole["n"])
    rows, nodes = _placed(sizes, tree), [_Node(leaves, 0)]
    while any(n.shards > 1 for n in nodes):
        _choose(rows, nodes, len(dims), kinds)
        keyed, slack = rows.withColumn("key", _key([n.dim for n in nodes], F.col("node"))), SLACK * whole["bytes"] / leaves
        tied = _find_cuts(keyed, nodes, slack)
        if tied:
            at = F.col("key") == _pick(F.col("node"), [n.cut if k in tied else -1 for k, n in enumerate(nodes)])
            within = [_Node(n.shards, n.first, span=1 << TIE_BITS, below=n.below, goal=n.goal) if k in tied else _Node(1, 0) for k, n in enumerate(nodes)]
            _find_cuts(keyed.filter(at).withColumn("key", F.col("seat")), within, slack)
            for k in tied:
                nodes[k].seat = within[k].cut
        tree.levels.append(([n.dim for n in nodes], [1 << 62 if n.cut is None else n.cut for n in nodes], [n.seat for n in nodes]))
        rows = _descend(rows, *tree.levels[-1])
        nodes = [half for n in nodes for half in (_Node(n.shards - n.shards // 2 if n.shards > 1 else 1, n.first), _Node(n.shards // 2, n.first + n.shards - n.shards // 2))]
    tree.first = [n.first for n in nodes]
    return tree


DIMS = ("source", "lang", "n_chars", "doc_id")


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = DIMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row: ``shards`` leaves, or as many as ``target_bytes`` asks for.

    Sizes of the shards are near equal in bytes; slots number a shard's rows from 0 without gaps.
    """
    sizes = stored(docs.select(*[c.alias(n) for n, c in _measured(docs, dims, id_col, text_col).items()]), "sizes")
    tree = fit(sizes, dims, shards, target_bytes, _categories(docs, dims))
    placed = _placed(sizes, tree).select("id", "size", "text_crc32", "seat", _pick(F.col("node"), tree.first).cast("int").alias("shard"))
    return _numbered(placed, tree.rows).withColumnRenamed("id", id_col)


def with_shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = DIMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its shard: the fitted tree as an expression of each row, so texts stay where they are.

    A column of ``docs`` named ``shard`` is replaced.
    """
    measured = _measured(docs, dims, id_col, text_col)
    tree = fit(stored(docs.select(*[c.alias(n) for n, c in measured.items()]), "sizes"), dims, shards, target_bytes, _categories(docs, dims))
    own = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c != "shard"]).alias("__doc")
    placed = _placed(docs.select(own, *[c.alias(n) for n, c in measured.items()]), tree)
    return placed.select("__doc.*", _pick(F.col("node"), tree.first).cast("int").alias("shard"))


def _choose(rows: DataFrame, nodes: list[_Node], n_dims: int, kinds: dict[int, int]) -> None:
    """The widest dimension of each node, its range of keys, and the bytes that must come to lie below the cut.

    ``kinds``: how many values each dimension of categories has in the whole table.
    """
    ends = [f(F.get("at", F.lit(k))).alias(f"{name}{k}") for k in range(n_dims) for name, f in (("lo", F.min), ("hi", F.max))]
    found = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *ends, *[F.approx_count_distinct(F.get("at", F.lit(k))).alias(f"kinds{k}") for k in kinds]).collect()

    def width(r, k: int) -> float:
        if k in kinds:
            return (1 << SCALE_BITS) * (r[f"kinds{k}"] - 1) / max(1, kinds[k] - 1)
        return r[f"hi{k}"] - r[f"lo{k}"]

    for r in found:
        n = nodes[r["node"]]
        if n.shards > 1:
            n.dim = max(range(n_dims), key=lambda k: (width(r, k), -k))
            n.low = r[f"lo{n.dim}"] << TIE_BITS
            n.span = (r[f"hi{n.dim}"] + 1 << TIE_BITS) - n.low
            n.goal = r["bytes"] * (n.shards - n.shards // 2) / n.shards
    for n in nodes:
        if n.shards > 1:
            n.cut = None if n.span else 0


def _find_cuts(keyed: DataFrame, nodes: list[_Node], slack: float) -> list[int]:
    """Narrow each node's range until the bytes inside are within the slack or it is a single key.

    Returns the nodes whose cut is a single key of several rows and more bytes than the slack, with the bytes under it in ``below``.
    """
    tied = []
    while open_ := [k for k, n in enumerate(nodes) if n.shards > 1 and n.cut is None][: CELLS // 4]:
        fan = CELLS // len(open_)
        step = {k: -(-nodes[k].span // fan) for k in open_}
        low, width, span = (_pick(F.col("node"), [x(k) if k in step else other for k in range(len(nodes))]) for x, other in ((lambda k: nodes[k].low, 0), (lambda k: step[k], 1), (lambda k: nodes[k].span, 0)))
        inside = keyed.withColumn("off", F.col("key") - low).filter((F.col("off") >= 0) & (F.col("off") < span))
        sums: dict[int, dict[int, tuple[int, int]]] = {k: {} for k in open_}
        for r in inside.withColumn("width", width).groupBy("node", F.expr("off div width").alias("cell")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
            sums[r["node"]][r["cell"]] = r["bytes"], r["n"]
        for k in open_:
            n, below = nodes[k], nodes[k].below
            for c in sorted(sums[k]):
                if below + sums[k][c][0] >= n.goal:
                    break
                below += sums[k][c][0]
            n.low, n.span, n.below, (heavy, rows) = n.low + c * step[k], step[k], below, sums[k][c]
            if n.span == 1 and heavy > slack and rows > 1:
                n.cut = n.low
                tied.append(k)
            elif heavy <= slack or n.span == 1:
                n.cut = n.low + n.span * (n.goal - below > heavy / 2)
    return tied


def _numbered(placed: DataFrame, n_rows: int) -> DataFrame:
    """Slots: rows are numbered inside blocks of bounded size, and each block begins where the one before it ends.

    Equal rows fall into one block; a block of many more rows than others is dealt to parts by the running number.
    """
    blocks = max(1, ceil(n_rows / BLOCK_ROWS))
    rows = placed.withColumn("block", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(blocks)))
    sizes = cut(rows.groupBy("shard", "block").agg(F.count("*").alias("n")))
    large = sizes.filter(F.col("n") > 4 * BLOCK_ROWS).withColumn("parts", F.ceil(F.col("n") / BLOCK_ROWS)).drop("n")
    if large.isEmpty():
        rows, sizes = rows.withColumn("part", F.lit(0).cast("long")), sizes.withColumn("part", F.lit(0).cast("long"))
    else:
        rows = rows.join(cut(large), ["shard", "block"], "left").withColumn("part", F.coalesce(F.pmod("seat", "parts"), F.lit(0).cast("long")))
        sizes = rows.groupBy("shard", "block", "part").agg(F.count("*").alias("n"))
    begins = sizes.select("shard", "block", "part", F.expr("sum(n) OVER (PARTITION BY shard ORDER BY block, part) - n").alias("begin"))
    inside = F.expr("row_number() OVER (PARTITION BY shard, block, part ORDER BY id, text_crc32, size) - 1")
    out = rows.withColumn("slot", inside).join(begins, ["shard", "block", "part"])
    return out.select("id", "size", "text_crc32", "shard", (F.col("slot") + F.col("begin")).cast("long").alias("slot"))
