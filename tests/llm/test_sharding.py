"""The k-d tree: equal rows part, leaves reach their target bytes, cuts are those of a plain tree in memory."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from shotline.llm import sharding


def loads(rows, shards):
    load = Counter({s: 0 for s in range(shards)})
    for r in rows:
        load[r["shard"]] += r["size"]
    return load


@pytest.mark.parametrize("block", [50])
def test_equal_rows_part(spark, monkeypatch, block):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", block)
    docs = spark.range(8000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(4).alias("n_chars"))
    rows = sharding.kd_shards(docs, shards=8).collect()
    load = loads(rows, 8)
    assert len(rows) == 8000 and max(load.values()) - min(load.values()) <= 5 * 4
    for s in range(8):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    placed = Counter(r["shard"] for r in sharding.with_shard(docs, shards=8).collect())
    assert max(placed.values()) - min(placed.values()) <= 4


def test_a_third_of_equal_rows_among_others(spark):
    docs = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.repeat(F.lit("x"), (F.col("id") % 40).cast("int"))).alias("text"))
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text")})
    rows = sharding.kd_shards(docs, shards=6, dims=("n_chars",)).collect()
    load = loads(rows, 6)
    assert len(rows) == 9000 and max(load.values()) - min(load.values()) <= 6 * 41


@pytest.mark.parametrize("target", [9_000])
def test_target_bytes(spark, target):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("y"), (F.col("id") * 7 % 90).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"), F.lit("en").alias("lang"), (F.col("id") * 7 % 90).alias("n_chars"))
    rows = sharding.kd_shards(docs, target_bytes=target).collect()
    n = -(-sum(r["size"] for r in rows) // target)
    load = loads(rows, n)
    assert set(load) == set(range(n)) and max(load.values()) <= target + 3 * 91 and min(load.values()) >= target / 2
    placed = sharding.with_shard(docs, target_bytes=target).select("doc_id", "shard").collect()
    assert {tuple(r) for r in placed} == {(r["doc_id"], r["shard"]) for r in rows}


def test_cuts_are_those_of_a_plain_tree(spark):
    """Numbers without ties and of one size: halves of sorted order along the widest dimension, down to single rows."""
    points = [(k, "z", float((k * 37) % 64), float((k * 11) % 64) ** 2) for k in range(64)]
    docs = spark.createDataFrame(points, "doc_id long, text string, u double, v double")
    got = {r["doc_id"]: r["shard"] for r in sharding.kd_shards(docs, shards=16, dims=("u", "v")).collect()}
    span = [(min(p[k] for p in points), max(p[k] for p in points)) for k in (2, 3)]

    def plain(rows, shards, first):
        if shards == 1:
            return {p[0]: first for p in rows}
        width = [(max(p[k + 2] for p in rows) - min(p[k + 2] for p in rows)) / (span[k][1] - span[k][0]) for k in (0, 1)]
        rows = sorted(rows, key=lambda p: p[2 + (width[1] > width[0])])
        half = len(rows) // 2
        return plain(rows[:half], shards // 2, first) | plain(rows[half:], shards // 2, first + shards // 2)

    assert got == plain(points, 16, 0)


def test_categories_are_as_wide_as_their_share(spark):
    """Two sources in a node are half of three; a number over a tenth of its range is narrower."""
    docs = spark.createDataFrame([(k, "t", "abc"[k % 3] if k < 60 else "a", 5.0 if k < 60 else 100.0) for k in range(64)], "doc_id long, text string, source string, u double")
    rows = sharding.kd_shards(docs, shards=2, dims=("source", "u")).join(docs, "doc_id").collect()
    sides = [{r["source"] for r in rows if r["shard"] == s} for s in (0, 1)]
    assert len(sides[0] & sides[1]) == 1  # the cut goes through one source
