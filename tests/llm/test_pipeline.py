"""The pipeline stage by stage against brute force on whole small tables."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from shotline.llm import quality_rules

from .test_more import brute_overlap
from .test_operators import SF, brute_near, brute_rules, brute_targets, words


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF).cache())
    rows = [[tuple(r) for r in f.collect()] for f in frames]
    kept = {r["doc_id"] for r in quality_rules.with_rules(docs).filter("kept").collect()}
    assert Counter(r[0] for r in rows[1]) == Counter(d for d, *_ in rows[0] if d in kept)
    near = brute_near(rows[1])
    assert Counter(r[0] for r in rows[2]) == Counter(d for d in near if near[d][1] == d)
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = lambda t: any(i in " ".join(t.lower().split()) for i in items)
    assert {r[0] for r in rows[2]} - {r[0] for r in rows[3]} >= {r[0] for r in rows[2] if held(r[1])}
    assert len(rows[3]) >= 0.9 * len(rows[2])
    assert max(Counter(r[0] for r in rows[4]).values()) <= 2 and set(rows[4]) <= set(rows[3])
    assert frames[4].columns == docs.columns and frames[5].columns == [*docs.columns, "shard"]
    assert Counter(r[:-1] for r in rows[5]) == Counter(rows[4]) and {r[-1] for r in rows[5]} <= set(range(8))


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[-1] == "shard" and out.count() > 0


def brute_kept(rows, items, kept):
    """The rows that quality rules (``kept``: texts that they keep), near-duplicates and decontamination leave, one after the other."""
    for text in kept:
        n, _, _, _, repeats = brute_rules(text)
        assert n >= 50 and 100 * repeats <= 50 * n
    rows = [r for r in rows if r[1] in kept]
    near = brute_near(rows)
    rows = [r for r in rows if near[r[0]][1] == r[0]]
    low = lambda t: [w.lower() for w in words(t)]
    quick = [set(low(i)) for i in items]
    return [r for r in rows if not any(len(q & set(low(r[1]))) > 2 and brute_overlap(low(r[1]), low(i)) for q, i in zip(quick, items, strict=True))]


def mix_and_shards_hold(rows, out):
    """The rows of ``out`` are copies of ``rows`` that meet the sources' targets, in eight shards of near equal bytes."""
    size, source_of, sizes = {}, {}, Counter()
    for r in rows:
        size[r[:5]], source_of[r[:5]] = len(words(r[1])), r[3]
        sizes[r[3]] += len(words(r[1]))
    want, taken, copies = brute_targets(sizes), Counter(), Counter(r[:5] for r in out)
    assert set(copies) <= set(size) and max(copies.values()) <= 2
    for r, n in copies.items():
        taken[source_of[r]] += n * size[r]
    largest = max(size.values())
    for s, target in want.items():
        assert abs(taken[s] - target) <= max(2 * largest, 0.02 * target), s
    shards = defaultdict(int)
    for r in out:
        shards[r[-1]] += len((r[1] or "").encode()) + 1
    assert set(shards) == set(range(8)) and max(shards.values()) - min(shards.values()) <= 2 * max(len((r[1] or "").encode()) for r in rows) + 2


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r["text"] for r in quality_rules.with_rules(docs).filter("kept").collect()}
    mix_and_shards_hold(brute_kept(rows, items, kept), [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()])


@pytest.mark.parametrize("empty", [False, True])
def test_run_over_awkward_rows(spark, tmp_path, empty):
    """Nulls in every column, blank and very long texts, repeated rows and ids, extra columns named like the operators' own."""
    rng = random.Random(6)
    text = lambda n, own: ". ".join(" ".join(f"{own}{rng.randrange(10**6)}" if rng.random() < 0.5 else rng.choice(["the", "of", "and", "to", "in", "is"]) for _ in range(12)) for _ in range(n // 12)) + "."
    own = [(k, text(120, f"w{k}x"), "en", "abc"[k % 3], 700, 1.0, "s") for k in range(60)]
    hot = text(240, "hot")
    rows = own + [(100 + k, hot, "en", "a", 1, None, None) for k in range(30)] + [own[3]] * 3 + [(None, own[5][1], None, None, None, None, None), (None, text(90, "n"), None, None, None, None, "x")]
    rows += [(7, text(90, "z"), "de", None, 5, 2.0, "t"), (200, None, "en", "a", 0, 0.0, ""), (201, "", "en", "b", 0, 0.0, ""), (202, " \n\t", "en", "b", 0, 0.0, ""), (203, text(60_000, "long"), "en", "c", 1, 1.0, ""), (204, text(90, "o") + " " + " ".join(f"bench{k}" for k in range(30)), "en", "a", 1, 1.0, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard double, kept string"
    df = spark.createDataFrame([] if empty else rows, schema).withColumnRenamed("shard", "size")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{k}" for k in range(30))), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*df.columns, "shard"]
    got = [tuple(r) for r in out.collect()]
    if empty:
        assert got == []
        return
    assert {r[:-1] for r in got} <= set(rows) and max(Counter(r[:-1] for r in got).values()) <= 2
    ids = Counter(r[0] for r in got)
    assert not {200, 201, 202, 204} & set(ids) and not set(range(101, 130)) & set(ids) and {r[-1] for r in got} <= set(range(8))
    assert len({r[1] for r in got}) > 20 and len(set(ids) & set(range(60))) > 20
