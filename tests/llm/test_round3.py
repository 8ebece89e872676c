"""Suffix-array dedup, ranked search and periodic runs against brute force; awkward rows; costs of hostile texts."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotline.llm import decontaminate, html_text, induced_sort, lexical_search, licenses, periodic_runs, queries, suffix_dedup

from .test_operators import SF

TEXTS = "doc_id long, text string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


# -- suffix order and repeated passages ------------------------------------------------------------------------------


def shared_prefix(a, b, most):
    k = 0
    while k < min(most, len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


@pytest.mark.parametrize("levels", [0, 1, 2, 9])
def test_suffix_order(levels, monkeypatch, tmp_path):
    """Order and prefixes by induction equal a plain sort, with tuples in run files or not."""
    rng = random.Random(levels)
    monkeypatch.setattr(induced_sort, "LEVELS", levels)
    for turn in range(150):
        monkeypatch.setattr(induced_sort, "RANGE", rng.choice([4, 64, 1 << 12]))
        monkeypatch.setattr(induced_sort, "BATCH", rng.choice([8, 256]))
        top, text = rng.choice([1, 2, 3, 26]), []
        for _ in range(rng.randint(1, 8)):
            text += [rng.randint(1, top) for _ in range(rng.randint(0, 20))]
            if text and rng.random() < 0.6:
                at = rng.randrange(len(text))
                text += text[at : at + rng.randint(1, 80)]
            text += [rng.randint(1, top)] * (rng.randint(1, 40) if rng.random() < 0.2 else 0)
        held, depth = bytes(text or [1]), rng.choice([20, 100, 200])
        order, lcp = induced_sort.suffix_order(np.frombuffer(held, np.uint8), depth, f"file://{tmp_path}", rng.choice([8, 50, 1 << 22]))
        want = sorted(range(len(held)), key=lambda k: held[k:])
        assert [held[k : k + depth] for k in order] == [held[k : k + depth] for k in want] and sorted(order.tolist()) == sorted(want)
        assert lcp.tolist()[1:] == [shared_prefix(held[a:], held[b:], depth) for a, b in zip(want, want[1:], strict=False)]
    assert not list(tmp_path.iterdir())  # run files go with the queue
    assert induced_sort.suffix_order(np.zeros(0, np.uint8), 100)[0].size == 0
    with pytest.raises(ValueError, match="depth"):
        induced_sort.suffix_order(np.ones(3, np.uint8), 300)


def brute_repeats(rows, least):
    """(id, n_bytes, spans, kept) by a set of all strings; rows with an id first, by id, then those without."""
    seen, out = set(), []
    for at, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - least + 1):
            if b[s : s + least] in seen:
                gone[s : s + least] = b"\x01" * least
            seen.add(b[s : s + least])
        spans = [(m.start(), m.end()) for m in re.finditer(rb"\x01+", bytes(gone))]
        out.append((at, len(b), tuple(spans), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return Counter(out)


def repeats(df, **more):
    return Counter((r["doc_id"], r["n_bytes"], tuple(map(tuple, r["spans"])), bytes(r["kept_bytes"])) for r in suffix_dedup.without_repeats(df, **more).collect())


def test_repeats_of_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {at: (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for at, n, spans, kept in brute_repeats(rows, 100)}
    got = queries.op11_suffix_dedup(spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(rows) and any(w[1] for w in want.values())


@pytest.mark.parametrize("more", [{}, {"crowd": 1}, {"shard_bytes": 500, "resident": 64}])
def test_repeats_of_planted_passages(spark, more):
    """Passages at every offset, overlaps, edits, periodic and multibyte text, hot passages between different neighbours."""
    rng = random.Random(2)
    passage = words(rng, 60)
    rows = [(k, words(rng, rng.randint(0, 40)) + " " * (k % 3) + passage[rng.randint(0, 90) :][: rng.randint(50, 300)] + words(rng, rng.randint(0, 30))) for k in range(60)]
    rows += [(100, "a" * 700), (101, "b" + "a" * 150), (102, "ab" * 300), (103, "ñé漢🙂" * 60), (104, "x" + "ñé漢🙂" * 60), (105, passage + passage), (106, ""), (107, None), (108, "z" * 99), (109, "z" * 100), (110, "z" * 100)]
    df = spark.createDataFrame(rows, TEXTS).repartition(3)
    assert repeats(df, **more) == brute_repeats(rows, 100)
    assert repeats(df, least=40, **more) == brute_repeats(rows, 40)


def test_repeats_of_awkward_rows(spark):
    a, b = ("".join(random.Random(k).choices("abcdefgh ", k=300)) for k in (1, 2))
    rows = [(1, a), (1, a), (1, b), (None, a), (None, b), (2, ""), (2, None), (3, a[:99]), (3, a[:99])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TEXTS + ", spans string, doc long")
    got = repeats(df)
    assert sum(got.values()) == len(rows)
    kept = Counter(k[3] for k in got.elements())
    assert kept[a.encode()] == 1 and kept[b.encode()] == 1 and kept[a[:99].encode()] == 2 and got[(1, 300, ((0, 300),), b"")] == 1
    assert [k for k in got.elements() if k[0] is None] == [(None, 300, ((0, 300),), b"")] * 2
    assert suffix_dedup.without_repeats(df.limit(0)).count() == 0


def test_a_hot_passage_is_combined_before_the_shuffle(spark):
    """One passage in every document reaches the shuffle once a batch."""
    passage = words(random.Random(5), 80)
    df = spark.createDataFrame([(k, f"{passage} {k}") for k in range(500)], TEXTS).coalesce(1)
    made = df.select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("row"), "text").mapInArrow(suffix_dedup._combined(100), suffix_dedup.SEGMENTS)
    assert made.groupBy("key", "part").count().filter("count > 1").count() == 0
    spans = Counter((r["doc_id"] > 0, len(r["spans"])) for r in suffix_dedup.without_repeats(df).collect())
    assert spans == {(False, 0): 1, (True, 1): 499}


# -- ranked search ---------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k=10):
    terms = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(at, Counter(terms(t))) for at, t in docs]
    n, total = sum(1 for _, c in bags if c), sum(sum(c.values()) for _, c in bags)
    df = Counter(x for _, c in bags for x in c)
    out = Counter()
    for item, text in items:
        scores = []
        for at, c in bags:
            m = 25 + 75 * sum(c.values()) * n // total if c else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 8 * m)) for x in terms(text) if x in c)
            if s > 0:
                scores.append((-s, at is None, at or 0))
        out.update((item, r, None if none else at, -s) for r, (s, none, at) in enumerate(sorted(scores)[:k], 1))
    return out


@pytest.mark.parametrize(("part", "cluster", "first", "chars"), [(4096, 256, 4, 1 << 18), (40, 8, 1, 1 << 18), (64, 4, 2, 600)])
def test_search_equals_brute_force(spark, monkeypatch, part, cluster, first, chars):
    """With one cluster, and with a tree, parts in blocks, many clusters and blocks of items; ties by id."""
    for name, value in (("PART", part), ("CLUSTER", cluster), ("FIRST", first), ("BLOCK_CHARS", chars)):
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(part)
    vocabulary = [f"w{k}" for k in range(80)]
    text = lambda lo, hi: " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(80)], k=rng.randint(lo, hi)))
    docs = [(k, text(0, 60)) for k in range(400)]
    docs += [(1000 + k, docs[7][1]) for k in range(30)] + [(5, "W1, w2;w3_w4"), (5, "w1"), (5, "w1"), (None, docs[7][1]), (2000, None), (2001, " .;"), (2002, "É漢 w1É"), (2003, "w1 " * 5000)]
    items = [(k, text(1, 12)) for k in range(12)] + [(50, docs[7][1]), (51, "nowhere"), (52, ""), (None, "w1 w1 w2"), (53, None), (54, "é É漢"), (54, "w3")]
    d = spark.createDataFrame([(*r, 1) for r in docs], TEXTS + ", score int").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in lexical_search.search(d, q).collect())
    assert got == brute_search(docs, items)


def test_search_of_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a")], TEXTS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert [tuple(r) for r in lexical_search.search(d, q).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // (1000 + 800)))]
    assert lexical_search.search(d.limit(0), q).count() == 0 and lexical_search.search(d, q.limit(0)).count() == 0


def test_bisection_brings_like_documents_together():
    rng = np.random.default_rng(1)
    topic = rng.permutation(np.repeat(np.arange(8), 32))
    terms = np.concatenate([rng.choice(20, 12, replace=False) + 20 * t for t in topic])
    order = lexical_search.bisected(np.full(256, 12), terms, 3)
    assert sorted(order.tolist()) == list(range(256))
    pure = sum(np.bincount(topic[order[32 * k : 32 * k + 32]]).max() for k in range(8))
    assert pure > 200  # a random order gives about 64


# -- periodic runs ---------------------------------------------------------------------------------------------------


def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i - q, j), q)
            i = j + 1
    return sorted((s, t - s, q) for (s, t), q in out.items())


def repetitive(rng):
    top, w = rng.choice([1, 2, 2, 3, 5, 50]), []
    for _ in range(rng.randint(0, 6)):
        root = [rng.randrange(top) for _ in range(rng.randint(1, 8))]
        w += (root * 9)[: rng.randint(1, len(root) * 9)]
        if w and rng.random() < 0.3:
            at = rng.randrange(len(w))
            w += w[at : at + rng.randint(1, 60)]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(2500):
        w = repetitive(rng)
        assert periodic_runs.runs_of(w) == brute_runs(w)
        factors = periodic_runs.lz_factors(w)
        assert [x for b, e, _ in factors for x in w[b:e]] == w and all(s < 0 or (s < b and w[s : s + e - b] == w[b:e]) for b, e, s in factors)


def test_runs_of_documents(spark):
    rng = random.Random(3)
    lists = [[f"w{x}" for x in repetitive(rng)] for _ in range(120)] + [[], None, ["a"] * 5, ["a"] * 6, ["a", None] * 8, [f"n{k}" for k in range(2000)] * 5]
    df = spark.createDataFrame([(k % 7 or None, w, "y") for k, w in enumerate(lists)], "doc_id long, w array<string>, extra string").repartition(3)
    want = Counter()
    for k, w in enumerate(lists):
        w = [x or "" for x in w or []]
        runs = brute_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want[k % 7 or None, len(w), tuple(runs), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    got = periodic_runs.with_runs(df, F.col("w")).collect()
    assert Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in got) == want and got[0]["extra"] == "y"
    assert periodic_runs.with_runs(df.limit(0), F.col("w")).count() == 0
    with pytest.raises(ValueError, match="named as results"):
        periodic_runs.with_runs(df.withColumn("runs", F.lit(1)), F.col("w"))


def test_runs_of_awkward_ids(spark, tmp_path):
    """The query over null, repeated and negative ids, blank texts and ties."""
    rows = [(None, "a a a a a a a"), (0, None), (0, ""), (1, " \t\n"), (2, "a b a b a b a b c c c c c c c c"), (2, "a b a b a b a b c c c c c c c c"), (-5, "x y z " * 40), (9, "q " * 3000)]
    rows += [(k, words(random.Random(k), 60)) for k in range(10, 60)]
    spark.createDataFrame([(*r, 1) for r in rows], TEXTS + ", start int").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for at, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(at).encode()) if at is not None else 1
        if h % 10 == 0 and w:
            a = (h // 10) % len(w)
            p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[at, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    assert Counter(tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("w", [[1] * 30000, [1, 2, 3] * 10000, list(range(6000)) * 5])
def test_runs_take_linear_time(w):
    began = time.perf_counter()
    periodic_runs.runs_of(w)
    assert time.perf_counter() - began < 5


# -- hostile texts ---------------------------------------------------------------------------------------------------


def test_an_altered_licence_is_scanned_in_time(spark):
    """GPL-3.0 with every seventh word replaced (took 139 s) costs at most a few seconds more than two words."""
    took = []
    altered = " ".join("other" + str(k) if k % 7 == 6 else x for k, x in enumerate((licenses.TEXTS / "gpl-3.0.txt").read_text().split()))
    for text in ("a b", "a b", altered):
        began = time.perf_counter()
        licenses.licence_scan(spark.createDataFrame([(1, text)], TEXTS)).collect()
        took.append(time.perf_counter() - began)
    assert took[2] < took[1] + 5


def test_one_word_repeated_is_decontaminated_in_time(spark):
    docs = spark.createDataFrame([(1, "w " * 50_000), (2, "v " * 9), (3, "w " * 200)], TEXTS)
    items = spark.createDataFrame([(1, "w " * 300)], "item_id long, text string")
    began = time.perf_counter()
    got = decontaminate.contaminated(docs, items).collect()
    assert time.perf_counter() - began < 15
    # the longest overlap, the last of equal ones; the shorter text is inside the item
    assert {(r["id"] if "id" in r.asDict() else r["doc_id"], r["n_matched"]) for r in got} == {(1, 300), (3, 200)}


def test_spanned_columns_do_not_swell(spark):
    for page in ("<table><tr>" + "<td colspan=1000>a" * 4000, "<table>" + "<tr><td rowspan=9999 colspan=1000>a" * 2000, "<table><tr>" + "<td>abc" * 4000 + "<tr><td colspan=3999>a<td>b" * 2000, "<table><tr><td>" * 60 + "x" * 2000 + "<td>y" * 60):
        text = html_text.render(page)
        assert len(text) <= (html_text.PADDING + 1) * len(page) + html_text.SPARE
        assert Counter(re.sub(r"[\s|]", "", text)) == Counter(re.sub(r"<[^>]*>", "", page))
