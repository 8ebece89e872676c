"""Near-duplicates, decontamination, mixing, the quality model, WARC and chat pairs against brute force on awkward rows."""

import random
import time
from collections import Counter
from math import ceil

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shotline.llm import chat_format, common, decontaminate, mixing, near_dedup, quality_model, queries, warc

from .test_operators import SF, brute_near, words

TEXTS = "doc_id long, text string"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(str(r[c]) for c in names) for r in got.collect()) == sorted(tuple(map(str, r)) for r in cur.fetchall())


def test_a_repeated_id_loses_no_text(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (9, b), (9, ""), (11, ""), (None, a)], TEXTS)
    got = near_dedup.near_duplicates(docs).select("doc_id", "component_id").collect()
    assert {tuple(r) for r in got} == {(3, 3), (5, 3), (9, 3), (11, 11), (None, None)}
    left = near_dedup.dedup_filter(docs)
    assert Counter(map(tuple, left.collect())) == Counter([(3, a), (5, b), (9, ""), (11, ""), (None, a)])
    again = spark.createDataFrame([(1, a)] * 5 + [(2, a), (2, b)], TEXTS)
    assert Counter(map(tuple, near_dedup.dedup_filter(again).collect())) == Counter([(1, a), (2, b)])


def test_boilerplate_gives_few_pairs_and_loses_no_link(spark, monkeypatch):
    """Documents around one boilerplate, nearly alike: pairs grow with their number; copies among them are found."""
    core = [f"c{k}" for k in range(400)]
    own = lambda k: [f"o{k}_{j}" for j in range(45)]
    rows = [(k, " ".join(core + own(k))) for k in range(240)]
    rows += [(1000 + k, " ".join(core + [w if j != 20 else "changed" for j, w in enumerate(own(k))])) for k in (7, 130)]
    rows += [(2000, " ".join(core[:398] + ["x"])), (2001, " ".join(core[1:] + ["y"]))]
    seen, confirmed = [], near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, *more: seen.append(pairs.count()) or confirmed(pairs, *more))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, TEXTS)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_near(rows)
    assert sum(seen) < 32 * len(rows)  # of 29,646 pairs, which nearly all share a bucket


def test_recall(spark):
    """Of 400 pairs at similarities of 0.85 to 0.95, from 15 to 600 shingles, at least 99% are linked, and none under 0.85."""
    rng, rows, want = random.Random(8), [], []
    for k in range(500):
        n = rng.choice([15, 30, 60, 120, 300, 600])
        extra = rng.randint(0, n // 5)
        a = [f"p{k}_{j}" for j in range(n + 4)]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(a + [f"e{k}_{j}" for j in range(extra)]))]
        want.append(100 * n >= 85 * (n + extra))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, TEXTS)).collect()}
    linked = [got[2 * k + 1] == 2 * k for k in range(500)]
    assert all(w for w, x in zip(want, linked, strict=True) if x) and sum(linked) >= 0.99 * sum(want)


def brute_overlap(doc, item):
    w = min(decontaminate.WINDOW, len(item))
    good = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) >= ceil(decontaminate.SHARE * w)
    return w > 0 and any(good(doc[i : i + w], item[j : j + w]) for i in range(len(doc) - w + 1) for j in range(len(item) - w + 1))


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(30)]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(line(n))) for k, n in enumerate([2, 3, 4, 5, 6, 8, 9, 11, 12, 13, 14, 20, 30])]
    docs = [(k, line(rng.randint(0, 60))) for k in range(60)]
    for k, text in items:
        for changes in (0, 1, 2, 3):
            part = [w if rng.random() > changes / len(text.split()) else "new" for w in text.split()]
            docs.append((100 + 10 * k + changes, line(9) + part + line(4)))
    table, bench = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], TEXTS), spark.createDataFrame(items, "item_id long, text string")
    want = {(d, k) for d, w in docs for k, text in items if brute_overlap(w, text.split())}
    got = decontaminate.contaminated(table, bench).select("doc_id", "item_id").collect()
    assert Counter(map(tuple, got)) == Counter(want) and len(want) > 30
    left = decontaminate.decontamination_filter(table.withColumn("hit", F.lit(1)), bench, block_words=60)
    assert left.columns == ["doc_id", "text", "hit"] and {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert {r["item_id"] for r in decontaminate.contaminated(table, bench, least_words=5).select("item_id").collect()} <= {k for k, t in items if len(t.split()) > 4}


def test_a_phrase_of_many_items_is_cheap():
    hashes = lambda text: decontaminate._words([text])[0].view(np.int64)
    phrase = "which of the following is true"
    index = decontaminate.Index([{"item_id": k, "item_words": 26, "hashes": hashes(f"{' '.join(f'i{k}_{j}' for j in range(10))} {phrase} {' '.join(f'j{k}_{j}' for j in range(10))}")} for k in range(400)])
    text = " ".join(f"w{k} x{k} y{k} {phrase}" for k in range(1000))
    began = time.process_time()
    assert decontaminate.overlaps(index, *decontaminate._words([text])) == []
    assert time.process_time() - began < 8  # 400,000 places for each mask that lies in the phrase


def test_an_item_longer_than_a_segment(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", 30)
    item = [f"q{k}" for k in range(200)]
    docs = spark.createDataFrame([(k, " ".join(["a"] * 5 + item[k : k + 13] + ["b"] * 5)) for k in range(0, 187, 11)], TEXTS)
    got = decontaminate.contaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == set(range(0, 187, 11))


def test_mixed_meets_its_targets_with_repeated_rows(spark):
    rows = [(k, " ".join(["w"] * (k % 37 + 1)), "pqr"[k % 3], j) for k in range(300) for j in range(3 if k % 3 == 1 else 1)]
    rows += [(1, None, "a", 0), (1, "a", None, 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    plan = {r["source"]: r["target"] for r in mixing.mix(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").filter("doc_id > 1").collect()}
    out = mixing.mixed(docs)
    got = out.collect()
    taken = Counter()
    for r in got:
        taken[r["source"]] += len(words(r["text"]))
    assert out.columns == docs.columns and set(map(tuple, got)) <= set(rows)
    assert all(abs(taken[s] - plan[s]) <= 40 for s in "pqr")
    assert max(Counter(map(tuple, got)).values()) <= 2 * 2
    many = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("one two").alias("text"), F.when(F.col("id") >= 0, "a").alias("source"))
    many = many.union(spark.range(1, 100).select("id", F.lit("x y z"), F.lit("b")))
    size = Counter()
    for r in mixing.mixed(many).collect():
        size[r["source"]] += len(words(r["text"]))
    goal = {r["source_size"]: r["target"] for r in mixing.mix(many).collect()}
    assert abs(size["a"] - goal[6000]) <= 4 and abs(size["b"] - goal[297]) <= 6


def brute_rates(sizes, target, most=2.0):
    """Bisection on the tilt of one source."""
    x = np.array(sizes, float) / np.mean(sizes)
    rate = lambda tilt: np.minimum(np.exp(np.minimum(tilt * x, 700)), most)
    low, high = -1e4, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (rate(mid) * sizes).sum() < target else (low, mid)
    return rate(high)


def test_rates_are_those_of_bisection(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.randint(1, 200)), "abc"[k % 3]) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    for s in "abc":
        own = [k for k, _, source in rows if source == s]
        want = brute_rates([got[k]["size"] for k in own], got[own[0]]["target"])
        assert np.allclose([got[k]["rate"] for k in own], want, atol=1e-4)
        assert abs(sum(got[k]["taken"] for k in own) - got[own[0]]["target"]) <= 200


def test_descent_reaches_the_optimum():
    """The hinge loss's primal and dual values nearly meet, so the solution is that of the convex problem."""
    rng = np.random.default_rng(3)
    rows = [np.unique(np.concatenate([rng.integers(0, 400, 12), rng.integers(400, 430, 4) + 30 * (k % 2)])).astype(np.int32) for k in range(200)]
    y = np.array([k % 2 if rng.random() > 0.05 else 1 - k % 2 for k in range(200)])
    model = quality_model.fit(rows, y, np.zeros(200, bool))
    ratio = np.zeros(quality_model.SLOTS)
    for sign in (1, 0):
        own = [r for r, v in zip(rows, y, strict=True) if v == sign]
        count = np.bincount(np.concatenate(own), minlength=quality_model.SLOTS) + quality_model.SMOOTH
        ratio += (1 if sign else -1) * np.log(count / (len(own) + 2 * quality_model.SMOOTH))
    x = np.zeros((200, quality_model.SLOTS), np.float32)
    for k, r in enumerate(rows):
        x[k, r] = ratio[r] / np.sqrt(len(r))
    used = np.flatnonzero(np.abs(x).sum(axis=0))
    x = np.concatenate([x[:, used], np.ones((200, 1))], axis=1)
    sign = np.where(y > 0, 1.0, -1.0)
    cost = np.where(y > 0, *(quality_model.COST * 200 / (2 * (y == v).sum()) for v in (1, 0)))
    w = np.append(model.weights[used] / np.where(ratio[used] == 0, 1, ratio[used]), model.bias)
    primal = lambda v: (v @ v) / 2 + (cost * np.maximum(0, 1 - sign * (x @ v))).sum()
    best, at = primal(w), np.zeros(len(w))
    for step in range(1, 6000):  # plain subgradient descent from nothing
        at = at - 1.0 / (step + 10) * (at - ((cost * sign * (sign * (x @ at) < 1)) @ x))
    assert best <= primal(at) * 1.02


def test_training_is_bounded_by_rows_and_slots(spark):
    text = lambda k: " ".join(f"{'good' if k % 2 else 'bad'}{j % (5 + k % 7)}" for j in range(30))
    docs = spark.createDataFrame([(k, text(k)) for k in range(60)] + [(1, text(1))] * 500 + [(3, "")], TEXTS)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(2, 1), (None, 1), (4, None)], "doc_id long, quality int")
    seen, whole = [], quality_model.fit
    quality_model.fit = lambda rows, *more: seen.append((len(rows), sum(map(len, rows)))) or whole(rows, *more)
    try:
        for limit in ({}, {"most_rows": 10}, {"most_slots": 1500}):
            model = quality_model.train(docs, labels, F.col("quality"), **limit)
            assert quality_model.score(docs, model).count() == docs.count()
    finally:
        quality_model.fit = whole
    assert seen[0][0] == 60 and seen[1][0] == 10 and seen[2][1] <= 1500


def test_warc_of_wide_ids_and_large_pages(spark, tmp_path):
    rows = [(5, f"u{k}", f"<p>{k}" + "y" * 300) for k in range(40)] + [(None, f"n{k}", f"<b>{k}" + "z" * 300) for k in range(40)]
    rows += [(6, "big", "q" * 50_000), (-(2**63), "low", "l" * 200), (2**63 - 1, "high", "h" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_warc(pages, f"file://{tmp_path}/w", shard_bytes=3000, roll_bytes=2000)
    assert len({f["shard"] for f in manifest}) > 8
    got = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert Counter((r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in got) == Counter(rows)
    (tmp_path / "w" / "_tmp-left-part").write_bytes(b"x")
    warc.write_warc(pages, f"file://{tmp_path}/w", shard_bytes=3000, roll_bytes=2000)
    assert not list((tmp_path / "w").glob("_tmp*"))


def test_reading_is_linear_in_records():
    took = []
    for n in (3_000, 30_000):
        data = b"".join(warc._record([("WARC-Type", "warcinfo"), ("N", k)], b"x") for k in range(n))
        began = time.process_time()
        assert sum(1 for _ in warc.records(data)) == n
        took.append(time.process_time() - began)
    assert took[1] < 25 * took[0] + 0.2
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records(data[:-9]))


def brute_pair(chosen, rejected):
    clean = lambda t: (t or "").replace("<|", "< |")
    said = lambda t: f"<|im_start|>{clean(t[1])}\n{clean(t[2])}<|im_end|>\n"
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n][1:] == rejected[n][1:]:
        n += 1
    out = [n, "".join(map(said, chosen[:n]))]
    for turns in (chosen, rejected):
        text, mask = "", []
        for t in turns[n:]:
            head = len(f"<|im_start|>{clean(t[1])}\n")
            if t[1] == "assistant":
                mask.append(f"{len(text) + head}:{len(text) + len(said(t)) - 1}")
            text += said(t)
        out += [text, ",".join(mask)]
    return out


def test_pairs_against_brute_force(spark):
    rng = random.Random(9)
    sides = {(p, c): [(k // 2 if p % 5 == 0 else k, rng.choice(["user", "assistant", "system"]), rng.choice(["", "é<|x", "two words", "z"])) for k in range(rng.randint(1, 7))] for p in range(40) for c in (0, 1)}
    for p in range(0, 40, 2):
        keep = rng.randint(0, len(sides[p, 0]))
        sides[p, 1] = sides[p, 0][:keep] + [(k + 50, r, t) for k, r, t in sides[p, 1]]
    rows = [(2 * p + c, c == 0, *t) for (p, c), turns in sides.items() for t in turns]
    df = spark.createDataFrame(rows, "conv_id long, is_chosen boolean, turn long, role string, text string").repartition(3)
    got = chat_format.preference_pairs(df, F.floor(F.col("conv_id") / 2), F.col("is_chosen")).collect()
    assert len(got) == 40
    for r in got:
        want = brute_pair(*(sorted(sides[r["pair_id"], c]) for c in (0, 1)))
        assert [r["n_common"], r["prompt"], r["chosen"], r["chosen_mask"], r["rejected"], r["rejected_mask"]] == want


def test_the_query_shares_history(spark):
    rows = queries.op8_preference_pairs(spark, SF).collect()
    answered = [r for r in rows if r["rejected_id"] is not None]
    assert answered and all(r["n_common"] > 0 and r["prompt"] for r in answered)


def test_long_conversations_cost_their_length(spark):
    took = []
    for n in (4_000, 32_000):
        turns = spark.range(n).select(F.lit(0).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("text").alias("text"))
        began = time.time()
        r = chat_format.preference_pairs(turns, F.lit(0), F.lit(True)).first()
        took.append(time.time() - began)
        assert r["chosen_mask"].count(":") == n // 2
    assert took[1] < 8 * took[0] + 2


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="share"):
        common.shared_dir(Session)
