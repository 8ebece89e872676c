"""Each operator against brute force or an exact round trip, and on awkward rows: nulls, blanks, ties, repeats, clashing columns."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotline.llm import chat_format, decontaminate, html_text, licenses, mixing, near_dedup, quality_model, quality_rules, sharding, warc
from shotline.llm.common import word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(t):
    return [w.decode() for w in (t or "").encode().split()]


def awkward():
    rng = random.Random(5)
    vocab = [f"w{k}é" for k in range(300)] + ["the", "of", "and", "is"] * 10
    body = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = body(120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \n\t ", "en", "a", 4), (3, "two words", "en", "b", 9), (4, "two words", "en", None, 9),
        (5, base, "en", "a", 1), (6, base.upper().lower(), "de", "a", 1), (7, " ".join(near), "en", "c", 1), (7, " ".join(near), "en", "c", 1),
        (8, body(30_000), "fr", "b", 5), (9, "x" * 200_000, "fr", "b", 5), (None, base, "en", "a", 1), (10, "same line\n" * 80, "en", "d", 7),
    ]
    return rows + [(k, body(60 + k % 90), "en", f"s{k % 3}", k) for k in range(11, 60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = awkward()
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def brute_rules(t):
    w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
    c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    cover = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(map((t or "").count, "#*$%&|<>")), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(docs, empty):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in quality_rules.with_rules(docs.withColumn("kept", F.lit("clash"))).collect():
        assert tuple(r[n] for n in names) == brute_rules(r["text"])
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns and kept.count() > 10
    assert quality_rules.with_rules(empty).count() == 0


def brute_near(rows):
    def shingles(t):
        w = [x.decode() for x in (t or "").encode().lower().split()]
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])

    sets = {d: shingles(t) for d, t, *_ in rows if d is not None}
    root = {d: d for d in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return {d: (len(sets[d]), root[d]) for d in ids}


def test_near_duplicates(spark, docs, empty):
    rows = [tuple(r) for r in docs.collect()]
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z aa bb cc dd ee ff gg hh ii jj kk ll mm nn".split()
    rows += [(100 + k, " ".join(base[: 40 - k % 7] + [f"tail{k // 7}"] * (k % 2)), "en", "z", 1) for k in range(40)]
    more = spark.createDataFrame(rows, DOCS)
    want = brute_near(rows)
    got = near_dedup.near_duplicates(more.withColumn("node", F.lit(1)).withColumn("id", F.lit(2))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    left = near_dedup.dedup_filter(more)
    assert left.columns == more.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(d for d, *_ in rows if d is None or want[d][1] == d)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 103), (103, 102)]
    got = {r["node"]: r["root"] for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 104)}


def test_word_hashes_tell_anagrams_apart():
    hashes, first = word_hashes([b"heor orhe", b"", b"HEOR  x"])
    assert list(first) == [0, 2, 2, 4] and hashes[0] != hashes[1] and hashes[0] == hashes[2]


def test_masks_find_every_window_with_two_substitutions():
    from itertools import combinations

    for gone in combinations(range(decontaminate.WINDOW), 2):
        assert any(not any(s + m in gone for m in mask) for mask in decontaminate.MASKS for s in range(decontaminate.WINDOW - mask[-1]))


def test_decontamination(spark, docs, empty):
    rng = random.Random(2)
    item = [f"q{k}" for k in range(40)]
    swapped = list(item)
    for k in range(3, 40, 7):
        swapped[k] = f"other{k}"
    filler = lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item)), (3, None), (4, "too short"), (5, "six words make one small item"), (None, filler(30))], "item_id long, text string")
    rows = [(200, f"{filler(50)} {' '.join(swapped).upper()}!! {filler(20)}"), (201, f"{filler(9)} six words make one small item."), (202, " ".join(item[:13])), (203, " ".join(item[:9]) + filler(40)), (None, " ".join(item))]
    more = docs.unionByName(spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], DOCS))
    for block in (decontaminate.BLOCK_WORDS, 30):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(more, bench, block_words=block).collect()}
        assert got == {(200, 1), (201, 5), (202, 1), (None, 1)}
    kept = decontaminate.decontamination_filter(more, bench)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in docs.collect()) + Counter([203])
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(more, bench.limit(0)).count() == 0


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards(spark, docs, empty, shards):
    many = spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 4000").unionByName(docs.filter("doc_id IS NULL OR doc_id < 8"))
    rows = sharding.kd_shards(many.withColumn("size", F.lit(0)), shards=shards).collect()
    text = {(r["doc_id"], zlib.crc32((r["text"] or "").encode())) for r in many.collect()}
    assert {(r["doc_id"], r["text_crc32"]) for r in rows} == text and len(rows) == many.count()
    load = Counter()
    for s in range(shards):
        own = [r for r in rows if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        load[s] = sum(r["size"] for r in own)
    assert max(load.values()) - min(load.values()) <= 2 * 4001
    placed = sharding.with_shard(many, shards=shards)
    assert placed.columns == [*many.columns, "shard"]
    assert Counter(r["shard"] for r in placed.collect()) == Counter(r["shard"] for r in rows)
    assert sharding.kd_shards(empty, shards=shards).count() == 0


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, out = share * sum(sizes.values()), {}
    while len(out) < len(names):
        free = [s for s in names if s not in out]
        left = total - sum(out.values())
        part = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s: float(most * sizes[s]) for s in free if part[s] > most * sizes[s]}
        out |= over or part
    return out


def test_mix(spark, docs, empty):
    many = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "big").otherwise(F.col("source"))).unionByName(docs.filter("doc_id IS NULL OR doc_id <> 8").withColumn("doc_id", F.col("doc_id") + 1000)).cache()
    rows = many.select("doc_id", "source", "text").collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    want = brute_targets(sizes)
    got = mixing.mix(many).join(many.select("doc_id", "source").distinct(), "doc_id", "left").collect()
    taken, seen = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        if r["doc_id"] is not None:
            seen[r["source"]] = (r["source_size"], r["target"])
        taken[r["source"]] += r["taken"]
    for s, (size, target) in seen.items():
        assert size == sizes[s] and target == pytest.approx(want[s])
        assert abs(taken[s] - target) <= max(40, 0.02 * target) or s in ("a", None)  # the row without an id joins no source here
    again = sorted((r["doc_id"] or -1, r["taken"]) for r in mixing.mix(many.repartition(5)).collect())
    assert again == sorted((r["doc_id"] or -1, r["taken"]) for r in mixing.mix(many).collect())
    out = mixing.mixed(many)
    assert out.columns == many.columns and out.count() > 0
    assert mixing.mix(empty).count() == 0


def test_mix_deals_hot_groups_by_block(spark):
    """A source and size with most of all rows goes to several blocks, and every row comes back once."""
    copies = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("one two three four five").alias("text"), F.lit("hot").alias("source"))
    other = spark.range(6000, 6400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"), F.lit("cold").alias("source"))
    got = mixing.mix(copies.union(other)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(6400))
    for source in (True, False):
        part = [r for r in got if (r["doc_id"] < 6000) == source]
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 0.01 * part[0]["target"]
        assert all(0 <= r["copies"] <= 2 for r in part)


def test_quality_model(spark, docs, empty):
    base = "/root/testdata/sf0.01"
    text, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality_model.train(text, labels.filter(~held), F.col("quality"))
    rows = quality_model.score(text, model).join(labels.filter(held), "doc_id").collect()
    assert np.mean([(r["score"] >= 0.3) == r["quality"] for r in rows]) > 0.9
    assert all(r["score"] >= 0.3 for r in rows if r["quality"] == 1)
    scores = [r["score"] for r in quality_model.score(docs.withColumn("id", F.lit(1)), model).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    one = quality_model.train(text, labels.filter("quality = 1"), F.col("quality"))
    assert quality_model.score(text.limit(1), one).first()["score"] == pytest.approx(1, abs=1e-6)
    assert quality_model.score(empty, quality_model.train(empty, labels.limit(0), F.col("quality"))).count() == 0


def brute_licence(t):
    best, hits = None, 0
    norm = re.sub(r"[^\w\n]+|_+", " ", (t or "").lower())
    for at, unit in enumerate([norm, *norm.split("\n")]):
        w = unit.split()
        own = {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}
        found = [(-2 * len(own & set(b)) / (len(own) + len(b)), n, at) for n, x in licenses.TEMPLATES.items() if own and (b := licenses.bigrams(x))]
        if found and min(found)[0] <= -licenses.THRESHOLD:
            hits += 1
            best = min(best or min(found), min(found))
    return (best[1], -best[0], best[2], hits) if best else (None, 0.0, None, 0)


def test_licence_scan(spark, docs, empty):
    rows = [(300, licenses._MIT, "en", "a", 1), (301, "text\nReleased under the MIT License.\nmore", "en", "a", 1), (302, licenses._BSD_HEAD.replace("\n", " ") + " " + licenses._BSD_TAIL.replace("\n", " "), "en", "a", 1), (303, "Released under the FOO License", "en", "a", 1), (304, "\n\n".join([licenses._MIT] * 30), "en", "a", 1)]
    more = docs.unionByName(spark.createDataFrame(rows, DOCS)).unionByName(spark.read.parquet(f"{SF}/documents.parquet"))
    text = {r["doc_id"]: r["text"] for r in more.filter("doc_id >= 300").collect()}
    for r in licenses.licence_scan(more).collect():
        if r["doc_id"] in text:
            name, score, unit, hits = brute_licence(text[r["doc_id"]])
            assert (r["license"], r["unit"], r["n_hits"]) == (name, unit, hits) and r["score"] == pytest.approx(score)
    assert licenses.licence_scan(empty).count() == 0


def test_preference_pairs(spark):
    turns = [(0, 0, "system", "s"), (0, 1, "user", "hi <|im_end|>"), (0, 2, "assistant", "good"), (1, 0, "system", "s"), (1, 1, "user", "hi <|im_end|>"), (1, 2, "assistant", "bad"), (1, 3, "user", "why"), (2, 0, "user", None), (4, 0, None, "x"), (5, 0, None, "x"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit(1))
    c = F.col("conv_id")
    got = {r["pair_id"]: r for r in chat_format.preference_pairs(df, F.floor(c / 2), c % 2 == 0).collect()}
    assert set(got) == {0, 1, 2}
    r = got[0]
    assert r["n_common"] == 2 and r["prompt"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nhi < |im_end|><|im_end|>\n"
    begin, end = map(int, r["chosen_mask"].split(":"))
    assert r["chosen"][begin:end] == "good<|im_end|>" and r["rejected_mask"].count(":") == 1 and r["rejected"].endswith("why<|im_end|>\n")
    assert got[1]["rejected"] is None and got[1]["rejected_id"] is None and got[1]["chosen"] == "<|im_start|>user\n<|im_end|>\n" and got[1]["chosen_mask"] == ""
    assert got[2]["n_common"] == 1 and got[2]["chosen"] == "" == got[2]["rejected"]
    assert chat_format.preference_pairs(df.limit(0), F.floor(c / 2), c % 2 == 0).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big, small = "<p>ü" + "z" * 200, "tiny"
    rows = [(k, f"http://x/{k}\n", big if k % 3 == 0 else f"<p>{k}" + "y" * (k * 7)) for k in range(1, 60)]
    rows += [(70, "u", small), (71, None, small), (72, "u", None), (3, "http://x/3\n", big), (None, "n", big), (10**12, "far", "q" * 5000), (73, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(4)
    names = []
    for k in range(2):
        folder = f"file://{tmp_path}/w{k}"
        manifest = warc.write_warc(pages.repartition(3 + k), folder, shard_bytes=4000, roll_bytes=1500)
        names.append({f["name"]: (tmp_path / f"w{k}" / f["name"]).read_bytes() for f in manifest})
        assert all(hashlib.sha256(names[k][f["name"]]).hexdigest() == f["sha256"] for f in manifest) and not list((tmp_path / f"w{k}").glob("_tmp*"))
    assert names[0] == names[1] and len(names[0]) > 3
    assert len(json.loads((tmp_path / "w0/manifest.json").read_text())["files"]) == len(names[0])
    got = warc.read_warc(spark, f"file://{tmp_path}/w0").collect()
    want = Counter((d, hashlib.sha256((h or "").encode()).hexdigest(), len((h or "").encode())) for d, _, h in rows)
    assert Counter((r["page_id"], r["payload_digest"], r["payload_bytes"]) for r in got) == want
    revisits = [r for r in got if r["record_type"] == "revisit"]
    assert all(r["refers_to"] == 3 for r in revisits) and len(revisits) == sum(h == big for *_, h in rows) - 1
    assert all(r["payload"] is None if r["record_type"] == "revisit" else hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in got)
    assert warc.write_warc(pages.limit(0), f"file://{tmp_path}/none") == [] and warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>one<p>two", "one\n\ntwo"), ("a<br>b", "a\nb"), ("<b>bold <i>both</b> tail", "bold both tail"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"), ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"), ("<div hidden>no</div><div style='display:none'>no</div>yes", "yes"),
        ("<head><title>t</title></head><script>if(a<b){}</script><p>in", "in"), ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a   | bb\nccc | d"), ("<pre>a  b\n c</pre>", "a  b\n c"),
        ("x<!-- <p>no</p> -->y", "xy"), ("<h1>T</h1>body", "T\n\nbody"), ("<dl><dt>k<dd>v</dl>", "k\n    v"), ("<table><tr><th colspan=2>h<tr><td>1<td>2</table>", "h\n1 | 2"), ("<p>unclosed <a href='x>y", "unclosed <a href='x>y"),
        ("<blockquote>q</blockquote>", "> q"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("<div>" * 5000 + "deep", "deep"),
    ],
)
def test_html(page, text):
    assert html_text.render(page) == text


def test_html_over_a_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (2, "u", None), (None, None, "<li>x")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert Counter(tuple(r) for r in html_text.extract_text(pages).collect()) == Counter({(1, "a"): 2, (2, ""): 1, (None, "- x"): 1})
    assert html_text.extract_text(pages.limit(0)).count() == 0
    for r in html_text.extract_text(spark.read.parquet(f"{SF}/pages.parquet")).collect():
        assert r["text"] and "<p>" not in r["text"] and "track(" not in r["text"]


def test_licence_in_longer_text(spark):
    rng = random.Random(3)
    body = lambda n: "\n".join(" ".join(f"f{rng.randrange(10**6)}" for _ in range(10)) for _ in range(n // 10))
    wrapped = {"mit-text": licenses._MIT, "isc": licenses._ISC, "apache-2.0-header": licenses._APACHE, "gpl-3.0-header": licenses._GPL3, "bsd-2-clause": f"{licenses._BSD_HEAD}\n{licenses._BSD_TAIL}", "gpl-2.0-text": licenses.TEMPLATES["gpl-2.0-text"], "apache-2.0-text": licenses.TEMPLATES["apache-2.0-text"]}
    rows = [(k, f"{body(20)}\n{t.strip()}\n{body(120 if k in (1, 3) else 9000)}", n, 3, 1 + (n == "apache-2.0-text")) for k, (n, t) in enumerate(wrapped.items())]
    # the notice within the full Apache text is a line of its own
    rows.append((50, f"{body(40)} by Ana. Released under the MIT License. See the annex {body(40)}", "mit", 4, 1))
    rows.append((51, "\n".join(f"{body(300)}\n{licenses._MIT.replace('persons', 'people')}" for _ in range(3)), "mit-text", 31, 3))
    rows.append((52, f"{body(300)}\nReleased under\nthe MIT\nLicense.\n{body(90)}\n{licenses._APACHE}", None, None, 2))
    rows.append((53, body(300) + "\nReleased under the FOO License of the MIT\n" + body(30), None, None, 0))
    docs = spark.createDataFrame([(k, t) for k, t, *_ in rows], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.licence_scan(docs).collect()}
    for k, _, name, unit, hits in rows:
        if k == 52:  # two notices, both verbatim
            assert (got[k]["license"], got[k]["score"], got[k]["n_hits"]) == ("apache-2.0-header", 1, hits)
        else:
            assert (got[k]["license"], got[k]["unit"], got[k]["n_hits"]) == (name, unit, hits), (k, got[k])
    assert all(got[k]["score"] == 1 for k in range(len(wrapped))) and got[50]["score"] == 1


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds", "so x=2 holds"), ("<math><semantics><mi>y</mi><annotation encoding=tex>\\y</annotation></semantics></math>", "y"),
        ("a <svg><title>t</title><desc>d</desc><defs><text>no</text></defs><rect/><g><text x=1>one <tspan>two</tspan></text><text>three</text></g></svg> b", "a one two three b"),
        ("<svg><defs/><path d='M0'/><foreignObject><p>in</p></foreignObject></svg><svg/>out", "in\n\nout"), ("<svg><text>a</text><p>b", "a\n\nb"),
        ("Pick <select><option>red<option selected>blue<optgroup label=Dark><option>black</select> now", "Pick\nred\nblue\nDark\nblack\nnow"),
        ("Say <textarea>\nhi &amp; <b>\n  you</textarea> end", "Say\nhi & <b>\n  you\nend"), ("<datalist><option>no</datalist>yes", "yes"),
    ],
)
def test_html_shows_formulas_drawings_and_forms(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<table><tr><td>{'x' * 60}<td>b<tr><td>c<td>d</table>", f"{'x' * 60} | b\nc{' ' * 59} | d"),
        ("<table><tr><td rowspan=2>aa<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>", "aa | b | c\n   | d | e\nf  | g | h"),
        ("<table><tr><td>a<td rowspan=0>bb<td>c<tr><td>d<td>e<tbody><tr><td>f<td>g<td>h</table>", "a | bb | c\nd |    | e\nf | g  | h"),
        ("<table><tr><td rowspan=3 colspan=2>w<td>x<tr><td>y<tr><td>z<tr><td>11<td>22<td>33</table>", "w       | x\n   |    | y\n   |    | z\n11 | 22 | 33"),
    ],
)
def test_html_columns_of_wide_and_tall_cells(page, text):
    assert html_text.render(page) == text


@pytest.mark.parametrize("n", range(5, 13))
def test_short_items_with_substitutions(n):
    """Every choice of substitutions that leaves 80% of a short item is found, and none beyond."""
    from itertools import combinations
    from math import ceil

    item = [f"i{k}" for k in range(n)]
    held = lambda w: decontaminate._words([" ".join(w)])[0].view(np.int64)
    index = decontaminate.Index([{"item_id": 1, "item_words": n, "hashes": held(item)}, {"item_id": 2, "item_words": 40, "hashes": held([f"k{k}" for k in range(40)])}])
    most = n - ceil(decontaminate.SHARE * n)
    for m in range(most + 2):
        gone = list(combinations(range(n), m))
        texts = [" ".join(["x"] * 7 + [f"o{k}" if k in g else w for k, w in enumerate(item)] + ["y"] * 3) for g in gone]
        found = {(t, b, e) for t, _, b, e, *_ in decontaminate.overlaps(index, *decontaminate._words(texts))}
        assert found == ({(t, 7, 7 + n) for t in range(len(texts))} if m <= most else set())
