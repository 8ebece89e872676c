"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import RULES, STOP_WORDS

#: The words of a text column ``text``.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _rule(r) -> str:
    x = f"(CASE WHEN {r.under} > 0 THEN {r.over}::DOUBLE / {r.under}::DOUBLE ELSE 0.0 END)"
    return " AND ".join([f"{x} >= {r.low!r}"] * (r.low is not None) + [f"{x} <= {r.high!r}"] * (r.high is not None))


_STOP = ", ".join("'" + w + "'" for w in sorted({w for line in STOP_WORDS for w in line.split()}))

QUALITY_RULES_OF = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, * FROM {{table}}),
w AS (SELECT rid, {WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM d),
tok AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
win AS (SELECT rid, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM tok WINDOW o AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, word, b, c) AS n FROM win WHERE c IS NOT NULL) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) AS t(k) GROUP BY rid),
ws AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (WHERE lower(word) IN ({_STOP})) AS n_stop_words FROM tok GROUP BY rid),
ln AS (SELECT rid, unnest(l) AS line FROM w),
ls AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.*, coalesce(ws.n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, coalesce(n_stop_words, 0)::BIGINT AS n_stop_words,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
  (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[!?]+', '', 'g')))::BIGINT AS n_marks
  FROM d LEFT JOIN ws USING (rid) LEFT JOIN ls USING (rid) LEFT JOIN cov USING (rid)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT *, (NOT base_failed AND {" AND ".join(_rule(r) for r in RULES)}) AS kept FROM f
"""

QUALITY_RULES = f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({QUALITY_RULES_OF.format(table='documents')})"

#: Links by counts of shared shingles, components as what can be reached.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN c cx ON cx.doc_id = x.doc_id JOIN c cy ON cy.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, cx.n, cy.n HAVING 100 * count(*) >= 85 * (cx.n + cy.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept FROM documents d JOIN m USING (doc_id) LEFT JOIN c USING (doc_id)
"""

_CLEAN = "replace(coalesce({0}, ''), '<|', '< |')"
_SPANS = "coalesce(string_agg((b + length(head)) || ':' || (b + length(said) - 1), ',' ORDER BY i) FILTER (WHERE side = '{0}' AND i > n_common AND role = 'assistant'), '')"
_SAID = "coalesce(string_agg(said, '' ORDER BY i) FILTER (WHERE side = '{0}' AND i {1} n_common), '')"

PREFERENCE_PAIRS = f"""
WITH last AS (SELECT conv_id, max(turn) AS upto FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
reply AS (SELECT conv_id, upto, max(text) AS text FROM conversations JOIN last USING (conv_id) WHERE role = 'assistant' AND turn = upto GROUP BY conv_id, upto),
heads AS (SELECT r.conv_id AS pair_id, r.upto, p.conv_id AS other, p.text AS answer FROM reply r LEFT JOIN reply p ON p.conv_id = r.conv_id + 1),
sides AS (
  SELECT pair_id, other, 'c' AS side, turn, role, text FROM conversations JOIN heads ON conv_id = pair_id WHERE turn <= upto
  UNION ALL SELECT pair_id, other, 'r', turn, role, text FROM conversations JOIN heads ON conv_id = pair_id WHERE turn < upto AND other IS NOT NULL
  UNION ALL SELECT pair_id, other, 'r', upto, 'assistant', answer FROM heads WHERE other IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS i, concat('<|im_start|>', {_CLEAN.format("role")}, chr(10)) AS head,
  concat('<|im_start|>', {_CLEAN.format("role")}, chr(10), {_CLEAN.format("text")}, '<|im_end|>', chr(10)) AS said FROM sides),
m AS (SELECT x.pair_id, x.i, x.role IS NOT DISTINCT FROM y.role AND x.text IS NOT DISTINCT FROM y.text AS same FROM n x JOIN n y ON x.pair_id = y.pair_id AND x.i = y.i AND x.side = 'c' AND y.side = 'r'),
k AS (SELECT pair_id, coalesce(min(i) FILTER (WHERE NOT same) - 1, count(*)) AS n_common FROM m GROUP BY pair_id),
q AS (SELECT n.*, coalesce(n_common, 0)::BIGINT AS n_common FROM n LEFT JOIN k USING (pair_id)),
o AS (SELECT *, sum(length(said)) OVER (PARTITION BY pair_id, side, i > n_common ORDER BY i)::BIGINT - length(said) AS b FROM q)
SELECT pair_id, pair_id AS chosen_id, other AS rejected_id, n_common, {_SAID.format("c", "<=")} AS prompt, {_SAID.format("c", ">")} AS chosen, CASE WHEN other IS NOT NULL THEN {_SAID.format("r", ">")} END AS rejected,
  {_SPANS.format("c")} AS chosen_mask, CASE WHEN other IS NOT NULL THEN {_SPANS.format("r")} END AS rejected_mask
FROM o GROUP BY pair_id, other, n_common
"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""

#: Runs as maximal stretches of equal words ``q`` apart, for every ``q``; the checksum of an id bit by bit.
PERIODIC_RUNS = r"""
WITH c AS (SELECT doc_id, text, row_number() OVER () AS r, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS digits FROM documents),
h AS (SELECT r, doc_id, text, xor(4294967295::BIGINT, list_reduce(flatten(list_prepend([4294967295::BIGINT], list_transform(digits, lambda x: [x, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END) END)) AS h FROM c),
t AS (SELECT r, doc_id, coalesce(h, 1) AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM h),
u AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 AND h % 10 = 0 THEN (h // 10) % len(w) END AS a FROM t),
v AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM u),
x AS MATERIALIZED (SELECT r, n, i, w[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END] AS word FROM (SELECT r, n, w, a, p, unnest(range(n)) AS i FROM v)),
e AS (SELECT x.r, x.i, x.i - y.i AS q FROM x JOIN x y ON x.r = y.r AND x.word = y.word AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
l AS (SELECT r, q, min(i) - q AS s, max(i) + 1 AS e FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e) GROUP BY r, q, island),
m AS MATERIALIZED (SELECT r, s, e - s AS len, min(q) AS q FROM l WHERE e - s >= greatest(6, 4 * q) GROUP BY r, s, e),
o AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines, list({'s': s, 'len': len, 'q': q} ORDER BY len::DOUBLE / q DESC, s, q)[1] AS best FROM m GROUP BY r),
d AS (SELECT DISTINCT r, i FROM (SELECT r, unnest(range(s + q, s + len)) AS i FROM m)),
k AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN d USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.len::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.len // best.q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM v LEFT JOIN o USING (r) LEFT JOIN k USING (r)
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL_SEARCH = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM benchmark),
s AS (SELECT count(*) FILTER (WHERE len(t) > 0)::BIGINT AS n, sum(len(t))::BIGINT AS l FROM d),
p AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
g AS (SELECT i, term, count(*) AS c FROM (SELECT i, unnest(t) AS term FROM q) GROUP BY i, term),
m AS (SELECT r, doc_id, 25 + (75 * len(t) * n) // l AS m FROM d, s WHERE len(t) > 0),
x AS (SELECT i, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM g JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY i, r),
k AS (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM x JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k JOIN q USING (i) WHERE rank <= 10
"""
