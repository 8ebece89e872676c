"""DuckDB SQL of the motion search over pictures of 8 by 8 tiles of 20 pixels: an account of the kernel from outside, for the queries' oracle.

A pair of pictures is a row that walks through its groups of four blocks, a set of displacements at a time, by a recursive
query. Since pictures consist of tiles, a block's sum of differences is that of a few rectangles: those between the places where
a row or column of the block enters another tile of either picture. Slot 1 of a group's sums and vectors is the whole, slots 2 to 5 its
quarters; a quarter gets its own sum, but the vector of the slot before it, as the kernel has it.
"""

from __future__ import annotations

STRIDE = 288  # of a padded picture: 160 and 64 on either side


def _tile(x: str) -> str:
    return f"(greatest(0, least(159, ({x}) - 64)) // 20)"


def _ahead(x: str) -> str:
    """Pixels from ``x`` to the next tile, 16 at most."""
    return f"least(16, CASE WHEN ({x}) < 84 THEN 84 - ({x}) WHEN ({x}) >= 204 THEN 16 ELSE 20 - (({x}) - 64) % 20 END)"


def _parts(a: str, b: str) -> str:
    """Begin and width of the parts of 16 pixels that ``a`` and ``b`` cut them into."""
    low, high = f"least({a}, {b})", f"greatest({a}, {b})"
    return f"[{{'c': 0, 'w': {low}}}, {{'c': {low}, 'w': {high} - {low}}}, {{'c': {high}, 'w': 16 - {high}}}]"


def _sad(x: str, y: str, dx: str, dy: str) -> str:
    """The block at ``x``, ``y`` of ``cur`` against ``ref`` displaced; what lies left of a row is the end of the row above it."""
    columns = _parts(_ahead(x), f"(CASE WHEN {x} + {dx} < 0 THEN least(16, -({x} + {dx})) ELSE {_ahead(f'{x} + {dx}')} END)")
    over = f"(CASE WHEN {x} + {dx} + k.c < 0 THEN 1 ELSE 0 END)"
    rows = _parts(_ahead(y), _ahead(f"{y} + {dy} - {over}"))
    here = f"cur[{_tile(f'{y} + l.c')} * 8 + {_tile(f'{x} + k.c')} + 1]"
    there = f"ref[{_tile(f'{y} + {dy} + l.c - {over}')} * 8 + {_tile(f'{x} + {dx} + k.c + {STRIDE} * {over}')} + 1]"
    return f"list_sum(list_transform({columns}, lambda k: k.w * list_sum(list_transform({rows}, lambda l: l.w * abs({here} - {there})))))"


def _dev(x: str, y: str) -> str:
    cells = f"flatten(list_transform({_parts(_ahead(x), '16')}, lambda k: list_transform({_parts(_ahead(y), '16')}, lambda l: {{'w': k.w * l.w, 'p': cur[{_tile(f'{y} + l.c')} * 8 + {_tile(f'{x} + k.c')} + 1]}})))"
    return f"list_sum(list_transform({cells}, lambda z: z.w * abs(z.p - list_sum(list_transform({cells}, lambda u: u.w * u.p)) // 256)))"


def _median(a: str, b: str, c: str) -> str:
    return f"greatest(least({a}, {b}), least(greatest({a}, {b}), {c}))"


def _guess(f: str) -> str:
    left, up, corner = f"{f}[10 * gy + gx]", f"{f}[10 * gy - 10 + gx + 1]", f"{f}[10 * gy - 10 + gx + 2]"
    return f"(CASE WHEN gx = 1 AND gy = 1 THEN 0 WHEN gx = 1 THEN {up} WHEN gy = 1 THEN {left} ELSE {_median(left, up, corner)} END)"


def _back(bit: int, along: str, across: str, step: int) -> str:
    """The bit of a direction that leads back to where the search was already."""
    seen = [f"(h{across} = {q}{across} AND h{along} = {q}{along} + {step})" for q in ("z", "p")]
    return f"CASE WHEN {' OR '.join(seen)} THEN 0 ELSE {bit} END"


def motion(pixels: str, side: str) -> str:
    """CTEs that end in ``blocks`` (video_id, frame_number, mb_x, mb_y, mv_x, mv_y, sad16, dev). ``pixels`` has vec_id, label, i, px; ``side``: search radius."""
    cross = "[{'x': -2, 'y': 0, 'm': 1}, {'x': 2, 'y': 0, 'm': 2}, {'x': 0, 'y': -2, 'm': 4}, {'x': 0, 'y': 2, 'm': 8}]"
    aside = "[{'x': 0, 'y': 2, 'm': 8}, {'x': 0, 'y': -2, 'm': 4}]"
    along = "[{'x': 2, 'y': 0, 'm': 2}, {'x': -2, 'y': 0, 'm': 1}]"
    around = "[" + ", ".join(f"{{'x': {x}, 'y': {y}, 'm': 0}}" for x, y in ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))) + "]"
    whole = "list_sum({0})"
    sums = "list_transform([0, 1, 2, 3], lambda q: " + _sad("(16 * gx + 16 * (q % 2))", "(16 * gy + 16 * (q // 2))", "t.x", "t.y") + ")"
    inside = f"t.x BETWEEN greatest(-{side}, -16 * (gx + 1)) AND least({side} - 1, 160 - 16 * gx) AND t.y BETWEEN greatest(-{side}, -16 * (gy + 1)) AND least({side} - 1, 160 - 16 * gy)"
    slot = lambda k: f"list_min(list_transform(tried, lambda t: t.s[{k}]))"
    first = lambda k: f"list_filter(tried, lambda t: t.s[{k}] = {slot(k)})[1]"
    better = lambda k: f"(len(tried) > 0 AND {slot(k)} < best[{k}])"
    each = lambda yes, no: "[" + ", ".join(f"CASE WHEN {better(k)} THEN {yes(k)} ELSE {no(k)} END" for k in range(1, 6)) + "]"
    next_phase = "CASE phase WHEN 0 THEN CASE WHEN best[1] <= 200 THEN 9 WHEN ax <> 0 OR ay <> 0 THEN 1 WHEN best[1] > 500 THEN 2 ELSE 9 END WHEN 1 THEN CASE WHEN best[1] > 500 THEN 2 ELSE 9 END WHEN 2 THEN CASE WHEN heading <> 0 THEN 3 WHEN best[1] > 500 THEN 4 ELSE 9 END WHEN 3 THEN 2 ELSE 9 END"
    gained = "CASE WHEN phase = 0 AND best[1] <= 200 THEN 1 WHEN phase <= 1 AND (phase = 1 OR (ax = 0 AND ay = 0)) AND best[1] <= 500 THEN 2 WHEN phase = 2 AND heading = 0 AND best[1] <= 500 THEN 1 ELSE 0 END"
    start_mask = " + ".join((_back(1, "x", "y", 2), _back(2, "x", "y", -2), _back(4, "y", "x", 2), _back(8, "y", "x", -2)))
    put = lambda f, v: f"list_transform({f}, lambda old, j: CASE WHEN (j - 1) // 10 BETWEEN gy AND gy + 1 AND (j - 1) % 10 BETWEEN gx AND gx + 1 THEN {v}[1 + ((j - 1) // 10 - gy) * 2 + (j - 1) % 10 - gx]::TINYINT ELSE old END)"
    worst = "[1048576, 1048576, 1048576, 1048576, 1048576]::BIGINT[]"
    none = "[0, 0, 0, 0, 0]::BIGINT[]"
    return f"""
tiles AS (SELECT label::VARCHAR AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_number, list(px ORDER BY i) AS t FROM {pixels} GROUP BY label, vec_id),
pairs AS MATERIALIZED (SELECT a.video_id, a.frame_number, b.t AS ref, a.t AS cur FROM tiles a JOIN tiles b ON a.video_id = b.video_id AND b.frame_number = a.frame_number - 1),
walk AS (
  SELECT video_id, frame_number, 1::BIGINT AS gx, 1::BIGINT AS gy, 0 AS phase, {worst} AS best, {none} AS vx, {none} AS vy, 0 AS heading, 0 AS allowed, 0::BIGINT AS ax, 0::BIGINT AS ay, 0 AS easy, list_transform(range(100), lambda j: 0::TINYINT) AS fx, list_transform(range(100), lambda j: 0::TINYINT) AS fy FROM pairs
  UNION ALL
  SELECT video_id, frame_number, CASE WHEN over THEN CASE WHEN gx = 7 THEN 1 ELSE gx + 2 END ELSE gx END, CASE WHEN over AND gx = 7 THEN gy + 2 ELSE gy END, CASE WHEN over THEN 0 ELSE ({next_phase}) END,
    CASE WHEN over THEN {worst} ELSE best END, CASE WHEN over THEN {none} ELSE vx END, CASE WHEN over THEN {none} ELSE vy END,
    CASE WHEN over THEN 0 ELSE heading END, CASE WHEN phase = 2 THEN heading WHEN phase = 3 THEN allowed | heading ELSE {start_mask} END, CASE WHEN over THEN 0 ELSE ax END, CASE WHEN over THEN 0 ELSE ay END, CASE WHEN over THEN 0 ELSE easy + {gained} END,
    CASE WHEN over THEN {put("fx", "vx")} ELSE fx END, CASE WHEN over THEN {put("fy", "vy")} ELSE fy END
  FROM (SELECT *, CASE WHEN heading = 2 AND phase <= 1 THEN ax ELSE 0 END AS hx, CASE WHEN heading = 2 AND phase <= 1 THEN ay ELSE 0 END AS hy, 0 AS zx, 0 AS zy, ax AS px, ay AS py FROM (
    SELECT video_id, frame_number, gx, gy, phase, over, {each(slot, lambda k: f"best[{k}]")} AS best, {each(lambda k: f"{first(k)}.x", lambda k: f"vx[{k}]")} AS vx, {each(lambda k: f"{first(k)}.y", lambda k: f"vy[{k}]")} AS vy,
      CASE WHEN {better(1)} THEN {first(1)}.m ELSE heading END AS heading, allowed, ax, ay, easy, fx, fy
    FROM (SELECT *, list_transform(list_transform(list_filter(wanted, lambda t: {inside}), lambda t: {{'x': t.x, 'y': t.y, 'm': t.m, 'q': {sums}}}), lambda t: {{'x': t.x, 'y': t.y, 'm': t.m, 's': list_prepend({whole.format("t.q")}, t.q)}}) AS tried
    FROM (SELECT s.video_id, s.frame_number, gx, gy, phase, phase = 9 AS over, best, vx, vy, CASE WHEN phase = 2 THEN 0 ELSE heading END AS heading, allowed, CASE WHEN phase = 0 THEN {_guess("fx")} ELSE ax END AS ax, CASE WHEN phase = 0 THEN {_guess("fy")} ELSE ay END AS ay, easy, fx, fy, ref, cur,
      CASE phase WHEN 0 THEN [{{'x': 0::BIGINT, 'y': 0::BIGINT, 'm': 0}}] WHEN 1 THEN [{{'x': ax, 'y': ay, 'm': 2}}]
        WHEN 9 THEN []
        ELSE list_transform(CASE WHEN phase = 2 THEN list_filter({cross}, lambda t: allowed & t.m > 0) WHEN phase = 3 AND allowed & 3 > 0 THEN {aside} WHEN phase = 3 THEN {along} ELSE {around} END, lambda t: {{'x': vx[1] + t.x, 'y': vy[1] + t.y, 'm': t.m}}) END AS wanted
      FROM walk s JOIN pairs USING (video_id, frame_number) WHERE NOT (phase = 9 AND gx = 7 AND gy = 7)))))
),
blocks AS MATERIALIZED (SELECT video_id, frame_number, (gx + i % 2)::INT AS mb_x, (gy + i // 2)::INT AS mb_y, vx[i + 1]::INT AS mv_x, vy[i + 1]::INT AS mv_y, greatest(0, best[i + 2] - 128 * easy)::INT AS sad16, {_dev("(16 * (gx + i % 2))", "(16 * (gy + i // 2))")}::INT AS dev
  FROM walk JOIN pairs USING (video_id, frame_number), range(4) r(i) WHERE phase = 9)"""


def pair_numbers() -> str:
    """``scores`` (video_id, frame_number, intra_key, ssad_score) from ``blocks`` of pictures of 160 by 160."""
    return """
scores AS MATERIALIZED (SELECT video_id, frame_number, max(CASE WHEN rn = 33 THEN d END)::BIGINT AS intra_key, (sum(CASE WHEN dev < 3000 THEN sad16 ELSE sad16 // 2 END + CASE WHEN mv_x = 0 AND mv_y = 0 AND dev > 1000 AND sad16 < 1000 THEN 512 ELSE 0 END) // (sum(greatest(dev, 300)) // 128 + 4 * (10 + 10 * (count(*) // 4))))::BIGINT AS ssad_score
  FROM (SELECT *, sad16 - dev AS d, row_number() OVER (PARTITION BY video_id, frame_number ORDER BY sad16 - dev DESC) AS rn FROM blocks) GROUP BY video_id, frame_number)"""
