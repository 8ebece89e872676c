"""A scalar model of the pair kernel: one group, one candidate, one pixel block at a time."""

import numpy as np


def score(prev, cur, code):
    """Block rows {(x, y): (vx, vy, sad, dev)} and the two numbers of a pair of (h, w) pictures."""
    h, w = cur.shape
    down, across = (h + 15) // 16, (w + 15) // 16
    pad = lambda a, top: np.pad(a, ((64 + top, 16 * down - h + 64), (64, 16 * across - w + 64)), mode="edge").astype(int)
    ref, now = pad(prev, 16).ravel(), pad(cur, 0)
    stride = now.shape[1]
    radius, field, blocks = 2 ** (code + 3), {}, {}

    def quarter(px, py, dx, dy):
        at = (py + dy + 16) * stride + px + dx
        return sum(int(np.abs(now[py + r, px : px + 16] - ref[at + r * stride : at + r * stride + 16]).sum()) for r in range(16))

    for y in range(1, down - 1, 2):
        for x in range(1, across - 1, 2):
            best, vec, heading = [4096 * 256] * 5, [(0, 0)] * 5, 0
            limits = (max(-radius, -16 * (x + 1)), min(radius - 1, w - 16 * x), max(-radius, -16 * (y + 1)), min(radius - 1, h - 16 * y))

            def attempt(vx, vy, mark):
                nonlocal heading
                if not (limits[0] <= vx <= limits[1] and limits[2] <= vy <= limits[3]):  # noqa: B023
                    return
                sums = [quarter(16 * x + 16 * (k % 2), 16 * y + 16 * (k // 2), vx, vy) for k in range(4)]  # noqa: B023
                for slot, value in enumerate([sum(sums), *sums]):
                    if value < best[slot]:  # noqa: B023
                        best[slot], vec[slot] = value, (vx, vy)  # noqa: B023
                        if slot == 0:
                            heading = mark

            attempt(0, 0, 0)
            easy = int(best[0] <= 200)
            if not easy:
                get = lambda a, b: field.get((a, b), (0, 0))
                left, up, corner = get(x - 1, y), get(x, y - 1), get(x + 1, y - 1)
                if x == 1 and y == 1:
                    guess = (0, 0)
                elif x == 1:
                    guess = up
                elif y == 1:
                    guess = left
                else:
                    guess = tuple(sorted(t)[1] for t in zip(left, up, corner, strict=True))
                if guess != (0, 0):
                    attempt(*guess, 2)
                if best[0] > 500:
                    seen = [(0, 0), (0, 0), guess]
                    here, on = seen[heading], {"l", "r", "u", "d"}
                    for q in seen:
                        if here[0] == q[0]:
                            on -= {"u"} if here[1] == q[1] + 2 else {"d"} if here[1] == q[1] - 2 else set()
                        elif here[1] == q[1]:
                            on -= {"l"} if here[0] == q[0] + 2 else {"r"} if here[0] == q[0] - 2 else set()
                    moves = {"l": (-2, 0), "r": (2, 0), "u": (0, -2), "d": (0, 2)}
                    while True:
                        heading, (px, py) = 0, vec[0]
                        for m in "lrud":
                            if m in on:
                                attempt(px + moves[m][0], py + moves[m][1], m)
                        if heading == 0:
                            break
                        on, (px, py) = {heading}, vec[0]
                        for m in "du" if on & {"l", "r"} else "rl":
                            attempt(px + moves[m][0], py + moves[m][1], m)
                        on = on | {heading}
                else:
                    easy += 1
                if best[0] > 500:
                    px, py = vec[0]
                    for dx, dy in ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)):
                        attempt(px + dx, py + dy, 0)
                else:
                    easy += 1
            for i in range(4):
                bx, by = x + i % 2, y + i // 2
                field[bx, by] = vec[i]
                part = now[16 * by : 16 * by + 16, 16 * bx : 16 * bx + 16]
                blocks[bx, by] = (*vec[i], max(0, best[i + 1] - 128 * easy), int(np.abs(part - part.sum() // 256).sum()))
    rows = list(blocks.values())
    limit = (down - 2) * (across - 2) // 2
    order = sorted((s - d for _, _, s, d in rows), reverse=True)
    total = sum((s if d < 3000 else s // 2) + (512 if vx == vy == 0 and d > 1000 and s < 1000 else 0) for vx, vy, s, d in rows)
    detail = sum(max(d, 300) for *_, d in rows) // 128 + 4 * (10 + 10 * (len(rows) // 4))
    return blocks, order[limit] if 0 <= limit < len(order) else None, total // detail


def cuts(scores, t1=2000, t2=90):
    since, out = 1, []
    for number, key, value in scores:
        hit = (key is not None and key > t1 + (15 * (10 - since) ** 2 if 0 < since < 10 else 0)) or value > t2 + (4 * (30 - since) if 0 < since < 30 else 0)
        since = 1 if hit else since + 1
        out += [number] * hit
    return out
