"""The frame-pair kernel: block motion search and block statistics over many pairs at once.

Groups of 2 by 2 blocks depend only on the group to their left and the one above, so all groups of one anti-diagonal,
of every pair in the batch, are searched together. Most groups never get that far: differences at rest and deviations
need no order and are computed for whole batches. Pixels stay unsigned bytes until they are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

EDGE, SPARE = 64, 17  # padding on every side; clamped rows kept above it for searches that leave the picture at the top, and there at the left
AT_ONCE = 1 << 18  # bytes of small pictures that are compared at once
EASY, GOOD, WORST = 200, 500, 4096 * 256
LEFT, RIGHT, UP, DOWN = 1, 2, 4, 8
_STEP = {LEFT: (-2, 0), RIGHT: (2, 0), UP: (0, -2), DOWN: (0, 2)}
_AROUND = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))


def clamp_window(frames: np.ndarray, top: int, bottom: int, left: int, right: int) -> np.ndarray:
    """Rows ``top`` to ``bottom``, columns ``left`` to ``right`` of (n, h, w) pictures that go on as their border pixels; ``left`` is not right of them."""
    n, h, w = frames.shape
    rows = np.take(frames, np.clip(np.arange(top, bottom), 0, h - 1), axis=1)
    a, b = min(max(left, 0), w), min(max(right, 0), w)
    out = np.empty((n, bottom - top, right - left), frames.dtype)
    out[:, :, a - left : b - left] = rows[:, :, a:b]
    out[:, :, : a - left] = rows[:, :, :1]
    out[:, :, b - left :] = rows[:, :, -1:]
    return out


def clamp_pad(frames: np.ndarray) -> np.ndarray:
    """(n, h, w) pictures extended to whole blocks and by ``EDGE`` on every side with their border pixels."""
    _, h, w = frames.shape
    return clamp_window(frames, -EDGE, -(-h // 16) * 16 + EDGE, -EDGE, -(-w // 16) * 16 + EDGE)


def deviations(blocks: np.ndarray) -> np.ndarray:
    """Sum of absolute differences to the floored mean of (..., 16, 16) blocks."""
    mean = blocks.sum(axis=(-1, -2), dtype=np.int32) >> 8
    return np.abs(blocks.astype(np.int16) - mean[..., None, None].astype(np.int16)).sum(axis=(-1, -2), dtype=np.int32)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.maximum(a, b)
    out -= np.minimum(a, b)
    return out


def _sums(pixels: np.ndarray) -> np.ndarray:
    """Sums of the 16 by 16 blocks of (n, 16 a, 16 b) bytes; a lane of 16 bits takes two bytes of 16 rows."""
    n, h, w = pixels.shape
    two = pixels.view(np.uint16)
    lanes = (two & 255) + (two >> 8)
    rows = lanes.reshape(n, h // 16, 16, w // 2).sum(axis=2, dtype=np.uint16)
    return rows.reshape(n, h // 16, w // 16, 8).sum(axis=3, dtype=np.int32)


def _quarters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of the four quarters of (n, 32, 32) pictures: upper left, upper right, lower left, lower right."""
    return _sums(_apart(a, b)).reshape(-1, 4)


def picture_deviations(pictures: np.ndarray) -> np.ndarray:
    """``deviations`` of all blocks of (n, 16 a, 16 b) pictures."""
    n, h, w = pictures.shape
    mean = np.repeat((_sums(pictures) >> 8).astype(np.uint8), 16, axis=2)
    return _sums(_apart(pictures.reshape(n, h // 16, 16, w), mean.reshape(n, h // 16, 1, w)).reshape(n, h, w))


def _spans(pictures: np.ndarray) -> Iterator[slice]:
    """Parts of ``pictures``: large ones one by one, small ones as many as stay in the cache."""
    step = max(1, AT_ONCE // max(1, pictures[:1].size))
    return (slice(k, k + step) for k in range(0, len(pictures), step))


class _Search:
    """Best sums and vectors of every group: slot 0 for the whole, 1 to 4 for its quarters."""

    def __init__(self, prev: np.ndarray, cur: np.ndarray, code: int) -> None:
        n, height, width = cur.shape
        self.down, self.across = (height + 15) // 16, (width + 15) // 16
        self.stride = 16 * self.across + 2 * EDGE
        self.gy, self.gx = max(0, (self.down - 1) // 2), max(0, (self.across - 1) // 2)
        # of padded pictures: what searches reach, and what groups cover
        ref = clamp_window(prev, -EDGE - SPARE, height + 32 - EDGE, -EDGE, self.stride - EDGE)
        self.inner = clamp_window(cur, 16 - EDGE, 16 + 32 * self.gy - EDGE, 16 - EDGE, 16 + 32 * self.gx - EDGE)
        self.still = ref[:, 16 + SPARE : 16 + SPARE + 32 * self.gy, 16 : 16 + 32 * self.gx]
        ref = ref.reshape(n, -1)
        # a window is 32 rows of 32 bytes, copied a row at a time
        self.windows = np.ndarray((n, ref.shape[1] - 31 * self.stride - 31, 32), "V32", ref, 0, (ref.strides[0], 1, self.stride))
        f, y, x = np.meshgrid(np.arange(n), np.arange(self.gy), np.arange(self.gx), indexing="ij")
        self.f, self.y, self.x = f.ravel(), 2 * y.ravel() + 1, 2 * x.ravel() + 1
        self.order = (x + y).ravel()
        self.own = self.inner.reshape(n, self.gy, 32, self.gx, 32).swapaxes(2, 3).reshape(-1, 32, 32)
        self.base = (16 * self.y + SPARE) * self.stride + 16 * self.x
        r = 1 << (code + 3)
        self.low = np.stack([np.maximum(-r, -16 * (self.x + 1)), np.maximum(-r, -16 * (self.y + 1))], 1)
        self.high = np.stack([np.minimum(r - 1, width - 16 * self.x), np.minimum(r - 1, height - 16 * self.y)], 1)
        k = len(self.f)
        self.best, self.vec = np.full((k, 5), WORST, np.int32), np.zeros((k, 5, 2), np.int32)
        self.dir, self.bonus = np.zeros(k, np.int32), np.zeros(k, np.int32)
        self.field = np.zeros((n, self.down, self.across, 2), np.int32)

    def attempt(self, g: np.ndarray, at: np.ndarray, steps: tuple[tuple[int, int], ...], marks: tuple[int, ...], on: np.ndarray | None = None) -> None:
        """Try the displacements ``at`` + step of each group of ``g``, where ``on`` (a row a step) allows it.

        The least sum wins, and the first of equal ones; the whole's winner leaves its mark as its direction.
        """
        step = np.array(steps, np.int32)
        v = at[None] + step[:, None]
        tried = ((v >= self.low[g]) & (v <= self.high[g])).all(axis=2)
        if on is not None:
            tried &= on
        j, k = np.nonzero(tried)
        if not len(j):
            return
        own, v = g[k], v[j, k]
        start = self.base[own] + v[:, 1] * self.stride + v[:, 0]
        found = np.empty((len(own), 4), np.int32)
        for first in range(0, len(own), AT_ONCE >> 10):
            some = slice(first, first + (AT_ONCE >> 10))
            there = np.ascontiguousarray(self.windows[self.f[own[some]], start[some]])
            found[some] = _quarters(self.own[own[some]], there.view(np.uint8).reshape(-1, 32, 32))
        sums = np.full((len(steps), len(g), 5), WORST, np.int32)
        sums[j, k, 0], sums[j, k, 1:] = found.sum(axis=1), found
        best = sums.argmin(axis=0)
        least = np.take_along_axis(sums, best[None], axis=0)[0]
        better = least < self.best[g]
        self.best[g] = np.where(better, least, self.best[g])
        self.vec[g] = np.where(better[..., None], at[:, None] + step[best], self.vec[g])
        self.dir[g] = np.where(better[:, 0], np.array(marks, np.int32)[best[:, 0]], self.dir[g])

    def _rest(self) -> None:
        """Every group where it stands, without a gather."""
        size = self.gy * self.gx
        for k in _spans(self.inner):
            found = _sums(_apart(self.inner[k], self.still[k])).reshape(-1, self.gy, 2, self.gx, 2).swapaxes(2, 3).reshape(-1, 4)
            at = slice(k.start * size, k.start * size + len(found))
            self.best[at, 1:] = found
            self.best[at, 0] = found.sum(axis=1)

    def run(self) -> None:
        if not len(self.f):
            return
        self._rest()
        hard = self.best[:, 0] > EASY
        self.bonus += ~hard
        if hard.any():
            rest = np.flatnonzero(hard)
            order = self.order[rest]
            for wave in np.unique(order):
                self._wave(rest[order == wave])

    def _wave(self, g: np.ndarray) -> None:
        guess = self._predicted(g)
        moved = guess.any(axis=1)
        self.attempt(g[moved], guess[moved], ((0, 0),), (2,))
        far = self.best[g, 0] > GOOD
        self.bonus[g] += ~far
        if far.any():
            self._diamond(g[far], self._allowed(g[far], guess[far]))
        far = self.best[g, 0] > GOOD
        self.bonus[g] += ~far
        near = g[far]
        if len(near):
            self.attempt(near, self.vec[near, 0], _AROUND, (0,) * 8)
        for i in range(4):
            self.field[self.f[g], self.y[g] + i // 2, self.x[g] + i % 2] = self.vec[g, i]

    def _predicted(self, g: np.ndarray) -> np.ndarray:
        f, y, x = self.f[g], self.y[g], self.x[g]
        left, up, corner = self.field[f, y, x - 1], self.field[f, y - 1, x], self.field[f, y - 1, np.minimum(x + 1, self.across - 1)]
        middle = np.maximum(np.minimum(left, up), np.minimum(np.maximum(left, up), corner))
        first_row, first_col = (y == 1)[:, None], (x == 1)[:, None]
        return np.where(first_row & first_col, 0, np.where(first_col, up, np.where(first_row, left, middle)))

    def _allowed(self, g: np.ndarray, guess: np.ndarray) -> np.ndarray:
        """Directions worth trying: not those that lead back to a place already measured."""
        at = np.where((self.dir[g] == 2)[:, None], guess, 0)
        out = np.full(len(g), LEFT | RIGHT | UP | DOWN)
        for known in (np.zeros_like(guess), guess):
            dx, dy = (at - known).T
            for bit, hit in ((UP, (dx == 0) & (dy == 2)), (DOWN, (dx == 0) & (dy == -2)), (LEFT, (dy == 0) & (dx == 2)), (RIGHT, (dy == 0) & (dx == -2))):
                out[hit] &= ~bit
        return out

    def _diamond(self, g: np.ndarray, allowed: np.ndarray) -> None:
        while len(g):
            self.dir[g] = 0
            self._steps(g, (LEFT, RIGHT, UP, DOWN), [(allowed & bit) > 0 for bit in (LEFT, RIGHT, UP, DOWN)])
            going = self.dir[g] != 0
            g = g[going]
            if not len(g):
                return
            allowed = self.dir[g].copy()
            flat = (allowed & (LEFT | RIGHT)) > 0
            self._steps(g, (DOWN, UP, RIGHT, LEFT), [flat, flat, ~flat, ~flat])
            allowed |= self.dir[g]

    def _steps(self, g: np.ndarray, bits: tuple[int, ...], on: list[np.ndarray]) -> None:
        self.attempt(g, self.vec[g, 0], tuple(_STEP[b] for b in bits), bits, np.array(on))


def analyse(prev: np.ndarray, cur: np.ndarray, code: int) -> dict[str, np.ndarray]:
    """Block statistics of pairs of (n, h, w) pictures: f, x, y, vx, vy, sad, dev, one entry a block, in search order."""
    s = _Search(prev, cur, code)
    s.run()
    spread = np.concatenate([picture_deviations(s.inner[k]) for k in _spans(s.inner)]) if len(s.f) else np.zeros((len(cur), 1, 1), np.int32)
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("f", "x", "y", "vx", "vy", "sad", "dev")}
    for i in range(4):
        y, x = s.y + i // 2, s.x + i % 2
        values = (s.f, x, y, s.vec[:, i, 0], s.vec[:, i, 1], np.maximum(0, s.best[:, i + 1] - 128 * s.bonus), spread[s.f, y - 1, x - 1])
        for name, value in zip(out, values, strict=True):
            out[name].append(value)
    return {k: np.stack(v, 1).ravel() for k, v in out.items()}


def intra_limit(width: int, height: int) -> int:
    """Blocks that must pass the intra test for a cut: more than this."""
    return ((height + 15) // 16 - 2) * ((width + 15) // 16 - 2) // 2


def pair_numbers(blocks: dict[str, np.ndarray], n: int, width: int, height: int) -> tuple[list[int | None], list[int]]:
    """The two integers of each of ``n`` pairs that decide it, whatever came before: intra_key and ssad_score."""
    sad, dev = blocks["sad"].astype(np.int64).reshape(n, -1), blocks["dev"].astype(np.int64).reshape(n, -1)
    still = (blocks["vx"] == 0).reshape(n, -1) & (blocks["vy"] == 0).reshape(n, -1)
    count, limit = sad.shape[1], intra_limit(width, height)
    keys: list[int | None] = [None] * n
    if 0 <= limit < count:
        keys = (-np.partition(dev - sad, limit, axis=1)[:, limit]).tolist()
    total = (np.where(dev < 3000, sad, sad // 2) + 512 * (still & (dev > 1000) & (sad < 1000))).sum(axis=1)
    detail = np.maximum(dev, 300).sum(axis=1) // 128 + 4 * (10 + 10 * (count // 4))
    return keys, (total // detail).tolist()
