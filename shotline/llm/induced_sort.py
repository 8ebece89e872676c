"""Suffixes of a shard's bytes in order, with common-prefix values, by external induced sorting.

The suffixes at valleys of the text (each symbol of type S behind one of type L) are sorted first: the stretches between
valleys get names by order, and if names repeat, the shorter text of names is sorted in the same way, down to ``LEVELS`` texts of
names. From these all suffixes are induced: a scan in ascending order puts every L suffix behind those of its bucket, then a scan in
descending order every S suffix.

Both scans read from a priority queue of tuples (suffix, common prefix with the tuple before). The queue is parted by ranges
of first symbols; only the range at hand is in memory, the others go to run files once more than ``resident`` tuples wait.
Tuples leave it in batches: as many as cannot be preceded by what they induce. A tuple's common prefix is its symbol's
width plus the least common prefix of all suffixes between the two that induced it and its forerunner in the bucket;
where buckets meet, the text is compared. Prefixes count in bytes and end at ``depth``, beyond which nothing is asked.

In memory are the text, the types, a sorted shard's order (five bytes a suffix) and one range of tuples.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyarrow import fs

RANGE = 1 << 12  # tuples in a range of symbols, about
BATCH = 1 << 16  # tuples that leave a queue at once, at most
LEVELS = 1  # texts of names, each sorted by induction as well; valleys of the last are compared up to the depth
RESIDENT = 1 << 22  # tuples that wait in memory; the others wait in run files

_TUPLE = np.dtype([("at", "<i4"), ("lcp", "u1")])


class Bytes:
    """A text whose suffixes can be compared eight bytes at a time, up to ``depth``."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        if not 0 < depth < 255:
            raise ValueError("depth is 1 to 254 bytes")
        self.depth, self.n = depth, len(text)
        self._held = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
        self._words = np.ndarray(len(text) + depth + 8, "<u8", self._held, strides=(1,))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``a`` and ``b`` share, ``depth`` at most."""
        out = np.zeros(len(a), np.int64)
        rest = np.arange(len(a))
        while len(rest):
            x = self._words[a[rest] + out[rest]] ^ self._words[b[rest] + out[rest]]
            out[rest] += np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3
            rest = rest[(x == 0) & (out[rest] < self.depth)]
        return np.minimum(out, self.depth).astype(np.uint8)


    def ordered(self, at: np.ndarray) -> np.ndarray:
        """``at`` by the order of its suffixes, up to ``depth``."""
        if not len(at):
            return at
        group, rest, out = np.zeros(len(at), np.int64), np.arange(len(at)), np.arange(len(at))
        for done in range(0, self.depth, 8):
            key = self._words[at[out[rest]] + done].byteswap()
            by = np.lexsort((key, group[rest])) if done else np.argsort(key, kind="stable")
            key = key[by]
            out[rest] = out[rest][by]
            fresh = np.append(True, (key[1:] != key[:-1]) | (group[rest[1:]] != group[rest[:-1]]))
            head = np.flatnonzero(fresh)
            sizes = np.diff(np.append(head, len(rest)))
            group[rest] = np.repeat(rest[head], sizes)
            rest = rest[np.repeat(sizes > 1, sizes)]
            if not len(rest):
                break
        return at[out]


class _Queue:
    """Tuples by ascending key, equal keys as they came; keys that are put in are never below those taken out."""

    def __init__(self, key: np.ndarray, waiting: np.ndarray, folder: str | None, resident: int) -> None:
        self._key, self._resident, self._folder = key, resident, folder
        counts = np.bincount(key[waiting])
        self._range_of = np.minimum((np.cumsum(counts) - counts) // RANGE, np.cumsum(counts)[-1] // RANGE).astype(np.int32)
        self._runs: list[list] = [[] for _ in range(int(self._range_of[-1]) + 1)]
        self._fresh: list[np.ndarray] = []
        self._n_fresh = self._n_held = 0
        self._now = -1
        self._at, self._head = np.empty(0, _TUPLE), 0
        self._files: list[str] = []
        if folder:
            self._fs, self._path = fs.FileSystem.from_uri(folder)

    def put(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        mine = self._range_of[self._key[rows["at"]]] == self._now
        later = rows if not mine.any() else rows[~mine]
        if len(later) < len(rows):
            now = rows[mine]
            keys = self._key[now["at"]]
            by = np.argsort(keys, kind="stable")
            rest = self._at[self._head :]
            place = np.searchsorted(self._key[rest["at"]], keys[by], side="right") + np.arange(len(by))
            old = np.ones(len(rest) + len(by), bool)
            old[place] = False
            self._at, self._head = np.empty(len(old), _TUPLE), 0
            self._at[old], self._at[place] = rest, now[by]
        if len(later):
            self._fresh.append(later)
            self._n_fresh += len(later)
            if self._n_fresh >= min(1 << 18, self._resident):
                self._deal()

    def _deal(self) -> None:
        """Fresh tuples to the runs of their ranges; these to a file if too many wait."""
        if not self._n_fresh:
            return
        rows = np.concatenate(self._fresh)
        where = self._range_of[self._key[rows["at"]]]
        by = np.argsort(where.astype(np.uint16) if self._range_of[-1] < 1 << 16 else where, kind="stable")
        rows, where = rows[by], where[by]
        edges = np.append(np.flatnonzero(np.diff(where, prepend=-1)), len(rows))
        for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            self._runs[where[begin]].append(rows[begin:end])
        self._n_held += self._n_fresh
        self._fresh, self._n_fresh = [], 0
        if self._folder and self._n_held > self._resident:
            name, at = f"{self._path}/{uuid.uuid4().hex}", 0
            with self._fs.open_output_stream(name) as out:
                for runs in self._runs:
                    for k, run in enumerate(runs):
                        if isinstance(run, np.ndarray):
                            out.write(run.tobytes())
                            runs[k] = (name, at, len(run))
                            at += run.nbytes
            self._files.append(name)
            self._n_held = 0

    def _load(self, run) -> np.ndarray:
        if isinstance(run, np.ndarray):
            self._n_held -= len(run)
            return run
        name, at, n = run
        with self._fs.open_input_file(f"{name}") as f:
            return np.frombuffer(f.read_at(n * _TUPLE.itemsize, at), _TUPLE)

    def some(self, most: int) -> np.ndarray:
        """The next tuples, still in the queue; none at its end."""
        while self._head >= len(self._at):
            if self._now + 1 >= len(self._runs):
                return np.empty(0, _TUPLE)
            self._deal()
            self._now += 1
            rows = [self._load(run) for run in self._runs[self._now]]
            self._runs[self._now] = []
            if rows:
                rows = np.concatenate(rows)
                self._at, self._head = rows[np.argsort(self._key[rows["at"]], kind="stable")], 0
        return self._at[self._head : self._head + most]

    def take(self, n: int) -> None:
        self._head += n

    def close(self) -> None:
        for name in self._files:
            self._fs.delete_file(name)


def _led(first: object, rest: np.ndarray) -> np.ndarray:
    """``rest`` behind ``first``; quicker than np.append for short arrays."""
    out = np.empty(len(rest) + 1, rest.dtype)
    out[0], out[1:] = first, rest
    return out


def _least(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of ``values[begin:end]`` for each pair; no range is empty."""
    if not len(begin):
        return np.empty(0, values.dtype)
    size = end - begin
    log = np.frexp(size.astype(np.float64))[1] - 1
    out, table = np.empty(len(begin), values.dtype), values
    for k in range(int(log.max()) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        mine = log == k
        out[mine] = np.minimum(table[begin[mine]], table[end[mine] - (1 << k)])
    return out


def _induced(text: Bytes, byte_at: np.ndarray, symbol: np.ndarray, key: np.ndarray, wanted: np.ndarray, seeds: np.ndarray, folder: str | None, resident: int) -> Iterator[np.ndarray]:
    """Batches of all tuples in the order of their keys: ``seeds``, and what is induced at ``wanted`` places."""
    taken_in = wanted.copy()
    taken_in[seeds["at"]] = True
    queue = _Queue(key, np.flatnonzero(taken_in), folder, resident)
    queue.put(seeds)
    n_symbols = int(symbol.max()) + 1
    seen, tail = np.full(n_symbols, -1, np.int64), np.zeros(n_symbols, np.uint8)
    between: np.ndarray = np.zeros(64, np.uint8)
    last, most, step = None, 1024, 0
    try:
        while len(rows := queue.some(most)):
            at = rows["at"].astype(np.int64)
            keys = key[at]
            before = np.maximum(at - 1, 0)
            hit = wanted[before] & (at > 0)
            reach = np.minimum.accumulate(np.where(hit, key[before], np.iinfo(key.dtype).max))
            fits = _led(True, reach[:-1] >= keys[1:])
            n = len(rows) if fits.all() else int(np.argmin(fits))
            most = min(BATCH, max(256, 2 * n))
            at, keys, hit, before = at[:n], keys[:n], hit[:n], before[:n]
            lcp = rows["lcp"][:n].copy()
            queue.take(n)
            other = _led(last is None or key[last] != keys[0], keys[1:] != keys[:-1]).nonzero()[0]
            forerunner = _led(at[0] if last is None else last, at[:-1])
            lcp[other] = text.common(byte_at[at[other]], byte_at[forerunner[other]])
            if last is None:
                lcp[0] = 0
            last = int(at[-1])
            source = hit.nonzero()[0]
            if len(source):
                target = before[source]
                name = symbol[target]
                by = np.argsort(name.astype(np.uint16) if n_symbols < 1 << 16 else name, kind="stable")
                source_by, name_by = source[by], name[by]
                fresh = _led(True, name_by[1:] != name_by[:-1])
                shared = np.zeros(len(by), np.uint8)
                again = (~fresh).nonzero()[0]
                shared[again] = _least(lcp, source_by[again - 1] + 1, source_by[again] + 1)
                first = fresh.nonzero()[0]
                so_far = np.minimum.accumulate(lcp)
                known = first[seen[name_by[first]] >= 0]
                names = name_by[known]
                shared[known] = np.minimum(np.minimum(tail[names], between[seen[names]]), so_far[source_by[known]])
                wide = np.minimum(byte_at[target[by] + 1] - byte_at[target[by]], text.depth)
                put = np.empty(len(source), _TUPLE)
                put["at"] = target
                put["lcp"][by] = np.minimum(shared + wide, text.depth)
                ends = _led(len(by), first[:0:-1])[::-1] - 1
                to_end = _led(255, np.minimum.accumulate(lcp[::-1]))[::-1]
            between[:step] = np.minimum(between[:step], lcp.min())
            if len(source):
                tail[name_by[ends]], seen[name_by[ends]] = to_end[source_by[ends] + 1], step
                queue.put(put)
            if step == len(between) - 1:
                between = np.append(between, np.zeros(len(between), np.uint8))
            between[step] = 255
            step += 1
            out = np.empty(n, _TUPLE)
            out["at"], out["lcp"] = at, lcp
            yield out
    finally:
        queue.close()


def _names(symbol: np.ndarray, is_s: np.ndarray, valleys: np.ndarray) -> np.ndarray:
    """The rank of each stretch from a valley up to and with the next; equal stretches have one rank."""
    code = 2 * symbol.astype(np.int64) + is_s
    size = np.append(np.diff(valleys) + 1, 1)
    bits = int(code.max()).bit_length()
    many = max(1, 62 // bits)
    padded = np.append(code, np.zeros(many, np.int64))
    rank = np.zeros(len(valleys), np.int64)
    rest, done = np.arange(len(valleys)), 0
    while len(rest):
        packed = np.zeros(len(rest), np.int64)
        for k in range(many):
            inside = size[rest] > done + k
            packed = (packed << bits) | np.where(inside, padded[np.minimum(valleys[rest] + done + k, len(symbol))], 0)
        by = np.lexsort((packed, rank[rest])) if done else np.argsort(packed, kind="stable")
        rest, packed = rest[by], packed[by]
        fresh = np.append(True, (packed[1:] != packed[:-1]) | (rank[rest[1:]] != rank[rest[:-1]]))
        head = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        old = np.append(True, rank[rest[1:]] != rank[rest[:-1]])
        base = np.flatnonzero(old)[np.cumsum(old) - 1]  # where the group of before begins
        rank[rest] = rank[rest] + head[group] - base
        done += many
        open_ = (np.diff(np.append(head, len(rest)))[group] > 1) & (size[rest] > done)
        rest = rest[open_]
    return rank


def _sorted(text: Bytes, byte_at: np.ndarray, symbol: np.ndarray, folder: str | None, resident: int, level: int = 0) -> np.ndarray:
    """Tuples of all suffixes of ``symbol`` in order; its last symbol is the smallest and comes once."""
    n = len(symbol)
    step = np.diff(symbol)
    moves = np.where(step != 0, np.arange(n - 1, dtype=np.int32), np.int32(n))
    moves = np.minimum.accumulate(moves[::-1])[::-1]  # the next place where the symbol changes
    is_s = np.append(step[np.minimum(moves, n - 2)] > 0, True) if n > 1 else np.ones(1, bool)
    del step, moves
    valleys = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if not len(valleys):
        valleys = np.array([n - 1])
    seeds = np.empty(len(valleys), _TUPLE)
    names, short = np.unique(_names(symbol, is_s, valleys), return_inverse=True) if level < LEVELS else (None, None)
    short = None if short is None else short.astype(np.int32)
    if names is None:
        starts = byte_at[valleys[:-1]]
        seeds["at"] = np.append(valleys[-1], valleys[np.searchsorted(starts, text.ordered(starts))])
        first = byte_at[seeds["at"]]
        seeds["lcp"] = np.append(np.uint8(0), text.common(first[1:], first[:-1]))
    elif len(names) == len(valleys):
        order = np.argsort(short)
        seeds["at"] = valleys[order]
        seeds["lcp"] = np.append(np.uint8(0), text.common(byte_at[valleys[order[1:]]], byte_at[valleys[order[:-1]]]))
    else:
        found = _sorted(text, np.append(byte_at[valleys], byte_at[-1]), short, folder, resident, level + 1)
        seeds["at"], seeds["lcp"] = valleys[found["at"]], found["lcp"]
    up = 2 * symbol + is_s
    found = np.concatenate(list(_induced(text, byte_at, symbol, up, ~is_s, seeds, folder, resident)))
    # the suffixes of type L are the seeds of the way down, with the common prefix with what comes before them there
    large = found[~is_s[found["at"]]][::-1].copy()
    large["lcp"] = np.append(np.uint8(0), large["lcp"][:-1])
    del found
    down = 2 * (symbol.max() - symbol) + ~is_s
    end = np.zeros(1, _TUPLE)
    end["at"] = n - 1  # nothing induces the last suffix, which is the smallest
    if not len(large):
        return end
    out = np.concatenate([end, *[rows[::-1] for rows in reversed(list(_induced(text, byte_at, symbol, down, is_s, large, folder, resident)))]])
    out["lcp"] = np.concatenate([np.zeros(2, np.uint8), out["lcp"][1:-1]])
    out["lcp"][1] = text.common(byte_at[out["at"][1:2]], byte_at[out["at"][:1]])[0]
    return out


def suffix_order(text: np.ndarray, depth: int, folder: str | None = None, resident: int = RESIDENT) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all suffixes of ``text`` (bytes) in order, and what each shares with the one before, ``depth`` bytes at most.

    Suffixes that are equal for ``depth`` bytes may come in any order. ``folder`` is a URI for run files.
    """
    if len(text) >= 2**31 - 1:
        raise ValueError("a shard has less than 2 GB")
    if not len(text):
        return np.empty(0, np.int64), np.empty(0, np.uint8)
    held = Bytes(text, depth)
    symbol = np.append(text.astype(np.int32) + 1, np.int32(0))
    found = _sorted(held, np.arange(len(text) + 2, dtype=np.int32), symbol, folder, resident)[1:]
    return found["at"].astype(np.int64), found["lcp"].copy()
