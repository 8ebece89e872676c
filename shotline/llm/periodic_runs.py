"""Maximal repetitions of words (runs), found as Kolpakov and Kucherov do.

A run is a stretch of consecutive words with smallest period ``q`` and of length at least ``max(6, 4 q)`` that no
neighbouring word extends. For a sequence of words:

1. A suffix automaton gives the LZ factors: each factor is the longest prefix of the rest that also starts earlier.
2. Runs that cross or touch the start of a factor come from Main's algorithm: common extensions to both sides of the
   border, read off Z arrays of the factor and of as much text before it as such a run can reach.
3. Any other run lies inside a factor and is copied from the factor's earlier occurrence.

Only stretches that can hold a run are searched: behind its first ``q`` words every word of a run has occurred at most
``q`` words before, so a run of a period in ``(Q / 2, Q]`` needs as many such words in a row. These stretches, for all
powers of two ``Q``, come from a few passes over whole batches; a run never sticks out of the union of its stretches.

A document's words are handled in one task, in time and memory linear in their number; nothing is shuffled.

Defined results: null texts and null arrays of words have no words and no runs, an empty text for what is kept; null
words in an array count as empty words; rows that repeat and rows without an id are documents of their own; columns of
the input pass through untouched, and their names may not be those of the results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import in_chunks

LEAST, POWER = 6, 4  # words of a run, and periods in it, at least
RESULT = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def lz_factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(begin, end, source) of each factor; ``source`` is where it occurs first, or -1 for a new word."""
    step, link, size, first = [{}], [-1], [0], [-1]
    last = 0
    for i, c in enumerate(w):
        new = len(step)
        step.append({})
        size.append(i + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] > size[p] + 1:  # q holds longer words as well: part those that the new end shares
                part = len(step)
                step.append(step[q].copy())
                size.append(size[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = part
                    p = link[p]
                link[q] = q = part
            link[new] = q
        last = new
    out, begin = [], 0
    while begin < len(w):
        state, end, source = 0, begin, -1
        while end < len(w):
            state = step[state].get(w[end], -1)
            if state < 0 or first[state] - (end - begin) >= begin:
                break
            source = first[state] - (end - begin)
            end += 1
        end = max(end, begin + 1)
        out.append((begin, end, source))
        begin = end
    return out


def common_prefixes(w: list[int]) -> list[int]:
    """For each suffix of ``w`` how many words it shares with ``w`` from its start (the Z array)."""
    n = len(w)
    z, left, right = [n] + [0] * (n - 1), 0, 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and w[k] == w[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def _at_border(w: list[int], low: int, border: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of repetitions of ``w[low:end]`` that cross or touch ``border``."""
    u, v = w[low:border], w[border:end]
    n_u, n_v = len(u), len(v)
    back = common_prefixes(u[::-1])
    ahead = common_prefixes(v)
    over = common_prefixes([*v, -2, *u])
    under = common_prefixes([*u[::-1], -2, *v[::-1]])
    for p in range(1, (n_u + n_v) // POWER + 1):
        least = max(LEAST, POWER * p) - p
        # words equal to that p before them: to the left of the border, and from it to the right
        left = back[p] if p < n_u else 0
        right = min(over[n_v + 1 + n_u - p], p) if p <= n_u else 0
        beyond = ahead[p] if p < n_v else 0
        if right == p:
            right += beyond
        if left + right >= least:
            yield border - left - p, border + right, p
        if right < p <= n_v:  # the same around the word p behind the border, apart from those
            before = under[n_u + 1 + n_v - p]
            if before + beyond >= least:
                yield border - before, border + p + beyond, p


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words`` (not negative), by start, then period."""
    w = [*words, -1]
    n = len(words)
    at: list[dict[int, int]] = [{} for _ in range(n + 1)]  # by start: end to smallest period
    before = 0  # length of the factor before
    for begin, end, source in lz_factors(w):
        if begin:
            low = max(0, begin - 2 * before - (end - begin))
            for s, t, p in _at_border(w, low, begin, min(end, n)):
                if (t == n or w[t] != w[t - p]) and (s == 0 or w[s - 1] != w[s - 1 + p]) and p < at[s].get(t, n):
                    at[s][t] = p
        shift = begin - source
        if source >= 0 and end - begin > LEAST:
            for s in range(source + 1, end - shift - LEAST):
                for t, p in list(at[s].items()):
                    if t < end - shift and p < at[s + shift].get(t + shift, n):
                        at[s + shift][t + shift] = p
        before = end - begin
    return [(s, t - s, p) for s, found in enumerate(at) for p, t in sorted((p, t) for t, p in found.items())]


def _stretches(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Disjoint (begin, end) stretches of the words of a batch that hold all its runs; ``starts`` has each document's first word."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    ago = np.full(n, n + 1, np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    ago[order[1:][same]] = (order[1:] - order[:-1])[same]
    own = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    ago[ago > own] = n + 1
    found, q = [], 1
    longest = int(own.max()) + 1 if n else 0
    while q // 2 + 1 <= longest // POWER or (q == 1 and longest >= LEAST):
        edge = np.flatnonzero(np.diff(ago <= q, prepend=False, append=False))
        begin, end = edge[0::2], edge[1::2]
        least = max(LEAST, POWER * (q // 2 + 1)) - (q // 2 + 1)
        long = end - begin >= least
        begin, end = begin[long], end[long]
        found.append(np.stack([np.maximum(begin - q, begin - own[begin]), end], axis=1))
        q *= 2
    spans = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    # stretches of two documents may touch, never overlap; those of one that touch are one
    base = spans[:, 0] - own[spans[:, 0]]
    fresh = np.append(True, (spans[1:, 0] > reach[:-1]) | (base[1:] != base[:-1]))
    at = np.flatnonzero(fresh)
    return np.stack([spans[at, 0], reach[np.append(at[1:], len(spans)) - 1]], axis=1)


def _collapsed(words: pa.ListArray) -> list[pa.Array]:
    """Number of words, runs, and what is left, for a batch of lists of words."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(words.flatten(), "")
    bounds = np.append(0, np.cumsum(sizes))
    ids = flat.dictionary_encode().indices.to_numpy().astype(np.int32)
    starts = bounds[:-1][sizes > 0]
    keep = np.ones(len(ids), bool)
    owner, rows = [], []
    for begin, end in _stretches(ids, starts).tolist() if len(ids) else []:
        doc = int(np.searchsorted(bounds, begin, side="right")) - 1
        base = int(bounds[doc])
        for s, length, p in runs_of(ids[begin:end].tolist()):
            keep[begin + s + p : begin + s + length] = False
            owner.append(doc)
            rows.append((begin - base + s, length, p))
    table = np.array(rows, np.int64).reshape(-1, 3)
    by = np.lexsort((table[:, 2], table[:, 0], np.array(owner, np.int64)))
    table = table[by]
    run_bounds = np.append(0, np.cumsum(np.bincount(np.array(owner, np.int64), minlength=len(sizes))))
    runs = pa.ListArray.from_arrays(pa.array(run_bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], ["start", "length", "period"]))
    left = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(keep))[bounds], pa.int32()), flat.filter(pa.array(keep)))
    return [pa.array(sizes), runs, pc.binary_join(left, " ")]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(batch.num_columns - 1)
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_pylist()
        for begin, end in in_chunks(lengths, lambda n: n, 400_000):
            part = batch.slice(begin, end - begin)
            found = _collapsed(part.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *found], [*batch.schema.names[:-1], "n_words", "runs", "collapsed"])


def with_runs(docs: DataFrame, words: Column) -> DataFrame:
    """``docs`` with the number of ``words`` (an array of strings), their ``runs`` by start, then period, and the text ``collapsed``.

    In the collapsed text only the first period of each run stays: a word goes if any run contains it behind its first
    ``period`` words. What stays is joined by one space.
    """
    fields = StructType.fromDDL(RESULT)
    clash = {f.name for f in fields} & set(docs.columns)
    if clash:
        raise ValueError(f"columns named as results: {sorted(clash)}")
    schema = StructType([*docs.schema.fields, *fields.fields])
    return docs.select("*", words.alias("__words")).mapInArrow(_search, schema)


def longest_run() -> Column:
    """Of ``runs`` the one of greatest exponent (ties: smallest start, then period); null where there is none."""
    # exponents are compared crosswise, so no rounding decides
    better = lambda x, best: x["length"] * best["period"] > best["length"] * x["period"]
    return F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best))
