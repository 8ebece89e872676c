"""A quality classifier: naive Bayes support vectors.

Each n-gram indicator is scaled by the log ratio of its frequencies in the two classes, and a linear hinge-loss model is
fitted to the scaled indicators by dual coordinate descent (Hsieh et al. 2008; the scaling is Wang and Manning 2012).
N-grams are of word shapes (letter case, digits, marks, repetition of the word before; one to three of them), of bytes
(three and four) and of words; shapes also say which of them make up an eighth, a quarter or half of the text. They are
hashed to ``SLOTS`` places. The margin becomes a score between 0 and 1 by a logistic curve fitted to rows held out of
the descent.

The model is fitted on a bounded sample: of the training labels those ``MOST_ROWS`` with the smallest hash of their id,
of these the first whose slots are ``MOST_SLOTS`` together, which reach the driver as arrays of slots. Scoring reads every whole text once, with a model of fixed size.

Defined results: a null or empty text has the score of no n-grams at all; a row of ``labels`` without a label, an id or
a document is ignored, and of an id labelled twice differently the smallest label counts; with no labels of either class
every score is the share of the class that there is (0.5 without labels); repeated rows score alike; of documents that
repeat a labelled id with different texts the smallest text is learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _ODD, _SPACE, in_chunks, mix, stored, word_hashes

SLOTS = 1 << 18
MOST_ROWS = 4000  # labelled rows that the fit sees, about 40 MB of slots
MOST_SLOTS = 1 << 24  # of these rows together, 64 MB
FOLDS = 5  # one of these holds rows for the curve
PASSES, COST, SMOOTH = 12, 0.02, 1.0

_KIND = np.zeros(256, np.uint8)  # of bytes: 1 lower, 2 upper, 3 digit, 4 mark, 5 non-ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4


def _slots(x: np.ndarray, salt: int) -> np.ndarray:
    return (mix(x ^ np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - 18)).astype(np.int32)


def features(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct slots of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    words, first = word_hashes(raw, _SPACE, lower=False)
    shapes = _shapes(raw)
    out = []
    for k, data in enumerate(raw):
        w, s = words[first[k] : first[k + 1]], shapes[first[k] : first[k + 1]].copy()
        found = []
        if len(w):
            s[1:] += np.uint64(64) * (w[1:] == w[:-1])
            found += [_slots(np.unique(w), 1)]
            for n in (1, 2, 3):
                if len(s) >= n:
                    code = sum(s[j : len(s) - n + 1 + j] * _ODD[j] for j in range(n))
                    kinds, counts = np.unique(code, return_counts=True)
                    found += [_slots(kinds, 1 + n)]
                    if n == 1:
                        found += [_slots(kinds[counts * part >= len(s)], 8 + part) for part in (2, 4, 8)]
        b = np.frombuffer(data, np.uint8).astype(np.uint32)
        for n in (3, 4):
            if len(b) >= n:
                code = sum(b[j : len(b) - n + 1 + j] << np.uint32(8 * j) for j in range(n))
                found += [_slots(np.unique(code).astype(np.uint64), 16 + n)]
        out.append(np.unique(np.concatenate(found)) if found else np.empty(0, np.int32))
    return out


def _shapes(raw: list[bytes]) -> np.ndarray:
    """A code for each word: the kinds of bytes it begins with, ends with and holds."""
    buf = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[buf], prepend=True))
    begin, end = edge[0::2], edge[1::2]
    if not len(begin):
        return np.empty(0, np.uint64)
    kind = _KIND[buf]
    holds = np.zeros(len(begin), np.uint64)
    for k in range(1, 6):
        n = np.concatenate([[0], np.cumsum(kind == k)])
        holds |= (n[end] > n[begin]).astype(np.uint64) << np.uint64(k)
    return holds | kind[begin].astype(np.uint64) << np.uint64(8) | kind[end - 1].astype(np.uint64) << np.uint64(12)


@dataclass
class Model:
    weights: np.ndarray  # float32, one a slot, the class ratios multiplied in
    bias: float
    slope: float
    shift: float

    def score(self, slots: np.ndarray) -> float:
        margin = float(self.weights[slots].sum()) / np.sqrt(max(len(slots), 1)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, held: np.ndarray) -> Model:
    """The model of rows of slots; rows that ``held`` marks fit the curve only."""
    y = np.where(labels > 0, 1.0, -1.0)
    known = [k for k in range(len(rows)) if not held[k]]
    ratio = np.zeros(SLOTS)
    for sign in (1, -1):
        own = [rows[k] for k in known if y[k] == sign]
        count = np.bincount(np.concatenate([*own, np.empty(0, np.int32)]).astype(np.int64), minlength=SLOTS) + SMOOTH
        ratio += sign * np.log(count / (len(own) + 2 * SMOOTH))
    size = [np.sqrt(max(len(r), 1)) for r in rows]
    values = [(ratio[r] / s).astype(np.float32) for r, s in zip(rows, size, strict=True)]
    # dual coordinate descent, hinge loss; classes weigh alike
    share = {s: max(1, sum(y[k] == s for k in known)) for s in (1, -1)}
    bound = {s: COST * len(known) / (2 * share[s]) for s in (1, -1)}
    square = [float(v @ v) + 1.0 for v in values]
    w, bias, alpha = np.zeros(SLOTS), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(11)
    for _ in range(PASSES):
        for k in order.permutation(known):
            slope = y[k] * (values[k] @ w[rows[k]] + bias) - 1
            new = min(max(alpha[k] - slope / square[k], 0.0), bound[int(y[k])])
            if new != alpha[k]:
                step = (new - alpha[k]) * y[k]
                w[rows[k]] += step * values[k]
                bias += step
                alpha[k] = new
    margin = np.array([values[k] @ w[rows[k]] + bias for k in range(len(rows)) if held[k]])
    a, b = _curve(margin, y[held] > 0)
    return Model((w * ratio).astype(np.float32), bias, a, b)


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps on smoothed targets (Platt 1999)."""
    if not len(margin) or label.all() or not label.any():
        return 4.0, 0.0
    goal = np.where(label, (label.sum() + 1) / (label.sum() + 2), 1 / ((~label).sum() + 2))
    x = np.stack([margin, np.ones(len(margin))])
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
        hessian = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        at = at - np.clip(np.linalg.solve(hessian, x @ (p - goal)), -2, 2)
    return float(max(at[0], 1e-3)), float(at[1])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for begin, end in in_chunks(texts, lambda t: len(t or "")):
            slots = pa.array(features(texts[begin:end]), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin), slots], ["id", "label", "slots"])


def train(docs: DataFrame, labels: DataFrame, label: Column, most_rows: int = MOST_ROWS, most_slots: int = MOST_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of ``label`` (1 or 0) over at most ``most_rows`` labelled documents and ``most_slots`` of their slots."""
    known = labels.filter(F.col(id_col).isNotNull() & label.isNotNull()).groupBy(id_col).agg(F.min(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64(id_col), id_col).limit(most_rows)
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(known), id_col)  # at most most_rows rows
    rows = rows.groupBy(id_col, "label").agg(F.min("text").alias("text"))  # one for each id
    found = rows.select(F.col(id_col).cast("long").alias("id"), "label", "text").mapInArrow(_featurise, "id long, label int, slots array<int>")
    found = stored(found, "features")
    upto = F.expr("sum(size(slots)) OVER (ORDER BY xxhash64(id), id)")  # at most most_rows narrow rows
    taken = found.select("id", upto.alias("upto")).filter(F.col("upto") <= most_slots).select("id")
    got = found.join(F.broadcast(taken), "id").toArrow().sort_by("id")
    y = np.array(got["label"].to_pylist(), np.int32)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(SLOTS, np.float32), 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    ids = got["id"].to_numpy().view(np.uint64)
    column = got["slots"].combine_chunks()
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    slots = [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return fit(slots, y, mix(ids) % np.uint64(FOLDS) == 0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # SLOTS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in in_chunks(texts, lambda t: len(t or "")):
                scores = pa.array([own.score(s) for s in features(texts[begin:end])], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), scores], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)
