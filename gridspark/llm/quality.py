"""A quality classifier: support vectors over naive Bayes log-count ratios of n-gram indicators.

A text is the set of its n-grams, hashed: byte trigrams, words, and runs of one to four word shapes (letters,
capitals, digits and marks, and whether a word repeats the one before). Each indicator is scaled by the log ratio of
its smoothed share in the two classes, vectors are brought to length one, and a linear hinge-loss
model is fitted by dual coordinate descent; a logistic curve on rows kept out of that fit turns margins into scores.

The fit reads a bounded sample of labelled rows (at most `max_rows`, about half of each class where there are so many,
chosen by hash of their ids); scoring reads every whole text. Only texts and labels enter the model.

Defined results: null and empty texts have no n-grams and get the score of margin zero; without labels of both classes
every score is the share of label 1, or 0.5 without any. An id that is labelled several times has its greatest label; documents that share an id
all enter the fit while they fit within `max_rows`, else none of that id does. Repeated rows and ties have equal scores; a very long text is a bounded
set of n-grams, whose words and shapes are whole; an empty table gives an empty table; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, in_batches

BITS = 18
SIZE = 1 << BITS
SHAPES = 4
#: Words whose hashes a worker remembers.
CACHE = 300_000

_CLASSES = [(re.compile(p), s) for p, s in ((rb"[a-z\x80-\xff]+", b"x"), (rb"[A-Z]+", b"X"), (rb"[0-9]+", b"0"))]
_ODD = np.random.default_rng(6).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def _fold(x: np.ndarray, k: int) -> np.ndarray:
    return ((x * _ODD[k]) >> np.uint64(64 - BITS)).astype(np.int32)


class Words(dict):
    """(hash, shape hash) of each word, remembered within a bound."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        shape = word
        for pattern, s in _CLASSES:
            shape = pattern.sub(s, shape)
        out = crc32(word), crc32(shape)
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


def ngrams(text: str | None, words: Words) -> np.ndarray:
    """The distinct hashed n-grams of a text, sorted."""
    raw = (text or "").encode("utf-8", "replace")
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    found = np.zeros(SIZE, bool)
    if len(b) >= 3:
        tri = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        found[_fold(tri.astype(np.uint64), 0)] = True
    tokens = raw.split()
    if tokens:
        pairs = np.array([words[t] for t in tokens], np.uint64)
        word, shape = pairs[:, 0], pairs[:, 1]
        found[_fold(word + np.uint64(1 << 33), 1)] = True
        same = np.r_[False, word[1:] == word[:-1]]
        shape = np.where(same, shape + np.uint64(1 << 32), shape)
        run = shape
        for n in range(1, SHAPES + 1):
            found[_fold(run, 1 + n)] = True
            if n < SHAPES:
                run = run[:-1] * _ODD[8 + n] + shape[n:]
    return np.flatnonzero(found).astype(np.int32)


@dataclass
class Model:
    """use: weight times ratio of each n-gram; square: its squared ratio; slope and shift: of the logistic curve."""

    use: np.ndarray
    square: np.ndarray
    slope: float
    shift: float

    def margin(self, grams: np.ndarray) -> float:
        norm = self.square[grams].sum()
        return float(self.use[grams].sum() / np.sqrt(norm)) if norm > 0 else 0.0

    def score(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def ratios(docs: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = np.full(SIZE, smooth), np.full(SIZE, smooth)
    for g, label in zip(docs, y):
        (p if label > 0 else q)[g] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(docs: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float = 1.0, rounds: int = 8, seed: int = 6) -> np.ndarray:
    """Dual coordinate descent for the hinge loss; rows are unit vectors, so each step is exact."""
    w, alpha, rng = np.zeros(SIZE), np.zeros(len(docs)), np.random.default_rng(seed)
    rows = [(g, x / n) if (n := np.linalg.norm(x := r[g])) > 0 else (g, x) for g in docs]
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            g, x = rows[i]
            if not len(g):
                continue
            a = min(max(alpha[i] - (y[i] * float(w[g] @ x) - 1), 0.0), c)
            if a != alpha[i]:
                w[g] += (a - alpha[i]) * y[i] * x
                alpha[i] = a
    return w


def logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, with labels a little inside 0 and 1."""
    n1, n0 = weight[y > 0].sum(), weight[y <= 0].sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([m, np.ones_like(m)], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (t - p)))
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(beta[0], 1e-6)), float(beta[1])


def fit(docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> Model:
    y = np.where(labels > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(SIZE), np.ones(SIZE), 1.0, float(np.log(share / (1 - share))))
    kept = np.arange(len(y)) % 5 == 0  # rows come in hash order
    part = [g for g, k in zip(docs, kept) if not k]
    r = ratios(part, y[~kept])
    w = descend(part, y[~kept], r)
    model = Model(w * r, r * r, 1.0, 0.0)
    m = np.array([model.margin(g) for g, k in zip(docs, kept) if k])
    model.slope, model.shift = logistic(m, y[kept], weight[kept])
    r = ratios(docs, y)
    w = descend(docs, y, r)
    return Model(w * r, r * r, model.slope, model.shift)


def learn(docs: DataFrame, labels: DataFrame, *, use: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 6000) -> Model:
    """Fits on at most `max_rows` labelled documents among those where `use` (of the labels' columns) holds."""
    known = labels.where(F.coalesce(use, F.lit(False))) if use is not None else labels
    known = known.select(col(id_col).cast("long").alias("id"), (col(label_col) > 0).cast("int").alias("y")).where("y is not null and id is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("id", F.lit(6)))
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}  # two rows
    if not sizes:
        return fit([], np.zeros(0), np.zeros(0))
    rates = {k: min(1.0, max_rows / len(sizes) / n) for k, n in sizes.items()}
    rate = F.when(F.col("y") == 1, F.lit(rates.get(1, 0.0))).otherwise(F.lit(rates.get(0, 0.0)))
    known = known.where((F.col("h").cast("double") + 2.0**63) / 2.0**64 < rate)
    # About max_rows distinct ids are left, so they may be broadcast, and collected with how many documents each has.
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id")
    taken, held = [], 0
    for r in sorted(rows.groupBy("id", "y", "h").count().collect(), key=lambda r: r["h"]):
        if held + r["count"] <= max_rows:
            held += r["count"]
            taken.append((r["id"],))
    taken = docs.sparkSession.createDataFrame(taken, "id long")
    rows = rows.join(F.broadcast(taken), "id", "left_semi").select("h", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            grams = [ngrams(t.as_py(), words).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(grams, pa.binary())], names=["h", "y", "grams"])

    got = in_batches(rows).mapInArrow(run, "h long, y int, grams binary").toArrow()
    grams = got["grams"].to_pylist()
    order = sorted(range(len(grams)), key=lambda i: (got["h"][i].as_py(), grams[i]))
    y = got["y"].to_numpy()[order]
    sample = [np.frombuffer(grams[i], np.int32) for i in order]
    return fit(sample, y, np.array([1 / rates[int(k)] for k in y]))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, margin, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            m = np.fromiter((model.margin(ngrams(t.as_py(), words)) for t in b.column(1)), float, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m), pa.array(model.score(m))], names=["id", "margin", "score"])

    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    return in_batches(rows).mapInArrow(run, "id long, margin double, score double")
