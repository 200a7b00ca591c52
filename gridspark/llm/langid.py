"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary. The probability of a text is
the sum over all its segmentations into pieces, which the forward algorithm gives; as pieces do not cross
words, a text's log probability is the sum over its words, each distinct word being computed once by a worker.

The piece probabilities are learned by expectation maximisation over word counts of a bounded sample
of labelled rows (`per_language` rows of each language, those with the smallest hashes by rate). What is
collected is one number a piece and language.

Defined results: null text or text without a letter is `und` with score 0, as is every text if nothing
could be learned; rows with a null language are not learned from; ties go to the language
first in code-point order; repeated rows have equal results; very long texts are scored whole, from their distinct words; an empty table gives an empty table;
other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged, col, in_batches
from .pieces import CACHE, CACHE_LENGTH, MARK, Vocabulary, vocabulary, words_of

#: Between words when many are searched in one go; no piece holds it.
GAP = "\x00"
#: Characters of words that are searched and summed in one go.
BLOCK = 200_000


class Lattice:
    """All pieces at all places of some words, and sums over paths through them, for many weights at once."""

    def __init__(self, v: Vocabulary, words: list[str]):
        self.v = v
        marked = [MARK + w.replace(GAP, "\x01") for w in words]
        lengths = np.fromiter(map(len, marked), np.int64, len(marked))
        joined = GAP.join(marked)
        found = np.fromiter(chain.from_iterable(v.automaton.iter(joined)), np.int64).reshape(-1, 2)
        end, piece = found[:, 0] + 1, found[:, 1]
        start = end - v.lengths[piece]
        # Characters without a piece of their own are edges of their bytes.
        lone = np.array([i for i, c in enumerate(joined) if c != GAP and c not in v.singles], np.int64)
        self.bytes = [v.byte_ids(joined[i]) for i in lone]
        k = len(v) + np.arange(len(lone))
        start, end, piece = np.r_[start, lone], np.r_[end, lone + 1], np.r_[piece, k]
        self.first = np.cumsum(lengths + 1) - lengths - 1  # each word's place; its last node is first + length
        self.last = self.first + lengths
        word = np.searchsorted(self.first, start, "right") - 1
        depth = end - self.first[word]
        order = np.lexsort((end, depth))
        self.start, self.end, self.piece, self.word, depth = start[order], end[order], piece[order], word[order], depth[order]
        self.steps = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1], True]) if len(depth) else np.array([0])
        self.nodes = len(joined) + 1

    def weights(self, logp: np.ndarray) -> np.ndarray:
        """Log weight of each edge; rows follow self.piece."""
        least = logp.min(0) - 1
        extra = [logp[b].sum(0) if b else least for b in self.bytes]
        return (np.vstack([logp, np.array(extra).reshape(-1, logp.shape[1])]) if extra else logp)[self.piece]

    @staticmethod
    def _sum(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log sums of runs of equal `at`."""
        cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        top = np.maximum.reduceat(values, cut)
        runs = np.repeat(np.arange(len(cut)), np.diff(np.r_[cut, len(at)]))
        return at[cut], top + np.log(np.add.reduceat(np.exp(values - top[runs]), cut))

    def forward(self, w: np.ndarray) -> np.ndarray:
        a = np.full((self.nodes, w.shape[1]), -np.inf)
        a[self.first] = 0
        for i, j in zip(self.steps[:-1], self.steps[1:]):
            at, total = self._sum(a[self.start[i:j]] + w[i:j], self.end[i:j])
            a[at] = total
        return a

    def backward(self, w: np.ndarray) -> np.ndarray:
        b = np.full((self.nodes, w.shape[1]), -np.inf)
        b[self.last] = 0
        left = self.last[self.word] - self.start  # characters from an edge's start to its word's end
        order = np.lexsort((self.start, left))
        cuts = np.flatnonzero(np.r_[True, np.diff(left[order]) != 0, True]) if len(order) else [0]
        for i, j in zip(cuts[:-1], cuts[1:]):
            e = order[i:j]
            at, total = self._sum(b[self.end[e]] + w[e], self.start[e])
            b[at] = total
        return b

    def log_probability(self, logp: np.ndarray) -> np.ndarray:
        return self.forward(self.weights(logp))[self.last]

    def expected(self, logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece and language, for counts of each word and language."""
        w = self.weights(logp)
        a, b = self.forward(w), self.backward(w)
        use = np.exp(a[self.start] + w + b[self.end] - a[self.last][self.word]) * counts[self.word]
        out = np.zeros_like(logp)
        known = self.piece < len(logp)
        np.add.at(out, self.piece[known], use[known])
        for piece, u in zip(self.piece[~known] - len(logp), use[~known]):
            for i in self.bytes[piece]:
                out[i] += u
        return out

    def matches(self, counts: np.ndarray) -> np.ndarray:
        """Places of each piece, weighed by counts; a start for the expectations."""
        out = np.zeros((len(self.v), counts.shape[1]))
        known = self.piece < len(out)
        np.add.at(out, self.piece[known], counts[self.word[known]])
        return out


def blocks(words: list[str], size: int = BLOCK) -> Iterator[slice]:
    at = total = 0
    for i, w in enumerate(words):
        total += len(w) + 2
        if total >= size:
            yield slice(at, i + 1)
            at, total = i + 1, 0
    if at < len(words):
        yield slice(at, len(words))


class Model:
    """Languages in code-point order, and log probabilities of pieces by language."""

    def __init__(self, languages: list[str], uses: np.ndarray, smooth: float = 0.1):
        self.languages = languages
        p = uses + smooth
        self.logp = np.log(p / p.sum(0))


def _word_counts(rows: DataFrame) -> DataFrame:
    """(word, lang, n) of (lang, text); counted in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out():
            for lang, c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([lang] * len(c), pa.string()), pa.array(c.values(), pa.int64())], names=["word", "lang", "n"])
            counts.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                counts.setdefault(lang, Counter()).update(words_of(text.as_py() or ""))
            if sum(map(len, counts.values())) > CACHE:
                yield from out()
        yield from out()

    return in_batches(rows).mapInArrow(run, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, path: str, *, use: Column | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 4000, rounds: int = 2) -> Model:
    """A model of at most about `per_language` rows of each language among those where `use` holds."""
    staged = Staged(docs.sparkSession, "langid")
    rows = docs.where(F.coalesce(use, F.lit(False))) if use is not None else docs
    rows = rows.select(col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text"), F.xxhash64(col(id_col), F.lit(10)).alias("h"))
    rows = rows.where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row a language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1, 0)))
    rate = F.lit(0.0)
    for lang in languages:
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / sizes[lang]))).otherwise(rate)
    # Rates that are kept by rows' hashes: the same rows at each run.
    rows = rows.where((F.col("h").cast("double") + 2.0**63) / 2.0**64 < rate).select("lang", "text")
    words = staged.put(_word_counts(rows))
    index = {x: i for i, x in enumerate(languages)}

    def summed(of) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            v, total = vocabulary(path), None
            for pdf in batches:
                w, k = pdf["word"].to_numpy(), pdf["lang"].map(index).to_numpy()
                codes, distinct = pd.factorize(w)
                counts = np.zeros((len(distinct), len(languages)))
                np.add.at(counts, (codes, k), pdf["n"].to_numpy(float))
                distinct = list(distinct)
                for s in blocks(distinct):
                    got = of(Lattice(v, distinct[s]), counts[s])
                    total = got if total is None else total + got
            if total is not None:
                i, k = np.nonzero(total)
                yield pd.DataFrame({"piece": i, "k": k, "x": total[i, k]})

        got = words.mapInPandas(run, "piece long, k long, x double").groupBy("piece", "k").agg(F.sum("x").alias("x"))
        out = np.zeros((len(vocabulary(path)), len(languages)))
        for piece, k, x in got.collect():  # at most one number a piece and language
            out[piece, k] = x
        return out

    model = Model(languages, summed(lambda lattice, counts: lattice.matches(counts)))
    for _ in range(rounds):
        logp = model.logp
        model = Model(languages, summed(lambda lattice, counts, logp=logp: lattice.expected(logp, counts)))
    staged.drop(words)
    return model


#: Words whose scores a worker keeps; beyond it those seen in one text only go.
KEPT = 600_000


class Scores(dict):
    """Places in a table of log probabilities of words, remembered within a bound."""

    def __init__(self, v: Vocabulary, model: Model):
        self.v, self.model, self.n = v, model, 0
        self.table, self.texts = np.zeros((1 << 14, len(model.languages))), np.zeros(1 << 14, np.int32)

    def add(self, texts: list[list[str]]) -> None:
        """Makes room for the words of these texts, and computes those that are new."""
        if self.n > KEPT:
            self._thin()
        new = list(set(chain.from_iterable(texts)).difference(self))
        need = self.n + len(new)
        if need > len(self.table):
            more = max(need - len(self.table), len(self.table) // 2)
            self.table = np.vstack([self.table, np.zeros((more, self.table.shape[1]))])
            self.texts = np.r_[self.texts, np.zeros(more, np.int32)]
        for s in blocks(new):
            part = new[s]
            self.table[self.n : self.n + len(part)] = Lattice(self.v, part).log_probability(self.model.logp)
            self.texts[self.n : self.n + len(part)] = 0
            self.update(zip(part, range(self.n, self.n + len(part))))
            self.n += len(part)

    def _thin(self) -> None:
        """Keeps words of several texts, if they are at most half of the bound; long words are never kept."""
        keep = [(w, i) for w, i in self.items() if self.texts[i] > 1 and len(w) <= CACHE_LENGTH]
        keep = keep if len(keep) <= KEPT // 2 else []
        at = np.array([i for _, i in keep], np.int64)
        self.table[: len(at)], self.n = self.table[at], len(at)
        self.texts[: len(at)] = 0
        self.clear()
        self.update((w, k) for k, (w, _) in enumerate(keep))

    def drop_long(self, texts: list[list[str]]) -> None:
        """Forgets the long words of these texts: their length has no bound."""
        for w in chain.from_iterable(texts):
            if len(w) > CACHE_LENGTH:
                self.pop(w, None)

    def text(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self.texts[at] += 1
        return self.table[at].sum(0)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text))


def identify(docs: DataFrame, model: Model, path: str, *, id_col: str = "doc_id", text_col: str = "text", at_once: int = 1 << 20) -> DataFrame:
    """(id, lang_pred, score): the likeliest language of every whole text. The score is its share after each language's log probability is
    divided by the root of the number of words, which keeps long texts from all scoring 1."""
    languages = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(vocabulary(path), model)
        for b in batches:
            pred, conf, held, size = ["und"] * b.num_rows, np.zeros(b.num_rows), [], 0

            def settle():
                scores.add([w for _, w in held])
                for i, words in held:
                    x = scores.text(words) / np.sqrt(len(words))
                    best = int(x.argmax())
                    pred[i], conf[i] = languages[best], 1 / np.exp(x - x[best]).sum()
                scores.drop_long([w for _, w in held])
                held.clear()

            for i, t in enumerate(b.column(1)):
                text = t.as_py()
                if text and languages and has_letter(text):
                    held.append((i, words_of(text)))
                    size += len(text)
                if size > at_once:
                    settle()
                    size = 0
            settle()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(conf)], names=["id", "lang_pred", "score"])

    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    return in_batches(rows).mapInArrow(run, "id long, lang_pred string, score double")
