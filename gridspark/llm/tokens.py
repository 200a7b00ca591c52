"""Token counts by a count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates the pieces that end at each character; a dynamic program carries the best score and
the number of pieces of the best segmentation, and no segmentation itself. Ties are broken as the
tokenizer breaks them: a later candidate must be strictly better, candidates come in order
of their start. A character that no piece covers costs the least score less a penalty and counts as its bytes.

Defined results: null or empty text has 0 tokens; a null id is carried; very long texts are counted whole, a word at a time; repeated rows and ties are
rows of their own with equal counts; an empty table gives an empty table; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, in_batches
from .pieces import CACHE, CACHE_LENGTH, MARK, Vocabulary, vocabulary, words_of

_LOWEST = float("-inf")


class Counts(dict):
    """Pieces of each word's best segmentation, remembered within a bound."""

    def __init__(self, v: Vocabulary):
        self.v, self.pairs = v, [(int(n), float(s)) for n, s in zip(v.lengths, v.scores)]

    def __missing__(self, word: str) -> int:
        n = self.count(MARK + word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n

    def count(self, marked: str) -> int:
        v, pairs, m = self.v, self.pairs, len(marked)
        best, pieces = [_LOWEST] * (m + 1), [0] * (m + 1)
        best[0] = 0.0
        done = 0  # ends before this are final

        def unknown(e: int) -> None:
            """The edge over a character without a piece of its own; its start is the last candidate of its end."""
            c = marked[e - 1]
            if c not in v.singles and best[e - 1] + v.unknown_score > best[e]:
                best[e] = best[e - 1] + v.unknown_score
                pieces[e] = pieces[e - 1] + (len(v.byte_ids(c)) or 1)

        for last, piece in v.automaton.iter(marked):
            e = last + 1
            while done < e - 1:
                done += 1
                unknown(done)
            length, score = pairs[piece]
            s = e - length
            got = best[s] + score
            if got > best[e]:
                best[e], pieces[e] = got, pieces[s] + 1
        while done < m:
            done += 1
            unknown(done)
        return pieces[m]


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, n_tokens) of every whole text, for the vocabulary file at `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counts(vocabulary(path))
        get = seen.__getitem__
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            n = np.fromiter((sum(map(get, words_of(t))) for t in texts), np.int64, len(texts))
            chars = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chars), pa.array(n)], names=["id", "n_chars", "n_tokens"])

    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    return in_batches(rows).mapInArrow(run, "id long, n_chars long, n_tokens long")
