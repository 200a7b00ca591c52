"""Best-fit packing of token pieces by exact-complement hashing.

Only the number of pieces of each length matters for the plan, at most `size` numbers however many
pieces there are. An index of single, pair and triple sums of the lengths that are
still available finds what fills a gap exactly, as many times at once as the counts
allow: first the gaps of long pieces by long ones, then, once best fit has placed the middling ones, the gaps that are open by
a reserve of short ones; the residuals go by best fit, again by counts. A plan is then a short list of patterns
with multiplicities, and a piece finds its place by its rank among the pieces of its length. Rows are numbered once, as they are
written, and dealt by that number, so no length and no repeated row gathers in one task.

Defined results: a null or empty text is the end token alone, so is a null id's; a very long text is cut into
pieces of `size`, of which only the first may be shorter; repeated rows and ties of length are packed as rows of
their own; columns named sequence_id or offset are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Staged, col, fresh, in_batches

END_ID = 2
#: Least long piece and first length over the reserve of short ones, as parts of a sequence. Chosen by plans of counts resampled from real lengths.
LONG, SHORT = (5, 16), (1, 8)


class Tokenizer:
    """Ids of a byte-level BPE file of the tokenizers library.

    Where the file's ids are its merge ranks, the same merges run in tiktoken, which is about four times as fast; texts
    with the string of a special token, and files of another kind, go to the library itself.
    """

    def __init__(self, path: str):
        import json

        import tokenizers

        self.slow = tokenizers.Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._fast(spec)

    def _fast(self, spec: dict):
        import tiktoken
        from public_tokenizers import PATTERN

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        if not plain:
            return None
        # Printable bytes stand for themselves, the others for the code points from 256 on, in order.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"]["".join(m)] for m in merges]
        if made != sorted(set(made)) or len(ranks) != 256 + len(made) or (made and made[0] != 256):
            return None
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than size."""
    first = n if n <= size else n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def tokenize(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every whole text's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        end = np.array([end_id], "<u4")
        for b in batches:
            out: list[tuple] = []
            held = 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.concatenate([tok.ids(t.as_py() or ""), end])
                raw = ids.tobytes()
                out += [(i, k, s, n, raw[4 * s : 4 * (s + n)]) for k, (s, n) in enumerate(cut(len(ids), size))]
                held += len(raw)
                if held > 8 << 20:
                    yield _pieces(out)
                    out, held = [], 0
            if out:
                yield _pieces(out)

    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    return in_batches(rows).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["doc_id", "piece", "start", "length", "ids"])


class Sums:
    """An index of the sums of one, two and three available lengths: sum to combinations, those of a longer first piece first.

    `left` holds the pieces of each length that are still there; the index says what adds up, `left` whether it can be had."""

    def __init__(self, left: np.ndarray, least: int, most: int):
        self.left, self.lengths = left, [x for x in range(min(most, len(left) - 1), least - 1, -1) if left[x]]
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        for i, a in enumerate(self.lengths):
            for b in self.lengths[i:]:
                if a + b <= most:
                    self.pairs.setdefault(a + b, []).append((a, b))

    def fills(self, gap: int, pieces: int) -> Iterator[tuple[int, ...]]:
        """Combinations of up to so many pieces whose sum is the gap; none for no gap."""
        if not gap:
            yield ()
            return
        if self.left[gap]:
            yield (gap,)
        yield from self.pairs.get(gap, ())
        if pieces > 2:
            for a in self.lengths:
                if 3 * a < gap:
                    break
                yield from ((a, *p) for p in self.pairs.get(gap - a, ()) if p[0] <= a)

    def take(self, lengths: tuple[int, ...], most: int) -> int:
        """Uses up the combination as often as the counts allow, up to `most` times."""
        need = Counter(lengths)
        n = min([most, *(int(self.left[x]) // k for x, k in need.items())])
        for x, k in need.items():
            self.left[x] -= n * k
        return n


class Plan:
    """Patterns (lengths that share a sequence, how many such sequences) for given counts of lengths.

    1. From the longest length down, a long piece takes one long piece or two that fill its gap exactly.
    2. What is left goes by best fit, from the longest down to the reserve of short pieces.
    3. The gaps that are open then, the least first, are filled exactly by one, two or three pieces of the reserve.
    4. The rest of the reserve goes by best fit.

    The reserve is what makes exact filling pay: spent early, short pieces are missing where middling ones leave odd gaps.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.size, self.left, self.patterns = size, np.zeros(size + 1, np.int64), []
        self.open: dict[int, list[tuple]] = {}  # gap to (lengths, how many sequences)
        self.gaps: list[int] = []
        for length, n in counts.items():
            self.left[length] += n
        long, short = max(1, size * LONG[0] // LONG[1]), max(1, size * SHORT[0] // SHORT[1])
        index = Sums(self.left, long, size - long)
        for length in range(size, long - 1, -1):
            if self.left[length]:
                for parts in index.fills(size - length, 2):
                    if min(parts, default=long) >= long and (n := index.take((length, *parts), size * int(self.left.sum()))):
                        self.patterns.append(((length, *parts), n))
        self._best_fit(size, short)
        index = Sums(self.left, 1, short - 1)
        for gap in list(self.gaps):
            self._exact(gap, index)
        self._best_fit(short - 1, 1)
        self.patterns += [p for ps in self.open.values() for p in ps]

    def _put(self, lengths: tuple[int, ...], n: int) -> None:
        gap = self.size - sum(lengths)
        if gap not in self.open:
            insort(self.gaps, gap)
            self.open[gap] = []
        self.open[gap].append((lengths, n))

    def _pop(self, gap: int) -> tuple[tuple[int, ...], int]:
        out = self.open[gap].pop()
        if not self.open[gap]:
            del self.open[gap]
            self.gaps.remove(gap)
        return out

    def _exact(self, gap: int, index: Sums) -> None:
        """Fills open sequences of a gap from the index, as often as the counts allow."""
        fills = index.fills(gap, 3) if gap else iter(())
        parts = next(fills, None)
        while parts and gap in self.open:
            lengths, n = self._pop(gap)
            used = index.take(parts, n)
            if used:
                self.patterns.append(((*lengths, *parts), used))
            if n > used:
                self._put(lengths, n - used)
                parts = next(fills, None)

    def _best_fit(self, longest: int, least: int) -> None:
        for length in range(longest, least - 1, -1):
            n = int(self.left[length])
            while n:
                i = bisect_left(self.gaps, length)
                if i == len(self.gaps):
                    k = self.size // length  # a new sequence takes as many as fit
                    self._put((length,) * min(n, k), n // k or 1)
                    n = n % k if n >= k else 0
                    continue
                lengths, m = self._pop(self.gaps[i])
                used = min(n, m)
                if m > used:
                    self._put(lengths, m - used)
                self._put((*lengths, length), used)
                n -= used
            self.left[length] = 0

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)

    def slots(self) -> dict[str, np.ndarray]:
        """Runs of ranks, sorted by (length, first rank): first sequence and offset of each."""
        next_rank, rows, seq = [0] * (self.size + 1), [], 0
        for lengths, n in self.patterns:
            at = 0
            for x in lengths:
                rows.append((x, next_rank[x], seq, at))
                next_rank[x] += n
                at += x
            seq += n
        rows.sort()
        return dict(zip(("length", "rank", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 4).T))


def pack(pieces: DataFrame, *, size: int = 1024, length_col: str = "length", rows_per_bucket: int = 8192) -> DataFrame:
    """Adds sequence_id and offset to pieces of lengths 1..size. All columns are carried; where `pieces` has columns of these names
    they are replaced."""
    staged = Staged(pieces.sparkSession, "packing")
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    row, bucket, first, rank, place = (fresh(x, names) for x in ("row_", "bucket_", "first_", "rank_", "place_"))
    t = staged.put(pieces.select(*map(col, names), F.monotonically_increasing_id().alias(row)))
    length = col(length_col)
    counts = {int(r[0]): int(r[1]) for r in t.groupBy(length).count().collect()}  # at most `size` rows
    if any(x < 1 or x > size for x in counts):
        raise ValueError(f"lengths must be from 1 to {size}")
    slots = Plan(counts, size).slots()

    # Ranks within a length: buckets of rows by a hash of their number, sums over buckets, then rows within a bucket.
    n_buckets = max(1, -(-sum(counts.values()) // rows_per_bucket))
    t = t.withColumn(bucket, F.pmod(F.xxhash64(row), F.lit(n_buckets)))
    order = W.partitionBy(length_col).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sums = t.groupBy(length_col, bucket).agg(F.count("*").alias(first)).withColumn(first, F.coalesce(F.sum(first).over(order), F.lit(0)))
    within = W.partitionBy(length_col, bucket).orderBy(row)
    ranked = t.withColumn(rank, F.row_number().over(within) - 1).join(sums, [length_col, bucket]).withColumn(rank, F.col(rank) + F.col(first))

    # The plan has a few patterns a length, so it fits in a closure whatever the number of pieces.
    keys = slots["length"] * (1 << 44) + slots["rank"]
    sequence, offset, starts = slots["sequence"], slots["offset"], slots["rank"]

    @F.pandas_udf("sequence_id long, offset long")
    def place_of(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, length.to_numpy(np.int64) * (1 << 44) + rank.to_numpy(np.int64), "right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank.to_numpy(np.int64) - starts[at], "offset": offset[at]})

    out = ranked.withColumn(place, place_of(length.cast("long"), F.col(rank).cast("long")))
    return out.select(*map(col, names), F.col(place).sequence_id.alias("sequence_id"), F.col(place).offset.alias("offset"))
