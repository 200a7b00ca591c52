"""Removal of repeated byte strings, by a depth-limited radix sort of suffixes.

A suffix matters only through its first `depth` bytes (a window), and only windows that occur twice. Most-significant-digit
passes split windows into ever finer groups; a group of one leaves the sort at once, and
the groups equal through all digits are exactly the repeated windows.

A prefilter says which windows enter the sort, and where. The `gram`-byte string of least hash in a window (its anchor,
leftmost of equals) is the same, at the same place, in equal windows; neighbouring windows share theirs, so a run of
windows is one record and a few percent of all suffixes are ever moved. Runs are dealt by their anchors' hashes. A run equal
to an earlier one (by 128 bits of hashes) is a repeat from end to end; a run alone with its anchor leaves. What is open then
is sorted from its bytes: the anchor and its place first, then the window's own bytes, eight at a time, to the depth.

Records travel as packed columns in a row for each task and bucket. Repeats within one task's batch are settled there, so
a string that a third of all texts hold is one record a batch. An anchor of very many different runs (one line in every
document, ever other words around it) overloads its bucket; records are counted by bucket over all tasks, and the
anchors that make a bucket overloaded are split by all their digits at once: their windows go on one by one, dealt and compared by hashes of
all their bytes (128 bits with the anchor's), so they spread over all tasks.

Defined results: null text is empty; a text shorter than depth loses nothing; documents are ordered by id, null first; rows that have
the same id are one document for the order, so an equal row is no earlier copy of itself, and a string at one place of two texts of an id
is no repeat; rows equal in id and text have one result each; a very long text is read in segments that overlap by depth - 1 bytes;
an empty table gives an empty table. Other columns are carried in a struct, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, by_group, col, in_batches, small

#: Bytes read at once by a task, and the most that one segment of a long text has.
SEGMENT = 1 << 17
#: Windows sorted at once by a task.
AT_ONCE = 1 << 19
NULL_ID = -(1 << 63)

_RNG = np.random.default_rng(20_240_229)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _join(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Hash of two adjoining strings from their hashes."""
    x = a * _ODD[2 * k]
    x ^= x >> np.uint64(31)
    x += b
    x *= _ODD[2 * k + 1]
    x ^= x >> np.uint64(29)
    return x


class Hashes:
    """Hashes of the strings of given lengths at every place of some bytes; places too near the end have none."""

    def __init__(self, data: np.ndarray):
        self.level = [_BYTE[data]]  # of 1, 2, 4, ... bytes

    def of(self, length: int) -> np.ndarray:
        out, at = None, 0
        n = len(self.level[0]) - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        for k in reversed(range(length.bit_length())):
            while len(self.level) <= k:
                x, s = self.level[-1], 1 << (len(self.level) - 1)
                self.level.append(_join(x[:-s], x[s:], len(self.level)) if len(x) > s else np.zeros(0, np.uint64))
            if length >> k & 1:
                part = self.level[k][at : at + n]
                out = part if out is None else _join(out, part, 16 + k)
                at += 1 << k
        return out


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for every i."""
    n, have = len(x) - width + 1, 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def runs(data: np.ndarray, edges: np.ndarray, depth: int, gram: int) -> dict[str, np.ndarray]:
    """The runs of windows of documents that lie side by side in data, at edges[i] to edges[i + 1]: doc, start (of the first window,
    within data), more (windows after the first), place (of the anchor in the first window), digit and body (hashes)."""
    h = Hashes(data)
    window = h.of(depth)
    if not len(window):
        z = np.zeros(0, np.int64)
        return {"doc": z, "start": z, "more": z, "place": z, "digit": z.astype(np.uint64), "body": z.astype(np.uint64), "window": window}
    grams = h.of(gram)
    order = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_least(order, depth - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    last = np.repeat(edges[1:], np.diff(edges))[: len(window)] - depth  # of the place's document
    ok = np.arange(len(window)) <= last
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[: len(window)]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])] & ok
    start = np.flatnonzero(new)
    # A run goes on to the next run's start or its document's last window.
    stop = np.minimum(np.r_[start[1:], len(window)] - 1, last[start])
    # Two runs are one when all their bytes are, told by their first and last windows (which overlap), their length and the anchor's place.
    body = _join(_join(window[start], window[stop], 20), (stop - start).astype(np.uint64) << np.uint64(8) | (anchor[start] - start).astype(np.uint64), 21)
    return {"doc": doc[start], "start": start, "more": stop - start, "place": anchor[start] - start, "digit": grams[anchor[start]], "body": body, "window": window}


def expand(start: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, place) of every window of runs."""
    n = more.astype(np.int64) + 1
    run = np.repeat(np.arange(len(n)), n)
    return run, start[run].astype(np.int64) + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)


#: Columns of packed records: runs; spans to remove; open runs (with their bytes, one run after another); single windows of overloading anchors.
RUN = {"digit": "<u8", "body": "<u8", "doc": "<i8", "tag": "<i8", "start": "<u4", "more": "u1", "place": "u1"}
MARK = {"m_doc": "<i8", "m_tag": "<i8", "m_start": "<u4", "m_stop": "<u4"}
OPEN = {"digit": "<u8", "doc": "<i8", "tag": "<i8", "start": "<u4", "more": "u1", "place": "u1"}
SINGLE = {"w_digit": "<u8", "w_hash": "<u8", "w_doc": "<i8", "w_tag": "<i8", "w_start": "<u4"}

#: What the prefilter finds: spans to remove (kind 0), runs to sort (1) and runs whose windows go on one by one (2).
FOUND = "kind int, doc long, tag long, start long, stop long, digit long, place int"
SPANS = "doc long, tag long, start long, stop long"
#: The bucket of spans that a task found for itself.
SETTLED = -1


def _ddl(columns: dict) -> str:
    return "bucket int, " + ", ".join(f"{c} binary" for c in columns)


def _split(bucket: np.ndarray, cols: dict[str, np.ndarray]) -> dict[int, dict[str, bytes]]:
    """The rows of each bucket, packed."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True]) if len(order) else [0]
    at = {int(bucket[order[i]]): order[i:j] for i, j in zip(cut[:-1], cut[1:])}
    return {k: {c: x[o].tobytes() for c, x in cols.items()} for k, o in at.items()}


def _batch(parts: dict[int, dict[str, bytes]], columns: list[str]) -> pa.RecordBatch:
    arrays = [pa.array(list(parts), pa.int32())] + [pa.array([p.get(c, b"") for p in parts.values()], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", *columns])


def _unpack(rows, columns: dict) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(b"".join(rows[c]), t) for c, t in columns.items()}


def _bucket(digit: np.ndarray, buckets: int) -> np.ndarray:
    return ((digit >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def settle(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the records that go on for each (digit, body), in that order, and of those that repeat an earlier one.

    The first goes on, and with it those of other texts of its id at its place; a record that is there twice goes on once."""
    order = np.lexsort((x["tag"], x["start"], x["doc"], x["body"], x["digit"]))
    if not len(order):
        return order, order
    same = lambda c: x[c][order][1:] == x[c][order][:-1]
    group = same("digit") & same("body")
    first = order[np.r_[True, ~group]][np.cumsum(np.r_[0, ~group])]
    later = (x["doc"][order] != x["doc"][first]) | (x["start"][order] != x["start"][first])
    again = np.r_[False, group & same("doc") & same("start") & same("tag")]
    return order[~later & ~again], order[later]


def settle_single(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return settle({"digit": w["w_digit"], "body": w["w_hash"], "doc": w["w_doc"], "tag": w["w_tag"], "start": w["w_start"]})


def _coalesce(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, stop: np.ndarray) -> dict[str, np.ndarray]:
    """Spans, those of a text that touch joined."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, stop = doc[order], tag[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    if not len(doc):
        return {"m_doc": doc, "m_tag": tag, "m_start": start.astype("<u4"), "m_stop": stop.astype("<u4")}
    text = np.cumsum(np.r_[0, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    reach = np.maximum.accumulate(stop + (text << 33))  # texts lie apart, so the running reach never crosses them
    new = np.r_[True, start[1:] + (text[1:] << 33) > reach[:-1]]
    at = np.flatnonzero(new)
    end = reach[np.r_[at[1:], len(reach)] - 1] - (text[at] << 33)
    return {"m_doc": doc[at], "m_tag": tag[at], "m_start": start[at].astype("<u4"), "m_stop": end.astype("<u4")}


def _spans(m: dict[str, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({c: m[f"m_{c}"].astype(np.int64) for c in ("doc", "tag", "start", "stop")})


def radix(x: dict[str, np.ndarray], text: bytes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, window within it) of the windows of open runs that repeat an earlier window, by most-significant-digit passes.

    Windows stay in the order of their documents within a group, so its first member is the earliest."""
    size = x["more"].astype(np.int64) + 1
    begin = np.cumsum(size + depth - 1) - (size + depth - 1)
    eight = np.ndarray((len(text) + 1,), ">u8", text + bytes(8), 0, (1,))  # the eight bytes at every place, as numbers
    order = np.lexsort((x["tag"], x["start"], x["doc"], x["digit"]))
    digit = x["digit"][order]
    number = np.cumsum(np.r_[False, digit[1:] != digit[:-1]]) if len(order) else order
    # Digits are sorted some at a time, never a part of one.
    ends = np.flatnonzero(np.r_[number[1:] != number[:-1], True]) + 1 if len(order) else []
    weight = np.cumsum(size[order])
    out_run, out_at, i = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for j, after in zip(ends, [*ends[1:], None]):
        if after is not None and weight[after - 1] - (weight[i - 1] if i else 0) <= AT_ONCE:
            continue
        runs_, i = order[i:j], j
        part, at = expand(np.zeros(len(runs_), np.int64), x["more"][runs_])
        run = runs_[part]
        # First digits: the anchor, and its place in the window.
        key = np.repeat(number[j - len(runs_) : j], size[runs_]) << 8 | (x["place"][run].astype(np.int64) - at)
        o = np.argsort(key, kind="stable")
        run, at, key = run[o], at[o], key[o]
        new = np.r_[True, key[1:] != key[:-1]]
        for k in range(0, depth, 8):
            alone = new & np.r_[new[1:], True]
            run, at, new = run[~alone], at[~alone], new[~alone]
            if not len(run):
                break
            v = eight[begin[run] + at + k].astype(np.uint64) >> np.uint64(8 * max(k + 8 - depth, 0))
            group = np.cumsum(new) - 1
            mixed = v != v[new][group]
            if mixed.any():  # only groups that this digit splits need sorting
                those = np.zeros(int(group[-1]) + 1, bool)
                those[group[mixed]] = True
                where = np.flatnonzero(those[group])
                o = where[np.lexsort((v[where], group[where]))]
                run[where], at[where], v[where] = run[o], at[o], v[o]
                new = new | np.r_[True, v[1:] != v[:-1]]
        if len(run):
            doc, start = x["doc"][run], x["start"][run].astype(np.int64) + at
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (doc != doc[lead]) | (start != start[lead])
            out_run.append(run[later])
            out_at.append(at[later])
    return np.concatenate(out_run), np.concatenate(out_at)


def segments(raw: bytes, depth: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of a text's segments; every window lies in exactly one."""
    step = SEGMENT - depth + 1
    for at in range(0, max(1, len(raw) - depth + 1), step):
        yield at, raw[at : at + SEGMENT]


def _key(id_col: str, text_col: str) -> list:
    """A text's own key, of 128 bits: id and text hash. Rows equal in both have one result."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return [F.coalesce(col(id_col).cast("long"), F.lit(NULL_ID)).alias("key"), F.xxhash64(text).alias("tag")]


def _prefilter(docs: DataFrame, depth: int, gram: int, buckets: int, hold: int = 200_000) -> DataFrame:
    """Packed runs by bucket, without those that repeat another of their batch; the spans of these are in the bucket SETTLED."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        data, keys, tags, offsets = [], [], [], []

        def take():
            """Runs of the texts read so far."""
            if not data:
                return
            edges = np.r_[0, np.cumsum([len(x) for x in data])]
            r = runs(np.frombuffer(b"".join(data), np.uint8), edges, depth, gram)
            at, key, tag, doc = np.array(offsets, np.int64), np.array(keys, "<i8"), np.array(tags, "<i8"), r["doc"]
            start = (r["start"] - edges[doc] + at[doc]).astype("<u4")
            held.append({"digit": r["digit"], "body": r["body"], "doc": key[doc], "tag": tag[doc], "start": start, "more": r["more"].astype("u1"), "place": r["place"].astype("u1")})
            for x in (data, keys, tags, offsets):
                x.clear()

        def flush():
            x = {c: np.concatenate([h[c] for h in held]) for c in RUN}
            held.clear()
            on, later = settle(x)
            parts = _split(_bucket(x["digit"][on], buckets), {c: x[c][on] for c in RUN})
            m = _coalesce(x["doc"][later], x["tag"][later], x["start"][later], x["start"][later].astype(np.int64) + x["more"][later] + depth)
            if len(m["m_doc"]):
                parts[SETTLED] = {c: v.tobytes() for c, v in m.items()}
            return _batch(parts, [*RUN, *MARK])

        size = 0
        for b in batches:
            for key, tag, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw = raw.as_py()
                if len(raw) < depth:
                    continue
                for at, part in segments(raw, depth):
                    if size + len(part) > SEGMENT:
                        take()
                        size = 0
                    data.append(part)
                    keys.append(key)
                    tags.append(tag)
                    offsets.append(at)
                    size += len(part)
            if sum(len(h["doc"]) for h in held) > hold:
                yield flush()
                pa.default_memory_pool().release_unused()
        take()
        if held:
            yield flush()

    return in_batches(docs).mapInArrow(read, _ddl(RUN | MARK))


def _overloading(packed: DataFrame, staged: Staged, buckets: int, hot_rows: int) -> DataFrame | None:
    """(bucket, hot): the anchors that make a bucket hold more than twice its share, counted over all records; None without such a bucket."""
    counts = packed.groupBy("bucket").agg(F.sum(F.octet_length("digit") / 8).alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    bound = 2 * -(-(total or 0) // buckets) + hot_rows
    if (most or 0) <= bound:
        return None
    over = staged.put(counts.where(F.col("n") > bound).select("bucket"), 1)  # fewer than half of the buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, raw in zip(b.column(0).to_pylist(), b.column(1)):
                digit, n = np.unique(np.frombuffer(raw.as_py(), "<i8"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), bucket, np.int32)), pa.array(digit), pa.array(n)], names=["bucket", "digit", "n"])

    found = packed.join(small(over, over.count()), "bucket").select("bucket", "digit").mapInArrow(count, "bucket int, digit long, n long")
    found = found.groupBy("bucket", "digit").agg(F.sum("n").alias("n")).where(F.col("n") > hot_rows)
    return staged.put(found.groupBy("bucket").agg(F.collect_list("digit").alias("hot")))


def _compare(packed: DataFrame, staged: Staged, depth: int, buckets: int, hot_rows: int) -> DataFrame:
    """FOUND rows of packed runs."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unpack(pdf, RUN)
        on, later = settle(x)
        stop = x["start"].astype(np.int64) + x["more"] + depth
        d, b = x["digit"][on], x["body"][on]
        new = np.r_[True, d[1:] != d[:-1]][: len(d)]
        bodies = np.bincount(np.cumsum(new) - 1, weights=new | np.r_[True, b[1:] != b[:-1]][: len(d)]) if len(d) else np.zeros(0)
        open_ = on[bodies[np.cumsum(new) - 1] > 1]
        spans = _spans(_coalesce(x["doc"][later], x["tag"][later], x["start"][later], stop[later])).assign(kind=0, digit=0, place=0)
        rest = pd.DataFrame({"doc": x["doc"][open_], "tag": x["tag"][open_], "start": x["start"][open_].astype(np.int64), "stop": stop[open_], "kind": 1, "digit": x["digit"][open_].view("<i8"), "place": x["place"][open_].astype(np.int32)})
        return pd.concat([spans, rest])[["kind", "doc", "tag", "start", "stop", "digit", "place"]]

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = {c: np.frombuffer(b.column(c)[i].as_py(), t) for c, t in RUN.items()}
                hot = np.isin(x["digit"].view("<i8"), np.array(b.column("hot")[i].as_py(), np.int64))
                start = x["start"][hot].astype(np.int64)
                cols = [np.full(len(start), 2, np.int32), x["doc"][hot], x["tag"][hot], start, start + x["more"][hot] + depth, x["digit"][hot].view("<i8"), x["place"][hot].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "doc", "tag", "start", "stop", "digit", "place"])

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = {c: np.frombuffer(b.column(c)[i].as_py(), t) for c, t in RUN.items()}
                cold = ~np.isin(x["digit"].view("<i8"), np.array(b.column("hot")[i].as_py(), np.int64))
                yield _batch({b.column("bucket")[i].as_py(): {c: v[cold].tobytes() for c, v in x.items()}}, list(RUN))

    hot = _overloading(packed, staged, buckets, hot_rows)
    if hot is None:
        return by_group(packed, ["bucket"], group, FOUND)
    hot = small(hot, hot.agg(F.sum(F.size("hot"))).first()[0], 1 << 20)  # by how many anchors it lists
    theirs = packed.join(hot, "bucket").select("bucket", *RUN, "hot")
    others = packed.join(hot, "bucket", "left_anti").unionByName(theirs.mapInArrow(without, _ddl(RUN)))
    return by_group(others, ["bucket"], group, FOUND).unionByName(theirs.mapInArrow(single, FOUND))


def _sorted(docs: DataFrame, found: DataFrame, depth: int, buckets: int) -> DataFrame:
    """SPANS of windows that repeat an earlier window, of the runs that are still open."""
    # Sets: rows equal in id and text name the same runs.
    wanted = found.where("kind in (1, 2)").groupBy(F.col("doc").alias("key"), "tag").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "digit", "kind", "place"))).alias("runs"))
    fields = ("start", "stop", "digit", "kind", "place")
    joined = docs.join(wanted, ["key", "tag"]).select("key", "tag", "raw", *[F.col(f"runs.{c}").alias(c) for c in fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = {c: b.column(c).values.to_numpy(zero_copy_only=False).astype(np.int64) for c in fields}
            of = np.repeat(np.arange(b.num_rows), np.diff(b.column("start").offsets.to_numpy()))
            raws = [r.as_py() for r in b.column("raw")]
            text = [raws[i][s:e] for i, s, e in zip(of.tolist(), x["start"].tolist(), x["stop"].tolist())]
            x |= {"doc": b.column("key").to_numpy()[of], "tag": b.column("tag").to_numpy()[of], "more": x["stop"] - x["start"] - depth}
            parts: dict[int, dict[str, bytes]] = {}
            at = np.flatnonzero(x["kind"] == 1)
            if len(at):
                bucket = _bucket(x["digit"][at].view("<u8"), buckets)
                parts = _split(bucket, {c: (x[c].view(t) if t == "<u8" else x[c].astype(t))[at] for c, t in OPEN.items()})
                order = np.argsort(bucket, kind="stable")
                cut = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
                for i, j in zip(cut[:-1], cut[1:]):
                    parts[int(bucket[order[i]])]["text"] = b"".join(text[k] for k in at[order[i:j]])
            at = np.flatnonzero(x["kind"] == 2)
            if len(at):
                size = x["stop"][at] - x["start"][at]
                begin = np.cumsum(size) - size
                hashes = Hashes(np.frombuffer(b"".join(text[k] for k in at), np.uint8)).of(depth)
                run, place = expand(begin, x["more"][at])
                w = {"w_digit": x["digit"][at].view("<u8")[run], "w_hash": hashes[place], "w_doc": x["doc"][at][run], "w_tag": x["tag"][at][run], "w_start": (place - begin[run] + x["start"][at][run]).astype("<u4")}
                on, later = settle_single(w)
                begin = w["w_start"][later].astype(np.int64)
                m = _coalesce(w["w_doc"][later], w["w_tag"][later], begin, begin + depth)
                if len(m["m_doc"]):
                    parts[SETTLED] = {c: v.tobytes() for c, v in m.items()}
                w = {c: v[on] for c, v in w.items()}
                for k, v in _split(_bucket(w["w_hash"], buckets), w).items():
                    parts.setdefault(k, {}).update(v)
            if parts:
                yield _batch(parts, [*OPEN, "text", *SINGLE, *MARK])

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        x, w = _unpack(pdf, OPEN), _unpack(pdf, SINGLE)
        run, at = radix(x, b"".join(pdf["text"]), depth)
        _, later = settle_single(w)
        begin = np.r_[x["start"][run].astype(np.int64) + at, w["w_start"][later].astype(np.int64)]
        m = _coalesce(np.r_[x["doc"][run], w["w_doc"][later]], np.r_[x["tag"][run], w["w_tag"][later]], begin, begin + depth)
        own = _unpack(pdf, MARK)
        return _spans({c: np.r_[m[c], own[c]] for c in MARK})

    rows = in_batches(joined).mapInArrow(read, _ddl(OPEN | {"text": 0} | SINGLE | MARK))
    return by_group(rows, ["bucket"], group, SPANS)


def _settled(packed: DataFrame) -> DataFrame:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _spans(_unpack({c: b.column(c).to_pylist() for c in MARK}, MARK))
            yield pa.RecordBatch.from_pandas(m, preserve_index=False)

    return packed.where(F.col("bucket") == SETTLED).select(*MARK).mapInArrow(unpack, SPANS)


def repeats(docs: DataFrame, staged: Staged, *, id_col: str = "doc_id", text_col: str = "text", depth: int = 100, gram: int = 40, bucket_bytes: int = 24 << 20, hot_rows: int = 1 << 15) -> DataFrame:
    """(doc, tag, start, stop): spans of bytes to remove, by id (null: the least long) and text hash; they may overlap."""
    if not 0 < gram <= depth or depth - gram > 255:
        raise ValueError("gram must be from 1 to depth, and at least depth - 255")
    keyed = docs.select(*_key(id_col, text_col), F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"))
    size = docs.agg(F.sum(F.octet_length(col(text_col).cast("string")))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    packed = staged.put(_prefilter(keyed, depth, gram, buckets))
    settled = staged.put(_settled(packed))
    found = staged.put(_compare(packed.where(F.col("bucket") != SETTLED).select("bucket", *RUN), staged, depth, buckets, hot_rows))
    staged.drop(packed)
    more = staged.put(_sorted(keyed, found, depth, buckets))
    return settled.unionByName(found.where("kind = 0").select("doc", "tag", "start", "stop")).unionByName(more)


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, *, id_col: str = "doc_id", text_col: str = "text", depth: int = 100, gram: int = 40, as_text: bool = False, hot_rows: int = 1 << 15) -> DataFrame:
    """One row per input row: `row` (a struct of the `keep` columns, by default all), n_bytes, spans (maximal removed
    runs of bytes, in order) and kept (the other bytes) or, with as_text, text (without characters that lost a byte)."""
    keep = list(docs.columns if keep is None else keep)
    staged, passes = Staged(docs.sparkSession, "suffix"), Staged(docs.sparkSession, "suffix-passes")
    spans = repeats(docs, passes, id_col=id_col, text_col=text_col, depth=depth, gram=gram, hot_rows=hot_rows)
    spans = staged.put(spans.groupBy(F.col("doc").alias("key"), "tag").agg(F.collect_set(F.struct("start", "stop")).alias("found")))
    passes.clear()
    # The text travels once: within the row if it is kept there.
    inside = text_col in keep and docs.schema[text_col].dataType.simpleString() == "string"
    text = F.lit(None) if inside else col(text_col)
    rows = docs.select(*_key(id_col, text_col), F.struct(*[col(c).alias(c) for c in keep]).alias("row"), text.cast("string").alias("other"))
    joined = rows.join(spans, ["key", "tag"], "left").select("row", "other", F.col("found.start").alias("start"), F.col("found.stop").alias("stop"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, all_spans, kept = [], [], []
            texts = b.column(0).field(keep.index(text_col)) if inside else b.column(1)
            for raw, start, stop in zip(texts, *b.columns[2:]):
                raw, runs_ = (raw.as_py() or "").encode(), []
                for s, e in sorted(zip(start.as_py() or (), stop.as_py() or ())):
                    if runs_ and s <= runs_[-1]["stop"]:
                        runs_[-1]["stop"] = max(e, runs_[-1]["stop"])
                    else:
                        runs_.append({"start": s, "stop": e})
                cuts = [0, *(x for r in runs_ for x in (r["start"], r["stop"])), len(raw)]
                lengths.append(len(raw))
                all_spans.append(runs_)
                kept.append(b"".join(raw[i:j] for i, j in zip(cuts[::2], cuts[1::2])) if runs_ else raw)
            last = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int64()), pa.array(all_spans, span), last], names=["row", "n_bytes", "spans", name])

    name = "text" if as_text else "kept"
    kind = joined.schema["row"].dataType.simpleString()
    return in_batches(joined).mapInArrow(cut, f"row {kind}, n_bytes long, spans array<struct<start:bigint,stop:bigint>>, {name} {'string' if as_text else 'binary'}")
