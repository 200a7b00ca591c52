"""SimHash near-dedup by a binary-trie self-join.

Distinct fingerprints are read as paths of a binary trie. Pairs of trie nodes descend together;
differing bits add up, and a pair of nodes is dropped as soon as it exceeds its error budget.
The trie is joined once for each of `rotations` rotations of the bits. On a ring of m equal
segments that hold at most k differences together, some start exists from which, for every l,
the first l segments hold at most l*k/m of them (the ring form of the pigeonhole principle), so
each rotation may use that tight budget from its first bit on and no pair is lost. Where the
budget of the first segment is zero, that segment is the key by which nodes go to tasks.

A key of more than `block` fingerprints is routed by a deeper prefix: a fingerprint goes to its own prefix and visits those lower ones
that the budget spent so far allows, so a task stays within a bound while copies grow with the depth, that is with the logarithm of the
fingerprints. Only where very many fingerprints share even that prefix are pairs of blocks joined.
Each task returns a spanning forest of the links that it found, never all pairs of a dense group.

Documents whose shingle sets reach a Jaccard similarity are grouped the same way (`similar_groups`): the trie join of the sets'
fingerprints proposes near copies, which are compared exactly; for the pairs beyond its budget there is an exact way, keys that any two sets
of the similarity share, looked at only between sets that the trie has not linked yet.

Defined results: null text is empty; a text without words has fingerprint zero, linked like any other, and an empty set, equal only to
empty sets; very long texts are read whole, one at a time; repeated rows and ties share a fingerprint; null ids never are a component's id unless
all are null; an empty table gives an empty table; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, by_group, col, in_batches, small
from .components import connected_components, local_components

SEED = 42
#: Trie node pairs that a task expands at once, and found links that it holds before it reduces them.
PAIRS, LINKS = 1 << 15, 1 << 18


def fingerprint(text: str | None, words: int = 4) -> int:
    """Majority bits of the XXH64 of all word shingles, as a signed 64-bit number."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = xxhash.xxh64_digest(joined, SEED)
    else:
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
        ends = np.cumsum(lengths) - 1
        starts = (ends - lengths + 1).tolist()
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())])
    raw = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(raw), 8192):
        counts += np.unpackbits(raw[i : i + 8192], axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(raw)).view(">i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    return in_batches(rows).mapInArrow(run, "id long, fp long")


def budgets(k: int, rotations: int, bits: int = 64) -> np.ndarray:
    """Most differing bits allowed among the first d bits, for d = 0..bits."""
    d = np.arange(bits + 1)
    return np.minimum(-(-d * rotations // bits) * k // rotations, k)


def trie_links(values: np.ndarray, k: int, budget: np.ndarray, roots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links a-b (positions in the sorted distinct uint64 `values`), enough to connect every two values that differ in at
    most k bits and keep to the budget. `roots` numbers the trie that each value is in; values are sorted by it first."""
    n = len(values)
    roots = np.zeros(n, np.int64) if roots is None else roots
    # Places are 32-bit: a task joins fewer values than that, and most memory is node pairs that wait.
    cuts = (np.flatnonzero(np.diff(roots)) + 1).astype(np.int32)
    lo, hi = np.r_[np.int32(0), cuts], np.r_[cuts, np.int32(n)]
    # Neighbours in order that are near link at once. Nodes that lie in one such run need no look.
    near = (np.bitwise_count(values[1:] ^ values[:-1]) <= k) & (roots[1:] == roots[:-1])
    run = np.r_[0, np.cumsum(~near)].astype(np.int32)
    found_a, found_b, held = [np.flatnonzero(near)], [np.flatnonzero(near) + 1], 0

    todo = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while todo:
        d, alo, ahi, blo, bhi, err = todo.pop()
        keep = run[alo] != run[bhi - 1]
        alo, ahi, blo, bhi, err = (x[keep] for x in (alo, ahi, blo, bhi, err))
        leaf = (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            a, b = alo[leaf], blo[leaf]
            good = np.flatnonzero(np.bitwise_count(values[a] ^ values[b]) <= k)
            found_a.append(a[good])
            found_b.append(b[good])
            held += len(good)
            if held > LINKS:
                label = local_components(n, np.concatenate(found_a), np.concatenate(found_b))
                found_b = [np.flatnonzero(label != np.arange(n))]
                found_a, held = [label[found_b[0]]], 0
            alo, ahi, blo, bhi, err = (x[~leaf] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        if len(alo) > PAIRS:
            for i in range(0, len(alo), PAIRS):
                todo.append((d, *(x[i : i + PAIRS] for x in (alo, ahi, blo, bhi, err))))
            continue
        if d not in ones:
            ones[d] = np.r_[0, np.cumsum((values >> np.uint64(63 - d)) & np.uint64(1), dtype=np.int64)].astype(np.int32)
        c, same = ones[d], alo == blo
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        may = err < budget[d + 1]
        parts = [
            (alo, amid, blo, bmid, err, None),
            (amid, ahi, bmid, bhi, err, None),
            (alo, amid, bmid, bhi, err + np.int8(1), may),
            (amid, ahi, blo, bmid, err + np.int8(1), may & ~same),
        ]
        nxt = []
        for p in parts:
            ok = (p[0] < p[1]) & (p[2] < p[3])
            if p[5] is not None:
                ok &= p[5]
            nxt.append([x[ok] for x in p[:5]])
        al, ah, bl, bh, er = (np.concatenate(x) for x in zip(*nxt))
        swap = al > bl
        al, bl, ah, bh = np.where(swap, bl, al), np.where(swap, al, bl), np.where(swap, bh, ah), np.where(swap, ah, bh)
        todo.append((d + 1, al, ah, bl, bh, er))
    return np.concatenate(found_a), np.concatenate(found_b)


def _blocks(rows: DataFrame, n: str, block: int, by: str) -> DataFrame:
    """Rows cut into blocks of about `block` where the group has more (column n): one row for each pair of blocks (p) that it is in."""
    rows = rows.withColumn("blocks", F.ceil(F.col(n) / block).cast("int"))
    own = F.pmod(F.xxhash64(by), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    return rows.withColumn("p", F.explode(F.filter(pairs, lambda p: (F.col("blocks") == 1) | (p.i != p.j))))


def _at_most(own):
    return lambda x: x <= own


def near_links(distinct: DataFrame, *, k: int = 4, rotations: int = 8, block: int = 1 << 16, bits: int = 64) -> DataFrame:
    """(u, v) links between distinct fingerprints (column fp) that connect all pairs within k bits."""
    if bits % rotations or k // rotations:
        raise ValueError("rotations must divide the bits and exceed k, so that the first segment is exact")
    seg = bits // rotations
    budget = budgets(k, rotations, bits)
    turn = lambda r: F.shiftleft("fp", r * seg).bitwiseOR(F.shiftrightunsigned("fp", bits - r * seg)) if r else F.col("fp")
    turned = F.array(*[F.struct(F.lit(r).alias("r"), turn(r).alias("t")) for r in range(rotations)])
    rows = distinct.select(F.explode(turned).alias("x")).select("x.r", "x.t")
    prefix = lambda depth: F.shiftrightunsigned("t", bits - depth)
    first = (F.col("r") * F.lit(1 << seg) + prefix(seg)).alias("first")
    sizes = rows.groupBy(first).agg(F.count("*").alias("n"))  # at most rotations * 2^seg rows
    found = {x["first"]: x["n"] for x in sizes.where(F.col("n") > block).collect()}
    level = F.lit(0)
    depths = [d for d in (seg, 2 * seg, 3 * seg) if d <= min(48, bits)]
    if found and len(depths) > 1:
        n = F.coalesce(F.col("n"), F.lit(0))
        rows = rows.withColumn("first", first).join(F.broadcast(sizes.where(F.col("n") > block)), "first", "left")
        level = F.when(n <= block, 0).when((n <= block << seg) | F.lit(len(depths) < 3), 1).otherwise(2)
    visits = F.array(prefix(seg))
    for i, depth in enumerate(depths[1:], 1):
        low = depth - seg
        masks = [sum(1 << x for x in c) for m in range(1, int(budget[depth]) + 1) for c in combinations(range(low), m)]
        # Of two prefixes that differ, the higher one's fingerprint visits the lower one.
        own = prefix(depth)
        visited = F.array(own, *[own.bitwiseXOR(F.lit(m).cast("long")) for m in masks])
        visits = F.when(F.col("level") == i, F.filter(visited, _at_most(own))).otherwise(visits)
    rows = rows.withColumn("level", level).select("t", "r", "level", F.explode(visits).alias("at"))
    rows = rows.select("t", (F.shiftleft((F.col("r") * 4 + F.col("level")).cast("long"), 48) + F.col("at")).alias("key"))
    total = rotations * distinct.count()
    if found:
        crowded = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 4 * block)
        rows = _blocks(rows.join(crowded, "key", "left").withColumn("n", F.coalesce("n", F.lit(1))), "n", block, "t")
        group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // block))))).otherwise(F.xxhash64("key", "p.i", "p.j"))
        rows = rows.select((F.col("blocks") > 1).alias("blocked"), group.alias("g"), "key", "t")
    else:  # small keys share a task: about `block` rows each
        rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // block)))).alias("g"), "key", "t")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        t, key = pdf["t"].to_numpy(np.int64).view(np.uint64), pdf["key"].to_numpy(np.int64)
        order = np.lexsort((t, key))
        t, key = t[order], key[order]
        a, b = trie_links(t, k, budget, key)
        label = local_components(len(t), a, b)
        child = np.flatnonzero(label != np.arange(len(t)))
        back = (key >> 50).astype(np.uint64) * np.uint64(seg)
        fp = np.where(back > 0, (t >> back) | (t << ((np.uint64(bits) - back) % np.uint64(bits))), t).view(np.int64)
        return pd.DataFrame({"u": fp[child], "v": fp[label[child]]})

    return by_group(rows, [c for c in rows.columns if c not in ("key", "t")], join, "u long, v long")


def _least_of(nodes: DataFrame, roots: DataFrame, name: str, least: str, staged: Staged) -> DataFrame:
    """(name, found): for the nodes that are linked with others, the least value of the column `least` in their component."""
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", name)
    linked = staged.put(nodes.select(name, least).join(linked, name))
    best = staged.put(linked.groupBy("root").agg(F.min(least).alias("found")))
    return linked.join(small(best, best.count()), "root").select(name, "found")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, k: int = 4, rotations: int = 8, block: int = 1 << 16) -> DataFrame:
    """(id, fp, component_id): the smallest id reachable over fingerprints that differ in at most k bits."""
    staged = Staged(docs.sparkSession, "simhash")
    own = staged.put(fingerprints(docs, id_col=id_col, text_col=text_col, words=words))
    distinct = staged.put(own.groupBy("fp").agg(F.min("id").alias("least")))
    links = near_links(distinct, k=k, rotations=rotations, block=block)
    found = _least_of(distinct, connected_components(links, staged), "fp", "least", staged)
    classes = distinct.join(found, "fp", "left").select("fp", F.coalesce("found", "least").alias("component_id"))
    return own.join(classes, "fp").select("id", "fp", "component_id")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of a text's word shingles, sorted (A-Z lower-cased; fewer words: the whole sequence; none: none)."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.r_[0, ends[: len(tokens) - words] + 1].tolist()
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]), ">u8").astype(np.uint64))


@lru_cache(1 << 16)
def size_classes(n: int, similarity: float) -> list[tuple[int, int]]:
    """The class of sets of n elements and the next one, each with the most elements in which two of its sets, or one and one
    of the class below, differ. Sets of the similarity are in one class or in neighbouring ones."""
    number, least = 0, 1
    while (after := int(least / similarity + 1e-9) + 1) <= n:
        number, least = number + 1, after
    out = []
    for c in (number, number + 1):
        most = int(least / similarity + 1e-9)
        out.append((c, int((1 - similarity) / (1 + similarity) * 2 * most + 1e-9)))
        least = most + 1
    return out


def _salted(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _parts(hashes: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For sets that differ in at most d elements: where the filled parts of the hashes' range start, which of them are keys, and how many keys
    every set of the similarity shares at least (0 or less: perhaps none).

    At least as many filled parts as go beyond d are equal. Of these no more are of one element than the set has; so where enough
    larger parts are left, those of one element, which unlike texts share as well, are no keys."""
    part = (hashes >> np.uint64(32)) * np.uint64(d + 3 * d // 5 + 2) >> np.uint64(32)
    at = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1]
    large = np.diff(np.r_[at, len(hashes)]) > 1
    sure = int(large.sum()) - d
    return (at, large, sure) if sure > 0 else (at, np.ones(len(at), bool), len(at) - d)


def keys(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """Keys of a set (sorted distinct hashes) of which any two sets of the similarity share one.

    Sets that differ in at most d elements and fill more than d parts of the hashes' range have an equal part that isn't empty, and the sum
    of a filled part is a key. A set that fills d parts or fewer also has its least hashes as keys (prefix filter)."""
    n = len(hashes)
    if not n:
        return hashes
    out, short = [], False
    for c, d in size_classes(n, similarity):
        at, use, sure = _parts(hashes, d)
        out.append(_salted(np.add.reduceat(hashes, at)[use], c + 1))
        short |= sure <= 0
    if short:
        out.append(_salted(hashes[: n - int(np.ceil(similarity * n - 1e-9)) + 1], 0))
    return np.unique(np.concatenate(out))


def slack(hashes: np.ndarray, similarity: float) -> int:
    """How many of a set's keys every other set of the similarity shares at least (in whichever of its size classes they meet)."""
    return max(1, min((_parts(hashes, d)[2] for _, d in size_classes(len(hashes), similarity)), default=1)) if len(hashes) else 1


def parity(hashes: np.ndarray) -> bytes:
    """Whether each place has an odd number of hashes; two sets differ in at least as many elements as in places."""
    bits = max(1024, 1 << (2 * len(hashes)).bit_length())
    odd = np.bincount(((hashes >> np.uint64(8)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_links(size: np.ndarray, places: list[bytes], similarity: float) -> tuple[list, list]:
    """Links, enough to connect every two sets that may have the similarity by their sizes and parities."""
    width = min(map(len, places))
    bits = np.array([np.bitwise_xor.reduce(np.frombuffer(p, np.uint64).reshape(-1, width // 8)) for p in places])
    share, rest = (1 - similarity) / (1 + similarity), np.arange(len(size))
    found_a, found_b = [], []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            n = size[rest]
            ok = np.bitwise_count(bits[rest] ^ bits[x]).sum(1, dtype=np.int64) <= share * (n + size[x]) + 1e-6
            ok &= np.minimum(n, size[x]) >= similarity * np.maximum(n, size[x]) - 1e-6
            hit, rest = rest[ok], rest[~ok]
            found_a += [x] * len(hit)
            found_b += hit.tolist()
            todo += hit.tolist()
    return found_a, found_b


def majority(hashes: np.ndarray) -> int:
    """Fingerprint of a set of hashes: the bits set in over half of them, as a signed 64-bit number."""
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(raw), 8192):
        counts += np.unpackbits(raw[i : i + 8192], axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(raw)).view(">i8")[0])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, set_hash) in order, those whose key another set has too; repeated rows once."""
    key, name, kept = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for b in batches:
        key, name = np.r_[key, b.column(0).to_numpy()], np.r_[name, b.column(1).to_numpy()]
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (name[1:] != name[:-1])][: len(key)])
        key, name = key[new], name[new]
        if len(key):
            same = key[1:] == key[:-1]
            keep = np.r_[kept, same] | np.r_[same, False]
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][keep[:-1]]), pa.array(name[:-1][keep[:-1]])], names=["key", "set_hash"])
            key, name, kept = key[-1:], name[-1:], keep[-1]
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(name)], names=["key", "set_hash"])


def may_pairs(size: np.ndarray, places: list[bytes], similarity: float, root: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each set with the later ones of other roots that may have the similarity with it, by their sizes and parities."""
    width = min(map(len, places))
    bits = np.array([np.bitwise_xor.reduce(np.frombuffer(p, np.uint64).reshape(-1, width // 8)) for p in places])
    share = (1 - similarity) / (1 + similarity)
    for i in range(len(size) - 1):
        rest = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        n = size[rest]
        rest = rest[np.minimum(n, size[i]) >= similarity * np.maximum(n, size[i]) - 1e-6]
        rest = rest[np.bitwise_count(bits[rest] ^ bits[i]).sum(1, dtype=np.int64) <= share * (size[rest] + size[i]) + 1e-6]
        if len(rest):
            yield i, rest


def shared_keys(keyed: DataFrame, sets: DataFrame, staged: Staged, common: int) -> DataFrame:
    """(key, set_hash) of the keys that sets of different roots share; `sets` has set_hash, root (equal ones are linked already), n and slack.

    A key of over `common` sets (a shingle that very many texts hold) is left out for those of its sets that have fewer such keys than
    their slack: their partners share a rarer key with them as well."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    both = staged.put(keyed.repartition(max(24, total >> 20), "key").sortWithinPartitions("key", "set_hash").mapInArrow(_shared, "key long, set_hash long"))
    rows = staged.put(_open_keys(both.join(sets.select("set_hash", "root", "slack"), "set_hash")))
    staged.drop(both)
    often = rows.where(F.col("m") > common).groupBy("set_hash").agg(F.count("*").alias("h"))
    out = staged.put(rows.join(often, "set_hash", "left").where((F.col("m") <= common) | (F.col("h") >= F.col("slack"))).select("key", "set_hash"))
    staged.drop(rows)
    return out


def _open_keys(rows: DataFrame) -> DataFrame:
    """The rows (key, set_hash, root) of keys whose sets have different roots, with the number of sets (m) and a hash of who they are."""
    many = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.bit_xor(F.xxhash64("set_hash")).alias("who"))
    return rows.join(many.where("r0 <> r1").select("key", "m", "who"), "key")


def key_groups(shared: DataFrame, sets: DataFrame, staged: Staged, similarity: float, block: int) -> DataFrame:
    """(g, h, set_hash, link): of sets that share a key and may have the similarity by their sizes and parities, links between sets of different
    roots, enough to connect all (link: g is the other set), and for each pair of roots (g, h) between which a pair may have it, the sets of such pairs."""
    rows = staged.put(_open_keys(shared.join(sets.select("set_hash", "root"), "set_hash")))
    # Keys of the same sets say the same; one of them is looked at.
    rows = rows.join(rows.groupBy("m", "who").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")
    bins = max(1, -(-rows.count() // block))
    rows = _blocks(rows, "m", block, "set_hash")
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(bins))).otherwise(F.xxhash64("key", "p.i", "p.j"))
    rows = rows.select((F.col("blocks") > 1).alias("blocked"), group.alias("g"), "key", "set_hash", "root").join(sets.select("set_hash", "n", "places"), "set_hash")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "set_hash"])
        key, name, root, size, places = pdf["key"].to_numpy(), pdf["set_hash"].to_numpy(), pdf["root"].to_numpy(), pdf["n"].to_numpy(), pdf["places"].tolist()
        out, i = [np.zeros((0, 4), np.int64)], 0
        for j in [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]:
            a, b = (np.array(x, np.int64) for x in may_links(size[i:j], places[i:j], similarity))
            apart = root[a + i] != root[b + i]
            if apart.any():
                out.append(np.stack([name[a[apart] + i], np.zeros(apart.sum(), np.int64), name[b[apart] + i], np.ones(apart.sum(), np.int64)], 1))
                label = local_components(j - i, a, b)
                for x in np.unique(label[b[apart]]):
                    at = np.flatnonzero(label == x) + i
                    for k, also in may_pairs(size[at], [places[y] for y in at], similarity, root[at]):
                        lo, hi = np.minimum(root[at[k]], root[at[also]]), np.maximum(root[at[k]], root[at[also]])
                        for who in (np.full(len(also), name[at[k]]), name[at[also]]):
                            out.append(np.unique(np.stack([lo, hi, who, np.zeros(len(also), np.int64)], 1), axis=0))
            i = j
        found = pd.DataFrame(np.concatenate(out), columns=["g", "h", "set_hash", "link"]).drop_duplicates()
        return found.assign(link=found["link"] > 0)

    return staged.put(by_group(rows, ["blocked", "g"], join, "g long, h long, set_hash long, link boolean").distinct())


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, k: int = 10, rotations: int = 16, block: int = 1 << 12, common: int = 1000, together: int = 1 << 20, staged: Staged | None = None) -> DataFrame:
    """(id, text_hash, component_id, component_hash: the least id and text hash of the component): documents are linked when the Jaccard similarity of their word-shingle sets reaches `similarity`.

    First the trie join links fingerprints of the sets within k bits, and what it links is compared exactly. Then, between sets that are not linked
    so: sets of the similarity share a key, whatever they are, and pass the bounds by size and parity; these are compared exactly too.
    No pair is missed, up to collisions of hashes of 64 bits. A task compares sets of about `together` shingles. Intermediate tables go to
    `staged`, which may be cleared once the result is written."""
    staged = staged or Staged(docs.sparkSession, "similar")
    key = F.coalesce(col(id_col).cast("long"), F.lit(-(1 << 63)))
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(key.alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    set_name = lambda hashes: xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for t in b.column(2):
                hashes = shingle_hashes(t.as_py(), words)
                got.append((set_name(hashes), len(hashes), parity(hashes), slack(hashes, similarity), majority(hashes)))
            cols = [pa.array([x[i] for x in got], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["id", "text_hash", "set_hash", "n", "places", "slack", "fp"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies that a task meets again say the same
        for b in batches:
            found, names = [np.zeros(0, np.uint64)], []
            for t in b.column(0):
                hashes = shingle_hashes(t.as_py(), words)
                name = set_name(hashes)
                if name not in seen:
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen.add(name)
                    found.append(keys(hashes, similarity))
                    names.append(name)
            names = np.repeat(np.array(names, np.int64), [len(x) for x in found[1:]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(names)], names=["key", "set_hash"])

    own = staged.put(in_batches(rows).mapInArrow(run, "id long, text_hash long, set_hash long, n long, places binary, slack long, fp long"))
    # Equal sets are one class.
    firsts = [F.first(c).alias(c) for c in ("n", "places", "slack", "fp")]
    classes = staged.put(own.groupBy("set_hash").agg(F.min(F.struct("id", "text_hash")).alias("rep"), *firsts))

    texts = rows.select(F.struct("id", "text_hash").alias("rep"), "text")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("set_hash").sort_values("set_hash")
        name, root = pdf["set_hash"].to_numpy(), pdf["root"].tolist()
        sets = [shingle_hashes(t, words) for t in pdf["text"]]
        clusters: list[list[int]] = []
        out = []
        for i, s in enumerate(sets):
            hit = []
            for c in clusters:
                for j in c:
                    lo, hi = sorted((len(s), len(sets[j])))
                    if root[i] != root[j]:
                        if lo < similarity * hi:
                            continue
                        both = len(np.intersect1d(s, sets[j], assume_unique=True))
                        if both < similarity * (lo + hi - both):
                            continue
                    hit.append(c)
                    out.append((name[i], name[j]))
                    break
            rest = [c for c in clusters if not any(c is h for h in hit)]
            clusters = [*rest, [x for h in hit for x in h] + [i]]
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    def exact(groups: DataFrame, sets: DataFrame) -> DataFrame:
        """(u, v) links of the similarity between the sets of each group (g, set_hash)."""
        there = staged.put(groups.join(sets.select("set_hash", "root", "rep"), "set_hash"))
        # Rows equal in id and text are one text; all three steps deal by rep, so texts are shuffled once.
        once = texts.join(there.select("rep"), "rep", "left_semi").groupBy("rep").agg(F.first("text").alias("text"))
        return staged.put(by_group(once.join(there, "rep").select("g", "set_hash", "root", "text"), ["g"], verify, "u long, v long"))

    def around(spokes: DataFrame) -> DataFrame:
        """Links (hub, set_hash) as groups of a hub and some of those linked to it, about `together` shingles in all."""
        spokes = staged.put(spokes.join(classes.select("set_hash", "n"), "set_hash"))
        salts = spokes.groupBy("hub").agg(F.ceil(F.sum("n") / together).cast("int").alias("salts"))
        spokes = spokes.join(salts, "hub").select(F.xxhash64("hub", F.pmod(F.xxhash64("set_hash"), F.col("salts"))).alias("g"), "hub", "set_hash")
        return spokes.select("g", F.col("hub").alias("set_hash")).distinct().unionByName(spokes.select("g", "set_hash"))

    def rooted(links: DataFrame) -> DataFrame:
        roots = connected_components(links, staged).withColumnRenamed("node", "set_hash")
        return staged.put(classes.drop("fp").join(roots, "set_hash", "left").withColumn("root", F.coalesce("root", "set_hash")))

    # The trie's links; sets of one fingerprint are linked to its least.
    hubs = staged.put(classes.where("n > 0").groupBy("fp").agg(F.min("set_hash").alias("hub")))
    near = near_links(hubs.select("fp"), k=k, rotations=rotations)
    near = near.join(hubs.select(F.col("fp").alias("u"), F.col("hub").alias("set_hash")), "u").join(hubs.select(F.col("fp").alias("v"), "hub"), "v")
    same = classes.where("n > 0").select("fp", "set_hash").join(hubs, "fp").where("set_hash <> hub")
    links = exact(around(same.select("hub", "set_hash").unionByName(near.select("hub", "set_hash"))), classes.withColumn("root", F.col("set_hash")))
    # The keys' links: most by a forest of what may be similar, then what it left open, in whole groups.
    sets = rooted(links)
    keyed = in_batches(rows.select("text")).mapInArrow(spread, "key long, set_hash long")
    shared = shared_keys(keyed, sets, staged, common)
    groups = key_groups(shared, sets, staged, similarity, block)
    links = links.unionByName(exact(around(groups.where("link").select(F.col("g").alias("hub"), "set_hash")), sets))
    sets = rooted(links)
    now = sets.select("set_hash", "root")
    groups = groups.where("not link").select("g", "h", "set_hash")
    open_ = groups.select("g", "h").distinct().join(now.toDF("g", "g_root"), "g").join(now.toDF("h", "h_root"), "h").where("g_root <> h_root").select("g", "h")
    groups = groups.join(open_, ["g", "h"]).select(F.xxhash64("g", "h").alias("g"), "set_hash")
    links = links.unionByName(exact(groups, sets))
    found = _least_of(classes, connected_components(links, staged), "set_hash", "rep", staged)
    member = classes.select("set_hash", "rep").join(found, "set_hash", "left").select("set_hash", F.coalesce("found", "rep").alias("least"))
    return own.join(member, "set_hash").select("id", "text_hash", F.col("least.id").alias("component_id"), F.col("least.text_hash").alias("component_hash"))


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
