"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector o is turned by one random rotation and kept as the signs of its coordinates (a code) together with
the factor f, the inner product of o and its code's unit vector. For any unit q, <q, code> / f is an unbiased estimate of <q, o>,
and its error stays within e * sqrt((1 - f^2) / f^2 / (d - 1)) with a probability that e sets. Only
pairs whose upper bound reaches the threshold are recomputed, in double precision from the vectors themselves.

Which pairs are estimated at all: pivots (a bounded sample, near copies taken out) cut the space. A vector has its
home at its nearest pivot and probes every home that may hold a vector at the threshold: by the triangle inequality, those whose
pivot is no farther than the home's radius and the threshold's angle together. No pair is skipped at any size. Where directions
are random no home is ruled out and the work is that of all pairs, in blocks.
What travels: a vector goes to its home once; to the homes that it probes go its code and factor alone, a few bytes a dimension's
eighth. The home says which of them the bound leaves open, and only their vectors are fetched there for the exact products.
Equal vectors are one row with a multiplicity; large homes are cut into blocks, so no task holds more than a bound.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows with a null id, link with nothing;
vectors of different lengths never link; repeated rows count as vectors of their own; an empty table gives an empty table; other columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, col, in_batches
from .components import connected_components, local_components

#: Rows of estimates that a task holds at once.
ROWS = 128
_HOME = 1 << 20
#: Vectors for which there is one pivot, and the most pivots.
PER_HOME, MOST = 4096, 16_384


def rotation(d: int, seed: int = 1) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # keeps squares from overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs and factors of rotated unit vectors."""
    return np.packbits(o > 0, axis=1), np.abs(o).sum(1) / np.sqrt(o.shape[1])


def decoded(codes: np.ndarray, factor: np.ndarray, d: int, e: float) -> tuple[np.ndarray, np.ndarray]:
    """Codes as rows to multiply rotated vectors with, and the error bound of each."""
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    signs *= (1 / (np.sqrt(d) * factor)).astype(np.float32)[:, None]
    return signs, (e * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(d - 1, 1))).astype(np.float32)


def estimates(q: np.ndarray, codes: np.ndarray, factor: np.ndarray, e: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of rotated unit vectors q with coded ones, and each code's error bound."""
    signs, bound = decoded(codes, factor, q.shape[1], e)
    return q.astype(np.float32) @ signs.T, bound


def open_pairs(x: np.ndarray, codes: np.ndarray, factor: np.ndarray, threshold: float, e: float):
    """Yields (rows of x, coded rows) of the pairs whose upper bound reaches the threshold."""
    signs, bound = decoded(codes, factor, x.shape[1], e)
    turn, least = rotation(x.shape[1]), np.float32(threshold - 1e-5) - bound
    for i in range(0, len(x), ROWS):
        a, b = np.nonzero((x[i : i + ROWS] @ turn).astype(np.float32) @ signs.T >= least)
        yield a + i, b


def close_pairs(x: np.ndarray, y: np.ndarray, codes: np.ndarray, factor: np.ndarray, threshold: float, e: float):
    """Yields (rows of x, rows of y) of pairs whose cosine in double precision reaches the threshold."""
    for a, b in open_pairs(x, codes, factor, threshold, e):
        for j in range(0, len(a), 1 << 16):
            u, v = a[j : j + (1 << 16)], b[j : j + (1 << 16)]
            ok = np.einsum("ij,ij->i", x[u], y[v]) >= threshold
            yield u[ok], v[ok]


class Pivots:
    """Unit vectors that cut the space, for each length of vectors: one for every `per_home` vectors, up to `most`. They set what is compared where,
    never what is found."""

    def __init__(self, sample: list[np.ndarray], n: int, most: int = MOST, per_home: int = PER_HOME):
        by: dict[int, list] = {}
        for s in sample:
            by.setdefault(len(s), []).append(s)
        self.of: dict[int, np.ndarray] = {}
        for d, rows in by.items():
            share = n * len(rows) / max(len(sample), 1)
            k = int(np.clip(np.ceil(share / per_home), 1, most))
            x, kept = unit(np.array(rows)), []
            for i in range(len(x)):
                if len(kept) == k:
                    break
                if not kept or (x[kept] @ x[i]).max() < 0.9:
                    kept.append(i)
            self.of[d] = x[kept]

    def angles(self, x: np.ndarray) -> np.ndarray:
        """The angle of each row and each pivot."""
        p = self.of.get(x.shape[1])
        # a length outside the sample is a home of its own
        return np.zeros((len(x), 1)) if p is None else np.arccos(np.clip(x @ p.T, -1, 1))


KEY = ("g_home", "g_member", "g_prober")


def _blocked(rows: DataFrame, role: str, at: str, sizes: DataFrame, own: int, other: int, mine: str, theirs: str) -> DataFrame:
    """Rows of a home cut into blocks, each repeated for every block of the other role."""
    r = rows.join(F.broadcast(sizes), F.col(at) == F.col("s_home"))
    i = F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.ceil(F.col(mine) / own)))
    j = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col(theirs) / other).cast("int") - 1)))
    r = r.withColumn("i", i.cast("int")).withColumn("j", j)
    blocks = ("i", "j") if role == "member" else ("j", "i")
    return r.select(F.col(at).alias("g_home"), F.col(blocks[0]).alias("g_member"), F.col(blocks[1]).alias("g_prober"), *[c for c in rows.columns if c not in (at, "probes")])


def near_duplicates(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    e: float = 4.0,
    sample_rows: int = 4 * MOST,
    members: int = 4096,
    probers: int = 32_768,
    pivots: Pivots | None = None,
) -> DataFrame:
    """(id, n_links, component_id, kept), one row per input row. Pivots come from about four times as many rows, at most `sample_rows`."""
    staged = Staged(vectors.sparkSession, "embeddings")
    # Single precision stays as it is while it travels.
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    item, number = ("float", "<f4") if single else ("double", "<f8")
    v = col(vector_col).cast(f"array<{item}>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)) & col(id_col).isNotNull()
    rows = vectors.select(col(id_col).cast("long").alias("id"), fine.alias("fine"), F.when(fine, v).alias("v"))
    # Equal vectors have equal keys of 128 bits; only one of them goes on, with how many there are.
    rows = rows.withColumn("k1", F.xxhash64("v", F.lit(1))).withColumn("k2", F.xxhash64(F.lit(2), "v"))
    classes = staged.put(rows.where("fine").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")))
    n = classes.count()
    if pivots is None:
        rate = min(1.0, min(sample_rows, 256 + 4 * n // PER_HOME) / max(n, 1))
        chosen = classes.where((F.col("k1").cast("double") + 2.0**63) / 2.0**64 < rate).orderBy("k1", "k2").select("v").toArrow()["v"].combine_chunks()
        values, cut = chosen.values.to_numpy(zero_copy_only=False), chosen.offsets.to_numpy()
        pivots = Pivots([values[i:j] for i, j in zip(cut[:-1], cut[1:])], n)

    def by_length(raw: list) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(dimensions, places, unit vectors) of packed vectors."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // int(number[2])
        at = [(int(d), np.flatnonzero(sizes == d)) for d in np.unique(sizes)]
        return [(d, i, unit(np.frombuffer(b"".join(raw[k] for k in i), number).reshape(len(i), d))) for d, i in at]

    def assign(batches):
        for b in batches:
            vs = [np.array(x, number).tobytes() for x in b.column("v").to_pylist()]
            home, away, code, factor = ([None] * len(vs) for _ in range(4))
            for d, at, x in by_length(vs):
                angle = pivots.angles(x)
                p = angle.argmin(1)
                c, f = encode(x @ rotation(d))
                for k, i in enumerate(at):
                    home[i], away[i], code[i], factor[i] = p[k] + d * _HOME, angle[k, p[k]], c[k].tobytes(), f[k]
            cols = [b.column("rep"), b.column("copies"), pa.array(home, pa.int64()), pa.array(away, pa.float64()), pa.array(vs, pa.binary()), pa.array(code, pa.binary()), pa.array(factor, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["rep", "copies", "home", "away", "vector", "code", "factor"])

    placed = staged.put(in_batches(classes).mapInArrow(assign, "rep long, copies long, home long, away double, vector binary, code binary, factor double"))
    # One row a home, and there are at most as many homes as pivots.
    at_home = staged.put(placed.groupBy(F.col("home").alias("s_home")).agg(F.count("*").alias("n_member"), F.max("away").alias("radius")), 1)
    radius = {r["s_home"]: r["radius"] for r in at_home.collect()}
    reach = float(np.arccos(min(max(threshold, -1.0), 1.0))) + 1e-6  # rounding of angles

    def probe(batches):
        for b in batches:
            out = [None] * b.num_rows
            for d, at, x in by_length(b.column("vector").to_pylist()):
                angle = pivots.angles(x)
                homes = np.arange(angle.shape[1]) + d * _HOME
                near = angle <= np.array([radius.get(h, -np.inf) for h in homes.tolist()]) + reach
                for i, row in zip(at, near):
                    out[i] = homes[row]
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("code"), b.column("factor"), pa.array(out, pa.list_(pa.int64()))], names=["rep", "code", "factor", "probes"])

    coded = staged.put(in_batches(placed).mapInArrow(probe, "rep long, code binary, factor double, probes array<long>"))
    asked = coded.select(F.explode("probes").alias("s_home")).groupBy("s_home").agg(F.count("*").alias("n_prober"))
    sizes = staged.put(at_home.join(asked, "s_home"), 1)
    member = _blocked(placed.select("rep", "home", "vector"), "member", "home", sizes, members, probers, "n_member", "n_prober")
    prober = _blocked(coded.withColumn("at", F.explode("probes")), "prober", "at", sizes, probers, members, "n_prober", "n_member")

    def involved(key, y: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        """Members and probers of the pairs that the bound leaves open, never the pairs."""
        if not len(x) or not len(y):
            return pd.DataFrame({**{c: [] for c in (*KEY, "rep")}, "member": []}).astype({**{c: "int64" for c in (*KEY, "rep")}, "member": bool})
        codes = np.frombuffer(b"".join(x["code"]), np.uint8).reshape(len(x), -1)
        yr, xr = y["rep"].to_numpy(), x["rep"].to_numpy()
        of_y, of_x = np.zeros(len(y), bool), np.zeros(len(x), bool)
        for a, b in open_pairs(by_length(y["vector"].tolist())[0][2], codes, x["factor"].to_numpy(), threshold, e):
            other = yr[a] != xr[b]
            of_y[a[other]] = of_x[b[other]] = True
        rep = np.r_[yr[of_y], xr[of_x]]
        return pd.DataFrame({**dict(zip(KEY, key)), "rep": rep, "member": np.arange(len(rep)) < of_y.sum()})

    wanted = member.groupBy(*KEY).cogroup(prober.groupBy(*KEY)).applyInPandas(involved, "g_home long, g_member int, g_prober int, rep long, member boolean")
    wanted = staged.put(wanted).join(placed.select("rep", "copies", "vector", "code", "factor"), "rep")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf[pdf["member"]], pdf[~pdf["member"]]
        none = pd.DataFrame({"u": [], "v": [], "n": []}).astype("int64")
        if not len(x) or not len(y):
            return none
        load = lambda p: by_length(p["vector"].tolist())[0][2]
        codes = np.frombuffer(b"".join(x["code"]), np.uint8).reshape(len(x), -1)
        xr, yr, yc = x["rep"].to_numpy(), y["rep"].to_numpy(), y["copies"].to_numpy()
        ids, place = np.unique(np.r_[xr, yr], return_inverse=True)
        px, py = place[: len(xr)], place[len(xr) :]
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        held_a, held_b, held = [], [], 0
        for b, a in close_pairs(load(y), load(x), codes, x["factor"].to_numpy(), threshold, e):
            other = xr[a] != yr[b]
            a, b = a[other], b[other]
            np.add.at(links, px[a], yc[b])  # the other way round the pair is seen where y probes
            apart = label[px[a]] != label[py[b]]
            held_a.append(px[a][apart])
            held_b.append(py[b][apart])
            held += int(apart.sum())
            if held > 1 << 18:
                seen = np.flatnonzero(label != np.arange(len(ids)))
                label = local_components(len(ids), np.concatenate([*held_a, seen]), np.concatenate([*held_b, label[seen]]))
                held_a, held_b, held = [], [], 0
        seen = np.flatnonzero(label != np.arange(len(ids)))
        label = local_components(len(ids), np.concatenate([*held_a, seen]), np.concatenate([*held_b, label[seen]]))
        some, child = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(ids)))
        return pd.concat([none, pd.DataFrame({"u": ids[some], "v": ids[some], "n": links[some]}), pd.DataFrame({"u": ids[child], "v": ids[label[child]], "n": 0})])

    found = staged.put(wanted.groupBy(*KEY).applyInPandas(compare, "u long, v long, n long"))
    links = found.where("n > 0").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("linked"))
    roots = connected_components(found.where("n = 0").select("u", "v"), staged).withColumnsRenamed({"node": "rep"})
    classes = classes.drop("v").join(links, "rep", "left").join(roots, "rep", "left")
    classes = classes.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    linked = rows.where("fine").select("id", "k1", "k2").join(classes, ["k1", "k2"]).select("id", "n_links", "component_id")
    alone = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
