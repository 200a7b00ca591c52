"""Each operator on a table with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from gridspark.llm import chat, embeddings, langid, mixing, packing, quality, queries, rules, simhash, suffix, tokens
from gridspark.llm.components import connected_components, local_components
from gridspark.llm.common import Staged
from gridspark.llm.pieces import vocabulary, words_of

rng = random.Random(3)
VOCAB = ["th", "and", "of", "ion", "the", "über", "été", "a", "zu", "$$$", "X!", "42"]


def words(n):
    return " ".join(rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(n))


LONG = words(30_000)
BASE = words(80)
TEXTS = [None, "", " ", "one", BASE, BASE, BASE + " tail", words(60), words(60) + "\n\nx", LONG, "日本語 テスト", "a  b\tc ", words(25), "x" * 5000]
DDL = "doc_id long, text string, lang string, source string, size long, row string, key long, v string"
ROWS = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None][i % 3], 7, "r", 9, "v") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[4], (None, "no id here", None, "s1", 0, None, None, None), (4, "same id, other text", "en", "s1", 0, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def size_of(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


# 1


def brute_links(x, t=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return u @ u.T >= t


def test_embeddings_exact_on_small_tables(spark):
    g = np.random.default_rng(0)
    x = g.normal(size=(300, 16)).astype(np.float32)
    x[50:90] = x[5] + 0.1 * g.normal(size=(40, 16))
    x[100:110] = x[7]
    rows = [(i, [float(v) for v in r], "c", 1) for i, r in enumerate(x)]
    bad = [(900, None, "c", 1), (901, [0.0] * 16, "c", 1), (902, [float("nan")] * 16, "c", 1), (903, [1.0, None], "c", 1), (904, [1.0, 2.0], "c", 1), (None, [1.0] * 16, "c", 1), (905, [], "c", 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, copies string, home long")
    got = {r["id"]: r for r in embeddings.near_duplicates(df).collect()}
    near = brute_links(x.astype(np.float64))
    label = local_components(300, *np.nonzero(near))
    for i in range(300):
        assert got[i]["n_links"] == near[i].sum() - 1 and got[i]["component_id"] == label[i] and got[i]["kept"] == (label[i] == i)
    for i in (900, 901, 902, 903, 904, 905, None):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_recall_with_many_homes(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(4000, 64))
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    z = g.normal(size=y.shape)
    z -= (z * y).sum(1, keepdims=True) * y
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    pairs = 0.905 * y + np.sqrt(1 - 0.905**2) * z
    every = np.concatenate([y, pairs]).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(every)], "vec_id long, embedding array<float>")
    pivots = embeddings.Pivots([r for r in every[:2000]], 8000, per_home=100)
    assert len(pivots.of[64]) > 30
    got = embeddings.near_duplicates(df, pivots=pivots, members=500, probers=3000).toPandas().set_index("id").sort_index()
    want = brute_links(every.astype(np.float64)).sum(1) - 1
    assert (got["n_links"].to_numpy() <= want).all() and got["n_links"].sum() >= 0.995 * want.sum()


def test_embeddings_miss_no_pair_with_many_homes(spark):
    g = np.random.default_rng(4)
    x = embeddings.unit(g.normal(size=(3000, 64)))
    z = g.normal(size=x.shape)
    z = embeddings.unit(z - (z * x).sum(1, keepdims=True) * x)
    near = embeddings.unit(x[:1] + 0.05 * g.normal(size=(1000, 64)))  # a narrow home, for most others out of reach
    every = np.concatenate([x, 0.9005 * x + np.sqrt(1 - 0.9005**2) * z, near])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(every)], "vec_id long, embedding array<double>")
    pivots = embeddings.Pivots([r for r in every], len(every), per_home=20)
    assert len(pivots.of[64]) > 30
    got = embeddings.near_duplicates(df, pivots=pivots, members=500, probers=3000).toPandas().set_index("id").sort_index()
    near = brute_links(every)
    assert (got["n_links"].to_numpy() == near.sum(1) - 1).all()
    assert (got["component_id"].to_numpy() == local_components(len(every), *np.nonzero(near))).all()


def test_embeddings_of_clusters_and_of_one_cone_on_the_default_path(spark):
    g = np.random.default_rng(9)
    centres = g.normal(size=(40, 64))
    x = np.concatenate([centres[g.integers(0, 40, 3000)] + 0.35 * g.normal(size=(3000, 64)), 3 * centres[0] + g.normal(size=(5000, 64)), g.normal(size=(5000, 64))]).astype(np.float32)
    every = x.astype(np.float64)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    got = embeddings.near_duplicates(df).toPandas().set_index("id").sort_index()
    near = brute_links(every)
    assert near.sum() > 200_000
    assert (got["n_links"].to_numpy() == near.sum(1) - 1).all()
    assert (got["component_id"].to_numpy() == local_components(len(every), *np.nonzero(near))).all()


def test_rabitq_estimate_is_unbiased_and_bounded():
    g = np.random.default_rng(2)
    o, q = embeddings.unit(g.normal(size=(2000, 64))), embeddings.unit(g.normal(size=(1, 64)))
    turn = embeddings.rotation(64)
    codes, factor = embeddings.encode(o @ turn)
    est, bound = embeddings.estimates(q @ turn, codes, factor, 4.0)
    err = est[0] - (o @ q[0])
    assert abs(err.mean()) < 0.01 and (np.abs(err) <= bound).all()


# 2


def test_token_counts_match_the_unigram_library(spark, docs):
    import sentencepiece
    from tokenizers import Tokenizer, models

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    u = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], unk_id=0, byte_fallback=True))
    want = lambda t: len(u.encode("▁" + t.replace(" ", "▁")).ids) if t else 0
    for r in tokens.count_tokens(docs.where("length(text) < 20000 or text is null"), queries.PIECES).join(docs.select("doc_id", "text").distinct(), F.col("id") == F.col("doc_id")).collect():
        if r["doc_id"] not in (4,):
            assert r["n_tokens"] == want(r["text"])
    count = tokens.Counts(vocabulary(queries.PIECES))
    for _ in range(500):
        t = "".join(rng.choice("ab teh  ing▁\né😀日 ,") for _ in range(rng.randint(0, 40)))
        assert sum(map(count.__getitem__, words_of(t))) == want(t)


# 3


def test_packing(spark, docs, empty):
    pieces = packing.tokenize(docs, queries.BPE)
    packed = packing.pack(pieces).toPandas().sort_values(["sequence_id", "offset"])
    assert len(packed) == pieces.count()
    by = packed.groupby("sequence_id")["length"]
    assert by.sum().max() <= 1024 and (packed["offset"] == by.cumsum() - packed["length"]).all()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.BPE)
    for i, t in enumerate(TEXTS):
        if i in (4,):
            continue
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = packed[packed.doc_id == i].sort_values("piece")
        assert mine.length.sum() == len(ids) and b"".join(mine.ids) == ids.tobytes() and (mine.length[1:] == 1024).all()
    assert packing.pack(packing.tokenize(empty, queries.BPE)).count() == 0


def test_tokenizer_special_strings():
    t = packing.tokenizer(queries.BPE)
    assert t.fast is not None
    for s in ("<|endoftext|> x", "\x1c a", " 's  \n\n x y", "ñ" * 300):
        assert t.ids(s).tolist() == t.slow.encode(s, add_special_tokens=False).ids


def test_plans_are_near_the_bound():
    g = np.random.default_rng(0)
    for n in (50, 3000):
        lengths = np.minimum(1024, g.lognormal(6, 1.2, n).astype(int) + 1)
        counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
        plan = packing.Plan(counts, 1024)
        used = {}
        for pattern, m in plan.patterns:
            assert 0 < sum(pattern) <= 1024 and m > 0
            for x in pattern:
                used[x] = used.get(x, 0) + m
        assert used == counts
        assert plan.sequences <= -(-lengths.sum() // 1024) * 1.005 + 1
    assert packing.Plan({}, 1024).sequences == 0


def test_gaps_are_filled_by_one_two_and_three_pieces():
    size = 1024
    single = packing.Plan({600: 5, 424: 5}, size)
    assert single.patterns == [((600, 424), 5)]
    pair = packing.Plan({384: 3, 320: 6}, size)
    assert pair.patterns == [((384, 320, 320), 3)]
    triple = packing.Plan({800: 4, 100: 4, 90: 4, 34: 4}, size)
    assert triple.sequences == 4 and {tuple(sorted(p)) for p, _ in triple.patterns} == {(34, 90, 100, 800)}
    index = packing.Sums(np.array([0, 0, 2, 1, 0, 1, 1]), 1, 6)
    assert list(index.fills(6, 3)) == [(6,), (3, 3), (2, 2, 2)] and list(index.fills(0, 3)) == [()]
    assert index.take((3, 3), 9) == 0 and index.take((2,), 9) == 2 and not index.left[2]


def test_small_plans_are_the_best():
    def best(items, size):
        out = len(items)

        def go(i, gaps):
            nonlocal out
            if len(gaps) >= out:
                return
            if i == len(items):
                out = len(gaps)
                return
            for gap in {x for x in gaps if x >= items[i]}:
                rest = list(gaps)
                rest[rest.index(gap)] -= items[i]
                go(i + 1, rest)
            go(i + 1, [*gaps, size - items[i]])

        go(0, [])
        return out

    r, more = random.Random(1), 0
    for _ in range(200):
        items = sorted((r.randint(1, 64) for _ in range(r.randint(1, 10))), reverse=True)
        counts = {x: items.count(x) for x in items}
        extra = packing.Plan(counts, 64).sequences - best(items, 64)
        assert extra <= 1
        more += extra
    assert more <= 2


def test_equal_rows_are_dealt_to_many_buckets(spark):
    same = spark.createDataFrame([(1, 100)] * 3000, "doc_id long, length long")
    packed = packing.pack(same, rows_per_bucket=50).toPandas()
    assert len(packed) == 3000 and packed.groupby("sequence_id").length.sum().max() <= 1024
    assert not packed.duplicated(["sequence_id", "offset"]).any() and packed.sequence_id.nunique() == 300


# 4


def brute_repeats(rows, depth=100):
    """(id, text) to removed flags; rows of one id are one document for the order."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - depth + 1):
            w, at = b[s : s + depth], (-1 if i is None else i, s)
            first[w] = min(first.get(w, at), at)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - depth + 1):
            if first[b[s : s + depth]] < (-1 if i is None else i, s):
                gone[s : s + depth] = True
        out.append((i, b, gone))
    return out


@pytest.mark.parametrize("segment,hot,at_once", [(1 << 21, 1 << 15, 1 << 20), (4096, 0, 100), (1 << 21, 0, 1 << 20)])
def test_suffix_dedup(spark, segment, hot, at_once, monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", segment)
    monkeypatch.setattr(suffix, "AT_ONCE", at_once)
    shared = words(40)
    rows = [(r[0], r[1]) for r in ROWS] + [(100 + k, words(5) + shared + words(5)) for k in range(6)] + [(200, shared * 3), (201, "é" * 300), (202, "a" * 99), (203, "a" * 10_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, start long").repartition(5)
    got = {}
    for r in suffix.remove_repeats(df, ["doc_id", "kept"], hot_rows=hot).collect():
        got.setdefault((r["row"]["doc_id"], r["n_bytes"]), []).append(r)
    for i, b, gone in brute_repeats(rows):
        r = got[i, len(b)][0]
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes() if len(b) else b""
        assert bytes(r["kept"]) == kept, i
        assert len(r["spans"]) == int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_one_line_in_every_document(spark, monkeypatch):
    line, found, own = "the one line that every single document of this table holds, in ever other words around it, here", [], suffix._overloading

    def spy(*args):
        hot = own(*args)
        found.append(0 if hot is None else hot.count())
        return hot

    monkeypatch.setattr(suffix, "_overloading", spy)
    rows = [(i, f"{hashlib.md5(b'%d' % (i % 380)).hexdigest()[:8]} {line} {hashlib.sha256(b'%d' % (i % 390)).hexdigest()[:8]}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["row"]["doc_id"]: [(s["start"], s["stop"]) for s in r["spans"]] for r in suffix.remove_repeats(df, ["doc_id"], hot_rows=20).collect()}
    assert found[0] > 0
    for i, b, gone in brute_repeats(rows):
        edge = np.diff(np.r_[0, gone.astype(int), 0])
        assert got[i] == list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def test_texts_that_share_an_id(spark, monkeypatch):
    """Null ids and shared ids, with text hashes forced to be equal in their low bits, as any 16-bit tag of them would be."""
    a, b, c = (hashlib.sha256(x).hexdigest() * 2 + hashlib.sha256(x + b"2").hexdigest() for x in (b"a", b"b", b"c"))
    rows = [(None, a), (None, b + "tail"), (None, a[:110] + c), (None, ""), (7, b), (7, c), (7, "0" + a), (8, b), (8, b), (8, b), (9, c + a)]
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(4)
    got = sorted((-1 if r["row"]["doc_id"] is None else r["row"]["doc_id"], r["row"]["text"], bytes(r["kept"])) for r in suffix.remove_repeats(df).collect())
    want = sorted((-1 if i is None else i, b.decode(), np.frombuffer(b, np.uint8)[~gone].tobytes()) for i, b, gone in brute_repeats(rows))
    assert got == want
    many = spark.createDataFrame([(None, hashlib.sha512(b"%d" % i).hexdigest() * 2) for i in range(700)], "doc_id long, text string")
    assert suffix.remove_repeats(many).where("size(spans) > 0").count() == 700


def test_radix_passes_find_exactly_the_repeated_windows():
    g = np.random.default_rng(4)
    for depth in (3, 8, 20):
        texts = [bytes(g.integers(97, 99, int(g.integers(depth, depth + 9))).astype(np.uint8)) for _ in range(60)]
        x = {"digit": np.zeros(60, "<u8"), "doc": np.arange(60) % 50, "tag": np.arange(60), "start": np.zeros(60, "<u4"), "more": np.array([len(t) - depth for t in texts], "u1"), "place": np.full(60, 200, "u1")}
        x["place"] = x["more"]  # any place: windows of other places differ by their first digit
        got = set(zip(*map(np.ndarray.tolist, suffix.radix(x, b"".join(texts), depth))))
        first, want = {}, set()
        for i in sorted(range(60), key=lambda i: (i % 50, i)):
            for k in range(len(texts[i]) - depth + 1):
                w = (int(x["place"][i]) - k, texts[i][k : k + depth])
                at = first.setdefault(w, (i % 50, k))
                if at != (i % 50, k):
                    want.add((i, k))
        assert got == want


# 5


def test_fingerprints():
    def plain(t, n=4):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        import xxhash

        s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    for t in TEXTS:
        assert simhash.fingerprint(t) & (1 << 64) - 1 == plain(t)


@pytest.mark.parametrize("k,rotations,block", [(4, 8, 1 << 16), (4, 8, 1), (3, 4, 1 << 16), (10, 16, 1 << 16), (10, 16, 2), (7, 8, 2)])
def test_trie_join_loses_no_link(spark, k, rotations, block):
    g = np.random.default_rng(k)
    base = g.integers(0, 1 << 63, 150, dtype=np.uint64) * np.uint64(2)
    near = base[g.integers(0, 150, 400)]
    for _ in range(6):
        near = near ^ (np.uint64(1) << g.integers(0, 64, 400).astype(np.uint64))
    v = np.unique(np.r_[base, near, near[:100] ^ np.uint64(1), np.uint64(0)])
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    links = simhash.near_links(df, k=k, rotations=rotations, block=block)
    roots = {r["node"]: r["root"] for r in connected_components(links, Staged(spark, "test")).collect()}
    want = local_components(len(v), *np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= k))
    groups = {}
    for x, w in zip(v.view(np.int64).tolist(), want.tolist()):
        groups.setdefault(roots.get(x, x), set()).add(w)
    assert all(len(s) == 1 for s in groups.values()) and len(groups) == len(set(want.tolist()))


def test_simhash_table(spark, docs, empty):
    got = simhash.near_duplicates(docs).toPandas()
    assert len(got) == len(ROWS)
    by = {(None if np.isnan(r.id) else int(r.id)): r for r in got.itertuples() if r.id != 4}
    assert by[5].component_id == 4 and {by[0].component_id, by[1].component_id, by[2].component_id} == {0}
    assert simhash.near_duplicates(empty).count() == 0


def test_similar_groups_match_brute_force(spark):
    base = [words(60).split() for _ in range(12)]
    texts = []
    for b in base:
        for edits in (0, 0, 1, 2, 3, 6, 12):
            t = list(b)
            for _ in range(edits):
                t[rng.randrange(len(t))] = "new" + str(rng.random())
            texts.append(" ".join(t))
    texts += [None, "", "  ", "short one", "short one"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, component_id string")
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    n = len(sets)
    near = np.array([[a == b or (len(a & b) >= 0.8 * len(a | b) and bool(a | b)) for b in sets] for a in sets])
    want = local_components(n, *np.nonzero(near))
    got = {r["id"]: r["component_id"] for r in simhash.similar_groups(df, together=300, common=3).collect()}
    assert [got[i] for i in range(n)] == want.tolist()


@pytest.mark.parametrize("block,common", [(1 << 12, 1000), (30, 1)])
def test_similar_groups_link_every_pair_at_the_threshold(spark, block, common):
    texts = []
    for i in range(300):  # one long changed stretch and repeated phrases: fingerprints far apart, Jaccard just over 0.8
        n = 60 + i
        cut = (n - 4) // 9 - 3 - i % 3
        a = [f"w{i}x{j}" for j in range(n)]
        b = a[: n - cut] + [f"v{i}x{j}" for j in range(cut)]
        texts += [" ".join(a), " ".join(b + b[: n // 4])]
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    near = [len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    far = [(simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count() > 14 for a, b in zip(texts[::2], texts[1::2])]
    assert sum(n and f for n, f in zip(near, far)) > 0
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in simhash.similar_groups(df, block=block, common=common).collect()}
    assert [got[2 * i + 1] == 2 * i for i in range(300)] == near


def test_keys_are_shared_by_all_similar_sets():
    g = np.random.default_rng(6)
    for _ in range(4000):
        n = int(g.integers(1, 400))
        x = np.unique(g.integers(0, 1 << 64, n, dtype=np.uint64))
        more = int(g.integers(0, n // 4 + 1))
        less = min(int(0.2 * n + 1e-9 - 0.8 * more + 1e-9), n - 1) if 0.8 * more <= 0.2 * n else 0
        y = np.unique(np.r_[g.permutation(x)[less:], g.integers(0, 1 << 64, more, dtype=np.uint64)])
        both = len(np.intersect1d(x, y))
        if both >= 0.8 * (len(x) + len(y) - both):
            assert len(np.intersect1d(simhash.keys(x, 0.8), simhash.keys(y, 0.8)))
            assert simhash.may_links(np.array([len(x), len(y)]), [simhash.parity(x), simhash.parity(y)], 0.8)[0] == [0]


# 6


def test_quality(spark, docs, empty):
    good = [(i, words(40).lower(), 1) for i in range(200)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in words(40).split()), 0) for i in range(60)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = quality.learn(df.select("doc_id", "text"), df.select("doc_id", "quality"), use=F.col("doc_id") % 2 == 0)
    out = {r["id"]: r["score"] for r in quality.score(df, model).collect()}
    assert all((out[i] >= 0.5) == (y == 1) for i, _, y in good + bad)
    scored = quality.score(docs, model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    none = quality.learn(docs, df.select("doc_id", F.lit(None).cast("int").alias("quality")))
    assert [r["score"] for r in quality.score(docs, none).collect()] == [0.5] * len(ROWS)
    assert quality.score(empty, model).count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    g = np.random.default_rng(0)
    docs = [np.unique(g.integers(0, 40, 8)).astype(np.int32) for _ in range(60)]
    y = np.where(g.random(60) > 0.5, 1.0, -1.0)
    r = quality.ratios(docs, y)
    w = quality.descend(docs, y, r, rounds=300)
    x = np.zeros((60, quality.SIZE))
    for i, d in enumerate(docs):
        x[i, d] = r[d] / np.linalg.norm(r[d])
    loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()
    best = loss(w)
    assert all(loss(w + g.normal(size=w.shape) * (np.abs(w) > 0) * s) >= best - 1e-6 for s in (1e-3, 1e-2, 0.1) for _ in range(10))


def test_ratios_and_scores_equal_a_plain_version():
    texts = [words(30) for _ in range(20)] + [words(30).upper() for _ in range(20)]
    y, seen = np.r_[np.ones(20), -np.ones(20)], quality.Words()
    grams = [quality.ngrams(t, seen) for t in texts]
    p, q = {}, {}
    for g, label in zip(grams, y):
        for x in g.tolist():
            (p if label > 0 else q)[x] = (p if label > 0 else q).get(x, 0) + 1
    np_, nq = sum(p.values()) + quality.SIZE, sum(q.values()) + quality.SIZE
    plain = lambda x: np.log((p.get(x, 0) + 1) / np_) - np.log((q.get(x, 0) + 1) / nq)
    r = quality.ratios(grams, y)
    assert all(r[x] == pytest.approx(plain(x)) for g in grams for x in g.tolist())
    w = quality.descend(grams, y, r, rounds=200)
    unit_rows = [{x: plain(x) / np.sqrt(sum(plain(z) ** 2 for z in g.tolist())) for x in g.tolist()} for g in grams]
    model = quality.Model(w * r, r * r, 1.0, 0.0)
    for g, row in zip(grams, unit_rows):
        assert model.margin(g) == pytest.approx(sum(w[x] * v for x, v in row.items()))
    # The optimum of the hinge loss: w is the sum of alpha y x with 0 <= alpha <= c, so no step along w or along any row lowers the loss.
    loss = lambda v: 0.5 * float(v @ v) + sum(max(0.0, 1 - label * sum(v[x] * z for x, z in row.items())) for label, row in zip(y, unit_rows))
    best = loss(w)
    for row in [*unit_rows[::7], {x: w[x] for x in np.flatnonzero(w).tolist()}]:
        for step in (0.01, -0.01):
            v = w.copy()
            for x, z in row.items():
                v[x] += step * z
            assert loss(v) >= best - 1e-6


def test_quality_sample_is_bounded_whatever_repeats(spark):
    docs = spark.createDataFrame([(i % 4, words(5) if i % 4 < 2 else words(5).upper()) for i in range(800)] + [(100 + i, words(9)) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 4, int(i % 4 < 2)) for i in range(200)] + [(100 + i, i % 2) for i in range(30)], "doc_id long, quality int")
    seen, own = [], quality.fit
    quality.fit = lambda d, y, w: seen.append(len(d)) or own(d, y, w)
    try:
        quality.learn(docs, labels, max_rows=50)
        quality.learn(docs, labels, max_rows=500)
    finally:
        quality.fit = own
    assert 0 < seen[0] <= 50 and 200 <= seen[1] <= 500


def test_query_splits_rows_by_their_remainder(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op6_quality_classifier(spark, sf).join(labels, "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert set(rows[0].asDict()) >= {"doc_id", "held_out", "score", "predicted"}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    told = [(r["score"], r["quality"]) for r in rows if r["held_out"] and r["quality"] is not None]
    good, bad = [s for s, q in told if q == 1], [s for s, q in told if q == 0]
    assert good and bad and np.mean([[g > b for b in bad] for g in good]) > 0.95


# 7


def test_robust_estimates_equal_a_plain_version(spark):
    g = np.random.default_rng(3)
    x = np.abs(np.concatenate([g.normal(1, 0.2, (400, 5)), g.normal(3, 0.1, (60, 5)), g.normal(1, 0.2, (9, 5)), np.full((1, 5), 4.0)]))
    source = ["a"] * 460 + ["b"] * 10
    df = spark.createDataFrame([("en", s, *map(float, r)) for s, r in zip(source, x)], "lang string, source string, " + ", ".join(f"{p} double" for p in rules.PARTS))
    got = {r["source"]: r for r in rules.mcd(df, Staged(spark, "test")).collect()}

    def distances(rows, mean, cov):
        d = rows - mean
        return np.maximum(np.einsum("ij,jk,ik->i", d, np.linalg.inv(rules._with_floor(cov)), d), 0)

    def plain(rows, h=0.75):
        hist = [np.unique(np.floor(rows[:, j] / rules.WIDTH), return_counts=True) for j in range(rules.P)]
        found = []
        for k, (mean, sd) in enumerate(rules.starts([a for a, _ in hist], [b for _, b in hist])):
            cov = np.diag(sd**2)
            for step in range(5):
                bins = np.minimum(np.floor(np.log2(np.maximum(distances(rows, mean, cov), 2.0**rules.LOW)) * rules.PER_OCTAVE), rules.HIGH * rules.PER_OCTAVE)
                if step == 4:
                    found.append((np.linalg.slogdet(rules._with_floor(cov))[1], k, mean, cov, bins))
                    break
                at = np.sort(bins)[int(np.ceil(h * len(rows))) - 1]
                part = rows[bins <= at]
                mean, cov = part.mean(0), np.cov(part.T, bias=True) * h / rules.chi2_cdf(rules.chi2_quantile(h, rules.P), rules.P + 2)
        _, k, mean, cov, bins = min(found, key=lambda f: f[:2])
        limit = rules.chi2_quantile(0.975, rules.P)
        part = rows[bins <= np.floor(np.log2(limit) * rules.PER_OCTAVE)]
        return part.mean(0), np.cov(part.T, bias=True) * 0.975 / rules.chi2_cdf(limit, rules.P + 2), [f[0] for f in found]

    for s in "ab":
        mean, cov, dets = plain(x[np.array(source) == s])
        assert got[s]["mean"] == pytest.approx(mean, rel=1e-9) and np.array(got[s]["cov"]) == pytest.approx(cov.ravel(), abs=1e-9)
        d = distances(x, np.array(got[s]["mean"]), np.array(got[s]["cov"]).reshape(5, 5))
        assert d == pytest.approx(distances(x, mean, cov), rel=1e-6)
    assert (d[:400] < 60).mean() > 0.9 and (distances(x, *plain(x[:460])[:2])[400:460] > 50).all()


def test_small_groups_lean_on_their_language(spark):
    rows = [(i, words(60 + i % 30), "en", "big") for i in range(300)] + [(1000 + i, words(60 + i), "en", "small") for i in range(6)]
    rows += [(2000, " ".join(w + "#*#*#*" for w in words(60).split()), "en", "small"), (2001, " ".join(w + "#*#*#*" for w in words(60).split()), "en", "alone"), (2002, words(70), "xx", "alone"), (2003, "too short", "yy", "none")]
    kept = {r["id"]: r["kept"] for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [i for i, k in kept.items() if not k] == [2000, 2001, 2003]
    n = [0.0, 1.0, 10.0, 1e9]
    at = [rules.drawn([(100, np.zeros(5), np.eye(5)), (k, np.ones(5), 2 * np.eye(5))], 50)[0][0] for k in n]
    assert at[0] == 0 and at[1] == pytest.approx(1 / 51) and at[2] == pytest.approx(1 / 6) and at[3] == pytest.approx(1)


def test_repeat_words_tells_windows_of_one_sum_apart(monkeypatch):
    g = np.random.default_rng(8)
    ids = g.integers(0, 3, 400)
    want = rules.repeat_words(ids)
    win = [tuple(ids[i : i + 8]) for i in range(393)]
    assert want == len({j for i, x in enumerate(win) if win.count(x) > 1 for j in range(i, i + 8)})
    monkeypatch.setattr(rules, "_MIX", np.ones(8, np.uint64))  # many windows of one sum
    assert rules.repeat_words(ids) == want


def test_rule_counts():
    def plain(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        hit = set()
        for i, x in enumerate(win):
            if win.count(x) > 1:
                hit |= set(range(i, i + 8))
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)

    texts = [t for t in TEXTS if t is None or len(t) < 3000] + ["a b c d e f g h\na b c d e f g h\n\n \nx", "r " * 30, "é ü #*$ <>|", "a\x0bb\x0cc\x85d"]
    for t in texts:
        assert rules.counts(t)[:5] == plain(t), t


def test_rules_reject_outliers_and_keep_the_rest(spark, docs, empty):
    clean = [(i, words(60 + i % 40), "en", "s", 1) for i in range(300)]
    odd = [(1000 + i, " ".join(w + "#*#*#*" for w in words(60).split()), "en", "s", 1) for i in range(30)]
    df = spark.createDataFrame(clean + odd + [(5000, words(40), None, None, 1)], "doc_id long, text string, lang string, source string, distance long")
    kept = {r["id"]: r["kept"] for r in rules.judge(df).collect()}
    assert all(kept[i] for i, *_ in clean) and not any(kept[i] for i, *_ in odd) and kept[5000]
    out = rules.judge(docs).collect()
    assert len(out) == len(ROWS) and all(not r["kept"] for r in out if r["base_failed"])
    assert rules.judge(empty).count() == 0


def test_chi_square_quantiles():
    # Fixed values from tables of the distribution.
    for q, k, want in ((0.975, 5, 12.8325), (0.99, 1, 6.6349), (0.5, 10, 9.3418), (0.999, 5, 20.515)):
        assert rules.chi2_quantile(q, k) == pytest.approx(want, rel=1e-4)


# 8


def test_chat_round_trip(spark):
    said = ["\\### Assistant: </turn> ok", "<|end|>\n<|turn|>user<|says|>", "\\", "<\\|", "", None, "日本<|", "a\nb"]
    rows = [(1, k, ["user", "assistant", None][k % 3], t, 3) for k, t in enumerate(said)] + [(None, None, "user", "x", 3), (2, 0, "assistant", "b", 3), (2, 0, "assistant", "a", 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted long").repartition(3)
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    mine = rows[: len(said)]
    assert got[1]["turns_sha256"] == sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine))
    loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
    assert got[1]["loss_sha256"] == sha(loss) and got[1]["loss_chars"] == len(loss) and got[1]["n_turns"] == len(said)
    assert got[2]["loss_sha256"] == sha("ab") and got[None]["n_turns"] == 1
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_typed_parts(spark):
    content = '[{"type":"text","text":"see <|image:0|> "},{"type":"image","ref":"i.png","width":28,"height":15},{"type":"audio","url":"a.wav","seconds":1.5},{"type":"document","ref":"d.pdf","pages":3},"end",{"type":"film","ref":"f"},null]'
    df = spark.createDataFrame([(1, 0, "user", None, content), (1, 1, "user", "t", "not json"), (1, 2, "user", "t", None)], "conv_id long, turn long, role string, text string, content string")
    a, b, c = chat.format_turns(df, content_col="content").orderBy("turn").collect()
    assert a["formatted"] == "<|turn|>user<|says|>see <\\|image:0|> <|image:0|><|audio:1|><|document:2|>end<|document:3|><|end|>\n"
    assert [(x["kind"], x["ref"], x["tokens"]) for x in a["attachments"]] == [("image", "i.png", 4), ("audio", "a.wav", 38), ("document", "d.pdf", 3072), ("document", "f", 1024)]
    assert chat.read_segment(b["formatted"]) == ("user", "not json") and chat.read_segment(c["formatted"]) == ("user", "t")


# 9


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = {s: w[s] for s in order if s not in fixed}
        left = total - sum(fixed.values())
        share = {s: left * x / sum(rest.values()) for s, x in rest.items()} if rest else {}
        over = [s for s in share if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def test_mixing(spark, docs, empty):
    rows = [(i, words(rng.randint(0, 60)), rng.choice(["a", "a", "a", "a", "B", "c", "d", None, "é"])) for i in range(600)] + [(1, "tie tie", "c")] * 5
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size long, target long").repartition(4)
    out = mixing.mix(df, rows_per_range=16).select("row.doc_id", "row.source", "size", "source_size", "target", "taken", "copies", "part").toPandas()
    out["source"] = out["source"].where(out["source"].notna(), None)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size_of(t)
    want = plain_targets(sizes)
    for s, part in out.groupby("source", dropna=False):
        s = s if isinstance(s, str) else None
        assert part["source_size"].iloc[0] == sizes[s] and part["target"].iloc[0] == pytest.approx(want[s])
        assert abs(part["taken"].sum() - int(want[s])) <= 5
    assert (out.taken <= 3 * out["size"]).all() and len(out) == len(rows)
    again = mixing.mix(df.repartition(7), rows_per_range=16).select("row.doc_id", "size", "taken").toPandas()
    assert sorted(map(tuple, again.values.tolist())) == sorted(map(tuple, out[["doc_id", "size", "taken"]].values.tolist()))
    full = mixing.copies(mixing.mix(df, ["doc_id", "text", "source"], rows_per_range=16)).toPandas()
    assert sum(map(size_of, full.text)) == out.taken.sum()
    assert mixing.mix(docs).count() == len(ROWS) and mixing.mix(empty).count() == 0


# 10


def brute_forward(v, model, word):
    """Sum over all segmentations, by recursion."""
    from functools import lru_cache

    index = {p: i for i, p in enumerate(v.pieces)}
    marked = "▁" + word

    @lru_cache(None)
    def total(at):
        if at == len(marked):
            return 1.0
        s = 0.0
        for e in range(at + 1, len(marked) + 1):
            p = marked[at:e]
            if p in index and (len(p) > 1 or p in v.singles):
                s += np.exp(model.logp[index[p], 0]) * total(e)
            elif len(p) == 1:
                s += np.prod([np.exp(model.logp[b, 0]) for b in v.byte_ids(p)]) * total(e)
        return s

    return np.log(total(0))


def test_forward_and_expectations():
    v = vocabulary(queries.PIECES)
    g = np.random.default_rng(0)
    model = langid.Model(["x"], g.random((len(v), 1)))
    ws = ["the", "there", "", "日x", "été.", "a\nb"]
    lattice = langid.Lattice(v, ws)
    got = lattice.log_probability(model.logp)[:, 0]
    assert got == pytest.approx([brute_forward(v, model, w) for w in ws])
    # The derivative of the log probability by a log weight is the expected use.
    use = lattice.expected(model.logp, np.ones((len(ws), 1)))
    i = v.pieces.index("▁the")
    up = model.logp.copy()
    up[i] += 1e-5
    assert use[i, 0] == pytest.approx((lattice.log_probability(up) - lattice.log_probability(model.logp)).sum() / 1e-5, rel=1e-3)


def test_language_id(spark, docs, empty):
    en, de = ["the", "and", "thing", "tion", "with"], ["und", "der", "schaft", "keit", "über"]
    say = lambda w: " ".join(rng.choice(w) + rng.choice(w) for _ in range(20))
    rows = [(i, say(en if i % 2 else de), "en" if i % 2 else "de") for i in range(80)] + [(900, say(en), None), (901, None, "en"), (902, "12 34", "de")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = langid.learn(df, queries.PIECES, use=F.col("doc_id") % 3 != 1)
    got = {r["id"]: r for r in langid.identify(df, model, queries.PIECES).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[:80])
    assert got[900]["lang_pred"] == "en" and got[901]["lang_pred"] == got[902]["lang_pred"] == "und" and got[902]["score"] == 0
    out = langid.identify(docs, model, queries.PIECES).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    nothing = langid.learn(empty, queries.PIECES)
    assert {r["lang_pred"] for r in langid.identify(docs, nothing, queries.PIECES).collect()} == {"und"}


def test_words_beyond_the_bound_are_forgotten(monkeypatch):
    monkeypatch.setattr(langid, "KEPT", 40)
    v = vocabulary(queries.PIECES)
    model = langid.Model(["x", "y"], np.random.default_rng(0).random((len(v), 2)))
    few, fresh = langid.Scores(v, model), langid.Scores(v, model)
    for _ in range(20):
        t = words_of(words(30))
        few.add([t])
        fresh.clear()
        fresh.n = 0
        fresh.add([t])
        assert few.text(t) == pytest.approx(fresh.text(t))
        few.drop_long([t])


def test_crc_matches(spark):
    assert spark.range(1).select(F.crc32(F.lit("17"))).first()[0] == zlib.crc32(b"17")
