"""The stages one after another, each against brute force on its own input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridspark.llm import rules, simhash, suffix
from gridspark.llm.common import by_group
from gridspark.llm.components import local_components

from .test_ops import DDL, ROWS, brute_repeats, size_of, words


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    base = [words(50) for _ in range(30)]
    texts = base + base[:5] + [b + " more" for b in base[:5]] + [None, "", "r r r " * 60] + [words(10) + base[7] + words(30) for _ in range(3)]
    rows = [(i, t, "en", "ab"[i % 2], None if t is None else len(t)) for i, t in enumerate(texts)] + [(3, base[3], "en", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], "").write.parquet(f"{root}/{k}")
        out.append(spark.read.parquet(f"{root}/{k}"))
    return [x.toPandas() for x in out]


def test_shapes(stages):
    for s in stages[:-1]:
        assert list(s.columns) == ["doc_id", "text", "lang", "source", "n_chars"]


def test_rules_stage(stages):
    kept = set(stages[1].doc_id)
    assert kept == {r.doc_id for r in stages[0].itertuples() if not ((c := rules.counts(r.text))[0] < 20 or 100 * c[4] > 30 * c[0])}


def test_near_stage(stages):
    d = stages[1]
    sets = [frozenset(simhash.shingle_hashes(t, 5).tolist()) for t in d.text]
    near = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    label = local_components(len(sets), *np.nonzero(near))
    want = {min(d.doc_id[i] for i in np.flatnonzero(label == g)) for g in set(label)}
    assert sorted(stages[2].doc_id) == sorted(want)


def test_repeats_stage(stages):
    rows = list(zip(stages[2].doc_id, stages[2].text))
    got = dict(zip(stages[3].doc_id, stages[3].text))
    for i, b, gone in brute_repeats(rows):
        assert got[i] == np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")


def test_mix_and_pack(stages):
    sizes = stages[3].assign(n=stages[3].text.map(size_of)).groupby("source").n.sum()
    taken = stages[4].assign(n=stages[4].text.map(size_of)).groupby("source").n.sum()
    total = sizes.sum()
    assert abs(taken["a"] - min(3 * sizes["a"], total * 5 / 7)) <= 1
    packed = stages[5].sort_values(["sequence_id", "offset"])
    assert packed.groupby("sequence_id").length.sum().max() <= 1024
    assert packed[packed.piece == 0].shape[0] == len(stages[4])


def test_odd_rows_pass_all_stages(spark):
    docs = spark.createDataFrame([r[:4] + (None,) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(f(spark, docs, "").toPandas().astype(object).where(lambda x: x.notna(), None).values.tolist() or [], f(spark, docs, "").schema)
        assert docs.columns
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        empty = f(spark, empty, "")
        assert empty.count() == 0


def test_near_stage_keeps_a_row_of_each_class_under_shared_ids(spark):
    a, b, c, d = (words(40) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d + " more"), (9, a), (8, d)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert len(got) == 4
    assert {(None, a), (None, b), (7, c)} < set(got)
    assert {i for i, t in got if t in (d, d + " more")} == {7}


def test_groups_are_whole_across_batches(spark):
    rows = [(None if i % 5 == 0 else f"k{i % 7}", i % 3, i, "x" * i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a string, b long, n long, t string").repartition(3)

    def f(pdf):
        out = pdf.groupby(["a", "b"], dropna=False).agg(n=("n", "sum"), m=("t", "size")).reset_index()
        return out[out.a != "k3"]

    got = {(r.a, r.b, r.n, r.m) for r in by_group(df, ["a", "b"], f, "a string, b int, n long, m long").collect()}
    own = {}
    for a, b, n, _ in rows:
        s, m = own.get((a, b), (0, 0))
        own[a, b] = (s + n, m + 1)
    assert got == {(*k, *x) for k, x in own.items() if k[0] != "k3"}
    assert by_group(df.where("n < 0"), ["a", "b"], f, "a string, b int, n long, m long").count() == 0


def test_stages_leave_no_arrow_buffers_behind(spark):
    allocator = spark._jvm.org.apache.spark.sql.util.ArrowUtils.rootAllocator()
    texts = [words(60) for _ in range(40)]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts + [t + " more" for t in texts] + [words(20) + t for t in texts])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()
    for _, f in corpus_pipeline.STAGES:
        before = allocator.getAllocatedMemory()
        f(spark, docs, "").collect()
        assert allocator.getAllocatedMemory() <= before, f.__name__
