"""Conversions, writing, virtual arrays, collectives and hierarchies."""

from dataclasses import dataclass, field
from enum import IntEnum

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark import types as G
from gridspark.errors import ConversionError, GridError, LinkError, SelectionError
from gridspark.extents import Extents
from gridspark.functions import convert as C
from gridspark.operators import collective
from gridspark.operators.array import ArrayFrame
from gridspark.operators.catalog import Catalog
from gridspark.operators.vds import Mapping, compose
from gridspark.selection import Selection, s_


def cast(spark, values, src, dst):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {src.spark().simpleString()}")
    return [r[0] for r in df.select(C.convert(F.col("v"), src, dst), "i").orderBy("i").collect()]


def test_saturation(spark):
    top = 2**63 - 1
    assert cast(spark, [300, -300, 5, top], G.I64, G.I8) == [127, -128, 5, 127]
    assert cast(spark, [-5, 300, 42], G.I32, G.U8) == [0, 255, 42]
    nan = float("nan")
    assert cast(spark, [nan, 1e10, -1e10, 2.9, -2.9], G.F64, G.I16) == [0, 32767, -32768, 2, -2]
    assert cast(spark, [nan, 1e30, -1e30, float("inf"), -2.5], G.F64, G.I64) == [0, top, -top - 1, top, -2]
    assert [int(x) for x in cast(spark, [nan, 1e30, -1.0, 2.0**63 * 1.5, 7.9], G.F64, G.U64)] == [0, 2**64 - 1, 0, 2**63 + 2**62, 7]
    from decimal import Decimal

    assert cast(spark, [Decimal(2**64 - 1), Decimal(5)], G.U64, G.I64) == [top, 5] and cast(spark, [-1, 9], G.I64, G.U64) == [0, 9]
    assert cast(spark, [2**60 + 2**36 + 1], G.I64, G.F32) == [float(2**60)]


def test_strings_and_compounds(spark):
    assert cast(spark, ["üni", "code"], G.VarLenString(), G.FixedString(4)) == ["üni", "code"]
    assert cast(spark, ["code", "a\0b\0\0"], G.FixedString(8), G.VarLenString()) == ["code", "a\0b"]
    a, b = G.layout([("x", G.I64), ("y", G.F64)]), G.layout([("y", G.F32), ("x", G.I8)])
    assert [tuple(r) for r in cast(spark, [(300, 1.5)], a, b)] == [(1.5, 127)]
    assert cast(spark, [[1, 300]], G.FixedArray(G.I64, 2), G.FixedArray(G.U8, 2)) == [[1, 255]]
    with pytest.raises(ConversionError):
        cast(spark, [[1]], G.FixedArray(G.I64, 1), G.FixedArray(G.I64, 2))


def test_paths():
    assert G.conversion_path(G.I32, G.F64) == G.Conversion.HARD and G.conversion_path(G.I32, G.I32) == G.Conversion.NOOP
    assert G.conversion_path(G.FixedString(3), G.VarLenString()) == G.Conversion.SOFT and G.conversion_path(G.I8, G.VarLenString()) is None
    flag = G.Enum(G.I8, (("FALSE", 0), ("TRUE", 1)))
    assert G.conversion_path(flag, G.BOOL) == G.Conversion.SOFT and G.conversion_path(G.BOOL, G.I8) is None
    some = G.layout([("x", G.I64)])
    assert G.conversion_path(G.layout([("x", G.I64), ("y", G.I8)]), some) is None
    with pytest.raises(ConversionError):
        G.check_conversion(G.I64, G.I32, G.Conversion.NOOP)


def test_descriptors():
    class Color(IntEnum):
        Red = 1
        Blue = 3

    @dataclass
    class Pixel:
        xy: tuple[int, int]
        color: Color
        note: str = field(default="", metadata={"rename": "tag"})
        gone: int = field(default=0, metadata={"skip": True})

    t = G.describe(Pixel)
    assert [f.name for f in t.fields] == ["xy", "color", "tag"] and t.fields[2].offset == 24 and t.size == 40
    assert t.to_packed().size == 33 and G.from_spark(t.spark()).fields[1].type.members == (("Red", 1), ("Blue", 3))
    assert str(G.Dynamic(t, {"xy": {"0": 1, "1": 2}, "color": 3, "tag": "x"})) == "{xy: {0: 1, 1: 2}, color: Blue, tag: 'x'}"
    for bad in (object, IntEnum("E", {}), dataclass(type("N", (), {}))):
        with pytest.raises(ConversionError):
            G.describe(bad)


def test_writing(spark):
    a = np.arange(100).reshape(10, 10)
    af = ArrayFrame.from_values(spark, a, G.I64, chunk=(4, 4))
    b = af.write_slice(s_[0, 0:3], ArrayFrame.from_values(spark, [-1, -2, -3], G.I64)).collect()
    assert b[0, :4].tolist() == [-1, -2, -3, 3] and (b[1:] == a[1:]).all()
    twice = af.write_slice(Selection.points([[1, 1], [1, 1]]), ArrayFrame.from_values(spark, [5, 6], G.I32)).collect()
    assert twice[1, 1] == 6
    with pytest.raises(SelectionError):
        af.write_slice(s_[0], ArrayFrame.from_values(spark, [1], G.I64))
    grown = ArrayFrame.from_values(spark, a, G.I64, maxshape=(None, 10), fill=9, chunk=(4, 4)).resize((12, 5))
    c = grown.collect()
    assert c.shape == (12, 5) and (c[10:] == 9).all() and (c[:10] == a[:, :5]).all()
    assert grown.dense().df.count() == 60
    with pytest.raises(SelectionError):
        af.resize((11, 10))
    with pytest.raises(GridError):
        ArrayFrame.from_values(spark, a, G.I64).resize((1, 1))
    assert (af.reshape((20, 5)).collect() == a.reshape(20, 5)).all()
    assert af.chunk_info().count() == 9 and sum(r["n"] for r in af.chunk_stats().collect()) == 100
    assert ArrayFrame.filled(spark, Extents.of([4]), G.F64, 7.5).dense().collect().tolist() == [7.5] * 4


def test_virtual(spark):
    a, b = np.arange(12).reshape(3, 4), np.arange(100, 112)
    x, y = ArrayFrame.from_values(spark, a, G.I64), ArrayFrame.from_values(spark, b, G.I64)
    maps = [
        Mapping(x, s_[0:2, 1:3], s_[0:2, 0:2]),
        Mapping(y, s_[0:12:3], s_[0, 1:5]),
        Mapping(y, s_[0:4], Selection.points([[1, 1], [2, 2], [2, 2], [0, 0]])),
        Mapping(y, s_[5:12], s_[2, 4:6]),
    ]
    want = np.full((3, 6), -1)
    for m, src in zip(maps, (a, b, b, b)):
        for i, j in zip(m.target_selection.linear_indices((3, 6)), m.source_selection.linear_indices(src.shape)):
            want.reshape(-1)[i] = src.reshape(-1)[j]
    got = compose(spark, Extents.of([3, 6]), G.I64, maps, fill=-1)
    assert sorted(r[0] for r in got.df.where("d0 = 2 and d1 = 2").select("v").collect()) in ([101], [102])
    have, want[2, 2] = got.collect(), 0
    have[2, 2] = 0
    assert (have == want).all()
    with pytest.raises(SelectionError):
        compose(spark, Extents.of([3]), G.I8, maps)


def test_collectives(spark):
    df = spark.createDataFrame([(r, float(r) if r != 2 else float("nan"), r * 10) for r in range(4)], "rank int, x double, k long")
    assert {tuple(r) for r in collective.allreduce(df, "k", "sum").collect()} == {(r, 60) for r in range(4)}
    assert collective.allreduce(df, "x", "max").first()["x"] == 3.0 and collective.allreduce(df, "x", "min").first()["x"] == 0.0
    assert collective.gather(df, "k").first()[0] == [0, 10, 20, 30]
    assert {r["k"] for r in collective.bcast(df, "k", root=3).collect()} == {30}
    base = ArrayFrame.from_values(spark, [1, 2, 3], G.I64)
    log = spark.createDataFrame([(0, 7, 1), (0, 8, 2), (2, 9, 0)], "d0 long, v long, rank int")
    assert collective.merge(base, log).collect().tolist() == [8, 2, 9]


def test_hierarchy(spark):
    c = Catalog.empty(spark)
    c, leaf = c.add_object("/a/b/c/leaf", "dataset")
    c, _ = c.add_object("/z")
    c = c.link_soft("/a/b/c", "/shortcut").link_hard("/a/b/c/leaf", "/hard_leaf").link_soft("/nowhere", "/dangling").link_external("f.h5", "/x", "/ext")
    assert [r["name"] for r in c.members(0).collect()] == ["a", "dangling", "ext", "hard_leaf", "shortcut", "z"]
    assert [r["name"] for r in c.members(0, "creation", descending=True, limit=2).collect()] == ["ext", "dangling"]
    assert c.resolve("/shortcut/leaf") == leaf == c.resolve("//a/./b/c/leaf") == c.resolve("/hard_leaf")
    assert c.exists("/dangling") and not c.exists("/nope") and not c.exists("/nope/x")
    assert {r["obj"]: r["links"] for r in c.link_counts().collect()}[leaf] == 2
    paths = {r["obj"]: r["path"] for r in c.paths().collect()}
    assert paths[leaf] == "/hard_leaf" and paths[0] == "/"
    assert [r["name"] for r in c.of_kind(0, "group").collect()] == ["a", "z"]
    for bad in (lambda: c.resolve("/dangling"), lambda: c.resolve("/ext"), lambda: c.add_object("/z"), lambda: c.unlink("nope"), lambda: c.relink("z", "/none/z"), lambda: c.link_soft("/z", "/z")):
        with pytest.raises(LinkError):
            bad()
    moved = c.relink("z", "/a/z")
    assert moved.exists("/a/z") and not moved.exists("/z")
    d = c.set_comment(leaf, "hi").set_attr(leaf, "n", "int32", [], "7")
    assert d.info().where(F.col("token") == leaf).first()["comment"] == "hi" and [r[0] for r in d.attr_names(leaf).collect()] == ["n"]
    loop = c.link_soft("/loop", "/loop")
    with pytest.raises(LinkError):
        loop.resolve("/loop")
    many = spark.createDataFrame([("/a/b/c/leaf",), ("/z",), ("/q",), ("/",)], "path string")
    assert {r["path"]: r["obj"] for r in c.resolve_all(many).collect()} == {"/a/b/c/leaf": leaf, "/z": c.resolve("/z"), "/q": None, "/": 0}


def test_small_patches_are_not_shuffled(spark):
    a = ArrayFrame.from_values(spark, list(range(50)), G.I64)
    sparse = ArrayFrame(a.df.where("d0 % 2 = 0"), a.extents, G.I64)
    patch = ArrayFrame.from_values(spark, [-1, -2, -3], G.I64)
    for x in (a, sparse):
        few, many = x.write_slice(s_[3:9:2], patch), x.upsert(spark.createDataFrame([(3, 0, -1), (5, 1, -2), (7, 2, -3)], "d0 bigint, ord bigint, v bigint"))
        want = {r.d0: r.v for r in many.df.collect()}
        assert {r.d0: r.v for r in few.df.collect()} == want and want[5] == -2 and few.df.count() == many.df.count()
    plan = sparse.write_slice(s_[3:9:2], patch).df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def test_tensors(spark):
    from gridspark.errors import SelectionError
    from gridspark.operators import tensor

    a, b = ArrayFrame.from_values(spark, [[1, -2], [3, 4], [0, 1]], G.I32), ArrayFrame.from_values(spark, [[1.0, 0.5], [2.0, -1.0]], G.F64)
    assert tensor.matmul(a, b).collect().tolist() == [[-3.0, 2.5], [11.0, -2.5], [2.0, -1.0]]
    assert tensor.relu(a).collect().tolist() == [[1, 0], [3, 4], [0, 1]]
    with pytest.raises(SelectionError):
        tensor.matmul(b, a)


def test_grids_are_ranges(spark):
    a = ArrayFrame.filled(spark, Extents.of([2, 3, 2]), G.I32)
    assert sorted(map(tuple, a.grid().collect())) == [(i, j, k) for i in range(2) for j in range(3) for k in range(2)]
    assert a.grid([4, 0]).count() == 0


def test_arrays_of_variable_length(spark):
    from gridspark.functions import arrays as A

    df = spark.createDataFrame([([1, 2, 3, 4],), ([],), (None,)], "v array<int>")
    got = df.select(A.length(F.col("v")), A.part(F.col("v"), 1, 3), A.part(F.col("v"), 2), A.equal(F.col("v"), F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(4, [2, 3], [3, 4], True), (0, [], [], True), (None, None, None, True)]
