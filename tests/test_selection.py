"""Extents, selections and their predicates."""

import random

import pytest

from gridspark import types as G
from gridspark.errors import SelectionError
from gridspark.extents import Extent, Extents, strides
from gridspark.operators.array import ArrayFrame, auto_chunk, choose_layout, num_chunks
from gridspark.selection import Index, Selection, Slice, s_


def test_extents():
    assert Extents.null().size == 0 and Extents.scalar().size == 1 and Extents.of([5, 10]).size == 50
    assert str(Extent(5, 10)) == "5..=10" and str(Extent(5, None)) == "5.." and str(Extent(5, 5)) == "5"
    assert str(Extents.of([(3, None), 4])) == "(3.., 4)" and str(Extents.of([3])) == "(3,)" and str(Extents.scalar()) == "scalar"
    assert Extents.null().is_resizable and Extents.scalar().is_resizable and not Extents.of([3]).is_resizable
    assert Extents.resizable([2]).resized([9]).dims == (9,)
    for bad in (lambda: Extent(5, 4), lambda: Extents.of([1] * 33), lambda: Extents.of([3]).resized([4]), lambda: Extents.of([3]).resized([1, 1])):
        with pytest.raises(SelectionError):
            bad()
    assert strides((2, 3, 4)) == (12, 4, 1) and strides(()) == ()


def test_axes_match_plain_enumeration():
    rng = random.Random(0)
    for _ in range(3000):
        dim = rng.randint(1, 40)
        start, step, block = rng.randint(0, dim), rng.randint(1, 6), rng.randint(1, 6)
        end = rng.randint(0, dim)
        axis = Selection.slab(Slice(start, step, end, block=block)).axes([dim])[0]
        want = [start + i * step + j for i in range(len(range(start + block - 1, end, step))) for j in range(block)]
        assert axis.coordinates() == want and axis.length == len(want) and all(x < dim for x in want)
        assert not want or axis.stop == max(want) + 1 or axis.overlaps


def test_refusals():
    for bad in (lambda: s_[-1], lambda: s_[1:-1], lambda: s_[::-1], lambda: Selection.slab(..., ...), lambda: Slice(0, 0), lambda: Selection.points([[1], [1, 2]])):
        with pytest.raises(SelectionError):
            bad()
    for bad, dims in ((s_[5], [5]), (s_[0:6], [5]), (Selection.slab(Slice(3, 2, count=3)), [7]), (s_[1, 1], [5]), (s_[6:], [5])):
        with pytest.raises(SelectionError):
            bad.axes(dims)
    with pytest.raises(SelectionError):
        s_[1].with_block(0, 2)
    assert Selection.slab(Slice(3, 2, count=2)).axes([6])[0].coordinates() == [3, 5]


def test_shapes_and_display():
    assert s_[0:10:2, 0:4].out_shape((10, 10)) == (5, 4) and s_[3, ...].out_shape((10, 10)) == (10,)
    assert s_[0:10, 0:10].simplified((10, 10)).kind == "all" and s_[3:3, :].simplified((10, 10)).kind == "none"
    assert str(Selection.slab(Slice(1, 2, 5, block=3), Index(4))) == "(1..5;2(Bx3), 4)" and str(Slice()) == "..∞"
    assert s_[0:3].with_unlimited(0).out_shape((9,)) == (9,) and s_[0:9:3].with_block(0, 2).out_shape((9,)) == (6,)
    assert s_[1:3, 0].linear_indices((4, 5)) == [5, 10]
    assert Selection.slab(Slice(0, 2, count=4)).linear_indices((5,), clip=True) == [0, 2, 4]


def test_select_against_numpy(spark):
    import numpy as np

    a = np.arange(12 * 9).reshape(12, 9)
    af = ArrayFrame.from_values(spark, a, G.I64)
    rng = random.Random(1)
    for _ in range(12):
        items = []
        for dim in a.shape:
            kind = rng.random()
            if kind < 0.2:
                items.append(Index(rng.randrange(dim)))
            else:
                step, block = rng.randint(1, 4), rng.randint(1, 4)
                items.append(Slice(rng.randint(0, 3), step, rng.randint(4, dim), block=block))
        s = Selection.slab(*items)
        want = a.reshape(-1)[s.linear_indices(a.shape)].reshape(s.out_shape(a.shape))
        got = af.select(s)
        assert got.shape == want.shape and got.df.count() == want.size
        assert want.size == 0 or (got.collect() == want).all(), str(s)
    assert af.points([[3, 3], [0, 0], [3, 3]]).collect().tolist() == [30, 0, 30]
    assert af.select(Selection.none()).df.count() == 0


def test_predicates_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet")
    af = ArrayFrame.from_column(df, "event_id", "value", df.count(), G.F64)
    plan = af.select(s_[10:500:7]).df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_id,10)" in plan and "LessThan(event_id," in plan and "Exchange" not in plan
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_chunking():
    assert num_chunks((40, 40), (4, 4)) == 100 and num_chunks((0,), (4,)) == 1
    assert auto_chunk((100, 100), 8, 8 * 2500) == (50, 50) and auto_chunk((4, 4), 1, 8) == (4, 2) and auto_chunk((0,), 8, 1) == (1,)
    fixed, grows = Extents.of([10, 10]), Extents.resizable([10, 0])
    assert choose_layout(fixed, 8) is None and choose_layout(grows, 8) == (10, 1) and choose_layout(fixed, 8, filters=True) == (10, 10)
    from gridspark.errors import GridError

    for bad in (dict(extents=grows, no_chunk=True), dict(extents=Extents.scalar(), chunk=(1,)), dict(extents=fixed, chunk=(11, 1))):
        with pytest.raises(GridError):
            choose_layout(bad.pop("extents"), 8, **bad)
