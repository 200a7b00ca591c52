"""Virtual arrays: selections of source arrays mapped onto selections of a new one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import types as G
from ..errors import SelectionError
from ..extents import Extents, strides
from ..selection import Selection
from .array import ArrayFrame, names


@dataclass(frozen=True)
class Mapping:
    """Cells of source_selection, in row-major order, go to those of target_selection, as far as both reach."""

    source: ArrayFrame
    source_selection: Selection
    target_selection: Selection


def _shift(m: Mapping, dims: Sequence[int]) -> list[Column] | None:
    """Target coordinates as sums, where both selections are solid blocks of one shape."""
    a, b = m.source_selection, m.target_selection
    if "points" in (a.kind, b.kind) or "none" in (a.kind, b.kind):
        return None
    x, y = a.axes(m.source.shape), b.axes(dims)
    solid = lambda axes: all(s.length == 1 or s.step == s.block or (s.step == 1 and s.block == 1) or s.count == 1 for s in axes)
    if not (solid(x) and solid(y)):
        return None
    wide_x, wide_y = [s for s in x if s.length != 1], [s for s in y if s.length != 1]
    if [s.length for s in wide_x] != [s.length for s in wide_y]:
        return None
    source = iter([(n, s) for n, s in zip(names(len(x)), x) if s.length != 1])
    return [F.lit(s.start).cast("bigint") if s.length == 1 else (lambda n, o: F.col(n) + (s.start - o.start))(*next(source)) for s in y]


def _placed(m: Mapping, dims: Sequence[int]) -> DataFrame:
    """Coordinates in the virtual array and values of one mapping."""
    if (to := _shift(m, dims)) is not None:
        p = m.source_selection.predicate(m.source.shape, m.source.names)
        df = m.source.df if p is None else m.source.df.where(p)
        return df.select(*[c.alias(n) for c, n in zip(to, names(len(dims)))], "v")
    size = min(m.source_selection.size(m.source.shape), m.target_selection.size(dims))
    taken = m.source.select(m.source_selection).with_linear("ord").where(F.col("ord") < size)
    if m.target_selection.kind == "points":
        spark = m.source.df.sparkSession
        at = spark.createDataFrame([(i, *c) for i, c in enumerate(m.target_selection.coords)], "ord bigint, " + ", ".join(f"{n} bigint" for n in names(len(dims))))
        return taken.select("ord", "v").join(at, "ord").select(*names(len(dims)), "v")
    axes = m.target_selection.axes(dims)
    lengths = [a.length for a in axes]
    cols = []
    for n, a, st, length in zip(names(len(dims)), axes, strides(lengths), lengths):
        at = F.floor(F.col("ord") / st) % max(length, 1)
        cols.append((F.lit(a.start) + F.floor(at / a.block) * a.step + at % a.block).cast("bigint").alias(n))
    return taken.select(*cols, "v")


def compose(spark: SparkSession, extents: Extents, type: G.Type, mappings: Sequence[Mapping], fill: Any = None) -> ArrayFrame:
    """The virtual array; a later mapping covers an earlier one, gaps have the fill value (as missing cells)."""
    if any(m.source.type.size != type.size for m in mappings):
        raise SelectionError("a source's elements must have the size of the virtual array's")
    if not mappings:
        return ArrayFrame.filled(spark, extents, type, fill)
    ns, dims = names(extents.ndim), extents.dims
    parts = [_placed(m, dims) for m in mappings]
    if len(parts) == 1 or _disjoint(mappings, dims):
        return ArrayFrame(reduce(DataFrame.unionByName, parts), extents, type, fill)
    numbered = reduce(DataFrame.unionByName, [p.withColumn("mapping", F.lit(i)) for i, p in enumerate(parts)])
    return ArrayFrame(numbered.groupBy(*ns).agg(F.max_by("v", "mapping").alias("v")), extents, type, fill)


def _disjoint(mappings: Sequence[Mapping], dims: Sequence[int]) -> bool:
    """True if the targets' bounding boxes do not meet, so the union needs no aggregation."""
    if any(m.target_selection.kind == "points" for m in mappings):
        return False
    boxes = [[(a.start, a.stop) for a in m.target_selection.axes(dims)] for m in mappings]
    meet = lambda p, q: all(a < d and c < b for (a, b), (c, d) in zip(p, q))
    boxes.sort()
    return not any(meet(boxes[i], boxes[j]) for i in range(len(boxes)) for j in range(i))
