"""ArrayFrame: an N-dimensional array as a DataFrame of coordinates d0.. and values v.

Rows are cells; a missing cell has the fill value. Selections are predicates, so they prune and push down; writes and resizes are joins on coordinates, never copies of whole arrays. Nothing but `collect`-like calls runs a job.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from math import ceil, prod
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import types as G
from ..errors import GridError, SelectionError
from ..extents import Extents, strides
from ..functions import convert as C
from ..selection import Axis, Selection

#: Points and selections written by hand are broadcast up to this many.
BROADCAST_POINTS = 100_000


def names(n: int) -> list[str]:
    return [f"d{k}" for k in range(n)]


@dataclass(frozen=True)
class ArrayFrame:
    df: DataFrame
    extents: Extents
    type: G.Type
    fill: Any = None
    chunk: tuple[int, ...] | None = None

    # Making

    @classmethod
    def from_vectors(cls, df: DataFrame, row: str, vector: str, shape: Sequence[int], type: G.Type = G.F32, **more) -> ArrayFrame:
        """A matrix: one row of it per DataFrame row, its columns an array."""
        cells = df.select(F.col(row).cast("bigint").alias("d0"), F.posexplode(vector).alias("p", "v"))
        return cls(cells.select("d0", F.col("p").cast("bigint").alias("d1"), "v"), Extents.of(shape), type, **more)

    @classmethod
    def from_column(cls, df: DataFrame, key: str, value: str | Column, size: int, type: G.Type, **more) -> ArrayFrame:
        """A vector: its coordinate a key column."""
        v = F.col(value) if isinstance(value, str) else value
        return cls(df.select(F.col(key).cast("bigint").alias("d0"), v.alias("v")), Extents.of([size]), type, **more)

    @classmethod
    def from_values(cls, spark: SparkSession, values, type: G.Type, shape: Sequence[int] | None = None, maxshape=None, **more) -> ArrayFrame:
        """From a numpy array or nested lists (driver-sized data)."""
        import numpy as np

        a = np.asarray(values, dtype=object)
        if shape is not None:
            a = a.reshape(tuple(shape))
        plain = lambda x: x.item() if hasattr(x, "item") else x
        rows = [(*map(int, at), plain(x)) for at, x in np.ndenumerate(a)]
        schema = ", ".join(f"{n} bigint" for n in names(a.ndim)) + (", " if a.ndim else "") + f"v {type.spark().simpleString()}"
        extents = Extents.of(zip(a.shape, maxshape)) if maxshape else Extents.of(a.shape)
        return cls(spark.createDataFrame(rows, schema), extents, type, **more)

    @classmethod
    def filled(cls, spark: SparkSession, extents: Extents, type: G.Type, fill: Any = None, **more) -> ArrayFrame:
        """An array without stored cells."""
        schema = ", ".join(f"{n} bigint" for n in names(extents.ndim)) + (", " if extents.ndim else "") + f"v {type.spark().simpleString()}"
        return cls(spark.createDataFrame([], schema), extents, type, fill, **more)

    # Describing

    @property
    def names(self) -> list[str]:
        return names(self.ndim)

    @property
    def shape(self) -> tuple[int, ...]:
        return self.extents.dims

    @property
    def ndim(self) -> int:
        return self.extents.ndim

    @property
    def size(self) -> int:
        return self.extents.size

    @property
    def is_scalar(self) -> bool:
        return self.extents.is_scalar

    @property
    def is_resizable(self) -> bool:
        return self.extents.is_simple and self.extents.is_unlimited

    @property
    def is_chunked(self) -> bool:
        return self.chunk is not None

    @property
    def fill_value(self) -> Any:
        """The user's fill, or the zero of the type."""
        if self.fill is not None:
            return self.fill
        return False if isinstance(self.type, G.Boolean) else "" if isinstance(self.type, (G.FixedString, G.VarLenString)) else 0

    def _fill(self) -> Column:
        return F.lit(self.fill_value).cast(self.type.spark())

    def _spark(self) -> SparkSession:
        return self.df.sparkSession

    # Reading

    def select(self, what) -> ArrayFrame:
        """The cells of a selection, renumbered from 0; indexed axes go."""
        given = Selection.of(what)
        if given.kind == "points":
            return self.points(given.coords)
        shape, s = given.out_shape(self.shape), given.simplified(self.shape)
        if s.kind == "none":
            at = [F.lit(0).cast("bigint").alias(n) for n in names(len(shape))]
            return ArrayFrame(self.df.where(F.lit(False)).select(*at, "v"), Extents.of(shape), self.type, self.fill)
        axes = s.axes(self.shape)
        p = s.predicate(self.shape, self.names)
        df = self.df if p is None else self.df.where(p)
        keep = [(n, a) for n, a in zip(self.names, axes) if not a.drop]
        for n, a in keep:
            if a.overlaps:
                df = _overlap(df, n, a)
        out = [(F.col(n) if a.overlaps else a.renumber(F.col(n))).cast("bigint").alias(f"d{k}") for k, (n, a) in enumerate(keep)]
        return ArrayFrame(df.select(*out, "v"), Extents.of(shape), self.type, self.fill)

    def points(self, coords: Sequence[Sequence[int]] | DataFrame) -> ArrayFrame:
        """Cells at points, in their order and as often as they are named: d0 is the place in the list.

        From a DataFrame: columns ord and d0..; it is joined, and broadcast only by its measured size."""
        if isinstance(coords, DataFrame):
            at, n = coords, coords.count()
        else:
            s = Selection.points(coords)
            s.check_points(self.shape)
            n = len(s.coords)
            at = self._spark().createDataFrame([(i, *c) for i, c in enumerate(s.coords)], "ord bigint, " + ", ".join(f"{x} bigint" for x in self.names))
        at = F.broadcast(at) if n <= BROADCAST_POINTS else at
        df = self.df.join(at, self.names).select(F.col("ord").alias("d0"), "v")
        return ArrayFrame(df, Extents.of([n]), self.type, self.fill)

    def as_type(self, type: G.Type, allowed: G.Conversion = G.Conversion.SOFT) -> ArrayFrame:
        f = C.converter(self.type, type, allowed)
        return replace(self, df=self.df.withColumn("v", f(F.col("v"))), type=type)

    def read_tensor(self) -> tuple[ArrayFrame, tuple[int, ...]]:
        return replace(self, df=self.df.withColumn("v", C.tensor_f32(F.col("v"), self.type)), type=G.F32), self.shape

    def dense(self) -> ArrayFrame:
        """Every cell stored: missing ones have the fill value."""
        grid = self.grid()
        if not self.ndim:
            return self
        return replace(self, df=grid.join(self.df, self.names, "left").select(*self.names, F.coalesce("v", self._fill()).alias("v")))

    def grid(self, dims: Sequence[int] | None = None) -> DataFrame:
        """All coordinates: a distributed range over row-major positions, taken apart by arithmetic; no join and no array."""
        dims = self.shape if dims is None else tuple(dims)
        return self._spark().range(prod(dims)).select(*[F.expr(f"id div {s} % {d}").cast("bigint").alias(f"d{k}") for k, (s, d) in enumerate(zip(strides(dims), dims))])

    def with_linear(self, name: str = "i") -> DataFrame:
        """Cells with their row-major position."""
        total: Column = F.lit(0).cast("bigint")
        for n, s in zip(self.names, strides(self.shape)):
            total = total + F.col(n) * s
        return self.df.withColumn(name, total)

    def reshape(self, shape: Sequence[int]) -> ArrayFrame:
        """The same cells in row-major order under another shape."""
        if prod(shape) != self.size:
            raise SelectionError(f"cannot reshape {self.shape} to {tuple(shape)}")
        df = self.with_linear("i_")
        out = [(F.floor(F.col("i_") / s) % d).cast("bigint").alias(f"d{k}") for k, (s, d) in enumerate(zip(strides(shape), shape))]
        return replace(self, df=df.select(*out, "v"), extents=Extents.of(shape), chunk=None)

    def collect(self, what=None) -> Any:
        """A numpy array on the driver (object dtype for anything but numbers); for results that fit there."""
        import numpy as np

        a = (self.select(what) if what is not None else self).df.toArrow()
        shape = self.shape if what is None else Selection.of(what).out_shape(self.shape)
        values = a["v"].to_pylist()
        out = np.empty(shape, dtype=object)
        out[...] = self.fill_value
        at = [a[n].to_pylist() for n in names(len(shape))]
        for i, v in enumerate(values):
            out[tuple(c[i] for c in at)] = v
        if isinstance(self.type, (G.Integer, G.Unsigned, G.Float, G.Boolean)):
            return out.astype({G.Float: "f", G.Integer: "i", G.Unsigned: "u", G.Boolean: "?"}[type(self.type)] + ("" if isinstance(self.type, G.Boolean) else str(self.type.size)))
        return out

    def scalar(self) -> Any:
        if self.size != 1:
            raise GridError(f"{self.shape} is not one element")
        row = self.df.select("v").first()
        return self.fill_value if row is None else row[0]

    # Writing

    def write(self, other: ArrayFrame) -> ArrayFrame:
        if other.shape != self.shape:
            raise SelectionError(f"shape {other.shape} is not {self.shape}")
        return replace(self, df=other.as_type(self.type).df)

    def write_slice(self, what, values: ArrayFrame) -> ArrayFrame:
        """The array with a selection's cells replaced, by position in row-major order. Where a cell is selected
        twice the last value stays. Up to BROADCAST_POINTS values the old cells aren't shuffled."""
        s = Selection.of(what)
        if s.size(self.shape) != values.size:
            raise SelectionError(f"{values.size} values for {s.size(self.shape)} cells")
        new = values.as_type(self.type).with_linear("ord")
        if s.kind == "points":
            at = self._spark().createDataFrame([(i, *c) for i, c in enumerate(s.coords)], "ord bigint, " + ", ".join(f"{x} bigint" for x in self.names))
            new = new.select("ord", "v").join(F.broadcast(at) if len(s.coords) <= BROADCAST_POINTS else at, "ord")
        else:
            axes = s.axes(self.shape) if s.kind != "none" else []
            lengths = [a.length for a in axes]
            for n, a, st, length in zip(self.names, axes, strides(lengths), lengths):
                at = F.floor(F.col("ord") / st) % length
                new = new.withColumn(n + "_", (F.lit(a.start) + F.floor(at / a.block) * a.step + at % a.block).cast("bigint"))
            new = new.select("ord", "v", *[F.col(n + "_").alias(n) for n in self.names]) if axes else new.where(F.lit(False)).select("ord", "v", *[F.lit(0).cast("bigint").alias(n) for n in self.names])
        return self.upsert(new, few=values.size <= BROADCAST_POINTS)

    def upsert(self, cells: DataFrame, order: str = "ord", few: bool = False) -> ArrayFrame:
        """Cells (coordinates, v, order) put over the array; the last by order wins. `few`: there are at most BROADCAST_POINTS cells, by their count."""
        last = cells.groupBy(*self.names).agg(F.max_by("v", order).alias("new"), F.lit(True).alias("is_new"))
        if few and self.ndim:
            old = self.df.join(F.broadcast(last), self.names, "left").select(*self.names, F.when(F.col("is_new"), F.col("new")).otherwise(F.col("v")).alias("v"))
            there = self.df.join(F.broadcast(last.select(*self.names)), self.names, "left_semi").select(*self.names)  # as few at most
            return replace(self, df=old.unionByName(last.join(F.broadcast(there), self.names, "left_anti").select(*self.names, F.col("new").alias("v"))))
        df = self.df.join(last, self.names, "full").select(*self.names, F.when(F.col("is_new"), F.col("new")).otherwise(F.col("v")).alias("v"))
        return replace(self, df=df)

    def resize(self, dims: Sequence[int]) -> ArrayFrame:
        """Another shape within the maximum: cells outside go, new ones have the fill value."""
        if self.chunk is None:
            raise GridError("only a chunked array can be resized")
        extents = self.extents.resized(dims)
        p = Selection.slab(*[slice(0, min(d, old)) for d, old in zip(dims, self.shape)]).predicate(self.shape, self.names)
        return replace(self, df=self.df if p is None else self.df.where(p), extents=extents)

    # Chunks

    def chunk_key(self) -> list[Column]:
        if self.chunk is None:
            raise GridError("not chunked")
        return [F.floor(F.col(n) / c).cast("bigint").alias(f"c{k}") for k, (n, c) in enumerate(zip(self.names, self.chunk))]

    def num_chunks(self) -> int:
        return num_chunks(self.shape, self.chunk or ())

    def chunk_stats(self) -> DataFrame:
        """Count, least and greatest value of each chunk; one partial aggregation."""
        return self.df.groupBy(*self.chunk_key()).agg(F.count("*").alias("n"), F.min("v").alias("v_min"), F.max("v").alias("v_max"))

    def chunk_info(self) -> DataFrame:
        """Each chunk of the grid: its number in row-major order, offset and stored bytes (whole chunks)."""
        counts = [max(ceil(d / c), 1) for d, c in zip(self.shape, self.chunk or ())]
        df = self._spark().range(prod(counts)).withColumnRenamed("id", "index")
        at = [(F.floor(F.col("index") / s) % n * c).cast("bigint").alias(f"offset{k}") for k, (s, n, c) in enumerate(zip(strides(counts), counts, self.chunk))]
        return df.select("index", *at, F.lit(prod(self.chunk) * self.type.size).cast("bigint").alias("bytes"), F.lit(0).alias("filter_mask"))


def _overlap(df: DataFrame, n: str, a: Axis) -> DataFrame:
    """Blocks that overlap name a cell several times; each place it has is one row."""
    at = F.col(n) - a.start
    first = F.greatest(F.lit(0), F.ceil((at - a.block + 1) / a.step))
    last = F.least(F.lit(a.count - 1), F.floor(at / a.step))
    places = F.transform(F.sequence(first.cast("bigint"), last.cast("bigint")), lambda i: i * a.block + at - i * a.step)
    return df.withColumn(n, F.explode(F.when(first <= last, places)))


def num_chunks(shape: Iterable[int], chunk: Iterable[int]) -> int:
    return prod(max(ceil(d / c), 1) for d, c in zip(shape, chunk))


def auto_chunk(shape: Sequence[int], item: int, target: int) -> tuple[int, ...]:
    """The shape with its largest axis (the last of equals) halved, rounding up, until a chunk is within target bytes."""
    dims = [max(d, 1) for d in shape]
    while prod(dims) * item > target and max(dims) > 1:
        k = max(range(len(dims)), key=lambda i: (dims[i], i))
        dims[k] = -(-dims[k] // 2)
    return tuple(dims)


def choose_layout(extents: Extents, item: int, *, chunk: tuple[int, ...] | None = None, no_chunk: bool = False, min_kb: int | None = None, filters: bool = False) -> tuple[int, ...] | None:
    """The chunk shape that a new array gets; None for contiguous."""
    movable = filters or (extents.is_simple and any(not a.is_fixed for a in extents.axes))
    if not extents.is_simple:
        if chunk is not None or filters:
            raise GridError("a scalar or null array has no chunks")
        return None
    if no_chunk:
        if movable:
            raise GridError("a filtered or resizable array must be chunked")
        return None
    if chunk is not None:
        if len(chunk) != extents.ndim or min(chunk) < 1 or any(m is not None and c > max(m, 1) for c, m in zip(chunk, extents.maxdims)):
            raise GridError(f"chunk {chunk} does not fit {extents}")
        return tuple(chunk)
    if min_kb is not None:
        return auto_chunk(extents.dims, item, min_kb * 1024)
    return tuple(max(d, 1) for d in extents.dims) if movable else None
