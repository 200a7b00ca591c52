"""Selections of cells: everything, nothing, points, or a hyperslab of slices and indices.

A hyperslab is a predicate on the coordinate columns d0, d1, ... (range conjuncts first, which reach
a Parquet scan, then the stride), and new coordinates are arithmetic. Only overlapping blocks and points, which may repeat
cells, are joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import SelectionError


@dataclass(frozen=True)
class Index:
    """One coordinate; the axis goes."""

    at: int

    def __str__(self) -> str:
        return str(self.at)


@dataclass(frozen=True)
class Slice:
    """start, step, block and either end (exclusive; None: the axis's size) or count."""

    start: int = 0
    step: int = 1
    end: int | None = None
    count: int | None = None
    block: int = 1

    def __post_init__(self):
        if self.start < 0 or self.step < 1 or self.block < 1 or (self.end or 0) < 0 or (self.count or 0) < 0:
            raise SelectionError("starts and ends must not be negative, steps and blocks not below 1")

    @property
    def is_unlimited(self) -> bool:
        return self.end is None and self.count is None

    def __str__(self) -> str:
        to = f"+{self.count}" if self.count is not None else ".." if self.end is None else f"..{self.end}"
        text = (f"{self.start}" if self.start or self.count is not None else "0" if self.end is not None else "") + to
        if self.is_unlimited:
            text += "∞"
        tail = f";{self.step}" if self.step != 1 or self.block != 1 else ""
        return text + tail + (f"(Bx{self.block})" if self.block != 1 else "")


@dataclass(frozen=True)
class Axis:
    """A slice resolved against an axis's size."""

    start: int
    step: int
    count: int
    block: int
    drop: bool = False

    @property
    def length(self) -> int:
        return self.count * self.block

    @property
    def overlaps(self) -> bool:
        return self.step < self.block and self.count > 1

    @property
    def stop(self) -> int:
        return self.start + (self.count - 1) * self.step + self.block if self.count else self.start

    def coordinates(self) -> list[int]:
        return [self.start + i * self.step + j for i in range(self.count) for j in range(self.block)]

    def predicate(self, d: Column) -> Column:
        """True for the selected coordinates. The count bound is part of it: with blocks, a last partial block is out."""
        if not self.count:
            return F.lit(False)
        if self.length == 1:
            return d == self.start
        p = (d >= self.start) & (d < self.stop)
        if self.step > self.block:
            p = p & ((d - self.start) % self.step < self.block)
        return p

    def renumber(self, d: Column) -> Column:
        if self.step == 1 or self.step == self.block:
            return d - self.start if self.start else d
        at = d - self.start
        q = F.floor(at / self.step) if self.block == 1 else None
        return q if q is not None else F.floor(at / self.step) * self.block + at % self.step


Item = Index | Slice


def _resolve(item: Item, dim: int) -> Axis:
    if isinstance(item, Index):
        if not 0 <= item.at < dim:
            raise SelectionError(f"index {item.at} is outside an axis of {dim}")
        return Axis(item.at, 1, 1, 1, drop=True)
    if item.count is not None:
        if item.count and item.start + (item.block - 1) + item.step * (item.count - 1) >= dim:
            raise SelectionError(f"{item} exceeds an axis of {dim}")
        return Axis(item.start, item.step, item.count, item.block)
    end = dim if item.end is None else item.end
    if item.start > dim or end > dim:
        raise SelectionError(f"{item} exceeds an axis of {dim}")
    return Axis(item.start, item.step, len(range(item.start + item.block - 1, end, item.step)), item.block)


@dataclass(frozen=True)
class Selection:
    """kind: all, none, slab or points."""

    kind: str
    items: tuple[Item, ...] = ()
    coords: tuple[tuple[int, ...], ...] = ()

    @classmethod
    def all(cls) -> Selection:
        return cls("all")

    @classmethod
    def none(cls) -> Selection:
        return cls("none")

    @classmethod
    def points(cls, coords: Sequence[Sequence[int]]) -> Selection:
        coords = tuple(tuple(int(x) for x in ([c] if isinstance(c, int) else c)) for c in coords)
        if len({len(c) for c in coords}) > 1 or any(x < 0 for c in coords for x in c):
            raise SelectionError("points must have one rank and no negative coordinate")
        return cls("points", coords=coords)

    @classmethod
    def slab(cls, *items) -> Selection:
        """From ints, Python slices, Index, Slice and one Ellipsis (kept until the rank is known)."""
        out = []
        for x in items:
            if isinstance(x, int) and not isinstance(x, bool):
                if x < 0:
                    raise SelectionError("negative index")
                x = Index(x)
            elif isinstance(x, slice):
                if any(v is not None and v < 0 for v in (x.start, x.stop, x.step)):
                    raise SelectionError("negative slice")
                x = Slice(x.start or 0, 1 if x.step is None else x.step, x.stop)
            elif not (isinstance(x, (Index, Slice)) or x is Ellipsis):
                raise SelectionError(f"not a slice or index: {x!r}")
            out.append(x)
        if sum(x is Ellipsis for x in out) > 1:
            raise SelectionError("only one ellipsis")
        return cls("slab", tuple(out))

    @classmethod
    def of(cls, what) -> Selection:
        if isinstance(what, Selection):
            return what
        if what is None or what is Ellipsis:
            return cls.all()
        return cls.slab(*what) if isinstance(what, tuple) else cls.slab(what)

    def axes(self, dims: Sequence[int]) -> list[Axis]:
        """One resolved axis per dimension, for all, none and slabs."""
        if self.kind == "all":
            return [Axis(0, 1, d, 1) for d in dims]
        if self.kind == "none":
            return [Axis(0, 1, 0, 1) for _ in dims]
        if self.kind == "points":
            raise SelectionError("points have no axes")
        items = list(self.items)
        if Ellipsis in items:
            k = items.index(Ellipsis)
            items[k : k + 1] = [Slice()] * (len(dims) - len(items) + 1)
        if len(items) != len(dims):
            raise SelectionError(f"{len(items)} slices for rank {len(dims)}")
        return [_resolve(i, d) for i, d in zip(items, dims)]

    def simplified(self, dims: Sequence[int]) -> Selection:
        """all or none where the slab amounts to that."""
        if self.kind == "slab":
            axes = self.axes(dims)
            if any(a.length == 0 for a in axes):
                return Selection.none()
            if all(a.length == d and not a.drop and not a.overlaps for a, d in zip(axes, dims)):
                return Selection.all()
        return self

    def out_shape(self, dims: Sequence[int]) -> tuple[int, ...]:
        if self.kind == "points":
            self.check_points(dims)
            return (len(self.coords),)
        if self.kind == "none":
            return (0,)
        return tuple(a.length for a in self.axes(dims) if not a.drop)

    def size(self, dims: Sequence[int]) -> int:
        return prod(self.out_shape(dims))

    def check_points(self, dims: Sequence[int]) -> None:
        for c in self.coords:
            if len(c) != len(dims) or any(x >= d for x, d in zip(c, dims)):
                raise SelectionError(f"point {c} is outside {tuple(dims)}")

    def with_block(self, axis: int, block: int) -> Selection:
        return self._change(axis, block=block)

    def with_unlimited(self, axis: int) -> Selection:
        return self._change(axis, end=None, count=None)

    def _change(self, axis: int, **what) -> Selection:
        if self.kind != "slab" or not isinstance(self.items[axis], Slice):
            raise SelectionError("only a slice has a block and an end")
        items = list(self.items)
        items[axis] = replace(items[axis], **what)
        return Selection("slab", tuple(items))

    def predicate(self, dims: Sequence[int], names: Sequence[str]) -> Column | None:
        """None where every cell is selected."""
        s = self.simplified(dims)
        if s.kind == "all":
            return None
        if s.kind == "none":
            return F.lit(False)
        parts = [a.predicate(F.col(n)) for a, n, d in zip(s.axes(dims), names, dims) if a.length != d or a.drop]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def linear_indices(self, dims: Sequence[int], clip: bool = False) -> list[int]:
        """Row-major positions in order; with clip, cells of a stored selection beyond the space are left out."""
        from itertools import product

        from .extents import strides

        st = strides(dims)
        if self.kind == "points":
            cells = list(self.coords)
        else:
            axes = self.axes(dims) if not clip else [a if isinstance(a, Axis) else _loose(a, d) for a, d in zip(self.items or [Slice()] * len(dims), dims)]
            cells = product(*(a.coordinates() for a in axes)) if self.kind != "none" else ()
        return [sum(x * s for x, s in zip(c, st)) for c in cells if not clip or all(x < d for x, d in zip(c, dims))]

    def __str__(self) -> str:
        if self.kind == "all":
            return ".."
        if self.kind == "none":
            return "none"
        if self.kind == "points":
            return f"points ({len(self.coords)})"
        return "(" + ", ".join("..." if i is Ellipsis else str(i) for i in self.items) + ("," if len(self.items) == 1 else "") + ")"


def _loose(item: Item, dim: int) -> Axis:
    if isinstance(item, Index):
        return Axis(item.at, 1, 1, 1, drop=True)
    if item.count is not None:
        return Axis(item.start, item.step, item.count, item.block)
    end = dim if item.end is None else item.end
    return Axis(item.start, item.step, len(range(item.start + item.block - 1, end, item.step)), item.block)


class _Builder:
    """s_[2:20:3, 0, ...] makes a selection."""

    def __getitem__(self, what) -> Selection:
        return Selection.of(what)


s_ = _Builder()
