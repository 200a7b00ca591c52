"""Dataspaces: null, scalar, or a current and a maximum size for each axis."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from math import prod

from .errors import SelectionError

MAX_RANK = 32
UNLIMITED = None


@dataclass(frozen=True)
class Extent:
    dim: int
    max: int | None  # None: unlimited

    def __post_init__(self):
        if self.dim < 0 or (self.max is not None and self.max < self.dim):
            raise SelectionError(f"bad extent {self.dim}..={self.max}")

    @property
    def is_fixed(self) -> bool:
        return self.max == self.dim

    @property
    def is_unlimited(self) -> bool:
        return self.max is None

    def __str__(self) -> str:
        return str(self.dim) if self.is_fixed else f"{self.dim}.." if self.max is None else f"{self.dim}..={self.max}"


@dataclass(frozen=True)
class Extents:
    """axes is None for the null dataspace, which has no element, and empty for a scalar, which has one."""

    axes: tuple[Extent, ...] | None

    def __post_init__(self):
        if self.axes is not None and len(self.axes) > MAX_RANK:
            raise SelectionError(f"rank {len(self.axes)} is above {MAX_RANK}")

    @classmethod
    def null(cls) -> Extents:
        return cls(None)

    @classmethod
    def scalar(cls) -> Extents:
        return cls(())

    @classmethod
    def of(cls, shape: int | Iterable) -> Extents:
        """From sizes; an axis may be (size, max) with max None for unlimited, a range, or an Extent."""
        out = []
        for a in [shape] if isinstance(shape, int) else shape:
            out.append(a if isinstance(a, Extent) else Extent(*a) if isinstance(a, tuple) else Extent(a, a))
        return cls(tuple(out))

    @classmethod
    def resizable(cls, shape: Iterable[int]) -> Extents:
        return cls(tuple(Extent(d, None) for d in shape))

    @property
    def is_null(self) -> bool:
        return self.axes is None

    @property
    def is_scalar(self) -> bool:
        return self.axes == ()

    @property
    def is_simple(self) -> bool:
        return bool(self.axes)

    @property
    def dims(self) -> tuple[int, ...]:
        return tuple(a.dim for a in self.axes or ())

    @property
    def maxdims(self) -> tuple[int | None, ...]:
        return tuple(a.max for a in self.axes or ())

    @property
    def ndim(self) -> int:
        return len(self.axes or ())

    @property
    def size(self) -> int:
        return 0 if self.is_null else prod(self.dims)

    @property
    def is_resizable(self) -> bool:
        """Some axis can grow. Null and scalar spaces say so too, having no axis that is fixed."""
        return not self.axes or any(not a.is_fixed for a in self.axes)

    @property
    def is_unlimited(self) -> bool:
        return any(a.is_unlimited for a in self.axes or ())

    def resized(self, dims: Iterable[int]) -> Extents:
        dims = tuple(dims)
        if self.axes is None or len(dims) != len(self.axes):
            raise SelectionError(f"cannot resize {self} to {dims}")
        if any(a.max is not None and d > a.max for d, a in zip(dims, self.axes)):
            raise SelectionError(f"{dims} exceeds {self}")
        return Extents(tuple(Extent(d, a.max) for d, a in zip(dims, self.axes)))

    def __str__(self) -> str:
        if self.axes is None:
            return "null"
        return "(" + ", ".join(map(str, self.axes)) + ("," if len(self.axes) == 1 else "") + ")" if self.axes else "scalar"


def strides(dims: Iterable[int]) -> tuple[int, ...]:
    """Row-major strides in elements."""
    out, at = [], 1
    for d in reversed(tuple(dims)):
        out.append(at)
        at *= d
    return tuple(reversed(out))
