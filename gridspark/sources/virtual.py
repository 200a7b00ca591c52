"""Stored selections and the mappings of virtual datasets."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from ..errors import FormatError
from ..functions.codecs import lookup3
from ..selection import Selection, Slice
from .store import Cursor

_UNLIMITED = (1 << 64) - 1


@dataclass(frozen=True)
class StoredMapping:
    file: str  # "." is the same file
    dataset: str
    source: Selection
    target: Selection


def selection(c: Cursor) -> Selection:
    kind, version = c.u32(), c.u32()
    if kind == 0:
        c.skip(8)
        return Selection.none()
    if kind == 3:
        c.skip(8)
        return Selection.all()
    if kind == 1:
        if version == 1:
            c.skip(8)
            width = 4
        else:
            width = c.u8()
        rank = c.u32()
        n = c.uint(width) if version > 1 else c.u32()
        return Selection.points([[c.uint(width) for _ in range(rank)] for _ in range(n)])
    if kind != 2:
        raise FormatError(f"selection kind {kind}")
    if version == 1:
        c.skip(8)
        rank, n = c.u32(), c.u32()
        boxes = [([c.u32() for _ in range(rank)], [c.u32() for _ in range(rank)]) for _ in range(n)]
        return _boxes(boxes)
    flags = c.u8()
    width = c.u8() if version >= 3 else 8
    if version == 2:
        c.skip(4)
    rank = c.u32()
    if flags & 1:
        slices = []
        top = (1 << 8 * width) - 1
        for _ in range(rank):
            start, step, count, block = (c.uint(width) for _ in range(4))
            slices.append(Slice(start, max(step, 1), count=None if count in (top, _UNLIMITED) else count, block=block if block not in (top, _UNLIMITED) else 1))
        return Selection.slab(*slices)
    n = c.uint(width)
    return _boxes([([c.uint(width) for _ in range(rank)], [c.uint(width) for _ in range(rank)]) for _ in range(n)])


def _boxes(boxes) -> Selection:
    """Blocks by their corners: one block is a slab; several are points, in row-major order."""
    if len(boxes) == 1:
        lo, hi = boxes[0]
        return Selection.slab(*[Slice(a, 1, count=b - a + 1) for a, b in zip(lo, hi)])
    from itertools import product

    return Selection.points(sorted({p for lo, hi in boxes for p in product(*(range(a, b + 1) for a, b in zip(lo, hi)))}))


def decode(blob: bytes) -> list[StoredMapping]:
    c = Cursor(blob)
    version, n = c.u8(), c.u64()
    out: list[StoredMapping] = []
    for _ in range(n):
        flags = c.u8() if version else 0
        if version and flags & 4:
            file = "."
        elif version and flags & 1:
            file = out[c.u64()].file
        else:
            file = c.text()
        dataset = out[c.u64()].dataset if version and flags & 2 else c.text()
        out.append(StoredMapping(file, dataset, selection(c), selection(c)))
    return out


def encode_selection(s: Selection, dims) -> bytes:
    if s.kind in ("none", "all"):
        return struct.pack("<4I", 0 if s.kind == "none" else 3, 1, 0, 0)
    if s.kind == "points":
        raise FormatError("point selections are not written")
    axes = s.axes(dims)
    return struct.pack("<IIBII", 2, 2, 1, 0, len(axes)) + b"".join(struct.pack("<4Q", a.start, a.step, a.count, a.block) for a in axes)


def encode(mappings: list[tuple[StoredMapping, tuple, tuple]]) -> bytes:
    """mappings with the shapes of their source and target."""
    out = struct.pack("<BQ", 0, len(mappings))
    for m, source_dims, dims in mappings:
        out += m.file.encode() + b"\0" + m.dataset.encode() + b"\0" + encode_selection(m.source, source_dims) + encode_selection(m.target, dims)
    return out + struct.pack("<I", lookup3(out))
