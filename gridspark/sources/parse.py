"""Reads the headers of a container: a tree of groups, datasets, committed types and attributes. Element bytes are not read.

An object that cannot be read becomes `unsupported` with the reason; the others stay readable.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, prod
from typing import Any

import numpy as np

from .. import types as G
from ..errors import FormatError, LinkError
from ..extents import MAX_RANK, Extent, Extents
from ..functions.codecs import Filter, Pipeline
from . import datatypes as D
from .store import Cursor, Ranges

# Fixed values of the format.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
UNDEFINED = (1 << 64) - 1
DATASPACE, LINK_INFO, DATATYPE, OLD_FILL, FILL, LINK, LAYOUT, GROUP_INFO, PIPELINE, ATTRIBUTE, COMMENT, OLD_MTIME, SHARED_TABLE, CONTINUATION, SYMBOL_TABLE, MTIME, ATTR_INFO = (
    1, 2, 3, 4, 5, 6, 8, 10, 11, 12, 13, 14, 15, 16, 17, 18, 21,
)
MAX_BYTES, MAX_ATTRIBUTE = 1 << 36, 1 << 33


@dataclass
class Link:
    name: str
    kind: str  # hard, soft, external
    child: int | None = None
    path: str | None = None
    file: str | None = None
    order: int = 0


@dataclass
class Attribute:
    name: str
    type: G.Type
    extents: Extents
    value: Any


@dataclass
class ChunkRef:
    offset: tuple[int, ...]  # of its first cell
    address: int
    bytes: int
    mask: int = 0


@dataclass
class Object:
    address: int
    kind: str = "group"
    links: list[Link] = field(default_factory=list)
    attrs: list[Attribute] = field(default_factory=list)
    comment: str | None = None
    mtime: int | None = None
    reason: str | None = None
    # Datasets
    type: G.Type | None = None
    dtype: np.dtype | None = None
    extents: Extents | None = None
    layout: str | None = None  # compact, contiguous, chunked, virtual
    data: bytes | None = None  # of a compact one
    address_of_data: int = UNDEFINED
    chunk: tuple[int, ...] | None = None
    chunks: list[ChunkRef] | None = None
    pipeline: Pipeline = field(default_factory=Pipeline)
    fill: bytes | None = None
    mappings: list | None = None


class Container:
    """A parsed file. Objects are numbered by the address of their header."""

    def __init__(self, path: str):
        self.path, self.io = path, Ranges(path)
        self.objects: dict[int, Object] = {}
        self._heaps: dict[int, dict[int, bytes]] = {}
        self.userblock = self._find()
        self.io.base = self.userblock
        self.root = self._superblock()
        self._load(self.root)

    def close(self) -> None:
        self.io.close()

    def __enter__(self) -> Container:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _find(self) -> int:
        at = 0
        while at + 8 <= self.io.size:
            if self.io.at(at, 8) == SIGNATURE:
                return at
            at = at * 2 or 512
        raise FormatError(f"{self.path} is no container")

    def _superblock(self) -> int:
        version = self.io.at(8, 1)[0]
        if version < 2:
            c = Cursor(self.io.at(0, 128 if self.io.size - self.userblock >= 128 else self.io.size - self.userblock), 13)
            sizes = c.u8(), c.u8()
            c.skip(1 + 4 + 4 + (4 if version == 1 else 0) + 32 + 8)
            root = c.u64()
        elif version <= 3:
            c = Cursor(self.io.at(9, 39))
            sizes = c.u8(), c.u8()
            c.skip(1 + 24)
            root = c.u64()
        else:
            raise FormatError(f"superblock version {version}")
        if sizes != (8, 8):
            raise FormatError("only 8-byte offsets and lengths")
        return root

    # Objects

    def _load(self, root: int) -> None:
        todo = [root]
        while todo:
            address = todo.pop()
            if address in self.objects:
                continue
            obj = Object(address)
            self.objects[address] = obj
            try:
                self._object(obj)
            except (FormatError, struct.error, IndexError, ValueError, OverflowError, KeyError, RecursionError) as e:
                self.objects[address] = Object(address, "unsupported", reason=str(e) or type(e).__name__)
                continue
            todo += [x.child for x in obj.links if x.kind == "hard"]

    def messages(self, address: int) -> Iterator[tuple[int, int, bytes]]:
        """(type, flags, body) of an object header."""
        if self.io.at(address, 4) == b"OHDR":
            c = Cursor(self.io.at(address, min(64, self.io.size - self.io.base - address)), 5)
            flags = c.u8()
            c.skip((16 if flags & 32 else 0) + (4 if flags & 16 else 0))
            size = c.uint(1 << (flags & 3))
            blocks, head, seen = [(address + c.pos, size)], 4 + (2 if flags & 4 else 0), set()
            if flags & 32:
                yield MTIME, 0, bytes([1, 0, 0, 0]) + self.io.at(address + 10, 4)
            while blocks:
                at, n = blocks.pop(0)
                if at in seen:
                    raise FormatError("header blocks in a circle")
                seen.add(at)
                c = Cursor(self.io.at(at, n))
                while c.left >= head:
                    kind, length, mflags = c.u8(), c.u16(), c.u8()
                    c.skip(head - 4)
                    body = c.take(length)
                    if kind == CONTINUATION:
                        where, k = struct.unpack("<QQ", body[:16])
                        blocks.append((where + 4, k - 8))
                    else:
                        yield kind, mflags, body
            return
        c = Cursor(self.io.at(address, 16))
        if c.u8() != 1:
            raise FormatError("no object header")
        c.skip(1)
        count = c.u16()
        c.skip(4)
        blocks, seen = [(address + 16, c.u32())], set()
        while blocks and count > 0:
            at, n = blocks.pop(0)
            if at in seen:
                raise FormatError("header blocks in a circle")
            seen.add(at)
            c = Cursor(self.io.at(at, n))
            while c.left >= 8 and count > 0:
                kind, length, mflags = c.u16(), c.u16(), c.u8()
                c.skip(3)
                body, count = c.take(length), count - 1
                if kind == CONTINUATION:
                    blocks.append(struct.unpack("<QQ", body[:16]))
                else:
                    yield kind, mflags, body

    def _shared(self, body: bytes, kind: int) -> bytes:
        """The message that a shared one points to: in another header, or in a heap of shared messages."""
        version, where = body[0], body[1]
        if version == 3 and where == 1:
            raise FormatError("shared message heap is not read")
        address = struct.unpack("<Q", body[8:16] if version == 1 else body[2:10])[0]
        for k, flags, b in self.messages(address):
            if k == kind:
                return b
        raise FormatError("a shared message leads nowhere")

    def _object(self, o: Object) -> None:
        space = kind = layout = fill = None
        attr_info = link_info = None
        for number, flags, body in self.messages(o.address):
            if flags & 2 and number not in (ATTRIBUTE,):
                body = self._shared(body, number)
            if number == DATASPACE:
                space = dataspace(Cursor(body))
            elif number == DATATYPE:
                kind = D.parse(Cursor(body))
            elif number == LAYOUT:
                layout = body
            elif number == FILL:
                fill = self._fill(body)
            elif number == OLD_FILL and fill is None:
                n = struct.unpack("<I", body[:4])[0]
                fill = body[4 : 4 + n] if n else None
            elif number == PIPELINE:
                o.pipeline = pipeline(Cursor(body))
            elif number == SYMBOL_TABLE:
                o.links += self._symbol_table(*struct.unpack("<QQ", body[:16]))
            elif number == LINK:
                o.links.append(link(Cursor(body)))
            elif number == LINK_INFO:
                link_info = body
            elif number == ATTR_INFO:
                attr_info = body
            elif number == ATTRIBUTE:
                o.attrs.append(self._attribute(body))
            elif number == COMMENT:
                o.comment = Cursor(body).text()
            elif number == MTIME:
                o.mtime = struct.unpack("<I", body[4:8])[0]
        if link_info is not None:
            c = Cursor(link_info, 1)
            flags = c.u8()
            c.skip(8 if flags & 1 else 0)
            heap, tree = c.u64(), c.u64()
            if heap != UNDEFINED:
                h = FractalHeap(self.io, heap)
                o.links += [link(Cursor(h.get(r[4:]))) for r in btree2(self.io, tree)]
        if attr_info is not None:
            c = Cursor(attr_info, 1)
            flags = c.u8()
            c.skip(2 if flags & 1 else 0)
            heap, tree = c.u64(), c.u64()
            if heap != UNDEFINED:
                h = FractalHeap(self.io, heap)
                found = [(struct.unpack("<I", r[9:13])[0], self._attribute(h.get(r[:8]))) for r in btree2(self.io, tree)]
                o.attrs += [a for _, a in sorted(found, key=lambda x: x[0])]
        if layout is not None:
            if kind is None or space is None:
                raise FormatError("a dataset without type or space")
            o.kind, o.extents, o.fill, (o.type, o.dtype) = "dataset", space, fill, kind
            if space.size * o.dtype.itemsize > MAX_BYTES:
                raise FormatError("a dataset is too large")
            self._layout(o, Cursor(layout))
        elif kind is not None:
            o.kind, (o.type, o.dtype) = "type", kind

    def _fill(self, body: bytes) -> bytes | None:
        c = Cursor(body)
        version = c.u8()
        if version < 3:
            c.skip(2)
            defined = c.u8()
            n = c.u32() if version == 1 or defined else 0
            return c.take(n) if n and n < 1 << 31 else None
        flags = c.u8()
        return c.take(c.u32()) if flags & 32 else None

    # Groups

    def _symbol_table(self, tree: int, heap: int) -> list[Link]:
        c = Cursor(self.io.at(heap, 32))
        if c.take(4) != b"HEAP":
            raise FormatError("no local heap")
        c.skip(4)
        size, _, start = c.u64(), c.u64(), c.u64()
        names = self.io.at(start, size)
        out: list[Link] = []
        for node in self._group_nodes(tree):
            c = Cursor(self.io.at(node, 8))
            if c.take(4) != b"SNOD":
                raise FormatError("no symbol node")
            c.skip(2)
            n = c.u16()
            c = Cursor(self.io.at(node + 8, 40 * n))
            for _ in range(n):
                name, header, cache = c.u64(), c.u64(), c.u32()
                c.skip(4)
                scratch = c.take(16)
                text = Cursor(names, name).text()
                if cache == 2:
                    out.append(Link(text, "soft", path=Cursor(names, struct.unpack("<I", scratch[:4])[0]).text(), order=len(out)))
                else:
                    out.append(Link(text, "hard", child=header, order=len(out)))
        return out

    def _group_nodes(self, tree: int, depth: int = 0) -> Iterator[int]:
        if depth > 32:
            raise FormatError("a tree is too deep")
        c = Cursor(self.io.at(tree, 24))
        if c.take(4) != b"TREE":
            raise FormatError("no tree node")
        c.skip(1)
        level, n = c.u8(), c.u16()
        c = Cursor(self.io.at(tree + 24, 16 * n + 8))
        for _ in range(n):
            c.skip(8)
            child = c.u64()
            if level:
                yield from self._group_nodes(child, depth + 1)
            else:
                yield child

    # Attributes

    def _attribute(self, body: bytes) -> Attribute:
        c = Cursor(body)
        version, flags = c.u8(), c.u8()
        sizes = c.u16(), c.u16(), c.u16()
        if version == 3:
            c.skip(1)
        pad = (lambda n: n + -n % 8) if version == 1 else (lambda n: n)
        name = Cursor(c.take(pad(sizes[0]))).text()
        kind, space = c.take(pad(sizes[1])), c.take(pad(sizes[2]))
        if version > 1 and flags & 1:
            kind = self._shared(kind, DATATYPE)
        if version > 1 and flags & 2:
            space = self._shared(space, DATASPACE)
        t, d = D.parse(Cursor(kind))
        extents = dataspace(Cursor(space))
        if extents.size * d.itemsize > MAX_ATTRIBUTE:
            raise FormatError("an attribute is too large")
        raw = np.frombuffer(c.take(extents.size * d.itemsize), d.base if d.subdtype else d)
        raw = raw.reshape((extents.size, *d.shape)) if d.subdtype else raw
        if D.is_plain(t):
            values = raw.tolist()
        else:
            values = [D.to_python(x, t, self.payload) for x in raw]
        return Attribute(name, t, extents, None if extents.is_null else values[0] if extents.is_scalar else values)

    def payload(self, slot: bytes, item: G.Type | None) -> Any:
        n, address, index = struct.unpack("<IQI", slot)
        if item is None:
            return "" if not n else self.heap_object(address, index)[:n].rstrip(b"\0").decode("utf-8", "replace")
        if not n:
            return []
        raw = np.frombuffer(self.heap_object(address, index), D.stored(item), n)
        return raw.tolist() if D.is_plain(item) else [D.to_python(x, item, self.payload) for x in raw]

    def heap_object(self, address: int, index: int) -> bytes:
        if address not in self._heaps:
            if len(self._heaps) > 256:
                self._heaps.clear()
            c = Cursor(self.io.at(address, 16))
            if c.take(4) != b"GCOL":
                raise FormatError("no global heap")
            c.skip(4)
            data, found = Cursor(self.io.at(address, c.u64()), 16), {}
            while data.left >= 16:
                number = data.u16()
                data.skip(6)
                n = data.u64()
                if not number:
                    break
                found[number] = data.take(n)
                data.skip(min(-n % 8, data.left))
            self._heaps[address] = found
        if index not in self._heaps[address]:
            raise FormatError("a heap object is missing")
        return self._heaps[address][index]

    # Layouts

    def _layout(self, o: Object, c: Cursor) -> None:
        version = c.u8()
        if version in (1, 2):
            rank, kind = c.u8(), c.u8()
            c.skip(5)
            address = c.u64() if kind else UNDEFINED
            dims = [c.u32() for _ in range(rank)]
            if kind == 0:
                o.layout, o.data = "compact", c.take(c.u32())
            elif kind == 1:
                o.layout, o.address_of_data = "contiguous", address
            else:
                o.layout, o.chunk = "chunked", tuple(dims[:-1])
                self._tree_chunks(o, address)
            return
        if version not in (3, 4, 5):
            raise FormatError(f"layout version {version}")
        kind = c.u8()
        if kind == 0:
            o.layout, o.data = "compact", c.take(c.u16())
        elif kind == 1:
            o.layout, o.address_of_data = "contiguous", c.u64()
        elif kind == 2 and version == 3:
            rank, address = c.u8(), c.u64()
            o.layout, o.chunk = "chunked", tuple(c.u32() for _ in range(rank))[:-1]
            self._tree_chunks(o, address)
        elif kind == 2:
            self._indexed(o, c)
        elif kind == 3:
            o.layout = "virtual"
            address, index = c.u64(), c.u32()
            from .virtual import decode

            o.mappings = decode(self.heap_object(address, index)) if address != UNDEFINED else []
        else:
            raise FormatError(f"layout class {kind}")

    def _chunk_bytes(self, o: Object) -> int:
        return prod(o.chunk) * o.dtype.itemsize

    def _tree_chunks(self, o: Object, address: int) -> None:
        o.chunks, rank = [], len(o.chunk)
        key = 8 + 8 * (rank + 1)

        def walk(at: int, depth: int) -> None:
            if depth > 32:
                raise FormatError("a tree is too deep")
            c = Cursor(self.io.at(at, 24))
            if c.take(4) != b"TREE" or c.u8() != 1:
                raise FormatError("no chunk tree")
            level, n = c.u8(), c.u16()
            c = Cursor(self.io.at(at + 24, n * (key + 8) + key))
            for _ in range(n):
                size, mask = c.u32(), c.u32()
                offset = tuple(c.u64() for _ in range(rank))
                c.skip(8)
                child = c.u64()
                if level:
                    walk(child, depth + 1)
                else:
                    o.chunks.append(ChunkRef(offset, child, size, mask))

        if address != UNDEFINED:
            walk(address, 0)

    def _grid(self, o: Object, dims=None) -> list[tuple[int, ...]]:
        counts = [max(ceil(d / c), 1) for d, c in zip(dims or o.extents.dims, o.chunk)]
        return [tuple(int(i) * c for i, c in zip(at, o.chunk)) for at in np.ndindex(*counts)]

    def _indexed(self, o: Object, c: Cursor) -> None:
        flags, rank, width = c.u8(), c.u8(), c.u8()
        o.layout, o.chunk = "chunked", tuple(c.uint(width) for _ in range(rank))[:-1]
        kind, whole, filtered = c.u8(), self._chunk_bytes(o), bool(o.pipeline.filters)
        if kind == 1:  # a single chunk
            size, mask = (c.u64(), c.u32()) if flags & 2 else (whole, 0)
            address = c.u64()
            o.chunks = [] if address == UNDEFINED else [ChunkRef((0,) * len(o.chunk), address, size, mask)]
            return
        if kind == 2:  # chunks of one size, one after another
            address = c.u64()
            o.chunks = [] if address == UNDEFINED else [ChunkRef(at, address + i * whole, whole) for i, at in enumerate(self._grid(o))]
            return
        if kind == 3:
            c.skip(1)
            address = c.u64()
            elements = [] if address == UNDEFINED else fixed_array(self.io, address, whole, filtered)
            o.chunks = [ChunkRef(at, *e) for at, e in zip(self._grid(o), elements) if e[0] != UNDEFINED]
            return
        if kind == 4:
            c.skip(5)
            address = c.u64()
            growing = [k for k, m in enumerate(o.extents.maxdims) if m is None]
            # The unlimited axis comes first in the order of chunks.
            k = growing[0] if growing else 0
            counts = [max(ceil(d / n), 1) for d, n in zip(o.extents.maxdims[:k] + (o.extents.dims[k],) + o.extents.maxdims[k + 1 :], o.chunk)]
            order = [k, *[i for i in range(len(counts)) if i != k]]
            elements = [] if address == UNDEFINED else extensible_array(self.io, address, whole, filtered)
            o.chunks = []
            for at, e in zip(np.ndindex(*[counts[i] for i in order]), elements):
                offset = tuple(at[order.index(i)] * o.chunk[i] for i in range(len(counts)))
                if e[0] != UNDEFINED and all(x < d for x, d in zip(offset, o.extents.dims)):
                    o.chunks.append(ChunkRef(offset, *e))
            return
        if kind == 5:
            c.skip(6)
            address, o.chunks = c.u64(), []
            for r in btree2(self.io, address) if address != UNDEFINED else ():
                k = Cursor(r)
                at, size, mask = k.u64(), whole, 0
                rest = len(r) - 8 - 8 * len(o.chunk)
                if rest:
                    size, mask = k.uint(rest - 4), k.u32()
                o.chunks.append(ChunkRef(tuple(k.u64() * n for n in o.chunk), at, size, mask))
            return
        raise FormatError(f"chunk index {kind}")

    # Paths

    def resolve(self, path: str, depth: int = 0) -> Object:
        from ..operators.catalog import MAX_INDIRECTIONS, parts

        at = self.objects[self.root]
        for k, name in enumerate(ns := parts(path)):
            found = next((x for x in at.links if x.name == name), None)
            if found is None:
                raise LinkError(f"no {name!r} in {path!r}")
            if found.kind == "hard":
                at = self.objects[found.child]
                continue
            if depth >= MAX_INDIRECTIONS:
                raise LinkError(f"too many links in {path!r}")
            rest = "/".join([found.path, *ns[k + 1 :]])
            if found.kind == "soft":
                return self.resolve(rest, depth + 1)
            raise ExternalLink(found.file, rest)
        return at

    def paths(self) -> dict[int, str]:
        """First path of each object, breadth first."""
        out, todo = {self.root: "/"}, [self.root]
        while todo:
            nxt = []
            for a in todo:
                for x in self.objects[a].links:
                    if x.kind == "hard" and x.child not in out:
                        out[x.child] = out[a].rstrip("/") + "/" + x.name
                        nxt.append(x.child)
            todo = nxt
        return out


class ExternalLink(LinkError):
    """A path that goes on in another file."""

    def __init__(self, file: str, path: str):
        super().__init__(f"{path!r} is in {file!r}")
        self.file, self.path = file, path


def dataspace(c: Cursor) -> Extents:
    version, rank, flags = c.u8(), c.u8(), c.u8()
    if version == 1:
        c.skip(5)
        kind = 1 if rank else 0
    elif version == 2:
        kind = c.u8()
    else:
        raise FormatError(f"dataspace version {version}")
    if rank > MAX_RANK:
        raise FormatError("rank is too high")
    if kind == 2:
        return Extents.null()
    dims = [c.u64() for _ in range(rank)]
    most = [c.u64() for _ in range(rank)] if flags & 1 else dims
    return Extents(tuple(Extent(d, None if m == UNDEFINED else m) for d, m in zip(dims, most)))


def link(c: Cursor) -> Link:
    if c.u8() != 1:
        raise FormatError("link version")
    flags = c.u8()
    kind = c.u8() if flags & 8 else 0
    order = c.u64() if flags & 4 else 0
    c.skip(1 if flags & 16 else 0)
    name = c.take(c.uint(1 << (flags & 3))).decode("utf-8", "replace")
    if kind == 0:
        return Link(name, "hard", child=c.u64(), order=order)
    value = c.take(c.u16())
    if kind == 1:
        return Link(name, "soft", path=value.decode("utf-8", "replace"), order=order)
    if kind == 64:
        v = Cursor(value, 1)
        return Link(name, "external", file=v.text(), path=v.text(), order=order)
    raise FormatError(f"link kind {kind}")


def pipeline(c: Cursor) -> Pipeline:
    version, n = c.u8(), c.u8()
    if version == 1:
        c.skip(6)
    out = []
    for _ in range(n):
        number = c.u16()
        named = c.u16() if version == 1 or number >= 256 else 0
        flags, k = c.u16(), c.u16()
        c.skip(named + (-named % 8 if version == 1 else 0))
        params = [c.u32() for _ in range(k)]
        if version == 1 and k % 2:
            c.skip(4)
        out.append(Filter.from_id(number, params, bool(flags & 1)))
    return Pipeline(tuple(out))


# Trees, heaps and arrays of the newer layouts


def btree2(io: Ranges, address: int) -> Iterator[bytes]:
    """All records of a version 2 tree, in order."""
    c = Cursor(io.at(address, 38))
    if c.take(4) != b"BTHD":
        raise FormatError("no version 2 tree")
    c.skip(2)
    node, record, depth = c.u32(), c.u16(), c.u16()
    c.skip(2)
    root, n = c.u64(), c.u16()
    width = lambda x: max(1, (x.bit_length() + 7) // 8)
    most = [(node - 10) // record]
    totals = [most[0]]
    for d in range(1, depth + 1):
        pointer = 8 + width(most[0]) + (width(totals[d - 1]) if d > 1 else 0)
        most.append((node - 10 - pointer) // (record + pointer))
        totals.append(most[d] + (most[d] + 1) * totals[d - 1])

    def walk(at: int, n: int, d: int) -> Iterator[bytes]:
        c = Cursor(io.at(at, node))
        if c.take(4) != (b"BTIN" if d else b"BTLF"):
            raise FormatError("no tree node")
        c.skip(2)
        records = [c.take(record) for _ in range(n)]
        if not d:
            yield from records
            return
        for k in range(n + 1):
            child, m = c.u64(), c.uint(width(most[0]))
            c.skip(width(totals[d - 1]) if d > 1 else 0)
            yield from walk(child, m, d - 1)
            if k < n:
                yield records[k]

    if root != UNDEFINED and n:
        yield from walk(root, n, depth)


class FractalHeap:
    """Objects by heap id: in the id itself, in blocks of a doubling table, or on their own."""

    def __init__(self, io: Ranges, address: int):
        self.io = io
        c = Cursor(io.at(address, min(256, io.size - io.base - address)))
        if c.take(4) != b"FRHP":
            raise FormatError("no fractal heap")
        c.skip(1)
        self.id_length, filters = c.u16(), c.u16()
        self.flags, self.managed = c.u8(), c.u32()
        c.skip(8)
        self.huge = c.u64()
        c.skip(8 * 10)
        self.width, self.start, self.direct, bits = c.u16(), c.u64(), c.u64(), c.u16()
        c.skip(2)
        self.root, self.rows = c.u64(), c.u16()
        self.pipeline, self.root_size, self.root_mask = Pipeline(), 0, 0
        if filters:
            self.root_size, self.root_mask = c.u64(), c.u32()
            self.pipeline = pipeline(Cursor(c.take(filters)))
        self.offset_bytes = (bits + 7) // 8
        self.length_bytes = max(1, (min(self.direct, self.managed).bit_length() + 7) // 8)

    def row_size(self, row: int) -> int:
        return self.start << max(row - 1, 0)

    def get(self, heap_id: bytes) -> bytes:
        kind = heap_id[0] >> 4 & 3
        if kind == 2:
            n = (heap_id[0] & 15) + 1
            return heap_id[1 : 1 + n]
        if kind == 1:
            if self.pipeline.filters:
                raise FormatError("filtered large heap objects")
            if self.id_length >= 17 and not self.huge_indirect:
                address, n = struct.unpack("<QQ", heap_id[1:17])
                return self.io.at(address, n)
            key = int.from_bytes(heap_id[1 : self.id_length], "little")
            for r in btree2(self.io, self.huge):
                address, n, number = struct.unpack("<QQQ", r[:24])
                if number == key:
                    return self.io.at(address, n)
            raise FormatError("a large heap object is missing")
        at = int.from_bytes(heap_id[1 : 1 + self.offset_bytes], "little")
        n = int.from_bytes(heap_id[1 + self.offset_bytes : 1 + self.offset_bytes + self.length_bytes], "little")
        block, inner = self._block(at)
        return block[inner : inner + n]

    @property
    def huge_indirect(self) -> bool:
        return self.huge != UNDEFINED

    def _read(self, address: int, size: int, stored: int, mask: int) -> bytes:
        raw = self.io.at(address, stored or size)
        return self.pipeline.decode(raw, 1, mask) if self.pipeline.filters else raw

    def _block(self, at: int) -> tuple[bytes, int]:
        """The block that holds heap offset at, and the place within it."""
        if not self.rows:
            return self._read(self.root, self.start, self.root_size, self.root_mask), at
        return self._inside(self.root, self.rows, at)

    def _inside(self, address: int, rows: int, at: int) -> tuple[bytes, int]:
        direct_rows = (self.direct // self.start).bit_length() + 1
        entry = 8 + (12 if self.pipeline.filters else 0)
        c = Cursor(self.io.at(address, 13 + self.offset_bytes + self.width * (min(rows, direct_rows) * entry + max(rows - direct_rows, 0) * 8)), 13 + self.offset_bytes)
        begin = 0
        for row in range(rows):
            size = self.row_size(row)
            for _ in range(self.width):
                child = c.u64()
                stored, mask = (c.u64(), c.u32()) if self.pipeline.filters and row < direct_rows else (0, 0)
                if begin <= at < begin + size:
                    if child == UNDEFINED:
                        raise FormatError("a heap block is missing")
                    if row < direct_rows:
                        return self._read(child, size, stored, mask), at - begin
                    return self._inside(child, (size // (self.start * self.width)).bit_length(), at - begin)
                begin += size
        raise FormatError("a heap offset is too large")


def _element(c: Cursor, width: int, whole: int, filtered: bool) -> tuple[int, int, int]:
    return (c.u64(), c.uint(width - 12), c.u32()) if filtered else (c.u64(), whole, 0)


def fixed_array(io: Ranges, address: int, whole: int, filtered: bool) -> list[tuple[int, int, int]]:
    c = Cursor(io.at(address, 28))
    if c.take(4) != b"FAHD":
        raise FormatError("no fixed array")
    c.skip(2)
    width, page_bits, n, data = c.u8(), c.u8(), c.u64(), c.u64()
    if data == UNDEFINED:
        return []
    page = 1 << page_bits
    if n <= page:
        c = Cursor(io.at(data + 14, n * width))
        return [_element(c, width, whole, filtered) for _ in range(n)]
    pages = -(-n // page)
    used = io.at(data + 14, (pages + 7) // 8)
    at, out = data + 14 + (pages + 7) // 8 + 4, []
    for k in range(pages):
        m = min(page, n - k * page)
        if used[k // 8] >> (7 - k % 8) & 1:
            c = Cursor(io.at(at, m * width))
            out += [_element(c, width, whole, filtered) for _ in range(m)]
        else:
            out += [(UNDEFINED, 0, 0)] * m
        at += m * width + 4
    return out


def extensible_array(io: Ranges, address: int, whole: int, filtered: bool) -> Iterator[tuple[int, int, int]]:
    """Elements in order: those in the index block, then data blocks, directly and under super blocks."""
    c = Cursor(io.at(address, 72))
    if c.take(4) != b"EAHD":
        raise FormatError("no extensible array")
    c.skip(2)
    width, bits, in_index, least, pointers, page_bits = (c.u8() for _ in range(6))
    c.skip(8 * 4)
    n = c.u64()
    c.skip(8)
    index = c.u64()
    if index == UNDEFINED:
        return
    offset_bytes, page, nothing = (bits + 7) // 8, 1 << page_bits, (UNDEFINED, 0, 0)
    blocks = lambda s: 1 << (s // 2)  # noqa: E731  data blocks of super block s
    sizes = lambda s: least << ((s + 1) // 2)  # noqa: E731  elements of each
    supers = 0
    while pointers and blocks(supers) < pointers:
        supers += 1
    in_super, s, count = 2 * (pointers.bit_length() - 1), 0, 0
    direct = []
    for s in range(in_super):
        direct += [sizes(s)] * blocks(s)
    c = Cursor(io.at(index, min(io.size - io.base - index, 14 + in_index * width + 8 * (len(direct) + 64))), 14)
    for _ in range(in_index):
        yield _element(c, width, whole, filtered)
        count += 1

    def data_block(at: int, m: int, used: bytes | None, first_page: int) -> Iterator[tuple[int, int, int]]:
        if at == UNDEFINED:
            yield from [nothing] * m
            return
        head = 14 + offset_bytes
        if m <= page:
            d = Cursor(io.at(at + head, m * width))
            for _ in range(m):
                yield _element(d, width, whole, filtered)
            return
        place = at + head + 4
        for k in range(m // page):
            bit = first_page + k
            if used is None or used[bit // 8] >> (7 - bit % 8) & 1:
                d = Cursor(io.at(place, page * width))
                for _ in range(page):
                    yield _element(d, width, whole, filtered)
            else:
                yield from [nothing] * page
            place += page * width + 4

    for m in direct:
        if count >= n:
            return
        yield from data_block(c.u64(), m, None, 0)
        count += m
    s = in_super
    while count < n and c.left >= 8:
        at, k, m = c.u64(), blocks(s), sizes(s)
        if at == UNDEFINED:
            yield from [nothing] * (k * m)
        else:
            pages = m // page if m > page else 0
            bitmap = (pages + 7) // 8 * k if pages else 0
            b = Cursor(io.at(at + 14 + offset_bytes, bitmap + 8 * k))
            used = b.take(bitmap) if bitmap else None
            for i in range(k):
                mine = used[i * (bitmap // k) : (i + 1) * (bitmap // k)] if used else None
                yield from data_block(b.u64(), m, mine, 0)
        count, s = count + k * m, s + 1
