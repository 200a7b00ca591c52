"""Writes a container in one pass: element bytes go out as they come, headers follow at the end, and the first bytes are set last.

Arrays of any size come from Spark: tasks gather cells by chunk, pack and filter them; the driver appends one chunk
after another (one partition in memory at a time) and keeps only their addresses.
"""

from __future__ import annotations

import os
import struct
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from math import prod
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .. import types as G
from ..errors import FormatError, GridError, LinkError
from ..extents import Extents, strides
from ..functions.codecs import Filter, Pipeline, lookup3
from ..operators.array import ArrayFrame, choose_layout
from ..operators.catalog import parts
from . import datatypes as D
from .parse import ATTR_INFO, ATTRIBUTE, COMMENT, DATASPACE, DATATYPE, FILL, GROUP_INFO, LAYOUT, LINK, LINK_INFO, MTIME, PIPELINE, SIGNATURE, SYMBOL_TABLE, UNDEFINED
from .virtual import StoredMapping, encode as encode_mappings

LEAF_K, INTERNAL_K, CHUNK_K = 4, 16, 32
HEAP_BYTES, HEAP_OBJECTS, MESSAGE_BYTES = 1 << 20, 60_000, 65_500


@dataclass
class _Node:
    kind: str
    links: dict[str, tuple] = field(default_factory=dict)  # name to (hard, node) | (soft, path) | (external, file, path)
    messages: list[tuple[int, bytes]] = field(default_factory=list)
    attrs: list[tuple[str, G.Type, Extents, Any]] = field(default_factory=list)
    comment: str | None = None
    address: int | None = None
    references: int = 1


class ContainerWriter:
    """mode w replaces a file, x refuses one. `with ContainerWriter(path) as w: w.dataset("/g/d", values)`."""

    def __init__(self, path: str, mode: str = "w", userblock: bytes = b""):
        if mode not in ("w", "x"):
            raise GridError(f"mode {mode!r}")
        if len(userblock) and (len(userblock) < 512 or len(userblock) & (len(userblock) - 1)):
            raise GridError("a userblock is a power of two of at least 512 bytes")
        if mode == "x" and os.path.exists(path):
            raise FileExistsError(path)
        self.path, self.part = path, f"{path}.part-{os.getpid()}"
        self.file, self.base = open(self.part, "wb"), len(userblock)
        self.file.write(userblock + bytes(96))
        self.end, self.root, self.heap = 96, _Node("group"), []
        self.heap_size = 0
        self.patches: list[tuple[int, int]] = []

    def __enter__(self) -> ContainerWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()
        else:
            self.file.close()
            os.unlink(self.part)

    def _put(self, data: bytes, align: int = 8) -> int:
        pad = -self.end % align
        self.file.write(bytes(pad) + data)
        at = self.end + pad
        self.end = at + len(data)
        return at

    # The tree

    def _find(self, path: str, make: bool = False) -> _Node:
        at = self.root
        for name in parts(path):
            if name not in at.links:
                if not make:
                    raise LinkError(f"no {name!r} in {path!r}")
                at.links[name] = ("hard", _Node("group"))
            link = at.links[name]
            at = link[1] if link[0] == "hard" else self._find(link[1]) if link[0] == "soft" else None
            if at is None or (make and at.kind != "group"):
                raise LinkError(f"{name!r} in {path!r} is no group here")
        return at

    def _add(self, path: str, link: tuple) -> None:
        *head, name = parts(path) or [""]
        if not name:
            raise LinkError("an empty name")
        parent = self._find("/".join(head), make=True)
        if name in parent.links:
            raise LinkError(f"{path!r} exists")
        parent.links[name] = link

    def group(self, path: str) -> None:
        self._add(path, ("hard", _Node("group")))

    def soft(self, path: str, target: str) -> None:
        self._add(path, ("soft", target))

    def external(self, path: str, file: str, target: str) -> None:
        self._add(path, ("external", file, target))

    def hard(self, path: str, target: str) -> None:
        node = self._find(target)
        self._add(path, ("hard", node))
        node.references += 1

    def unlink(self, path: str) -> None:
        *head, name = parts(path)
        parent = self._find("/".join(head))
        if name not in parent.links:
            raise LinkError(f"no {path!r}")
        link = parent.links.pop(name)
        if link[0] == "hard":
            link[1].references -= 1

    def comment(self, path: str, text: str) -> None:
        self._find(path).comment = text

    def named_type(self, path: str, t: G.Type) -> None:
        self._add(path, ("hard", _Node("type", messages=[(DATATYPE, D.encode(t))])))

    def attr(self, path: str, name: str, value: Any, type: G.Type | None = None, extents: Extents | None = None) -> None:
        node = self._find(path)
        if any(a[0] == name for a in node.attrs):
            raise GridError(f"attribute {name!r} exists")
        t, extents, value = _described(value, type, extents)
        node.attrs.append((name, t, extents, value))

    def relink(self, old: str, new: str) -> None:
        """Moves a link. The new place is made first, so a failure leaves the old one."""
        *head, name = parts(old)
        parent = self._find("/".join(head))
        if name not in parent.links:
            raise LinkError(f"no {old!r}")
        self._add(new, parent.links[name])
        del parent.links[name]

    def take_over(self, old) -> None:
        """All objects of a parsed container, with their stored bytes as they are; only elements of variable length are written anew."""
        made: dict[int, _Node] = {}

        def node_of(address: int) -> _Node:
            if address in made:
                made[address].references += 1
                return made[address]
            o = old.objects[address]
            if o.kind == "unsupported":
                raise FormatError(f"an object cannot be taken over: {o.reason}")
            node = made[address] = _Node(o.kind, comment=o.comment)
            for a in o.attrs:
                value = a.value if not a.extents.is_scalar else [a.value]
                node.attrs.append((a.name, a.type, a.extents, value if a.value is not None else []))
            if o.kind == "type":
                node.messages = [(DATATYPE, D.encode(o.type))]
            elif o.kind == "dataset":
                self._take_dataset(old, o, node)
            for x in o.links:
                node.links[x.name] = ("hard", node_of(x.child)) if x.kind == "hard" else ("soft", x.path) if x.kind == "soft" else ("external", x.file, x.path)
            return node

        self.root = node_of(old.root)

    def _take_dataset(self, old, o, node: _Node) -> None:
        from .h5 import boxes_of, elements, plan_of

        same = o.dtype == D.stored(o.type) and not o.type.has_vlen
        fill = o.fill if o.fill and same else b""
        bits = (o.dtype.metadata or {}).get("precision") if same else None
        node.messages = [(DATASPACE, space_message(o.extents)), (DATATYPE, D.encode(o.type, bits)), (FILL, struct.pack("<4B", 2, 3 if o.pipeline.filters else 2, 0, 1) + struct.pack("<I", len(fill)) + fill)]
        if o.pipeline.filters:
            node.messages.append((PIPELINE, pipeline_message(o.pipeline)))
        if o.layout == "virtual":
            raise FormatError("a virtual dataset is not taken over: make it again")
        plan = plan_of(old, o)
        found = []
        for box in boxes_of(o, old, [(0, d - 1) for d in plan.dims]):
            at, shape, address, stored, mask = box
            if o.layout == "chunked":
                if address == UNDEFINED:
                    continue
                if same and not mask:
                    packed = old.io.at(address, stored)
                else:
                    packed = o.pipeline.encode(self._again(old, o, elements(plan, old, *box)), o.type.size)
                found.append((at, self._put(packed), len(packed)))
            elif o.layout == "compact" or address != UNDEFINED:
                raw = self._again(old, o, elements(plan, old, *box))
                place = self._put(raw, 8 if not found else 1)
                found.append((at, place, len(raw)))
        if o.layout == "chunked":
            self._chunk_layout(node, o.type, o.chunk, found, o.extents)
        else:
            node.messages.append((LAYOUT, struct.pack("<BBQQ", 3, 1, found[0][1] if found else UNDEFINED, o.extents.size * o.type.size)))

    def _again(self, old, o, values: np.ndarray) -> bytes:
        if not o.type.has_vlen:
            return values.astype(D.stored(o.type)).tobytes() if values.dtype.names is None and D.stored(o.type).subdtype is None else values.tobytes()
        flat = values.reshape(-1)
        return self._with_addresses(b"".join(self._element(D.to_python(x, o.type, old.payload), o.type) for x in flat), o.type)

    # Elements

    def _heap_slot(self, data: bytes, n: int) -> bytes:
        if not n:
            return bytes(16)
        if len(self.heap) >= HEAP_OBJECTS or self.heap_size + len(data) > HEAP_BYTES and self.heap:
            self._flush_heap()
        self.heap.append(data)
        self.heap_size += len(data) + 24
        # A collection's place is known before it is filled: it is reserved by the address table.
        return struct.pack("<IQI", n, self._heap_address(), len(self.heap))

    def _heap_address(self) -> int:
        if not hasattr(self, "_heap_file"):
            self._heap_file: list[bytes] = []
        return 1 << 62 | len(self._heap_file)

    def _flush_heap(self) -> None:
        out = bytearray()
        for i, data in enumerate(self.heap, 1):
            out += struct.pack("<HHIQ", i, 1, 0, len(data)) + data + bytes(-len(data) % 8)
        size = max(4096, 16 + len(out) + 16)
        free = size - 16 - len(out)
        out += struct.pack("<HHIQ", 0, 0, 0, free) + bytes(free - 16)
        self._heap_file.append(b"GCOL" + bytes([1, 0, 0, 0]) + struct.pack("<Q", size) + bytes(out))
        self.heap, self.heap_size = [], 0

    def encode(self, values: Any, t: G.Type) -> bytes:
        """Stored bytes of elements. Slots of variable length hold a mark that `_placed` turns into an address."""
        if isinstance(values, np.ndarray) and values.dtype != object and (D.is_plain(t) or isinstance(t, (G.Boolean, G.Unsigned))):
            return values.astype(D.stored(t)).tobytes()
        flat = list(values.reshape(-1)) if isinstance(values, np.ndarray) else values
        return b"".join(self._element(x, t) for x in flat)

    def _element(self, x: Any, t: G.Type) -> bytes:
        if isinstance(t, G.VarLenString):
            raw = ("" if x is None else str(x)).encode()
            if b"\0" in raw:
                raise FormatError("a string with a zero inside")
            return self._heap_slot(raw, len(raw))
        if isinstance(t, G.VarLenArray):
            x = [] if x is None else list(x)
            return self._heap_slot(self._placed(b"".join(self._element(y, t.item) for y in x)), len(x)) if not t.item.has_vlen else self._nested()
        if isinstance(t, G.FixedString):
            return (x if isinstance(x, bytes) else ("" if x is None else str(x)).encode())[: t.bytes].ljust(t.bytes, b"\0")
        if isinstance(t, G.FixedArray):
            x = list(x)
            if len(x) != t.length:
                raise FormatError(f"{len(x)} items for {t}")
            return b"".join(self._element(y, t.item) for y in x)
        if isinstance(t, G.Compound):
            out = bytearray(t.size)
            for f in t.fields:
                v = x[f.name] if not isinstance(x, (tuple, list)) else x[[g.name for g in t.fields].index(f.name)]
                raw = self._element(v, f.type)
                out[f.offset : f.offset + len(raw)] = raw
            return bytes(out)
        if isinstance(t, G.Opaque):
            return bytes(x or b"").ljust(t.bytes, b"\0")[: t.bytes]
        return np.array(0 if x is None else int(x) if not isinstance(t, G.Float) else float(x)).astype(D.stored(t)).tobytes()

    def _nested(self) -> bytes:
        raise FormatError("arrays of variable length within one another are not written")

    def _placed(self, raw: bytes) -> bytes:
        return raw

    def _with_addresses(self, raw: bytes, t: G.Type) -> bytes:
        """Writes the collections that are due, and puts their addresses into the slots of raw."""
        if not t.has_vlen:
            return raw
        if self.heap:
            self._flush_heap()
        at = [self._put(c) for c in self._heap_file]
        self._heap_file = []
        out = bytearray(raw)
        for place in _slots(t, len(raw) // t.size):
            mark = struct.unpack_from("<Q", out, place + 4)[0]
            if mark >> 62:
                struct.pack_into("<Q", out, place + 4, at[mark & (1 << 62) - 1])
        return bytes(out)

    # Datasets

    def dataset(self, path: str, values: Any = None, *, type: G.Type | None = None, shape: Sequence[int] | None = None, maxshape: Sequence[int | None] | None = None, chunk: tuple[int, ...] | None = None, filters: Sequence[Filter] = (), fill: Any = None, compact: bool = False) -> None:
        """A dataset of driver-sized values; without values it is all fill."""
        if values is None and type is None:
            raise GridError("a dataset needs values or a type")
        extents = None if shape is None else Extents.of(zip(shape, maxshape)) if maxshape else Extents.of(shape)
        if values is not None:
            type, found, values = _described(values, type, None)
            extents = extents or (Extents.of(zip(found.dims, maxshape)) if maxshape else found)
            if extents.dims != found.dims:
                raise GridError(f"shape {found.dims} is not {extents.dims}")
        extents = extents or Extents.scalar()
        chunk = choose_layout(extents, type.size, chunk=chunk, filters=bool(filters))
        pipe = lowered(filters, type, prod(chunk) if chunk else 0)
        node = self._dataset_node(type, extents, fill, pipe, path)
        if chunk is None:
            raw = b"" if values is None else self._with_addresses(self.encode(values, type), type)
            if compact and len(raw) <= MESSAGE_BYTES and values is not None:
                node.messages.append((LAYOUT, struct.pack("<BBH", 3, 0, len(raw)) + raw))
            else:
                at = self._put(raw) if raw else UNDEFINED
                node.messages.append((LAYOUT, struct.pack("<BBQQ", 3, 1, at, extents.size * type.size)))
            return
        found: list[tuple] = []
        if values is not None and extents.size:
            a = np.asarray(values).reshape(extents.dims) if D.is_plain(type) or isinstance(type, (G.Boolean, G.Unsigned)) else _objects(values, extents.dims)
            for at in np.ndindex(*[-(-d // c) for d, c in zip(extents.dims, chunk)]):
                origin = tuple(i * c for i, c in zip(at, chunk))
                part = a[tuple(slice(o, o + c) for o, c in zip(origin, chunk))]
                if part.shape != tuple(chunk):
                    whole = np.zeros(chunk, part.dtype) if part.dtype != object else np.full(chunk, _zero(type), object)
                    whole[tuple(slice(0, n) for n in part.shape)] = part
                    part = whole
                raw = self._with_addresses(self.encode(part, type), type)
                packed = pipe.encode(raw, type.size)
                found.append((origin, self._put(packed), len(packed)))
        self._chunk_layout(node, type, chunk, found, extents)

    def _dataset_node(self, t: G.Type, extents: Extents, fill: Any, pipe: Pipeline, path: str) -> _Node:
        node = _Node("dataset")
        body = b"" if fill is None else self.encode([fill], t)
        if t.has_vlen and body:
            raise FormatError("a fill value of variable length is not written")
        alloc = 3 if pipe.filters else 2
        bits = next((f.params[6] for f in pipe.filters if f.name == "nbit"), None)
        node.messages = [(DATASPACE, space_message(extents)), (DATATYPE, D.encode(t, bits)), (FILL, struct.pack("<4B", 2, alloc, 0, 1) + struct.pack("<I", len(body)) + body)]
        if pipe.filters:
            node.messages.append((PIPELINE, pipeline_message(pipe)))
        self._add(path, ("hard", node))
        return node

    def _chunk_layout(self, node: _Node, t: G.Type, chunk: Sequence[int], found: list[tuple], extents: Extents) -> None:
        rank = len(chunk)
        address = self._chunk_tree(sorted(found), chunk, t.size) if found else UNDEFINED
        node.messages.append((LAYOUT, struct.pack("<BBBQ", 3, 2, rank + 1, address) + struct.pack(f"<{rank + 1}I", *chunk, t.size)))

    def _chunk_tree(self, found: list[tuple], chunk: Sequence[int], item: int) -> int:
        rank = len(chunk)
        key = lambda origin, size: struct.pack("<II", size, 0) + struct.pack(f"<{rank + 1}Q", *origin, 0)
        last = (tuple(o + c for o, c in zip(found[-1][0], chunk)), 0)
        rows = [((o, n), a) for o, a, n in found]
        level = 0
        while True:
            nodes = []
            groups = [rows[i : i + 2 * CHUNK_K] for i in range(0, len(rows), 2 * CHUNK_K)]
            width = 24 + 2 * CHUNK_K * (len(key(*last)) + 8) + len(key(*last))
            first = self.end + -self.end % 8
            place = [first + i * (width + -width % 8) for i in range(len(groups))]
            for i, g in enumerate(groups):
                left, right = place[i - 1] if i else UNDEFINED, place[i + 1] if i + 1 < len(groups) else UNDEFINED
                body = b"TREE" + struct.pack("<BBHQQ", 1, level, len(g), left, right)
                body += b"".join(key(*k) + struct.pack("<Q", a) for k, a in g)
                body += key(*(groups[i + 1][0][0] if i + 1 < len(groups) else last))
                at = self._put(body.ljust(width, b"\0"))
                assert at == place[i]
                nodes.append((g[0][0], at))
            if len(nodes) == 1:
                return nodes[0][1]
            rows, level = nodes, level + 1

    def array(self, path: str, a: ArrayFrame, *, chunk: tuple[int, ...] | None = None, filters: Sequence[Filter] = ()) -> None:
        """An ArrayFrame as a chunked dataset. Chunks are made by tasks; only chunks that hold cells are stored."""
        if a.type.has_vlen:
            raise FormatError("an ArrayFrame of variable-length elements: cast it to a fixed type first")
        chunk = chunk or a.chunk or choose_layout(a.extents, a.type.size, min_kb=1024)
        if not a.ndim:
            self.dataset(path, a.scalar(), type=a.type)
            return
        pipe = lowered(filters, a.type, prod(chunk))
        node = self._dataset_node(a.type, a.extents, a.fill, pipe, path)
        found = []
        for row in chunk_blobs(a, chunk, pipe).toLocalIterator(prefetchPartitions=False):
            found.append((tuple(row[f"c{k}"] * c for k, c in enumerate(chunk)), self._put(bytes(row["blob"])), len(row["blob"])))
        self._chunk_layout(node, a.type, chunk, found, a.extents)

    def virtual(self, path: str, type: G.Type, shape: Sequence[int], mappings: Sequence[tuple[StoredMapping, tuple]], fill: Any = None) -> None:
        """mappings with the shapes of their sources."""
        extents = Extents.of(shape)
        node = self._dataset_node(type, extents, fill, Pipeline(), path)
        blob = encode_mappings([(m, dims, extents.dims) for m, dims in mappings])
        self._heap_address()
        self.heap.append(blob)
        self._flush_heap()
        at = self._put(self._heap_file.pop())
        node.messages.append((LAYOUT, struct.pack("<BBQI", 4, 3, at, 1)))

    # Headers

    def close(self) -> None:
        root = self._write(self.root, set())
        tree, heap = self.root_table
        now = struct.pack("<QQII", 0, root, 1 if tree else 0, 0) + (struct.pack("<QQ", tree, heap) if tree else bytes(16))
        head = SIGNATURE + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", LEAF_K, INTERNAL_K, 0) + struct.pack("<4Q", self.base, UNDEFINED, self.base + self.end, UNDEFINED) + now
        self.file.seek(self.base)
        self.file.write(head)
        self.file.close()
        os.replace(self.part, self.path)

    def _write(self, node: _Node, above: set[int]) -> int:
        if node.address is not None:
            return node.address
        if id(node) in above:
            raise LinkError("hard links in a circle")
        above = above | {id(node)}
        messages = list(node.messages)
        if node.kind == "group":
            table = self._group(node, above)
            messages += table[0]
            if node is self.root:
                self.root_table = table[1]
        messages.append((MTIME, struct.pack("<B3xI", 1, int(time.time()))))
        if node.comment:
            messages.append((COMMENT, node.comment.encode() + b"\0"))
        attrs = [(a[0], self._attr_message(*a)) for a in node.attrs]
        if any(len(m) > MESSAGE_BYTES for _, m in attrs):
            messages.append((ATTR_INFO, self._dense_attrs(attrs)))
        else:
            messages += [(ATTRIBUTE, m) for _, m in attrs]
        body = b""
        for kind, m in messages:
            m += bytes(-len(m) % 8)
            if len(m) > MESSAGE_BYTES:
                raise FormatError("a message is larger than 64 KB")
            body += struct.pack("<HHB3x", kind, len(m), 0) + m
        node.address = self._put(struct.pack("<BxHII4x", 1, len(messages), node.references, len(body)) + body)
        return node.address

    def _attr_message(self, name: str, t: G.Type, extents: Extents, value: Any) -> bytes:
        values = [] if extents.is_null else value
        raw = self._with_addresses(self.encode(values, t), t)
        fields = [name.encode() + b"\0", D.encode(t), space_message(extents)]
        out = struct.pack("<BxHHH", 1, *map(len, fields))
        return out + b"".join(f + bytes(-len(f) % 8) for f in fields) + raw

    def _dense_attrs(self, attrs: list[tuple[str, bytes]]) -> bytes:
        """Attributes outside the header: each is an object of a heap on its own, found by a tree of heap numbers and named by a tree of name hashes."""
        objects = [struct.pack("<QQQ", self._put(m), len(m), k) for k, (_, m) in enumerate(attrs, 1)]
        names = sorted((lookup3(n.encode()), k) for k, (n, _) in enumerate(attrs, 1))
        of_name = [struct.pack("<B", 0x10) + k.to_bytes(7, "little") + struct.pack("<BII", 0, k - 1, h) for h, k in names]
        head = b"FRHP" + struct.pack("<BHHBI", 0, 8, 0, 0, 4096) + struct.pack("<QQ", len(attrs) + 1, self._tree2(1, objects))
        head += struct.pack("<QQ", 0, UNDEFINED) + struct.pack("<8Q", 0, 0, 0, 0, sum(len(m) for _, m in attrs), len(attrs), 0, 0)
        head += struct.pack("<HQQHHQH", 4, 512, 65536, 40, 1, UNDEFINED, 0)
        heap = self._put(head + struct.pack("<I", lookup3(head)))
        return struct.pack("<BBQQ", 0, 0, heap, self._tree2(8, of_name))

    def _tree2(self, kind: int, records: list[bytes]) -> int:
        """A version 2 tree of one leaf."""
        size = max(512, 1 << (10 + len(records) * len(records[0]) - 1).bit_length())
        leaf = b"BTLF" + struct.pack("<BB", 0, kind) + b"".join(records)
        at = self._put((leaf + struct.pack("<I", lookup3(leaf))).ljust(size, b"\0"))
        head = b"BTHD" + struct.pack("<BBIHHBBQHQ", 0, kind, size, len(records[0]), 0, 100, 40, at, len(records), len(records))
        return self._put(head + struct.pack("<I", lookup3(head)))

    def _group(self, node: _Node, above: set[int]) -> tuple[list, tuple[int, int]]:
        links = {n: (("hard", self._write(x[1], above)) if x[0] == "hard" else x) for n, x in node.links.items()}
        if any(x[0] == "external" for x in links.values()):
            out = [(LINK_INFO, struct.pack("<BBQQ", 0, 0, UNDEFINED, UNDEFINED)), (GROUP_INFO, bytes([0, 0]))]
            return out + [(LINK, link_message(n, x, k)) for k, (n, x) in enumerate(links.items())], (0, 0)
        names, texts = bytearray(8), {}

        def place(s: str) -> int:
            if s not in texts:
                texts[s] = len(names)
                raw = s.encode() + b"\0"
                names.extend(raw + bytes(-len(raw) % 8))
            return texts[s]

        entries = []
        for n in sorted(links, key=str.encode):
            x = links[n]
            if x[0] == "hard":
                entries.append((place(n), struct.pack("<QQII16x", place(n), x[1], 0, 0)))
            else:
                entries.append((place(n), struct.pack("<QQIII12x", place(n), UNDEFINED, 2, 0, place(x[1]))))
        rows = []
        for i in range(0, len(entries), 2 * LEAF_K):
            part = entries[i : i + 2 * LEAF_K]
            body = b"SNOD" + struct.pack("<BxH", 1, len(part)) + b"".join(e for _, e in part)
            rows.append((part[-1][0], self._put(body.ljust(8 + 40 * 2 * LEAF_K, b"\0"))))
        level, width = 0, 24 + 8 * (4 * INTERNAL_K + 1)
        while True:
            nodes, groups = [], [rows[i : i + 2 * INTERNAL_K] for i in range(0, len(rows), 2 * INTERNAL_K)] or [[]]
            before = 0
            first = self.end + -self.end % 8
            for i, g in enumerate(groups):
                step = width + -width % 8
                left, right = first + (i - 1) * step if i else UNDEFINED, first + (i + 1) * step if i + 1 < len(groups) else UNDEFINED
                body = b"TREE" + struct.pack("<BBHQQQ", 0, level, len(g), left, right, before)
                for last, at in g:
                    body += struct.pack("<QQ", at, last)
                    before = last
                nodes.append((g[-1][0] if g else 0, self._put(body.ljust(width, b"\0"))))
            if len(nodes) == 1:
                break
            rows, level = nodes, level + 1
        data = self._put(bytes(names))
        heap = self._put(b"HEAP" + bytes(4) + struct.pack("<QQQ", len(names), 1, data))
        return [(SYMBOL_TABLE, struct.pack("<QQ", nodes[0][1], heap))], (nodes[0][1], heap)


def _slots(t: G.Type, n: int, base: int = 0) -> list[int]:
    """Places of variable-length slots in n elements."""
    if isinstance(t, (G.VarLenString, G.VarLenArray)):
        return [base + i * 16 for i in range(n)]
    if isinstance(t, G.FixedArray):
        return _slots(t.item, n * t.length, base)
    if isinstance(t, G.Compound):
        inner = [p for f in t.fields if f.type.has_vlen for p in _slots(f.type, 1, f.offset)]
        return [base + i * t.size + p for i in range(n) for p in inner]
    return []


def _zero(t: G.Type) -> Any:
    if isinstance(t, (G.VarLenString, G.FixedString)):
        return ""
    if isinstance(t, G.VarLenArray):
        return ()
    if isinstance(t, G.FixedArray):
        return (_zero(t.item),) * t.length
    return {f.name: _zero(f.type) for f in t.fields} if isinstance(t, G.Compound) else 0


def _objects(values: Any, dims: tuple[int, ...]) -> np.ndarray:
    flat = values.reshape(-1) if isinstance(values, np.ndarray) else values
    out = np.empty(prod(dims), object)
    for i, x in enumerate(flat):
        out[i] = x
    return out.reshape(dims)


def _described(values: Any, t: G.Type | None, extents: Extents | None) -> tuple[G.Type, Extents, Any]:
    """Type, space and flat values of what a caller gave."""
    if isinstance(values, np.ndarray) and values.dtype != object and values.dtype.kind in "iufb":
        found = G.BOOL if values.dtype.kind == "b" else {"i": G.Integer, "u": G.Unsigned, "f": G.Float}[values.dtype.kind](values.dtype.itemsize)
        return t or found, extents or Extents.of(values.shape), values
    if isinstance(values, np.ndarray):
        return t or _guess(values.reshape(-1)[0]), extents or Extents.of(values.shape), list(values.reshape(-1))
    if isinstance(values, (list, tuple)) and not (isinstance(values, tuple) and isinstance(t, G.Compound)) and not isinstance(t, G.FixedArray):
        return t or _guess(values[0] if values else 0), extents or Extents.of([len(values)]), list(values)
    return t or _guess(values), extents or Extents.scalar(), [values]


def _guess(x: Any) -> G.Type:
    if isinstance(x, (bool, np.bool_)):
        return G.BOOL
    if isinstance(x, (int, np.integer)):
        return G.I64
    if isinstance(x, (float, np.floating)):
        return G.F64
    if isinstance(x, str):
        return G.VarLenString()
    raise FormatError(f"no element type for {x!r}")


def space_message(e: Extents) -> bytes:
    if e.is_null:
        return bytes([2, 0, 0, 2])
    grows = any(not a.is_fixed for a in e.axes)
    out = struct.pack("<BBB5x", 1, e.ndim, int(grows)) + struct.pack(f"<{e.ndim}Q", *e.dims)
    return out + (struct.pack(f"<{e.ndim}Q", *[UNDEFINED if m is None else m for m in e.maxdims]) if grows else b"")


def pipeline_message(p: Pipeline) -> bytes:
    out = struct.pack("<BB6x", 1, len(p.filters))
    for f in p.filters:
        name = f.name.encode() + b"\0" if f.id >= 256 else b""
        name += bytes(-len(name) % 8)
        out += struct.pack("<4H", f.id, len(name), int(f.optional), len(f.params)) + name + struct.pack(f"<{len(f.params)}I", *f.params) + bytes(4 * (len(f.params) % 2))
    return out


def link_message(name: str, link: tuple, order: int) -> bytes:
    raw = name.encode()
    kind = {"hard": 0, "soft": 1, "external": 64}[link[0]]
    out = struct.pack("<BBBQB", 1, 0x1C | 1, kind, order, 1) + struct.pack("<H", len(raw)) + raw
    if link[0] == "hard":
        return out + struct.pack("<Q", link[1])
    value = link[1].encode() if link[0] == "soft" else b"\0" + link[1].encode() + b"\0" + link[2].encode() + b"\0"
    return out + struct.pack("<H", len(value)) + value


def lowered(filters: Sequence[Filter], t: G.Type, elements: int) -> Pipeline:
    """Filters with the parameters that depend on the type and the chunk."""
    out = []
    for f in filters:
        p = f.params
        plain = isinstance(t, (G.Integer, G.Unsigned, G.Float))
        if not f.available:
            raise GridError(f"filter {f.name} cannot be written")
        if f.name in ("nbit", "scaleoffset", "szip") and not plain:
            raise GridError(f"{f.name} needs numbers")
        if f.name == "deflate":
            p = (p[0] if p else 6,)
            if not 0 <= p[0] <= 9:
                raise GridError("deflate levels are 0 to 9")
        elif f.name == "shuffle":
            p = (t.size,)
        elif f.name == "nbit":
            if p and not (0 < p[0] <= 8 * t.size and isinstance(t, (G.Integer, G.Unsigned))):
                raise GridError("n-bit: integers of at most their own bits")
            p = (8, 0, elements, 1, t.size, 0, p[0] if p else 8 * t.size, 0)
        elif f.name == "scaleoffset":
            is_float = isinstance(t, G.Float)
            p = (0 if is_float else 2, p[0] if p else 0, elements, int(is_float), t.size, int(isinstance(t, G.Integer)), 0, 0) + (0,) * 12
        elif f.name == "szip":
            block = p[1] if len(p) > 1 else 16
            if block % 2 or not 2 <= block <= 32:
                raise GridError("szip blocks are even, up to 32")
            p = (p[0] if p else 32 | 4, block, 8 * t.size, min(max(elements, 1), block * 128))
        elif f.name == "lzf":
            p = (4, 0x0105, elements * t.size)
        elif f.name == "blosc":
            # level, shuffle, codec
            level, shuffled, codec = (*p, *(5, 1, 0)[len(p) :])
            p = (2, 2, t.size, elements * t.size, level, shuffled, codec)
        out.append(Filter(f.name, tuple(p), f.optional))
    return Pipeline(tuple(out))


def chunk_blobs(a: ArrayFrame, chunk: Sequence[int], pipe: Pipeline):
    """(c0.., blob): the filtered bytes of every chunk that has cells, in any order; tasks do the packing."""
    keys = [f"c{k}" for k in range(a.ndim)]
    st, n, t, fill = strides(chunk), prod(chunk), a.type, a.fill_value
    at = [F.floor(F.col(x) / c).cast("bigint").alias(k) for k, x, c in zip(keys, a.names, chunk)]
    inner = sum((F.col(x) % c * s for x, c, s in zip(a.names, chunk, st)), F.lit(0)).cast("bigint").alias("i_")
    plain = D.is_plain(t) or isinstance(t, (G.Boolean, G.Unsigned))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        if plain:
            whole = np.full(n, fill).astype(D.stored(t))
            whole[pdf["i_"].to_numpy()] = pdf["v"].fillna(fill).to_numpy().astype(D.stored(t))
            raw = whole.tobytes()
        else:
            encode = ContainerWriter.__new__(ContainerWriter)._element
            one = encode(_zero(t), t)
            cells = [one] * n
            for i, v in zip(pdf["i_"], pdf["v"]):
                cells[i] = encode(v.asDict() if hasattr(v, "asDict") else v, t)
            raw = b"".join(cells)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "blob": [pipe.encode(raw, t.size)]})

    return a.df.select(*at, inner, "v").groupBy(*keys).applyInPandas(pack, ", ".join(f"{k} bigint" for k in keys) + ", blob binary")
