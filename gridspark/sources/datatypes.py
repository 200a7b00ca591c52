"""Datatype messages: element types as they are stored, and numpy layouts to read them with."""

from __future__ import annotations

import struct
from typing import Any

import numpy as np

from .. import types as G
from ..errors import FormatError
from .store import Cursor

# Class numbers of the format.
FIXED, FLOAT, TIME, STRING, BITFIELD, OPAQUE, COMPOUND, REFERENCE, ENUM, VLEN, ARRAY = range(11)


def parse(c: Cursor) -> tuple[G.Type, np.dtype]:
    """The descriptor and the numpy type of stored bytes (byte order included; slots of variable length are raw bytes)."""
    head, bits, size = c.u8(), c.uint(3), c.u32()
    kind, version = head & 15, head >> 4
    if not 1 <= version <= 3:
        raise FormatError(f"datatype version {version}")
    order = ">" if bits & 1 else "<"
    if kind in (FIXED, BITFIELD):
        offset, precision = c.u16(), c.u16()
        if size not in (1, 2, 4, 8):
            raise FormatError(f"integer of {size} bytes")
        signed = kind == FIXED and bool(bits & 8)
        spread = {} if (offset, precision) == (0, 8 * size) else {"precision": precision, "offset": offset}
        return (G.Integer if signed else G.Unsigned)(size), np.dtype(f"{order}{'i' if signed else 'u'}{size}", metadata=spread)
    if kind == FLOAT:
        c.skip(12)
        if size not in (2, 4, 8):
            raise FormatError(f"float of {size} bytes")
        return G.Float(size), np.dtype(f"{order}f{size}")
    if kind == STRING:
        return G.FixedString(size, bool(bits >> 4 & 15)), np.dtype(f"S{size}")
    if kind == OPAQUE:
        c.skip(bits & 255)
        return G.Opaque(size), np.dtype(f"V{size}")
    if kind == REFERENCE:
        return G.Opaque(size), np.dtype(f"V{size}")
    if kind == COMPOUND:
        members, names, dtypes, offsets = [], [], [], []
        for _ in range(bits & 0xFFFF):
            start = c.pos
            name = c.text()
            if version < 3:
                c.align(8, start)
            offset = c.u32() if version < 3 else c.uint((size.bit_length() + 7) // 8 or 1)
            dims: list[int] = []
            if version == 1:
                rank = c.u8()
                c.skip(11)
                dims = [c.u32() for _ in range(4)][:rank]
            t, d = parse(c)
            for n in reversed(dims):
                t, d = G.FixedArray(t, n), np.dtype((d, (n,)))
            members.append(G.Field(name, t, offset))
            names.append(name)
            dtypes.append(d)
            offsets.append(offset)
        return G.Compound(tuple(members), size), np.dtype({"names": names, "formats": dtypes, "offsets": offsets, "itemsize": size})
    if kind == ENUM:
        base, d = parse(c)
        n, names = bits & 0xFFFF, []
        for _ in range(n):
            start = c.pos
            names.append(c.text())
            if version < 3:
                c.align(8, start)
        values = np.frombuffer(c.take(n * d.itemsize), d).tolist()
        members = tuple(zip(names, values))
        if d.itemsize == 1 and dict(members) == {"FALSE": 0, "TRUE": 1}:
            return G.BOOL, np.dtype("i1")
        return G.Enum(base, members), d
    if kind == VLEN:
        base, d = parse(c)
        if bits & 15 == 1:
            return G.VarLenString(bool(bits >> 8 & 15)), np.dtype("V16")
        return G.VarLenArray(base), np.dtype("V16", metadata={"base": d})
    if kind == ARRAY:
        rank = c.u8()
        if version < 3:
            c.skip(3)
        dims = [c.u32() for _ in range(rank)]
        if version < 3:
            c.skip(4 * rank)
        t, d = parse(c)
        for n in reversed(dims):
            t = G.FixedArray(t, n)
        return t, np.dtype((d, tuple(dims)))
    raise FormatError(f"datatype class {kind}")


def _head(kind: int, version: int, bits: int, size: int) -> bytes:
    return bytes([kind | version << 4]) + bits.to_bytes(3, "little") + struct.pack("<I", size)


#: sign place, exponent place and size, mantissa place and size, bias.
_FLOATS = {2: (15, 10, 5, 0, 10, 15), 4: (31, 23, 8, 0, 23, 127), 8: (63, 52, 11, 0, 52, 1023)}


def significant(values: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """Integers of fewer bits than their bytes have: moved down, and the sign extended."""
    bits = dtype.metadata or {}
    if "precision" not in bits:
        return values
    up = 8 * dtype.itemsize - bits["precision"]
    native = values.astype(dtype.newbyteorder("="))
    return (native << (up - bits["offset"]) >> up).astype(dtype)


def encode(t: G.Type, precision: int | None = None) -> bytes:
    if isinstance(t, (G.Integer, G.Unsigned)):
        return _head(FIXED, 1, 8 if isinstance(t, G.Integer) else 0, t.bytes) + struct.pack("<HH", 0, precision or 8 * t.bytes)
    if isinstance(t, G.Float):
        sign, *rest, bias = _FLOATS[t.bytes]
        return _head(FLOAT, 1, 0x20 | sign << 8, t.bytes) + struct.pack("<HH4BI", 0, 8 * t.bytes, *rest, bias)
    if isinstance(t, G.Boolean):
        return encode(G.Enum(G.I8, (("FALSE", 0), ("TRUE", 1))))
    if isinstance(t, G.Enum):
        names = b"".join(_padded(n) for n, _ in t.members)
        kind = stored(t.base)
        return _head(ENUM, 1, len(t.members), t.size) + encode(t.base) + names + np.array([v for _, v in t.members], kind).tobytes()
    if isinstance(t, G.FixedString):
        return _head(STRING, 1, 1 | (1 << 4 if t.utf8 else 0), t.bytes)
    if isinstance(t, G.Opaque):
        return _head(OPAQUE, 1, 0, t.bytes)
    if isinstance(t, G.VarLenString):
        return _head(VLEN, 1, 1 | (1 << 8 if t.utf8 else 0), 16) + encode(G.U8)
    if isinstance(t, G.VarLenArray):
        return _head(VLEN, 1, 0, 16) + encode(t.item)
    if isinstance(t, G.FixedArray):
        dims = []
        while isinstance(t, G.FixedArray):
            dims.append(t.length)
            t = t.item
        size = t.size * int(np.prod(dims))
        return _head(ARRAY, 2, 0, size) + bytes([len(dims), 0, 0, 0]) + struct.pack(f"<{len(dims)}I", *dims) + bytes(4 * len(dims)) + encode(t)
    if isinstance(t, G.Compound):
        out = _head(COMPOUND, 1, len(t.fields), t.size)
        for f in t.fields:
            out += _padded(f.name) + struct.pack("<I", f.offset) + bytes([0]) + bytes(11) + bytes(16) + encode(f.type)
        return out
    raise FormatError(f"{t} cannot be stored")


def _padded(name: str) -> bytes:
    raw = name.encode() + b"\0"
    return raw + bytes(-len(raw) % 8)


def stored(t: G.Type) -> np.dtype:
    """Little-endian numpy type of stored elements."""
    if isinstance(t, G.Integer):
        return np.dtype(f"<i{t.bytes}")
    if isinstance(t, G.Unsigned):
        return np.dtype(f"<u{t.bytes}")
    if isinstance(t, G.Float):
        return np.dtype(f"<f{t.bytes}")
    if isinstance(t, G.Boolean):
        return np.dtype("i1")
    if isinstance(t, G.Enum):
        return stored(t.base)
    if isinstance(t, G.FixedString):
        return np.dtype(f"S{t.bytes}")
    if isinstance(t, (G.VarLenString, G.VarLenArray)):
        return np.dtype("V16")
    if isinstance(t, G.Opaque):
        return np.dtype(f"V{t.bytes}")
    if isinstance(t, G.FixedArray):
        return np.dtype((stored(t.item), (t.length,)))
    if isinstance(t, G.Compound):
        return np.dtype({"names": [f.name for f in t.fields], "formats": [stored(f.type) for f in t.fields], "offsets": [f.offset for f in t.fields], "itemsize": t.size})
    raise FormatError(f"{t} cannot be stored")


def to_python(value: Any, t: G.Type, payload) -> Any:
    """A stored element as the value of its Spark type; payload(slot, item type) reads what a variable-length slot points to."""
    if isinstance(t, G.FixedString):
        return bytes(value).rstrip(b"\0").decode("utf-8", "replace")
    if isinstance(t, G.Boolean):
        return bool(value)
    if isinstance(t, G.VarLenString):
        return payload(bytes(value), None)
    if isinstance(t, G.VarLenArray):
        return payload(bytes(value), t.item)
    if isinstance(t, G.Opaque):
        return bytes(value)
    if isinstance(t, G.FixedArray):
        return [to_python(x, t.item, payload) for x in value]
    if isinstance(t, G.Compound):
        return {f.name: to_python(value[f.name], f.type, payload) for f in t.fields}
    v = value.item() if hasattr(value, "item") else value
    if isinstance(t, G.Unsigned) and t.bytes == 8:
        from decimal import Decimal

        return Decimal(int(v))
    return v


def is_plain(t: G.Type) -> bool:
    """Numbers whose numpy arrays are Arrow columns as they are."""
    return isinstance(t, (G.Integer, G.Float, G.Enum)) or (isinstance(t, G.Unsigned) and t.bytes < 8)
