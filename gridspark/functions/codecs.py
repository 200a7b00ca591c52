"""Chunk filters: bytes to bytes, in numpy where a byte loop can be avoided.

A pipeline encodes forward and decodes backward, leaving out filters whose bit is set in a chunk's mask. On columns it runs as
an Arrow-batched pandas UDF; the container source calls it in its own partition tasks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FormatError

# Filter numbers of the format.
DEFLATE, SHUFFLE, FLETCHER32, SZIP, NBIT, SCALEOFFSET, LZF, BLOSC = 1, 2, 3, 4, 5, 6, 32000, 32001
NAMES = {DEFLATE: "deflate", SHUFFLE: "shuffle", FLETCHER32: "fletcher32", SZIP: "szip", NBIT: "nbit", SCALEOFFSET: "scaleoffset", LZF: "lzf", BLOSC: "blosc"}
IDS = {v: k for k, v in NAMES.items()}


# Shuffle


def shuffle(data: bytes, size: int) -> bytes:
    """Byte k of all elements together; a last part of an element stays at the end."""
    n = len(data) // size * size
    if size < 2 or not n:
        return data
    return np.frombuffer(data, np.uint8, n).reshape(-1, size).T.tobytes() + data[n:]


def unshuffle(data: bytes, size: int) -> bytes:
    n = len(data) // size * size
    if size < 2 or not n:
        return data
    return np.frombuffer(data, np.uint8, n).reshape(size, -1).T.tobytes() + data[n:]


def bit_shuffle(data: bytes, size: int) -> bytes:
    """Bit k of all elements together, for whole groups of eight elements; the rest is as it was."""
    n = len(data) // (8 * size) * 8 * size
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n).reshape(-1, size), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[n:]


def bit_unshuffle(data: bytes, size: int) -> bytes:
    n = len(data) // (8 * size) * 8 * size
    if not n:
        return data
    bits = np.unpackbits(np.frombuffer(data, np.uint8, n).reshape(8 * size, -1), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little").tobytes() + data[n:]


# Checksums


def fletcher32(data: bytes) -> int:
    """Two sums of big-endian 16-bit words, folded: never 0 unless every word is."""
    if len(data) % 2:
        data = data + b"\0"
    w = np.frombuffer(data, ">u2").astype(np.uint64)
    s1, s2, n = int(w.sum()), 0, len(w)
    for i in range(0, n, 1 << 20):
        part = w[i : i + (1 << 20)]
        s2 += int((part * (np.arange(n - i, n - i - len(part), -1, dtype=np.uint64) % np.uint64(65535))).sum())
    if s2 == 0 and s1:
        s2 = 65535
    fold = lambda x: (x - 1) % 65535 + 1 if x else 0
    return fold(s2) << 16 | fold(s1)


def _add_checksum(data: bytes) -> bytes:
    return data + struct.pack("<I", fletcher32(data))


def _check(data: bytes) -> bytes:
    if len(data) < 4 or struct.unpack("<I", data[-4:])[0] != fletcher32(data[:-4]):
        raise FormatError("checksum mismatch")
    return data[:-4]


def lookup3(data: bytes, seed: int = 0) -> int:
    """The public-domain Jenkins hash of metadata blocks (hashlittle)."""
    m = 0xFFFFFFFF
    rot = lambda x, k: (x << k | x >> (32 - k)) & m
    a = b = c = (0xDEADBEEF + len(data) + seed) & m
    if not data:
        return c
    tail = (len(data) - 1) // 12 * 12
    for i in range(0, tail + 1, 12):
        x, y, z = struct.unpack("<3I", data[i : i + 12].ljust(12, b"\0"))
        a, b, c = (a + x) & m, (b + y) & m, (c + z) & m
        if i < tail:
            a = ((a - c) & m) ^ rot(c, 4)
            c = (c + b) & m
            b = ((b - a) & m) ^ rot(a, 6)
            a = (a + c) & m
            c = ((c - b) & m) ^ rot(b, 8)
            b = (b + a) & m
            a = ((a - c) & m) ^ rot(c, 16)
            c = (c + b) & m
            b = ((b - a) & m) ^ rot(a, 19)
            a = (a + c) & m
            c = ((c - b) & m) ^ rot(b, 4)
            b = (b + a) & m
    for x, y, z in ((14, 11, 25), (16, 4, 14)):
        c = ((c ^ b) - rot(b, x)) & m
        a = ((a ^ c) - rot(c, y)) & m
        b = ((b ^ a) - rot(a, z)) & m
    return ((c ^ b) - rot(b, 24)) & m


# LZF


def lzf_decode(data: bytes, size: int | None = None) -> bytes:
    out, i = bytearray(), 0
    try:
        while i < len(data):
            c = data[i]
            i += 1
            if c < 32:
                out += data[i : i + c + 1]
                i += c + 1
                continue
            n = c >> 5
            if n == 7:
                n += data[i]
                i += 1
            at = len(out) - ((c & 31) << 8 | data[i]) - 1
            i += 1
            if at < 0:
                raise FormatError("lzf reference before the start")
            _copy(out, at, n + 2)
    except IndexError:
        raise FormatError("lzf stream is cut off") from None
    return bytes(out)


def _copy(out: bytearray, at: int, n: int) -> None:
    """n bytes from place at, which may reach into those being written."""
    have = len(out) - at
    if have >= n:
        out += out[at : at + n]
    else:
        piece = bytes(out[at:])
        out += (piece * (n // have + 1))[:n]


def _matches(data: bytes, window: int, longest: int, least: int = 3) -> Iterator[tuple[int, int, int]]:
    """Greedy (place, distance, length) of repeats; a table of the last place of each three bytes."""
    last: dict[bytes, int] = {}
    i, n = 0, len(data)
    while i + least <= n:
        key = data[i : i + 3]
        at = last.get(key, -1)
        last[key] = i
        if at >= 0 and i - at <= window:
            k, top = 3, min(longest, n - i)
            while k < top and data[at + k] == data[i + k]:
                k += 1
            if k >= least:
                yield i, i - at, k
                i += k
                continue
        i += 1


def lzf_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literals(to: int):
        for i in range(at, to, 32):
            part = data[i : min(i + 32, to)]
            out.append(len(part) - 1)
            out.extend(part)

    for i, distance, n in _matches(data, 8192, 264):
        literals(i)
        d, k = distance - 1, n - 2
        if k < 7:
            out.append(k << 5 | d >> 8)
        else:
            out.append(7 << 5 | d >> 8)
            out.append(k - 7)
        out.append(d & 255)
        at = i + n
    literals(len(data))
    return bytes(out)


# Packed bits


def pack_bits(values: np.ndarray, bits: int) -> bytes:
    """The low bits of unsigned values, most significant first, with no gap between values."""
    if not bits:
        return b""
    v = values.astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.packbits(np.unpackbits(v, axis=1)[:, 64 - bits :]).tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if not bits:
        return np.zeros(n, np.uint64)
    raw = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    full = np.zeros((n, 64), np.uint8)
    full[:, 64 - bits :] = raw
    return np.packbits(full, axis=1).view(">u8").ravel().astype(np.uint64)


def nbit_encode(data: bytes, p: Sequence[int]) -> bytes:
    """p: parameter count, flag that nothing is packed, elements, class, size, order, precision, offset."""
    if p[1]:
        return data
    size, precision, offset = p[4], p[6], p[7]
    v = np.frombuffer(data, f"<u{size}").astype(np.uint64) >> np.uint64(offset)
    return pack_bits(v, precision)


def nbit_decode(data: bytes, p: Sequence[int]) -> bytes:
    if p[1]:
        return data
    if p[3] != 1 or p[5] != 0:
        raise FormatError("n-bit: only little-endian atomic elements")
    n, size, precision, offset = p[2], p[4], p[6], p[7]
    return (unpack_bits(data, precision, n) << np.uint64(offset)).astype(f"<u{size}").tobytes()


#: Where packed values start: 4 bytes of width, one of the minimum's length, and room for the minimum.
_SCALE_HEAD = 21


def _scale_kind(p: Sequence[int]) -> str:
    return f"<{'f' if p[3] == 1 else 'i' if p[5] else 'u'}{p[4]}"


def scaleoffset_encode(data: bytes, p: Sequence[int]) -> bytes:
    """p: scale type (0 floats, 2 integers), factor, elements, class (0 integer, 1 float), size, sign, order, fill flag, fill."""
    kind, size = _scale_kind(p), p[4]
    v = np.frombuffer(data, kind)
    if p[3] == 1:
        low = float(v.min()) if len(v) else 0.0
        q = np.rint((v.astype(np.float64) - low) * 10.0 ** _signed(p[1]))
        span, head = int(q.max()) if len(q) else 0, np.array([low], kind).tobytes()
        packed = q.astype(np.uint64) if span < 1 << 63 else None
    else:
        low = int(v.min()) if len(v) else 0
        span, head = int(v.max()) - low if len(v) else 0, struct.pack("<q" if p[5] else "<Q", low)
        packed = v.astype(np.uint64) - np.uint64(low & (1 << 64) - 1)
    bits = (span + 1).bit_length()  # one pattern more than is used: it stands for the fill value
    if packed is None or bits >= 8 * size:
        return (struct.pack("<IB", 8 * size, 8) + bytes(16)) + data
    return (struct.pack("<IB", bits, 8) + head.ljust(8, b"\0")).ljust(_SCALE_HEAD, b"\0") + pack_bits(packed, bits)


def scaleoffset_decode(data: bytes, p: Sequence[int]) -> bytes:
    if p[6] != 0:
        raise FormatError("scale-offset: only little-endian elements")
    if p[0] == 1:
        raise FormatError("scale-offset: no exponent scaling")
    kind, size, n = _scale_kind(p), p[4], p[2]
    bits, width = struct.unpack("<IB", data[:5])
    low, body = data[5 : 5 + width], data[_SCALE_HEAD:]
    if bits >= 8 * size:
        return body[: n * size]
    q = unpack_bits(body, bits, n)
    if p[3] == 1:
        v = (q.astype(np.float64) / 10.0 ** _signed(p[1]) + float(np.frombuffer(low.ljust(8, b"\0"), kind, 1)[0])).astype(kind)
    else:
        v = (q + np.uint64(int.from_bytes(low, "little", signed=bool(p[5])) & (1 << 64) - 1)).astype(f"<u{size}").view(kind)
    if p[7] and bits:
        fill = b"".join(struct.pack("<I", x) for x in p[8:])[:size].ljust(size, b"\0")
        v = np.where(q == np.uint64((1 << bits) - 1), np.frombuffer(fill, kind)[0], v).astype(kind)
    return v.tobytes()


def _signed(x: int) -> int:
    return x - (1 << 32) if x >> 31 else x


# Blosc 1


_BLOSC_CODECS = ("blosclz", "lz4", "snappy", "zlib", "zstd")
_BLOSC_BLOCK = 1 << 16


def blosclz_decode(data: bytes, size: int) -> bytes:
    out, i, first = bytearray(), 0, True
    try:
        while i < len(data):
            c = data[i] & 31 if first else data[i]
            i, first = i + 1, False
            if c < 32:
                out += data[i : i + c + 1]
                i += c + 1
                continue
            n, d = (c >> 5) - 1, (c & 31) << 8
            if n == 6:
                while True:
                    n += data[i]
                    i += 1
                    if data[i - 1] != 255:
                        break
            low = data[i]
            i += 1
            if low == 255 and d == 31 << 8:
                d = (data[i] << 8 | data[i + 1]) + 8191
                i += 2
            else:
                d += low
            at = len(out) - d - 1
            if at < 0:
                raise FormatError("blosclz reference before the start")
            _copy(out, at, n + 3)
    except IndexError:
        raise FormatError("blosclz stream is cut off") from None
    if len(out) != size:
        raise FormatError("blosclz stream has another length")
    return bytes(out)


def blosclz_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literals(to: int):
        for i in range(at, to, 32):
            part = data[i : min(i + 32, to)]
            out.append(len(part) - 1)
            out.extend(part)

    for i, distance, n in _matches(data, 8191, 1 << 20):
        if not out and not i:
            continue
        literals(i)
        d, k = distance - 1, n - 2  # stored length, one more than a code's zero
        out.append(min(k, 7) << 5 | d >> 8)
        if k >= 7:
            k -= 7
            while k >= 255:
                out.append(255)
                k -= 255
            out.append(k)
        out.append(d & 255)
        at = i + n
    literals(len(data))
    return bytes(out)


def _blosc_pack(name: str, data: bytes) -> bytes:
    if name == "blosclz":
        return blosclz_encode(data)
    if name == "zlib":
        return zlib.compress(data)
    import pyarrow as pa

    return pa.compress(data, codec={"lz4": "lz4_raw"}.get(name, name), asbytes=True)


def _blosc_unpack(name: str, data: bytes, size: int) -> bytes:
    if name == "blosclz":
        return blosclz_decode(data, size)
    if name == "zlib":
        return zlib.decompress(data)
    import pyarrow as pa

    return pa.decompress(data, decompressed_size=size, codec={"lz4": "lz4_raw"}.get(name, name), asbytes=True)


def blosc_encode(data: bytes, size: int, shuffled: int = 1, codec: str = "blosclz") -> bytes:
    """shuffled: 0 no, 1 bytes, 2 bits. Blocks are not split by byte, so each is one stream."""
    flags = {0: 0, 1: 1, 2: 4}[shuffled] | 0x10 | _BLOSC_CODECS.index(codec) << 5
    block = max(_BLOSC_BLOCK // (8 * size) * 8 * size, size)
    body, starts = bytearray(), []
    n_blocks = -(-len(data) // block)
    for i in range(0, len(data), block):
        part = data[i : i + block]
        part = shuffle(part, size) if shuffled == 1 else bit_shuffle(part, size) if shuffled == 2 else part
        packed = _blosc_pack(codec, part)
        packed = packed if len(packed) < len(part) else part
        starts.append(16 + 4 * n_blocks + len(body))
        body += struct.pack("<I", len(packed)) + packed
    total = 16 + 4 * n_blocks + len(body)
    if total >= len(data) + 16:
        return struct.pack("<4B3I", 2, 1, flags | 2, size & 255, len(data), block, len(data) + 16) + data
    return struct.pack("<4B3I", 2, 1, flags, size & 255, len(data), block, total) + struct.pack(f"<{n_blocks}I", *starts) + bytes(body)


def blosc_decode(data: bytes) -> bytes:
    if len(data) < 16:
        raise FormatError("blosc header is cut off")
    _, _, flags, size, total, block, _ = struct.unpack("<4B3I", data[:16])
    if flags & 2:
        return data[16 : 16 + total]
    if not total:
        return b""
    name = _BLOSC_CODECS[flags >> 5] if flags >> 5 < len(_BLOSC_CODECS) else None
    if name is None or not block or not size:
        raise FormatError("unknown blosc stream")
    if total > 1 << 33:
        raise FormatError("blosc chunk is too large")
    out = bytearray()
    for k, at in enumerate(struct.unpack_from(f"<{-(-total // block)}I", data, 16)):
        n = min(block, total - k * block)
        split = not flags & 0x10 and size <= 16 and n == block and block // size >= 128
        part = bytearray()
        for _ in range(size if split else 1):
            length, want = struct.unpack_from("<I", data, at)[0], n // size if split else n
            raw = data[at + 4 : at + 4 + length]
            part += raw if length == want else _blosc_unpack(name, raw, want)
            at += 4 + length
        part = bytes(part)
        out += unshuffle(part, size) if flags & 1 and size > 1 else bit_unshuffle(part, size) if flags & 4 else part
    return bytes(out)


# Pipelines


@dataclass(frozen=True)
class Filter:
    """A filter by name (or number) with its parameters; an optional one may be left out of a chunk."""

    name: str
    params: tuple[int, ...] = ()
    optional: bool = False

    @property
    def id(self) -> int:
        return IDS.get(self.name) or int(self.name)

    @classmethod
    def from_id(cls, number: int, params: Sequence[int] = (), optional: bool = False) -> Filter:
        return cls(NAMES.get(number, str(number)), tuple(params), optional)

    @property
    def available(self) -> bool:
        return self.name in IDS


def _blosc_params(p: Sequence[int], size: int) -> tuple[int, int, str]:
    return (p[2] if len(p) > 2 and p[2] else size, p[5] if len(p) > 5 else 1, _BLOSC_CODECS[p[6] if len(p) > 6 else 0])


def encode_one(f: Filter, data: bytes, size: int) -> bytes:
    from . import szip

    if f.name == "deflate":
        return zlib.compress(data, f.params[0] if f.params else 6)
    if f.name == "shuffle":
        return shuffle(data, f.params[0] if f.params else size)
    if f.name == "fletcher32":
        return _add_checksum(data)
    if f.name == "szip":
        return struct.pack("<I", len(data)) + szip.encode(data, *szip.parameters(f.params))
    if f.name == "nbit":
        return nbit_encode(data, f.params)
    if f.name == "scaleoffset":
        return scaleoffset_encode(data, f.params)
    if f.name == "lzf":
        return lzf_encode(data)
    if f.name == "blosc":
        return blosc_encode(data, *_blosc_params(f.params, size))
    raise FormatError(f"filter {f.name} is not known")


def decode_one(f: Filter, data: bytes, size: int) -> bytes:
    """Decodes one filter; whatever a broken stream does to a library below becomes a FormatError."""
    try:
        return _decode_one(f, data, size)
    except (FormatError, MemoryError):
        raise
    except (zlib.error, struct.error, IndexError, ValueError, OSError, OverflowError) as e:
        raise FormatError(f"{f.name}: {e}") from None


def _decode_one(f: Filter, data: bytes, size: int) -> bytes:
    from . import szip

    if f.name == "deflate":
        return zlib.decompress(data)
    if f.name == "shuffle":
        return unshuffle(data, f.params[0] if f.params else size)
    if f.name == "fletcher32":
        return _check(data)
    if f.name == "szip":
        return szip.decode(data[4:], struct.unpack("<I", data[:4])[0], *szip.parameters(f.params))
    if f.name == "nbit":
        return nbit_decode(data, f.params)
    if f.name == "scaleoffset":
        return scaleoffset_decode(data, f.params)
    if f.name == "lzf":
        return lzf_decode(data)
    if f.name == "blosc":
        return blosc_decode(data)
    raise FormatError(f"filter {f.name} is not known")


@dataclass(frozen=True)
class Pipeline:
    filters: Sequence[Filter] = field(default_factory=tuple)

    def encode(self, data: bytes, size: int) -> bytes:
        for f in self.filters:
            data = encode_one(f, data, size)
        return data

    def decode(self, data: bytes, size: int, mask: int = 0) -> bytes:
        for k in reversed(range(len(self.filters))):
            if not mask >> k & 1:
                data = decode_one(self.filters[k], data, size)
        return data


def encode_column(name: str, pipe: Pipeline, size: int) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else pipe.encode(bytes(x), size))

    return run(name)


def decode_column(name: str, pipe: Pipeline, size: int) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else pipe.decode(bytes(x), size))

    return run(name)
