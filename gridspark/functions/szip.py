"""Extended-Rice coding of samples in blocks, as in the CCSDS lossless standard: nearest-neighbour or no prediction, split samples,
second extension, zero blocks and uncompressed blocks. The encoder chooses split samples or uncompressed blocks, and zero blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from ..errors import FormatError

# Option bits of the format.
NEAREST, MSB_FIRST = 32, 16
#: Blocks of one reference interval at most, and the run code that means to the end of a segment of 64 blocks.
SEGMENT, TO_END = 64, 5


def parameters(p: Sequence[int]) -> tuple[int, int, int, bool, bool]:
    """(pixels a block, bits a pixel, blocks a scan line, nearest neighbour, big-endian) of options, block, bits and line."""
    options, block, bits, line = p[:4]
    return block, bits, -(-line // block), bool(options & NEAREST), bool(options & MSB_FIRST)


class _Reader:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.ones = np.flatnonzero(self.bits)
        self.at = 0

    def take(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise FormatError("szip stream is cut off")
        v = 0
        for b in self.bits[self.at : self.at + n].tolist():
            v = v << 1 | b
        self.at += n
        return v

    def unary(self) -> int:
        k = np.searchsorted(self.ones, self.at)
        if k == len(self.ones):
            raise FormatError("szip stream is cut off")
        n = int(self.ones[k]) - self.at
        self.at += n + 1
        return n


def _id_bits(bits: int) -> int:
    return 3 if bits <= 8 else 4 if bits <= 16 else 5


def _kind(bits: int, big: bool) -> str:
    return f"{'>' if big else '<'}u{1 if bits <= 8 else 2 if bits <= 16 else 4 if bits <= 32 else 8}"


def _unmap(mapped: int, last: int, top: int) -> int:
    """A sample from its mapped difference to the last one."""
    room = min(last, top - last)
    if mapped <= 2 * room:
        return last + (mapped >> 1 if mapped % 2 == 0 else -((mapped + 1) >> 1))
    return mapped if last <= top - last else top - mapped


def _map(x: int, last: int, top: int) -> int:
    d, room = x - last, min(last, top - last)
    if 0 <= d <= room:
        return 2 * d
    return -2 * d - 1 if -room <= d < 0 else room + abs(d)


def decode(data: bytes, size: int, block: int, bits: int, line: int, nearest: bool, big: bool) -> bytes:
    kind = _kind(bits, big)
    n, r, top, ids = size // np.dtype(kind).itemsize, _Reader(data), (1 << bits) - 1, _id_bits(bits)
    raw_id = (1 << ids) - 1
    out: list[int] = []
    row = block * line
    zero = 0
    index = 0  # of the block in its line
    while len(out) < n:
        if len(out) % row == 0:
            index = zero = 0
        first = index == 0 and nearest
        mapped: list[int] = []
        if not zero:
            code = r.take(ids)
            low = code == 0 and r.take(1)
            if first:
                out.append(r.take(bits))
            want = block - first
            if code == 0 and not low:
                run = r.unary() + 1
                zero = min(SEGMENT - index % SEGMENT, line - index) if run == TO_END else run - (run > TO_END)
            elif code == 0:
                while len(mapped) < want + first:
                    v = r.unary()
                    s = int((np.sqrt(8 * v + 1) - 1) / 2)
                    b = v - s * (s + 1) // 2
                    mapped += [s - b, b]
                mapped = mapped[first : want + first]
            elif code == raw_id:
                mapped = [r.take(bits) for _ in range(want)]
            else:
                k = code - 1
                tops = [r.unary() for _ in range(want)]
                mapped = [t << k | (r.take(k) if k else 0) for t in tops]
        elif first:
            want = block
        if zero:
            zero -= 1
            mapped = [0] * (block - (1 if first else 0))
        for m in mapped:
            out.append(_unmap(m, out[-1], top) if nearest else m)
        index += 1
    return np.array(out[:n], np.uint64).astype(kind).tobytes()[:size]


def encode(data: bytes, block: int, bits: int, line: int, nearest: bool, big: bool) -> bytes:
    values = np.frombuffer(data, _kind(bits, big)).astype(object).tolist()
    top, ids, row = (1 << bits) - 1, _id_bits(bits), block * line
    raw_id = (1 << ids) - 1
    out: list[str] = []
    put = lambda v, n: out.append(format(v, f"0{n}b") if n else "")
    for start in range(0, len(values), row):
        scan = values[start : start + row]
        scan = scan + [scan[-1]] * (-len(scan) % block)
        blocks = []
        for i in range(0, len(scan), block):
            part, first = scan[i : i + block], i == 0 and nearest
            if nearest:
                blocks.append((part[0] if first else None, [_map(x, scan[i + j - 1], top) for j, x in enumerate(part) if i + j]))
            else:
                blocks.append((None, part))
        for ref, mapped in blocks:
            costs = [(sum(m >> k for m in mapped) + len(mapped) * (k + 1), k) for k in range(min(raw_id - 1, bits))]
            cost, k = min(costs, default=(1 << 62, 0))
            raw = cost >= len(mapped) * bits
            put(raw_id if raw else k + 1, ids)
            if ref is not None:
                put(ref, bits)
            if raw:
                for m in mapped:
                    put(m, bits)
            else:
                out.extend("0" * (m >> k) + "1" for m in mapped)
                for m in mapped:
                    put(m & (1 << k) - 1, k)
    text = "".join(out)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""
