"""Byte ranges of files, wherever they are: local paths and the URIs that Arrow knows."""

from __future__ import annotations

from fnmatch import fnmatch

from pyarrow import fs

from ..errors import FormatError

BLOCK = 1 << 16


def locate(path: str):
    """(file system, path within it)."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def expand(pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a pattern names, in order; * and ? stand for anything, / included."""
    system, inner = locate(pattern)
    prefix = pattern[: len(pattern) - len(inner)] if "://" in pattern else ""
    wild = min((inner.find(c) for c in "*?[" if c in inner), default=-1)
    if wild < 0:
        found = [system.get_file_info(inner)]
    else:
        found = system.get_file_info(fs.FileSelector(inner[:wild].rpartition("/")[0] or ".", recursive=True, allow_not_found=True))
        found = [f for f in found if fnmatch(f.path, inner)]
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File)


class Ranges:
    """Random reads of one file, in cached blocks; headers cluster, so few blocks serve a whole parse."""

    def __init__(self, path: str, base: int = 0):
        system, inner = locate(path)
        self.path, self.base, self.file = path, base, system.open_input_file(inner)
        self.size = self.file.size()
        self._blocks: dict[int, bytes] = {}

    def at(self, offset: int, n: int) -> bytes:
        offset += self.base
        if offset < 0 or n < 0 or offset + n > self.size:
            raise FormatError(f"{self.path}: {n} bytes at {offset} are outside the file")
        if n > 4 * BLOCK:
            return self.file.read_at(n, offset)
        out = bytearray()
        for k in range(offset // BLOCK, (offset + n - 1) // BLOCK + 1 if n else 0):
            if k not in self._blocks:
                if len(self._blocks) >= 1024:
                    self._blocks.clear()
                self._blocks[k] = self.file.read_at(min(BLOCK, self.size - k * BLOCK), k * BLOCK)
            out += self._blocks[k]
        first = offset - offset // BLOCK * BLOCK
        return bytes(out[first : first + n])

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class Cursor:
    """Little-endian fields one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.pos = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.pos + n > len(self.data):
            raise FormatError("a message is cut off")
        self.pos += n
        return self.data[self.pos - n : self.pos]

    def uint(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def u8(self) -> int:
        return self.uint(1)

    def u16(self) -> int:
        return self.uint(2)

    def u32(self) -> int:
        return self.uint(4)

    def u64(self) -> int:
        return self.uint(8)

    def skip(self, n: int) -> None:
        self.take(n)

    def align(self, n: int, start: int = 0) -> None:
        self.pos += -(self.pos - start) % n

    def text(self) -> str:
        """Up to a zero byte, which is taken too."""
        end = self.data.find(b"\0", self.pos)
        if end < 0:
            raise FormatError("a name has no end")
        return self.take(end - self.pos + 1)[:-1].decode("utf-8", "replace")

    @property
    def left(self) -> int:
        return len(self.data) - self.pos
