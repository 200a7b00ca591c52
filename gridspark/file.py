"""Files by mode: read, read-write, create, create-exclusive and append.

A file opened for writing is a new file that takes over the old one's objects, byte by byte where nothing changes, and replaces it on close; until then
the old one stays as it was.
"""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import SparkSession

from .errors import GridError
from .operators.array import ArrayFrame
from .operators.catalog import Catalog
from .plists import FileAccess, FileCreate
from .sources.h5 import read_array, read_attrs, read_catalog, read_values, storage_size
from .sources.parse import Container
from .sources.write import ContainerWriter

MODES = ("r", "r+", "w", "x", "a")
LIBRARY_VERSION = (1, 10, 0)


class File:
    """`with File("x.h5", "a") as f: f.writer.dataset("/d", values)`; reading needs no writer."""

    def __init__(self, path: str, mode: str = "r", *, create: FileCreate = FileCreate(), access: FileAccess = FileAccess()):
        if mode not in MODES:
            raise GridError(f"mode {mode!r}")
        self.path, self.mode, self.create, self.access, self.writer = path, mode, create, access, None
        exists = os.path.exists(path)
        if mode in ("r", "r+") and not exists:
            raise FileNotFoundError(path)
        if mode == "x" and exists:
            raise FileExistsError(path)
        if mode in ("w", "x") or (mode == "a" and not exists):
            self.writer = ContainerWriter(path, "w", bytes(create.userblock))
        elif mode in ("r+", "a"):
            with Container(path) as old:
                prefix = open(path, "rb").read(old.userblock)
                self.writer = ContainerWriter(path, "w", prefix)
                self.writer.take_over(old)
        else:
            Container(path).close()

    def __enter__(self) -> File:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.writer is not None:
            self.writer.__exit__(kind)
            self.writer = None

    def close(self) -> None:
        self.__exit__(None)

    @property
    def is_read_only(self) -> bool:
        return self.mode == "r"

    @property
    def userblock(self) -> int:
        if self.writer is not None:
            return self.writer.base
        with Container(self.path) as c:
            return c.userblock

    def size(self) -> int:
        """Bytes of the file, or written so far."""
        return self.writer.base + self.writer.end if self.writer is not None else os.path.getsize(self.path)

    def free_space(self) -> int:
        return 0

    # Reading (of what is on disk)

    def array(self, spark: SparkSession, dataset: str) -> ArrayFrame:
        return read_array(spark, self.path, dataset)

    def values(self, dataset: str, what: Any = None) -> Any:
        return read_values(self.path, dataset, what)

    def attrs(self, obj: str = "/") -> dict:
        return read_attrs(self.path, obj)

    def catalog(self, spark: SparkSession) -> Catalog:
        return read_catalog(spark, self.path)

    def storage_size(self, dataset: str) -> int:
        return storage_size(self.path, dataset)

    # Changing

    def _writable(self) -> ContainerWriter:
        if self.writer is None:
            raise GridError(f"{self.path} is open for reading only")
        return self.writer

    def dataset(self, path: str, values: Any = None, **more: Any) -> None:
        self._writable().dataset(path, values, **more)

    def write_array(self, path: str, a: ArrayFrame, **more: Any) -> None:
        self._writable().array(path, a, **more)

    def group(self, path: str) -> None:
        self._writable().group(path)

    def attr(self, path: str, name: str, value: Any, **more: Any) -> None:
        self._writable().attr(path, name, value, **more)

    def unlink(self, path: str) -> None:
        self._writable().unlink(path)

    def relink(self, old: str, new: str) -> None:
        self._writable().relink(old, new)


class ByteReader:
    """The stored bytes of a dataset in row-major order, with read and seek; not for elements of variable length."""

    def __init__(self, path: str, dataset: str):
        import numpy as np

        from .sources.h5 import find

        box, o = find(path, dataset)
        with box:
            if o.kind != "dataset" or o.type.has_vlen:
                raise GridError("only datasets of fixed-size elements are bytes")
            kind = o.dtype.newbyteorder("<")
        v = read_values(path, dataset)
        if not isinstance(v, np.ndarray) or v.dtype == object:
            from .sources.write import ContainerWriter as Writer

            flat = v.reshape(-1) if isinstance(v, np.ndarray) else [v]
            self.data = b"".join(Writer.__new__(Writer)._element(x, o.type) for x in flat)
        else:
            self.data = v.astype(kind).tobytes()
        self.pos = 0

    def __len__(self) -> int:
        return len(self.data)

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.pos, len(self.data))[whence]
        if at < 0:
            raise GridError("seek before the start")
        self.pos = at
        return at

    def read(self, n: int = -1) -> bytes:
        out = self.data[self.pos :] if n < 0 else self.data[self.pos : self.pos + n]
        self.pos += len(out)
        return out
