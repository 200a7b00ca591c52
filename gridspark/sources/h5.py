"""The container as a Spark data source: `spark.read.format("h5").option("dataset", "/g/d").load(path)`.

Rows are cells: d0.. and v. Headers are parsed once where the plan is made; a partition is a few chunks or a range of bytes, read and
decoded by its own task into Arrow batches. Comparisons of coordinates with constants prune chunks before any byte is read
(spark.sql.python.filterPushdown.enabled); Spark applies all filters again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import product
from math import prod
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .. import types as G
from ..errors import FormatError, GridError
from ..extents import Extents, strides
from ..functions.codecs import Pipeline
from ..operators.array import ArrayFrame, names
from ..operators.catalog import ATTRS, LINKS, OBJECTS, Catalog
from ..operators.vds import Mapping, compose
from ..selection import Selection
from . import datatypes as D
from .store import expand
from .parse import UNDEFINED, Attribute, ChunkRef, Container, ExternalLink, Object

#: Stored bytes that a partition reads at most, if it is more than one chunk; cells of one Arrow batch.
PARTITION_BYTES, BATCH_CELLS = 32 << 20, 1 << 18
MAX_NESTING = 8


@dataclass
class Cells(InputPartition):
    """Boxes of cells, and where their bytes are: (origin, shape, address, stored bytes, mask or None for unstored)."""

    boxes: list[tuple]


@dataclass(frozen=True)
class Plan:
    """What a task needs to know of a dataset."""

    path: str
    userblock: int
    type: G.Type
    dtype: np.dtype
    dims: tuple[int, ...]
    pipeline: Pipeline
    fill: bytes | None
    chunked: bool
    data: bytes | None = None


def find(path: str, dataset: str, depth: int = 0) -> tuple[Container, Object]:
    """The container and object of a path, through external links."""
    box = Container(path)
    try:
        return box, box.resolve(dataset)
    except ExternalLink as e:
        box.close()
        if depth >= 32:
            raise FormatError("too many external links") from None
        return find(beside(path, e.file), e.path, depth + 1)


def beside(path: str, name: str) -> str:
    """A file named in another one: relative names are beside it."""
    return name if name.startswith("/") or "://" in name else f"{os.path.dirname(path)}/{name}" if os.path.dirname(path) else name


def plan_of(box: Container, o: Object) -> Plan:
    if o.kind == "unsupported":
        raise FormatError(o.reason or "unsupported object")
    if o.kind != "dataset":
        raise GridError("no dataset")
    if o.layout == "virtual":
        raise GridError("a virtual dataset is read with read_array")
    return Plan(box.path, box.userblock, o.type, o.dtype, o.extents.dims, o.pipeline, o.fill, o.layout == "chunked", o.data)


def boxes_of(o: Object, box: Container, bounds: list[tuple[int, int]]) -> Iterator[tuple]:
    """Boxes of a dataset that meet the bounds (first, last of each axis)."""
    dims = o.extents.dims
    if o.extents.is_null or o.extents.size == 0:
        return
    if o.layout == "chunked":
        stored = {c.offset: c for c in o.chunks}
        # Only the grid within the bounds is walked.
        axes = [range(max(lo, 0) // c * c, min(hi, d - 1) + 1, c) for d, c, (lo, hi) in zip(dims, o.chunk, bounds)]
        for at in product(*axes):
            c = stored.get(at)
            yield (at, o.chunk, c.address, c.bytes, c.mask) if c else (at, o.chunk, UNDEFINED, 0, 0)
        return
    if not dims:
        yield (), (), o.address_of_data, o.dtype.itemsize, 0
        return
    lo, hi = max(bounds[0][0], 0), min(bounds[0][1], dims[0] - 1)
    row = prod(dims[1:]) * o.dtype.itemsize
    step = max(1, PARTITION_BYTES // max(row, 1))
    for a in range(lo, hi + 1, step):
        n = min(step, hi + 1 - a)
        yield (a, *[0] * (len(dims) - 1)), (n, *dims[1:]), UNDEFINED if o.address_of_data == UNDEFINED else o.address_of_data + a * row, n * row, 0


def elements(p: Plan, box: Container, at: tuple, shape: tuple, address: int, stored: int, mask: int) -> np.ndarray:
    """Stored elements of one box."""
    n, d = prod(shape), p.dtype
    base = d.base if d.subdtype else d
    if p.data is not None:
        first = at[0] * prod(shape[1:]) * d.itemsize if at else 0
        raw = p.data[first : first + n * d.itemsize]
    elif address == UNDEFINED:
        raw = (p.fill if p.fill and len(p.fill) == d.itemsize else bytes(d.itemsize)) * n
    else:
        raw = box.io.at(address, stored)
        if p.chunked:
            raw = p.pipeline.decode(raw, d.itemsize, mask)
    if len(raw) < n * d.itemsize:
        raise FormatError("a chunk is too short")
    out = D.significant(np.frombuffer(raw, base, n * (d.itemsize // base.itemsize)), base)
    return out.reshape((*shape, *d.shape)) if d.subdtype else out.reshape(shape)


def to_arrow(values: np.ndarray, t: G.Type, box: Container, kind: pa.DataType) -> pa.Array:
    if D.is_plain(t):
        native = values.astype(values.dtype.newbyteorder("="), copy=False)
        return pa.array(native).cast(kind)
    if isinstance(t, G.Boolean):
        return pa.array(values != 0)
    return pa.array([D.to_python(x, t, box.payload) for x in values], kind)


class H5Reader(DataSourceReader):
    def __init__(self, path: str, dataset: str):
        self.path, self.dataset = path, dataset
        box, o = find(path, dataset)
        with box:
            self.plan, self.rank = plan_of(box, o), o.extents.ndim
        self.bounds = [(0, d - 1) for d in self.plan.dims]

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = getattr(f, "attribute", ())
            if len(name) == 1 and name[0] in (ns := names(self.rank)) and isinstance(getattr(f, "value", None), int):
                k, v = ns.index(name[0]), f.value
                lo, hi = self.bounds[k]
                if isinstance(f, EqualTo):
                    lo, hi = max(lo, v), min(hi, v)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    lo = max(lo, v + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    hi = min(hi, v - isinstance(f, LessThan))
                self.bounds[k] = lo, hi
            yield f  # Spark checks every row again

    def partitions(self) -> Sequence[InputPartition]:
        if any(lo > hi for lo, hi in self.bounds):
            return [Cells([])]
        box, o = find(self.path, self.dataset)
        out, held = [[]], 0
        with box:
            for b in boxes_of(o, box, self.bounds):
                size = max(b[3], prod(b[1]) * o.dtype.itemsize)
                if out[-1] and held + size > PARTITION_BYTES:
                    out.append([])
                    held = 0
                out[-1].append(b)
                held += size
        return [Cells(x) for x in out]

    def read(self, partition: Cells) -> Iterator[pa.RecordBatch]:
        p = self.plan
        kind = to_arrow_type(p.type.spark())
        with Container(p.path) if not D.is_plain(p.type) else _Io(p) as box:
            for b in partition.boxes:
                at, shape, values = b[0], b[1], elements(p, box, *b)
                inside = tuple(min(n, d - a) for a, n, d in zip(at, shape, p.dims))
                values = values[tuple(slice(0, n) for n in inside)]
                flat = values.reshape((prod(inside), *values.shape[len(inside) :]))
                for i in range(0, len(flat), BATCH_CELLS):
                    part = flat[i : i + BATCH_CELLS]
                    place = np.unravel_index(np.arange(i, i + len(part)), inside) if inside else ()
                    cols = [pa.array(x.astype(np.int64) + a) for x, a in zip(place, at)]
                    yield pa.RecordBatch.from_arrays([*cols, to_arrow(part, p.type, box, kind)], names=[*names(len(inside)), "v"])


class _Io:
    """Just the bytes of a file, for plain elements: no headers are parsed in the task."""

    def __init__(self, p: Plan):
        from .store import Ranges

        self.io = Ranges(p.path, p.userblock)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.io.close()


def to_arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type as convert

    return convert(t)


class H5FilesReader(DataSourceReader):
    """The dataset of the same name in many files; a task parses the headers of its own files."""

    def __init__(self, paths: list[tuple[str, int]], dataset: str):
        self.paths, self.dataset = paths, dataset

    def partitions(self) -> Sequence[InputPartition]:
        out, held = [[]], 0
        for p, size in self.paths:
            if out[-1] and held + size > PARTITION_BYTES:
                out.append([])
                held = 0
            out[-1].append(p)
            held += size
        return [Cells(x) for x in out if x] or [Cells([])]

    def read(self, partition: Cells) -> Iterator[pa.RecordBatch]:
        for path in partition.boxes:
            one = H5Reader(path, self.dataset)
            for part in one.partitions():
                for b in one.read(part):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * b.num_rows, pa.string()), *b.columns], names=["file", *b.schema.names])


class H5FilesSource(DataSource):
    """Options: path (a glob, or several with commas between), dataset. Rows are cells with the path of their file."""

    @classmethod
    def name(cls) -> str:
        return "h5files"

    def _paths(self) -> list[tuple[str, int]]:
        found = [f for g in self.options.get("path", "").split(",") for f in expand(g.strip())]
        if not found or "dataset" not in self.options:
            raise GridError("h5files needs a path that names files and the option dataset")
        return found

    def schema(self) -> T.StructType:
        box, o = find(self._paths()[0][0], self.options["dataset"])
        with box:
            p = plan_of(box, o)
        return T.StructType([T.StructField("file", T.StringType(), False), *cell_schema(len(p.dims), p.type).fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return H5FilesReader(self._paths(), self.options["dataset"])


class H5Source(DataSource):
    """Options: path, dataset."""

    @classmethod
    def name(cls) -> str:
        return "h5"

    def _open(self) -> tuple[str, str]:
        if "path" not in self.options or "dataset" not in self.options:
            raise GridError("h5 needs a path and the option dataset")
        return self.options["path"], self.options["dataset"]

    def schema(self) -> T.StructType:
        box, o = find(*self._open())
        with box:
            p = plan_of(box, o)
        return cell_schema(len(p.dims), p.type)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return H5Reader(*self._open())


def cell_schema(rank: int, t: G.Type) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType(), False) for n in names(rank)] + [T.StructField("v", t.spark(), True, G.metadata(t))])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(H5Source)
    spark.dataSource.register(H5FilesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_array(spark: SparkSession, path: str, dataset: str, depth: int = 0) -> ArrayFrame:
    """A dataset as an ArrayFrame; a virtual one is composed of its sources, whose files are opened only now."""
    register(spark)
    box, o = find(path, dataset)
    with box:
        if o.kind == "dataset" and o.layout == "virtual":
            if depth >= MAX_NESTING:
                raise FormatError("virtual datasets are nested too deep")
            maps = []
            for m in o.mappings:
                source = read_array(spark, box.path if m.file == "." else beside(box.path, m.file), m.dataset, depth + 1)
                maps.append(Mapping(source, m.source, m.target))
            fill = D.to_python(np.frombuffer(o.fill, D.stored(o.type))[0], o.type, None) if o.fill else None
            return compose(spark, o.extents, o.type, maps, fill)
        plan_of(box, o)
        df = spark.read.format("h5").option("dataset", dataset).load(path)
        fill = None
        if o.fill and D.is_plain(o.type):
            fill = np.frombuffer(o.fill, o.dtype)[0].item()
        return ArrayFrame(df, o.extents, o.type, fill, o.chunk)


def read_attrs(path: str, obj: str = "/") -> dict[str, Attribute]:
    box, o = find(path, obj)
    with box:
        return {a.name: a for a in o.attrs}


def storage_size(path: str, dataset: str) -> int:
    """Bytes stored for a dataset, without decoding any."""
    box, o = find(path, dataset)
    with box:
        if o.layout == "chunked":
            return sum(c.bytes for c in o.chunks)
        return len(o.data) if o.data is not None else 0 if o.layout == "virtual" or o.address_of_data == UNDEFINED else o.extents.size * o.dtype.itemsize


def chunk_table(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Stored chunks: offsets, address, bytes and filter mask."""
    box, o = find(path, dataset)
    with box:
        rows = [(*c.offset, c.address, c.bytes, c.mask) for c in o.chunks or []]
        rank = o.extents.ndim
    return spark.createDataFrame(rows, ", ".join(f"offset{k} bigint" for k in range(rank)) + ", address bigint, bytes bigint, filter_mask bigint")


def read_catalog(spark: SparkSession, path: str) -> Catalog:
    """The hierarchy of a file as tables; objects are numbered by header address."""
    with Container(path) as box:
        objects = [(o.address, o.kind, o.comment, o.mtime, o.reason) for o in box.objects.values()]
        links = [(o.address, x.name, x.kind, x.child, x.path, x.file, x.order) for o in box.objects.values() for x in o.links]
        attrs = [(o.address, a.name, str(a.type), list(a.extents.dims), repr(a.value), k) for o in box.objects.values() for k, a in enumerate(o.attrs)]
        root = box.root
    return Catalog(spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(links, LINKS), spark.createDataFrame(attrs, ATTRS), root)


def read_values(path: str, dataset: str, what: Any = None) -> Any:
    """A small dataset (or a selection of it) on the driver, without Spark: a numpy array, or a scalar's value."""
    box, o = find(path, dataset)
    with box:
        p = plan_of(box, o)
        if o.extents.is_null:
            return None
        plain = D.is_plain(p.type)
        out = np.zeros(p.dims, p.dtype.newbyteorder("=") if plain else object)
        for b in boxes_of(o, box, [(0, d - 1) for d in p.dims]):
            v = elements(p, box, *b)
            inside = tuple(slice(0, min(n, d - a)) for a, n, d in zip(b[0], b[1], p.dims))
            v = v[inside]
            if not plain:
                flat = v.reshape((-1, *v.shape[len(p.dims) :]))
                cells = np.empty(len(flat), object)
                for i, x in enumerate(flat):
                    cells[i] = D.to_python(x, p.type, box.payload)
                v = cells.reshape(v.shape[: len(p.dims)])
            out[tuple(slice(a, a + s.stop) for a, s in zip(b[0], inside))] = v
        if not p.dims:
            v = out.item()
            return v.item() if isinstance(v, np.ndarray) else v
        if what is None:
            return out
        s = Selection.of(what)
        return out.reshape(-1)[s.linear_indices(p.dims)].reshape(s.out_shape(p.dims))
