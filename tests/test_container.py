"""The container format: round trips of our own writer and reader, Spark reads, pruning, and damaged files."""

import random
import struct

import numpy as np
import pytest

from gridspark import types as G
from gridspark.errors import FormatError, GridError, LinkError
from gridspark.extents import Extents
from gridspark.functions.codecs import Filter
from gridspark.operators.array import ArrayFrame
from gridspark.selection import s_
from gridspark.sources.h5 import H5Reader, chunk_table, read_array, read_attrs, read_catalog, read_values, register, storage_size
from gridspark.sources.parse import Container
from gridspark.sources.virtual import StoredMapping
from gridspark.sources.write import ContainerWriter

COLOR = G.Enum(G.U8, (("Red", 1), ("Green", 2), ("Blue", 3)))
PIXEL = G.layout([("xy", G.record(G.I64, G.I64)), ("color", COLOR), ("tag", G.VarLenString())])
GRID = np.arange(16 * 17, dtype="i4").reshape(16, 17)
FILTERS = [[Filter("deflate", (6,)), Filter("shuffle"), Filter("fletcher32")], [Filter("lzf")], [Filter("scaleoffset")], [Filter("nbit")], [Filter("szip", (32, 8))]]
FILTERS += [[Filter("blosc", (5, s, c))] for s in (0, 1, 2) for c in range(5)]


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = str(tmp_path_factory.mktemp("h5") / "t.h5")
    with ContainerWriter(p) as w:
        w.dataset("/s/i", 42, type=G.I32)
        w.dataset("/s/f", 2.5)
        w.dataset("/s/b", True)
        w.dataset("/a2", np.arange(21).reshape(7, 3))
        w.dataset("/be", np.arange(4, dtype="f4"), compact=True)
        w.group("/a/b/c")
        w.dataset("/a/b/c/leaf", np.arange(5))
        w.soft("/shortcut", "/a/b/c")
        w.hard("/hard_leaf", "/a/b/c/leaf")
        w.dataset("/st", ["plain", "", "ünï"])
        w.dataset("/fs", ["üni", "code"], type=G.FixedString(12, True))
        w.dataset("/vl", [[1, 2], [3, 4, 5, 6], []], type=G.VarLenArray(G.U16))
        w.dataset("/vc", ["a", "bb", "", "dddd", "e"], chunk=(2,), filters=[Filter("deflate")])
        w.dataset("/px", [{"xy": {"0": 1, "1": 2}, "color": 1, "tag": "x"}, {"xy": {"0": 3, "1": 4}, "color": 3, "tag": "yy"}], type=PIXEL)
        for k, f in enumerate(FILTERS):
            w.dataset(f"/c/{k}", GRID, chunk=(5, 4), filters=f, maxshape=(None, 17))
        w.dataset("/many", np.arange(1600, dtype="u4").reshape(40, 40), chunk=(4, 4))
        w.dataset("/fill", type=G.F64, shape=(4,), fill=7.5)
        w.dataset("/fillc", type=G.F64, shape=(4,), fill=7.5, chunk=(2,))
        w.dataset("/none", type=G.I32, shape=(0, 3))
        for i in range(300):
            w.dataset(f"/l/d{i:04d}", i, type=G.I32)
        w.external("/ext/e", "t2.h5", "/data")
        w.external("/ext/lost", "missing.h5", "/data")
        w.attr("/a", "scalar", 7, type=G.I32)
        w.attr("/a", "vec", np.arange(4, dtype="f4"))
        w.attr("/a", "note", "metadata ünïcode")
        w.comment("/a", "a comment")
        w.named_type("/T", PIXEL)
        w.virtual("/vds", G.I64, (2, 5), [(StoredMapping("t2.h5", "/data", s_[0:5], s_[0, 0:5]), (6,)), (StoredMapping(".", "/a/b/c/leaf", s_[0:3], s_[1, 0:5:2]), (5,))], fill=-1)
    with ContainerWriter(p.replace("t.h5", "t2.h5"), userblock=b"u" * 512) as w:
        w.dataset("/data", np.array([7, 8, 9, 10, 11, 12]))
    return p


def test_values(path):
    v = lambda d, w=None: read_values(path, d, w)
    assert v("/s/i") == 42 and v("/s/f") == 2.5 and v("/s/b") is True
    assert (v("/a2") == np.arange(21).reshape(7, 3)).all() and v("/be").tolist() == [0, 1, 2, 3]
    assert list(v("/st")) == ["plain", "", "ünï"] and list(v("/fs")) == ["üni", "code"] and list(v("/vl")) == [[1, 2], [3, 4, 5, 6], []]
    assert list(v("/vc")) == ["a", "bb", "", "dddd", "e"]
    assert v("/px")[1] == {"xy": {"0": 3, "1": 4}, "color": 3, "tag": "yy"}
    assert v("/fill").tolist() == [7.5] * 4 == v("/fillc").tolist()
    assert v("/none").shape == (0, 3)
    assert v("/many", s_[4:8, 8:12])[0].tolist() == [168, 169, 170, 171]


@pytest.mark.parametrize("k", range(len(FILTERS)))
def test_filters(path, k):
    assert (read_values(path, f"/c/{k}") == GRID).all()
    with Container(path) as c:
        assert [f.name for f in c.resolve(f"/c/{k}").pipeline.filters] == [f.name for f in FILTERS[k]]


def test_hierarchy(path, spark):
    assert read_values(path, "/shortcut/leaf").tolist() == read_values(path, "/hard_leaf").tolist() == list(range(5))
    assert read_values(path, "/ext/e").tolist() == [7, 8, 9, 10, 11, 12]
    assert [read_values(path, f"/l/d{i:04d}") for i in (0, 7, 255, 256, 299)] == [0, 7, 255, 256, 299]
    for bad in ("/nope", "/s/i/x"):
        with pytest.raises(LinkError):
            read_values(path, bad)
    with pytest.raises(OSError):
        read_values(path, "/ext/lost")
    with pytest.raises(GridError):
        read_values(path, "/a")
    a = read_attrs(path, "/a")
    assert list(a) == ["scalar", "vec", "note"] and a["scalar"].value == 7 and a["vec"].value == [0, 1, 2, 3] and a["note"].value == "metadata ünïcode"
    c = read_catalog(spark, path)
    assert c.objects.where("kind = 'unsupported'").count() == 0 and c.objects.where("comment = 'a comment'").count() == 1
    assert [r["links"] for r in c.link_counts().where("links > 1").collect()] == [2]
    assert c.links.where("type = 'external'").count() == 2 and c.objects.where("mtime > 1600000000").count() > 300
    with Container(path) as box:
        assert box.resolve("/T").kind == "type" and box.resolve("/T").type == PIXEL
        assert box.resolve("/c/0").extents == Extents.of([(16, None), 17])


def test_spark_reads(path, spark):
    register(spark)
    load = lambda d: spark.read.format("h5").option("dataset", d).load(path)
    df = load("/many")
    assert df.schema.simpleString() == "struct<d0:bigint,d1:bigint,v:bigint>" and df.schema["v"].metadata["unsigned"]
    assert df.count() == 1600 and df.where("v <> d0 * 40 + d1").count() == 0
    assert [r.v.tag for r in load("/px").orderBy("d0").collect()] == ["x", "yy"]
    assert [r.v for r in load("/vc").orderBy("d0").collect()] == ["a", "bb", "", "dddd", "e"]
    assert load("/s/i").collect()[0].v == 42 and load("/none").count() == 0
    assert (read_array(spark, path, "/c/0").select(s_[3:9:2, 4]).collect() == GRID[3:9:2, 4]).all()
    v = read_array(spark, path, "/vds")
    assert v.collect().tolist() == [[7, 8, 9, 10, 11], [0, -1, 1, -1, 2]]
    assert storage_size(path, "/many") == 6400 and chunk_table(spark, path, "/many").count() == 100


def test_chunks_are_pruned(path):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    r = H5Reader(path, "/many")
    assert sum(len(p.boxes) for p in r.partitions()) == 100
    list(r.pushFilters([GreaterThanOrEqual(("d0",), 8), LessThan(("d0",), 12), EqualTo(("d1",), 39)]))
    assert [b[0] for p in r.partitions() for b in p.boxes] == [(8, 36)]
    list(r.pushFilters([EqualTo(("d1",), 99)]))
    assert sum(len(p.boxes) for p in r.partitions()) == 0


def test_array_frames_are_written(path, spark, tmp_path):
    a = read_array(spark, path, "/many").select(s_[2:40:3, 5:20])
    p = str(tmp_path / "out.h5")
    rec = G.layout([("a", G.I32), ("s", G.FixedString(4))])
    sparse = ArrayFrame(spark.createDataFrame([(0, 5), (9, 6)], "d0 long, v int"), Extents.of([(10, None)]), G.I32, fill=-1, chunk=(3,))
    with ContainerWriter(p, "x") as w:
        w.array("/m", a, chunk=(4, 4), filters=[Filter("shuffle"), Filter("deflate")])
        w.array("/sparse", sparse)
        w.array("/rec", ArrayFrame(spark.createDataFrame([(0, (1, "ab")), (1, (2, "cdefg"))], "d0 long, v struct<a:int,s:string>"), Extents.of([2]), rec))
    assert (read_values(p, "/m") == np.arange(1600).reshape(40, 40)[2:40:3, 5:20]).all()
    assert read_values(p, "/sparse").tolist() == [5, *[-1] * 8, 6] and storage_size(p, "/sparse") == 24
    assert list(read_values(p, "/rec")) == [{"a": 1, "s": "ab"}, {"a": 2, "s": "cdef"}]
    with pytest.raises(FileExistsError):
        ContainerWriter(p, "x")


def test_writer_refusals(tmp_path):
    p = str(tmp_path / "x.h5")
    with ContainerWriter(p) as w:
        w.dataset("/d", 1)
        for bad in (lambda: w.dataset("/d", 2), lambda: w.group("/d/x"), lambda: w.soft("", "x"), lambda: w.hard("/h", "/nope")):
            with pytest.raises(LinkError):
                bad()
        w.attr("/d", "a", 1)
        for bad in (lambda: w.attr("/d", "a", 1), lambda: w.dataset("/e", 1, chunk=(1,)), lambda: w.dataset("/f", ["x"], filters=[Filter("nbit")]), lambda: w.dataset("/g", [1], filters=[Filter("999")])):
            with pytest.raises(GridError):
                bad()
        w.dataset("/gone", 3)
        w.unlink("/gone")
    assert [x.name for x in Container(p).resolve("/").links] == ["d"]
    with pytest.raises(GridError):
        ContainerWriter(p, userblock=b"x" * 100)


def test_damaged_files_do_not_crash(path, tmp_path):
    raw, rng = open(path, "rb").read(), random.Random(0)
    p = str(tmp_path / "bad.h5")
    for _ in range(60):
        b = bytearray(raw)
        for _ in range(rng.randint(1, 8)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        open(p, "wb").write(bytes(b[: rng.choice([len(b), rng.randrange(len(b))])]))
        try:
            with Container(p) as c:
                for o in c.objects.values():
                    assert o.kind in ("group", "dataset", "type", "unsupported")
        except (FormatError, OSError):
            pass


def test_big_endian_and_newer_headers(tmp_path):
    """Hand-made bytes: superblock 2, version 2 headers, big-endian elements, a version 4 layout with a single chunk."""
    from gridspark.functions.codecs import lookup3
    from gridspark.sources.parse import SIGNATURE, UNDEFINED

    def header(messages):
        body = b"".join(struct.pack("<BHB", k, len(m), 0) + m for k, m in messages)
        raw = b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body
        return raw + struct.pack("<I", lookup3(raw))

    data = np.array([[1, -2], [300000, 4]], ">i4").tobytes()
    kind = struct.pack("<B3BIHH", 0x10, 0x09, 0, 0, 4, 0, 32)
    space = struct.pack("<4B2Q", 2, 2, 0, 1, 2, 2)
    plain = struct.pack("<BBQQ", 3, 1, 512, 16)
    single = struct.pack("<BBBBB", 4, 2, 0, 3, 1) + bytes([2, 2, 4]) + bytes([1]) + struct.pack("<Q", 512)
    link = lambda n, at: struct.pack("<BBB", 1, 0, len(n)) + n.encode() + struct.pack("<Q", at)
    a, b = header([(1, space), (3, kind), (8, plain)]), header([(1, space), (3, kind), (8, single)])
    root = header([(2, struct.pack("<BBQQ", 0, 0, UNDEFINED, UNDEFINED)), (6, link("a", 1024)), (6, link("b", 2048))])
    out = bytearray(4096)
    out[:48] = SIGNATURE + struct.pack("<4B5Q", 2, 8, 8, 0, 0, UNDEFINED, 4096, 256, 0)[:40]
    for at, x in ((256, root), (512, data), (1024, a), (2048, b)):
        out[at : at + len(x)] = x
    p = str(tmp_path / "be.h5")
    open(p, "wb").write(bytes(out))
    for d in ("/a", "/b"):
        assert read_values(p, d).tolist() == [[1, -2], [300000, 4]]


def test_large_attributes(tmp_path):
    p = str(tmp_path / "attr.h5")
    with ContainerWriter(p) as w:
        w.dataset("/d", 1, type=G.I32)
        w.attr("/d", "first", 1, type=G.I32)
        w.attr("/d", "large", np.arange(20_000.0))
        for i in range(5):
            w.attr("/d", f"a{i}", i, type=G.I32)
        w.attr("/d", "text", "é")
    a = read_attrs(p, "/d")
    assert list(a) == ["first", "large", "a0", "a1", "a2", "a3", "a4", "text"]
    assert a["large"].value == np.arange(20_000.0).tolist() and a["a4"].value == 4 and a["text"].value == "é"


def test_nbit_keeps_signs(tmp_path, spark):
    p, values = str(tmp_path / "n.h5"), np.array([-1, -5, 7, 2047, -2048, 0], "i2")
    with ContainerWriter(p) as w:
        w.dataset("/signed", values, chunk=(4,), filters=[Filter("nbit", (12,))])
        w.dataset("/unsigned", np.array([0, 5, 4095], "u2"), chunk=(2,), filters=[Filter("nbit", (12,))])
        with pytest.raises(GridError):
            w.dataset("/wide", values, chunk=(4,), filters=[Filter("nbit", (17,))])
    assert read_values(p, "/signed").tolist() == values.tolist() and read_values(p, "/unsigned").tolist() == [0, 5, 4095]
    assert [r.v for r in read_array(spark, p, "/signed").df.orderBy("d0").collect()] == values.tolist()
    assert storage_size(p, "/signed") == 12
    from gridspark.file import File

    with File(p, "a") as f:
        f.dataset("/more", [1], type=G.I8)
    assert read_values(p, "/signed").tolist() == values.tolist()


def test_many_files(tmp_path, spark):
    for k in range(4):
        with ContainerWriter(str(tmp_path / f"x{k}.h5")) as w:
            w.dataset("/d", np.arange(k, dtype="i8"))
    register(spark)
    load = lambda p: spark.read.format("h5files").option("dataset", "/d").load(p)
    got = load(f"{tmp_path}/x*.h5")
    assert got.columns == ["file", "d0", "v"]
    assert sorted((r.file[-4], r.d0, r.v) for r in got.collect()) == [(str(k), i, i) for k in range(4) for i in range(k)]
    assert load(f"{tmp_path}/x1.h5,{tmp_path}/x3.h5").count() == 4
    with pytest.raises(Exception, match="names files"):
        load(f"{tmp_path}/y*.h5").count()


def test_grid_within_bounds(tmp_path):
    p = str(tmp_path / "g.h5")
    with ContainerWriter(p) as w:
        w.dataset("/d", np.arange(400).reshape(20, 20), chunk=(3, 7))
    r = H5Reader(p, "/d")
    r.bounds = [(4, 8), (0, 6)]
    assert sorted(b[0] for c in r.partitions() for b in c.boxes) == [(3, 0), (6, 0)]
