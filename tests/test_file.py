"""Files by mode, property lists, byte readers and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark import plists
from gridspark import types as G
from gridspark.errors import GridError, LinkError
from gridspark.file import ByteReader, File
from gridspark.functions.codecs import Filter
from gridspark.sources.h5 import read_values
from gridspark.sources.parse import Container
from gridspark.streaming.append import append_batches, read_appended


def test_modes(tmp_path):
    p = str(tmp_path / "m.h5")
    with pytest.raises(FileNotFoundError):
        File(p)
    with File(p, "x", create=plists.build("file create", userblock=512)) as f:
        f.dataset("/d", np.arange(6).reshape(2, 3), chunk=(1, 3), filters=[Filter("deflate")], maxshape=(None, 3))
        f.dataset("/s", ["a", "", "ccc"])
        f.dataset("/t", [{"a": 1, "b": "x"}], type=G.layout([("a", G.I16), ("b", G.VarLenString())]))
        f.dataset("/e", type=G.F32, shape=(3,), fill=2.0)
        f.dataset("/z", 5)
        f.attr("/d", "unit", "m")
        f.writer.soft("/link", "/d")
        f.writer.hard("/again", "/s")
    with pytest.raises(FileExistsError):
        File(p, "x")
    with File(p) as f:
        assert f.is_read_only and f.userblock == 512 and f.size() > 512
        with pytest.raises(GridError):
            f.dataset("/n", 1)
    with File(p, "a") as f:
        f.dataset("/new", 7)
        f.unlink("/z")
        f.relink("/e", "/g/e")
        with pytest.raises(LinkError):
            f.relink("/nope", "/x")
    with Container(p) as c:
        assert c.userblock == 512 and sorted(x.name for x in c.resolve("/").links) == ["again", "d", "g", "link", "new", "s", "t"]
        assert c.resolve("/again") is c.resolve("/s")
    assert read_values(p, "/link").tolist() == [[0, 1, 2], [3, 4, 5]] and list(read_values(p, "/again")) == ["a", "", "ccc"]
    assert list(read_values(p, "/t")) == [{"a": 1, "b": "x"}] and read_values(p, "/g/e").tolist() == [2, 2, 2] and read_values(p, "/new") == 7
    assert File(p).attrs("/d")["unit"].value == "m"
    with File(p, "w") as f:
        pass
    assert Container(p).resolve("/").links == []


def test_a_failed_write_leaves_the_old_file(tmp_path):
    p = str(tmp_path / "k.h5")
    with File(p, "w") as f:
        f.dataset("/d", 1)
    with pytest.raises(RuntimeError):
        with File(p, "a") as f:
            f.unlink("/d")
            raise RuntimeError
    assert read_values(p, "/d") == 1 and len(list(tmp_path.iterdir())) == 1


def test_byte_reader(tmp_path):
    p = str(tmp_path / "b.h5")
    with File(p, "w") as f:
        f.dataset("/u", np.array([0x04030201, 0x08070605], "u4"))
        f.dataset("/v", ["x"])
    r = ByteReader(p, "/u")
    assert len(r) == 8 and r.read(4) == bytes([1, 2, 3, 4]) and r.seek(-2, 2) == 6 and r.read() == bytes([7, 8])
    for bad in (lambda: r.seek(-1), lambda: ByteReader(p, "/v")):
        with pytest.raises(GridError):
            bad()


def test_property_lists():
    assert [n for n, c in plists.CLASSES.items() if c] == ["dataset access", "dataset create", "file access", "file create", "link create"] and len(plists.CLASSES) == 16
    d = plists.build("dataset create", chunk=(2, 2), fill_value=3)
    assert d.chunk == (2, 2) and d.has("virtual_map") and len(d) == 12 and d.is_class("dataset create") and not d.is_empty
    assert d.arguments()["fill"] == 3
    for bad in (lambda: plists.build("dataset create", nope=1), lambda: plists.build("nope"), lambda: plists.build("file create", userblock=100), lambda: plists.build("dataset create", external=(1,)), lambda: plists.build("file access", driver="tape")):
        with pytest.raises(GridError):
            bad()


def test_stream_appends(spark, sf, tmp_path):
    src = tmp_path / "src"
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(events.schema).parquet(str(src))
        append_batches(stream, "event_id", "value", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    a = read_appended(spark, str(tmp_path / "out"))
    rows = events.toPandas()
    want = np.concatenate([rows[rows.event_id % 3 == k].sort_values("event_id").value.to_numpy() for k in range(3)])
    assert a.shape == want.shape and (a.collect() == want).all()
