"""Queries that go through files: tables written to containers in the shared folder, changed there, and read back."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import types as G
from ..errors import FormatError, GridError, LinkError
from ..extents import Extents
from ..file import ByteReader, File
from ..functions import convert as C
from ..functions.codecs import Filter
from ..operators.array import ArrayFrame, auto_chunk, choose_layout
from ..operators.catalog import Catalog
from ..plists import DatasetCreate, FileCreate, build
from ..selection import Selection, Slice, s_
from ..session import shared_dir
from ..sources.h5 import chunk_table, find, read_array, read_attrs, read_catalog, read_values, register, storage_size as stored_bytes
from ..sources.virtual import StoredMapping, decode, encode
from ..sources.write import ContainerWriter
from .queries import catalog, query, table, vec


def fresh(spark: SparkSession) -> str:
    """A path in the shared folder; what is there goes when the session ends."""
    path = f"{shared_dir(spark).removeprefix('file://')}/{uuid.uuid4().hex}.h5"
    atexit.register(lambda: os.path.exists(path) and os.unlink(path))
    return path


def nations(spark, sf) -> list:
    """The 25 rows of nation, by key."""
    return table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()


def rows(spark: SparkSession, data, schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


# Codecs: a whole column written by tasks through a filter, and read back


def through(spark, sf, name, key, value, type, filters) -> DataFrame:
    path = fresh(spark)
    with ContainerWriter(path) as w:
        w.array("/d", vec(spark, sf, name, key, value, type), chunk=(512,), filters=filters)
    return read_array(spark, path, "/d").df


SIZES, PRICES = "select p_partkey as d0, p_size::integer as v from part", "select o_orderkey as d0, o_totalprice as v from orders"


@query(SIZES)
def container_lzf(spark, sf):
    return through(spark, sf, "part", "p_partkey", "p_size", G.I32, [Filter("lzf")])


@query(SIZES)
def container_szip(spark, sf):
    return through(spark, sf, "part", "p_partkey", "p_size", G.I32, [Filter("szip", (32, 8))])


@query(SIZES)
def container_scaleoffset(spark, sf):
    return through(spark, sf, "part", "p_partkey", "p_size", G.I32, [Filter("scaleoffset")])


@query("select s_suppkey as d0, (s_nationkey - 12)::smallint as v from supplier")
def container_nbit_signed(spark, sf):
    return through(spark, sf, "supplier", "s_suppkey", (F.col("s_nationkey") - 12).cast("smallint"), G.I16, [Filter("nbit", (6,))])


@query(PRICES)
def container_deflate(spark, sf):
    return through(spark, sf, "orders", "o_orderkey", "o_totalprice", G.F64, [Filter("shuffle"), Filter("deflate", (6,)), Filter("fletcher32")])


@query(PRICES)
def container_blosc_lz4(spark, sf):
    return through(spark, sf, "orders", "o_orderkey", "o_totalprice", G.F64, [Filter("blosc", (5, 1, 1))])


@query(PRICES)
def container_blosc_zstd(spark, sf):
    return through(spark, sf, "orders", "o_orderkey", "o_totalprice", G.F64, [Filter("blosc", (5, 2, 4))])


@query(SIZES)
def container_blosclz(spark, sf):
    return through(spark, sf, "part", "p_partkey", "p_size", G.I32, [Filter("blosc", (5, 1, 0))])


# Layouts and element types, on nation and region


def small(spark, sf, values, **how) -> DataFrame:
    path = fresh(spark)
    with ContainerWriter(path) as w:
        w.dataset("/d", values, **how)
    return read_array(spark, path, "/d").df


REGIONS = "select n_nationkey::bigint as d0, n_regionkey::integer as v from nation"


@query(REGIONS)
def container_contiguous(spark, sf):
    return small(spark, sf, [r[2] for r in nations(spark, sf)], type=G.I32)


@query(REGIONS)
def container_compact(spark, sf):
    return small(spark, sf, [r[2] for r in nations(spark, sf)], type=G.I32, compact=True)


@query(REGIONS)
def container_resizable(spark, sf):
    return small(spark, sf, [r[2] for r in nations(spark, sf)], type=G.I32, maxshape=(None,), chunk=(4,))


@query("select n_nationkey::bigint as d0, n_name as v from nation")
def container_strings(spark, sf):
    return small(spark, sf, [r[1] for r in nations(spark, sf)], type=G.VarLenString())


@query("select n_nationkey::bigint as d0, left(n_name, 5) as v from nation")
def container_fixed_strings(spark, sf):
    return small(spark, sf, [r[1] for r in nations(spark, sf)], type=G.FixedString(5))


@query("select n_regionkey::bigint as d0, string_agg(n_nationkey::varchar, ' ' order by n_nationkey) as v from nation group by 1")
def container_vlen_arrays(spark, sf):
    by = {}
    for k, _, r in nations(spark, sf):
        by.setdefault(r, []).append(k)
    return small(spark, sf, [by[r] for r in sorted(by)], type=G.VarLenArray(G.I32)).withColumn("v", F.array_join(F.col("v").cast("array<string>"), " "))


@query("select n_nationkey::bigint as d0, n_nationkey::integer as key, n_name as name, n_regionkey / 2.0 as half from nation")
def container_compound(spark, sf):
    t = G.layout([("key", G.I32), ("name", G.VarLenString()), ("half", G.F64)])
    out = small(spark, sf, [{"key": k, "name": n, "half": r / 2} for k, n, r in nations(spark, sf)], type=t)
    return out.select("d0", "v.key", "v.name", "v.half")


@query("select n_nationkey::bigint as d0, n_regionkey = 1 as v from nation")
def container_bool(spark, sf):
    return small(spark, sf, [r[2] == 1 for r in nations(spark, sf)], type=G.BOOL)


@query("select n_nationkey::bigint as d0, case n_regionkey when 0 then 'ZERO' when 1 then 'ONE' end as v from nation")
def container_enum(spark, sf):
    t = G.Enum(G.U8, (("ZERO", 0), ("ONE", 1)))
    return small(spark, sf, [r[2] for r in nations(spark, sf)], type=t).select("d0", C.enum_name(F.col("v"), t).alias("v"))


@query("select d::bigint as d0, 7.5::double as v from range(40) x(d)")
def container_fill(spark, sf):
    path = fresh(spark)
    with ContainerWriter(path) as w:
        w.dataset("/d", type=G.F64, shape=(40,), fill=7.5, chunk=(16,))
    return read_array(spark, path, "/d").dense().df


@query("select count(*)::bigint as v from nation")
def container_scalar(spark, sf):
    return small(spark, sf, len(nations(spark, sf)), type=G.I64).select("v")


@query("select n_nationkey::bigint as d0, n_regionkey::bigint as v from nation where n_nationkey >= 4 and n_nationkey < 17 and (n_nationkey - 4) % 3 = 0")
def read_values_slab(spark, sf):
    path = fresh(spark)
    with ContainerWriter(path) as w:
        w.dataset("/d", [r[2] for r in nations(spark, sf)], type=G.I64, chunk=(8,))
    found = read_values(path, "/d", s_[4:17:3])
    return rows(spark, [(4 + 3 * i, int(v)) for i, v in enumerate(found)], "d0 bigint, v bigint")


# Files


@query("select (count(*) * 8)::bigint as bytes, count(*)::bigint as n from supplier")
def storage_size(spark, sf):
    path, a = fresh(spark), vec(spark, sf, "supplier", "s_suppkey", "s_acctbal", G.F64)
    with ContainerWriter(path) as w:
        w.array("/d", a, chunk=(a.size,))
    return rows(spark, [(stored_bytes(path, "/d"), a.size)], "bytes bigint, n bigint")


@query("select string_agg(printf('%02X000000', r_regionkey::integer), '' order by r_regionkey) as v from region")
def raw_bytes(spark, sf):
    keys = [r[0] for r in table(spark, sf, "region").select("r_regionkey").orderBy("r_regionkey").collect()]  # five rows
    path = fresh(spark)
    with File(path, "w") as f:
        f.dataset("/d", keys, type=G.I32)
    return rows(spark, [(ByteReader(path, "/d").read().hex().upper(),)], "v string")


@query("select 512::bigint as userblock, true as kept, true as longer, 'r' as mode")
def file_modes(spark, sf):
    path = fresh(spark)
    with File(path, "w", create=FileCreate(userblock=512)) as f:
        f.dataset("/a", 1, type=G.I32)
    before = File(path).size()
    with File(path, "a") as f:
        f.dataset("/b", [r[0] for r in nations(spark, sf)], type=G.I64)
    f = File(path)
    kept = open(path, "rb").read(512) == bytes(512) and f.values("/a") == 1 and len(f.values("/b")) == 25
    return rows(spark, [(f.userblock, kept, f.size() > before, f.mode)], "userblock bigint, kept boolean, longer boolean, mode string")


@query("select n_nationkey::bigint as d0, n_name as v from nation union all select 25 + r_regionkey, r_name from region")
def file_append(spark, sf):
    path, names = fresh(spark), [r[1] for r in nations(spark, sf)]
    with File(path, "w") as f:
        f.dataset("/n", names, type=G.VarLenString(), chunk=(6,), filters=[Filter("deflate", (4,))])
    with File(path, "r+") as f:
        f.dataset("/r", [r[0] for r in table(spark, sf, "region").select("r_name").orderBy("r_regionkey").collect()], type=G.VarLenString())
    more = File(path).array(spark, "/r").df.withColumn("d0", F.col("d0") + 25)
    return File(path).array(spark, "/n").df.unionByName(more)


@query("select * from (values ('duplicate'), ('exclusive'), ('filtered scalar'), ('missing'), ('read only'), ('ragged chunk'), ('string with zero'), ('szip of strings')) v(what)")
def refusals(spark, sf):
    path = fresh(spark)
    with File(path, "w") as f:
        f.dataset("/d", 1, type=G.I32)

    def twice():
        with ContainerWriter(fresh(spark)) as w:
            w.dataset("/d", 1)
            w.dataset("/d", 2)

    def made(*a, **k):
        with ContainerWriter(fresh(spark)) as w:
            w.dataset(*a, **k)

    tries = {
        "duplicate": twice,
        "exclusive": lambda: File(path, "x"),
        "filtered scalar": lambda: made("/d", 1, filters=[Filter("deflate")]),
        "missing": lambda: read_values(path, "/nope"),
        "read only": lambda: File(path).dataset("/e", 1),
        "ragged chunk": lambda: made("/d", [1, 2], chunk=(1, 1)),
        "string with zero": lambda: made("/d", ["a\0b"]),
        "szip of strings": lambda: made("/d", ["a"], chunk=(1,), filters=[Filter("szip")]),
    }
    found = []
    for what, f in tries.items():
        try:
            f()
        except (GridError, LinkError, FormatError, FileExistsError):
            found.append((what,))
    return rows(spark, found, "what string")


@query("select f.range::integer as file, s_suppkey as d0, s_acctbal + f.range as v from supplier, range(3) f")
def many_files_scan(spark, sf):
    register(spark)
    folder = fresh(spark).removesuffix(".h5")
    os.makedirs(folder)
    for k in range(3):
        with ContainerWriter(f"{folder}/part-{k}.h5") as w:
            w.array("/d", vec(spark, sf, "supplier", "s_suppkey", F.col("s_acctbal") + k, G.F64), chunk=(64,))
    df = spark.read.format("h5files").option("dataset", "/d").load(f"{folder}/part-*.h5")
    return df.select(F.regexp_extract("file", r"part-(\d+)", 1).cast("int").alias("file"), "d0", "v")


# Links, attributes, comments


def tree(spark, sf) -> str:
    path, beside = fresh(spark), fresh(spark)
    with ContainerWriter(beside) as w:
        w.dataset("/data", [r[2] for r in nations(spark, sf)], type=G.I32)
    with ContainerWriter(path) as w:
        for k, n, r in nations(spark, sf):
            w.dataset(f"/r{r}/{n}", k, type=G.I64)
        w.soft("/soft", "/r1")
        w.hard("/hard", "/r2")
        w.external("/out", os.path.basename(beside), "/data")
        w.group("/gone")
        w.unlink("/gone")
        w.group("/old")
        w.relink("/old", "/new/place")
        w.named_type("/type", G.I16)
        w.comment("/r3", "third")
        for k, n, r in nations(spark, sf):
            w.attr(f"/r{r}", n, k, type=G.I32)
        w.attr("/new", "long", [float(k) for k in range(20_000)], type=G.F64)
        w.attr("/new", "note", "by the long one")
    return path


@query("select '/r' || n_regionkey || '/' || n_name as path, n_nationkey::bigint as v from nation union all select '/soft/' || n_name, n_nationkey from nation where n_regionkey = 1 union all select '/hard/' || n_name, n_nationkey from nation where n_regionkey = 2")
def container_links(spark, sf):
    path = tree(spark, sf)
    names = [f"/r{r}/{n}" for _, n, r in nations(spark, sf)]
    names += [f"/soft/{n}" for _, n, r in nations(spark, sf) if r == 1] + [f"/hard/{n}" for _, n, r in nations(spark, sf) if r == 2]
    return rows(spark, [(p, int(read_values(path, p))) for p in names], "path string, v bigint")


@query(REGIONS)
def external_scan(spark, sf):
    return read_array(spark, tree(spark, sf), "/out").df


@query("select n_regionkey::integer as region, n_name as name, n_nationkey::bigint as v from nation")
def attr_scan(spark, sf):
    path = tree(spark, sf)
    return rows(spark, [(r, n, int(a.value)) for r in range(5) for n, a in read_attrs(path, f"/r{r}").items()], "region int, name string, v bigint")


@query("select 'long' as name, 20000::bigint as n, 199990000.0::double as total union all select 'note', 15, null")
def attr_dense(spark, sf):
    a = read_attrs(tree(spark, sf), "/new")
    return rows(spark, [("long", len(a["long"].value), float(sum(a["long"].value))), ("note", len(a["note"].value), None)], "name string, n bigint, total double")


@query("select 'group' as kind, 8::bigint as n, 1::bigint as comments union all select 'dataset', count(*), 0 from nation union all select 'type', 1, 0")
def container_objects(spark, sf):
    c = read_catalog(spark, tree(spark, sf))
    return c.objects.groupBy("kind").agg(F.count("*").alias("n"), F.count("comment").alias("comments"))


@query("select type, n from (values ('hard', 9 + 25), ('soft', 1), ('external', 1)) v(type, n)")
def container_link_kinds(spark, sf):
    c = read_catalog(spark, tree(spark, sf))
    return c.links.groupBy("type").agg(F.count("*").cast("int").alias("n"))


@query("select r_name as name, r_name <> 'ASIA' as there, r_name = 'AFRICA' as renamed, case when r_name = 'EUROPE' then 'old world' end as comment from region")
def catalog_edit(spark, sf):
    c = catalog(spark, sf)
    names = [r[0] for r in table(spark, sf, "region").select("r_name").orderBy("r_regionkey").collect()]  # five rows
    c, made = c.add_object("/made/deep")
    c = c.unlink("ASIA").relink("AFRICA", "/made/AFRICA").link_soft("/EUROPE", "/soft").link_hard("/EUROPE", "/hard").link_external("f.h5", "/x", "/ext")
    c = c.set_comment(c.resolve("/soft"), "old world").set_attr(made, "a", "i32", [], "1")
    assert c.exists("/ext") and c.resolve("/hard") == c.resolve("/EUROPE") and c.attr_names(made).count() == 1 and c.length(c.resolve("/made")) == 2
    said = {r["obj"]: r["comment"] for r in c.objects.where("comment is not null").collect()}
    out = [(n, c.exists(f"/{n}") or c.exists(f"/made/{n}"), c.exists(f"/made/{n}"), said.get(k + 1)) for k, n in enumerate(names)]
    return rows(spark, out, "name string, there boolean, renamed boolean, comment string")


@query("select 0::bigint as n, true as root union all select 1, false")
def catalog_empty(spark, sf):
    c = Catalog.empty(spark)
    d, _ = c.add_object("/g")
    return rows(spark, [(c.length(0), c.links.isEmpty()), (d.length(0), d.links.isEmpty())], "n bigint, root boolean")


# Virtual files


@query("select 0::bigint as d0, n_nationkey::bigint as d1, n_regionkey::integer as v from nation where n_nationkey < 10 union all select 1, n_nationkey - 10, n_regionkey * 10 from nation where n_nationkey >= 10 and n_nationkey < 20")
def virtual_file_scan(spark, sf):
    a, b, path = fresh(spark), fresh(spark), fresh(spark)
    keys = [r[2] for r in nations(spark, sf)]
    for p, f in ((a, 1), (b, 10)):
        with ContainerWriter(p) as w:
            w.dataset("/d", [k * f for k in keys], type=G.I32)
    maps = [(StoredMapping(os.path.basename(a), "/d", s_[0:10], s_[0, 0:10]), (25,)), (StoredMapping(os.path.basename(b), "/d", s_[10:20], s_[1, 0:10]), (25,))]
    with ContainerWriter(path) as w:
        w.virtual("/v", G.I32, (2, 10), maps, fill=-1)
    return read_array(spark, path, "/v").df


@query("select * from (values ('a.h5', '/d', 10, 10), ('.', '/e', 3, 3)) v(file, dataset, source, target)")
def virtual_mappings(spark, sf):
    maps = [(StoredMapping("a.h5", "/d", s_[0:10], s_[0, 0:10]), (25,), (2, 10)), (StoredMapping(".", "/e", s_[0:9:3], s_[1, 0:10:4]), (9,), (2, 10))]
    found = decode(encode(maps))
    return rows(spark, [(m.file, m.dataset, m.source.size(s), m.target.size(t)) for m, (_, s, t) in zip(found, maps)], "file string, dataset string, source int, target int")


# Descriptions, whose SQL states the values


@query("select n_nationkey::bigint as rows, n_nationkey::bigint * 3 as cells, ((n_nationkey + 1) // 2)::bigint as half from nation")
def selection_shapes(spark, sf):
    out = []
    for k, *_ in nations(spark, sf):
        a, b = s_[0:k, 1:4], s_[0:k:2]
        out.append((a.out_shape((k, 5))[0], a.size((k, 5)), b.out_shape((k,))[0]))
    return rows(spark, out, "rows bigint, cells bigint, half bigint")


@query("select n_nationkey::bigint as start, 2::bigint as block, concat_ws(' ', n_nationkey, n_nationkey + 1, n_nationkey + 5, n_nationkey + 6) as at from nation")
def selection_blocks(spark, sf):
    out = []
    for k, *_ in nations(spark, sf):
        s = Selection.slab(Slice(k, 5, count=2)).with_block(0, 2)
        out.append((k, 2, " ".join(map(str, s.linear_indices((40,))))))
    return rows(spark, out, "start bigint, block bigint, at string")


@query("select n_nationkey::bigint as n, case when n_nationkey = 0 then 'none' else 'all' end as kind from nation")
def selection_simplified(spark, sf):
    return rows(spark, [(k, s_[0:k].simplified((k,)).kind) for k, *_ in nations(spark, sf)], "n bigint, kind string")


@query("select * from (values ('i32', 'i64', 'HARD'), ('i64', 'i8', 'HARD'), ('f64', 'i16', 'HARD'), ('string', 'i32', 'none')) v(src, dst, path)")
def conversion_paths(spark, sf):
    kinds = {"i8": G.I8, "i16": G.I16, "i32": G.I32, "i64": G.I64, "f64": G.F64, "string": G.VarLenString()}
    out = []
    for a, b in (("i32", "i64"), ("i64", "i8"), ("f64", "i16"), ("string", "i32")):
        found = G.conversion_path(kinds[a], kinds[b])
        out.append((a, b, "none" if found is None else found.name))
    return rows(spark, out, "src string, dst string, path string")


@query("select n_nationkey::bigint as d0, left(n_name, 4) as v from nation")
def fixed_to_fixed(spark, sf):
    a = vec(spark, sf, "nation", "n_nationkey", F.rpad("n_name", 24, "\0"), G.FixedString(24))
    return a.as_type(G.FixedString(4)).as_type(G.VarLenString()).df


@query("select n_nationkey::bigint as n, (n_nationkey * 1024)::bigint as bytes, case when n_nationkey <= 4 then n_nationkey * 128 when n_nationkey <= 8 then n_nationkey * 64 when n_nationkey <= 16 then n_nationkey * 32 else n_nationkey * 16 end::bigint as chunk from nation where n_nationkey > 0")
def auto_chunks(spark, sf):
    return rows(spark, [(k, 1024 * k, auto_chunk((128 * k,), 8, 4096)[0]) for k, *_ in nations(spark, sf) if k], "n bigint, bytes bigint, chunk bigint")


@query("select * from (values ('fixed', null), ('filtered', 100::bigint), ('resizable', 100), ('asked', 7)) v(what, chunk)")
def layout_choice(spark, sf):
    one, grows = Extents.of([100]), Extents.resizable([100])
    found = {"fixed": choose_layout(one, 8), "filtered": choose_layout(one, 8, filters=True), "resizable": choose_layout(grows, 8), "asked": choose_layout(one, 8, chunk=(7,))}
    return rows(spark, [(k, v and v[0]) for k, v in found.items()], "what string, chunk bigint")


@query("select (i * 16)::bigint as offset0, 128::bigint as bytes, true as placed from range(((select count(*) from nation) + 15) // 16) x(i)")
def chunk_places(spark, sf):
    path = fresh(spark)
    with ContainerWriter(path) as w:
        w.dataset("/d", [r[2] for r in nations(spark, sf)], type=G.I64, chunk=(16,))
    return chunk_table(spark, path, "/d").select("offset0", "bytes", (F.col("address") > 0).alias("placed"))


@query("select * from (values ('dataset', 16::bigint, 2::bigint), ('file', 512, 0)) v(list, n, filters)")
def property_lists(spark, sf):
    path, made = fresh(spark), DatasetCreate(chunk=(16,), filters=(Filter("shuffle"), Filter("deflate", (3,))))
    with File(path, "w", create=build("file create", userblock=512)) as f:
        f.dataset("/d", [r[2] for r in nations(spark, sf)], type=G.I64, **made.arguments())
    box, o = find(path, "/d")
    with box:
        return rows(spark, [("dataset", o.chunk[0], len(o.pipeline.filters)), ("file", box.userblock, 0)], "list string, n bigint, filters bigint")


@query("select n_nationkey::bigint as n, n_nationkey::bigint + 2 as grown, (n_nationkey * (n_nationkey + 2))::bigint as size, 2 as ndim, true as resizable from nation")
def extents_of(spark, sf):
    out = []
    for k, *_ in nations(spark, sf):
        e = Extents.resizable([k, k]).resized([k, k + 2])
        out.append((e.dims[0], e.dims[1], e.size, e.ndim, e.is_resizable))
    return rows(spark, out, "n bigint, grown bigint, size bigint, ndim int, resizable boolean")
