"""Queries of the array engine over the driver's tables, each with its SQL for DuckDB.

Arrays: embeddings is a matrix [N, 64]; events, orders, part and customer are vectors by their dense keys; region, nation and
customer make a three-level hierarchy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import types as G
from ..functions import arrays as A
from ..functions import convert as C
from ..functions import codecs as K
from ..operators import collective, tensor
from ..operators.array import ArrayFrame, num_chunks
from ..operators.catalog import ATTRS, LINKS, OBJECTS, Catalog
from ..operators.vds import Mapping, compose
from ..selection import Selection, Slice, s_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

EMB = "(select vec_id as d0, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as d1 from embeddings)"


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def emb(spark: SparkSession, sf: str, **more) -> ArrayFrame:
    df = table(spark, sf, "embeddings")
    return ArrayFrame.from_vectors(df, "vec_id", "embedding", (df.count(), 64), **more)


def vec(spark: SparkSession, sf: str, name: str, key: str, value, type: G.Type, **more) -> ArrayFrame:
    df = table(spark, sf, name)
    return ArrayFrame.from_column(df, key, value, df.count(), type, **more)


def vec_events(spark, sf, **more):
    return vec(spark, sf, "events", "event_id", "value", G.F64, **more)


# Selections


@query(f"select d0, d1, v from {EMB}")
def array_scan_2d(spark, sf):
    return emb(spark, sf).df


@query(f"select (d0 - 2) // 3 as d0, d1, v from {EMB} where d0 >= 2 and d0 < 20 and (d0 - 2) % 3 = 0")
def hyperslab_step(spark, sf):
    return emb(spark, sf).select(s_[2:20:3, :]).df


@query(f"select (d0 - 2) // 3 as d0, (d1 // 4) * 2 + d1 % 4 as d1, v from {EMB} where d0 >= 2 and d0 < 20 and (d0 - 2) % 3 = 0 and d1 < 16 and d1 % 4 < 2 and d1 // 4 < 4")
def hyperslab_block(spark, sf):
    return emb(spark, sf).select(Selection.slab(slice(2, 20, 3), Slice(0, 4, 16, block=2))).df


@query(f"select ((d0 - 1) // 5) * 2 + (d0 - 1) % 5 as d0, d1 - 8 as d1, v from {EMB} where d0 >= 1 and (d0 - 1) % 5 < 2 and (d0 - 1) // 5 < 7 and d1 >= 8 and d1 < 12")
def hyperslab_count(spark, sf):
    return emb(spark, sf).select(Selection.slab(Slice(1, 5, count=7, block=2), Slice(8, 1, count=4))).df


@query(f"select (d0 - 4) // 7 as d0, d1 - 60 as d1, v from {EMB} where d0 >= 4 and (d0 - 4) % 7 = 0 and d1 >= 60")
def hyperslab_unlimited(spark, sf):
    return emb(spark, sf).select(Selection.slab(Slice(4, 7), Slice(60))).df


@query(f"select d1 as d0, v from {EMB} where d0 = 3")
def index_drop_axis(spark, sf):
    return emb(spark, sf).select(s_[3, ...]).df


@query(f"select p.i * 4 + p.j as d0, e.d1, e.v from {EMB} e join (select a.i, b.j, a.i * 2 + b.j as d from range(5) a(i), range(4) b(j)) p on e.d0 = p.d where e.d1 < 3")
def hyperslab_overlap(spark, sf):
    return emb(spark, sf).select(Selection.slab(Slice(0, 2, count=5, block=4), slice(0, 3))).df


@query(f"select ((d0 - 5) // 6) * 3 + (d0 - 5) % 6 as d0, ((d1 - 3) // 9) * 4 + (d1 - 3) % 9 as d1, v from {EMB} where d0 >= 5 and (d0 - 5) % 6 < 3 and (d0 - 5) // 6 < 10 and d1 >= 3 and (d1 - 3) % 9 < 4 and (d1 - 3) // 9 < 6")
def hyperslab_renumber(spark, sf):
    return emb(spark, sf).select(Selection.slab(Slice(5, 6, count=10, block=3), Slice(3, 9, count=6, block=4))).df


POINTS = [(7, 3), (0, 0), (99, 63), (7, 3), (42, 17), (1, 62)]


@query(f"select p.d as d0, e.v from {EMB} e join (values {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(POINTS))}) p(d, a, b) on e.d0 = p.a and e.d1 = p.b")
def points_select(spark, sf):
    return emb(spark, sf).points(POINTS).df


@query(f"select d0, v from {EMB} where false")
def select_none(spark, sf):
    return emb(spark, sf).select(Selection.none()).df.select("d0", "v")


@query("select event_id as d0, value as v from events")
def select_all(spark, sf):
    return vec_events(spark, sf).select(...).df


@query(f"select d0 * 64 + d1 as i, v from {EMB}")
def linear_index(spark, sf):
    return emb(spark, sf).with_linear().select("i", "v")


@query(f"select (d0 * 64 + d1) // 32 as d0, (d0 * 64 + d1) % 32 as d1, v from {EMB}")
def reshape_unlinear(spark, sf):
    a = emb(spark, sf)
    return a.reshape((a.shape[0] * 2, 32)).df


@query("select event_id - 100 as d0, value as v from events where event_id >= 100 and event_id < 900 and value > 0")
def slab_then_filter(spark, sf):
    return vec_events(spark, sf).select(s_[100:900]).df.where("v > 0")


@query(f"select (d0 - 2) // 3 as d0, round(avg(v::double), 6) as mean_v, count(*) as n from {EMB} where d0 >= 2 and d0 < 20 and (d0 - 2) % 3 = 0 and d1 < 16 and d1 % 4 < 2 and d1 // 4 < 4 group by 1")
def slab_row_mean(spark, sf):
    a = emb(spark, sf).select(Selection.slab(slice(2, 20, 3), Slice(0, 4, 16, block=2)))
    return a.df.groupBy("d0").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean_v"), F.count("*").alias("n"))


@query("select 'rows' as what, ((count(*) + 6) // 7)::bigint as n from embeddings union all select 'columns', 4 union all select 'points', 6")
def out_shape_metadata(spark, sf):
    shape = emb(spark, sf).shape
    slab = Selection.slab(Slice(0, 7), Slice(0, 4, 16, block=1)).out_shape(shape)
    return spark.createDataFrame([("rows", slab[0]), ("columns", slab[1]), ("points", Selection.points(POINTS).out_shape(shape)[0])], "what string, n bigint")


# Conversions


def _cast(spark, sf, name, key, value, src, dst):
    return vec(spark, sf, name, key, value, src).as_type(dst).df


@query("select event_id as d0, greatest(least(trunc(value), 127), -128)::tinyint as v from events")
def sat_int8(spark, sf):
    return _cast(spark, sf, "events", "event_id", "value", G.F64, G.I8)


@query("select o_orderkey as d0, greatest(least(o_custkey - 500, 255), 0)::smallint as v from orders")
def sat_uint8(spark, sf):
    return _cast(spark, sf, "orders", "o_orderkey", F.col("o_custkey") - 500, G.I64, G.U8)


@query("select o_orderkey as d0, greatest(least(trunc(o_totalprice), 32767), -32768)::smallint as v from orders")
def sat_int16_f64(spark, sf):
    return _cast(spark, sf, "orders", "o_orderkey", "o_totalprice", G.F64, G.I16)


@query("select event_id as d0, greatest(least(user_id * 100000000, 2147483647), -2147483648)::integer as v from events")
def sat_int32(spark, sf):
    return _cast(spark, sf, "events", "event_id", F.col("user_id") * 100_000_000, G.I64, G.I32)


@query("select c_custkey as d0, greatest(c_custkey - 50, 0)::decimal(20, 0) as v from customer")
def sat_uint64(spark, sf):
    return _cast(spark, sf, "customer", "c_custkey", F.col("c_custkey") - 50, G.I64, G.U64)


@query("select c_custkey as d0, greatest(least(c_acctbal, 3.4e38), -3.4e38)::float as v from customer")
def f64_to_f32(spark, sf):
    return _cast(spark, sf, "customer", "c_custkey", "c_acctbal", G.F64, G.F32)


@query("select event_id as d0, (1152921504606846976 + 68719476736 + event_id)::double::float as v from events")
def int_to_float_via_double(spark, sf):
    return _cast(spark, sf, "events", "event_id", F.lit((1 << 60) + (1 << 36)) + F.col("event_id"), G.I64, G.F32)


@query("select event_id as d0, case when event_id % 7 = 0 then 0 else trunc(value)::bigint end as v from events")
def nan_to_zero(spark, sf):
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return _cast(spark, sf, "events", "event_id", v, G.F64, G.I64)


@query("select event_id as d0, case event_id % 4 when 0 then 9223372036854775807 when 1 then -9223372036854775808 else trunc(value)::bigint end as v from events")
def infinite_to_bounds(spark, sf):
    v = F.when(F.col("event_id") % 4 == 0, F.lit(float("inf"))).when(F.col("event_id") % 4 == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    return _cast(spark, sf, "events", "event_id", v, G.F64, G.I64)


@query("select c_custkey as d0, rtrim(left(c_name, 6), chr(0)) as v from customer")
def fixed_string_truncate(spark, sf):
    return _cast(spark, sf, "customer", "c_custkey", "c_name", G.VarLenString(), G.FixedString(6))


@query("select n_nationkey::bigint as d0, n_name as v from nation")
def fixed_string_unpad(spark, sf):
    padded = F.rpad("n_name", 24, "\0")
    return vec(spark, sf, "nation", "n_nationkey", padded, G.FixedString(24)).as_type(G.VarLenString()).df


@query("select doc_id as d0, case quality when 0 then 'LOW' when 1 then 'HIGH' end as v from labels")
def enum_name(spark, sf):
    t = G.Enum(G.U8, (("LOW", 0), ("HIGH", 1)))
    return table(spark, sf, "labels").select(F.col("doc_id").alias("d0"), C.enum_name(F.col("quality"), t).alias("v"))


@query("select doc_id as d0, toxic <> 0 as v from labels")
def enum_bool(spark, sf):
    t = G.Enum(G.I8, (("FALSE", 0), ("TRUE", 1)))
    return table(spark, sf, "labels").select(F.col("doc_id").alias("d0"), C.convert(F.col("toxic"), t, G.BOOL).alias("v"))


@query("select p_partkey as d0, p_retailprice::float as price, greatest(least(p_size, 127), -128)::tinyint as size, p_name as name from part")
def compound_rebuild(spark, sf):
    src = G.layout([("name", G.VarLenString()), ("size", G.I32), ("price", G.F64)])
    dst = G.layout([("price", G.F32), ("size", G.I8), ("name", G.VarLenString())])
    df = table(spark, sf, "part").select(F.col("p_partkey").alias("d0"), F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")).alias("v"))
    return df.select("d0", C.convert(F.col("v"), src, dst).alias("v")).select("d0", "v.price", "v.size", "v.name")


@query("select vec_id as d0, unnest(list_transform(embedding, lambda x: greatest(least(trunc(x::double * 1000), 127), -128)::tinyint)) as v, generate_subscripts(embedding, 1) - 1 as d1 from embeddings")
def fixed_array_cast(spark, sf):
    big = F.transform("embedding", lambda x: x.cast("double") * 1000)
    cast = C.convert(big, G.FixedArray(G.F64, 64), G.FixedArray(G.I8, 64))
    df = table(spark, sf, "embeddings").select(F.col("vec_id").alias("d0"), F.posexplode(cast).alias("d1", "v"))
    return df.withColumn("d1", F.col("d1").cast("bigint"))


@query("select doc_id as d0, len(string_split(text, ' '))::bigint as v from documents")
def vlen_array_len(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("d0"), A.length(F.split("text", " ")).alias("v"))


@query("select doc_id as d0, array_to_string(list_slice(string_split(text, ' '), 2, 4), ' ') as v, list_slice(string_split(text, ' '), 2, 4) = list_slice(string_split(text, ' '), 1, 3) as same from documents")
def vlen_array_slice(spark, sf):
    items = F.split("text", " ")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("d0"), F.array_join(A.part(items, 1, 4), " ").alias("v"), A.equal(A.part(items, 1, 4), A.part(items, 0, 3)).alias("same"))


@query("select doc_id as d0, quality::float as v from labels")
def tensor_read_f32(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("d0"), C.tensor_f32(F.col("quality"), G.I32).alias("v"))


# Chunks, fill, writing


@query(f"select d0 // 32 as c0, d1 // 16 as c1, count(*) as n, min(v) as v_min, max(v) as v_max from {EMB} group by 1, 2")
def chunk_stats(spark, sf):
    return emb(spark, sf, chunk=(32, 16)).chunk_stats()


@query("select i.i as index, (i.i // 4) * 32 as offset0, (i.i % 4) * 16 as offset1, 2048::bigint as bytes from (select unnest(range((((select count(*) from embeddings) + 31) // 32) * 4)) as i) i")
def chunk_info(spark, sf):
    return emb(spark, sf, chunk=(32, 16)).chunk_info().drop("filter_mask")


@query("select (((count(*) + 31) // 32) * 4)::bigint as n from embeddings")
def num_chunks_of(spark, sf):
    n = table(spark, sf, "embeddings").count()
    return spark.createDataFrame([(num_chunks((n, 64), (32, 16)),)], "n bigint")


@query(f"select d0 % 32 as d0, d1 % 16 as d1, v from {EMB} where d0 // 32 = 1 and d1 // 16 = 2")
def chunk_read(spark, sf):
    return emb(spark, sf, chunk=(32, 16)).select(s_[32:64, 32:48]).df


@query("select o.o_orderkey as d0, case when o.o_orderkey % 3 = 0 then o.o_totalprice else 7.5 end as v from orders o")
def fill_missing(spark, sf):
    df = table(spark, sf, "orders")
    a = ArrayFrame.from_column(df.where("o_orderkey % 3 = 0"), "o_orderkey", "o_totalprice", df.count(), G.F64, fill=7.5)
    return a.dense().df


@query("select p_partkey as d0, p_retailprice as v from part union all select (select count(*) from part) + range as d0, 0.0 as v from range(100)")
def resize_grow(spark, sf):
    df = table(spark, sf, "part")
    n = df.count()
    from ..extents import Extents

    a = ArrayFrame(df.select(F.col("p_partkey").alias("d0"), F.col("p_retailprice").alias("v")), Extents.resizable([n]), G.F64, chunk=(256,))
    return a.resize([n + 100]).dense().df


@query("select p_partkey as d0, p_retailprice as v from part where p_partkey < 77")
def resize_shrink(spark, sf):
    return vec(spark, sf, "part", "p_partkey", "p_retailprice", G.F64, chunk=(256,)).resize([77]).df


@query("select event_id as d0, case when event_id >= 10 and event_id < 50 and event_id % 4 = 2 then -((event_id - 10) // 4)::double else value end as v from events")
def write_slice(spark, sf):
    a = vec_events(spark, sf)
    new = ArrayFrame.from_values(spark, [-float(i) for i in range(10)], G.F64)
    return a.write_slice(s_[10:50:4], new).df


@query("select p_partkey as d0, case p_partkey when 5 then 30.0 when 9 then 20.0 else p_retailprice end as v from part")
def write_last_wins(spark, sf):
    a = vec(spark, sf, "part", "p_partkey", "p_retailprice", G.F64)
    return a.write_slice(Selection.points([[5], [9], [5]]), ArrayFrame.from_values(spark, [10.0, 20.0, 30.0], G.F64)).df


# Virtual arrays

SRC = "(select p_partkey as d0, p_retailprice as v from part)"


@query("select 0::bigint as d0, s_suppkey as d1, s_acctbal as v from supplier where s_suppkey < 10 union all select 1, c_custkey, c_acctbal from customer where c_custkey < 10")
def vds_union(spark, sf):
    a, b = vec(spark, sf, "supplier", "s_suppkey", "s_acctbal", G.F64), vec(spark, sf, "customer", "c_custkey", "c_acctbal", G.F64)
    maps = [Mapping(x, Selection.slab(slice(0, 10)), Selection.slab(i, slice(0, 10))) for i, x in enumerate((a, b))]
    from ..extents import Extents

    return compose(spark, Extents.of([2, 10]), G.F64, maps).df


@query(f"select d0, arg_max(v, m) as v from (select d0, v, 0 as m from {SRC} where d0 < 40 union all select d0 // 2 + 10, v, 1 from {SRC} where d0 < 40 and d0 % 2 = 0) group by 1")
def vds_overwrite(spark, sf):
    from ..extents import Extents

    a = vec(spark, sf, "part", "p_partkey", "p_retailprice", G.F64)
    maps = [Mapping(a, s_[0:40], s_[0:40]), Mapping(a, s_[0:40:2], s_[10:30])]
    return compose(spark, Extents.of([40]), G.F64, maps).df


@query(f"select g.range as d0, coalesce(s.v, -1.0) as v from range(60) g left join (select d0 * 3 as d0, v from {SRC} where d0 < 20) s on g.range = s.d0")
def vds_gap_fill(spark, sf):
    from ..extents import Extents

    a = vec(spark, sf, "part", "p_partkey", "p_retailprice", G.F64)
    return compose(spark, Extents.of([60]), G.F64, [Mapping(a, s_[0:20], s_[0:60:3])], fill=-1.0).dense().df


# Hierarchy: region / nation / customer


def catalog(spark, sf) -> Catalog:
    r, n, c = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    link = lambda p, name, child, order: [p.cast("bigint").alias("parent"), name.alias("name"), F.lit("hard").alias("type"), child.cast("bigint").alias("child"), F.lit(None).cast("string").alias("target_path"), F.lit(None).cast("string").alias("target_file"), order.cast("bigint").alias("creation_order")]
    rk, nk, ck = F.col("r_regionkey") + 1, F.col("n_nationkey") + 100, F.col("c_custkey") + 1000
    links = r.select(*link(F.lit(0), F.col("r_name"), rk, F.col("r_regionkey")))
    links = links.unionByName(n.select(*link(F.col("n_regionkey") + 1, F.col("n_name"), nk, F.col("n_nationkey"))))
    links = links.unionByName(c.select(*link(F.col("c_nationkey") + 100, F.col("c_name"), ck, F.col("c_custkey"))))
    obj = lambda k, kind: [k.cast("bigint").alias("obj"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("comment"), F.lit(0).cast("bigint").alias("mtime"), F.lit(None).cast("string").alias("reason")]
    objects = spark.range(1).select(*obj(F.col("id"), "group")).unionByName(r.select(*obj(rk, "group"))).unionByName(n.select(*obj(nk, "group"))).unionByName(c.select(*obj(ck, "dataset")))
    return Catalog(objects, links, spark.createDataFrame([], ATTRS))


CUST = "(select '/' || r_name || '/' || n_name || '/' || c_name as path, c_custkey + 1000 as obj, c_name, c_custkey, n_nationkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"


@query("select n_name as name, (n_nationkey + 100)::bigint as child from nation where n_regionkey = 1")
def link_members(spark, sf):
    return catalog(spark, sf).members(2).select("name", "child")


@query("select row_number() over (order by n_name) as rank, n_name as name from nation where n_regionkey = 2")
def iter_by_name(spark, sf):
    from pyspark.sql import Window as W

    return catalog(spark, sf).members(3).select(F.row_number().over(W.orderBy("name")).cast("bigint").alias("rank"), "name")


@query("select row_number() over (order by n_nationkey desc) as rank, n_name as name from nation where n_regionkey = 2")
def iter_by_creation(spark, sf):
    from pyspark.sql import Window as W

    return catalog(spark, sf).members(3, "creation", descending=True).select(F.row_number().over(W.orderBy(F.desc("creation_order"))).cast("bigint").alias("rank"), "name")


@query("select 0::bigint as obj, 1::bigint as links union all select r_regionkey + 1, 1 from region union all select n_nationkey + 100, 1 from nation union all select c_custkey + 1000, 1 from customer")
def link_counts(spark, sf):
    return catalog(spark, sf).link_counts()


@query(f"select c_name as name, obj from {CUST} where n_nationkey = 7")
def group_datasets(spark, sf):
    return catalog(spark, sf).of_kind(107, "dataset")


@query(f"select path, obj from {CUST} union all select '/nowhere/x', null")
def path_resolve(spark, sf):
    c = catalog(spark, sf)
    paths = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    paths = paths.select(F.concat_ws("/", F.lit(""), "r_name", "n_name", "c_name").alias("path")).unionByName(spark.createDataFrame([("/nowhere/x",)], "path string"))
    return c.resolve_all(paths, depth=3)


@query(f"select 0::bigint as obj, '/' as path union all select r_regionkey + 1, '/' || r_name from region union all select n_nationkey + 100, '/' || r_name || '/' || n_name from nation join region on n_regionkey = r_regionkey union all select obj, path from {CUST}")
def path_of(spark, sf):
    return catalog(spark, sf).paths(max_depth=3)


@query(f"select 0::bigint as obj, 0 as depth union all select r_regionkey + 1, 1 from region union all select n_nationkey + 100, 2 from nation union all select obj, 3 from {CUST}")
def path_depths(spark, sf):
    return catalog(spark, sf).paths().select("obj", F.when(F.col("path") == "/", 0).otherwise(F.size(F.split("path", "/")) - 1).alias("depth"))


@query("select kind, count(*) as n, sum(links)::bigint as links from (select 'group' as kind, 1 as links union all select 'group', 1 from region union all select 'group', 1 from nation union all select 'dataset', 1 from customer) group by 1")
def object_info(spark, sf):
    return catalog(spark, sf).info().groupBy("kind").agg(F.count("*").alias("n"), F.sum("links").cast("bigint").alias("links"))


# Collectives


def _ranked(spark, sf):
    df = table(spark, sf, "events").select(collective.rank_of("event_id", 4).alias("rank"), "value", "event_id")
    return df.groupBy("rank").agg(F.round(F.sum("value"), 3).alias("x"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("event_id").alias("k"))


@query("select r.range::integer as rank, s.k from range(4) r, (select sum(event_id)::bigint as k from events) s")
def allreduce_sum(spark, sf):
    return collective.allreduce(_ranked(spark, sf), "k", "sum")


@query("select r.range::integer as rank, s.lo from range(4) r, (select min(value) as lo from events) s")
def allreduce_min(spark, sf):
    return collective.allreduce(_ranked(spark, sf), "lo", "min")


@query("select r.range::integer as rank, s.hi from range(4) r, (select max(value) as hi from events) s")
def allreduce_max(spark, sf):
    return collective.allreduce(_ranked(spark, sf), "hi", "max")


@query("select (event_id % 4)::integer as rank, sum(event_id)::bigint as v from events group by 1")
def gather_ranks(spark, sf):
    g = collective.gather(_ranked(spark, sf), "k")
    return g.select(F.posexplode("gathered").alias("rank", "v"))


@query("select r.range::integer as rank, s.k from range(4) r, (select sum(event_id)::bigint as k from events where event_id % 4 = 2) s")
def bcast_root(spark, sf):
    return collective.bcast(_ranked(spark, sf), "k", root=2)


@query("select g.d0, coalesce(arg_max(l.v, l.rank), 0.0) as v from (select unnest(range((select (count(*) + 3) // 4 from events))) as d0) g left join (select event_id // 4 as d0, event_id % 4 as rank, value as v from events where event_id % 3 <> 0) l on g.d0 = l.d0 group by 1")
def collective_merge(spark, sf):
    df = table(spark, sf, "events")
    log = df.where("event_id % 3 <> 0").select(F.floor(F.col("event_id") / 4).cast("bigint").alias("d0"), collective.rank_of("event_id", 4).alias("rank"), F.col("value").alias("v"))
    from ..extents import Extents

    base = ArrayFrame.filled(spark, Extents.of([-(-df.count() // 4)]), G.F64)
    return collective.merge(base, log).dense().df


@query("select r.range::integer as rank, s.g as gathered from range(4) r, (select string_agg(k::varchar, ' ' order by rank) as g from (select event_id % 4 as rank, sum(event_id)::bigint as k from events group by 1)) s")
def allgather_ranks(spark, sf):
    return collective.allgather(_ranked(spark, sf), "k").withColumn("gathered", F.array_join(F.col("gathered").cast("array<string>"), " "))


@query("select count(distinct event_id % 4)::bigint as ranks from events")
def barrier_ranks(spark, sf):
    return spark.createDataFrame([(collective.barrier(_ranked(spark, sf)),)], "ranks bigint")


# Tensors and codecs


@query(f"select a.d0, b.j as d1, greatest(round(sum(a.v::double * b.w), 4), 0.0) as v from {EMB} a join (select i.range as i, j.range as j, ((i.range * 3 + j.range * 5) % 7 - 3)::double as w from range(64) i, range(4) j) b on a.d1 = b.i group by 1, 2")
def matmul_relu(spark, sf):
    w = ArrayFrame.from_values(spark, [[float((i * 3 + j * 5) % 7 - 3) for j in range(4)] for i in range(64)], G.F64)
    return tensor.relu(tensor.each(tensor.matmul(emb(spark, sf), w), lambda v: F.round(v, 4))).df


@query("select doc_id, strlen(text)::bigint as n, strlen(text)::bigint + 4 as stored, true as same from documents")
def fletcher32_round_trip(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    pipe = K.Pipeline([K.Filter("fletcher32")])
    df = df.withColumn("enc", K.encode_column("raw", pipe, 1)).withColumn("dec", K.decode_column("enc", pipe, 1))
    return df.select("doc_id", F.octet_length("raw").cast("bigint").alias("n"), F.octet_length("enc").cast("bigint").alias("stored"), (F.col("raw") == F.col("dec")).alias("same"))


@query("select doc_id, strlen(text)::bigint as n, true as same from documents")
def filter_pipeline_round_trip(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    pipe = K.Pipeline([K.Filter("shuffle"), K.Filter("deflate", (6,)), K.Filter("fletcher32")])
    df = df.withColumn("enc", K.encode_column("raw", pipe, 4)).withColumn("dec", K.decode_column("enc", pipe, 4))
    return df.select("doc_id", F.octet_length("dec").cast("bigint").alias("n"), (F.col("raw") == F.col("dec")).alias("same"))


# The container itself: written to the shared folder, read back by the data source


def container(spark, sf, filters=()) -> str:
    import uuid

    from ..session import shared_dir
    from ..sources.write import ContainerWriter

    path = f"{shared_dir(spark).removeprefix('file://')}/{uuid.uuid4().hex}.h5"
    with ContainerWriter(path) as w:
        w.array("/g/matrix", emb(spark, sf), chunk=(256, 16), filters=filters)
        w.soft("/alias", "/g/matrix")
    return path


@query(f"select d0, d1, v from {EMB}")
def container_scan(spark, sf):
    from ..sources.h5 import read_array

    return read_array(spark, container(spark, sf), "/g/matrix").df


@query(f"select d0 - 10 as d0, (d1 - 3) // 5 as d1, v from {EMB} where d0 >= 10 and d0 < 200 and d1 >= 3 and (d1 - 3) % 5 = 0 and d1 < 40")
def container_slab(spark, sf):
    from ..sources.h5 import read_array

    path = container(spark, sf, [K.Filter("shuffle"), K.Filter("deflate", (4,)), K.Filter("fletcher32")])
    return read_array(spark, path, "/alias").select(s_[10:200, 3:40:5]).df


@query("select c.i * 256 as offset0, j.j * 16 as offset1, 16384::bigint as bytes from (select unnest(range(((select count(*) from embeddings) + 255) // 256)) as i) c, (select unnest(range(4)) as j) j")
def container_chunks(spark, sf):
    from ..sources.h5 import chunk_table

    return chunk_table(spark, container(spark, sf), "/g/matrix").select("offset0", "offset1", "bytes")


@query("select '/' as path, 'group' as kind union all select '/g', 'group' union all select '/g/matrix', 'dataset'")
def container_catalog(spark, sf):
    from ..sources.h5 import read_catalog

    c = read_catalog(spark, container(spark, sf))
    return c.paths().join(c.objects, "obj").select("path", "kind")
