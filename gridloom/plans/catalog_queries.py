"""Queries over stored arrays, each with SQL for the same rows.

Every query makes its array from a table (or takes one made before in the session for the same folder and layout),
so rows go through encoding, the store and the scan.
"""

from __future__ import annotations

import functools
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import meta
from ..functions import attributes as at
from ..functions import cells as fc
from ..grid import grid_frame, packed, projected
from ..meta import SpecBuilder
from ..operators.array import Array
from ..operators.hierarchy import Group, nodes
from ..operators.imaging import MultiscaleImage, Plate, Scene
from ..session import work_folder
from ..sources.sink import parts_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Cells of the arrays, from the tables.

def _cells(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    if what == "E":  # embeddings by vector and position
        return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("d0"), F.posexplode("embedding").alias("d1", "value"))
    if what == "P":
        return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d0"), F.col("o_totalprice").alias("value"))
    if what == "Q":  # of repeated cells the sum
        return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("d0"), F.col("l_suppkey").alias("d1"), F.col("l_quantity").alias("value"))
    if what == "S":
        return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("d0"), F.col("p_size").alias("value"))
    if what == "V":
        return table(spark, sf_dir, "events").select(F.col("event_id").alias("d0"), F.col("value").alias("value"))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("d0"), (F.col("toxic") == 1).alias("value"))


KEYS = {"E": ("embeddings", "vec_id"), "P": ("orders", "o_orderkey"), "S": ("part", "p_partkey"), "V": ("events", "event_id"), "B": ("documents", "doc_id")}
TYPES = {"E": "float32", "P": "float64", "Q": "float64", "S": "uint8", "V": "float64", "B": "bool"}


def _extent(spark: SparkSession, sf_dir: str, t: str, key: str) -> int:
    return table(spark, sf_dir, t).agg(F.max(key)).first()[0] + 1


@functools.lru_cache(maxsize=256)
def _made(spark: SparkSession, sf_dir: str, what: str, chunks: tuple, version: int, options: tuple) -> str:
    shape = (_extent(spark, sf_dir, *KEYS[what]),) if what != "Q" else (_extent(spark, sf_dir, "part", "p_partkey"), _extent(spark, sf_dir, "supplier", "s_suppkey"))
    shape = (*shape, 64) if what == "E" else shape
    chunks = packed(chunks, shape, MOST_SHARDS, SHARD_CELLS) if options is SMALL else chunks
    build = SpecBuilder(version).with_shape(*shape).with_dtype(TYPES[what]).with_chunks(*chunks)
    for method, args in options:
        build = getattr(build, method)(*args) if not isinstance(args, dict) else getattr(build, method)(**args)
    path = f"{work_folder(spark, f'array-{what}')}/array"
    Array.create(path, build).write_cells(_cells(spark, sf_dir, what), whole=True, combine=F.sum if what == "Q" else None)
    return path


def array(spark: SparkSession, sf_dir: str, what: str, chunks: tuple, version: int = 3, options: tuple = ()) -> Array:
    path = _made(spark, sf_dir, what, chunks, version, options)
    return Array.open(path)


def _small_chunks(c):
    """The index needs no checksum of its own: that of the whole shard covers it."""
    return c.sharding(8, 8, index_codecs=[{"name": "bytes", "configuration": {"endian": "little"}}]).zstd(3)


#: Of parts and suppliers few cells are set: chunks are small, compressed, and lie in shards, not in files of their own.
SMALL = (("with_codecs", (_small_chunks,)),)
#: Shards of small chunks hold more of them where there would be more shards than this, up to so many cells each.
MOST_SHARDS, SHARD_CELLS = 10_000, 1 << 24

E_SQL = "SELECT vec_id AS d0, CAST(i - 1 AS BIGINT) AS d1, embedding[i] AS value FROM embeddings, range(1, 65) t(i)"
P_SQL = "SELECT o_orderkey AS d0, o_totalprice AS value FROM orders"
V_SQL = "SELECT event_id AS d0, value FROM events"
S_SQL = "SELECT p_partkey AS d0, CAST(p_size AS SMALLINT) AS value FROM part"
Q_SQL = """SELECT p_partkey AS d0, s_suppkey AS d1, coalesce(q, 0) AS value FROM part CROSS JOIN supplier
           LEFT JOIN (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) ON p_partkey = l_partkey AND s_suppkey = l_suppkey"""


@query(E_SQL)
def read_full(spark, sf_dir):
    return array(spark, sf_dir, "E", (128, 16)).cells(spark)


@query(f"SELECT * FROM ({E_SQL}) WHERE d0 BETWEEN 100 AND 199 AND d1 < 20")
def read_cutout(spark, sf_dir):
    return array(spark, sf_dir, "E", (128, 16)).cells(spark).where("d0 BETWEEN 100 AND 199 AND d1 < 20")


@query(f"SELECT * FROM ({E_SQL}) WHERE d0 >= 37 AND d0 < 301 AND d1 >= 5 AND d1 < 49")
def read_cutout_unaligned(spark, sf_dir):
    return array(spark, sf_dir, "E", (128, 16)).access().with_offset(37, 5).with_shape(264, 44).cells(spark)


@query(f"SELECT * FROM ({E_SQL}) WHERE d0 >= 128 AND d0 < 256 AND d1 >= 16 AND d1 < 32")
def read_chunk(spark, sf_dir):
    return array(spark, sf_dir, "E", (128, 16)).cells(spark, (128, 16), (128, 16))


@query(f"SELECT * FROM ({E_SQL}) WHERE d0 >= (SELECT max(vec_id) // 128 * 128 FROM embeddings) AND d1 >= 48")
def read_edge_chunk(spark, sf_dir):
    a = array(spark, sf_dir, "E", (128, 16))
    at0 = (a.spec.shape[0] - 1) // 128 * 128
    return a.cells(spark).where((F.col("d0") >= at0) & (F.col("d1") >= 48))


@query(f"""SELECT d0 // 128 AS c0, d1 // 16 AS c1, min(d0) AS o0, min(d1) AS o1, count(*) AS n,
           round(sum(CAST(value AS DOUBLE)), 4) AS total FROM ({E_SQL}) GROUP BY 1, 2""")
def read_blocks(spark, sf_dir):
    b = array(spark, sf_dir, "E", (128, 16)).blocks(spark)
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return b.select(F.col("chunk_coords")[0].alias("c0"), F.col("chunk_coords")[1].alias("c1"), F.col("origin")[0].alias("o0"), F.col("origin")[1].alias("o1"), F.size("values").cast("long").alias("n"), F.round(total, 4).alias("total"))


@query("SELECT 'c/' || c0 || '/' || c1 AS key, CAST(128 * 16 * 4 AS BIGINT) AS nbytes FROM (SELECT DISTINCT vec_id // 128 AS c0 FROM embeddings) CROSS JOIN range(4) t(c1)")
def read_raw_chunks(spark, sf_dir):
    return array(spark, sf_dir, "E", (128, 16)).chunks(spark).select("key", "nbytes")


@query("SELECT a AS c0, b AS c1 FROM range(37 // 30, (37 + 300 - 1) // 30 + 1) t(a) CROSS JOIN range(5 // 7, (5 + 40 - 1) // 7 + 1) u(b)")
def chunk_grid(spark, sf_dir):
    return grid_frame(spark, (30, 7), (37, 5), (300, 40))


@query("""SELECT a AS c0, greatest(0, 37 - a * 30) AS chunk_offset, greatest(0, a * 30 - 37) AS out_offset,
          least(30, 337 - a * 30) - greatest(0, 37 - a * 30) AS extent FROM range(37 // 30, 336 // 30 + 1) t(a)""")
def chunk_projection(spark, sf_dir):
    p = projected(grid_frame(spark, (30,), (37,), (300,)), (30,), (37,), (300,))
    return p.select("c0", *(F.col(c)[0].alias(c) for c in ("chunk_offset", "out_offset", "extent")))


@query(Q_SQL)
def fill_missing(spark, sf_dir):
    return array(spark, sf_dir, "Q", (512, 128), options=SMALL).filled_cells(spark)


@query("SELECT CAST(d AS BIGINT) AS d0, coalesce(toxic = 1, FALSE) AS value FROM (SELECT DISTINCT doc_id AS d FROM documents) LEFT JOIN labels ON d = doc_id")
def fill_missing_bool(spark, sf_dir):
    return array(spark, sf_dir, "B", (100,)).cells(spark)


@query("SELECT DISTINCT 'c/' || (l_partkey // 8) || '/' || (l_suppkey // 8) AS key FROM lineitem")
def chunk_elision(spark, sf_dir):
    return array(spark, sf_dir, "Q", (512, 128), options=SMALL).chunks(spark, inner=True, stored=True, payload=False).select("key")


def _copied(spark, sf_dir, what, chunks, *options) -> Array:
    """A new array of its own, for queries that change it."""
    _made.cache_clear()
    return array(spark, sf_dir, what, chunks, 3, options)


@query(f"SELECT d0, CASE WHEN d0 >= 150 AND d0 < 450 THEN -d0 ELSE value END AS value FROM ({P_SQL})")
def write_overlay(spark, sf_dir):
    a = _copied(spark, sf_dir, "P", (100,))
    a.write_cells(spark.range(150, 450).selectExpr("id AS d0", "-CAST(id AS DOUBLE) AS value"))
    return Array.open(a.handle).cells(spark)


@query(f"SELECT d0 + 1000 AS d0, value FROM ({V_SQL}) UNION ALL SELECT i, CAST(-1 AS DOUBLE) FROM range(1000) t(i)")
def write_offset(spark, sf_dir):
    n = _extent(spark, sf_dir, *KEYS["V"])
    a = Array.create(f"{work_folder(spark, 'offset')}/array", SpecBuilder().with_shape(n + 1000).with_dtype("float64").with_chunks(700).with_fill(-1))
    a.write_cells(_cells(spark, sf_dir, "V").withColumn("d0", F.col("d0") + 1000), whole=True)
    return a.cells(spark)


@query(f"SELECT * FROM ({P_SQL}) UNION ALL SELECT i, CAST(0 AS DOUBLE) FROM range((SELECT max(o_orderkey) + 1 FROM orders), (SELECT max(o_orderkey) + 501 FROM orders)) t(i)")
def resize_grow(spark, sf_dir):
    a = _copied(spark, sf_dir, "P", (1000,))
    return a.resize((a.spec.shape[0] + 500,)).cells(spark)


@query(f"SELECT * FROM ({P_SQL}) WHERE d0 < 777")
def resize_shrink(spark, sf_dir):
    return _copied(spark, sf_dir, "P", (100,)).resize((777,), metadata_only=False, spark=spark).cells(spark)


@query(f"SELECT d0, CASE WHEN d0 < 777 THEN value ELSE 9 END AS value FROM ({P_SQL}) WHERE d0 < 1000")
def resize_trim_regrow(spark, sf_dir):
    a = _copied(spark, sf_dir, "P", (100,), ("with_fill", (9,)))
    return a.resize((777,), metadata_only=False, spark=spark).resize((1000,)).cells(spark)


def _codec(name: str, what: str, sql: str, chunks: tuple, build, version: int = 3) -> None:
    options = (("with_codecs", (build,)),) if version == 3 else build

    def run(spark, sf_dir):
        return array(spark, sf_dir, what, chunks, version, options).cells(spark)

    query(sql, name)(run)


_codec("codec_bytes_big", "P", P_SQL, (999,), lambda c: c.bytes("big"))
_codec("codec_gzip", "P", P_SQL, (999,), lambda c: c.gzip())
_codec("codec_zstd", "V", V_SQL, (999,), lambda c: c.zstd())
_codec("codec_crc32c", "S", S_SQL, (256,), lambda c: c.crc32c())
for _cname, _how in (("lz4", "shuffle"), ("zstd", "bitshuffle"), ("zlib", "noshuffle"), ("lz4hc", "shuffle"), ("blosclz", "shuffle")):
    _codec(f"codec_blosc_{_cname}", "P", P_SQL, (999,), functools.partial(lambda c, n, h: c.blosc(n, h), n=_cname, h=_how))
_codec("codec_transpose", "E", E_SQL, (128, 16), lambda c: c.transpose(1, 0).zstd())
_codec("codec_reshape", "E", E_SQL, (128, 16), lambda c: c.reshape([0, 1]).gzip())
_codec("shard_full", "E", E_SQL, (128, 64), lambda c: c.sharding(32, 16, codecs=lambda d: d.zstd()))
_codec("shard_nested", "E", E_SQL, (128, 64), lambda c: c.sharding(64, 32, codecs=lambda d: d.sharding(16, 8), index_location="start"))
_codec("v2_read", "P", P_SQL, (999,), (("with_compressor", ("zlib",)),), 2)
_codec("v2_blosc", "V", V_SQL, (999,), (("with_compressor", ("blosc",)),), 2)
_codec("v2_fortran_order", "E", E_SQL, (128, 16), (("with_order", ("F",)), ("with_compressor", ("zstd",))), 2)
_codec("v2_big_endian", "P", P_SQL, (999,), (("with_dtype", (">f8",)),), 2)


@query(f"SELECT * FROM ({E_SQL}) WHERE d0 BETWEEN 100 AND 140 AND d1 BETWEEN 10 AND 20")
def shard_cutout(spark, sf_dir):
    a = array(spark, sf_dir, "E", (128, 64), 3, (("with_codecs", (_SHARDED,)),))
    return a.cells(spark).where("d0 BETWEEN 100 AND 140 AND d1 BETWEEN 10 AND 20")


def _SHARDED(c):
    return c.sharding(32, 16, codecs=lambda d: d.blosc("lz4", "shuffle"))


@query("SELECT DISTINCT (o_orderkey // 999) || '' AS key FROM orders")
def v2_chunk_keys(spark, sf_dir):
    return array(spark, sf_dir, "P", (999,), 2, (("with_compressor", ("zlib",)),)).chunks(spark).select("key")


#: Type, how a cell comes from p_size in Spark and in SQL.
_CASTS = {
    "bool": ("CAST(p_size % 2 = 0 AS BOOLEAN)", "p_size % 2 = 0"), "int8": ("CAST(p_size - 25 AS TINYINT)", "CAST(p_size - 25 AS TINYINT)"), "int16": ("CAST(p_size * -600 AS SMALLINT)", "CAST(p_size * -600 AS SMALLINT)"),
    "int32": ("p_size * -40000000", "p_size * -40000000"), "int64": ("CAST(p_size AS BIGINT) * -100000000000", "CAST(p_size AS BIGINT) * -100000000000"), "uint8": ("CAST(p_size * 5 AS SMALLINT)", "CAST(p_size * 5 AS SMALLINT)"),
    "uint16": ("p_size * 1300", "p_size * 1300"), "uint32": ("CAST(p_size AS BIGINT) * 85000000", "CAST(p_size AS BIGINT) * 85000000"), "uint64": ("CAST(CAST(p_size AS DECIMAL(20,0)) * 300000000000000000 AS DECIMAL(20,0))", "CAST(CAST(p_size AS DECIMAL(20,0)) * 300000000000000000 AS DECIMAL(20,0))"),
    "float32": ("CAST(p_size / 4.0 AS FLOAT)", "CAST(p_size / 4.0 AS FLOAT)"), "float64": ("CAST(p_retailprice AS DOUBLE)", "CAST(p_retailprice AS DOUBLE)"),
}


def _typed(dtype: str, spark_expr: str, sql_expr: str) -> None:
    def run(spark, sf_dir):
        n = _extent(spark, sf_dir, "part", "p_partkey")
        a = Array.create(f"{work_folder(spark, 'typed')}/array", SpecBuilder().with_shape(n).with_dtype(dtype).with_chunks(300))
        a.write_cells(table(spark, sf_dir, "part").selectExpr("p_partkey AS d0", f"{spark_expr} AS value"))
        cells = a.cells(spark)
        return cells.withColumn("value", F.col("value").cast("string")) if dtype == "uint64" else cells

    sql_expr = f"CAST({sql_expr} AS VARCHAR)" if dtype == "uint64" else sql_expr
    query(f"SELECT p_partkey AS d0, {sql_expr} AS value FROM part", f"dtype_{dtype}")(run)


for _name, _how in _CASTS.items():
    _typed(_name, *_how)


@query(E_SQL)
def rechunk(spark, sf_dir):
    spec = SpecBuilder().with_shape(1, 64).with_dtype("float32").with_chunks(50, 64).with_codecs([{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd"}]).build()
    return array(spark, sf_dir, "E", (128, 16)).rechunked(f"{work_folder(spark, 'rechunk')}/array", spec, spark).cells(spark)


@query(f"SELECT d1, round(avg(CAST(value AS DOUBLE)), 6) AS mean, min(value) AS low, max(value) AS high, count(*) AS n FROM ({E_SQL}) GROUP BY d1")
def array_group_stats(spark, sf_dir):
    cells = array(spark, sf_dir, "E", (128, 16)).cells(spark)
    return cells.groupBy("d1").agg(F.round(F.avg(F.col("value").cast("double")), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


@query("SELECT label, round(sum(CAST(embedding[1] AS DOUBLE)), 5) AS total, count(*) AS n FROM embeddings GROUP BY label")
def array_join_dim(spark, sf_dir):
    first = array(spark, sf_dir, "E", (128, 16)).cells(spark).where("d1 = 0")
    joined = first.join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), F.col("d0") == F.col("vec_id"))
    return joined.groupBy("label").agg(F.round(F.sum(F.col("value").cast("double")), 5).alias("total"), F.count("*").alias("n"))


@query(f"SELECT d0, value FROM ({P_SQL}) ORDER BY value DESC, d0 LIMIT 25")
def array_topk(spark, sf_dir):
    return array(spark, sf_dir, "P", (999,)).cells(spark).orderBy(F.desc("value"), "d0").limit(25)


@query("SELECT l_partkey AS d0, l_suppkey AS d1, sum(l_quantity) AS value, rank() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC) AS place FROM lineitem GROUP BY 1, 2 QUALIFY place <= 3")
def array_window(spark, sf_dir):
    from pyspark.sql import Window

    cells = array(spark, sf_dir, "Q", (512, 128), options=SMALL).cells(spark, stored=True, slowest=1).where("value <> 0")
    return cells.withColumn("place", F.rank().over(Window.partitionBy("d1").orderBy(F.desc("value")))).where("place <= 3").withColumn("place", F.col("place").cast("long"))


_PART = "(d // (d // 512 + 1))"


@query(f"SELECT d AS size, CASE WHEN d // 512 = 0 THEN d WHEN d % {_PART} = 0 THEN {_PART} ELSE {_PART} + 1 END AS chunk FROM (SELECT p_partkey * 7 + 1 AS d FROM part)")
def default_chunks(spark, sf_dir):
    def run(batches):
        for batch in batches:
            chunks = [meta.default_chunks((d,))[0] for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chunks, pa.int64())], ["size", "chunk"])

    return table(spark, sf_dir, "part").selectExpr("CAST(p_partkey * 7 + 1 AS BIGINT) AS size").mapInArrow(run, "size long, chunk long")


@query(f"SELECT d1 AS d0, d0 AS d1, value FROM ({E_SQL})")
def cells_transposed(spark, sf_dir):
    return fc.transposed(array(spark, sf_dir, "E", (128, 16)).cells(spark), ["d0", "d1"], [1, 0])


@query(f"SELECT d0 * 4 + d1 // 16 AS d0, d1 % 16 // 4 AS d1, d1 % 4 AS d2, value FROM ({E_SQL})")
def cells_reshaped(spark, sf_dir):
    a = array(spark, sf_dir, "E", (128, 16))
    n = a.spec.shape[0]
    return fc.reshaped(a.cells(spark), ["d0", "d1"], (n, 64), (4 * n, 4, 4))


@query(f"SELECT d0 // 8 AS c0, d1 // 8 AS c1, bool_and(value = 0) AS empty FROM ({Q_SQL}) GROUP BY 1, 2")
def blocks_all_equal(spark, sf_dir):
    return array(spark, sf_dir, "Q", (512, 128), options=SMALL).equal_blocks(spark, 0.0, inner=True).withColumnRenamed("equal", "empty")


@query("SELECT 'other chunks' AS against, TRUE AS same UNION ALL SELECT 'other cells', NOT bool_or(p_partkey % 7 = 0) FROM part")
def arrays_equal(spark, sf_dir):
    first = array(spark, sf_dir, "P", (999,), 3, (("with_codecs", (_GZIPPED,)),))
    plain, parts = first.cells(spark), parts_of(spark, 2 * first.spec.shape[0])
    other = array(spark, sf_dir, "P", (500,)).cells(spark)
    changed = other.withColumn("value", F.when((F.col("d0") % 7 == 0) & (F.col("d0") > 0), F.col("value") + 1).otherwise(F.col("value")))
    cases = {"other chunks": other, "other cells": changed}
    one, two = (fc.same_cells(plain, other, parts).select(F.lit(name).alias("against"), "same") for name, other in cases.items())
    return one.unionByName(two)


def _GZIPPED(c):
    return c.gzip()


_REGION, _NATION = "replace(r_name, ' ', '_')", "replace(n_name, ' ', '_')"


def _hierarchy(spark, sf_dir) -> str:
    """A group for each region and in it an array for each of its nations."""
    root = work_folder(spark, "hierarchy")
    own = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = own.selectExpr(f"{_REGION} AS region", "r_regionkey", f"{_NATION} AS nation", "n_nationkey").collect()  # tables of fixed size
    top = Group.create(root, {"about": "regions"})
    for region, key in sorted({(r.region, r.r_regionkey) for r in rows}):
        keys = sorted(r.n_nationkey for r in rows if r.region == region)
        group = top.create_group(region, {"title": region.lower(), "key": key, "share": key / 4, "even": key % 2 == 0, "nations": keys, "first": {"nation": keys[0]}})
        for r in rows:
            if r.region == region:
                group.create_array(r.nation, SpecBuilder().with_shape(r.n_nationkey + 1, 30).with_dtype("int16").with_chunks(4, 11))
    return root


@query(f"""SELECT '' AS path, 'group' AS node_type, 3 AS zarr_format, NULL AS data_type, NULL AS shape UNION ALL SELECT {_REGION}, 'group', 3, NULL, NULL FROM region
    UNION ALL SELECT {_REGION} || '/' || {_NATION}, 'array', 3, 'int16', (n_nationkey + 1) || 'x30' FROM nation JOIN region ON n_regionkey = r_regionkey""")
def list_nodes(spark, sf_dir):
    shape = F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape")
    return nodes(spark, _hierarchy(spark, sf_dir)).select("path", "node_type", "zarr_format", "data_type", shape)


@query(f"""SELECT lower({_REGION}) AS title, CAST(r_regionkey AS INTEGER) AS key, r_regionkey / 4.0::DOUBLE AS share, r_regionkey % 2 = 0 AS even, CAST(sum(n_nationkey) AS BIGINT) AS total,
    CAST(min(n_nationkey) AS INTEGER) AS first, CAST(NULL AS INTEGER) AS missing FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey""")
def attributes_get(spark, sf_dir):
    a = F.col("attributes")
    total = F.aggregate(at.get_array(a, "nations", "bigint"), F.lit(0).cast("long"), lambda s, x: s + x)
    plain = (at.get_string(a, "title").alias("title"), at.get_int(a, "key").alias("key"), at.get_double(a, "share").alias("share"), at.get_boolean(a, "even").alias("even"))
    groups = nodes(spark, _hierarchy(spark, sf_dir)).where("node_type = 'group' AND path <> ''")
    return groups.select(*plain, total.alias("total"), at.get_int(a, "first.nation").alias("first"), at.get_int(a, "none").alias("missing"))


@query(f"SELECT {_REGION} AS path, CAST(r_regionkey * 10 AS INTEGER) AS key, 'seen' AS mark, NULL AS share FROM region")
def attributes_changed(spark, sf_dir):
    """Set, updated and deleted in columns, then written to the groups and read again."""
    root = _hierarchy(spark, sf_dir)
    a = F.col("attributes")
    changed = at.delete_attribute(at.set_attribute(at.set_attribute(a, "mark", F.lit('"seen"')), "key", (at.get_int(a, "key") * 10).cast("string")), "share")
    for r in nodes(spark, root).where("node_type = 'group' AND path <> ''").select("path", changed.alias("new")).collect():
        Group.open(f"{root}/{r.path}").set_attributes(json.loads(r.new))
    again = nodes(spark, root).where("node_type = 'group' AND path <> ''")
    return again.select("path", at.get_int(a, "key").alias("key"), at.get_string(a, "mark").alias("mark"), at.get_string(a, "share").alias("share"))


@query("SELECT 'R' || n_regionkey || '/C' || n_nationkey AS path, 'R' || n_regionkey AS row_name, 'C' || n_nationkey AS column_name, CAST(n_regionkey AS INTEGER) AS row_index, CAST(n_nationkey AS INTEGER) AS column_index FROM nation")
def plate_wells(spark, sf_dir):
    wells = [(r.n_regionkey, r.n_nationkey) for r in table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").collect()]  # a table of fixed size
    rows, columns = ([f"{c}{k}" for k in range(max(w[i] for w in wells) + 1)] for i, c in enumerate("RC"))
    return Plate.create(work_folder(spark, "plate"), rows, columns, [f"R{r}/C{c}" for r, c in wells], "nations").wells(spark)


@query("""SELECT CAST(k AS INTEGER) AS level, 'z' || k AS path, (n // (1 << k) + 1) || 'x' || (40 // (1 << k)) AS shape, (0.75 * (1 << k))::DOUBLE || ',' || (1.25 * (1 << k))::DOUBLE AS scale
    FROM (SELECT CAST(max(s_suppkey) AS INTEGER) AS n FROM supplier), (SELECT CAST(range AS INTEGER) AS k FROM range(4))""")
def image_levels(spark, sf_dir):
    n = _extent(spark, sf_dir, "supplier", "s_suppkey") - 1
    image = MultiscaleImage.create(work_folder(spark, "image"), [{"name": "row", "type": "space"}, {"name": "col", "type": "space"}])
    for k in range(4):
        spec = SpecBuilder().with_shape((n >> k) + 1, 40 >> k).with_dtype("uint16").with_chunks(9, 10).build()
        image.create_level(f"z{k}", spec, [{"type": "scale", "scale": [0.75 * (1 << k), 1.25 * (1 << k)]}])
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), "x" if c == "shape" else ",").alias(c)
    return MultiscaleImage.open(image.group.handle).levels(spark).select("level", "path", joined("shape"), joined("scale"))


#: What a transform of ``_scene`` is made of: its type, whether it has the ends, its path.
_SCENE_PARTS = (("sequence", True, None), ("rotation", False, None), ("bijection", False, None), ("affine", False, "maps/out"), ("affine", False, "maps/back"))
_SCENE_VALUES = ", ".join(f"('{t}', {ends}, {repr(path) if path else 'NULL'})" for t, ends, path in _SCENE_PARTS)


def _scene(spark, sf_dir) -> Scene:
    """An image for each region, with a transform to the whole; one more that leads nowhere."""
    root = work_folder(spark, "scene")
    axes = [{"name": "row", "type": "space"}, {"name": "col", "type": "space"}]
    names = [r.name for r in table(spark, sf_dir, "region").selectExpr(f"{_REGION} AS name").collect()]  # a table of fixed size
    for name in names:
        MultiscaleImage.create(f"{root}/{name}", axes, "views", "0.6")
    own = MultiscaleImage.open(f"{root}/{names[0]}").document["multiscales"][0]["coordinateSystems"][0]["name"]
    inner = [{"type": "rotation"}, {"type": "bijection", "forward": {"type": "affine", "path": "maps/out"}, "inverse": {"type": "affine", "path": "./maps/back"}}]
    steps = [{"type": "sequence", "name": f"to_{n}", "input": f"{n}#{own}", "output": {"name": "globe"}, "transformations": inner} for n in names]
    return Scene.create(root, [{"name": "globe", "axes": axes}], [*steps, {"type": "identity", "input": "moon#own", "output": "globe"}])


@query(f"""SELECT 'to_' || {_REGION} AS name, type, CASE WHEN ends THEN {_REGION} END AS source, CASE WHEN ends THEN '.#globe' END AS target, path FROM region, (VALUES {_SCENE_VALUES}) t(type, ends, path)
    UNION ALL SELECT NULL, 'identity', NULL, '.#globe', NULL""")
def scene_graph_edges(spark, sf_dir):
    edges = _scene(spark, sf_dir).graph(spark)[1]
    return edges.select("name", "type", F.substring_index("source", "#", 1).alias("source"), "target", "path")


@query(f"SELECT {_REGION} AS path, 'row,col' AS axes FROM region UNION ALL SELECT '.', 'row,col'")
def scene_graph_nodes(spark, sf_dir):
    return _scene(spark, sf_dir).graph(spark)[0].select("path", F.array_join("axes", ",").alias("axes"))


@query("SELECT 'input' AS side, 'moon#own' AS reference")
def scene_graph_warnings(spark, sf_dir):
    return _scene(spark, sf_dir).graph(spark)[2].select("side", "reference")
