import json
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.__main__ import main
from gridloom.errors import GridError, MissingNode
from gridloom.functions import cells as fc
from gridloom.meta import DTYPES, ArraySpec, SpecBuilder
from gridloom.operators.array import Array
from gridloom.operators.hierarchy import Group, nodes, open_node
from gridloom.sources import sink
from gridloom.sources.stores import MemoryStore


def cube(dtype, n=4096, shape=(16, 16, 16)):
    i = np.arange(n)
    return ((i % 2 == 0) if dtype == "bool" else i.astype(DTYPES[dtype][0])).reshape(shape)


def spec(dtype="uint32", shape=(16, 16, 16), chunks=(2, 4, 8), version=3, **more):
    own = SpecBuilder(version).with_shape(*shape).with_dtype(dtype).with_chunks(*chunks)
    return ArraySpec(**{**{k: getattr(own.build(), k) for k in own.build().__dataclass_fields__}, **more})


BYTES = {"name": "bytes", "configuration": {"endian": "little"}}
INDEX = [BYTES, {"name": "crc32c"}]


def sharding(inner, codecs, where="end"):
    return {"name": "sharding_indexed", "configuration": {"chunk_shape": inner, "codecs": codecs, "index_codecs": INDEX, "index_location": where}}


PIPELINES = [
    [BYTES], [{"name": "bytes", "configuration": {"endian": "big"}}], [BYTES, {"name": "gzip", "configuration": {"level": 5}}], [BYTES, {"name": "zstd", "configuration": {"level": 0, "checksum": True}}], [BYTES, {"name": "crc32c"}],
    *([BYTES, {"name": "blosc", "configuration": {"cname": c, "shuffle": s, "clevel": 6, "typesize": 4, "blocksize": 0}}] for c in ("blosclz", "lz4", "lz4hc", "zlib", "zstd") for s in ("noshuffle", "shuffle", "bitshuffle")),
    [{"name": "transpose", "configuration": {"order": [1, 0, 2]}}, BYTES], [{"name": "reshape", "configuration": {"shape": [[0, 1], -1]}}, BYTES],
    [sharding([2, 2, 4], [BYTES], "start")], [sharding([2, 2, 4], [BYTES, {"name": "zstd"}])], [sharding([2, 2, 4], [sharding([2, 1, 2], [BYTES])])],
    [{"name": "transpose", "configuration": {"order": [2, 1, 0]}}, sharding([4, 4, 1], [BYTES])],
]


@pytest.mark.parametrize("codecs", PIPELINES)
def test_codecs_round_trip(tmp_path, codecs):
    array = Array.create(str(tmp_path), spec(codecs=tuple(codecs)))
    array.write(cube("uint32"))
    again = Array.open(str(tmp_path))
    assert (again.read() == cube("uint32")).all()
    assert (again.read((3, 5, 7), (6, 9, 8)) == cube("uint32")[3:9, 5:14, 7:15]).all()
    assert json.loads(again.spec.to_json()) == json.loads(array.spec.to_json())


@pytest.mark.parametrize("dtype", DTYPES)
def test_types_through_frames(spark, tmp_path, dtype):
    array = Array.create(str(tmp_path / "a"), spec(dtype))
    array.write(cube(dtype), spark=spark)
    assert (array.read(spark=spark) == cube(dtype)).all() and (array.read() == cube(dtype)).all()
    copy = Array.create(str(tmp_path / "b"), spec(dtype, chunks=(5, 5, 5), fill_value=1 if dtype != "bool" else True))
    copy.write_cells(array.cells(spark))
    assert (copy.read() == cube(dtype)).all()
    got = array.cells(spark).where("d0 >= 3 AND d0 < 5 AND d2 = 7").agg(F.count("*"), F.sum(F.col("value").cast("double"))).first()
    part = cube(dtype)[3:5, :, 7]
    assert tuple(got) == (part.size, float(part.astype(float).sum()))


# Chunks that divide the extent, don't, or exceed it; windows shorter than, as long as and longer than a chunk.
@pytest.mark.parametrize("more", [-1, 0, 5])
@pytest.mark.parametrize("chunk", [6, 8, 40])
def test_unaligned(tmp_path, chunk, more):
    shape, size = 36, chunk + more
    array = Array.create(str(tmp_path), spec(shape=(shape,), chunks=(chunk,)))
    data = np.arange(shape, dtype="u4")
    for at in range(0, shape, size):
        array.write(data[at : at + size], (at,))
    for at in range(shape - min(size, shape) + 1):
        assert (array.read((at,), (min(size, shape),)) == data[at : at + size]).all()


def test_partitions_are_pruned(spark, tmp_path):
    array = Array.create(str(tmp_path), spec(shape=(100, 100), chunks=(10, 10)))
    array.write(np.arange(10000, dtype="u4").reshape(100, 100))
    df = array.cells(spark, partition_bytes=1)
    assert df.rdd.getNumPartitions() == 100
    assert df.where("d0 >= 10 AND d0 < 30 AND d1 = 5").rdd.getNumPartitions() == 2
    assert sorted(r.value for r in df.where("d0 = 20 AND d1 > 97").collect()) == [2098, 2099]


def test_elision_overlay_and_edges(tmp_path):
    array = Array.create(str(tmp_path), spec("int32", (10, 10), (4, 4), fill_value=7))
    array.write(np.full((10, 10), 7, "i4"))
    assert array.handle.list() == ["zarr.json"]
    array.write(np.arange(4, dtype="i4").reshape(2, 2), (3, 3))
    assert sorted(array.handle.list()) == ["c/0/0", "c/0/1", "c/1/0", "c/1/1", "zarr.json"]
    want = np.full((10, 10), 7)
    want[3:5, 3:5] = [[0, 1], [2, 3]]
    assert (array.read() == want).all()
    array.write(np.full((2, 2), 7, "i4"), (3, 3))
    assert array.handle.list() == ["zarr.json"]
    assert (array.read_chunk((2, 2)) == 7).all() and array.read_chunk((2, 2)).shape == (4, 4)
    for bad in (lambda: array.read((8, 8), (3, 3)), lambda: array.read((-1, 0), (1, 1)), lambda: array.read((0,), (1,)), lambda: array.read_chunk((3, 0)), lambda: array.write(np.zeros(3, "i4")), lambda: array.access().with_shape(1, 1).read()):
        with pytest.raises(GridError):
            bad()
    assert (array.access().with_offset(3, 3).with_shape(2, 2).read() == 7).all()


@pytest.mark.parametrize("with_spark", [False, True])
def test_resize(spark, tmp_path, with_spark):
    data = np.arange(100, dtype="u4").reshape(10, 10) + 5
    array = Array.create(str(tmp_path), spec(shape=(10, 10), chunks=(5, 5), fill_value=99))
    array.write(data)
    grown = array.resize((20, 15))
    assert (grown.read((0, 0), (10, 10)) == data).all() and (grown.read((10, 0), (10, 15)) == 99).all()
    small = grown.resize((7, 7), metadata_only=False, spark=spark if with_spark else None)
    again = small.resize((10, 10)).read()
    assert (again[:7, :7] == data[:7, :7]).all() and (again[7:] == 99).all() and (again[:, 7:] == 99).all()
    Array.open(str(tmp_path)).resize((5, 5), metadata_only=False)
    assert sorted(array.handle.list()) == ["c/0/0", "zarr.json"]


def test_huge_sparse_array(spark, tmp_path):
    array = Array.create(str(tmp_path), spec("int32", (3_000_000_000,) * 2, (1000, 1000), fill_value=42))
    array.write(np.full((1, 1000), 100, "i4"))
    array.write(np.full((1, 1000), 200, "i4"), (1, 2**31))
    assert (array.read((1, 2**31), (1, 10)) == 200).all() and (array.read((2_000_000_000, 5), (2, 2)) == 42).all()
    assert array.cells(spark).where(f"d0 = 1 AND d1 BETWEEN {2**31} AND {2**31 + 9}").agg(F.sum("value")).first()[0] == 2000


def test_version_2(spark, tmp_path):
    for k, (dtype, order, sep, comp) in enumerate([(">i4", "C", ".", None), ("<f8", "F", "/", "zlib"), ("|u1", "C", "/", "zstd"), (">u2", "C", ".", "blosc")]):
        own = SpecBuilder(2).with_shape(15, 10).with_dtype(dtype).with_chunks(4, 5).with_order(order).with_compressor(comp)
        own = own.with_v2_keys(sep).with_attributes({"a": 1})
        array = Array.create(str(tmp_path / str(k)), own)
        data = np.arange(150).reshape(15, 10).astype(np.dtype(dtype).newbyteorder("="))
        assert (array.read() == 0).all()
        array.write(data)
        again = open_node(str(tmp_path / str(k)))
        assert (again.read() == data).all() and again.attributes == {"a": 1} and again.spec == array.spec
        assert again.handle.exists(f"3{sep}1") and (again.read((1, 2), (9, 8), spark=spark) == data[1:10, 2:10]).all()


def test_groups_nodes_and_attributes(spark, tmp_path):
    for store in (str(tmp_path), MemoryStore("m"), f"file://{tmp_path}/u"):
        root = Group.create(store, {"some": "value"})
        root.create_array("array", SpecBuilder().with_shape(8).with_dtype("uint8").with_attributes({"x": [1]}))
        sub = root.create_group("subgroup")
        sub.create_array("array", spec(shape=(4, 4), chunks=(2, 2)))
        assert [repr(n)[:10] for n in root.list()] == ["<v3.Array ", "<v3.Group ", "<v3.Array "]
        assert root.get("nothing") is None and root.get("subgroup", "array").spec.shape == (4, 4)
        got = {r.path: (r.node_type, r.zarr_format, r.shape, r.chunks, r.data_type) for r in nodes(spark, store).collect()}
        assert got == {"": ("group", 3, None, None, None), "array": ("array", 3, [8], [8], "uint8"), "subgroup": ("group", 3, None, None, None), "subgroup/array": ("array", 3, [4, 4], [2, 2], "uint32")}
        with pytest.raises(GridError):
            root.create_array("array", spec())
        old = root.get("array")
        new = old.update_attributes(lambda a: {**a, "y": 2})
        assert old.attributes == {"x": [1]} and new.attributes == {"x": [1], "y": 2} and Array.open(new.handle).attributes == new.attributes
        assert root.update_attributes(lambda a: a | {"t": True}) is root and Group.open(store).attributes == {"some": "value", "t": True}
        if store == str(tmp_path):
            for k in list(tmp_path.rglob("*")):
                assert ".tmp" not in k.name
            import shutil

            shutil.rmtree(tmp_path)
    with pytest.raises(MissingNode):
        open_node(str(tmp_path / "none"))


def test_memory_store_frames(spark):
    array = Array.create(MemoryStore("x"), spec(shape=(9, 9), chunks=(4, 4)))
    data = np.arange(81, dtype="u4").reshape(9, 9)
    array.write(data, spark=spark)
    assert (array.read(spark=spark) == data).all()
    other = Array.create(MemoryStore("y"), spec(shape=(9, 9), chunks=(9, 2)))
    assert other.write_cells(array.cells(spark)) == (5, 0) and (other.read() == data).all()


def test_rechunk_blocks_and_chunks(spark, tmp_path):
    array = Array.create(str(tmp_path / "a"), spec(shape=(9, 10), chunks=(4, 4), dimension_names=("y", "x")))
    data = np.arange(90, dtype="u4").reshape(9, 10)
    array.write(data)
    new = array.rechunked(str(tmp_path / "b"), spec(shape=(9, 10), chunks=(3, 10)), spark)
    assert (new.read() == data).all() and new.spec.grid == (3, 1)
    assert array.cells(spark).columns == ["y", "x", "value"] and array.blocks(spark).count() == 9
    raw = array.chunks(spark, (0, 0), (4, 5)).collect()
    assert sorted(r.key for r in raw) == ["c/0/0", "c/0/1"] and all(r.nbytes == 64 for r in raw)
    copy = Array.create(str(tmp_path / "c"), array.spec)
    assert copy.write_blocks(array.blocks(spark)) == (9, 0) and (copy.read() == data).all()


def test_command_line(tmp_path, capsys):
    Array.create(str(tmp_path), spec(shape=(2, 2), chunks=(2, 2))).write(np.arange(4, dtype="u4").reshape(2, 2))
    assert main(["--array_path", str(tmp_path)]) == 0 and "[2 3]" in capsys.readouterr().out
    assert main(["--array_path", str(tmp_path / "no")]) == 1


@pytest.mark.parametrize("rows", [[(0, 0), (10, 0)], [(0, 0), (0, 12)], [(0, 0), (-1, 0)], [(0, 0), (None, 0)]])
def test_cells_outside_raise_before_writing(spark, tmp_path, rows):
    array = Array.create(str(tmp_path), spec("int32", (10, 10), (4, 4), fill_value=7))
    with pytest.raises(Exception, match="outside the array"):
        array.write_cells(spark.createDataFrame([(*r, 1) for r in rows], "d0 long, d1 long, value int"))
    assert array.handle.list() == ["zarr.json"]


def test_blocks_outside_raise_before_writing(spark, tmp_path):
    array = Array.create(str(tmp_path), spec("int32", (10, 10), (4, 4), fill_value=7))
    for s in (None, spark):
        with pytest.raises(GridError):
            array.write(np.ones((4, 4), "i4"), (8, 8), spark=s)
    with pytest.raises(Exception, match="leave the array"):
        array.write_blocks(spark.createDataFrame([([8, 8], [4, 4], [1] * 16)], "origin array<long>, block_shape array<int>, values array<int>"))
    assert array.handle.list() == ["zarr.json"]


def test_repeated_cells_are_combined_before_the_chunks(spark, tmp_path, monkeypatch):
    array = Array.create(str(tmp_path), spec("int32", (8,), (4,), fill_value=7))
    monkeypatch.setattr(sink, "numpy_values", lambda values, s, own=sink.numpy_values: own(values, s) if len(values) <= 4 else 1 / 0)
    assert array.write_cells(spark.range(10000).selectExpr("id % 3 AS d0", "CASE WHEN id % 3 = 2 THEN NULL ELSE id END AS value")) == (1, 0)
    assert array.read().tolist() == [9999, 9997, 7, 7, 7, 7, 7, 7]


def test_a_filtered_frame_can_be_used_again(spark, tmp_path):
    array = Array.create(str(tmp_path), spec(shape=(90,), chunks=(10,)))
    array.write(np.arange(90, dtype="u4"))
    df = array.cells(spark)
    assert (df.where("d0 = 3").count(), df.where("d0 > 49").count(), df.count(), df.where("value = 7").count()) == (1, 40, 90, 1)
    assert array.cells(spark).where("d0 = 3").union(array.cells(spark).where("d0 > 49")).count() == 41


def sparse(spark, where, codecs, fill=0):
    """An array of 40 x 50 cells in chunks of 16 x 8, four of which are set; with its data."""
    data = np.full((40, 50), fill, np.uint32)
    for k, at in enumerate([(0, 0), (3, 9), (39, 49), (17, 8)]):
        data[at] = 7 + k
    array = Array.create(str(where), spec(shape=(40, 50), chunks=(16, 8), codecs=tuple(codecs), fill_value=fill))
    array.write(data)
    return array, data


@pytest.mark.parametrize("fill", [0, 5])
@pytest.mark.parametrize("codecs", [[BYTES], [BYTES, {"name": "zstd"}], [sharding([4, 4], [BYTES])]])
def test_scan_of_what_is_stored(spark, tmp_path, codecs, fill):
    array, data = sparse(spark, tmp_path, codecs, fill)
    want = {(int(a), int(b), int(data[a, b])) for a, b in np.argwhere(data != fill)}
    assert {tuple(r) for r in array.cells(spark, stored=True).collect()} == want
    some = array.cells(spark, (2, 5), (20, 10), stored=True, partition_bytes=1)
    assert {tuple(r) for r in some.collect()} == {w for w in want if 2 <= w[0] < 22 and 5 <= w[1] < 15}
    keys = {r.key for r in array.chunks(spark).where("payload is not null").collect()}
    assert {r.key for r in array.chunks(spark, stored=True).collect()} == keys and len(keys) == 4


@pytest.mark.parametrize("codecs", [[sharding([4, 4], [BYTES])], [sharding([4, 4], [BYTES], "start"), {"name": "zstd"}], [sharding([4, 4], [BYTES, {"name": "zstd"}])]])
def test_inner_chunks_as_rows(spark, tmp_path, codecs):
    array, data = sparse(spark, tmp_path, codecs)
    cut = {(a, b): data[a * 4 : a * 4 + 4, b * 4 : b * 4 + 4] for a in range(10) for b in range(13)}
    full = {k for k, v in cut.items() if v.any()}
    rows = array.blocks(spark, inner=True).collect()
    assert {tuple(r.chunk_coords): (r.origin, r.block_shape, r["values"]) for r in rows} == {k: ([4 * k[0], 4 * k[1]], list(v.shape), v.ravel().tolist()) for k, v in cut.items()} and len(rows) == 130
    assert {tuple(r.chunk_coords) for r in array.blocks(spark, inner=True, stored=True).collect()} == full
    held = array.chunks(spark, inner=True, stored=True).collect()
    assert {r.key for r in held} == {f"c/{a}/{b}" for a, b in full} and all(len(r.payload) == r.nbytes for r in held)
    assert {r.key for r in array.chunks(spark, inner=True, stored=True, payload=False).where("payload is null").collect()} == {r.key for r in held}
    for value in (0, 7):
        told = {(r.c0, r.c1): r.equal for r in array.equal_blocks(spark, value, inner=True).collect()}
        assert told == {k: bool((v == value).all()) for k, v in cut.items()}
    with pytest.raises(Exception, match="inner chunks"):
        Array.create(str(tmp_path / "plain"), spec()).blocks(spark, inner=True).collect()


def test_cells_written_in_one_shuffle(spark, tmp_path):
    """A frame that fills the array is shuffled by chunk alone; of repeated cells the largest stays, NaN above all."""
    array = Array.create(str(tmp_path), spec("float64", shape=(3000,), chunks=(1000,)))
    rows = spark.range(60000).selectExpr("id % 2500 AS d0", "CASE WHEN id % 2500 = 7 AND id < 2600 THEN double('NaN') ELSE CAST((id * 7919) % 60000 AS DOUBLE) END AS value")
    seen = []
    real = sink._finished
    sink._finished = lambda handle, done: seen.append(done._jdf.queryExecution().executedPlan().toString()) or real(handle, done)
    try:
        array.write_cells(rows, whole=True)
    finally:
        sink._finished = real
    want = np.zeros(3000)
    np.maximum.at(want, np.arange(60000) % 2500, (np.arange(60000) * 7919 % 60000).astype(float))
    want[7] = np.nan
    assert np.array_equal(array.read(), want, equal_nan=True) and seen[0].count("Exchange") == 1


def test_many_cells_are_dealt_to_many_tasks(spark, tmp_path):
    """What a task of a scan or a comparison holds does not grow with the array."""
    assert sink.parts_of(spark, 10) == 4 and sink.parts_of(spark, 100 * sink.PART_CELLS) == 100 and sink.parts_of(spark, 1 << 60) == sink.MOST_PARTS
    array = Array.create(str(tmp_path), spec("float64", shape=(1 << 26,), chunks=(1 << 20,)))
    assert array.cells(spark).rdd.getNumPartitions() == 16


def test_a_shard_costs_its_cells_not_its_extent(spark, tmp_path):
    """Shards of 2^40 cells, which no task could hold as a whole, are written, read and compared by their few cells."""
    codec = sharding([1 << 10, 1 << 10], [BYTES])
    codec["configuration"]["index_codecs"] = [BYTES]
    array = Array.create(str(tmp_path), spec("uint8", (1 << 20, 1 << 21), (1 << 20, 1 << 20), codecs=(codec, {"name": "zstd"})))
    want = {(3, 5, 7), (1 << 19, 9, 8), (5, (1 << 20) + 1, 9), (6, (1 << 21) - 1, 1)}
    assert array.write_cells(spark.createDataFrame([*want, (0, 0, 0)], "d0 long, d1 long, value int")) == (2, 0)
    assert {tuple(r) for r in array.cells(spark, stored=True).collect()} == want
    told = array.equal_blocks(spark, 0, inner=True)
    assert {(r.c0, r.c1) for r in told.where("not equal").collect()} == {(a >> 10, b >> 10) for a, b, _ in want} and told.distinct().count() == 1 << 21


@pytest.mark.parametrize("fill", [0, 5])
def test_shards_of_few_cells_are_as_those_of_whole_arrays(spark, tmp_path, fill):
    codecs = [sharding([4, 4], [BYTES]), {"name": "zstd"}]
    array, data = sparse(spark, tmp_path / "a", codecs, fill)
    other = Array.create(str(tmp_path / "b"), array.spec)
    some = [(int(a), int(b), int(data[a, b])) for a, b in np.argwhere(data != fill)]
    assert other.write_cells(spark.createDataFrame([*some, (8, 40, fill)], "d0 long, d1 long, value long"), whole=True) == (4, 1)
    assert other.handle.list() == array.handle.list() and all(other.handle.read(k) == array.handle.read(k) for k in array.handle.list())
    other.write_cells(spark.createDataFrame([(1, 1, 30), (3, 9, fill)], "d0 long, d1 long, value long"))
    data[1, 1], data[3, 9] = 30, fill
    assert (other.read() == data).all() and other.cells(spark, stored=True).count() == 4


@pytest.mark.parametrize("dtype, values, against", [("float32", [0.1, 0.0, np.nan], (0.1, 0.0, float("nan"))), ("uint64", [0, 1 << 63, 3], (0, 1 << 63, -1)), ("bool", [True, False, False], (True, False)), ("float64", [0.5, 0.0, -0.0], (0.5, 0.0))])
def test_equal_blocks_of_every_type(spark, tmp_path, dtype, values, against):
    """Against the rule in columns, on blocks and inner chunks, with cells left beyond the edge."""
    for inner, codecs in ((False, (BYTES,)), (True, (sharding([2, 3], [BYTES]),))):
        array = Array.create(f"{tmp_path}/{inner}", spec(dtype, (7, 11), (4, 6), codecs=codecs))
        data = np.zeros((7, 11), array.spec.numpy_dtype)
        data[:4, 2:6], data[3, 10], data[6, 6:], data[5, 0] = values[0], values[1], values[0], values[2]
        array.write(data)
        array = array.resize((6, 10))
        for value in against:
            rows = array.blocks(spark, inner=inner).select("chunk_coords", fc.all_equal(F.col("values"), value if dtype != "uint64" else Decimal(value)).alias("equal"))
            told = array.equal_blocks(spark, value, inner=inner).collect()
            assert {(r.c0, r.c1, r.equal) for r in told} == {(*r.chunk_coords, r.equal) for r in rows.collect()} and len(told) == rows.count()


@pytest.mark.parametrize("dtype, fill", [("float64", 0.5), ("float64", float("nan")), ("uint64", 3), ("bool", True)])
def test_filled_cells_are_all_cells(spark, tmp_path, monkeypatch, dtype, fill):
    """Equal to what a scan gives, also where bands of the last dimension are narrow, and where nothing is stored."""
    monkeypatch.setattr("gridloom.operators.array.BAND", 4)
    for codecs in ((BYTES,), (sharding([2, 3, 2], [BYTES]), {"name": "zstd"})):
        array = Array.create(f"{tmp_path}/{len(codecs)}", spec(dtype, (5, 3, 11), (4, 3, 6), codecs=codecs, fill_value=fill if fill == fill else "NaN"))
        assert array.filled_cells(spark).count() == 165
        array.write_cells(spark.createDataFrame([(0, 0, 0), (0, 0, 1), (0, 0, 10), (4, 2, 3), (4, 2, 4)], "d0 long, d1 long, d2 long").selectExpr("*", "d2 = 3 AS value" if dtype == "bool" else "d2 + 7 AS value"))
        one, two = array.filled_cells(spark), array.cells(spark)
        assert one.dtypes == two.dtypes and fc.same_cells(one, two).first().same


def test_fill_of_a_large_grid_is_not_scanned(spark, tmp_path):
    """Rows of 2^28 cells, two of which are set, come from their bands in seconds, and no task holds a chunk of that size."""
    array = Array.create(str(tmp_path), spec("float64", (2, 1 << 28), (1, 1 << 28), codecs=(sharding([1, 1 << 10], [BYTES]), {"name": "zstd"})))
    array.write_cells(spark.createDataFrame([(1, 5, 2.0), (1, (1 << 28) - 1, 3.0)], "d0 long, d1 long, value double"))
    got = array.filled_cells(spark).where("value <> 0 OR (d0 = 1 AND d1 BETWEEN 3 AND 7)").collect()
    assert {tuple(r) for r in got} == {(1, 3, 0.0), (1, 4, 0.0), (1, 5, 2.0), (1, 6, 0.0), (1, 7, 0.0), (1, (1 << 28) - 1, 3.0)}


def test_repeated_cells_are_summed_in_the_one_shuffle(spark, tmp_path, monkeypatch):
    """Sums of repeated cells need no shuffle of their own ahead of that by chunk; both ways of writing give them."""
    seen = []
    monkeypatch.setattr(sink, "_finished", lambda handle, done, own=sink._finished: seen.append(done._jdf.queryExecution().executedPlan().toString()) or own(handle, done))
    rows = spark.range(6000).selectExpr("id % 20 AS d0", "id % 30 AS d1", "IF(id % 60 = 7, NULL, id) AS value")
    want = np.zeros((20, 30))
    for i in range(6000):
        want[i % 20, i % 30] += i * (i % 60 != 7)
    for whole in (True, False):
        array = Array.create(f"{tmp_path}/{whole}", spec("float64", (20, 30), (8, 8), codecs=(sharding([2, 4], [BYTES]), {"name": "zstd"})))
        array.write_cells(rows, whole=whole, combine=F.sum)
        assert (array.read() == want).all()
    assert seen[0].count("Exchange") == 1


@pytest.mark.parametrize("codecs", [[BYTES], [sharding([4, 4], [BYTES]), {"name": "zstd"}]])
def test_partitions_of_whole_layers(spark, tmp_path, codecs):
    """Along the slowest dimension each partition holds all that is stored, in no other partition."""
    array, data = sparse(spark, tmp_path, codecs)
    want = {(int(a), int(b), int(data[a, b])) for a, b in np.argwhere(data)}
    for k, layers in ((0, 3), (1, 7)):
        rows = array.cells(spark, stored=True, slowest=k, partition_bytes=1)
        assert rows.rdd.getNumPartitions() == layers and {tuple(r) for r in rows.collect()} == want
        cut = array.cells(spark, slowest=k, partition_bytes=1).where("d1 BETWEEN 9 AND 30 AND d0 > 2")
        assert {tuple(r) for r in cut.collect()} == {(a, b, int(data[a, b])) for a in range(3, 40) for b in range(9, 31)}
        at = rows.select(F.floor(F.col(f"d{k}") / array.spec.chunks[k]).alias("layer"), F.spark_partition_id().alias("part")).distinct().collect()
        assert len(at) == len({r.layer for r in at}) == len({r.part for r in at})
    with pytest.raises(Exception, match="slowest"):
        array.cells(spark, slowest=2).collect()


def test_keys_of_inner_chunks_in_bulk(spark, tmp_path):
    """Keys are made as columns, not one by one, and as ``chunk_key`` makes them."""
    from gridloom.sources import ndarray

    coords = np.array([[0, 0, 0], [12, 3, 1 << 40]])
    for more in ({}, {"separator": "."}, {"key_encoding": "v2", "separator": "."}):
        own = spec(**more)
        assert ndarray._keys(coords, own).to_pylist() == [own.chunk_key(c) for c in coords.tolist()]
