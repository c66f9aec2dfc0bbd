import json
import math

import numpy as np
import pytest

from gridloom import grid
from gridloom.codecs import Codec, CodecBuilder, Crc32c, Pipeline, blosc, register_codec
from gridloom.codecs.checksum import _plain, crc32c
from gridloom.codecs.reshape import resolved, resolved_grid
from gridloom.errors import GridError
from gridloom.meta import ArraySpec, GroupSpec, SpecBuilder, default_chunks, parse_fill

BYTES = {"name": "bytes", "configuration": {"endian": "little"}}


def build(**more):
    own = {"shape": (8, 8), "dtype": "uint32", "chunks": (4, 4)} | more
    return ArraySpec(**own)


def test_fill_values():
    assert parse_fill("0x00010203", "uint32") == 50462976 and parse_fill("0b00000010", "uint8") == 2
    assert math.isnan(parse_fill("NaN", "float32")) and parse_fill("-Infinity", "float64") == -math.inf and parse_fill("+Infinity", "float32") == math.inf
    assert parse_fill(None, "int8") is None and parse_fill(300, "uint8") == 44 and parse_fill(2, "bool") and not parse_fill(256, "bool")
    assert parse_fill("0x0000c07f", "float32") != parse_fill("0x0000c07f", "float32")
    for value, dtype in (("Infinity", "float32"), ("NaN", "int32"), (True, "int8"), ("0x01", "uint32"), ("x", "float64"), ([], "int8")):
        with pytest.raises(GridError):
            parse_fill(value, dtype)


def test_default_chunks():
    assert [default_chunks(s) for s in ((100, 50), (2000, 1500), (1024, 100, 2048), (512,))] == [(100, 50), (500, 500), (342, 100, 410), (256,)]


@pytest.mark.parametrize("bad", [
    {"chunks": (4,)}, {"codecs": (BYTES, BYTES)}, {"codecs": ()}, {"codecs": ({"name": "gzip", "configuration": {"level": 1}}, BYTES)}, {"codecs": (BYTES, {"name": "transpose", "configuration": {"order": [1, 0]}})},
    {"codecs": (BYTES, {"name": "gzip", "configuration": {"level": 10}})}, {"codecs": (BYTES, {"name": "zstd", "configuration": {"level": 23}})}, {"codecs": (BYTES, {"name": "nothing"})}, {"codecs": ({"name": "bytes"},)},
    {"codecs": (BYTES, {"name": "blosc", "configuration": {"cname": "zstd", "shuffle": "shuffle", "clevel": 10, "typesize": 4}})}, {"codecs": (BYTES, {"name": "blosc", "configuration": {"cname": "zstd", "shuffle": "shuffle", "clevel": 1, "typesize": 0}})},
    *({"codecs": ({"name": "transpose", "configuration": {"order": o}}, BYTES)} for o in ([1, 0, 0], [1, 2, 3], [1, 2], [0])),
    *({"codecs": ({"name": "sharding_indexed", "configuration": {"chunk_shape": c, "codecs": [BYTES], "index_codecs": [BYTES]}},)} for c in ([4], [4, 4, 4], [3, 3], [8, 8], [2, 3])),
    {"codecs": ({"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 2], "codecs": [BYTES], "index_codecs": [BYTES], "index_location": "middle"}},)},
    {"storage_transformers": ({"name": "x"},)}, {"dtype": "float16"}, {"separator": "-"}, {"dimension_names": ("a",)}, {"fill_value": "Infinity"},
])
def test_invalid_arrays(bad):
    with pytest.raises(GridError):
        build(**bad)


def test_documents():
    spec = build(storage_transformers=(), dimension_names=("y", None), attributes={"a": {"b": [1]}}, fill_value="0x00010203")
    doc = json.loads(spec.to_json())
    assert ArraySpec.from_json(json.dumps(doc)) == spec and spec.dims == ["y", "d1"] and spec.fill == 50462976
    for change in ({"more": 1}, {"zarr_format": 4}, {"node_type": "group"}, {"chunk_grid": {"name": "other"}}):
        with pytest.raises(GridError):
            ArraySpec.from_json(json.dumps(doc | change))
    assert GroupSpec.from_json(GroupSpec(3, {"x": 1}).to_json()) == GroupSpec(3, {"x": 1})
    with pytest.raises(GridError):
        GroupSpec.from_json(json.dumps(doc))
    with pytest.raises(GridError):
        ArraySpec.from_json(json.dumps({"zarr_format": 2, "shape": [1], "chunks": [1], "dtype": "<c8", "fill_value": 0, "order": "C", "filters": None, "compressor": None}))
    assert [build(key_encoding=e, separator=s).chunk_key((1, 2)) for e, s in (("default", "/"), ("default", "."), ("v2", "."))] == ["c/1/2", "c.1.2", "1.2"]
    assert ArraySpec((), "int8", ()).chunk_key(()) == "c"


def test_builders():
    with pytest.raises(GridError):
        SpecBuilder().with_shape(4).build()
    with pytest.raises(GridError):
        SpecBuilder().with_shape(4).with_codecs(lambda c: c.gzip())
    spec = SpecBuilder().with_shape(600).with_dtype("int16").with_codecs(lambda c: c.transpose(0).gzip().crc32c()).with_attributes({"a": 1}).with_attributes({"b": 2}).build()
    assert [c["name"] for c in spec.codecs] == ["transpose", "bytes", "gzip", "crc32c"] and spec.attributes == {"a": 1, "b": 2} and spec.chunks == (300,)
    assert SpecBuilder.of(spec).build() == spec and SpecBuilder.of(spec, False).build().attributes is None
    assert SpecBuilder(2).with_shape(3).with_dtype(">i2").with_compressor("zlib").build().codecs == ({"id": "zlib", "level": 1},)
    assert CodecBuilder("float64").blosc().build()[1]["configuration"]["typesize"] == 8


@pytest.mark.parametrize("shape,wanted,out", [
    ((2, 3, 4), [[0, 1], [2]], (6, 4)), ((2, 3, 4), [[0, 1, 2]], (24,)), ((2, 3, 4), [-1], (24,)), ((4, 5, 6, 3), [[0, 1], [2], 3], (20, 6, 3)), ((6, 4), [2, 3, 4], (2, 3, 4)), ((4, 4), [1, [0], [1]], (1, 4, 4)),
    ((2, 3, 4), [6, -1], (6, 4)), ((2, 3, 4), [[0], -1], (2, 12)), ((2, 3, 4), [[0], [1], [2]], (2, 3, 4)), ((2, 3), [[0], [1], 1], (2, 3, 1)), ((2,) * 5, [-1], (32,)),
])
def test_reshape(shape, wanted, out):
    assert resolved(shape, wanted) == out
    pipeline = Pipeline([{"name": "reshape", "configuration": {"shape": wanted}}, BYTES], shape, np.dtype("<i4"), 0)
    a = np.arange(math.prod(shape), dtype="i4").reshape(shape)
    assert (pipeline.decode(pipeline.encode(a)) == a).all() and pipeline.encode(a) == a.tobytes()


@pytest.mark.parametrize("shape,wanted", [((2, 3), [5]), ((2, 3, 4), [7, -1]), ((2, 3, 4), [-1, -1]), ((2, 3), [0, 6]), ((2, 3), [-2, 3]), ((2, 3), [[1], [0]]), ((2, 3, 4), [[1, 0], [2]]), ((2, 3), [[0, 0]]), ((2, 3), [[5]]), ((2, 2, 2), [[2], 4]), ((2, 3), [])])
def test_reshape_invalid(shape, wanted):
    with pytest.raises(GridError):
        resolved(shape, wanted)


def test_reshape_grid():
    assert resolved_grid((8, 6), (4, 3), [[0, 1]]) == ((48,), (12,)) and resolved_grid((8, 6, 4), (4, 3, 4), [[0, 1], [2]]) == ((48, 4), (12, 4))


def test_checksum():
    assert crc32c(b"123456789") == 0xE3069283 and crc32c(b"") == 0 and crc32c(bytes(32)) == 0x8A9136AA
    data = bytes(np.random.default_rng(0).integers(0, 256, 50_003, np.uint8))
    assert crc32c(data) == _plain(data, 0xFFFFFFFF) ^ 0xFFFFFFFF


def test_codec_bytes():
    pipeline = Pipeline([{"name": "transpose", "configuration": {"order": [1, 2, 0]}}, BYTES, {"name": "crc32c"}], (2, 3, 3), np.dtype("<i4"), 0)
    data = pipeline.encode(np.arange(18, dtype="i4").reshape(2, 3, 3))
    assert np.frombuffer(data[:-4], "<i4").tolist()[:6] == [0, 9, 1, 10, 2, 11] and pipeline.encoded_size() == len(data) == 76
    with pytest.raises(GridError):
        pipeline.decode(data[:-1] + bytes([data[-1] ^ 1]))
    with pytest.raises(GridError):
        Pipeline([BYTES, {"name": "gzip"}], (2,), np.dtype("<i4"), 0).encoded_size()
    shard = {"chunk_shape": [2], "codecs": [BYTES], "index_codecs": [BYTES, {"name": "crc32c"}]}
    at_end, at_start = (Pipeline([{"name": "sharding_indexed", "configuration": shard | {"index_location": w}}], (4,), np.dtype("<u2"), np.uint16(7)).encode(np.asarray([1, 2, 7, 7], "u2")) for w in ("end", "start"))
    index = np.asarray([0, 4, 2**64 - 1, 2**64 - 1], "<u8").tobytes()
    assert at_end == b"\1\0\2\0" + index + crc32c(index).to_bytes(4, "little")
    assert at_start[-4:] == b"\1\0\2\0" and np.frombuffer(at_start[:32], "<u8").tolist()[:2] == [36, 4]


@pytest.mark.parametrize("name", blosc.NAMES)
@pytest.mark.parametrize("shuffle", ["noshuffle", "shuffle", "bitshuffle"])
def test_blosc(name, shuffle):
    for size in (1, 2, 8):
        for data in (b"", b"x", np.arange(9001, dtype="u4").tobytes()[:-3], bytes(np.random.default_rng(0).integers(0, 256, 5000, np.uint8))):
            assert blosc.decode(blosc.encode(data, name, 5, shuffle, size, 4096)) == data


def test_blosclz_stream():
    # three literals, a match of six from three back, one of eleven from one back, a last literal
    assert blosc._blosclz(bytes([2]) + b"abc" + bytes([0x80, 2, 0xE0, 3, 0, 0]) + b"z") == b"abcabcabc" + b"c" * 12 + b"z"


def test_own_codec():
    class Flip(Codec):
        def encode(self, data):
            return data[::-1]

        decode = encode

    register_codec("flip", Flip)
    spec = build(codecs=(BYTES, {"name": "flip"}))
    a = np.arange(16, dtype="u4").reshape(4, 4)
    assert (spec.pipeline().decode(spec.pipeline().encode(a)) == a).all() and spec.pipeline().encode(a) == a.tobytes()[::-1]
    assert Crc32c({}, (), None, None).encode(b"") == b"\0\0\0\0"


def test_geometry(spark):
    assert list(grid.chunk_coords((30, 30), (50, 20), (20, 1))) == [(1, 0), (2, 0)]
    assert list(grid.chunk_coords((1, 17), (0, 32), (1, 20))) == [(0, 1), (0, 2), (0, 3)]
    p = grid.projection((0, 2), (1, 17), (0, 32), (1, 20))
    assert (p.chunk_offset, p.out_offset, p.shape) == ((0, 0), (0, 2), (1, 17))
    assert grid.inverse_permutation([1, 2, 0]) == [2, 0, 1] and grid.inverse_permutation([0, 4, 2, 1, 3]) == [0, 3, 2, 4, 1]
    assert not grid.is_permutation([]) and not grid.is_permutation([1, 2])
    assert grid.is_full_chunk((0, 0), (2, 2), (2, 2)) and grid.is_single_full_chunk((2, 4), (2, 2), (2, 2)) and not grid.is_single_full_chunk((1, 0), (2, 2), (2, 2))
    assert next(grid.chunk_coords((1, 1), (0, 0), (100_000, 100_000))) == (0, 0)
    with pytest.raises(GridError):
        grid.copy_region(np.zeros((2, 2)), (1, 1), np.zeros((3, 3)), (0, 0), (2, 2))
    want = [(c, grid.projection(c, (3, 4), (2, 5), (7, 6))) for c in grid.chunk_coords((3, 4), (2, 5), (7, 6))]
    rows = grid.projected(grid.grid_frame(spark, (3, 4), (2, 5), (7, 6)), (3, 4), (2, 5), (7, 6)).collect()
    assert sorted(((r.c0, r.c1), tuple(r.chunk_offset), tuple(r.out_offset), tuple(r.extent)) for r in rows) == sorted((c, p.chunk_offset, p.out_offset, p.shape) for c, p in want)
