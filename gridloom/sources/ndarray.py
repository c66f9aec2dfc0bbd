"""The ``ndarray`` data source: an array's cells, blocks or chunks as rows.

``spark.read.format("ndarray").option("mode", "cells").load(path)``. Range predicates on the dimension columns become
a box of chunks: other chunks are neither listed nor read, and of shards only the inner chunks that are needed. A
partition is a range of positions in that box, so the driver holds two numbers for each, however many chunks there
are. Modes:

* ``cells``: a column for each dimension, and ``value``;
* ``blocks``: chunk_coords, origin, block_shape, values (in C order, of the part inside the array);
* ``equal``: chunk_coords, equal: whether all values of the block equal the option ``value`` (JSON), told where it is read;
* ``chunks``: chunk_coords, key, nbytes, payload; null payload for chunks that are not stored.

Option ``slowest`` (a dimension's number) lets partitions take whole layers of chunks along that dimension, so that a
task sees all that is stored for its part of it. Options ``offset`` and ``shape`` (comma-separated) select a cutout in any mode, ``coords=false`` leaves out the
dimension columns, ``partition_bytes`` sets how many bytes of chunks (of rows, in mode ``cells``) a partition takes.
``stored=true`` leaves out blocks and chunks that are not stored and, of cells, those that hold the fill value: only
stored chunks are looked at then, which folders tell by their listings. ``inner=true`` gives the inner chunks of shards
as rows of ``blocks``, ``equal`` and ``chunks``, with coordinates and keys in their own grid; ``payload=false`` leaves payloads null.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..errors import GridError
from ..grid import checked_selection, chunk_box, unravel
from ..meta import ArraySpec
from . import chunks as ch
from .stores import FileStore, Handle, handle_for

PARTITION_BYTES = 64 << 20
#: Cells in one Arrow batch.
BATCH = 1 << 19
#: Partitions of a scan of stored chunks alone; how many of a partition's are stored is not known before.
STORED_PARTITIONS = 2000


def arrow_values(values: np.ndarray, spec: ArraySpec) -> pa.Array:
    """Cells in the Spark type that holds all values of the data type."""
    kinds = {"uint8": np.int16, "uint16": np.int32, "uint32": np.int64}
    if spec.dtype == "uint64":
        return pa.array(values).cast(pa.decimal128(20, 0))
    return pa.array(np.ascontiguousarray(values.astype(kinds.get(spec.dtype, values.dtype), copy=False)))


def equal_rows(rows: np.ndarray, value) -> np.ndarray:
    """Of each row, whether all its cells equal a value; NaN equals nothing, and a float is no float32."""
    return (rows == (np.float64(value) if isinstance(value, float) else value)).all(axis=1)


def load_spec(handle: Handle, zarr_format: int | None = None) -> ArraySpec:
    from ..operators.hierarchy import read_spec

    return read_spec(handle, "array", zarr_format)


class Part(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.handle = handle_for(options.get("handle") or options["path"])
        version = options.get("zarr_format")
        self.spec = load_spec(self.handle, int(version) if version else None)
        self.mode, self.schema = options.get("mode", "cells"), schema
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.stored, self.inner, self.payload = (options.get(k, d) == "true" for k, d in (("stored", "false"), ("inner", "false"), ("payload", "true")))
        self.value = json.loads(options["value"]) if self.mode == "equal" else None
        if self.inner and (self.mode == "cells" or self.spec.pipeline().sharded is None):
            raise GridError("inner chunks are read as blocks or chunks, of arrays in shards")
        shape = self.spec.shape
        low = [int(x) for x in options["offset"].split(",") if x] if "offset" in options else [0] * len(shape)
        size = [int(x) for x in options["shape"].split(",") if x] if "shape" in options else [s - o for s, o in zip(shape, low, strict=True)]
        checked_selection(shape, low, size)
        slow = int(options.get("slowest", 0)) if shape else 0
        if not 0 <= slow < max(1, len(shape)):
            raise GridError(f"slowest dimension {slow} of an array of rank {len(shape)}")
        #: Dimensions in the order in which positions go through the box.
        self.order = [slow, *(k for k in range(len(shape)) if k != slow)] if shape else []
        self.layers = "slowest" in options
        self.low, self.high = low, [o + s for o, s in zip(low, size, strict=True)]

    def pushFilters(self, filters):
        """Narrows the box; every filter is still checked by Spark."""
        dims = self.spec.dims if self.mode == "cells" else []
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in dims and isinstance(getattr(f, "value", None), int) and not isinstance(f.value, bool):
                k = dims.index(name)
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.low[k] = max(self.low[k], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.high[k] = min(self.high[k], f.value + (not isinstance(f, LessThan)))
            yield f

    def _box(self):
        sizes = [max(0, b - a) for a, b in zip(self.low, self.high, strict=True)]
        first, stop = chunk_box(self.spec.chunks, self.low, sizes)
        return tuple(first[k] for k in self.order), tuple(stop[k] - first[k] for k in self.order)

    def _coords(self, i: int, first, sizes) -> tuple[int, ...]:
        """The chunk at a position."""
        own = {k: a + x for k, a, x in zip(self.order, first, unravel(i, sizes), strict=True)}
        return tuple(own[k] for k in range(len(own)))

    def partitions(self):
        sizes = self._box()[1]
        total = math.prod(sizes)
        size = self.spec.chunk_bytes + (self.mode == "cells") * 8 * self.spec.ndim * self.spec.chunk_size
        per = max(1, self.bytes // max(1, size), -(-total // (STORED_PARTITIONS if self.stored else 100_000)))
        if self.layers and total:
            layer = math.prod(sizes[1:])
            per = -(-per // layer) * layer
        return [Part(a, min(total, a + per)) for a in range(0, total, per)] or [Part(0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        first, sizes = self._box()
        for i in self._listed(part, first, sizes) if self.stored else range(part.start, part.stop):
            coords = self._coords(i, first, sizes)
            yield from self._inner_rows(coords) if self.inner else self._rows(coords)

    def _listed(self, part: Part, first, sizes) -> Iterator[int]:
        """Positions of a partition where a chunk may be stored. Chunks that differ in the last dimension alone lie in
        one folder, where keys are cut by slashes: its listing tells which there are."""
        spec, store = self.spec, self.handle.store
        if not (isinstance(store, FileStore) and spec.separator == "/" and spec.ndim > 1 and self.order[-1] == spec.ndim - 1):
            yield from range(part.start, part.stop)
            return
        width, at = sizes[-1], part.start
        while at < part.stop:
            end = min(part.stop, at - at % width + width)
            folder = spec.chunk_key(self._coords(at, first, sizes)).rpartition("/")[0]
            columns = (int(c) - first[-1] + at - at % width for c in store.children(self.handle.key(folder)) if c.isdigit())
            yield from sorted(i for i in columns if at <= i < end)
            at = end

    def _inner_rows(self, coords) -> Iterator[pa.RecordBatch]:
        """The inner chunks of a shard that meet the selection."""
        spec, shard = self.spec, self.spec.pipeline().sharded
        size, counts = shard.inner.chunk, shard.counts
        total, index, rows = math.prod(counts), None, None
        if self.mode == "chunks":
            found = ch.stored_inner(self.handle, spec, coords)
            index, held = found or (None, np.zeros(total, bool))
            held = np.flatnonzero(held)
        else:
            found = ch.held(self.handle, spec, coords)
            held, rows = found or (np.zeros(0, np.int64), np.zeros((0, math.prod(size)), spec.numpy_dtype))
        if found is None and self.stored:
            return
        looked = held if self.stored else np.arange(total)
        own = np.stack(np.unravel_index(looked, counts), axis=1) + np.asarray(coords) * counts
        at, end = np.maximum(own * size, self.low), np.minimum((own + 1) * size, self.high)
        wanted = np.flatnonzero((at < end).all(axis=1))
        for a in range(0, len(wanted), max(1, BATCH // math.prod(size))):
            some = wanted[a : a + max(1, BATCH // math.prod(size))]
            places, here = [_lists(own[some], pa.int64())], looked[some]
            if self.mode == "chunks":
                yield self._batch([*places, *self._inner_chunks(coords, own[some], None if index is None else index[here], np.isin(here, held))])
                continue
            values = self._cut(_taken(here, held, rows, spec.fill), own[some], at[some], end[some])
            if self.mode == "equal":
                yield self._batch([*places, pa.array(equal_rows(values, self.value) if isinstance(values, np.ndarray) else np.array([equal_rows(v[None], self.value)[0] for v in values], bool))])
                continue
            ends = np.arange(len(some) + 1) * math.prod(size) if isinstance(values, np.ndarray) else np.concatenate(([0], np.cumsum([len(v) for v in values])))
            flat = arrow_values(values.ravel() if isinstance(values, np.ndarray) else np.concatenate(values), spec)
            yield self._batch([*places, _lists(at[some], pa.int64()), _lists((end - at)[some], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)])

    def _inner_chunks(self, coords, own, index, held) -> list[pa.Array]:
        keys = _keys(own, self.spec)
        data = [None] * len(own) if self.payload else pa.nulls(len(own), pa.binary())
        if self.payload and index is not None:
            whole = self.spec.pipeline().bytes_of(self.handle.read(self.spec.chunk_key(coords)))
            data = [whole[a : a + n] if h else None for (a, n), h in zip(index.tolist(), held.tolist(), strict=True)]
        sizes = np.zeros(len(own), np.int64) if index is None else index[:, 1].astype(np.int64)
        return [keys, pa.array(sizes, pa.int64(), mask=~held), data if not self.payload else pa.array(data, pa.binary())]

    def _cut(self, rows: np.ndarray, own, at, end) -> np.ndarray | list[np.ndarray]:
        """The cells of inner chunks inside the selection: as they are where all of them are, else each cut by itself."""
        size = self.spec.pipeline().sharded.inner.chunk
        if (end - at == size).all():
            return rows
        cuts = [tuple(slice(a - o * s, b - o * s) for a, b, o, s in zip(*x, size, strict=True)) for x in zip(at.tolist(), end.tolist(), own.tolist(), strict=True)]
        return [row.reshape(size)[cut].ravel() for row, cut in zip(rows, cuts, strict=True)]

    def _shard_cells(self, coords) -> Iterator[pa.RecordBatch]:
        """Cells of a shard that differ from the fill value, from the inner chunks it holds alone."""
        spec, shard = self.spec, self.spec.pipeline().sharded
        if (found := ch.held(self.handle, spec, coords)) is None:
            return
        held, rows = found
        row, within = np.nonzero(rows != spec.fill)
        values = rows[row, within]
        inner, cell = np.unravel_index(held[row], shard.counts), np.unravel_index(within, shard.inner.chunk)
        at = [o * c + i * s + x for o, c, i, s, x in zip(coords, spec.chunks, inner, shard.inner.chunk, cell, strict=True)]
        inside = np.flatnonzero(np.logical_and.reduce([(x >= lo) & (x < hi) for x, lo, hi in zip(at, self.low, self.high, strict=True)]))
        for a in range(0, len(inside), BATCH):
            some = inside[a : a + BATCH]
            yield self._batch([*(pa.array(x[some]) for x in at if len(self.schema) > 1), arrow_values(values[some], spec)])

    def _rows(self, coords) -> Iterator[pa.RecordBatch]:
        spec = self.spec
        if self.mode == "chunks":
            data = self.handle.read(spec.chunk_key(coords))
            if data is not None or not self.stored:
                sent = data if self.payload else None
                yield self._batch([pa.array([coords], pa.list_(pa.int64())), pa.array([spec.chunk_key(coords)]), pa.array([None if data is None else len(data)], pa.int64()), pa.array([sent], pa.binary())])
            return
        if self.mode == "cells" and self.stored and spec.ndim and ch.takes_cells(spec) and spec.pipeline().shard is None:
            yield from self._shard_cells(coords)
            return
        origin = [x * c for x, c in zip(coords, spec.chunks, strict=True)]
        start = [max(lo, o) - o for lo, o in zip(self.low, origin, strict=True)]
        stop = [min(hi, o + c) - o for hi, o, c in zip(self.high, origin, spec.chunks, strict=True)]
        wanted = tuple(slice(a, b) for a, b in zip(start, stop, strict=True))
        shape = tuple(b - a for a, b in zip(start, stop, strict=True))
        chunk = ch.read_chunk(self.handle, spec, coords, wanted)
        if chunk is None and self.stored:
            return
        values = np.full(shape, spec.fill, spec.numpy_dtype) if chunk is None else chunk[wanted]
        at = [o + a for o, a in zip(origin, start, strict=True)]
        if self.mode == "equal":
            yield self._batch([pa.array([coords], pa.list_(pa.int64())), pa.array(equal_rows(values.reshape(1, -1), self.value))])
            return
        if self.mode == "blocks":
            flat = arrow_values(values.ravel(), spec)
            yield self._batch([pa.array([coords], pa.list_(pa.int64())), pa.array([at], pa.list_(pa.int64())), pa.array([shape], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)])
            return
        flat = np.ascontiguousarray(values).ravel()
        kept = np.flatnonzero(flat != spec.fill) if self.stored else None
        for a in range(0, len(flat) if kept is None else len(kept), BATCH):
            some = np.arange(a, min(a + BATCH, len(flat))) if kept is None else kept[a : a + BATCH]
            columns = [pa.array(x + o) for x, o in zip(np.unravel_index(some, shape), at, strict=True)] if shape and len(self.schema) > 1 else []
            yield self._batch([*columns, arrow_values(flat[some] if kept is not None else flat[a : a + BATCH], spec)])

    def _batch(self, columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(columns, self.schema.names)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel(), kind))


def _keys(coords: np.ndarray, spec: ArraySpec) -> pa.Array:
    """Keys of many chunks."""
    lead = ["c"] if spec.zarr_format == 3 and spec.key_encoding == "default" else []
    parts = [*lead, *(pc.cast(pa.array(np.ascontiguousarray(x)), pa.string()) for x in coords.T)]
    return pc.binary_join_element_wise(*parts, spec.separator)


def _taken(which: np.ndarray, held: np.ndarray, rows: np.ndarray, fill) -> np.ndarray:
    """Rows of some inner chunks, of which ``held`` are stored."""
    out = np.full((len(which), rows.shape[1]), fill, rows.dtype)
    if len(held):
        at = np.minimum(np.searchsorted(held, which), len(held) - 1)
        hit = held[at] == which
        out[hit] = rows[at[hit]]
    return out


class NdArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ndarray"

    def schema(self) -> T.StructType:
        version = self.options.get("zarr_format")
        spec = load_spec(handle_for(self.options["path"]), int(version) if version else None)
        return schema_of(spec, self.options.get("mode", "cells"), self.options.get("coords", "true") != "false")

    def reader(self, schema: T.StructType) -> Reader:
        return Reader({k: v for k, v in self.options.items()}, schema)


def schema_of(spec: ArraySpec, mode: str, coords: bool = True) -> T.StructType:
    longs = T.ArrayType(T.LongType())
    if mode == "chunks":
        return T.StructType().add("chunk_coords", longs).add("key", T.StringType()).add("nbytes", T.LongType()).add("payload", T.BinaryType())
    if mode == "equal":
        return T.StructType().add("chunk_coords", longs).add("equal", T.BooleanType())
    if mode == "blocks":
        return T.StructType().add("chunk_coords", longs).add("origin", longs).add("block_shape", T.ArrayType(T.IntegerType())).add("values", T.ArrayType(spec.spark_type))
    if mode != "cells":
        raise ValueError(f"mode {mode!r}")
    dims = [T.StructField(d, T.LongType(), False) for d in spec.dims] if coords else []
    return T.StructType([*dims, T.StructField("value", spec.spark_type)])


def register(spark: SparkSession) -> None:
    """Makes ``format("ndarray")`` known to a session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NdArraySource)
