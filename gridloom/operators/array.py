"""Arrays: opening, creating, reading, writing, resizing."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GridError
from ..functions.cells import spread
from ..grid import checked_selection, chunk_coords, copy_region, grid_frame, in_grid, projection
from ..meta import ArraySpec, SpecBuilder
from ..sources import chunks as ch
from ..sources import ndarray, sink
from ..sources.stores import FileStore, Handle, handle_for
from .hierarchy import MARKERS, read_spec, write_spec


#: Cells of the last dimension that lie in one row of a sparse grid until it is spread out.
BAND = 1 << 16


@dataclass(frozen=True)
class Array:
    handle: Handle
    spec: ArraySpec

    @staticmethod
    def open(where, zarr_format: int | None = None) -> Array:
        handle = handle_for(where)
        return Array(handle, read_spec(handle, "array", zarr_format))

    @staticmethod
    def create(where, spec: ArraySpec | SpecBuilder, exists_ok: bool = False) -> Array:
        handle, spec = handle_for(where), spec.build() if isinstance(spec, SpecBuilder) else spec
        if not exists_ok and any(handle.exists(m) for m in MARKERS):
            raise GridError(f"there is a node at {handle}")
        write_spec(handle, spec)
        return Array(handle, spec)

    # Reading

    def _frame(self, spark: SparkSession, mode: str, offset, shape, **options) -> DataFrame:
        ndarray.register(spark)
        if not isinstance(self.handle.store, FileStore) and not str(self.handle).startswith(("http", "memory")):
            return self._sent(spark, mode, offset, shape, **options)
        reader = spark.read.format("ndarray").option("mode", mode).option("zarr_format", self.spec.zarr_format)
        if offset is not None or shape is not None:
            offset, shape = self._selection(offset, shape)
            reader = reader.option("offset", ",".join(map(str, offset))).option("shape", ",".join(map(str, shape)))
        for k, v in options.items():
            reader = reader.option(k, v)
        return reader.load(str(self.handle))

    def _sent(self, spark: SparkSession, mode: str, offset, shape, **options) -> DataFrame:
        """The rows of a store that only a handle reaches; each chunk is read by a task."""
        offset, shape = self._selection(offset, shape)
        schema = ndarray.schema_of(self.spec, mode)
        options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}
        reader = ndarray.Reader({**options, "handle": self.handle, "mode": mode, "offset": ",".join(map(str, offset)), "shape": ",".join(map(str, shape)), "zarr_format": self.spec.zarr_format}, schema)
        parts = spark.createDataFrame([(p.start, p.stop) for p in reader.partitions()], "a long, b long")

        def run(batches):
            for batch in batches:
                for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield from reader.read(ndarray.Part(a, b))

        return parts.repartition(min(200, len(reader.partitions()))).mapInArrow(run, schema)

    def _selection(self, offset, shape):
        offset = (0,) * self.spec.ndim if offset is None else tuple(offset)
        shape = tuple(s - o for s, o in zip(self.spec.shape, offset, strict=True)) if shape is None else tuple(shape)
        checked_selection(self.spec.shape, offset, shape)
        return offset, shape

    def cells(self, spark: SparkSession, offset=None, shape=None, **options) -> DataFrame:
        """A row per cell: the dimensions and ``value``. Predicates on dimensions prune chunks as well.

        Spark keeps what was pushed to a loaded frame for the next plan that pushes nothing, so the frame comes with a
        predicate of its own. Within one plan (a union or self-join) it still keeps only one of two uses' predicates:
        there, call this once for each use, or give the selection here."""
        frame = self._frame(spark, "cells", offset, shape, **options)
        return frame.where(F.col(self.spec.dims[0]) >= 0) if self.spec.shape else frame

    def filled_cells(self, spark: SparkSession) -> DataFrame:
        """All cells, as ``cells`` gives them, of an array of which little is stored: only what is stored is read, the
        others are made from the runs between these cells."""
        if not self.spec.shape:
            return self.cells(spark)
        return self._spread(spark, self.cells(spark, stored=True), self.spec.dims, self.spec.shape, sink.fill_of(self.spec))

    def blocks(self, spark: SparkSession, offset=None, shape=None, **options) -> DataFrame:
        """A row per chunk with its cells inside the selection."""
        return self._frame(spark, "blocks", offset, shape, **options)

    def chunks(self, spark: SparkSession, offset=None, shape=None, **options) -> DataFrame:
        """A row per chunk with its stored bytes."""
        return self._frame(spark, "chunks", offset, shape, **options)

    def equal_blocks(self, spark: SparkSession, value, inner: bool = False) -> DataFrame:
        """c0, c1 ... and ``equal`` of every block (or inner chunk of the shards): whether all its cells equal a value.

        Where that is the fill value, only what is stored is read; the blocks that are not come from the grid, whose
        rows hold many blocks until then."""
        size = self.spec.pipeline().sharded.inner.chunk if inner else self.spec.chunks
        names, sparse = [f"c{k}" for k in range(self.spec.ndim)], self.spec.ndim > 1 and bool(self.spec.fill == value)
        blocks = self._frame(spark, "equal", None, None, inner=inner, stored=sparse, value=json.dumps(value))
        told = blocks.select(*(F.col("chunk_coords")[k].alias(c) for k, c in enumerate(names)), "equal")
        if not sparse:
            return told
        counts = tuple(-(-n // s) for n, s in zip(self.spec.shape, size, strict=True))
        return self._spread(spark, told.where("not equal").withColumnRenamed("equal", "value"), names, counts, F.lit(True)).withColumnRenamed("value", "equal")

    def _spread(self, spark: SparkSession, given: DataFrame, names: list[str], shape: tuple[int, ...], fill: Column) -> DataFrame:
        """All cells of a grid, of which some are given."""
        n = len(shape)
        grid = grid_frame(spark, (*(1,) * (n - 1), BAND), (0,) * n, shape).toDF(*names[:-1], "band")
        return spread(given, grid, names, shape[-1], BAND, fill, sink.parts_of(spark, math.prod(shape)))

    def read(self, offset=None, shape=None, spark: SparkSession | None = None) -> np.ndarray:
        """A cutout in memory; with a session its chunks are read and decoded by tasks."""
        offset, shape = self._selection(offset, shape)
        out = np.full(shape, self.spec.fill, self.spec.numpy_dtype)
        if spark is not None:
            for batch in self.blocks(spark, offset, shape).toArrow().to_batches():
                for r in range(batch.num_rows):
                    at, size = batch.column(1)[r].as_py(), batch.column(2)[r].as_py()
                    block = sink.numpy_values(batch.column(3)[r].values, self.spec).reshape(size)
                    copy_region(block, [0] * len(size), out, [a - o for a, o in zip(at, offset, strict=True)], size)
            return out
        for coords in chunk_coords(self.spec.chunks, offset, shape):
            p = projection(coords, self.spec.chunks, offset, shape)
            wanted = tuple(slice(a, a + s) for a, s in zip(p.chunk_offset, p.shape, strict=True))
            chunk = ch.read_chunk(self.handle, self.spec, coords, wanted)
            if chunk is not None:
                copy_region(chunk, p.chunk_offset, out, p.out_offset, p.shape)
        return out

    def read_chunk(self, coords) -> np.ndarray:
        """A whole chunk, padded where it leaves the array."""
        if not in_grid(coords, self.spec.shape, self.spec.chunks):
            raise GridError(f"chunk {tuple(coords)} is outside the grid")
        chunk = ch.read_chunk(self.handle, self.spec, coords)
        return np.full(self.spec.chunks, self.spec.fill, self.spec.numpy_dtype) if chunk is None else np.array(chunk)

    # Writing

    def write(self, data: np.ndarray, offset=None, spark: SparkSession | None = None, parallel: bool = True) -> None:
        """Cells from memory; with a session, tasks encode and write the chunks."""
        offset = (0,) * self.spec.ndim if offset is None else tuple(offset)
        if not data.ndim == len(offset) == self.spec.ndim:
            raise GridError(f"data of rank {data.ndim} at {offset} in an array of rank {self.spec.ndim}")
        checked_selection(self.spec.shape, offset, data.shape)
        data = data.astype(self.spec.numpy_dtype, copy=False)
        rows = []
        for coords in chunk_coords(self.spec.chunks, offset, data.shape):
            p = projection(coords, self.spec.chunks, offset, data.shape)
            own = data[tuple(slice(a, a + s) for a, s in zip(p.out_offset, p.shape, strict=True))]
            if spark is None or not self.handle.store.shared:
                at = tuple(slice(a, a + s) for a, s in zip(p.chunk_offset, p.shape, strict=True))
                ch.put(self.handle, self.spec.chunk_key(coords), ch.encoded(self.spec, ch.overlaid(self.handle, self.spec, coords, at, own)))
                continue
            origin = [x * c + a for x, c, a in zip(coords, self.spec.chunks, p.chunk_offset, strict=True)]
            rows.append((origin, list(p.shape), ndarray.arrow_values(own.ravel(), self.spec)))
        if rows:
            kinds = pa.schema([("origin", pa.list_(pa.int64())), ("block_shape", pa.list_(pa.int32())), ("values", pa.list_(rows[0][2].type))])
            ends = np.concatenate(([0], np.cumsum([len(r[2]) for r in rows])))
            columns = [pa.array([r[0] for r in rows], kinds.field(0).type), pa.array([r[1] for r in rows], kinds.field(1).type), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([r[2] for r in rows]))]
            blocks = spark.createDataFrame(pa.table(columns, schema=kinds))
            self.write_blocks(blocks.repartition(min(len(rows), spark.sparkContext.defaultParallelism * 4)) if parallel else blocks.coalesce(1))

    def write_cells(self, cells: DataFrame, value: str = "value", whole: bool = False, combine=None) -> tuple[int, int]:
        return sink.write_cells(self.handle, self.spec, cells, value, whole, combine)

    def write_blocks(self, blocks: DataFrame) -> tuple[int, int]:
        return sink.write_blocks(self.handle, self.spec, blocks)

    def write_chunk(self, coords, chunk: np.ndarray) -> None:
        if not in_grid(coords, self.spec.shape, self.spec.chunks) or chunk.shape != self.spec.chunks:
            raise GridError(f"chunk {tuple(coords)} of shape {chunk.shape}")
        ch.put(self.handle, self.spec.chunk_key(coords), ch.encoded(self.spec, chunk.astype(self.spec.numpy_dtype, copy=False)))

    def rechunked(self, where, spec: ArraySpec, spark: SparkSession) -> Array:
        """The same cells under another layout. Chunks that are not stored here are not read."""
        new = Array.create(where, replace(spec, shape=self.spec.shape))
        new.write_cells(self.cells(spark).toDF(*new.spec.dims, "value"), whole=True)
        return new

    # Metadata

    def resize(self, shape, metadata_only: bool = True, spark: SparkSession | None = None) -> Array:
        """An array of another shape. Chunks outside stay stored, unless ``metadata_only`` is off: then they go, and
        those on the edge are trimmed, before the metadata changes."""
        if len(shape) != self.spec.ndim:
            raise GridError(f"shape {tuple(shape)} for rank {self.spec.ndim}")
        if not metadata_only:
            sink.shrink(self.handle, self.spec, shape, spark)
        return self._changed(shape=tuple(shape))

    def _changed(self, **what) -> Array:
        new = Array(self.handle, replace(self.spec, **what))
        write_spec(self.handle, new.spec)
        return new

    @property
    def attributes(self) -> dict:
        if self.spec.attributes is None:
            raise GridError(f"{self.handle} has no attributes")
        return self.spec.attributes

    def set_attributes(self, attributes: dict) -> Array:
        return self._changed(attributes=dict(attributes))

    def update_attributes(self, change) -> Array:
        return self.set_attributes(change(dict(self.spec.attributes or {})))

    def builder(self, attributes: bool = True) -> SpecBuilder:
        return SpecBuilder.of(self.spec, attributes)

    def access(self) -> Accessor:
        return Accessor(self)

    def __repr__(self) -> str:
        return f"<v{self.spec.zarr_format}.Array {{{self.handle}}} {self.spec.shape} {self.spec.dtype}>"


@dataclass(frozen=True)
class Accessor:
    """A selection that is read or written."""

    array: Array
    offset: tuple[int, ...] | None = None
    shape: tuple[int, ...] | None = None

    def with_offset(self, *offset: int) -> Accessor:
        return replace(self, offset=offset)

    def with_shape(self, *shape: int) -> Accessor:
        return replace(self, shape=shape)

    def read(self, spark: SparkSession | None = None) -> np.ndarray:
        return self.array.read(*self._given(), spark=spark)

    def cells(self, spark: SparkSession) -> DataFrame:
        return self.array.cells(spark, *self._given())

    def _given(self):
        if self.offset is None or self.shape is None:
            raise GridError("a read needs an offset and a shape")
        return self.offset, self.shape

    def write(self, data: np.ndarray, spark: SparkSession | None = None) -> None:
        if self.offset is None:
            raise GridError("a write needs an offset")
        self.array.write(data, self.offset, spark)
