"""Writing frames of cells or blocks into an array, one task per chunk.

Repeated cells are combined, then cells are shuffled and sorted by chunk; a chunk is written by one task, so nothing is locked. A chunk whose cells are all
given replaces the stored one, any other is read, overlaid and written; one that holds only the fill value is deleted.
A shard of few cells that is not stored yet is encoded from these alone.
A task that is run again writes the same bytes. Blocks are whole chunks and are not shuffled at all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GridError
from ..grid import checked_selection, chunk_of
from ..meta import ArraySpec
from . import chunks as ch
from .stores import Handle

WRITTEN = "key string, stored boolean, payload binary"


def numpy_values(values: pa.Array, spec: ArraySpec) -> np.ndarray:
    if pa.types.is_decimal(values.type):
        values = pc.cast(values, pa.uint64())
    return values.to_numpy(zero_copy_only=False).astype(spec.numpy_dtype)


def _row(handle: Handle, key: str, data: bytes | None) -> list[pa.Array]:
    if handle.store.shared:
        ch.put(handle, key, data)
    return [pa.array([key]), pa.array([data is not None]), pa.array([None if handle.store.shared else data], pa.binary())]


def _finished(handle: Handle, done: DataFrame) -> tuple[int, int]:
    """Runs the job: chunks stored, chunks left out. Chunks for a store that executors can't write come one by one."""
    if handle.store.shared:
        counts = {r["stored"]: r["n"] for r in done.groupBy("stored").agg(F.count("*").alias("n")).collect()}
        return counts.get(True, 0), counts.get(False, 0)
    counts = [0, 0]
    for r in done.toLocalIterator():
        ch.put(handle, r["key"], None if r["payload"] is None else bytes(r["payload"]))
        counts[not r["stored"]] += 1
    return counts[0], counts[1]


#: Cells in a partition of a frame that fills an array, and the most partitions.
PART_CELLS, MOST_PARTS = 1 << 20, 2000


def fill_of(spec: ArraySpec) -> Column:
    return F.lit(Decimal(int(spec.fill)) if spec.dtype == "uint64" else spec.fill.item()).cast(spec.spark_type)


def parts_of(spark, cells: int) -> int:
    """Partitions for so many cells, the session's number at least: what a task holds does not grow with the array."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-cells // PART_CELLS)))


#: A shard is spread out in memory from one cell in so many on.
FEW = 8


class _Chunk:
    """Cells of one chunk as they come: few of a shard are kept as they are, others lie in the whole chunk."""

    def __init__(self, spec: ArraySpec, coords: tuple[int, ...]):
        self.spec, self.coords, self.few, self.n, self.whole = spec, coords, [], 0, None

    def add(self, at: list[np.ndarray], values: np.ndarray) -> None:
        self.few.append((at, values))
        self.n += len(values)
        if self.whole is not None or self.n * FEW > self.spec.chunk_size or not ch.takes_cells(self.spec):
            self._spread()

    def _spread(self) -> None:
        spec = self.spec
        if self.whole is None:
            self.whole = np.full(spec.chunks, spec.fill, spec.numpy_dtype), np.zeros(spec.chunk_size, bool)
        for at, values in self.few:
            flat = np.ravel_multi_index(at, spec.chunks) if spec.ndim else np.zeros(len(values), np.int64)
            self.whole[0].reshape(-1)[flat] = values
            self.whole[1][flat] = True
        self.few = []

    def encoded(self, handle: Handle) -> bytes | None:
        spec = self.spec
        if self.whole is None:
            if not handle.exists(spec.chunk_key(self.coords)):
                at = [np.concatenate(x) for x in zip(*(at for at, _ in self.few), strict=True)]
                return ch.encoded_cells(spec, at, np.concatenate([v for _, v in self.few]))
            self._spread()
        chunk, seen = self.whole
        if not seen.all() and (old := ch.read_chunk(handle, spec, self.coords)) is not None:
            chunk = np.where(seen.reshape(spec.chunks), chunk, old)
        return ch.encoded(spec, chunk)


def write_cells(handle: Handle, spec: ArraySpec, cells: DataFrame, value: str = "value", whole: bool = False, combine: Callable[[Column], Column] | None = None) -> tuple[int, int]:
    """Of rows with a column for each dimension and a value; of repeated cells the one with the largest value stays, or
    what ``combine`` (an aggregate function) makes of their values. Null values become the fill value. Rows with a coordinate that is null or outside the array raise, before any
    chunk is written: that is checked ahead of a shuffle. A frame that fills the array (``whole``) is shuffled
    once, by chunk, to as many tasks as the array's size asks for, and repeated cells are combined there; any other is
    combined ahead of the shuffle by chunk. In Python a task holds one chunk and one batch of cells."""
    n = spec.ndim
    fill = fill_of(spec)

    def inside(k: int):
        x = F.col(spec.dims[k]).cast("long")
        error = F.raise_error(F.concat(F.lit(f"a cell outside the array of shape {tuple(spec.shape)}: {spec.dims[k]} = "), F.coalesce(x.cast("string"), F.lit("null"))))
        return F.when((x >= 0) & (x < spec.shape[k]), x).otherwise(error.cast("long"))

    own = cells.select(*(inside(k).alias(f"_x{k}") for k in range(n)), (F.coalesce(F.col(value).cast(spec.spark_type), fill) if combine is None else F.col(value)).alias("_v"))
    combined = F.max("_v") if combine is None else F.coalesce(combine(F.col("_v")).cast(spec.spark_type), fill)
    by, dims = [f"_c{k}" for k in range(n)], [f"_x{k}" for k in range(n)]
    if not (whole and n):
        own = (own.groupBy(*dims) if n else own.groupBy(F.lit(0))).agg(combined.alias("_v")).select(*dims, "_v")
    chunk = [chunk_of(F.col(x), c) for x, c in zip(dims, spec.chunks, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in which those of a chunk follow each other."""
        chunk = None

        def written() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(_row(handle, spec.chunk_key(chunk.coords), chunk.encoded(handle)), ["key", "stored", "payload"])

        for rows in batches:
            if not rows.num_rows:
                continue
            places = [rows.column(k).to_numpy() for k in range(n)]
            own = [x // c for x, c in zip(places, spec.chunks, strict=True)]
            values, new = numpy_values(rows.column(n), spec), np.zeros(max(0, rows.num_rows - 1), bool)
            for c in own:
                new |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), rows.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                coords = tuple(int(c[a]) for c in own)
                if chunk is None or chunk.coords != coords:
                    if chunk is not None:
                        yield written()
                    chunk = _Chunk(spec, coords)
                chunk.add([x[a:b] - o * c for x, o, c in zip(places, coords, spec.chunks, strict=True)], values[a:b])
        if chunk is not None:
            yield written()

    if whole and n:
        own = own.repartition(parts_of(own.sparkSession, math.prod(spec.shape)), *chunk)
        own = own.select("*", *(c.alias(name) for c, name in zip(chunk, by, strict=True))).groupBy(*by, *dims).agg(combined.alias("_v"))
    else:
        own = own.repartition(*chunk) if n else own.repartition(1)
        own = own.select("*", *(c.alias(name) for c, name in zip(chunk, by, strict=True)))
    own = own.sortWithinPartitions(*by) if n else own
    return _finished(handle, own.select(*dims, "_v").mapInArrow(run, WRITTEN))


def write_blocks(handle: Handle, spec: ArraySpec, blocks: DataFrame) -> tuple[int, int]:
    """Of rows with origin, block_shape and values (C order); a block lies within one chunk and the array, and no two
    blocks of a frame in the same chunk; one that does not raises and is not written. Not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                origin, shape = batch.column(0)[r].as_py(), tuple(batch.column(1)[r].as_py())
                values = numpy_values(batch.column(2)[r].values, spec).reshape(shape)
                checked_selection(spec.shape, origin, shape)
                coords = tuple(o // c for o, c in zip(origin, spec.chunks, strict=True))
                start = [o - x * c for o, x, c in zip(origin, coords, spec.chunks, strict=True)]
                if any(a + s > c for a, s, c in zip(start, shape, spec.chunks, strict=True)):
                    raise GridError(f"block at {origin} of shape {shape} does not lie within a chunk")
                chunk = ch.overlaid(handle, spec, coords, tuple(slice(a, a + s) for a, s in zip(start, shape, strict=True)), values)
                yield pa.RecordBatch.from_arrays(_row(handle, spec.chunk_key(coords), ch.encoded(spec, chunk)), ["key", "stored", "payload"])

    return _finished(handle, blocks.select("origin", "block_shape", "values").mapInArrow(run, WRITTEN))


def shrink(handle: Handle, spec: ArraySpec, shape, spark) -> int:
    """Deletes stored chunks outside a new shape and refills the outer part of those on its edge; the number touched.

    Only stored chunks are looked at, so a sparse array costs what it stores.
    """
    depth = spec.chunk_key((0,) * spec.ndim)
    prefix = "c" + spec.separator if depth.startswith("c") else ""
    keys = [(k,) for k in handle.list() if k.startswith(prefix) and k.rsplit("/", 1)[-1] not in ("zarr.json", ".zarray", ".zattrs")]
    if not keys:
        return 0
    chunk, new, sep = spec.chunks, tuple(shape), spec.separator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in batch.column(0).to_pylist():
                coords = tuple(int(x) for x in key[len(prefix) :].split(sep))
                if all((x + 1) * c <= s for x, c, s in zip(coords, chunk, new, strict=True)):
                    continue
                data = None
                if all(x * c < s for x, c, s in zip(coords, chunk, new, strict=True)):
                    data = ch.encoded(spec, ch.trimmed(ch.read_chunk(handle, spec, coords), spec, coords, new))
                yield pa.RecordBatch.from_arrays(_row(handle, key, data), ["key", "stored", "payload"])

    if not handle.store.shared or spark is None:
        for batch in run(iter([pa.RecordBatch.from_arrays([pa.array([k for (k,) in keys])], ["key"])])):
            ch.put(handle, batch.column(0)[0].as_py(), batch.column(2)[0].as_py()) if not handle.store.shared else None
        return len(keys)
    return sum(_finished(handle, spark.createDataFrame(keys, "key string").repartition(max(1, min(2000, len(keys) // 8))).mapInArrow(run, WRITTEN)))
