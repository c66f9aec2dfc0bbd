"""Geometry of regular chunk grids: in Python for single selections, as columns for frames of chunks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import GridError


def is_permutation(order) -> bool:
    return len(order) > 0 and sorted(order) == list(range(len(order)))


def inverse_permutation(order) -> list[int]:
    if not is_permutation(order):
        raise GridError(f"{order} is no permutation")
    return np.argsort(order).tolist()


def chunk_box(chunks, offset, shape) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """First chunk and end (exclusive) of the chunks that meet a selection, along each dimension."""
    first = tuple(o // c for o, c in zip(offset, chunks, strict=True))
    return first, tuple((o + s - 1) // c + 1 if s else f for o, s, c, f in zip(offset, shape, chunks, first, strict=True))


def chunk_coords(chunks, offset, shape) -> Iterator[tuple[int, ...]]:
    """Chunks that meet a selection, one at a time in C order."""
    first, stop = chunk_box(chunks, offset, shape)
    sizes = tuple(b - a for a, b in zip(first, stop, strict=True))
    for i in range(math.prod(sizes)):
        yield tuple(int(a + x) for a, x in zip(first, unravel(i, sizes), strict=True))


def unravel(i: int, sizes) -> tuple[int, ...]:
    """C-order coordinates of a position; of any size, unlike numpy's."""
    out = []
    for s in reversed(sizes):
        i, x = divmod(i, s)
        out.append(x)
    return tuple(reversed(out))


@dataclass(frozen=True)
class Projection:
    """Where a chunk and a selection overlap: offset in the chunk, offset in the selection, and extent."""

    chunk_offset: tuple[int, ...]
    out_offset: tuple[int, ...]
    shape: tuple[int, ...]


def projection(coords, chunks, offset, shape) -> Projection:
    start = [max(0, o - x * c) for x, c, o in zip(coords, chunks, offset, strict=True)]
    stop = [min(c, o + s - x * c) for x, c, o, s in zip(coords, chunks, offset, shape, strict=True)]
    out = [max(0, x * c - o) for x, c, o in zip(coords, chunks, offset, strict=True)]
    return Projection(tuple(start), tuple(out), tuple(b - a for a, b in zip(start, stop, strict=True)))


def is_full_chunk(offset, shape, chunks) -> bool:
    if not len(offset) == len(shape) == len(chunks):
        raise GridError("ranks differ")
    return all(o == 0 for o in offset) and tuple(shape) == tuple(chunks)


def is_single_full_chunk(offset, shape, chunks) -> bool:
    if not len(offset) == len(shape) == len(chunks):
        raise GridError("ranks differ")
    return all(o % c == 0 and s == c for o, s, c in zip(offset, shape, chunks, strict=True))


def single_chunk_coords(offset, chunks) -> tuple[int, ...]:
    return tuple(o // c for o, c in zip(offset, chunks, strict=True))


def in_grid(coords, shape, chunks) -> bool:
    return all(0 <= x and x * c < s for x, s, c in zip(coords, shape, chunks, strict=True))


def copy_region(source: np.ndarray, at, target: np.ndarray, to, shape) -> None:
    """Copies a rectangle between arrays; regions that leave an array raise."""
    if not source.ndim == target.ndim == len(at) == len(to) == len(shape):
        raise GridError("ranks differ")
    for a, o in ((source, at), (target, to)):
        if any(x < 0 or x + s > n for x, s, n in zip(o, shape, a.shape, strict=True)):
            raise GridError("the region leaves the array")
    target[tuple(slice(x, x + s) for x, s in zip(to, shape, strict=True))] = source[tuple(slice(x, x + s) for x, s in zip(at, shape, strict=True))]


def checked_selection(array_shape, offset, shape) -> None:
    if not len(array_shape) == len(offset) == len(shape):
        raise GridError(f"the selection has rank {len(offset)}, {len(shape)}; the array {len(array_shape)}")
    if any(o < 0 or s < 0 or o + s > n for o, s, n in zip(offset, shape, array_shape, strict=True)):
        raise GridError(f"offset {tuple(offset)} and shape {tuple(shape)} leave the array {tuple(array_shape)}")


def chunk_of(dim: Column, size: int) -> Column:
    """Chunk coordinate of a cell coordinate."""
    return F.floor(dim / size).cast("long") if size > 1 else dim.cast("long")


def grid_frame(spark: SparkSession, chunks, offset, shape) -> DataFrame:
    """c0, c1 ... of all chunks that meet a selection, made by the executors from one range."""
    first, stop = chunk_box(chunks, offset, shape)
    sizes = [b - a for a, b in zip(first, stop, strict=True)]
    total, rows, step = math.prod(sizes), [], 1
    for k in range(len(sizes) - 1, -1, -1):
        rows.insert(0, (F.expr(f"id div {step}") % sizes[k] + first[k]).alias(f"c{k}") if sizes[k] else F.lit(None).cast("long").alias(f"c{k}"))
        step *= max(1, sizes[k])
    return spark.range(total).select(*rows)


def packed(chunks, shape, most: int, cells: int) -> tuple[int, ...]:
    """Chunks of whole multiples of these, doubled where the grid is longest until it has at most ``most`` chunks or a
    chunk has ``cells`` cells: the number of chunks of a sparse array does not grow with the product of its extents."""
    chunks = tuple(chunks)
    counts = [-(-s // c) for s, c in zip(shape, chunks, strict=True)]
    while math.prod(counts) > most and 2 * math.prod(chunks) <= cells:
        k = counts.index(max(counts))
        chunks = (*chunks[:k], 2 * chunks[k], *chunks[k + 1 :])
        counts[k] = -(-counts[k] // 2)
    return chunks


def projected(grid: DataFrame, chunks, offset, shape) -> DataFrame:
    """Chunks of ``grid_frame`` with their overlap: chunk_offset, out_offset and extent as arrays."""
    n = len(chunks)

    def each(make) -> Column:
        return F.array(*(make(F.col(f"c{k}"), F.lit(chunks[k]).cast("long"), F.lit(offset[k]).cast("long"), F.lit(offset[k] + shape[k]).cast("long")) for k in range(n)))

    start = each(lambda x, c, o, e: F.greatest(F.lit(0).cast("long"), o - x * c))
    out = each(lambda x, c, o, e: F.greatest(F.lit(0).cast("long"), x * c - o))
    extent = each(lambda x, c, o, e: F.least(c, e - x * c) - F.greatest(F.lit(0).cast("long"), o - x * c))
    return grid.select("*", start.alias("chunk_offset"), out.alias("out_offset"), extent.alias("extent"))
