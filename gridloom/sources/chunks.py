"""Reading, writing and trimming single chunks; what tasks do with one."""

from __future__ import annotations

import numpy as np

from ..codecs import shards
from ..meta import ArraySpec
from .stores import Handle


def read_chunk(handle: Handle, spec: ArraySpec, coords, wanted=None) -> np.ndarray | None:
    """A chunk, or None where it is not stored. ``wanted`` (a slice for each dimension) lets a shard fetch its index
    and the inner chunks that it needs alone, by byte ranges."""
    key, pipeline = spec.chunk_key(coords), spec.pipeline()
    shard = pipeline.shard
    whole = wanted is None or all(w.start <= 0 and w.stop >= c for w, c in zip(wanted, spec.chunks, strict=True))
    if shard is None or whole:
        data = handle.read(key)
        return None if data is None else pipeline.decode(data)
    index = handle.read(key, -shard.index_bytes) if shard.at_end else handle.read(key, 0, shard.index_bytes)
    if index is None:
        return None
    return shards.assembled(shard, shards.index_of(shard, index), lambda a, b: handle.read(key, a, b), wanted)


def stored_inner(handle: Handle, spec: ArraySpec, coords) -> tuple[np.ndarray, np.ndarray] | None:
    """Of a shard that is stored: the index, and which inner chunks it holds, in C order. Where shards are not
    compressed, the index alone is read."""
    pipeline, key = spec.pipeline(), spec.chunk_key(coords)
    if (shard := pipeline.shard) is not None:
        head = handle.read(key, -shard.index_bytes) if shard.at_end else handle.read(key, 0, shard.index_bytes)
        index = None if head is None else shards.index_of(shard, head)
    else:
        data = handle.read(key)
        index = None if data is None else shards.own_index(pipeline.sharded, pipeline.bytes_of(data))
    return None if index is None else (index, shards.stored(index))


def held(handle: Handle, spec: ArraySpec, coords) -> tuple[np.ndarray, np.ndarray] | None:
    """Of a shard that is stored: which inner chunks it holds, in C order, and a row of cells for each."""
    pipeline = spec.pipeline()
    data = handle.read(spec.chunk_key(coords))
    return None if data is None else shards.held(pipeline.sharded, pipeline.bytes_of(data))


def takes_cells(spec: ArraySpec) -> bool:
    """Whether a chunk is encoded from its few set cells, without the others."""
    shard = spec.pipeline().sharded
    return shard is not None and shards.takes_cells(shard)


def encoded_cells(spec: ArraySpec, at: list[np.ndarray], values: np.ndarray) -> bytes | None:
    """``encoded`` for a chunk of these cells, the others holding the fill value."""
    some = np.flatnonzero(values != spec.fill)
    if not len(some):
        return None
    shard, *raw = spec.pipeline().codecs
    data = shards.encode_cells(shard, [x[some] for x in at], values[some])
    for codec in raw:
        data = codec.encode(data)
    return data


def encoded(spec: ArraySpec, array: np.ndarray) -> bytes | None:
    """A chunk's bytes; None where all cells hold the fill value, which is not stored."""
    pipeline = spec.pipeline()
    return None if pipeline.is_fill(array) else pipeline.encode(array)


def put(handle: Handle, key: str, data: bytes | None) -> None:
    if data is None:
        handle.delete(key)
    else:
        handle.set(data, key)


def overlaid(handle: Handle, spec: ArraySpec, coords, at: tuple[slice, ...], new: np.ndarray) -> np.ndarray:
    """The chunk with new cells in a region; the old one is read only where some of it stays."""
    if new.shape == spec.chunks:
        return new
    old = read_chunk(handle, spec, coords)
    chunk = np.full(spec.chunks, spec.fill, spec.numpy_dtype) if old is None else np.array(old)
    chunk[at] = new
    return chunk


def trimmed(chunk: np.ndarray, spec: ArraySpec, coords, shape) -> np.ndarray:
    """The chunk with the fill value outside an array shape."""
    out = np.full(spec.chunks, spec.fill, spec.numpy_dtype)
    keep = tuple(slice(0, max(0, min(c, s - x * c))) for x, c, s in zip(coords, spec.chunks, shape, strict=True))
    out[keep] = chunk[keep]
    return out
