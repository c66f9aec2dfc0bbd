"""Shards: inner chunks in one value, with an index of their offsets and lengths."""

from __future__ import annotations

import math

import numpy as np

from ..errors import GridError

MISSING = np.uint64(2**64 - 1)


def _slices(codec, i: int) -> tuple[slice, ...]:
    at = np.unravel_index(i, codec.counts) if codec.counts else ()
    return tuple(slice(a * c, (a + 1) * c) for a, c in zip(at, codec.inner.chunk, strict=True))


def _plain(codec):
    """The one codec of inner chunks where it stores cells as they are: then all of them are handled at once."""
    own = codec.inner.codecs
    return own[0] if len(own) == 1 and type(own[0]).__name__ == "Bytes" else None


def rows_of(array: np.ndarray, counts, inner) -> np.ndarray:
    """A row of cells in C order for each inner chunk."""
    d = len(counts)
    split = array.reshape([x for pair in zip(counts, inner, strict=True) for x in pair])
    return split.transpose([*range(0, 2 * d, 2), *range(1, 2 * d, 2)]).reshape(math.prod(counts), math.prod(inner))


def array_of(rows: np.ndarray, counts, inner) -> np.ndarray:
    """The array whose inner chunks these are."""
    d = len(counts)
    split = rows.reshape([*counts, *inner])
    return split.transpose([k + h for k in range(d) for h in (0, d)]).reshape([c * i for c, i in zip(counts, inner, strict=True)])


def _encode_plain(codec, array: np.ndarray) -> bytes:
    rows = rows_of(array, codec.counts, codec.inner.chunk)
    some = np.flatnonzero(~(rows == codec.fill).all(axis=1))
    return _packed(codec, some, rows[some])


def _packed(codec, some: np.ndarray, rows: np.ndarray) -> bytes:
    """A shard of these inner chunks, cells as they are."""
    size = rows.shape[1] * codec.dtype.itemsize
    index = np.full((math.prod(codec.counts), 2), MISSING, "<u8")
    index[some, 0] = np.arange(len(some)) * size + (0 if codec.at_end else codec.index_bytes)
    index[some, 1] = size
    cells, head = _plain(codec).encode(rows), codec.index.encode(index)
    return cells + head if codec.at_end else head + cells


def takes_cells(codec) -> bool:
    """Whether ``encode_cells`` makes the bytes that ``encode`` makes; a fill value of NaN equals nothing, so all is stored."""
    return _plain(codec) is not None and bool(codec.fill == codec.fill)


def encode_cells(codec, at: list[np.ndarray], values: np.ndarray) -> bytes:
    """A shard from its cells (a coordinate array for each dimension, in the shard) that differ from the fill value: it
    costs what these cells are and the index, not what the shard's extent is."""
    inner = codec.inner.chunk
    some, row = np.unique(np.ravel_multi_index([x // i for x, i in zip(at, inner, strict=True)], codec.counts), return_inverse=True)
    rows = np.full((len(some), math.prod(inner)), codec.fill, codec.dtype)
    rows[row, np.ravel_multi_index([x % i for x, i in zip(at, inner, strict=True)], inner)] = values
    return _packed(codec, some, rows)


def stored(index: np.ndarray) -> np.ndarray:
    """Which inner chunks a shard holds."""
    return (index[:, 0] != MISSING) | (index[:, 1] != MISSING)


def own_index(codec, data: bytes) -> np.ndarray:
    """The index of a whole shard."""
    return index_of(codec, data[len(data) - codec.index_bytes :] if codec.at_end else data[: codec.index_bytes])


def _rows_plain(codec, index: np.ndarray, some: np.ndarray, data: bytes) -> np.ndarray | None:
    """The stored inner chunks of a shard where they follow each other as ``_packed`` puts them; None for any other."""
    width = math.prod(codec.inner.chunk)
    size, first = width * codec.dtype.itemsize, int(index[some[0], 0]) if len(some) else 0
    if not (index[some, 1] == size).all() or (index[some, 0] != first + np.arange(len(some)) * size).any() or first + len(some) * size > len(data):
        return None
    cells = np.frombuffer(data, np.uint8, len(some) * size, first).reshape(len(some), size)
    return cells.view(_plain(codec).stored).astype(codec.dtype, copy=False) if codec.dtype.kind != "b" else cells != 0


def held(codec, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Which inner chunks a whole shard holds, in C order, and a row of cells for each; nothing for the others."""
    index = own_index(codec, data)
    some = np.flatnonzero(stored(index))
    rows = _rows_plain(codec, index, some, data) if _plain(codec) else None
    if rows is None:
        rows = np.full((len(some), math.prod(codec.inner.chunk)), codec.fill, codec.dtype)
        for k, (offset, length) in enumerate(index[some].tolist()):
            rows[k] = codec.inner.decode(data[offset : offset + length]).ravel()
    return some, rows


def encode(codec, array: np.ndarray) -> bytes:
    if _plain(codec):
        return _encode_plain(codec, array)
    n = math.prod(codec.counts)
    index, parts = np.full((n, 2), MISSING, "<u8"), []
    at = 0 if codec.at_end else codec.index_bytes
    for i in range(n):
        inner = np.ascontiguousarray(array[_slices(codec, i)])
        if not codec.inner.is_fill(inner):
            parts.append(codec.inner.encode(inner))
            index[i] = at, len(parts[-1])
            at += len(parts[-1])
    head = codec.index.encode(index)
    return b"".join([*parts, head] if codec.at_end else [head, *parts])


def index_of(codec, data: bytes) -> np.ndarray:
    """The index from the bytes that hold it alone."""
    if len(data) != codec.index_bytes:
        raise GridError("the shard is shorter than its index")
    return codec.index.decode(data)


def decode(codec, data: bytes) -> np.ndarray:
    if not _plain(codec):
        return assembled(codec, own_index(codec, data), lambda a, b: data[a:b])
    some, own = held(codec, data)
    rows = np.full((math.prod(codec.counts), own.shape[1]), codec.fill, codec.dtype)
    rows[some] = own
    return array_of(rows, codec.counts, codec.inner.chunk)


def assembled(codec, index: np.ndarray, read, wanted=None) -> np.ndarray:
    """A shard with the inner chunks that meet ``wanted`` (a slice for each dimension, or all); the others hold the
    fill value. ``read(start, stop)`` gives bytes of the shard."""
    out = np.full(codec.chunk, codec.fill, codec.dtype)
    for i, (offset, length) in enumerate(index.tolist()):
        own = _slices(codec, i)
        if offset == MISSING and length == MISSING or wanted and not all(a.start < w.stop and w.start < a.stop for a, w in zip(own, wanted, strict=True)):
            continue
        out[own] = codec.inner.decode(read(offset, offset + length))
    return out
