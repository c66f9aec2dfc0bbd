"""Chunk codecs: pure functions between arrays and bytes, by name, and pipelines of them.

``register_codec`` adds a codec of one's own: a class made from (configuration, chunk shape, dtype, fill) with
``kind`` ("array", "bytes" for array to bytes, or "raw" for bytes to bytes), ``encode`` and ``decode``; array codecs
also have ``shape``, the shape they turn a chunk into.
"""

from __future__ import annotations

import gzip
import math
import sys
import zlib

import numpy as np
import zstandard

from ..errors import GridError
from . import blosc, shards
from .checksum import crc32c
from .reshape import resolved

_registry: dict[str, type] = {}


def register_codec(name: str, cls: type) -> None:
    _registry[name] = cls


def _level(value, low: int, high: int, name: str) -> int:
    if not isinstance(value, int) or not low <= value <= high:
        raise GridError(f"{name} level {value!r} is not in {low}..{high}")
    return value


class Codec:
    kind = "raw"

    def __init__(self, conf: dict, shape: tuple[int, ...], dtype: np.dtype, fill):
        self.conf, self.chunk, self.dtype, self.fill = conf, tuple(shape), dtype, fill

    def encoded_size(self, size: int) -> int:
        raise GridError(f"{type(self).__name__} has no fixed size")


class Bytes(Codec):
    kind = "bytes"

    def __init__(self, *args):
        super().__init__(*args)
        endian = self.conf.get("endian")
        if endian not in ("little", "big", None) or endian is None and self.dtype.itemsize > 1:
            raise GridError(f"bytes: endian {endian!r} for {self.dtype}")
        self.stored = self.dtype.newbyteorder(">" if endian == "big" else "<")

    def encode(self, array: np.ndarray) -> bytes:
        return np.ascontiguousarray(array).astype(self.stored, copy=False).tobytes()

    def decode(self, data: bytes) -> np.ndarray:
        if self.dtype.kind == "b":
            return (np.frombuffer(data, np.uint8) != 0).reshape(self.chunk)
        return np.frombuffer(data, self.stored).astype(self.dtype, copy=False).reshape(self.chunk)

    def encoded_size(self, size: int) -> int:
        return size


class Transpose(Codec):
    kind = "array"

    def __init__(self, *args):
        super().__init__(*args)
        self.order = tuple(self.conf.get("order", ()))
        if sorted(self.order) != list(range(len(self.chunk))):
            raise GridError(f"transpose: {self.order} is no permutation of {len(self.chunk)} dimensions")
        self.shape = tuple(self.chunk[i] for i in self.order)

    def encode(self, array: np.ndarray) -> np.ndarray:
        return np.transpose(array, self.order)

    def decode(self, array: np.ndarray) -> np.ndarray:
        return np.transpose(array, np.argsort(self.order))

    def encoded_size(self, size: int) -> int:
        return size


class Reshape(Codec):
    kind = "array"

    def __init__(self, *args):
        super().__init__(*args)
        self.shape = resolved(self.chunk, self.conf.get("shape"))

    def encode(self, array: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(array).reshape(self.shape)

    def decode(self, array: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(array).reshape(self.chunk)

    def encoded_size(self, size: int) -> int:
        return size


class Gzip(Codec):
    def __init__(self, *args):
        super().__init__(*args)
        self.level = _level(self.conf.get("level", 0), 0, 9, "gzip")

    def encode(self, data: bytes) -> bytes:
        return gzip.compress(data, self.level, mtime=0)

    def decode(self, data: bytes) -> bytes:
        return gzip.decompress(data)


class Zlib(Gzip):
    def encode(self, data: bytes) -> bytes:
        return zlib.compress(data, self.level)

    def decode(self, data: bytes) -> bytes:
        return zlib.decompress(data)


class Zstd(Codec):
    def __init__(self, *args):
        super().__init__(*args)
        self.level, self.checksum = _level(self.conf.get("level", 0), -131072, 22, "zstd"), bool(self.conf.get("checksum", False))

    def encode(self, data: bytes) -> bytes:
        return zstandard.ZstdCompressor(self.level, write_checksum=self.checksum).compress(data)

    def decode(self, data: bytes) -> bytes:
        return zstandard.ZstdDecompressor().decompress(data)


class Crc32c(Codec):
    def encode(self, data: bytes) -> bytes:
        return data + crc32c(data).to_bytes(4, "little")

    def decode(self, data: bytes) -> bytes:
        if len(data) < 4 or crc32c(data[:-4]) != int.from_bytes(data[-4:], "little"):
            raise GridError("the checksum does not fit the data")
        return data[:-4]

    def encoded_size(self, size: int) -> int:
        return size + 4


class Blosc(Codec):
    def __init__(self, *args):
        super().__init__(*args)
        c = self.conf
        shuffle = c.get("shuffle", "noshuffle")
        names = ("noshuffle", "shuffle", "bitshuffle")
        self.shuffle = names[shuffle] if isinstance(shuffle, int) and 0 <= shuffle < 3 else shuffle
        self.level = _level(c.get("clevel", 5), 0, 9, "blosc")
        self.typesize = c.get("typesize") or (self.dtype.itemsize if isinstance(shuffle, int) else 0)
        if self.shuffle not in names or c.get("cname", "zstd") not in blosc.NAMES or self.typesize < 1 and self.shuffle != "noshuffle":
            raise GridError(f"blosc: {c}")

    def encode(self, data: bytes) -> bytes:
        return blosc.encode(data, self.conf.get("cname", "zstd"), self.level, self.shuffle, max(1, self.typesize), self.conf.get("blocksize", 0))

    def decode(self, data: bytes) -> bytes:
        return blosc.decode(data)


class Sharding(Codec):
    kind = "bytes"

    def __init__(self, *args):
        super().__init__(*args)
        inner = tuple(self.conf["chunk_shape"])
        if len(inner) != len(self.chunk) or any(i < 1 or c % i for c, i in zip(self.chunk, inner, strict=False)):
            raise GridError(f"inner chunks {inner} do not divide the shard {self.chunk}")
        self.counts = tuple(c // i for c, i in zip(self.chunk, inner, strict=True))
        n = math.prod(self.counts)
        self.at_end = {"end": True, "start": False, None: True}.get(self.conf.get("index_location"))
        if self.at_end is None:
            raise GridError(f"index_location {self.conf['index_location']!r}")
        self.inner = Pipeline(self.conf["codecs"], inner, self.dtype, self.fill)
        self.index = Pipeline(self.conf["index_codecs"], (n, 2), np.dtype("<u8"), np.uint64(0))
        self.index_bytes = self.index.encoded_size()

    def encode(self, array: np.ndarray) -> bytes:
        return shards.encode(self, array)

    def decode(self, data: bytes) -> np.ndarray:
        return shards.decode(self, data)


for _name, _cls in (("bytes", Bytes), ("transpose", Transpose), ("reshape", Reshape), ("gzip", Gzip), ("zlib", Zlib), ("zstd", Zstd), ("crc32c", Crc32c), ("blosc", Blosc), ("sharding_indexed", Sharding)):
    register_codec(_name, _cls)
#: Codecs of version 2; version 3 has the others.
_V2 = {"blosc", "zlib", "zstd"}


class Pipeline:
    """Array codecs, then one that makes bytes, then codecs of bytes; decoding is the reverse."""

    def __init__(self, specs, shape: tuple[int, ...], dtype: np.dtype, fill, version: int = 3):
        self.chunk, self.dtype, self.fill, self.codecs = tuple(shape), dtype, fill, []
        stage = 0
        for spec in specs:
            old = version == 2 and "id" in spec
            name = spec.get("id" if old else "name")
            if name not in _registry or old and name not in _V2:
                raise GridError(f"unknown codec {name!r}")
            conf = {k: v for k, v in spec.items() if k != "id"} if old else spec.get("configuration") or {}
            own = _registry[name](conf, shape, dtype, fill)
            now = {"array": 0, "bytes": 1, "raw": 2}[own.kind]
            if now < stage or now == 1 and stage == 1 or now == 2 and stage == 0:
                raise GridError(f"codec {name!r} stands in the wrong place")
            stage = max(stage, now)
            if now == 0:
                shape = own.shape
            self.codecs.append(own)
        if stage == 0:
            raise GridError("no codec makes bytes of the array")

    def encode(self, array: np.ndarray) -> bytes:
        for codec in self.codecs:
            array = codec.encode(array)
        return array

    def decode(self, data: bytes) -> np.ndarray:
        for codec in reversed(self.codecs):
            data = codec.decode(data)
        return data

    def encoded_size(self) -> int:
        """Bytes of an encoded chunk; compressors have no fixed size."""
        size = math.prod(self.chunk) * self.dtype.itemsize
        for codec in self.codecs:
            size = codec.encoded_size(size)
        return size

    @property
    def shard(self) -> Sharding | None:
        """The sharding codec, where inner chunks can be read alone."""
        return self.codecs[0] if len(self.codecs) == 1 and isinstance(self.codecs[0], Sharding) else None

    @property
    def sharded(self) -> Sharding | None:
        """The sharding codec, where inner chunks lie in the array's own order, also if shards are compressed."""
        return self.codecs[0] if isinstance(self.codecs[0], Sharding) else None

    def bytes_of(self, data: bytes) -> bytes:
        """What the codec that makes bytes had made: the bytes without compression and checksums."""
        for codec in reversed(self.codecs):
            if codec.kind != "raw":
                break
            data = codec.decode(data)
        return data

    def is_fill(self, array: np.ndarray) -> bool:
        """Whether all cells equal the fill value; NaN equals nothing."""
        return bool((array == self.fill).all())


def v2_defaults(name: str) -> dict:
    return {"blosc": {"cname": "zstd", "shuffle": 0, "clevel": 5, "typesize": 0, "blocksize": 0}, "zlib": {"level": 1}, "zstd": {"level": 0, "checksum": False}}.get(name, {})


class CodecBuilder:
    """A list of version 3 codecs; ``bytes`` (little-endian) is put in where no codec makes bytes."""

    def __init__(self, dtype: str):
        self.dtype, self.list = dtype, []

    def _add(self, name: str, **conf) -> CodecBuilder:
        self.list.append({"name": name} | ({"configuration": conf} if conf else {}))
        return self

    def blosc(self, cname="zstd", shuffle="noshuffle", clevel=5, typesize: int | None = None, blocksize=0) -> CodecBuilder:
        from ..meta import DTYPES

        return self._add("blosc", cname=cname, shuffle=shuffle, clevel=clevel, typesize=typesize or np.dtype(DTYPES[self.dtype][0]).itemsize, blocksize=blocksize)

    def transpose(self, *order: int) -> CodecBuilder:
        return self._add("transpose", order=list(order))

    def reshape(self, *shape) -> CodecBuilder:
        return self._add("reshape", shape=list(shape))

    def bytes(self, endian: str = sys.byteorder) -> CodecBuilder:
        return self._add("bytes", endian=endian)

    def gzip(self, level=5) -> CodecBuilder:
        return self._add("gzip", level=level)

    def zstd(self, level=5, checksum=True) -> CodecBuilder:
        return self._add("zstd", level=level, checksum=checksum)

    def crc32c(self) -> CodecBuilder:
        return self._add("crc32c")

    def sharding(self, *chunks: int, codecs=None, index_location="end", index_codecs=None) -> CodecBuilder:
        inner = codecs(CodecBuilder(self.dtype)).build() if callable(codecs) else codecs or [{"name": "bytes", "configuration": {"endian": "little"}}]
        index = index_codecs or [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]
        return self._add("sharding_indexed", chunk_shape=list(chunks), codecs=inner, index_codecs=index, index_location=index_location)

    def build(self) -> list[dict]:
        kinds = [_registry[c["name"]].kind for c in self.list]
        if "bytes" not in kinds:
            at = next((i for i, k in enumerate(kinds) if k == "raw"), len(kinds))
            return [*self.list[:at], {"name": "bytes", "configuration": {"endian": "little"}}, *self.list[at:]]
        return list(self.list)
