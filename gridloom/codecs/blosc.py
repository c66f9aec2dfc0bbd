"""Frames of the Blosc 1 format: blocks of byte- or bit-shuffled data under one of five compressors."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard

from ..errors import GridError

#: Compressor names and their codes in the header's flags. lz4hc data is lz4 data.
NAMES = {"blosclz": 0, "lz4": 1, "lz4hc": 1, "snappy": 2, "zlib": 3, "zstd": 4}
SHUFFLE, MEMCPY, BITSHUFFLE, WHOLE = 0x1, 0x2, 0x4, 0x10
BLOCK = 1 << 18


def _shuffled(data: bytes, kind: str, size: int, back: bool = False) -> bytes:
    n = len(data) // size
    if kind == "bitshuffle":
        n -= n % 8
    body, rest = np.frombuffer(data, np.uint8, n * size), data[n * size :]
    if not n or kind == "noshuffle" or kind == "shuffle" and size == 1:
        return data
    if kind == "shuffle":
        body = body.reshape(size, n).T if back else body.reshape(n, size).T
    elif back:
        body = np.packbits(np.unpackbits(body, bitorder="little").reshape(size * 8, n).T, bitorder="little")
    else:
        body = np.packbits(np.unpackbits(body, bitorder="little").reshape(n, size * 8).T, bitorder="little")
    return np.ascontiguousarray(body).tobytes() + rest


def _compressed(data: bytes, name: str, level: int) -> bytes:
    if name in ("lz4", "lz4hc"):
        return pa.Codec("lz4_raw").compress(data, asbytes=True)
    if name == "snappy":
        return pa.Codec("snappy").compress(data, asbytes=True)
    return zlib.compress(data, level) if name == "zlib" else zstandard.ZstdCompressor(2 * level or 1).compress(data)


def encode(data: bytes, name: str, level: int, shuffle: str, size: int, block: int = 0) -> bytes:
    block = max(size, min(len(data) or size, block or BLOCK) // size * size)
    flags = NAMES[name] << 5 | WHOLE | {"noshuffle": 0, "shuffle": SHUFFLE, "bitshuffle": BITSHUFFLE}[shuffle]
    parts = []
    if level and name != "blosclz":
        for at in range(0, len(data), block):
            own = _shuffled(data[at : at + block], shuffle, size)
            small = _compressed(own, name, level)
            parts.append(small if len(small) < len(own) else own)
    total = 16 + sum(8 + len(p) for p in parts)
    if not parts or total >= 16 + len(data):  # stored as it is
        return struct.pack("<BBBBIII", 2, 1, flags | MEMCPY, size, len(data), block, 16 + len(data)) + data
    starts, body, at = [], [], 16 + 4 * len(parts)
    for p in parts:
        starts.append(at)
        body.append(struct.pack("<i", len(p)) + p)
        at += 4 + len(p)
    return struct.pack("<BBBBIII", 2, 1, flags, size, len(data), block, at) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(body)


def decode(frame: bytes) -> bytes:
    if len(frame) < 16:
        raise GridError("a blosc frame has at least 16 bytes")
    _, _, flags, size, total, block, _ = struct.unpack_from("<BBBBIII", frame)
    if flags & MEMCPY:
        return frame[16 : 16 + total]
    kind = "shuffle" if flags & SHUFFLE else "bitshuffle" if flags & BITSHUFFLE else "noshuffle"
    n, out = -(-total // block) if block else 0, []
    for k, at in enumerate(struct.unpack_from(f"<{n}i", frame, 16)):
        length = min(block, total - k * block)
        streams = size if not flags & WHOLE and size <= 16 and block // size >= 128 and length == block else 1
        own = []
        for _ in range(streams):
            (stored,) = struct.unpack_from("<i", frame, at)
            part = frame[at + 4 : at + 4 + stored]
            own.append(part if stored == length // streams else _expanded(part, flags >> 5, length // streams))
            at += 4 + stored
        out.append(_shuffled(b"".join(own), kind, size, back=True))
    return b"".join(out)


def _expanded(data: bytes, code: int, size: int) -> bytes:
    if code == 1:
        return pa.Codec("lz4_raw").decompress(data, size, asbytes=True)
    if code == 2:
        return pa.Codec("snappy").decompress(data, size, asbytes=True)
    if code == 3:
        return zlib.decompress(data)
    if code == 4:
        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    return _blosclz(data)


def _blosclz(data: bytes) -> bytes:
    """Runs of literals, and matches as (length, distance back), with long lengths and far distances spelt out."""
    out, i, control = bytearray(), 1, data[0] & 31
    while True:
        if control < 32:
            out += data[i : i + control + 1]
            i += control + 1
        else:
            length, high = (control >> 5) - 1, (control & 31) << 8
            if length == 6:
                while data[i] == 255:
                    length += 255
                    i += 1
                length += data[i]
                i += 1
            low = data[i]
            i += 1
            back = high + low + 1
            if low == 255 and high == 31 << 8:
                back = 8192 + (data[i] << 8 | data[i + 1])
                i += 2
            for _ in range(length + 3):
                out.append(out[-back])
        if i >= len(data):
            return bytes(out)
        control = data[i]
        i += 1
