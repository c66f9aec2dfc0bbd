"""CRC-32C (Castagnoli)."""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0x82F63B78
#: Parts of a long value that are summed side by side.
LANES = 1024


def _table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (POLYNOMIAL if i & 1 else 0)
        out.append(i)
    return out


_TABLE = _table()
_ARRAY = np.asarray(_TABLE, np.uint32)


def _plain(data: bytes, crc: int) -> int:
    for b in data:
        crc = _TABLE[(crc ^ b) & 0xFF] ^ crc >> 8
    return crc


def crc32c(data: bytes) -> int:
    """A long value is cut into lanes that one loop takes byte by byte together. The sum is linear, so what a state
    becomes over a lane's length follows from what each of its 32 bits becomes; those run along as lanes of zeros."""
    crc, length = 0xFFFFFFFF, len(data) // LANES
    if length < 16:
        return _plain(data, crc) ^ 0xFFFFFFFF
    columns = np.zeros((length, LANES + 32), np.uint8)
    columns[:, :LANES] = np.frombuffer(data, np.uint8, LANES * length).reshape(LANES, length).T
    state = np.concatenate((np.zeros(LANES, np.uint32), np.uint32(1) << np.arange(32, dtype=np.uint32)))
    for column in columns:
        state = _ARRAY[(state ^ column) & np.uint32(0xFF)] ^ state >> np.uint32(8)
    parts = state.tolist()
    bits = parts[LANES:]
    for lane in parts[:LANES]:
        moved = lane
        for k in range(32):
            if crc >> k & 1:
                moved ^= bits[k]
        crc = moved
    return _plain(data[LANES * length :], crc) ^ 0xFFFFFFFF
