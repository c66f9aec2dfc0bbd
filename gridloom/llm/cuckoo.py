"""A cuckoo filter over 64-bit hashes, as one block of bytes."""

from __future__ import annotations

import struct

import numpy as np

SLOTS = 4
#: Moves before a hash goes to the stash.
KICKS = 200
#: The share of slots up to which a filter takes hashes.
FULL = 0.9
_MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """Membership with insertion and deletion; 16-bit fingerprints, four to a bucket.

    A fingerprint lies in one of two buckets, each found from the other and the fingerprint. What finds no place is
    kept whole in a stash, so insertion never fails and no member is ever denied; up to a load of ``FULL`` that hardly
    happens, and a filter that would get fuller is to be made anew, larger. Only hashes that were inserted may be
    deleted. Buckets are found from the low 32 bits of a hash; its high ones are free to choose among filters.
    """

    def __init__(self, capacity: int):
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * FULL)))))
        self.table, self.stash = np.zeros((buckets, SLOTS), np.uint16), set()

    @property
    def capacity(self) -> int:
        return int(self.table.size * FULL)

    @staticmethod
    def _places(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.asarray(h, np.int64).view(np.uint64) * _MIX
        mark = ((h >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (h & np.uint64(0xFFFFFFFF) & np.uint64(buckets - 1)).astype(np.int64)
        return mark, first, first ^ CuckooFilter._step(mark, buckets)

    @staticmethod
    def _step(mark: np.ndarray, buckets: int) -> np.ndarray:
        return ((mark.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7) & np.uint64(buckets - 1)).astype(np.int64)

    def contains(self, hashes) -> np.ndarray:
        hashes = np.asarray(hashes, np.int64)
        mark, a, b = self._places(hashes, len(self.table))
        found = (self.table[a] == mark[:, None]).any(axis=1) | (self.table[b] == mark[:, None]).any(axis=1)
        return found | np.isin(hashes, list(self.stash)) if self.stash else found

    def insert(self, hashes) -> None:
        hashes = np.asarray(hashes, np.int64)
        marks, firsts, seconds = self._places(hashes, len(self.table))
        for h, mark, a, b in zip(hashes.tolist(), marks, firsts.tolist(), seconds.tolist(), strict=True):
            if not self._placed(mark, a) and not self._placed(mark, b) and not self._moved(mark, a):
                self.stash.add(h)

    def _placed(self, mark, at: int) -> bool:
        free = np.flatnonzero(self.table[at] == 0)
        if len(free):
            self.table[at, free[0]] = mark
        return bool(len(free))

    def _moved(self, mark, at: int) -> bool:
        moves = []
        for k in range(KICKS):
            slot = (k * 7 + at) % SLOTS
            moves.append((at, slot, self.table[at, slot]))
            mark, self.table[at, slot] = self.table[at, slot], mark
            at ^= int(self._step(np.asarray([mark], np.uint16), len(self.table))[0])
            if self._placed(mark, at):
                return True
        for at, slot, was in reversed(moves):  # as it was before
            self.table[at, slot] = was
        return False

    def delete(self, hashes) -> None:
        hashes = np.asarray(hashes, np.int64)
        marks, firsts, seconds = self._places(hashes, len(self.table))
        for h, mark, a, b in zip(hashes.tolist(), marks, firsts.tolist(), seconds.tolist(), strict=True):
            if h in self.stash:
                self.stash.remove(h)
                continue
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == mark)
                if len(held):
                    self.table[at, held[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return struct.pack("<QQ", len(self.table), len(self.stash)) + self.table.tobytes() + np.asarray(sorted(self.stash), np.int64).tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> CuckooFilter:
        buckets, stashed = struct.unpack_from("<QQ", data)
        own = CuckooFilter(1)
        own.table = np.frombuffer(data, np.uint16, buckets * SLOTS, 16).reshape(-1, SLOTS).copy()
        own.stash = set(np.frombuffer(data, np.int64, stashed, 16 + own.table.nbytes).tolist())
        return own
