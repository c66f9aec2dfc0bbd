"""Exact SentencePiece encoding (merge type with byte fallback) by backtracking, and decoding.

A text, with U+2581 for every space and one more in front, is cut where no piece of the vocabulary can join the two
neighbours: before a run of U+2581 that follows something else, between letters and other characters, and around
characters that are not in the vocabulary (these become byte tokens). Each unit is then encoded without running the
merges: an Aho-Corasick automaton gives all pieces that match at each position, longest first; a piece is taken if
it is compatible with the one before it, that is, if merging the two pieces' text gives exactly these two again;
positions from which no way led to the end are kept in a bitfield and not tried twice. Compatibility of all
neighbours makes the result the one that the merges would give.

Short units and pairs already seen are kept in bounded caches that live as long as a partition is worked on; nothing
outlives it in the Python worker, which Spark uses again for other jobs. Documents are encoded whole, one at a time, so
memory is bounded by the longest one.

Defined results: null and empty texts have no ids and decode to the empty text; ties between equal merges go to the
leftmost, as in the library; every row gives a row, also where its doc_id is null or repeated; an empty table gives no
rows; other columns are not read. A model whose normaliser changes texts is refused.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back, parts

SPACE_MARK = "▁"
#: Units kept in each of a cache's two generations, and the characters of the longest that is kept (longer ones are
#: hardly met again): about 15 MB a generation.
CACHED, CACHED_CHARS = 70_000, 16
#: Pairs of pieces kept in each generation.
CACHED_PAIRS = 100_000



def by_class(others: str = "") -> tuple[re.Pattern, re.Pattern]:
    """Units: a run of marks with letters, a run of marks with other characters, or marks alone; and what a piece
    must be that joins no two units. Numbers that are neither letters nor digits (like ²) count as letters, but for those in ``others``."""
    o = re.escape(others)
    return re.compile(f"▁*(?:[^\\W\\d_{o}]+|(?:(?!▁)[\\W\\d_{o}])+)|▁+"), re.compile(f"[^\\W\\d_{o}]*\\Z|[\\W\\d_{o}]*\\Z")


UNIT_BY_CLASS = by_class()[0]
#: The same without the cut between letters and others, for vocabularies that join them.
UNIT_BY_SPACE = re.compile("▁*[^▁]+|▁+")


class Cache(dict):
    """Calls ``make`` for a missing key; keeps at most two generations of ``limit`` entries."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def add(self, new: dict) -> None:
        """Puts all of them, by one step for all; so a generation may exceed the limit by those of one call."""
        if self and len(self) + len(new) > self.limit:
            self.old = dict(self)
            self.clear()
        self.update(new)


class PieceCodec:
    """Encoder and decoder of one SentencePiece model file."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self._check(model)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.byte_id = {int(pieces[i][3:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.rank = {p: (-model.get_score(i), i) for i, p in enumerate(pieces) if not special[i] and not model.is_byte(i)}
        #: The place of each piece in the order of merging; none has ``last``.
        self.order = {p: k for k, p in enumerate(sorted(self.rank, key=self.rank.get))}
        self.last = len(self.order)
        self.pieces = pieces
        self.surface = [b"" if special[i] else bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.known = {p for p in self.rank if len(p) == 1}
        self.found = ahocorasick.Automaton()
        for piece, (_, i) in self.rank.items():
            self.found.add_word(piece, i)
        self.found.make_automaton()
        self.length, self.decimal = [len(p) for p in pieces], [str(i) for i in range(n)]
        #: The next shorter piece that a piece starts with, or -1.
        self.shorter = [next((self.rank[p[:k]][1] for k in range(len(p) - 1, 0, -1) if p[:k] in self.rank), -1) for p in pieces]
        inner = [p.lstrip(SPACE_MARK) for p in self.rank]
        joined = {c for p in inner if not by_class()[1].match(p) for c in p if UNIT_BY_CLASS.match(c) and c.isnumeric() and not c.isdecimal()}
        unit, fits = by_class("".join(sorted(joined)))
        self.unit = unit if all(fits.match(p) for p in inner) else UNIT_BY_SPACE
        if any(SPACE_MARK in p for p in inner):
            raise ValueError("a piece holds a space mark after another character; units can't be cut at spaces")
        self.pairs = Cache(self._compatible, CACHED_PAIRS)
        self.units = Cache(self._kept, CACHED)

    @staticmethod
    def _check(model) -> None:
        """Spaces and characters that other normalisers change must come back as they are."""
        for text in ("  a  b ", "ﬁ Ⅷ ｱ e\u0301 \u200b\u00a0\ttab"):
            if model.decode(model.encode(text)) != text:
                raise ValueError("the model's normaliser changes texts")

    def _compatible(self, key: int) -> bool:
        """Of the piece before (-1: none) and the next one."""
        before, i = key >> 32, key & 0xFFFFFFFF
        return self.merged((self.pieces[before] if before >= 0 else "") + self.pieces[i]) == ([before, i] if before >= 0 else [i])

    def merged(self, text: str) -> list[int]:
        """Ids by running the merges: the lowest rank first, then the leftmost. For short texts."""
        parts, rank, order, none = list(text), self.rank, self.order, self.last
        get = order.get
        joins = [get(x, none) for x in map(add, parts, parts[1:])]  # place of what each two neighbours would join to
        while joins and (best := min(joins)) != none:
            i = joins.index(best)
            parts[i] += parts.pop(i + 1)
            joins.pop(i)
            if i:
                joins[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(joins):
                joins[i] = get(parts[i] + parts[i + 1], none)
        return [rank[p][1] if p in rank else -1 for p in parts]

    def _searched(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary, by backtracking."""
        n = len(text)
        length, shorter, pairs = self.length, self.shorter, self.pairs
        longest = self.found.iter_long
        failed = None  # a bitfield, once a position has failed
        path: list[int] = []
        pos, before = 0, -1
        ahead = longest(text)
        i = next(ahead)[1]
        while True:
            while i >= 0:
                stop = pos + length[i]
                if (failed is None or not failed[stop >> 3] >> (stop & 7) & 1) and pairs[before << 32 | i]:
                    break
                i, ahead = shorter[i], None  # matches are no longer where the automaton stands
            if i >= 0:
                path.append(i)
                if stop == n:
                    return path
                pos, before = stop, i
                if ahead is None:
                    ahead = longest(text, pos)
                i = next(ahead)[1]
            else:
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                i = path.pop()
                pos -= length[i]
                before = path[-1] if path else -1
                i, ahead = shorter[i], None

    def unit_ids(self, unit: str) -> list[int]:
        if self.known.issuperset(unit):
            return self._searched(unit)
        ids: list[int] = []
        start = 0
        for i, c in enumerate(unit):
            if c not in self.known:
                ids += self._searched(unit[start:i]) if i > start else []
                ids += [self.byte_id[b] for b in c.encode()]
                start = i + 1
        return ids + (self._searched(unit[start:]) if start < len(unit) else [])

    def _kept(self, unit: str) -> tuple[str, bytes]:
        ids = self._searched(unit) if self.known.issuperset(unit) else self.unit_ids(unit)
        decimal = self.decimal
        return ",".join([decimal[i] for i in ids]), array("I", ids).tobytes()

    def _parts(self, text: str | None) -> list[tuple[str, bytes]]:
        if not text:
            return []
        units, kept, new = self.units, self._kept, {}
        found = self.unit.findall(SPACE_MARK + text.replace(" ", SPACE_MARK))
        met = set(found)
        known = dict(zip(met, map(units.get, met), strict=True))
        old = units.old
        for u in [u for u, ids in known.items() if ids is None]:
            known[u] = ids = old.get(u) or kept(u)
            if len(u) <= CACHED_CHARS:
                new[u] = ids
        units.add(new)
        return list(map(known.__getitem__, found))

    def forget(self) -> None:
        """Empties the caches, which refer back to this codec, so that its memory is free at once."""
        for cache in (self.units, self.pairs):
            cache.clear()
            cache.old, cache.make = {}, None

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join([x[1] for x in self._parts(text)]), np.uint32)

    def encode_listed(self, text: str | None) -> tuple[np.ndarray, str]:
        """Ids, and the same in decimal joined by commas."""
        parts = self._parts(text)
        return np.frombuffer(b"".join([x[1] for x in parts]), np.uint32), ",".join([x[0] for x in parts])

    def decode(self, ids) -> str:
        """The text of ids, without the space that encoding puts in front."""
        surface = self.surface
        text = b"".join([surface[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@contextmanager
def codec(model_file: str) -> Iterator[PieceCodec]:
    """A codec for one partition."""
    own = PieceCodec(model_file)
    try:
        yield own
    finally:
        own.forget()
        give_back()


def encoded(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (text) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(model_file) as own:
            for part in parts(batches, 256):
                ids = [own.encode(t.as_py()) for t in part.column(1)]
                columns = [
                    part.column(0).cast(pa.int64()),
                    pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                    pa.array([own.decode(x) for x in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """The digest of ``encoded``: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def digests(own: PieceCodec, text: str | None) -> tuple[int, str, str]:
        ids, listed = own.encode_listed(text)
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(model_file) as own:
            for part in parts(batches, 1024):
                columns = list(zip(*(digests(own, t.as_py()) for t in part.column(1)), strict=True)) or [(), (), ()]
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *arrays], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
