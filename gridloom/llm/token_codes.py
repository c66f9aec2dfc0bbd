"""Token ids in files of directly addressable codes, read back by range or by single position.

A segment holds the ids of consecutive documents. Every id is split into chunks of ``BITS`` bits, low chunk first.
Level 0 holds the low chunk of every id, level k the k-th chunk of those ids that are that long; a bitmap for each
level says which of its chunks continue, and a rank directory counts the set bits before every block of the bitmap.
So the chunk of an id at the next level is found by one rank, and any token is read without decoding what is before.

Segments are rows of a Parquet table in the shared folder, in ascending doc_id order: part (the task that wrote it),
segment, the ids in the task's segments before, the documents' ids and ends, and the code itself. They are never larger than ``SEGMENT_IDS`` ids unless one
document is. Only per-task totals meet in one place, to give each segment its start.

Defined results: null and empty texts have the end id alone; rows that repeat a doc_id follow each other, ordered by
their text; null doc_ids come first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, work_folder
from .pieces import Cache

BITS = 8
BLOCK = 512
SEGMENT_IDS = 1 << 20
MAGIC = b"DAC1"
#: Chunks and cores whose ids are kept, each in two generations.
CACHED = 400_000
#: Kept runs of punctuation, and the bytes of UTF-8 texts below U+0180.
STOPS, BELOW_0180 = 10_000, bytes(range(0xC6))
SEGMENTS = "part int, segment int, ids_before long, n_docs long, n_ids long, doc_ids binary, ends binary, code binary"


def packed(ids: np.ndarray) -> bytes:
    """The code of an array of unsigned ids."""
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        more = rest >> BITS != 0
        bitmap = np.packbits(more, bitorder="little")
        directory = np.concatenate(([0], np.cumsum(np.add.reduceat(more, range(0, len(more), BLOCK), dtype=np.uint32)))).astype("<u4") if len(more) else np.zeros(1, "<u4")
        levels.append((len(rest), (rest & (1 << BITS) - 1).astype(np.uint8).tobytes(), bitmap.tobytes(), directory.tobytes()))
        if not more.any():
            break
        rest = rest[more] >> BITS
    head = MAGIC + struct.pack("<I", len(levels)) + b"".join(struct.pack("<Q", n) for n, *_ in levels)
    return head + b"".join(part for level in levels for part in level[1:])


class Codes:
    """Reads a code: ``codes[i]`` for one id, ``codes.read(start, stop)`` for a range."""

    def __init__(self, code: bytes):
        if code[:4] != MAGIC:
            raise ValueError("not a code of this format")
        (n_levels,) = struct.unpack_from("<I", code, 4)
        sizes = struct.unpack_from(f"<{n_levels}Q", code, 8)
        at, self.levels = 8 + 8 * n_levels, []
        for n in sizes:
            chunks = np.frombuffer(code, np.uint8, n, at)
            bitmap = np.frombuffer(code, np.uint8, -(-n // 8), at + n)
            directory = np.frombuffer(code, "<u4", -(-n // BLOCK) + 1, at + n + len(bitmap))
            self.levels.append((chunks, bitmap, directory))
            at += n + len(bitmap) + 4 * len(directory)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, i: int) -> int:
        """Set bits before position i of a level's bitmap."""
        _, bitmap, directory = self.levels[level]
        block = i // BLOCK
        first = block * BLOCK // 8
        bits = np.unpackbits(bitmap[first : i // 8 + 1], bitorder="little")
        return int(directory[block]) + int(bits[: i - block * BLOCK].sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << BITS * k
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(k, i)
        return value

    def read(self, start: int, stop: int) -> np.ndarray:
        out = np.zeros(stop - start, np.uint32)
        into = np.arange(stop - start)
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out[into] |= chunks[start:stop].astype(np.uint32) << np.uint32(BITS * k)
            more = np.unpackbits(bitmap[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start].astype(bool)
            into = into[more]
            if not len(into):
                break
            start = self._rank(k, start)
            stop = start + len(into)
        return out


class ChunkEncoder:
    """Ids of white-space chunks, as the library gives them, kept in a bounded cache.

    The vocabulary drops white space and joins nothing across it, and its normaliser acts within the chunks between
    ASCII white space alone; so the ids of a text are those of its chunks. ASCII punctuation that ends a chunk after a
    letter or number is cut from it by the pattern, and letters below U+0180 have the ids of their lower case; so the library sees each
    such core once, and many new cores in one call.
    """

    def __init__(self, tokenizer_file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        from tokenizers import Tokenizer, pre_tokenizers

        self.own = Tokenizer.from_file(tokenizer_file)
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: The byte alphabet of each letter between U+0080 and U+017F.
        self.alphabet = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x180)}
        self.type, self.code = ("<u2", "H") if self.own.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.cores = Cache(lambda core: self._called([core])[0], CACHED)
        self.chunks = Cache(self._ids, CACHED)
        self.stops = Cache(lambda stop: self._called([stop])[0], STOPS)

    def split(self, chunk: bytes) -> tuple[str, bytes]:
        """The core that the library sees, and the ids of the punctuation after it."""
        text = chunk.decode()
        if not chunk.translate(None, BELOW_0180) and "\u0130" not in text and "<|" not in text:
            text = text.lower()
            if not text[-1].isalnum():
                core = text.rstrip(punctuation)
                if core and core[-1].isalnum():
                    return core, self.stops[text[len(core) :]]
        return text, b""

    def _ids(self, chunk: bytes) -> bytes:
        core, stop = self.split(chunk)
        return self.cores[core] + stop

    def _called(self, cores: list[str]) -> list[bytes]:
        """Words of lower-case letters are whole words to the pattern and the same after normalising: ASCII ones go to
        the library's model, others through its byte alphabet and model, all other cores through the whole tokenizer."""
        out, code, tokenize = [b""] * len(cores), self.code, self.own.model.tokenize
        rest = []
        for i, core in enumerate(cores):
            if not core.isalpha() or core != core.lower():
                rest.append(i)
            elif core.isascii():
                out[i] = array(code, [t.id for t in tokenize(core)]).tobytes()
            elif max(core) < "\u0180":
                out[i] = array(code, [t.id for t in tokenize(core.translate(self.alphabet))]).tobytes()
            else:
                rest.append(i)
        if rest:
            done = self.own.encode([cores[i] for i in rest], is_pretokenized=True, add_special_tokens=False)
            ids = array(code, done.ids).tobytes()
            width = len(ids) // max(1, len(done))
            cut = (np.searchsorted(np.asarray(done.word_ids, np.int64), np.arange(len(rest) + 1)) * width).tolist()
            for i, start, stop in zip(rest, cut[:-1], cut[1:], strict=True):
                out[i] = ids[start:stop]
        return out

    def learn(self, met: set[bytes]) -> dict[bytes, bytes]:
        """The ids of these chunks alone: a table that is small enough to be fast. Meets new chunks' cores in a few calls."""
        kept, cores, split = self.chunks, self.cores, self.split
        old = kept.old
        new: tuple[list, list, list] = ([], [], [])  # flat: a tuple for each would have the collector walk through the caches
        known = dict(zip(met, map(kept.get, met), strict=True))  # looked up: a set operation would walk through all of the caches' keys
        again = {}
        for chunk in [chunk for chunk, ids in known.items() if ids is None]:
            ids = old.get(chunk)
            if ids is None:
                core, stop = split(chunk)
                new[0].append(chunk)
                new[1].append(core)
                new[2].append(stop)
            else:
                again[chunk] = ids
        before, of_core, todo = cores.old, {}, []
        for core in set(new[1]):
            ids = cores.get(core) or before.get(core)
            if ids is None:
                todo.append(core)
            else:
                of_core[core] = ids
        for at in range(0, len(todo), 2000):
            some = todo[at : at + 2000]
            of_core.update(zip(some, self._called(some), strict=True))
        for chunk, core, stop in zip(*new, strict=True):
            again[chunk] = of_core[core] + stop
        cores.add(of_core)
        kept.add(again)
        known.update(again)
        return known

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [(t or "").encode().split() for t in texts]
        met: set[bytes] = set()
        met.update(*cut)
        ids = self.learn(met).__getitem__
        return [np.frombuffer(b"".join(map(ids, x)), self.type) for x in cut]


_encoders: dict[str, ChunkEncoder] = {}


def encoder(tokenizer_file: str) -> ChunkEncoder:
    """The encoder of this process."""
    if tokenizer_file not in _encoders:
        _encoders[tokenizer_file] = ChunkEncoder(tokenizer_file)
    return _encoders[tokenizer_file]


def _segments(tokenizer_file: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_file)
        end = np.asarray([end_id], own.type)
        part, number, before, docs, held, n = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def row() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in held]).astype("<i8")
            ids = np.asarray([-1 if d is None else d for d in docs], "<i8").tobytes() + np.packbits([d is None for d in docs]).tobytes()
            values = (part, number, before, len(held), int(ends[-1]), ids, ends.tobytes(), packed(np.concatenate(held).astype(np.uint32)))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            names = ["part", "segment", "ids_before", "n_docs", "n_ids", "doc_ids", "ends", "code"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                for doc_id, ids in zip(some.column(0).to_pylist(), own.encode(some.column(1).to_pylist()), strict=True):
                    docs.append(doc_id)
                    held.append(np.concatenate((ids, end)))
                    n += len(ids) + 1
                    if n >= SEGMENT_IDS:
                        yield row()
                        number, before, docs, held, n = number + 1, before + n, [], [], 0
        if held:
            yield row()

    return run


def write_codes(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """The segments, written to the shared folder in ascending doc_id order and read again."""
    folder = work_folder(docs.sparkSession, "codes")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(_segments(tokenizer_file, end_id), SEGMENTS), folder, "segments")


def placed(segments: DataFrame) -> DataFrame:
    """Segments with ``start``: ids in all segments before. One row per writing task is added up in one place and
    sent to all, so its size is bounded by the number of tasks."""
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    return segments.join(F.broadcast(parts), "part").withColumn("start", F.col("part_start") + F.col("ids_before"))


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from ``placed`` segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                n, docs, ends, code, start = (batch.column(c)[r].as_py() for c in range(5))
                codes, stops = Codes(code), np.frombuffer(ends, "<i8")
                starts = np.concatenate(([0], stops[:-1]))
                ids = codes.read(0, len(codes)).astype("<u4")
                null = np.unpackbits(np.frombuffer(docs, np.uint8, -1, 8 * n))[:n].astype(bool)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(docs, "<i8", n), mask=null), pa.array(start + starts), pa.array(stops - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.select("n_docs", "doc_ids", "ends", "code", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int = 1) -> DataFrame:
    """Documents' ids written as directly addressable codes and read back: doc_id, start, n_tokens, ids_crc32."""
    return read_documents(placed(write_codes(docs, tokenizer_file, end_id)))
