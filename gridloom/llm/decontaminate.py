"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Texts become words (runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower case), and the words of
items become numbers of a few digits; words that no item has share one sign. Every window of ``window`` consecutive
words of an item is a pattern, a shorter item is one pattern. The automaton runs once over the string that each
document's words make, and matches are mapped back to its words and to code points of the original text.

The automaton is made from the benchmark alone, in each task, and takes about 200 bytes a character of item text.
``max_chars`` bounds it. A benchmark of any size takes one such step for each ``max_chars`` of
its text: a step adds its hits and items to what the row has, so rows are neither grouped nor shuffled, and a row gives a
row; between steps the rows are stored, so that one automaton is in memory at a time.

Defined results: a null or wordless text has no words, no hits and no items; null or wordless items have no windows;
rows that repeat an item_id add their windows to one item; rows that repeat a doc_id, or have none, give a row each;
empty tables give no rows or no hits; other columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, stored, work_folder

WINDOW = 10
#: Characters of item text in one automaton.
MAX_CHARS = 1_600_000
#: Signs for a digit.
BASE = 32

#: The contract's word class, with A-Z, which ``lowered`` turns into a-z.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

STATE = "doc_id long, text string, hits array<int>, items array<string>"
SCHEMA = "doc_id long, n_words long, hits array<int>, spans array<struct<start:int,stop:int>>, items array<string>"
_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32())])


def lowered(text: str | None) -> str:
    """A-Z in lower case; every code point stays where it is."""
    return (text or "").encode().lower().decode()


class Numbers(dict):
    """Digits for each of some words, as many for each, and one sign for all others.

    The library goes through a node's branches one by one, so digits are of a small base; each place has signs of its
    own, so a match can't start or end within a word."""

    def __init__(self, words: Iterable[str]):
        super().__init__()
        words = sorted(set(words))
        self.width = next(d for d in itertools.count(1) if BASE**d >= len(words))
        for i, word in enumerate(words):
            self[word] = "".join(chr(1 + place * BASE + i // BASE**place % BASE) for place in range(self.width))

    def __missing__(self, word: str) -> str:
        return "\0"


class Items:
    """The automaton over the windows of (item id, text) rows; a pattern's value is (number of words, item ids)."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        import ahocorasick

        cut = [(item, WORD.findall(lowered(text))) for item, text in items]
        self.numbers = Numbers(w for _, words in cut for w in words)
        of: dict[str, set[str]] = defaultdict(set)
        for item, words in cut:
            words = [self.numbers[w] for w in words]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                of["".join(words[i : i + window])].add(item)
        self.found = ahocorasick.Automaton() if of else None
        for pattern, ids in of.items():
            self.found.add_word(pattern, (len(pattern) // self.numbers.width, tuple(sorted(ids))))
        if of:
            self.found.make_automaton()

    def hits(self, words: list[str]) -> tuple[set[int], set[str]]:
        """Positions of the words inside any occurrence of a pattern, and the items with an occurring pattern."""
        at: set[int] = set()
        items: set[str] = set()
        if self.found is not None and words:
            own = list(map(self.numbers.__getitem__, words))
            if matches := list(self.found.iter("".join(own))):
                stops = np.cumsum(list(map(len, own)))
                last = np.searchsorted(stops, [stop for stop, _ in matches], "right").tolist()
                for k, (_, (n, ids)) in zip(last, matches, strict=True):
                    at.update(range(k - n + 1, k + 1))
                    items.update(ids)
        return at, items


def spans_of(lower: str, hits: list[int]) -> list[dict[str, int]]:
    """Maximal runs of hit words as code points of the original text, end exclusive."""
    if not hits:
        return []
    at = [m.span() for m in WORD.finditer(lower)]
    runs = np.split(np.asarray(hits), np.flatnonzero(np.diff(hits) > 1) + 1)
    return [{"start": at[r[0]][0], "stop": at[r[-1]][1]} for r in runs]


def _scan(items, window: int, last: bool):
    """A step: ``STATE`` to ``STATE``, or to ``SCHEMA`` where it is the last."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for part in parts(batches, 512):
            own = own or Items(items.value, window)
            rows = []
            for doc_id, text, before, met in zip(*(c.to_pylist() for c in part.columns), strict=True):
                lower = lowered(text)
                words = WORD.findall(lower)
                at, ids = own.hits(words)
                hits, ids = sorted(at.union(before)), sorted(ids.union(met))
                rows.append((doc_id, len(words), hits, spans_of(lower, hits), ids) if last else (doc_id, text, hits, ids))
            kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "hits": pa.list_(pa.int32()), "spans": pa.list_(_SPAN), "items": pa.list_(pa.string())}
            if not last:
                kinds = {"doc_id": pa.int64(), "text": pa.string(), "hits": pa.list_(pa.int32()), "items": pa.list_(pa.string())}
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_chars: int = MAX_CHARS) -> DataFrame:
    """doc_id, n_words, hits (word positions), spans (code points), items (ids as strings) of each document."""
    spark = docs.sparkSession
    folder = work_folder(spark, "decontaminate")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text")).where("text is not null and item_id is not null")
    steps = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // max_chars) or 1
    none = (F.array().cast("array<int>").alias("hits"), F.array().cast("array<string>").alias("items"))
    state = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *none)
    for k in range(steps):
        own = items if steps == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(steps)) == k)
        sent = spark.sparkContext.broadcast([tuple(r) for r in own.collect()])  # at most about max_chars of text
        last = k + 1 == steps
        state = state.mapInArrow(_scan(sent, window, last), SCHEMA if last else STATE)
        state = state if last else stored(state, folder, str(k))
    return state


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``contamination``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, benchmark)
    n_hit = F.size("hits").cast("long")
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    counts = (n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"))
    return found.select("doc_id", "n_words", *counts, items.alias("items_sha256"), (n_hit > 0).alias("contaminated"))
