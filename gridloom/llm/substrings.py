"""Substring dedup: every run of words that repeats an earlier one goes, judged with suffix automata.

A window is ``WINDOW`` consecutive words. Each window has an anchor, the least fingerprint of its runs of ``GRAM``
words (the leftmost of equals), so equal windows have equal anchors at the same place. Consecutive windows with the
same anchor make a run; its words are a fragment.

1. Anchors are counted; one that occurs once can't belong to a repeated window. About one word in eight is an anchor.
2. Documents keep the runs whose anchor repeats. Others are done.
3. Equal fragments become one row, with the document and position where it is first met; copies are combined in each
   task before the shuffle. Every later copy of a fragment is covered as a whole.
4. Fragments of an anchor that has several are the reference, in shards of about ``SHARD_WORDS`` words by anchor. In
   each shard they stream, in the order of their first place, through the suffix automaton of those before; where
   the matching statistics reach ``WINDOW``, a window has started earlier; the other windows are new.
   An anchor with more than ``MOST`` fragments (at the edge of a passage that very many documents share, where the
   words next to it differ) is split: of its windows those with more words left of the anchor go one way, the others
   the other way, each under the anchor with the words next to it that all of them hold. Equal pieces become one row
   again, and pieces under a key that is still too large are split further; equal windows never part. A window alone
   is a piece of its own at the latest after four splits, and all pieces under its key are equal.
5. Each document unites its covered windows to maximal spans and drops their words.

The automata are shuffled to, not broadcast: the reference is made of the corpus itself and grows with it, and every
document would have to pass every shard. What is stored for a document is bounded by its length.

Defined results: null and empty texts have no words; texts under ``WINDOW`` words keep all; rows that repeat a doc_id
are one document written twice, so a row does not repeat its own twin; rows with a null doc_id are left as they are
and are no reference; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_set, hot_keys, parts, split_join, stored, with_membership, work_folder

WINDOW, GRAM = 20, 6
SHARD_WORDS = 60_000
#: Fragments of one anchor, or pieces of one key, that go to an automaton without a split.
MOST = 200
#: The most words that a window has on one side of its anchor.
SIDE = WINDOW - GRAM

_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # splits at the six ASCII white-space characters


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all runs of ``size`` words."""
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : len(h) - size + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def runs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window, last window and the anchor's place of each run."""
    if len(words) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    value = _rolled(h, GRAM)
    at, low, span = np.arange(len(value)), value, 1
    while span < WINDOW - GRAM + 1:  # the least of twice as many, the left one of equals
        step = min(span, WINDOW - GRAM + 1 - span)
        right = low[step:] < low[:-step]
        at, low, span = np.where(right, at[step:], at[:-step]), np.where(right, low[step:], low[:-step]), span + step
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    return low[first].view(np.int64), first, last, at[first]


class Automaton:
    """Suffix automaton of several word sequences; ``next`` is keyed by state and word."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, of: int | None = None) -> int:
        self.next.append({} if of is None else dict(self.next[of]))
        self.link.append(-1 if of is None else self.link[of])
        self.length.append(length)
        return len(self.next) - 1

    def add(self, sequence: list) -> None:
        last = 0
        for word in sequence:
            last = self._extended(last, word)

    def _split(self, p: int, q: int, word) -> int:
        """The state for what p's longest string and the word make, cut off from q."""
        clone = self._state(self.length[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extended(self, last: int, word) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(word)) is not None:  # as far as here it is known from an earlier sequence
            return q if length[q] == length[last] + 1 else self._split(last, q, word)
        new, p = self._state(length[last] + 1), last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, word)
        return new

    def statistics(self, sequence: list) -> list[int]:
        """For each position the length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for word in sequence:
            while (q := nxt[state].get(word)) is None and state:
                state = link[state]
                matched = length[state]
            if q is not None:
                state = q
                matched += 1
            out.append(matched)
        return out


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, 1024):
        found = [runs(words_of(t.as_py())) for t in part.column(1)]
        ids = np.repeat(part.column(0).to_numpy(), [len(x[0]) for x in found])
        anchors, firsts = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(ids), pa.array(firsts.astype(np.int32))], ["anchor", "doc_id", "first"])


def _kept_runs(text: str | None, firsts: list[int]):
    """Words, and (anchor, first window, windows, words left of the anchor, fragment) of the runs that start at ``firsts``."""
    words = words_of(text)
    found = runs(words)
    chosen = np.flatnonzero(np.isin(found[1], firsts))
    rows = zip(*(x[chosen].tolist() for x in found), strict=True)
    return words, [(a, i, j - i + 1, at - i, b" ".join(words[i : j + WINDOW])) for a, i, j, at in rows]


_FRAGMENT = {"anchor": pa.int64(), "fragment": pa.binary(), "doc_id": pa.int64(), "first": pa.int32(), "left": pa.int32()}


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, 256):
        rows: dict[tuple, tuple] = {}
        for doc_id, text, firsts in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
            for anchor, i, _, left, fragment in _kept_runs(text, firsts)[1]:
                rows.setdefault((anchor, fragment, doc_id), (i, left))
        columns = list(zip(*(k + v for k, v in rows.items()), strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FRAGMENT.values(), strict=True)], list(_FRAGMENT))


#: A piece: its key, words, first place, words left of the anchor, the range of words that its windows have left of it,
#: and the fragment it is of, with the first of its windows there.
PIECE = "key long, piece binary, doc_id long, start int, left int, low int, high int, anchor long, name long, k int"
_PIECE = {"key": pa.int64(), "piece": pa.binary(), "doc_id": pa.int64(), "start": pa.int32(), "left": pa.int32()}
_PIECE |= {"low": pa.int32(), "high": pa.int32(), "anchor": pa.int64(), "name": pa.int64(), "k": pa.int32()}


def halves(anchor: int, words: list[bytes], left: int, low: int, high: int):
    """(key, first window, words, words left of the anchor, low, high) of the one or two parts of a piece."""
    middle = (low + high) // 2
    for low, high in ((low, middle), (middle + 1, high)):
        first, last = max(0, left - high), min(len(words) - WINDOW, left - low)
        if first <= last:
            shared = words[left - low : left + WINDOW - high]
            key = xxhash.xxh3_64_intdigest(b"%d %d %d " % (anchor, low, high) + b" ".join(shared))
            yield np.uint64(key).view(np.int64).item(), first, words[first : last + WINDOW], left - first, low, high


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, 1024):
        rows = []
        for _, piece, doc_id, start, left, low, high, anchor, name, k in zip(*(c.to_pylist() for c in part.columns), strict=True):
            for key, first, words, rest, *bounds in halves(anchor, piece.split(b" "), left, low, high):
                rows.append((key, b" ".join(words), doc_id, start + first, rest, *bounds, anchor, name, k + first))
        columns = list(zip(*rows, strict=True)) or [()] * len(_PIECE)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE.values(), strict=True)], list(_PIECE))


def _first_of(pieces: DataFrame) -> DataFrame:
    """Of equal pieces under one key, the one that starts first."""
    rest = [c for c in _PIECE if c not in ("key", "piece")]
    least = pieces.groupBy("key", "piece").agg(F.min(F.struct(*rest)).alias("own"))
    return least.select("key", "piece", "own.*")


def _judged(shard: pa.Table) -> pa.Table:
    """Of a shard's pieces, those with windows that have not started earlier; ``new`` has a bit for each such window."""
    shard = shard.sort_by([("doc_id", "ascending"), ("start", "ascending")])
    own, ids, new = Automaton(), {}, []
    for piece, k in zip(shard.column("piece").to_pylist(), shard.column("k").to_pylist(), strict=True):
        sequence = [ids.setdefault(w, len(ids)) for w in piece.split(b" ")]
        new.append(sum(1 << k + i for i, n in enumerate(own.statistics(sequence)[WINDOW - 1 :]) if n < WINDOW))
        own.add(sequence)
    masks = pa.array(new, pa.int32())
    return shard.select(["doc_id", "anchor", "name"]).append_column("new", masks).filter(pa.array([x > 0 for x in new], pa.bool_()))


def _settled(pieces: DataFrame, folder: str) -> DataFrame:
    """Pieces with ``lone``: true only where no other piece has the key. Keys with more than ``MOST`` pieces are split.

    Which keys are large, or have several pieces, is told by bounded sets: a key that one takes for larger than it is
    costs work and changes nothing, and no row moves for it."""
    done, level = None, 0
    while True:
        sizes = stored(pieces.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), folder, f"sizes-{level}")
        large = sizes.where(F.col("n") > MOST)
        told = with_membership(pieces, "key", bounded_set(sizes, "key", folder, f"several-{level}"), "shared").withColumn("lone", ~F.col("shared")).drop("shared")
        last = large.isEmpty() or 1 << level > SIDE  # then each piece is one window
        if not last:
            told = with_membership(told, "key", bounded_set(large, "key", folder, f"large-{level}"), "large")
            again, told = told.where("large").select(*_PIECE), told.where("not large").drop("large")
        done = told if done is None else done.unionByName(told)
        if last:
            return done
        level += 1
        pieces = stored(_first_of(again.mapInArrow(_split, PIECE)), folder, f"pieces-{level}")


def repeated_runs(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """doc_id, firsts (starts of runs whose anchor repeats) and doc_id, news (anchor, name, new windows of the fragments
    that have such in this document); the job's folder. Documents without such runs are in neither."""
    spark = docs.sparkSession
    folder = work_folder(spark, "substrings")
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = stored(docs.mapInArrow(_placed, "anchor long, doc_id long, first int"), folder, "placed")
    several = stored(placed.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), folder, "anchors")
    placed = split_join(placed, several.select("anchor"), ["anchor"], "doc_id", hot_keys(several, "anchor"), "left_semi")
    firsts = stored(placed.groupBy("doc_id").agg(F.collect_set("first").alias("firsts")), folder, "firsts")

    told = with_membership(docs, "doc_id", bounded_set(firsts, "doc_id", folder, "suspects"), "maybe").where("maybe")
    schema = "anchor long, fragment binary, doc_id long, first int, left int"
    fragments = told.select("doc_id", "text").join(firsts, "doc_id").select("doc_id", "text", "firsts").mapInArrow(_fragments, schema)
    first = (F.min("doc_id").alias("doc_id"), F.min_by("first", "doc_id").alias("start"), F.min("left").alias("left"))
    classes = fragments.groupBy(F.col("anchor").alias("key"), F.col("fragment").alias("piece")).agg(*first)
    whole = {"low": F.lit(0), "high": F.lit(SIDE), "anchor": F.col("key"), "name": F.xxhash64("piece"), "k": F.lit(0)}
    done = _settled(stored(classes.withColumns(whole).select(*_PIECE), folder, "pieces-0"), folder)

    # A fragment under a key of its own is new as a whole.
    alone = done.where("lone").select("doc_id", "anchor", "name", (F.expr(f"shiftleft(1, cast(regexp_count(cast(piece as string), ' ') as int) + 2 - {WINDOW}) - 1") * F.expr("shiftleft(1, k)")).alias("new"))
    rest = done.where("not lone").select("key", "piece", "doc_id", "start", "anchor", "name", "k")
    shards = -(-rest.count() * (WINDOW + WINDOW // 3) // SHARD_WORDS) or 1
    judged = rest.groupBy(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")).applyInArrow(_judged, "doc_id long, anchor long, name long, new int")
    news = stored(alone.unionByName(judged).groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "name", "new")).alias("news")), folder, "news")
    return firsts, news, folder


_KEPT = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept": pa.string()}
_KEPT |= {"spans": pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))}


def _without(text: str | None, firsts: list[int] | None, news: list[dict] | None) -> tuple:
    if not firsts:
        words = words_of(text)
        return len(words), 0, b" ".join(words).decode(), []
    words, found = _kept_runs(text, firsts)
    mine: dict[tuple[int, int], int] = defaultdict(int)
    for x in news or ():
        mine[x["anchor"], x["name"]] |= x["new"]
    edge = np.zeros(len(words) + 1, np.int64)
    for anchor, i, n, _, fragment in found:
        new = mine.pop((anchor, np.uint64(_spark_hash(fragment)).view(np.int64).item()), 0)  # the first one in this document
        for k in range(n):
            if not new >> k & 1:
                edge[i + k] += 1
                edge[i + k + WINDOW] -= 1
    gone = (np.cumsum(edge)[:-1] > 0).astype(np.int8)
    spans = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])))).reshape(-1, 2).tolist()
    kept, at = [], 0
    for start, stop in spans:
        kept += words[at:start]
        at = stop
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept).decode(), [{"start": a, "stop": b} for a, b in spans]


def _dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, 256):
        rows = [_without(*x) for x in zip(*(part.column(c).to_pylist() for c in (1, 2, 3)), strict=True)]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), list(_KEPT.values())[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column(0), *columns], list(_KEPT))


def _spark_hash(value: bytes) -> int:
    """What xxhash64 gives for a binary column."""
    return xxhash.xxh64_intdigest(value, 42)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text: the words left, joined by one space), spans (removed words) of each row."""
    firsts, news, folder = repeated_runs(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = with_membership(docs, "doc_id", bounded_set(firsts, "doc_id", folder, "with-runs"), "maybe")
    schema = "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,stop:int>>"
    by_doc = firsts.join(news, "doc_id", "left")
    some = told.where("maybe").select("doc_id", "text").join(by_doc, "doc_id", "left").select("doc_id", "text", "firsts", "news")
    rest = told.where("not maybe").select("doc_id", "text", F.lit(None).cast("array<int>").alias("firsts"), F.lit(None).cast("array<struct<anchor:bigint,name:bigint,new:int>>").alias("news"))
    return some.mapInArrow(_dropped, schema).unionByName(rest.mapInArrow(_dropped, schema))


def substring_dedup(docs: DataFrame) -> DataFrame:
    """The digest: doc_id, n_words, n_removed, kept_sha256."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
