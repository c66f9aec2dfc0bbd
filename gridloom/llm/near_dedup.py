"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A signature has ``SYMBOLS`` MinHash values of 16 bits; two documents' distance is the number of symbols that differ.
Symbols are split into ``CHUNKS`` chunks. By the pigeonhole principle two signatures at a distance of at most
``RADIUS`` = CHUNKS * (ERRORS + 1) - 1 agree in some chunk but for ``ERRORS`` symbols; so every way to leave out that
many symbols of a chunk gives a key, and all pairs within the radius share a key. At the similarity of 0.85 a symbol
differs with probability 0.15; the chance that a link lies beyond the radius of 31 is then 5e-11 (binomial tail), at 0.8
it is 8e-8, and less at higher similarity.

1. Signatures: one pass over the texts. Documents with equal shingle sets become one class, under its smallest id.
2. Keys that occur once are dropped.
3. Stars: each class is compared with two leaders of each of its keys: signature, then full shingle sets. Confirmed
   links give components; a large group of near copies falls together here after a number of comparisons in
   proportion to its size.
4. Rest: only keys whose classes still lie in several components are open. All pairs of a small open key in different
   components are compared. Large open keys hold variants of one text or texts with a common passage, most pairs of
   which are near but not linked; for their classes the shared key is replaced by a rare shingle: with the shingles of
   all these classes in one order, rare ones first, two linked sets have one in common among the first
   n - ceil(0.85 n) + 1 of each. Keys of that kind that are large again are compared in blocks of bounded size.
   So no link within the radius is lost.
   Pairs whose sizes, or places of their shared rare shingle, can't make a link are no candidates.
5. Final components: the links of the rest join those of the stars.

Shingles are 64-bit fingerprints of runs of words; links are confirmed on the full sets of them, which are made again
from the texts of candidates alone. Keys and classes with very many rows are dealt to many tasks in every join.

Defined results: documents without words (null and empty ones too) have an empty set, link with nothing and are
kept; with one or two words the whole sequence is the one shingle; equal sets always link; rows that repeat a doc_id
count as one document, linked with whatever one of its rows links with; a row with a null doc_id takes the component
of the documents with its very set, else it is alone and kept; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_set, hot_keys, parts, split_join, stored, with_membership, work_folder
from .components import components

SYMBOLS, CHUNKS, ERRORS = 64, 16, 1
RADIUS = CHUNKS * (ERRORS + 1) - 1
#: Words of a shingle; links have 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 3, 85
#: Keys with more classes than this are compared in blocks, not by a join.
SMALL_KEY = 24
#: Classes in one block.
BLOCK = 1024

_MIX = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20240607)
_A = _random.integers(0, 2**63, SYMBOLS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**63, SYMBOLS, np.uint64)
_CHUNKS = np.array_split(np.arange(SYMBOLS), CHUNKS)
#: The symbols of each key.
PATTERNS = [tuple(i for i in chunk if i not in out) for chunk in _CHUNKS for out in itertools.combinations(chunk, ERRORS)]


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct fingerprints of the runs of ``size`` words; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : len(h) - size + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(sets: np.ndarray) -> np.ndarray:
    """16-bit MinHash symbols of a non-empty set."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), 2048):
        part = sets[at : at + 2048]
        least = np.minimum(least, (part[:, None] * _A + _B).min(axis=0))
    return ((least * _MIX) >> np.uint64(48)).astype(np.uint16)


def _signed(size: int):
    """Set size, name (a digest of the set) and signature of each document."""
    kinds = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "name": pa.binary(), "sign": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 2048):
            rows = []
            for text in part.column(1):
                own = shingles(text.as_py(), size)
                name = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                rows.append((len(own), name, signature(own).tobytes()) if len(own) else (0, None, None))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), list(kinds.values())[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *columns], list(kinds))

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            signs = _matrix(part.column(1)).astype(np.uint64)
            ids = part.column(0).to_numpy()
            keys = np.empty((len(PATTERNS), len(ids)), np.uint64)
            for k, symbols in enumerate(PATTERNS):
                h = np.full(len(ids), k + 1, np.uint64)
                for i in symbols:
                    h = (h ^ signs[:, i]) * _MIX
                    h ^= h >> np.uint64(31)
                keys[k] = h
            columns = [keys.ravel().view(np.int64), np.tile(ids, len(PATTERNS)), np.tile(part.column(2).to_numpy(), len(PATTERNS))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "id", "n_shingles"])


def _may_link(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _sizes_fit(n: str, m: str, percent: int) -> Column:
    """The same of two columns."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _near(percent: int):
    """Of a, b, their sizes and signatures: the pairs within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = (_matrix(batch.column(4)) != _matrix(batch.column(5))).sum(axis=1)
                good = pa.array((far <= RADIUS) & _may_link(batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent))
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(good) for k in (0, 1)], ["a", "b"])

    return run


def _near_in_block(percent: int):
    """Pairs of one key within the radius and in different components; ``side`` says which block a class is of.

    At the first rare shingle that two sets share, what follows it in both bounds what they share; so a pair whose
    bound is too small is left to an earlier shared key, or is no link."""

    def run(rows: pa.Table) -> pa.Table:
        side, ids, comp, n, rank = (rows.column(c).to_numpy() for c in ("side", "id", "component", "n_shingles", "rank"))
        signs = _matrix(rows.column("sign").combine_chunks() if rows.num_rows else pa.array([], pa.binary()))
        left = np.flatnonzero(side != 1)
        right = np.flatnonzero(side != 0)
        found: tuple[list, list] = ([], [])
        for i in left:
            js = right[(comp[right] != comp[i]) & _may_link(n[right], n[i], percent)]
            most = 1 + np.minimum(n[i] - rank[i], n[js] - rank[js])  # shared, if nothing before the key is
            js = js[(100 + percent) * most >= percent * (n[i] + n[js])]
            js = js[(signs[js] != signs[i]).sum(axis=1) <= RADIUS]
            for j in js:
                found[0].append(min(ids[i], ids[j]))
                found[1].append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return run


def _similar(percent: int):
    """Of a, b and their full sets: the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 512):
            sets = pa.array([shingles(t.as_py(), size).tobytes() for t in part.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), sets], ["id", "members"])

    return run


class _Job:
    """One run over a table: its folder, documents and classes."""

    def __init__(self, docs: DataFrame, size: int, percent: int):
        self.size, self.percent = size, percent
        self.docs = docs.select("doc_id", "text")
        self.folder = work_folder(docs.sparkSession, "near")
        self.signed = stored(self.docs.mapInArrow(_signed(size), "doc_id long, n_shingles long, name binary, sign binary"), self.folder, "signed")
        of_name = self.signed.where("n_shingles > 0 and doc_id is not null").groupBy("name", "n_shingles", "sign").agg(F.min("doc_id").alias("id"))
        self.classes = stored(of_name, self.folder, "classes")
        self.passes = 0

    def near(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a < b): those within the radius."""
        both = self._both(pairs, self.classes.select("id", "n_shingles", "sign"), ("n", "m"), ("s", "t"))
        return both.select("a", "b", "n", "m", "s", "t").mapInArrow(_near(self.percent), "a long, b long")

    def _both(self, pairs: DataFrame, of: DataFrame, *names: tuple[str, str]) -> DataFrame:
        """Pairs with what ``of`` (id, ...) has of a and of b, under the first and the second of each two names."""
        self.passes += 1
        pairs = stored(pairs.distinct(), self.folder, f"pairs-{self.passes}")
        hot = [hot_keys(pairs.groupBy(c).agg(F.count("*").alias("n")), c) for c in ("a", "b")]
        with_a = split_join(pairs, of.toDF("a", *(x for x, _ in names)), ["a"], "b", hot[0])
        return split_join(with_a, of.toDF("b", *(y for _, y in names)), ["b"], "a", hot[1])

    def sets(self, ids: DataFrame, name: str) -> DataFrame:
        """id, members (the full set) of the classes in ``ids`` (column doc_id), made from their texts."""
        wanted = stored(ids.distinct(), self.folder, f"ids-{name}")
        some = with_membership(self.docs, "doc_id", bounded_set(wanted, "doc_id", self.folder, f"set-{name}"), "wanted").where("wanted")
        sets = some.select("doc_id", "text").join(wanted, "doc_id", "left_semi").mapInArrow(_sets(self.size), "id long, members binary")
        return stored(sets.where(F.length("members") > 0), self.folder, f"sets-{name}")

    def linked(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs within the radius: those whose full sets are similar."""
        pairs = stored(pairs, self.folder, f"near-{name}")
        both = self._both(pairs, self.sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), name), ("x", "y"))
        return stored(both.select("a", "b", "x", "y").mapInArrow(_similar(self.percent), "a long, b long"), self.folder, f"links-{name}")

    def joined(self, placed: DataFrame, links: DataFrame) -> DataFrame:
        """``placed`` (id, component) with components joined where a link leads from one to another."""
        between = self._both(links, placed, ("c", "d")).select(F.col("c").alias("a"), F.col("d").alias("b"))
        larger = components(between, self.folder, "all").toDF("component", "of")
        hot = hot_keys(stored(placed.groupBy("component").agg(F.count("*").alias("n")), self.folder, "component-sizes"), "component")
        return split_join(placed, larger, ["component"], "id", hot, "left").select("id", F.coalesce("of", "component").alias("component"))

    def rare_shingles(self, ids: DataFrame) -> DataFrame:
        """key (a shingle), id, rank: those among each set's rarest that a linked set must share one of."""
        each = stored(self.sets(ids, "rare").mapInArrow(_exploded, "id long, s long, n int"), self.folder, "shingles")
        held = stored(each.groupBy("s").agg(F.count("*").alias("held")).where("held > 1"), self.folder, "held")
        own = split_join(each, held, ["s"], "id", hot_keys(held, "s", "held"))
        rank = F.row_number().over(Window.partitionBy("id").orderBy("held", "s")) + F.col("n") - F.count("*").over(Window.partitionBy("id"))
        first = F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1
        return own.withColumn("rank", rank).where(F.col("rank") <= first).select(F.col("s").alias("key"), "id", "rank")


def near_classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> tuple[_Job, DataFrame]:
    """The job with its classes, and id, component of each class."""
    job = _Job(docs, size, percent)
    folder = job.folder
    keys = job.classes.select("id", "sign", "n_shingles").mapInArrow(_keys, "key long, id long, n_shingles long")
    sized = F.struct("id", F.col("n_shingles").alias("m"))
    leaders = F.array(F.min(sized), F.min(F.struct(F.xxhash64("id").alias("h"), sized.alias("of")))["of"]).alias("leaders")
    several = stored(keys.groupBy("key").agg(F.count("*").alias("size"), leaders).where("size > 1"), folder, "several")
    hot = hot_keys(several, "key", "size")
    shared = stored(split_join(keys, several, ["key"], "id", hot), folder, "shared")

    stars = shared.select("id", "n_shingles", F.inline("leaders").alias("leader", "m")).where("id <> leader").where(_sizes_fit("n_shingles", "m", percent))
    stars = stars.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b"))
    links = job.linked(job.near(stars), "stars")
    found = components(links, folder, "stars")

    placed = job.classes.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = stored(placed.select("id", "component", "n_shingles", "sign"), folder, "placed")
    members = shared.select("key", "id", "n_shingles", "size").join(placed.select("id", "component"), "id")
    rest = stored(_open(members, hot), folder, "open")
    pairs = _pairs(rest.where(F.col("size") <= SMALL_KEY), percent)
    large = rest.where(F.col("size") > SMALL_KEY).select(F.col("id").alias("doc_id"))
    rare = stored(job.rare_shingles(large).join(placed.select("id", "n_shingles", "component"), "id"), folder, "rare")
    sizes = stored(rare.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), folder, "rare-sizes")
    hot = hot_keys(sizes, "key", "size")
    rare = stored(_open(split_join(rare, sizes, ["key"], "id", hot), hot), folder, "rare-open")
    near = job.near(pairs.unionByName(_pairs(rare.where(F.col("size") <= SMALL_KEY), percent, "rank")))
    more = job.linked(near.unionByName(_blocks(rare.where(F.col("size") > SMALL_KEY), placed, percent)), "rest")
    return job, job.joined(placed.select("id", "component"), more)


def _open(members: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows of keys whose classes lie in several components; ``hot``: keys with very many rows."""
    still = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return split_join(members, still, ["key"], "id", hot)


def _pairs(few: DataFrame, percent: int, rank: str | None = None) -> DataFrame:
    """a < b in different components of small keys, of sizes that fit; ``rank``: the column with the key's place in the
    order of each set's shingles, which bounds what two sets share as in ``_near_in_block``."""
    few = few.select("key", "id", "component", "n_shingles", (F.col(rank) if rank else F.lit(1)).alias("rank"))
    both = few.join(few.toDF("key", "b", "c", "m", "other"), "key").where("id < b and component <> c").where(_sizes_fit("n_shingles", "m", percent))
    most = 1 + F.least(F.col("n_shingles") - F.col("rank"), F.col("m") - F.col("other"))
    if rank:
        both = both.where((100 + percent) * most >= percent * (F.col("n_shingles") + F.col("m")))
    return both.select(F.col("id").alias("a"), "b").distinct()


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            own = [np.frombuffer(x.as_py(), np.int64) for x in part.column(1)]
            sizes = [len(x) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(np.concatenate(own)), pa.array(np.repeat(sizes, sizes).astype(np.int32))], ["id", "s", "n"])


def _blocks(rest: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Pairs within the radius among classes of large open keys: every two blocks of a key meet in one task."""
    n = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), n).cast("int")
    rows = rest.select("key", "id", "rank", n.alias("n"), own.alias("own")).join(placed, "id")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side")
    two = (F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side)
    rows = rows.select("key", *two, "id", "component", "n_shingles", "rank", "sign")
    return rows.groupBy("key", "i", "j").applyInArrow(_near_in_block(percent), "a long, b long")


def near_dedup(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of documents. Shingles have ``size`` words; documents link
    where 100 * intersection >= ``percent`` * union."""
    job, found = near_classes(docs, size, percent)
    of_class = job.classes.join(found, "id").select("name", F.col("component").alias("component_id"))
    rows = job.signed.join(of_class, "name", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
