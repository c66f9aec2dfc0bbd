"""Reversible line dedup: exact reference counts with sharded cuckoo filters in front.

A line's key is the line stripped of ASCII white space at both ends, A-Z in lower case; keys of at least
``MIN_CHARS`` characters count. The index holds, as Parquet tables in the shared folder:

* postings: h, doc_id; which documents hold a key with this 64-bit hash (the exact references),
* counts: shard, h, n; the number of documents of each hash,
* filters: shard, filter; a cuckoo filter for each range of hashes, of those that ``MIN_DOCS`` documents hold.

Inserting documents adds postings, deleting documents takes theirs away; counts follow exactly, and hashes that cross
the limit enter or leave their shard's filter. A filter that would get too full is made anew from the counts, larger;
when the filters have grown to twice their size on average, there are more shards. After a deletion the index answers as
if the documents had never been there. Applying it passes every line through the filters; the lines that get through
are counted by their whole key, so neither a filter's errors nor equal hashes change the result.

Filters are broadcast while they take at most ``FILTER_BYTES``; where they take more, the hashes go to them, each
once, dealt by shard, and the lines are joined to those that get through. A line that very many documents share is
pre-counted in each task, and its rows are dealt to many tasks in each join.

Defined results: a null or empty text is one empty line; a document is a doc_id, so rows that repeat one count once;
a row with a null doc_id is in no count and keeps its lines; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_set, hot_keys, parts, split_join, stored, with_membership, work_folder
from .cuckoo import CuckooFilter

MIN_CHARS, MIN_DOCS = 20, 3
#: Hashes that a filter is made for.
SHARD = 1 << 15
#: Bytes of all filters together that may be broadcast.
FILTER_BYTES = 64 << 20
_BLANK = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys(text: Column) -> Column:
    """Distinct keys of a text that are long enough."""
    every = F.transform(lines(text), lambda x: ascii_lower(F.btrim(x, F.lit(_BLANK))))
    return F.array_distinct(F.filter(every, lambda k: F.length(k) >= MIN_CHARS))


def key_of(line: str) -> str:
    """The same key, in Python."""
    return line.strip(_BLANK).encode().lower().decode()


def _postings(docs: DataFrame) -> DataFrame:
    hashes = F.array_distinct(F.transform(keys(F.col("text")), lambda k: F.xxhash64(k)))
    return docs.where("doc_id is not null").select(F.explode(hashes).alias("h"), "doc_id").distinct()


def _changed(group: tuple, filters: pa.Table, changes: pa.Table) -> pa.Table:
    """A shard's filter after the hashes that enter (up) or leave it; a new one where there was none."""
    h, up = changes.column("h").to_numpy(), changes.column("up").to_numpy(zero_copy_only=False)
    own = CuckooFilter.from_bytes(filters.column("filter")[0].as_py()) if filters.num_rows else CuckooFilter(max(SHARD // 16, 2 * int(up.sum())))
    own.delete(h[~up])
    own.insert(h[up])
    kinds = {"shard": pa.int32(), "room": pa.int64(), "filter": pa.binary()}
    return pa.table({c: pa.array([v], kinds[c]) for c, v in zip(kinds, (group[0].as_py(), own.capacity, own.to_bytes()), strict=True)})


def _shard(h: Column, shards: int) -> Column:
    """From the high bits of a hash; a filter takes its buckets from the low ones."""
    return (F.shiftrightunsigned(h, 33) % shards).cast("int")


@dataclass(frozen=True)
class LineIndex:
    folder: str
    version: int
    shards: int
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame

    @staticmethod
    def create(docs: DataFrame) -> LineIndex:
        folder = work_folder(docs.sparkSession, "lines")
        postings = stored(_postings(docs), folder, "postings-0")
        counts = stored(postings.groupBy("h").agg(F.count("*").alias("n")), folder, "counts-0")
        shards = -(-counts.where(F.col("n") >= MIN_DOCS).count() // SHARD) or 1
        return LineIndex(folder, 0, shards, postings, counts, _filters(counts, shards, folder, "filters-0"))

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with more documents; documents it already holds stay as they are."""
        return self._with(_postings(docs).join(self.postings, ["h", "doc_id"], "left_anti"), 1)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without the documents of column doc_id."""
        return self._with(self.postings.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select("h", "doc_id"), -1)

    def _with(self, change: DataFrame, sign: int) -> LineIndex:
        v, folder = self.version + 1, self.folder
        change = stored(change, folder, f"change-{v}")
        postings = self.postings.unionByName(change) if sign > 0 else self.postings.join(change, ["h", "doc_id"], "left_anti")
        step = change.groupBy("h").agg((F.count("*") * sign).alias("step"))
        both = self.counts.join(step, "h", "full").select("h", F.coalesce("n", F.lit(0)).alias("was"), (F.coalesce("n", F.lit(0)) + F.coalesce("step", F.lit(0))).alias("n"))
        both = stored(both, folder, f"steps-{v}")
        counts = both.where("n > 0").select("h", "n")
        shards, filters = self._grown(both, f"filters-{v}")
        return LineIndex(folder, v, shards, stored(postings, folder, f"postings-{v}"), counts, filters)

    def _grown(self, both: DataFrame, name: str) -> tuple[int, DataFrame]:
        """Number of shards and filters after a change; ``both``: h, was, n."""
        members = both.where(F.col("n") >= MIN_DOCS)
        held = members.count()
        if held > 2 * self.shards * SHARD:
            shards = -(-held // SHARD)
            return shards, _filters(members, shards, self.folder, name)
        own = _shard(F.col("h"), self.shards).alias("shard")
        sizes = members.groupBy(own).agg(F.count("*").alias("n"))
        # A row for each shard: those without a filter, or with too small a one, get a new one from the counts.
        small = stored(sizes.join(self.filters, "shard", "left").where("room is null or n > room").select("shard"), self.folder, f"{name}-small")
        whole = members.select(own, "h", F.lit(True).alias("up")).join(small, "shard", "left_semi")
        crossing = both.where((F.col("was") >= MIN_DOCS) != (F.col("n") >= MIN_DOCS))
        steps = crossing.select(own, "h", (F.col("n") >= MIN_DOCS).alias("up")).join(small, "shard", "left_anti")
        return self.shards, _applied(self.filters.join(small, "shard", "left_anti"), whole.unionByName(steps), self.folder, name)

    def _passed(self, docs: DataFrame) -> DataFrame:
        """key, doc_id of the lines that get through the filters."""
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        by_doc = docs.where("doc_id is not null").select("doc_id", keys(F.col("text")).alias("keys"))
        hashed = by_doc.select("doc_id", "keys", F.transform("keys", lambda k: F.xxhash64(k)).alias("h"))
        return self._passed_here(hashed) if size <= FILTER_BYTES else self._passed_there(hashed)

    def _passed_here(self, hashed: DataFrame) -> DataFrame:
        """With all filters sent to every task."""
        sent = hashed.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in self.filters.select("shard", "filter").collect()})
        shards = self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {k: CuckooFilter.from_bytes(x) for k, x in sent.value.items()}
            for batch in batches:
                names, at = batch.column(1).flatten(), batch.column(1).value_parent_indices()
                h = batch.column(2).flatten().to_numpy()
                shard = (h.view(np.uint64) >> np.uint64(33)).astype(np.int64) % shards
                good = np.zeros(len(h), bool)
                order = np.argsort(shard, kind="stable")
                for mine in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                    if len(mine) and (own := filters.get(int(shard[mine[0]]))):
                        good[mine] = own.contains(h[mine])
                keep = pa.array(good)
                yield pa.RecordBatch.from_arrays([names.filter(keep), batch.column(0).take(at.filter(keep))], ["key", "doc_id"])

        return hashed.mapInArrow(run, "key string, doc_id long")

    def _passed_there(self, hashed: DataFrame) -> DataFrame:
        """With each hash dealt to its shard's filter, once however many lines have it, and the lines joined to what gets
        through."""
        hashes = self.counts.select(_shard(F.col("h"), self.shards).alias("shard"), "h")
        through = stored(self.filters.groupBy("shard").cogroup(hashes.groupBy("shard")).applyInArrow(_contained, "h long"), self.folder, _new("through"))
        pairs = hashed.select("doc_id", F.explode(F.arrays_zip("keys", "h")).alias("x"))
        lines = pairs.select(F.col("x.keys").alias("key"), "doc_id", F.col("x.h").alias("h"))
        return split_join(lines, through, ["h"], "doc_id", hot_keys(self.counts, "h"), "left_semi").select("key", "doc_id")

    def dropped(self, docs: DataFrame) -> DataFrame:
        """doc_id, keys (the keys whose lines go) of those documents that lose lines. ``docs``: all that are indexed."""
        passed = stored(self._passed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), self.folder, _new("passed"))
        held = passed.groupBy("key").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= MIN_DOCS)
        h = F.xxhash64("key")
        gone = split_join(passed.withColumn("h", h), held.withColumn("h", h), ["key", "h"], "doc_id", hot_keys(self.counts, "h")).where("doc_id <> last")
        return gone.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def _new(name: str) -> str:
    """A name that no other run uses in the index's folder."""
    return f"{name}-{uuid.uuid4().hex[:8]}"


def _contained(filters: pa.Table, hashes: pa.Table) -> pa.Table:
    """A shard's hashes that its filter lets through."""
    h = hashes.column("h")
    good = CuckooFilter.from_bytes(filters.column("filter")[0].as_py()).contains(h.to_numpy()) if filters.num_rows else [False] * len(h)
    return pa.table({"h": h.filter(pa.array(good, pa.bool_()))})


def _filters(counts: DataFrame, shards: int, folder: str, name: str) -> DataFrame:
    """New filters from the counts."""
    none = counts.sparkSession.createDataFrame([], "shard int, room long, filter binary")
    entering = counts.where(F.col("n") >= MIN_DOCS).select(_shard(F.col("h"), shards).alias("shard"), "h", F.lit(True).alias("up"))
    return _applied(none, entering, folder, name)


def _applied(filters: DataFrame, changes: DataFrame, folder: str, name: str) -> DataFrame:
    made = filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_changed, "shard int, room long, filter binary")
    return stored(made, folder, name)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts(batches, 1024):
        rows = []
        for text, gone in zip(part.column(1), part.column(2), strict=True):
            every = (text.as_py() or "").split("\n")
            gone = set(gone.as_py() or ())
            kept = [x for x in every if key_of(x) not in gone] if gone else every
            rows.append((len(every), len(every) - len(kept), "\n".join(kept)))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_lines", "n_dropped", "kept"])


def without_repeated_lines(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (text) of each row. Only documents that lose lines are shuffled."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = index or LineIndex.create(docs)
    gone = stored(index.dropped(docs), index.folder, _new("dropped"))
    told = with_membership(docs, "doc_id", bounded_set(gone, "doc_id", index.folder, _new("losing")), "losing")
    some = told.where("losing").select("doc_id", "text").join(gone, "doc_id", "left").select("doc_id", "text", "keys")
    rest = told.where("not losing").select("doc_id", "text", F.lit(None).cast("array<string>").alias("keys"))
    schema = "doc_id long, n_lines long, n_dropped long, kept string"
    return some.mapInArrow(_without, schema).unionByName(rest.mapInArrow(_without, schema))


def line_dedup(docs: DataFrame) -> DataFrame:
    """The digest: doc_id, n_lines, n_dropped, kept_sha256."""
    return without_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
