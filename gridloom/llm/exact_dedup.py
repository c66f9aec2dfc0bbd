"""Exact dedup over an extendible-hash index that lies on shared files.

1. Keys: one narrow row per document (64-bit hash and SHA-256 of its normalised text).
2. Directory: distinct hashes are counted by hash prefix; the directory doubles while a bucket is overfull, and
   only overfull buckets split. It holds at most ``2 ** MAX_DEPTH`` slots however large the input is.
3. Chains: texts whose hash occurs once can't have a copy. The others are grouped by their bytes, so that texts
   that only share a hash become separate links of that hash's chain. Spark combines copies before the shuffle,
   so a hot group reaches its owner as one row per task.
4. Index files: every bucket is sorted by hash and written by the task that owns it.
5. Probe: each document's key finds its link of the chain.

Everything runs in DataFrame functions. Texts cross the network only where their hash repeats.

Defined results: a null text counts as empty; empty texts are equal to each other; rows that repeat a doc_id are
documents of their own which share the doc_id, so each counts in ``group_size`` and all that carry the smallest
doc_id are kept; null doc_ids lose against any other and are equal among themselves; an empty table gives no rows;
other columns are neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, bounded_set, sha256_of, stored, with_membership, work_folder

#: Bits of the hash that the directory may use: at most 65,536 slots, a few hundred KB.
MAX_DEPTH = 16
#: Distinct hashes that a bucket holds before it splits.
CAPACITY = 50_000

def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


@dataclass(frozen=True)
class Directory:
    """``slots[prefix]`` is the bucket of all hashes that start with the ``depth`` bits of ``prefix``."""

    depth: int
    slots: list[int]

    @staticmethod
    def grown(counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> Directory:
        """``counts``: distinct hashes by their first ``max_depth`` bits."""

        def held(prefix: int, local: int) -> int:
            first = prefix << (max_depth - local)
            return sum(counts.get(i, 0) for i in range(first, first + (1 << (max_depth - local))))

        depth, buckets = 0, [(0, 0, sum(counts.values()))]  # prefix, local depth, hashes
        full = lambda b: b[2] > capacity and b[1] < max_depth
        while over := [b for b in buckets if full(b)]:
            depth = max(depth, max(b[1] for b in over) + 1)  # a bucket as deep as the directory doubles it
            buckets = [b for b in buckets if not full(b)]
            buckets += [(2 * p + side, d + 1, held(2 * p + side, d + 1)) for p, d, _ in over for side in (0, 1)]
        slots = [0] * (1 << depth)
        for number, (prefix, local, _) in enumerate(sorted(buckets, key=lambda b: b[0] << (max_depth - b[1]))):
            first = prefix << (depth - local)
            slots[first : first + (1 << (depth - local))] = [number] * (1 << (depth - local))
        return Directory(depth, slots)

    def frame(self, spark) -> DataFrame:
        """slot, bucket."""
        listed = F.split(F.lit(",".join(map(str, self.slots))), ",")
        return spark.range(1).select(F.posexplode(listed).alias("slot", "b")).select("slot", F.col("b").cast("int").alias("bucket"))


@dataclass(frozen=True)
class Index:
    """``keys``: doc_id, h, sha of every document. ``entries``: bucket, h, chain, sha, keep_id, group_size of every
    distinct text, one file folder for each bucket."""

    keys: DataFrame
    entries: DataFrame
    directory: Directory


def _prefix(h: Column, bits: int, depth: int) -> Column:
    return F.shiftrightunsigned(h, bits - depth) if depth else F.lit(0).cast("long")


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, hash_bits: int = 64) -> Index:
    """``hash_bits`` under 64 makes hashes collide, for tests; at least ``MAX_DEPTH``."""
    spark = docs.sparkSession
    folder = work_folder(spark, "exact")

    def hashed() -> DataFrame:
        norm = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("norm"))
        return norm.select("doc_id", "norm", F.shiftrightunsigned(F.xxhash64("norm"), 64 - hash_bits).alias("h") if hash_bits < 64 else F.xxhash64("norm").alias("h"))

    keys = stored(hashed().select("doc_id", "h", sha256_of(F.col("norm")).alias("sha")), folder, "keys")

    by_hash = stored(keys.groupBy("h").agg(F.count("*").alias("n")), folder, "hashes")
    prefixes = by_hash.groupBy(_prefix(F.col("h"), hash_bits, MAX_DEPTH).alias("p")).count()
    directory = Directory.grown({r["p"]: r["count"] for r in prefixes.collect()}, capacity)

    repeated = bounded_set(by_hash.where("n > 1"), "h", folder, "repeated")

    several = with_membership(hashed(), "h", repeated, "again").where("again").groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    several = several.select("h", sha256_of(F.col("norm")).alias("sha"), "keep_id", "group_size")
    alone = with_membership(keys, "h", repeated, "again").where("not again").select("h", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))

    slot = _prefix(F.col("h"), hash_bits, directory.depth).cast("int").alias("slot")
    owned = several.unionByName(alone).select("*", slot).join(F.broadcast(directory.frame(spark)), "slot").drop("slot")
    owned = owned.repartition(len(set(directory.slots)), "bucket")
    chained = owned.withColumn("chain", F.row_number().over(Window.partitionBy("bucket", "h").orderBy("keep_id", "sha")))
    path = f"{folder}/index"
    chained.write.partitionBy("bucket").parquet(path)
    return Index(keys, spark.read.schema(chained.schema).parquet(path), directory)


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row, kept or not."""
    index = build_index(docs, text, doc_id, capacity, hash_bits)
    found = index.keys.join(index.entries.select("h", "sha", "keep_id", "group_size"), ["h", "sha"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
