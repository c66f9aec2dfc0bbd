"""What the operators share: the shared work folder, work tables and fixed patterns."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters as a Java character class.
SPACE = r"\x20\x09-\x0D"


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder that the driver and all executors can reach.

    It lies under ``spark.checkpoint.dir``. Where that is unset and everything runs in one process (local tests), a
    temporary folder is made and the setting is left alone; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The frame written as a Parquet table in the shared folder and read again; this cuts its lineage, and a
    lost executor costs no recomputation of what led to it."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many rows, so that what is made of one at a time stays small."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        give_back()


def give_back() -> None:
    """Returns freed memory to the system: a Python worker stays for other stages, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case; all other characters as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256_of(c: Column) -> Column:
    """Lower-case hex SHA-256 of the text in UTF-8."""
    return F.sha2(c.cast("binary"), 256)


#: Words of 64 bits in a ``bounded_set``: at most 2**20 rows of 16 bytes.
SET_WORDS_LOG2 = 20


def _place(key: Column) -> tuple[Column, Column]:
    mixed = F.xxhash64(key, F.lit(7))
    word = F.shiftrightunsigned(mixed, 64 - SET_WORDS_LOG2)
    bit = F.shiftrightunsigned(mixed, 58 - SET_WORDS_LOG2).bitwiseAND(F.lit(63)).cast("int")
    return word, F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bounded_set(df: DataFrame, key: str, folder: str, name: str) -> DataFrame:
    """A set of keys as 64-bit words with a bit for each: at most 2**20 rows, however many keys there are. The more
    keys, the more others share their bits; so it only ever saves work and never decides."""
    word, bit = _place(F.col(key))
    words = df.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return stored(words.coalesce(8), folder, name)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_membership(df: DataFrame, key: str, members: DataFrame, flag: str) -> DataFrame:
    """``df`` with a boolean: false only where the key is not in the ``bounded_set``."""
    word, bit = _place(F.col(key))
    at, bits = unused(df, "word"), unused(df, "bits")
    known = df.withColumn(at, word).join(F.broadcast(members.toDF(at, bits)), at, "left")
    return known.withColumn(flag, F.coalesce(bit.bitwiseAND(F.col(bits)) != 0, F.lit(False))).drop(at, bits)


def without_ids(docs: DataFrame, dropped: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``dropped`` (column doc_id). Only rows that the bounded set can't
    rule out are shuffled."""
    gone = stored(dropped.select("doc_id").where("doc_id is not null").distinct(), folder, name)
    maybe = unused(docs, "maybe")
    told = with_membership(docs, "doc_id", bounded_set(gone, "doc_id", folder, f"{name}-set"), maybe)
    rest = told.where(F.col(maybe)).drop(maybe).join(gone, "doc_id", "left_anti").select(*docs.columns)
    return told.where(~F.col(maybe)).drop(maybe).select(*docs.columns).unionByName(rest)


#: At most so many keys are split, those with more than that share of all rows; and into how many parts.
HOT_KEYS, WAYS = 1000, 64


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> tuple[str, list]:
    """The column, and the keys of a stored table of counts that hold over 1/HOT_KEYS of all rows, so at most HOT_KEYS
    of them; only these come to the driver."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return key, [r[0] for r in counts.where(F.col(n) > max(HOT_KEYS, total // HOT_KEYS)).select(key).collect()]


def split_join(left: DataFrame, right: DataFrame, on: list[str], spread: str, hot: tuple[str, list], how: str = "inner") -> DataFrame:
    """``left.join(right, on, how)`` where rows with a key in ``hot`` (of ``hot_keys``) are dealt to ``WAYS`` parts by
    the column ``spread`` of the left side, and meet a copy of the right side's rows in each."""
    key, keys = hot
    is_hot = F.col(key).isin(keys)
    dealt = F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(WAYS)).cast("int")).otherwise(0)
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(WAYS - 1))).otherwise(F.array(F.lit(0)))
    left = left.withColumn("part", dealt)
    right = right.withColumn("part", F.explode(copies))
    return left.join(right, [*on, "part"], how).drop("part")
