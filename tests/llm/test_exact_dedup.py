import hashlib
import random
import re
from collections import defaultdict

import pytest

from gridloom.llm.exact_dedup import Directory, build_index, exact_dedup


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[norm(t)], len(groups[norm(t)]), i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str)


def corpus():
    rng = random.Random(0)
    texts = [f"text number {i}" for i in range(150)]
    rows = [rng.choice(texts) for _ in range(200)] + ["a hot text"] * 120 + ["", None, " ", "\t\n ", "a b", "a  b", "a b", "x" * 200_000, "x" * 200_000]
    return [(1000 - i, t) for i, t in enumerate(rows)] + [(1, "a hot text"), (1, "a hot text"), (None, "a hot text"), (None, "alone")]


@pytest.mark.parametrize("bits,capacity", [(64, 50_000), (64, 7), (16, 3)])
def test_same_as_brute_force(spark, bits, capacity):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in corpus()], "doc_id long, text string, h string, keep_id int")
    got = sorted(map(tuple, exact_dedup(docs, capacity=capacity, hash_bits=bits).collect()), key=str)
    assert got == brute(corpus())


def test_collisions_are_chained(spark):
    """300 texts under 16 bits with every bit pattern of the hash cut to few values."""
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(3000)], "doc_id long, text string")
    index = build_index(docs, capacity=100, hash_bits=16)
    entries = index.entries.collect()
    assert len(entries) == 3000 and max(r.chain for r in entries) > 1
    for r in entries:
        assert index.directory.slots[r.h >> 16 - index.directory.depth] == r.bucket
    held = defaultdict(set)
    for r in entries:
        held[r.bucket].add(r.h)
    assert max(map(len, held.values())) <= 100 and index.directory.depth >= 5


def test_directory_splits_only_overfull_buckets():
    d = Directory.grown({0b0000: 5, 0b0001: 5, 0b1000: 1, 0b1100: 1}, capacity=6, max_depth=4)
    assert d.depth == 4 and d.slots[0] != d.slots[1] and len(set(d.slots[8:])) == 1
    assert Directory.grown({}, 5).slots == [0] and Directory.grown({0: 99}, 5, 2).depth == 2


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
