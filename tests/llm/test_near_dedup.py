import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import common
from gridloom.llm import near_dedup as nd
from gridloom.llm.components import components


def brute(rows, size=3, percent=85):
    """doc_id -> (n_shingles, component) by comparing all pairs."""
    sets, root = {}, {}
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
        root[i] = i

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=3, groups=25, size=6):
    """Groups of copies with a few words changed each, chains of them, texts that share a long passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows, passage = [], [word() for _ in range(40)]
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([5, 40, 120, 300]))]
        for _ in range(size):
            rows.append(" ".join(base))
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                base[rng.randrange(len(base))] = word()
    rows += [" ".join([word() for _ in range(20)] + passage + [word() for _ in range(20)]) for _ in range(60)]
    hot = [word() for _ in range(150)]
    for _ in range(80):
        own = list(hot)
        for _ in range(rng.choice([0, 1, 2, 3])):
            own[rng.randrange(150)] = word()
        rows.append(" ".join(own))
    rows += ["", None, " \t\n", "one", "One", "one two", "one  two", "one two three", "x y z " * 4000, "x y z " * 3000]
    ids = list(range(0, 7 * len(rows), 7))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize("small,block", [(24, 1024), (2, 4)])
def test_same_as_all_pairs(spark, monkeypatch, small, block):
    monkeypatch.setattr(nd, "SMALL_KEY", small)
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(common, "HOT_KEYS", 8 if small == 2 else common.HOT_KEYS)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, component string, id int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_dedup(docs).collect()}
    assert got == brute(rows)


def test_other_shingles_and_similarity(spark):
    rows = corpus(seed=8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_dedup(docs, 5, 80).collect()}
    assert got == brute(rows, 5, 80) != brute(rows)


def test_radius_is_guaranteed():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = rng.integers(0, 2**16, nd.SYMBOLS).astype(np.uint16)
        y = x.copy()
        y[rng.choice(nd.SYMBOLS, nd.RADIUS, replace=False)] ^= 1
        assert any(all(x[i] == y[i] for i in p) for p in nd.PATTERNS)


def test_repeated_rows_nulls_and_empty(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(5, text), (5, text), (None, text), (2, text), (9, None)], "doc_id long, text string")
    got = sorted(map(tuple, nd.near_dedup(docs).collect()), key=str)
    assert got == sorted([(5, 5, 2, False), (5, 5, 2, False), (None, 5, 2, False), (2, 5, 2, True), (9, 0, 9, True)], key=str)
    assert nd.near_dedup(docs.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 100)], "a long, b long")
    got = {r.id: r.component for r in components(links, nd.work_folder(spark, "t"), "c").collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100}


def test_candidates_have_sizes_that_can_link(spark, monkeypatch):
    """Long texts share keys with beginnings of theirs, which are too short to link; no join meets such pairs."""
    rng = random.Random(5)
    base = [str(rng.randrange(10**6)) for _ in range(120)]
    rows = [(i, " ".join(base[: 120 - 20 * (i % 3)] + [f"end{i}"])) for i in range(40)]
    met = []
    both = nd._Job._both
    monkeypatch.setattr(nd._Job, "_both", lambda self, pairs, *a: met.extend(map(tuple, pairs.distinct().collect())) or both(self, pairs, *a))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want and met
    assert all(100 * min(want[a][0], want[b][0]) >= 85 * max(want[a][0], want[b][0]) for a, b in met)


@pytest.mark.parametrize("hot", [[], [3]])
def test_hot_keys_are_told_without_a_join(spark, hot):
    left = spark.createDataFrame([(i % 5, i) for i in range(50)], "k long, x long")
    right = spark.createDataFrame([(k, 10 * k) for k in range(4)], "k long, y long")
    key = common.hot_keys(left.where(F.col("k").isin(hot)).selectExpr("k", "1100L as n").distinct(), "k")
    assert key == ("k", hot)
    out = common.split_join(left, right, ["k"], "x", key, "left")
    assert {tuple(r) for r in out.collect()} == {(i % 5, i, 10 * (i % 5) if i % 5 < 4 else None) for i in range(50)}
    assert str(out._jdf.queryExecution().optimizedPlan()).count("Join ") == 1
