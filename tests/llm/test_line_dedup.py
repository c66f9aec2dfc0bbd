import random

import numpy as np
import pytest

from gridloom.llm import line_dedup as ld
from gridloom.llm.cuckoo import CuckooFilter


def brute(rows):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(k := ld.key_of(line)) >= ld.MIN_CHARS:
                holders.setdefault(k, set()).add(i)
    out = []
    for i, text in rows:
        every = (text or "").split("\n")
        gone = lambda k: i is not None and len(holders.get(k, ())) >= ld.MIN_DOCS and i != max(holders[k])  # noqa: E731,B023
        kept = [x for x in every if not gone(ld.key_of(x))]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    common = [f"This line number {i} is shared by documents" for i in range(12)]
    rows = []
    for i in range(60):
        own = [f"line {i} {k} that nobody else holds at all" for k in range(rng.randrange(4))]
        own += rng.sample(common, rng.randrange(5)) + ["short"] * rng.randrange(3)
        rng.shuffle(own)
        rows.append((i * 3, "\n".join(rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 else x) for x in own)))
    hot = "A very common line that a third of all documents hold"
    return rows + [(500 + i, f"{hot}\n{hot}") for i in range(40)] + [(900, None), (901, ""), (902, "\n\n"), (None, hot), (902, hot), (903, "x" * 19), (904, "é" * 20), (905, "é" * 20), (906, "é" * 20 + "\r")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], "doc_id long, text string, key string, h int")


def test_same_as_brute_force(spark, monkeypatch):
    rows = corpus()
    got = sorted(map(tuple, ld.without_repeated_lines(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)
    monkeypatch.setattr(ld, "FILTER_BYTES", 0)
    monkeypatch.setattr(ld, "SHARD", 2)
    assert sorted(map(tuple, ld.without_repeated_lines(frame(spark, rows)).collect()), key=str) == got


def test_deletion_undoes_insertion(spark, monkeypatch):
    monkeypatch.setattr(ld, "SHARD", 4)
    rows = [r for r in corpus() if r[0] is not None and r[0] != 902]
    first, second = rows[:50], rows[50:]
    one = ld.LineIndex.create(frame(spark, first))
    more = one.insert(frame(spark, second)).insert(frame(spark, second))
    assert sorted(map(tuple, ld.without_repeated_lines(frame(spark, rows), more).collect()), key=str) == brute(rows)
    back = more.delete(spark.createDataFrame([(i,) for i, _ in second], "doc_id long"))
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, one.counts.collect()))
    assert sorted(map(tuple, back.postings.collect())) == sorted(map(tuple, one.postings.collect()))
    assert sorted(map(tuple, ld.without_repeated_lines(frame(spark, first), back).collect()), key=str) == brute(first)


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    h = rng.integers(-(2**63), 2**63 - 1, 5000)
    own = CuckooFilter(5000)
    own.insert(h)
    assert own.contains(h).all() and own.contains(rng.integers(-(2**63), 2**63 - 1, 20000)).mean() < 0.01
    own = CuckooFilter.from_bytes(own.to_bytes())
    own.delete(h[:2500])
    assert own.contains(h[2500:]).all() and own.contains(h[:2500]).mean() < 0.01
    tiny = CuckooFilter(4)
    tiny.insert(h[:200])
    assert tiny.contains(h[:200]).all() and tiny.stash
    tiny.delete(h[:200])
    assert not tiny.stash and not tiny.table.any()


@pytest.mark.parametrize("shards", [1, 3, 8, 64])
def test_stash_stays_small_in_every_shard(shards):
    """Of hashes that are dealt to shards by their high bits, at 90 % of the slots."""
    h = np.random.default_rng(shards).integers(-(2**63), 2**63 - 1, 40_000 * shards)
    mine = h[(h.view(np.uint64) >> np.uint64(33)).astype(np.int64) % shards == shards - 1][: int((1 << 13) * 4 * 0.9)]
    own = CuckooFilter(len(mine))
    own.insert(mine)
    assert len(own.table) == 1 << 13 and own.contains(mine).all() and len(own.stash) < len(mine) / 100


def test_filters_grow_with_the_index(spark, monkeypatch):
    """Ten times as many lines in several steps: no filter gets fuller than it may, and there are more shards."""
    monkeypatch.setattr(ld, "SHARD", 64)
    rows = lambda a, b: [(d, "\n".join(f"repeated line with the number {i}" for i in range(a, b))) for d in range(3 * a, 3 * a + 3)]
    index = ld.LineIndex.create(frame(spark, rows(0, 100)))
    every, seen = rows(0, 100), [index.shards]
    for at in (100, 150, 400):
        every += rows(at, at * 2 + 200)
        index = index.insert(frame(spark, rows(at, at * 2 + 200)))
        held = {r.shard: r for r in index.filters.collect()}
        filters = {k: CuckooFilter.from_bytes(bytes(r.filter)) for k, r in held.items()}
        assert sum(len(f.stash) for f in filters.values()) <= 2 and all(r.room == filters[k].capacity for k, r in held.items())
        for r in index.counts.where(f"n >= {ld.MIN_DOCS}").collect():
            assert filters[((r.h & 2**64 - 1) >> 33) % index.shards].contains([r.h]).all()
        seen.append(index.shards)
    assert seen == sorted(seen) and seen[-1] > seen[0]
    assert sorted(map(tuple, ld.without_repeated_lines(frame(spark, every), index).collect()), key=str) == brute(every)


def test_empty_table(spark):
    assert ld.line_dedup(frame(spark, [])).collect() == []
