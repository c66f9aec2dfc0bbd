import hashlib
import random
import re

import pytest

from gridloom.llm.decontaminate import WORD, contamination, decontaminated


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    out = []
    for i, text in rows:
        w, hit, ids = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= own
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcÉß9") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(rng.choice([10, 11, 14, 40])))) for k in range(20)]
    items += [(100, "Short item"), (101, "one"), (102, ""), (103, None), (5, " ".join(word() for _ in range(12))), (104, items[3][1]), (105, "a b " * 10)]
    rows = []
    for i in range(60):
        own = [word() for _ in range(rng.randrange(30))]
        if i % 2:
            w = rng.choice(items)[1] or ""
            w = w.split(" ")
            a = rng.randrange(max(1, len(w) - 5))
            own += w[a : a + rng.choice([9, 10, 30])] + [word()]
        rows.append((i, rng.choice([" ", ", ", "-\n"]).join(x.upper() if rng.random() < 0.3 else x for x in own)))
    return rows + [(90, None), (91, ""), (92, "..."), (93, "ONE!"), (94, "short\titem"), (95, "a b " * 3000), (96, rows[1][1])], items


@pytest.mark.parametrize("most", [10**6, 200])
def test_same_as_brute_force(spark, most):
    rows, items = tables()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    if most == 10**6:
        assert sorted(map(tuple, decontaminated(docs, bench).collect()), key=str) == brute(rows, items)
    got = {r.doc_id: r for r in contamination(docs, bench, max_chars=most).collect()}
    text = dict(rows)
    for i, n, n_hit, n_items, _, _ in brute(rows, items):
        r = got[i]
        assert (r.n_words, len(r.hits), len(r.items)) == (n, n_hit, n_items)
        assert [w for s in r.spans for w in WORD.findall(text[i][s.start : s.stop])] == [WORD.findall(text[i])[k] for k in r.hits]


def test_empty_tables(spark):
    rows, items = tables()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminated(docs.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in decontaminated(docs, bench.limit(0)).collect())


def test_a_row_for_a_row_at_every_benchmark_size(spark):
    rows, items = tables()
    rows += [(None, rows[1][1]), (None, None), (None, rows[3][1] + " " + items[3][1]), (7, rows[1][1]), (7, "one"), (8, " ".join(t or "" for _, t in items))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, several = (contamination(docs, bench, max_chars=most) for most in (10**6, 200))
    assert several.columns == one.columns
    assert sorted(map(str, several.collect())) == sorted(map(str, one.collect()))
    assert several.count() == len(rows)
