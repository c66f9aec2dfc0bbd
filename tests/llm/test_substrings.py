import random
import re

import pytest

from gridloom.llm import substrings as ss


def brute(rows):
    seen, out, cut = {}, [], {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        gone = [False] * len(words)
        for k in range(len(words) - ss.WINDOW + 1):
            w = tuple(words[k : k + ss.WINDOW])
            if w in seen:
                gone[k : k + ss.WINDOW] = [True] * ss.WINDOW
            seen.setdefault(w, i)
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(4))
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 35, 60, 150)]
    rows = []
    for _ in range(80):
        own = []
        for _ in range(rng.randrange(6)):
            own += [word() for _ in range(rng.randrange(40))]
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randrange(len(p))
                own += p if rng.random() < 0.5 else p[a:]
        rows.append(rng.choice([" ", "\n", "\t "]).join(own))
    rows += [rows[3], rows[3], rows[5], "", None, "x " * 70, "x y " * 50, "a b c " * 3000, " ".join(passages[4] * 3)]
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize("most,shard", [(500, 60_000), (2, 100)])
def test_same_as_brute_force(spark, monkeypatch, most, shard):
    monkeypatch.setattr(ss, "MOST", most)
    monkeypatch.setattr(ss, "SHARD_WORDS", shard)
    rows = corpus(4)
    docs = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, anchor int, name string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in ss.without_repeats(docs).collect())
    assert got == brute(rows)


def test_automaton_statistics():
    rng = random.Random(1)
    for _ in range(60):
        own, texts = ss.Automaton(), []
        for _ in range(5):
            new = [rng.choice("ab") for _ in range(rng.randrange(1, 14))]
            want = [max((n for n in range(i + 2) if any("".join(new[i + 1 - n : i + 1]) in t for t in [*texts, ""])), default=0) for i in range(len(new))]
            assert own.statistics(new) == want
            own.add(new)
            texts.append("".join(new))


def test_repeated_rows_nulls_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(4, text), (4, text), (None, text), (9, text), (1, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in ss.without_repeats(docs).collect()), key=str)
    assert got == sorted([(4, 30, 0), (4, 30, 0), (None, 30, 0), (9, 30, 30), (1, 0, 0)], key=str)
    assert ss.substring_dedup(docs.limit(0)).collect() == []
