import os

import numpy as np
import pytest

from gridloom.llm import quality as q

DATA = "/root/testdata/sf0.1"


def test_gradient_orders_the_grades():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(600):
        g = int(rng.integers(3))
        own = [np.int32(g * 10 + k) for k in rng.choice(10, 3, replace=False)]
        rows.append((g, np.unique(np.asarray(own + rng.integers(1000, 1050, 5).tolist(), np.int32))))
    model = q.fitted(rows)
    mean = [np.mean([model.weights[x].sum() for g, x in rows if g == k]) for k in range(3)]
    assert mean[0] < model.thresholds[0] < mean[1] < model.thresholds[1] < mean[2]
    low, good = model.tails(np.asarray([-5.0, 0.0, 5.0]))
    assert (low >= good).all() and (np.diff(low) > 0).all()


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the shared tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = q.fit(docs, labels.where("doc_id % 4 <> 0"))
    rest = q.scored(docs.where("doc_id % 4 = 0"), model).join(labels.where("doc_id % 4 = 0"), "doc_id").toPandas()
    assert rest[(rest.quality == 1) & (rest.toxic == 0)].kept.mean() > 0.97
    assert 1 - rest[rest.toxic == 1].kept.mean() > 0.9
    assert 1 - rest[(rest.quality == 0) & (rest.toxic == 0)].kept.mean() > 0.75


def test_sample_is_bounded_and_nulls_are_left_out(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5000)] + [(None, 1, 1), (6000, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    n = q.sampled(labels, 500).count()
    assert 350 < n < 650 and n == q.sampled(labels.repartition(3), 500).count()
    assert q.sampled(labels, 10**6).count() == 5000


def test_nothing_is_rejected_without_labels(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (2, "x" * 100000, 0.0), (None, "IDIOT!!", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = q.quality(docs, labels).collect()
    assert len(got) == 4 and all(r.kept for r in got)
    assert q.quality(docs.limit(0), labels).collect() == []


def dense_fit(x, y, seed=0):
    """The same model from a dense matrix of features, each step spelled out: the likelihood's slope is taken from the
    probabilities by differences, not by the operator's formula."""
    n, d = x.shape
    x = x * (x.sum(axis=0) >= q.LEAST_DOCS)
    share = np.array([(y == g).mean() for g in range(3)])
    weigh = np.array([s**-0.5 if s else 0.0 for s in share])
    weigh /= sum(weigh * share)
    cum = np.clip([share[0], share[0] + share[1]], 0.01, 0.99)
    t = np.log(cum / (1 - cum))
    t[1] = max(t[1], t[0] + 0.5)
    w, w2, t2 = np.zeros(d), np.full(d, 1e-6), np.full(2, 1e-6)
    rng = np.random.default_rng(seed)

    def loss(score, t, y):
        upper = np.where(y == 2, 1.0, 1 / (1 + np.exp(-(np.append(t, np.inf)[y] - score))))
        lower = np.where(y == 0, 0.0, 1 / (1 + np.exp(-(np.append(-np.inf, t)[y] - score))))
        return -np.log(upper - lower)

    for _ in range(q.EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, q.BATCH):
            some = order[at : at + q.BATCH]
            xs, ys = x[some], y[some]
            cost, score, e = weigh[ys] / len(some), xs @ w, 1e-5
            by_score = (loss(score + e, t, ys) - loss(score - e, t, ys)) / (2 * e) * cost
            by_t = [((loss(score, t + e * np.eye(2)[k], ys) - loss(score, t - e * np.eye(2)[k], ys)) / (2 * e)) @ cost for k in (0, 1)]
            slope, hot = xs.T @ by_score, xs.any(axis=0)
            w2[hot] += slope[hot] ** 2
            rate = q.RATE / np.sqrt(w2)
            moved = w - rate * slope
            w = np.where(hot, np.sign(moved) * np.maximum(0, np.abs(moved) - rate * q.L1), w)
            for k in (0, 1):
                t2[k] += by_t[k] ** 2
                t[k] -= 0.1 * by_t[k] / np.sqrt(t2[k])
            t[1] = max(t[1], t[0] + 0.1)
    return w, t


def test_query_same_as_brute_force(spark):
    """Fit and scores against a dense version with features of its own."""
    import collections
    import re

    import xxhash

    rng = np.random.default_rng(4)
    words = [["vile", "hate", "scum", "trash"], ["buy", "click", "now", "cheap"], ["river", "stone", "study", "music"]]
    texts = []
    for i in range(400):
        g = i % 3
        own = [str(rng.choice(words[g if rng.random() < 0.7 else rng.integers(3)])) for _ in range(rng.integers(3, 12))] + ["the", "Of"]
        texts.append((i, " ".join(w.upper() if rng.random() < 0.05 else w for w in own) + str(rng.choice(["", "!!", " ."]))))
    texts += [(1000, None), (1001, ""), (1002, "river " * 500), (1002, "hate")]
    labels = [(i, int(i % 3 == 2), int(i % 3 == 0)) for i in range(300)]

    def own_features(text):
        text = text or ""
        parts = re.findall(r"\w+", text)
        low = collections.Counter(p.lower() for p in parts)
        capital = sum(p.isupper() for p in parts) / max(1, len(parts))
        signs = max(0, max(1, len(text)) - sum(len(p) for p in parts) - (text.count(" ") + text.count("\n") + 1)) / max(1, len(parts))
        steps = [min(15, int(v * 16 / top)) for v, top in ((capital, 1), (signs, 4), (len(low) / max(1, len(parts)) ** 0.75, 4))]
        return {xxhash.xxh3_64_intdigest(p) % 2**18 for p in low} | {2**18 + 16 * k + s for k, s in enumerate(steps)}

    used = sorted(set().union(*(own_features(t) for _, t in texts)))
    matrix = lambda rows: np.array([[f in own for f in used] for own in map(own_features, rows)], float)
    grade = np.array([0 if toxic else 1 + good for _, good, toxic in labels])
    w, t = dense_fit(matrix([x for _, x in texts[:300]]), grade)
    score = matrix([x for _, x in texts]) @ w
    want = sorted((i, 1 / (1 + np.exp(t[0] - s)), 1 / (1 + np.exp(t[1] - s))) for (i, _), s in zip(texts, score, strict=True))
    docs, graded = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted((r.doc_id, r.p_low, r.p_good, r.expected_grade, r.kept) for r in q.quality(docs, graded).collect())
    assert [r[0] for r in got] == [r[0] for r in want]
    assert np.allclose([r[1:3] for r in got], [r[1:] for r in want], atol=1e-6)
    assert np.allclose([r[3] for r in got], [r[1] + r[2] for r in got])
    assert all(r[4] == (r[2] >= q.KEEP_AT) for r in got)
