"""Quality classifier: cumulative-link (ordinal logistic) regression on graded ratings.

Grades are 0 (toxic), 1 (of low quality) and 2 (good). A document's score is the sum of the weights of its distinct
words, hashed into ``BUCKETS``, and of a few shape features (shares of capitals and of symbols, variety of words, each
in steps). All grades share the weights; ordered thresholds cut the score: P(grade <= k) = logistic(t_k - score). So a
document has an expected grade and tail probabilities P(grade >= k), and is kept where P(grade >= KEEP_FROM) is at
least ``KEEP_AT``.

The model is fitted by proximal AdaGrad on at most about ``MAX_LABELLED`` labelled documents, a sample by hash of
doc_id that does not depend on the order of rows; their features are made on the executors, and only they come to the
driver. Scoring is one pass over all documents with the weights (1 MB) broadcast.

Defined results: null texts count as empty and are scored by their shape alone; null grades are not used; rows that
repeat a doc_id are scored each by its own text; where there are no labels, or only one grade, nothing is rejected; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts
from .pieces import Cache

BUCKETS = 1 << 18
SHAPES, STEPS = 3, 16
MAX_LABELLED = 12_000
#: Documents of the sample that must hold a feature for it to count.
LEAST_DOCS = 5
EPOCHS, BATCH, RATE, L1 = 14, 128, 0.3, 1.2e-3
KEEP_FROM, KEEP_AT = 2, 0.4
CACHED = 60_000
WORD = re.compile(r"\w+")
GRADES = 3


def bucket(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) % BUCKETS


def features(text: str | None) -> tuple[set[str], list[int]]:
    """Distinct lower-case words, and the shape features' indices."""
    text = text or ""
    words = WORD.findall(text)
    n_words, n = max(1, len(words)), max(1, len(text))
    distinct = {w.lower() for w in words}
    letters = sum(map(len, words))
    capitals = sum(map(str.isupper, words)) / n_words
    spaces = text.count(" ") + text.count("\n") + 1
    symbols = max(0, n - letters - spaces) / n_words
    variety = len(distinct) / n_words**0.75
    return distinct, [BUCKETS + k * STEPS + min(STEPS - 1, int(x * STEPS / top)) for k, (x, top) in enumerate(((capitals, 1.0), (symbols, 4.0), (variety, 4.0)))]


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS + SHAPES * STEPS, np.float32))
    thresholds: tuple[float, ...] = (-40.0, -20.0)

    def tails(self, score) -> list:
        """P(grade >= 1), P(grade >= 2)."""
        return [1 / (1 + np.exp(np.clip(t - score, -60, 60))) for t in self.thresholds]


def fitted(rows: list[tuple[int, np.ndarray]], seed: int = 0) -> Model:
    """From (grade, indices of features) of each document."""
    model = Model()
    grades = np.asarray([g for g, _ in rows])
    if len(set(grades.tolist())) < 2:
        return model
    held = np.bincount(np.concatenate([x for _, x in rows]), minlength=len(model.weights))
    used = held >= LEAST_DOCS
    rows = [(g, x[used[x]]) for g, x in rows]
    share = np.bincount(grades, minlength=GRADES) / len(grades)
    weigh = np.where(share > 0, (1 / np.maximum(share, 1e-9)) ** 0.5, 0)
    weigh /= (weigh * share).sum()
    cum = np.clip(np.cumsum(share)[:-1], 0.01, 0.99)
    w, g2 = np.zeros(len(model.weights)), np.full(len(model.weights), 1e-6)
    t, t2 = np.log(cum / (1 - cum)), np.full(GRADES - 1, 1e-6)
    if len(t) == 2 and t[1] - t[0] < 0.5:
        t[1] = t[0] + 0.5
    rng = np.random.default_rng(seed)
    sizes = np.asarray([len(x) for _, x in rows])
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            some = order[at : at + BATCH]
            index = np.concatenate([rows[i][1] for i in some])
            owner = np.repeat(np.arange(len(some)), sizes[some])
            score = np.bincount(owner, w[index], len(some))
            y = grades[some]
            edges = np.concatenate(([-np.inf], t, [np.inf]))
            up, low = (1 / (1 + np.exp(-np.clip(edges[y + d] - score, -60, 60))) for d in (1, 0))
            up, low = np.where(y == GRADES - 1, 1.0, up), np.where(y == 0, 0.0, low)
            p, cost = np.maximum(up - low, 1e-9), weigh[y] / len(some)
            grad = np.bincount(index, ((1 - up - low) * cost)[owner], len(w))
            hot = np.unique(index)
            g2[hot] += grad[hot] ** 2
            rate = RATE / np.sqrt(g2[hot])
            moved = w[hot] - rate * grad[hot]
            w[hot] = np.sign(moved) * np.maximum(0, np.abs(moved) - rate * L1)
            for k in range(GRADES - 1):
                slope = (np.where(y == k, -up * (1 - up) / p, 0) + np.where(y == k + 1, low * (1 - low) / p, 0)) @ cost
                t2[k] += slope**2
                t[k] -= 0.1 * slope / np.sqrt(t2[k])
            t[1] = max(t[1], t[0] + 0.1)
    return Model(w.astype(np.float32), tuple(t.tolist()))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column(1):
            words, shapes = features(text.as_py())
            found.append(np.unique(np.asarray([bucket(w) for w in words] + shapes, np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["grade", "x"])


def sampled(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, grade of about ``most`` labelled documents at most."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    graded = labels.select("doc_id", grade.alias("grade")).where("grade is not null and doc_id is not null").dropDuplicates(["doc_id"])
    n = graded.count()
    return graded.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(1, n))))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    joined = docs.select("doc_id", "text").join(F.broadcast(sampled(labels, most)), "doc_id").select("doc_id", "grade", "text")
    rows = joined.select("grade", "text", "doc_id").mapInArrow(_indexed_by_doc, "doc_id long, grade int, x array<int>").toArrow().sort_by([("doc_id", "ascending")])
    x, grades = rows.column("x").combine_chunks(), rows.column("grade").to_pylist()
    return fitted([(g, a.values.to_numpy()) for g, a in zip(grades, x, strict=True)]) if grades else Model()


def _indexed_by_doc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = next(_indexed(iter([batch.select([0, 1])])))
        yield pa.RecordBatch.from_arrays([batch.column(2).cast(pa.int64()), *made.columns], ["doc_id", "grade", "x"])


def _scores(model: Model, cache: Cache, column: pa.Array) -> np.ndarray:
    weights = cache.weights
    score = np.zeros(len(column))
    for i, text in enumerate(column):
        words, shapes = features(text.as_py())
        score[i] = sum(map(cache.__getitem__, words)) + sum(weights[k] for k in shapes)
    return score


def _cache(model: Model) -> Cache:
    weights = model.weights.tolist()
    cache = Cache(lambda w: weights[bucket(w)], CACHED)
    cache.weights = weights
    return cache


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, expected_grade, p_low (P(grade >= 1)), p_good (P(grade >= 2)), kept of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = sent.value
        cache = _cache(own)
        for batch in parts(batches, 2048):
            score = _scores(own, cache, batch.column(1))
            low, good = own.tails(score)
            kept = (low, good)[KEEP_FROM - 1] >= KEEP_AT
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c) for c in (score, low + good, low, good, kept))], ["doc_id", "score", "expected_grade", "p_low", "p_good", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, expected_grade double, p_low double, p_good double, kept boolean")


def selected(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are kept, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = sent.value
        cache = _cache(own)
        for batch in parts(batches, 2048):
            tails = own.tails(_scores(own, cache, batch.column("text")))
            yield batch.filter(pa.array(tails[KEEP_FROM - 1] >= KEEP_AT))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fit(docs, labels))
