import hashlib
import os
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import quality as q
from tests.llm.test_near_dedup import brute as near_brute

DATA = "/root/testdata/sf0.001"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the shared tables")
def test_same_as_brute_force(spark):
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    docs = sorted((r.doc_id, r.text) for r in read("documents").collect())
    model = q.fit(read("documents"), read("labels"))
    grade = {r.doc_id: 0 if r.toxic else 1 + r.quality for r in read("labels").collect()}
    index = lambda t: (lambda w, s: np.unique(np.asarray([q.bucket(x) for x in w] + s, np.int32)))(*q.features(t))
    own = q.fitted([(grade[i], index(t)) for i, t in docs if i in grade])
    assert np.allclose(own.weights, model.weights) and np.allclose(own.thresholds, model.thresholds)
    score = lambda t: sum(float(model.weights[q.bucket(w)]) for w in q.features(t)[0]) + sum(float(model.weights[k]) for k in q.features(t)[1])
    docs = [(i, t) for i, t in docs if model.tails(score(t))[q.KEEP_FROM - 1] >= q.KEEP_AT]
    first = {}
    docs = [(i, t) for i, t in docs if first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i) == i]
    near = near_brute(docs, 5, 80)
    docs = [(i, t) for i, t in docs if near[i][1] == i]
    items = set()
    for r in read("benchmark").collect():
        w = words(r.text)
        items |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in items}
    leaks = lambda w: any(tuple(w[k : k + n]) in items for n in sizes for k in range(len(w) - n + 1))
    docs = [(i, t) for i, t in docs if not leaks(words(t))]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, len(ids := library.encode(t or "")), digest(",".join(map(str, ids))), digest(library.decode(ids))) for i, t in docs]
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == want
    assert 0 < len(want) < 200


def test_stages_keep_columns_and_take_odd_rows(spark):
    long = "The river carries the boats and the boats carry the grain to the far town by the sea. " * 3
    rows = [(1, long, "word", 1.0), (2, long, None, 2.0), (3, None, "x", None), (4, "", "y", 0.0), (None, long, "z", 0.0), (5, long + "indeed", "w", 0.0), (5, long + "indeed", "w", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, keys double")
    docs = docs.withColumn("__word", docs.keys).withColumn("maybe", docs.keys).withColumn("hits", docs.keys)
    for _, stage in corpus_pipeline.STAGES[:4]:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, DATA)
            assert out.columns == docs.columns
            out.collect()
    assert corpus_pipeline.quality_stage(spark, docs, DATA).count() <= len(rows)
    last = corpus_pipeline.pieces_stage(spark, docs, DATA).collect()
    assert len(last) == len(rows) and {r.n_tokens for r in last if r.doc_id in (3, 4)} == {0}
    assert corpus_pipeline.pieces_stage(spark, docs.limit(0), DATA).collect() == []
    assert sorted(r.doc_id or -1 for r in corpus_pipeline.exact_stage(spark, docs, DATA).collect()) == [-1, 1, 3, 5, 5]
    assert sorted(r.doc_id or -1 for r in corpus_pipeline.near_stage(spark, docs, DATA).collect()) == [-1, 1, 3, 4]
    other = docs.unionByName(docs.where("doc_id = 4").withColumn("text", F.lit(long)))  # a doc_id again, with another text
    assert sorted(r.doc_id or -1 for r in corpus_pipeline.exact_stage(spark, other, DATA).collect()) == [-1, 1, 3, 5, 5]
