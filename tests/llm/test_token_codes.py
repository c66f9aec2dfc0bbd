import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import token_codes as tc

FILE = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(FILE)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500), st.data())
def test_codes_round_trip(ids, data):
    codes = tc.Codes(tc.packed(np.asarray(ids, np.uint32)))
    assert codes.read(0, len(ids)).tolist() == ids and len(codes) == len(ids)
    if ids:
        i = data.draw(st.integers(0, len(ids) - 1))
        j = data.draw(st.integers(i, len(ids)))
        assert codes[i] == ids[i]
        assert codes.read(i, j).tolist() == ids[i:j]
    with pytest.raises(IndexError):
        codes[len(ids)]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aA é́̊J̌   'stDdlre <|endoftext|>.,!İŸŒß\t\n\x1c\x850½", max_size=60)))
def test_chunks_give_the_ids_of_the_whole_text(text):
    assert tc.encoder(FILE).encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcdehinorstTHEéÉçßñüÄŒºŉſĸ", min_size=1, max_size=14), max_size=20))
def test_plain_words(words):
    text = " ".join(words)
    assert tc.encoder(FILE).encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_frames(spark, monkeypatch):
    monkeypatch.setattr(tc, "SEGMENT_IDS", 20)
    texts = ["The quick brown fox's tail", None, "", "same same", "same same", "word " * 700, "<|endoftext|> x", "Éa  1234"] * 4
    rows = [(1000 - 3 * i, t, 5) for i, t in enumerate(texts)] + [(7, "a", 1), (7, "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = tc.token_files(docs, FILE).collect()
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_table(spark):
    assert tc.token_files(spark.createDataFrame([], "doc_id long, text string"), FILE).collect() == []


def test_learning_does_not_walk_through_the_caches(monkeypatch):
    from gridloom.llm.pieces import Cache

    own = tc.ChunkEncoder(FILE)
    want = [x.tolist() for x in own.encode(["One two, three.", "two four"])]
    monkeypatch.setattr(Cache, "keys", lambda self: 1 / 0, raising=False)
    assert [x.tolist() for x in own.encode(["One two, three.", "two four"])] == want and own.encode(["five"])[0].size


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab1é²½ŀ'.,*#_<|>-~$", min_size=1, max_size=9), max_size=20))
def test_punctuation_after_words(words):
    text = " ".join(words)
    assert tc.encoder(FILE).encode([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_punctuation_is_met_once():
    """A word with other punctuation after it is no new core, and the library is not asked about it again."""
    own = tc.ChunkEncoder(FILE)
    own.encode(["word écrit"])
    assert own.split(b"Word***") == ("word", own.stops["***"])
    own._called = None
    assert own.encode(["Word*** word"])[0].tolist() == LIBRARY.encode("Word*** word", add_special_tokens=False).ids
