import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm.pieces import Cache, PieceCodec, encoded, round_trip

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
OWN = PieceCodec(MODEL)

HARD = ["", " ", "   ", "\n", "a", " a", "a  b", "aaaaaaaaaaa", "▁", "x▁y", "Éréier enqueeau", "日本語 text", "🙂🙂 ok", "<s>", "<0x0A>", "<unk> </s>",
        "0123456789", "a1b2", "don't", "\x00\x01", "é", "THE!!  QUICK\t\tbrown_fox", "[[]]{{}}==>>//", "²x½", "नमस्ते", "a" * 3000, "ab " * 500, "　  x"]


@pytest.mark.parametrize("text", HARD)
def test_same_as_library(text):
    ids = LIBRARY.encode(text)
    assert OWN.encode(text).tolist() == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abcdehinorst THE.,\n'", max_size=80), st.text("▁ ax.1_", max_size=30)))
def test_same_as_library_on_any_text(text):
    ids = LIBRARY.encode(text)
    assert OWN.encode(text).tolist() == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids)


def test_cache_is_bounded():
    made = []
    cache = Cache(lambda k: made.append(k) or k * 2, 3)
    assert [cache[k] for k in (1, 2, 3, 4, 1, 9)] == [2, 4, 6, 8, 2, 18]
    assert len(cache) <= 3 and made == [1, 2, 3, 4, 9]


def test_frames(spark):
    texts = [*HARD, None, "same", "same"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in round_trip(docs, MODEL).collect()}
    whole = {r.doc_id: r for r in encoded(docs, MODEL).collect()}
    assert len(got) == len(whole) == len(texts)
    for i, t in enumerate(texts):
        ids = LIBRARY.encode(t or "")
        assert whole[i].ids == ids and whole[i].decoded == LIBRARY.decode(ids)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []


def test_units_are_cut_between_letters_and_others():
    """The one piece that joins a number sign to a full stop does not keep words and marks together."""
    assert OWN.unit.findall("▁ab.▁²x") == ["▁ab", ".", "▁²", "x"]
    for text in ("ab². ²x.²", "²½.a², b²³"):
        assert OWN.encode(text).tolist() == LIBRARY.encode(text)


def test_merging_makes_each_join_once(monkeypatch):
    """The pairs of neighbours are not all looked up again after every merge, and the caches stay bounded."""
    asked = []

    class Counted(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    monkeypatch.setattr(OWN, "order", Counted(OWN.order))
    text = "▁international" * 3
    assert OWN.merged(text) == LIBRARY.encode("international" + " international" * 2)
    assert 0 < len(asked) < 3 * len(text)


@settings(max_examples=300, deadline=None)
@given(st.text("aehnrstino", min_size=1, max_size=24))
def test_merges_are_those_of_the_library(text):
    assert OWN.merged("▁" + text) == LIBRARY.encode(text)
