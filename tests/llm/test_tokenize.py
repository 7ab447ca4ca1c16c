import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marquee.llm import tokenize as T

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return T.TrieEncoder(T.Vocabulary.load())


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=encoder.vocabulary.rank, special_tokens={})


HARD = ["", " ", "a" * 3000, " " * 2000 + "x", "<|endoftext|>", "abć\r\n\r\n\tx", "🇨🇿" * 200, "don't WON'T we've  ", "日本語のテキスト。" * 20, "​‎\u0000", "ééé" * 50]


def test_hard_texts(encoder, reference):
    offsets, ids = encoder.encode(HARD + [None])
    got = [list(ids[a:b]) for a, b in zip(offsets, offsets[1:])]
    assert got == [reference.encode_ordinary(t) for t in HARD] + [[]]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    e = test_any_text.encoder = getattr(test_any_text, "encoder", None) or T.TrieEncoder(T.Vocabulary.load())
    enc = test_any_text.ref = getattr(test_any_text, "ref", None) or tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=e.vocabulary.rank, special_tokens={})
    assert list(e.encode([text])[1]) == enc.encode_ordinary(text)


def test_frame(spark, reference):
    df = spark.createDataFrame([(1, "film film", 0), (2, None, 0), (3, "", 0), (1, "film film", 0)], "doc_id bigint, text string, ids int")
    rows = sorted((r.doc_id, list(r.ids)) for r in T.token_ids(df, "doc_id", "text").collect())
    x = reference.encode_ordinary("film film")
    assert rows == [(1, x), (1, x), (2, []), (3, [])]
    assert T.token_ids(df.limit(0), "doc_id", "text").count() == 0
    counts = {(r.doc_id, r.n_tokens) for r in T.token_counts(df, "text", keep=["doc_id"]).collect()}
    assert counts == {(1, len(x)), (2, 0), (3, 0)}
