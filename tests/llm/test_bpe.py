import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from plazaflow.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TOKENS = bpe.read_ranks(RANKS)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(TOKENS, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})


def test_perfect_hash_is_minimal_and_exact(codec):
    assert sorted(codec.table.ids) == list(range(len(TOKENS)))
    assert all(codec.table.find(t) == i for i, t in enumerate(TOKENS))
    assert codec.table.find(b"no such token at all") == -1
    assert bpe.PerfectHash([]).find(b"x") == -1 and bpe.PerfectHash([b"x"]).find(b"x") == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_equals_the_library(codec, library, text):
    text = text.encode("utf-8", "replace").decode()
    (ids,) = codec.encode([text])
    assert ids.tolist() == library.encode_ordinary(text)
    assert codec.decode(ids).decode() == text


@pytest.mark.parametrize("text", ["", "   ", "a" * 3000, "<|endoftext|>", "it's I'LL", "é" * 700, "\x00\n\n x", "🤷‍♂️🤷‍♂️"])
def test_edge_texts(codec, library, text):
    assert codec.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_memory_of_words_is_bounded(codec, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    c = bpe.Codec(TOKENS, P.PATTERN, codec.table)
    c.encode([" ".join(f"w{i}x{j}" for j in range(900)) for i in range(100)])
    assert len(c.known) <= 10 + 50_000 + 2_000


def test_rows(docs, library):
    pairs = [(1, "Hello wörld"), (1, "Hello wörld"), (2, None), (None, ""), (3, "x y")]
    df = docs(pairs).withColumnRenamed("source", "n_tokens")
    got = sorted(bpe.round_trip(df, RANKS, P.PATTERN).collect(), key=repr)
    assert len(got) == 5
    for r in got:
        text = {1: "Hello wörld", 3: "x y"}.get(r.doc_id, "")
        ids = library.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    whole = bpe.round_trip(docs(pairs), RANKS, P.PATTERN, texts=True)
    assert {(r.doc_id, r.text, len(r.ids)) for r in whole.collect()} == {(i, t or "", len(library.encode_ordinary(t or ""))) for i, t in pairs}
    assert bpe.round_trip(docs([]), RANKS, P.PATTERN, texts=True).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n,'s\u00a0é1", max_size=120))
def test_long_texts_go_by_pieces(codec, library, text):
    held, bpe.PIECE = bpe.PIECE, 10
    try:
        assert "".join(bpe.pieces(text)) == text
        assert codec.encode([text])[0].tolist() == library.encode_ordinary(text)
    finally:
        bpe.PIECE = held
