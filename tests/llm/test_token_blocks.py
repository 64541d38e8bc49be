import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plazaflow.llm import token_blocks as T
from plazaflow.llm import word_table
from plazaflow.llm.word_table import WordTable

VOCABULARY = P.path("word_bpe_49k.json")
TEXTS = ["Hello, world! it's 12", "", None, "  \n\t ", "Ünï ﬁ İstanbul ΣΑΣ e\u0301", "<|endoftext|> <|startoftext|>", "a\x1cb\x85c\u00a0d", "x" * 300 + " y", "don't DON'T 'tis", "漢字かな\u3000交じり"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50_000), st.integers(0, 2**32 - 1)), max_size=700), st.floats(0.1, 0.99))
def test_blocks_round_trip(ids, percentile):
    x = np.array(ids, np.uint32)
    s = T.Segment(T.pack(x, np.array([len(x)]), percentile))
    assert (s.ids() == x).all()
    for k in range(s.blocks):
        assert (s.block(k) == x[k * T.BLOCK : (k + 1) * T.BLOCK]).all()


def test_outliers_are_exceptions_not_width():
    x = np.ones(256, np.uint32)
    x[7] = 40_000
    s = T.Segment(T.pack(x, np.array([256])))
    assert s.width[0] == 0 and s.n_exc[0] == 1 and s.ids()[7] == 40_000


def test_words_encode_as_texts(tokenizer):
    got = T.WordEncoder(VOCABULARY).encode(TEXTS)
    assert [x.tolist() for x in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(tokenizer, texts):
    clean = [t.encode("utf-8", "replace").decode() for t in texts]
    encoder = T.word_encoder(VOCABULARY)
    for _ in range(2):  # the second time from the table
        assert [x.tolist() for x in encoder.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in clean]


def test_a_full_table_still_encodes():
    def lengths(words):
        return np.concatenate([np.full(len(w), len(w), np.uint32) for w in words]), np.array([len(w) for w in words])

    table = WordTable(lengths, 3)
    for _ in range(3):
        assert [x.tolist() for x in table.encode([b"a bb ccc dddd a", b"", b"eeeee bb"])] == [[1, 2, 2, 3, 3, 3, 4, 4, 4, 4, 1], [], [5] * 5 + [2, 2]]
    assert table.n == 3


@pytest.mark.parametrize("segment_ids", [1, 50, 1 << 18])
def test_written_and_read(spark, docs, tokenizer, tmp_path, segment_ids):
    pairs = [(i * 7 % 31, TEXTS[i % len(TEXTS)]) for i in range(31)] + [(None, "none"), (3, "again"), (3, "again")]
    df = docs(pairs).withColumnRenamed("lang", "shard").repartition(3)
    T.write_tokens(df, str(tmp_path / "t"), VOCABULARY, segment_ids=segment_ids)
    got = sorted(T.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert len(got) == len(pairs)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == [None, *sorted(i for i, _ in pairs if i is not None)]
    text = dict(pairs)
    for r in got:
        if r.doc_id not in (3,):
            ids = [*tokenizer.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 2]
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_empty_table(spark, docs, tmp_path):
    T.write_tokens(docs([]), str(tmp_path / "t"), VOCABULARY)
    assert T.read_tokens(spark, str(tmp_path / "t")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\tcdéfghij", max_size=80), max_size=4))
def test_long_texts_go_by_pieces(tokenizer, texts):
    held, word_table.PIECE = word_table.PIECE, 12
    try:
        assert all(b"".join(word_table.cut_between_words(t.encode())) == t.encode() for t in texts)
        got = T.word_encoder(VOCABULARY).encode(texts)
        assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    finally:
        word_table.PIECE = held


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abc ", max_size=120), min_size=1, max_size=6))
def test_words_of_equal_hashes_are_told_apart_by_their_bytes(texts):
    def identity(words):
        return np.concatenate([np.frombuffer(w, np.uint8).astype(np.uint32) for w in words]), np.array([len(w) for w in words])

    real = word_table.hashes
    word_table.hashes = lambda data, starts, ends: [np.zeros(len(starts), np.uint64)] * 2
    try:
        table = WordTable(identity, 40)
        for _ in range(2):
            got = table.encode([t.encode() for t in texts])
            assert [bytes(x.astype(np.uint8)) for x in got] == ["".join(t.split()).encode() for t in texts]
    finally:
        word_table.hashes = real


def test_very_long_words_are_not_kept():
    def lengths(words):
        return np.array([len(w) for w in words], np.uint32), np.ones(len(words), np.int64)

    table = WordTable(lengths, 10)
    text = b"x" * 49 + b" " + b"x" * 48 + b" y " + b"x" * 49 + b" " + b"x" * 47 + b"z"
    for _ in range(2):
        assert table.encode([text])[0].tolist() == [49, 48, 1, 49, 48]
    assert table.n == 3
