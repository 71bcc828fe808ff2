import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import byte_bpe
from pagewright.llm.queries import BYTE_RANKS

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def enc() -> tiktoken.Encoding:
    return byte_bpe.encoding(BYTE_RANKS, PATTERN)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "\n", "\t", "é", "'s", "12", "!", "　", "\x1c", "日本", "word"]), max_size=60), st.integers(1, 40))
def test_split_texts_have_the_ids_of_whole_texts(parts, times):
    enc = byte_bpe.encoding(BYTE_RANKS, PATTERN)
    text = "".join(parts) * times
    kept = byte_bpe.LONG, byte_bpe.LONG_RUN
    byte_bpe.LONG, byte_bpe.LONG_RUN = 16, 4
    byte_bpe._run = __import__("re").compile(rf"[{byte_bpe.SPACE}]{{4,}}")
    try:
        ids = byte_bpe.encode(enc, text)
    finally:
        byte_bpe.LONG, byte_bpe.LONG_RUN = kept
        byte_bpe._run = __import__("re").compile(rf"[{byte_bpe.SPACE}]{{{kept[1]},}}")
    assert ids.tolist() == enc.encode_ordinary(text)
    assert byte_bpe.decode(enc, ids.tolist()) == text.encode()


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 2_000_000, " " * 2_000_000 + "x", "!" * 200_000, "x y\n" * 60_000])
def test_very_long_texts_round_trip(enc, text):
    assert byte_bpe.decode(enc, byte_bpe.encode(enc, text).tolist()) == text.encode()


def test_rows(spark):
    rows = [(1, "Hello world", 5), (2, None, 6), (None, "", 7), (1, "Hello world", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    encoded = byte_bpe.encode_documents(docs, BYTE_RANKS, PATTERN)
    out = byte_bpe.digests(byte_bpe.decode_ids(encoded, BYTE_RANKS, PATTERN)).collect()
    assert len(out) == 4
    empty = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in out if r.doc_id in (2, None)] == [(2, 0, empty, empty), (None, 0, empty, empty)]
    assert {r.decoded_sha256 for r in out if r.doc_id == 1} == {hashlib.sha256(b"Hello world").hexdigest()}
    assert byte_bpe.encode_documents(docs.limit(0), BYTE_RANKS, PATTERN).count() == 0
    whole = byte_bpe.round_trip(docs, BYTE_RANKS, PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in whole) == sorted((str(r.doc_id), *tuple(r)[1:]) for r in out)
    assert all(len(r.ids) == r.n_tokens for r in whole)
    bare = byte_bpe.round_trip(docs, BYTE_RANKS, PATTERN, with_ids=False)
    assert bare.columns == out[0].__fields__ and sorted(map(str, bare.collect())) == sorted(map(str, out))
