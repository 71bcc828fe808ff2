import json
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagewright.llm import token_ids
from pagewright.llm.queries import WORD_BPE

parts = [*"aZé'Σ<|>12.日 \n\t\r", chr(0x85), chr(0x1C), chr(0xA0), chr(0x301), "'s", "<|endoftext|>", "İ"]
letters = st.lists(st.sampled_from(parts), max_size=40).map("".join)


whole = Tokenizer.from_file(WORD_BPE)


@settings(max_examples=300, deadline=None)
@given(st.lists(letters, min_size=1, max_size=5))
def test_words_have_the_ids_of_whole_texts(texts):
    encoder = token_ids.word_encoder(WORD_BPE, 2)
    assert encoder.parted
    got = [np.frombuffer(raw, "<u2").tolist() for raw in encoder.texts(texts)]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_given_texts_have_the_ids_of_whole_texts(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += ["a <|endoftext|> b", "x<|ENDOFTEXT|>Y <|StartOfText|>z<|startoftext|>.", "\x0b \x0c\x1c\x85 a\u2028b"]
    got = token_ids.WordEncoder(WORD_BPE, 2).texts(texts)
    assert all(np.frombuffer(raw, "<u2").tolist() == e.ids for raw, e in zip(got, whole.encode_batch(texts, add_special_tokens=False), strict=True))


def test_other_rules_encode_whole_texts(tmp_path):
    rules = json.loads(whole.to_str())
    rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\p{L}+(?= \p{N})|\S"
    path = str(tmp_path / "other.json")
    Path(path).write_text(json.dumps(rules))
    encoder = token_ids.WordEncoder(path, 2)
    texts = ["abc 1 def", "", "one 2 three"]
    assert not encoder.parted
    assert [np.frombuffer(raw, "<u2").tolist() for raw in encoder.texts(texts)] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700), st.booleans())
def test_elias_fano(values, dense):
    values = sorted(v % 97 if dense else v for v in values)
    coded = token_ids.EliasFano.of(np.array(values, np.int64))
    read, end = token_ids.EliasFano.read(memoryview(coded.to_bytes()), 0)
    assert end == len(coded.to_bytes())
    assert read.all().tolist() == values
    assert [read[i] for i in range(len(values))] == values
    assert end <= 40 + len(values) * (2 + max(0, int(np.log2(max(values, default=0) / max(1, len(values)) + 1))) + 2) / 8 + 4 * (len(values) // 256 + 2)


def test_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_ids, "SHARD_TOKENS", 50)
    long = "word " * 3000
    rows = [(i * 7 - 20, f"Text {i} is here", 1) for i in range(40)] + [(5, None, 2), (None, "x", 3), (9, long, 4), (1, "same", 5), (1, "same", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3)
    path = str(tmp_path / "t")
    token_ids.write_token_files(docs, path, WORD_BPE, 1, parts=4)
    got = sorted(token_ids.read_token_files(spark, path).collect(), key=lambda r: r.start)
    tok = Tokenizer.from_file(WORD_BPE)
    start = 0
    for row, (key, text, _) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert tuple(row) == (key, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    shard = token_ids.Shard(spark.read.parquet(path).filter("n_docs > 2").first().blob)
    assert [len(shard.document(i)) for i in range(len(shard))] == np.diff(shard.bounds.all()).tolist()


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_ids.write_token_files(docs, str(tmp_path / "e"), WORD_BPE, 1)
    assert token_ids.read_token_files(spark, str(tmp_path / "e")).count() == 0
