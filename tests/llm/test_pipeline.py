import hashlib
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline as cp
from pagewright.llm import byte_bpe, decontaminate, toxicity
from tests.llm.test_decontaminate import index_of, plain_scores
from tests.llm.test_jaccard_join import plain as plain_links
from tests.llm.test_line_dedup import plain as plain_lines

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, FOLDER)
        rows = [r.asDict() for r in docs.collect()]
        out.append({r["doc_id"]: r for r in rows})
        assert len(out[-1]) == len(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_each_stage_is_the_plain_rule_on_its_input(spark, stages):
    first = {r.doc_id: r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    kept, lined, unique, clean, encoded = stages
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    wrong = [key for key in first.keys() - kept.keys() if labels.get(key) == 0]
    assert not wrong and all(first[key] == row for key, row in kept.items())
    want = plain_lines([(k, r["text"], r["source"]) for k, r in kept.items()], 10)
    assert {key: row["text"] for key, row in lined.items()} == {key: text for key, text, *_ in want}
    links = plain_links([(k, r["text"]) for k, r in lined.items()], cp.SHINGLE, cp.SHARE)
    assert unique.keys() == {key for key, _, comp in links if key == comp}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    index = index_of(items)
    for key, row in unique.items():
        words = decontaminate.words_of(row["text"])
        ordinal = {item: at for at, (item, _) in enumerate(items)}
        found = [min(index.overlaps(words, ordinal[item], 0, len(words))) for item in plain_scores(items, words)]
        assert (key in clean) == (max(found, default=0) < decontaminate.QUESTION)
    assert encoded.keys() == clean.keys()
    enc = byte_bpe.encoding(cp.RANKS, public_tokenizers.PATTERN)
    for key, row in encoded.items():
        assert row["ids"] == enc.encode_ordinary(clean[key]["text"]) and row["n_tokens"] == len(row["ids"])
        assert row["decoded_sha256"] == hashlib.sha256(clean[key]["text"].encode()).hexdigest()


def test_run_is_its_stages(spark, stages):
    assert Counter(r.doc_id for r in cp.run(spark, FOLDER).collect()) == Counter(stages[-1].keys())


def test_odd_documents(spark):
    rows = [(1, None, "en", None, None), (None, "no id here", None, "s", 3), (2, "", "en", "s", 0), (3, "long " * 50_000, "en", "s", 9), (4, "idiot " * 9, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, FOLDER)
        assert docs.limit(0).count() == 0, name
    assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 1, 2, 3]
    assert toxicity.PATTERNS
