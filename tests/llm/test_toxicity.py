import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import toxicity
from pagewright.llm.queries import QUERIES


def corpus(n, seed=1):
    rng = random.Random(seed)
    bad, good = ["idiot", "scum", "grobzaxa", "grobzine", "grobzolu"], [f"word{i}" for i in range(300)]
    for i in range(n):
        toxic = rng.random() < 0.2
        yield i, " ".join(rng.choices(good, k=40) + (rng.choices(bad, k=3) if toxic else [])), int(toxic)


def test_label_model_discounts_repeated_voters():
    rng = np.random.default_rng(3)
    truth = rng.random(2000) < 0.2
    one = np.where(truth, rng.random(2000) < 0.6, rng.random(2000) < 0.02)
    other = np.where(truth, rng.random(2000) < 0.6, rng.random(2000) < 0.02)
    votes = np.stack([one, one, one, other], axis=1).astype(float)
    labels = np.where(rng.random(2000) < 0.1, truth, -1)
    posterior, rates, right = toxicity.label_model(votes, labels, np.where(labels >= 0, 0.1 + 0.8 * labels, np.where(votes.any(1), 0.5, 0.05)))
    assert abs(rates[3, 0] - 0.6) < 0.1 and rates[3, 1] < 0.05
    assert rates[0, 2] < 0.5 < rates[3, 2]
    assert posterior[truth].mean() > 0.6 > 0.2 > posterior[~truth].mean()
    assert min(right) > 0.85


def test_accuracies_of_voters_and_labels_are_learned_from_unlabelled_rows():
    rng = np.random.default_rng(4)
    truth = rng.random(6000) < 0.25
    rates = [(0.7, 0.05), (0.5, 0.02), (0.6, 0.1), (0.4, 0.01), (0.3, 0.2)]
    votes = np.stack([np.where(truth, rng.random(6000) < a, rng.random(6000) < b) for a, b in rates], axis=1).astype(float)
    wrong = rng.random(6000) < 0.2
    labels = np.where(rng.random(6000) < 0.3, truth ^ wrong, -1)
    posterior, found, right = toxicity.label_model(votes, labels, np.where(labels >= 0, 0.1 + 0.8 * labels, np.where(votes.any(1), 0.5, 0.05)))
    assert np.abs(found[:, :2] - np.array(rates)).max() < 0.08
    assert abs(right[0] - 0.8) < 0.08 and abs(right[1] - 0.8) < 0.08
    flipped = (labels >= 0) & wrong
    assert (np.round(posterior[flipped]) == truth[flipped]).mean() > 0.7


def test_held_out_accuracy(spark):
    rows = list(corpus(1500))
    docs = spark.createDataFrame([(i, t, "x", 0.0) for i, t, _ in rows], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == 1500
    for row in out:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)
    assert np.mean([row.predicted == rows[row.doc_id][2] for row in out if row.held_out]) > 0.97


def test_held_out_labels_are_never_learned(spark):
    rows = list(corpus(600))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    one = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert one == toxicity.train(docs, spark.createDataFrame(flip, "doc_id long, toxic int"))


def test_odd_rows(spark):
    rows = [(1, None, "x"), (None, "idiot", "y"), (2, "", "z"), (2, "", "z"), (3, "fine words " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, predicted string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    out = toxicity.score(docs, model).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert {r.predicted for r in out if r.doc_id} == {0}
    odd = spark.createDataFrame([(1, None), (None, 1), (3, 7), (2, 0), (2, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs.limit(0), toxicity.train(docs, odd)).count() == 0
    dotted = toxicity.score(docs.withColumnRenamed("predicted", "a.predicted"), model)
    assert dotted.columns == ["doc_id", "text", "a.predicted", "held_out", "score", "predicted"] and dotted.count() == 5


def test_scores_are_of_the_features_that_were_fitted():
    model = toxicity.Model(-1.0, {"ab$": 0.5, "abc": 0.25, "xyz$": 2.0}, dict.fromkeys(toxicity.PATTERNS, 0.0))
    texts = ["", "ab", "abcd abce abcf abcg abch ab ab", "xyz " * 9, "fine words " * 2000 + "ab"]
    for text, got in zip(texts, toxicity.scores(model, pa.array([t.encode() for t in texts])), strict=True):
        found = toxicity.features(text)
        want = model.bias + sum(w * toxicity.strength(found[name]) for name, w in model.weights.items())
        assert abs(got - 1 / (1 + np.exp(-want))) < 1e-12


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_given_labels(spark, folder):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op6_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted and not labels[r.doc_id] for r in rows) <= 1
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.9
