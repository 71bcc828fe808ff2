import math
import random
from collections import Counter

import pytest

from pagewright.llm import decontaminate as dc
from pagewright.llm.queries import QUERIES


def plain_scores(items, words):
    """BM25 of every passage and item, as shares of the items' own, over the threshold."""
    lists = {key: dc.words_of(text) for key, text in items}
    lists = {key: w for key, w in lists.items() if w}
    mean = sum(map(len, lists.values())) / len(lists)
    frequency = Counter(w for words in lists.values() for w in set(words))

    def impacts(own):
        counts = Counter(own)
        idf = {w: math.log(1 + (len(lists) - frequency[w] + 0.5) / (frequency[w] + 0.5)) for w in counts}
        return {w: idf[w] * n * (dc.K1 + 1) / (n + dc.K1 * (1 - dc.B + dc.B * len(own) / mean)) for w, n in counts.items()}

    out = {}
    tables = {key: impacts(own) for key, own in lists.items()}
    for start in range(0, max(1, len(words) - dc.WINDOW + dc.STRIDE), dc.STRIDE):
        passage = set(words[start : start + dc.WINDOW])
        for key, table in tables.items():
            score = sum(v for w, v in table.items() if w in passage) / sum(table.values())
            if score >= dc.THRESHOLD:
                out[key] = max(out.get(key, 0), score)
    return out


def made(seed=4, count=60):
    rng = random.Random(seed)
    vocabulary = [f"w{min(int(rng.expovariate(0.01)), 900)}" for _ in range(4000)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, f"{text(rng.randint(4, 50))}? {text(rng.randint(1, 20))}.") for i in range(count)]
    docs = []
    for i in range(120):
        kind, (key, item) = rng.randrange(4), rng.choice(items)
        words = item.split()
        if kind == 1 and len(words) > 20:
            words[len(words) // 2] = "changed"
        if kind == 2:
            words = words[: len(words) // 4]
        inside = "" if kind == 3 else " ".join(words).upper()
        docs.append((i, f"{text(rng.randint(0, 300))} {inside} {text(rng.randint(0, 90))}"))
    return items, docs


def index_of(items):
    counts = Counter(w for _, text in items for w in set(dc.words_of(text)))
    return dc.Index.of(items, len(items), counts, sum(len(dc.words_of(t)) for _, t in items) / len(items))


@pytest.mark.parametrize("slab", [1024, 2])
def test_wand_finds_all_over_the_threshold(monkeypatch, slab):
    monkeypatch.setattr(dc, "SLAB", slab)
    items, docs = made()
    index = index_of(items)
    some = 0
    for _, text in docs:
        words = dc.words_of(text)
        want = plain_scores(items, words)
        got = {index.ids[k]: v[0] for k, v in index.candidates(words).items()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
        some += len(want)
    assert some > 30


def test_rows(spark):
    items = [(7, "Which river runs through the old town of Brell? It is the wide river Aune."), (8, None), (9, "?!")]
    leak = "some words before " * 30 + items[0][1].lower() + " and after" * 40
    half = "Which river runs through the old town of Brell? Nobody here can say that for sure at all."
    docs = [(1, leak, "q"), (2, half, "q"), (3, None, "q"), (None, leak, "q"), (4, "", "q"), (5, "long " * 100_000 + leak, "q"), (1, leak, "q")]
    made_docs = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    made_items = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    for most in (4096, 1):
        out = dc.find_leaks(made_docs, made_items, most_items=most).collect()
        assert sorted((r.doc_id or 0, r.item_id) for r in out) == [(0, 7), (1, 7), (1, 7), (5, 7)]
    assert sorted(r.doc_id or 0 for r in dc.clean(made_docs, made_items).collect()) == [0, 2, 3, 4]
    assert dc.find_leaks(made_docs.limit(0), made_items).count() == 0
    assert dc.find_leaks(made_docs, made_items.limit(0)).count() == 0


def test_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    items = {r.item_id: dc.words_of(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    want = set()
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        text = " " + " ".join(dc.words_of(row.text)) + " "
        want |= {(row.doc_id, key) for key, words in items.items() if f" {' '.join(words)} " in text}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op5_decontaminate"](spark, folder).collect()}
    assert want and got == want


@pytest.mark.parametrize("rare", ["even", "first", "ends"])
def test_exact_copies_of_long_items(rare):
    """A whole copy of an item is found at every length and place, wherever its rare words are."""
    rng = random.Random(8)
    items = []
    for key, size in enumerate([60, 64, 65, 90, 97, 98, 110, 130, 200, 400, 1000]):
        places = {"even": range(size), "first": range(20), "ends": [*range(10), *range(size - 10, size)]}[rare]
        items.append((key, " ".join(f"r{rng.randrange(10**6)}" if i in places else f"c{rng.randrange(40)}" for i in range(size))))
    index = index_of(items)
    for key, text in items:
        for before in [*range(0, 70, 3), 1000]:
            around = lambda n: " ".join(f"o{rng.randrange(500)}" for _ in range(n))
            found = {leak[0] for leak in index.leaks(f"{around(before)} {text} {around(rng.randrange(100))}")}
            assert key in found
