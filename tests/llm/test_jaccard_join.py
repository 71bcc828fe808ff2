import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import jaccard_join as jj
from pagewright.llm.graph import components
from pagewright.llm.queries import QUERIES


def shingles(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def plain(rows, n=3, share=90):
    sets = {key: shingles(text, n) for key, text, *_ in rows}
    comp = {key: key for key in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    holders = {}
    for key, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(key)
    near = {(a, b) for keys in holders.values() for a in keys for b in keys if a < b}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if 100 * both >= share * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            comp[y] = x
    return sorted((key, len(own), root(key)) for key, own in sets.items())


def near_copies(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for size in (1, 2, 3, 9, 10, 11, 12, 30, 60, 150, 400, 1500):
        base = rng.choices(vocabulary, k=size)
        for _ in range(14):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, size // 60, size // 30])):
                words[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append(" ".join(words if rng.random() < 0.5 else [w.upper() for w in words]))
    rng.shuffle(rows)
    return [(i * 3 + 1, text) for i, text in enumerate(rows)]


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 4)
    rows = near_copies() + [(0, None), (2, ""), (3, " \n\t"), (5, "one"), (6, "ONE"), (8, "x " * 100_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    got = sorted(map(tuple, jj.link(docs).collect()))
    assert got == plain(rows)
    assert len({c for *_, c in got}) < len(rows) - 20
    assert sorted(map(tuple, jj.link(docs, n=5, share=80).collect())) == plain(rows, 5, 80)
    assert jj.link(docs.limit(0)).count() == 0
    odd = jj.link(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, odd), key=str) == sorted([(None, 2, None), (4, 2, 4), (4, 2, 4)], key=str)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 600), st.integers(0, 80), st.sampled_from([80, 90]), st.randoms())
def test_linked_sets_share_a_piece(size, apart, share, rng):
    rest = np.array([rng.getrandbits(64) for _ in range(size + apart)], np.uint64)
    a, b = np.unique(rest[:size]), np.unique(rest[min(apart, size - 1) // 2 : size + apart // 2])
    both = len(np.intersect1d(a, b))
    if 100 * both < share * (len(a) + len(b) - both):
        return
    small, large = sorted((a, b), key=len)
    band = jj.band_of(len(small))
    assert band in jj.bands_of(len(large), share)
    assert set(jj.given_keys(small, band, share).tolist()) & set(jj.given_keys(large, band, share).tolist())
    one, other = jj.folded([jj.mini_sketch(a), jj.mini_sketch(b)])
    assert np.bitwise_count(one ^ other).sum() <= len(a) + len(b) - 2 * both


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    comp = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    assert all(got.get(x, x) == c for x, c in comp.items())


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op7_jaccard_join"](spark, folder).collect())) == plain(rows)
