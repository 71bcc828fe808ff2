import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import cover_tree as ct
from pagewright.llm.queries import ORACLES, QUERIES


def plain(rows, asked, k):
    """Brute force in Python's integers."""
    sets = [(key, [math.floor(1024 * x) for x in v]) for key, v in rows if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for key, own in {(key, tuple(v)) for key, v in sets if asked(key)}:
        found = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(own, v, strict=True)))), other) for other, v in sets if other != key and len(v) == len(own))
        out += [(key, i + 1, other, -s) for i, (s, other) in enumerate(found[:k])]
    return sorted(out)


def check_node(tree, node):
    inside = tree.x[node.low : node.high]
    if len(inside):
        assert np.sqrt(((inside - tree.x[node.centre]) ** 2).sum(1)).max() <= node.radius + 1e-6
    centres = [kid.centre for kid in node.kids]
    for i, kid in enumerate(node.kids):
        assert kid.radius <= node.radius / ct.BASE + 1e-6
        for other in centres[:i]:
            assert np.sqrt(((tree.x[kid.centre] - tree.x[other]) ** 2).sum()) > node.radius / ct.BASE
        check_node(tree, kid)
    assert node.high == (node.kids[-1].high if node.kids else node.own)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 5), st.integers(1, 400), st.integers(1, 60), st.integers(1, 12))
def test_search_is_exact_and_prunes(seed, dim, n, m, k):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(size=(n, dim)) * rng.choice([3, 300]) + rng.integers(-3, 4, (n, 1)) * 500)
    q = np.floor(rng.normal(size=(m, dim)) * 300)
    data, asked = ct.CoverTree.of(np.arange(n), x), ct.CoverTree.of(np.arange(m), q)
    check_node(data, data.root)
    assert sorted(data.ids.tolist()) == list(range(n))
    best = ct.Best(asked, k)
    assert ct.search(best, data) <= n * m
    for key, row, found in zip(asked.ids, asked.x, best.rows, strict=True):
        want = sorted((-int(row @ v), i) for i, v in enumerate(x) if i != key)[:k]
        assert found == want


def test_low_dimensions_are_pruned():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(4000, 3)) * 20 + rng.integers(-5, 6, (4000, 3)) * 1000)
    best = ct.Best(ct.CoverTree.of(np.arange(1000) + 10**6, x[:1000] + 1.0, ct.PACK_LEAF), 10)
    assert ct.search(best, ct.CoverTree.of(np.arange(4000), x)) < 0.3 * 4000 * 1000


def test_trees_of_given_vectors():
    """Random directions in 64 dimensions: trees have nodes, but what is nearest is so far that next to nothing is pruned."""
    rows = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.1/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.floor(1024 * np.array([r[1] for r in rows]))
    asked = ids % 100 == 0
    data, queries = ct.CoverTree.of(ids, x), ct.CoverTree.of(ids[asked], x[asked], ct.PACK_LEAF)
    check_node(data, data.root)
    assert data.nodes() > 10
    best = ct.Best(queries, 10)
    scored = ct.search(best, data)
    print(f"{data.nodes()} and {queries.nodes()} nodes, {1 - scored / len(ids) / asked.sum():.3f} of pairs pruned")
    for key, row, found in zip(queries.ids, queries.x, best.rows, strict=True):
        assert found == sorted((-int(row @ v), int(i)) for i, v in zip(ids, x, strict=True) if i != key)[:10]


def test_one_ranking_an_id_whatever_the_columns(spark):
    rows = [(0, [1.0, 2.0], 5, 6), (0, [0.5, 9.0], 5, 6), (0, [float("nan"), 0.0], 5, 6), (1, [1.0, 1.0], 5, 6), (2, [2.0, 0.0], 5, 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, query_id int")
    out = sorted(map(tuple, ct.top_k(vectors, vectors.filter("vec_id = 0"), groups=2).collect()))
    assert out == [(0, 1, 1, 512 * 1024 + 9216 * 1024), (0, 2, 2, 1024 * 1024)]


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(ct, "PACKS", 1)
    monkeypatch.setattr(ct, "PACK_ROWS", 2)
    monkeypatch.setattr(ct, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(120)]
    rows += [(500, None), (600, [1.0, None]), (700, [float("nan")] * 8), (None, rows[1][1]), (800, [1.0, 2.0]), (801, [3.0, -1.0]), (900, []), (901, [])]
    rows += [(1300, [1e30] * 8), (1301, [-3e38] + [0.0] * 7), (100, rows[100][1])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    out = ct.top_k(vectors, vectors.filter("vec_id % 100 = 0"), k=10, groups=3)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, out.collect())) == plain(rows, lambda key: key % 100 == 0, 10)
    assert ct.top_k(vectors.limit(0), vectors).count() == 0
    assert ct.top_k(vectors, vectors.limit(0)).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_oracle(spark, folder):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = duck.execute(ORACLES["op4_cover_tree"]).fetchall()
    assert sorted(map(tuple, QUERIES["op4_cover_tree"](spark, folder).collect())) == sorted(want)
