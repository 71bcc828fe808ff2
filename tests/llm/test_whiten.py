import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import whiten as wh
from pagewright.llm.queries import QUERIES


def fine(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def plain(rows, most=16):
    """Per length of vectors: everything in fractions but the decomposition, which comes from doubles of 80 bits' sums."""
    out = []
    for dim in {len(v) for _, v in rows if fine(v)}:
        held = [(key, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for key, v in rows if fine(v) and len(v) == dim]
        fit = sorted(set(x for _, x in held))
        n, s = len(fit), [sum(x[j] for x in fit) for j in range(dim)]
        d = [[n * x[j] - s[j] for j in range(dim)] for x in fit]
        v = np.array([[float(Fraction(sum(a[i] * a[j] for a in d), n**3)) for j in range(dim)] for i in range(dim)]).reshape(dim, dim)
        values, axes = np.linalg.eigh(v)
        values, axes = values[::-1], axes[:, ::-1]
        for key, x in held:
            own = [n * x[j] - s[j] for j in range(dim)]
            for k in range(min(most, int((values > max(0, values[0]) * dim * 2.3e-16).sum()) if dim else 0)):
                out.append((key, k + 1, n, sum(a * a for a in own), float(np.array([a / n for a in own]) @ axes[:, k] / math.sqrt(values[k])), values[k] / np.trace(v)))
    return out


def agree(got, want):
    key = lambda r: (str(r[0]), r[1], r[3], abs(r[4]))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for a, b in zip(got, want, strict=True):
        assert abs(abs(a[4]) - abs(b[4])) < 1e-9 and abs(a[5] / b[5] - 1) < 1e-9 and a[6] < 1e-9


def test_against_fractions(spark, monkeypatch):
    monkeypatch.setattr(wh, "BLOCK_CELLS", 64)
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(7, 7)) * [9, 5, 3, 2, 1.5, 1, 0.7]
    rows = [(i, (rng.normal(size=7) @ mix + 40).tolist()) for i in range(160)]
    rows += [(500 + i, rows[0][1]) for i in range(90)] + [(None, rows[3][1]), (4, rows[5][1])]
    rows += [(600, None), (601, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0]), (602, [math.nan] * 7), (603, [math.inf] * 7), (604, [])]
    rows += [(700 + i, rng.normal(size=2).tolist()) for i in range(12)] + [(800, [5.0]), (801, [5.0])]
    vectors = spark.createDataFrame([(k, v, 1, 2) for k, v in rows], "vec_id long, embedding array<double>, component int, `a.n` int").repartition(5)
    models = wh.fit(vectors, size=3)
    got = wh.whiten(vectors, models).collect()
    agree(got, plain(rows))
    assert models[7].n == 160 and models[7].directions.shape == (7, 7)
    assert wh.fit(vectors.limit(0)) == {} and wh.whiten(vectors, {}).count() == 0
    assert len(wh.fit(vectors, most=2)[7].explained) == 2


def test_large_numbers_stay_exact(spark):
    rows = [(i, [3e15 + i * 1000.0, -(2.0**52) * (i % 3), 1e-3 * i]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in wh.whiten(vectors, wh.fit(vectors)).collect()}
    x = [[math.floor(64 * c) for c in v] for _, v in rows]
    s = [sum(r[j] for r in x) for j in range(3)]
    for i, own in enumerate(x):
        assert got[i] == min((1 << 63) - 1, sum((40 * a - b) ** 2 for a, b in zip(own, s, strict=True)))
    assert [wh.unpacked(wh.packed(np.array(v))).tolist() for v in ([1, -128], [128], [1 << 40], [])] == [[1, -128], [128], [1 << 40], []]


def test_batches_with_offsets():
    batch = pa.array([[1.0, 2.0], None, [], [3.0, None], [4.0, 5.0]], pa.list_(pa.float64())).slice(1)
    assert [(d, r.tolist(), x.tolist()) for d, r, x in wh.whole_numbers(batch)] == [(0, [1], [[]]), (2, [3], [[256, 320]])]


@pytest.mark.parametrize("sf", ["0.001"])
def test_given_vectors(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    agree(QUERIES["op12_whiten"](spark, folder).collect(), plain(rows))
