import hashlib
import math
import re
from fractions import Fraction

import duckdb
import pytest

from pagewright.llm import mix_sources as ms
from pagewright.llm.queries import ORACLES, QUERIES


def shares(sizes, weights, most):
    """Targets by stopping one source at a time, in fractions."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        rest = total - sum(most * sizes[s] for s in stopped)
        out = {s: Fraction(rest * weight[s], sum(weight[x] for x in free)) if s in free else Fraction(most * sizes[s]) for s in names}
        over = [s for s in free if out[s] > most * sizes[s]]
        if not over:
            return out
        stopped.add(max(over, key=lambda s: out[s] - most * sizes[s]))


def plain(rows, quality, weights, most):
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    target, out = shares(sizes, weights, most), []
    for source in sizes:
        order = []
        for i, (key, text, own) in enumerate(rows):
            if own == source:
                bits = int(hashlib.md5(f"{ms.SEED}:{'' if key is None else key}".encode()).hexdigest()[:13], 16)
                order.append((-math.log((bits + 0.5) / 2**52) / quality.get(key, ms.UNLABELLED), -math.inf if key is None else key, size(text), i))
        before, epochs = 0, int(target[source] // sizes[source]) if sizes[source] else 0
        left = target[source] - epochs * sizes[source]
        for *_, n, i in sorted(order):
            taken = n * (epochs + (n > 0 and 2 * before + n <= 2 * left))
            out.append((rows[i][0], n, sizes[source], float(target[source]), taken))
            before += n
    return sorted(out, key=str)


def test_against_plain_rule(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), ["b", "a", None, "ü", "z"][i % 5 if i % 3 else 0]) for i in range(300)]
    rows += [(1000 + i, "few words here", f"tiny{i}") for i in range(4)] + [(2000, None, "nothing"), (2001, " \t\x0b\n ", "nothing"), (2002, "", None)]
    rows += [(None, "no id", "a"), (None, "no id", "a"), (7, "again seven", "a"), (7, "again seven", "a"), (3000, "long " * 50_000, "b"), (3001, "one\x1ctwo three four", "z")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, `a.b` int")
    quality = spark.createDataFrame([(i, 0.5 + i % 4) for i in range(0, 250, 2)] + [(0, 0.1), (5, -1.0), (None, 9.0)], "doc_id long, weight double")
    known = {i: 0.5 + i % 4 for i in range(0, 250, 2)}
    planned = ms.plan(docs, quality)
    got = planned.collect()
    assert sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got), key=str) == plain(rows, known, (1, 2, 3), 3)
    assert {r.target for r in got if r.source == "tiny0"} == {9.0} and {r.copies for r in got if r.source == "tiny0"} == {3}
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2
    assert all(r.taken <= 3 * r.size for r in got)
    assert sorted(planned.collect(), key=str) == sorted(ms.plan(docs.repartition(3), quality).collect(), key=str)
    assert ms.plan(docs.limit(0)).count() == 0 and ms.plan(docs.limit(0), quality.limit(0)).count() == 0
    mixed = ms.mixture(docs, planned)
    assert mixed.columns == [*docs.columns, "epoch"]
    taken = sum(r.taken for r in got)
    assert mixed.agg({"text": "count"}).first()[0] and sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in mixed.collect()) == taken


def test_better_documents_are_drawn_more_often(spark):
    rows = [(i, "w " * 10, f"s{i % 2}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    quality = spark.createDataFrame([(i, 4.0 if i % 4 < 2 else 1.0) for i in range(4000)], "doc_id long, weight double")
    got = ms.plan(docs, quality, weights=(1, 5)).filter("source = 's0'").collect()
    share = lambda good: sum(r.copies for r in got if (r.doc_id % 4 < 2) == good) / 1000
    # A third of the source is drawn; 1 - exp(-4 t) and 1 - exp(-t) of both halves, with t of about 0.15.
    assert abs(share(True) + share(False) - 2 / 3) < 0.01 and abs(share(True) - 0.505) < 0.05 and abs(share(False) - 0.161) < 0.04


def test_running_sums_of_one_group(spark):
    rows = spark.range(5000).selectExpr("'x' AS g", "id", "id % 7 AS v")
    got = ms.running(rows, ["g"], ["id"], rows.v).orderBy("id").collect()
    total = 0
    for r in got:
        assert r.before == total
        total += r.v


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_oracle(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    duck = duckdb.connect()
    for name in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = duck.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({ORACLES['op11_mix_sources']})").fetchall()
    got = QUERIES["op11_mix_sources"](spark, folder).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got)) == sorted(want)
