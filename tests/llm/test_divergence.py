import random
import re

import duckdb
import numpy as np
import pytest

from pagewright.llm import divergence as dv
from pagewright.llm.queries import ORACLES, QUERIES


def plain(rows, least=3, most=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        holders = {}
        for _, _, terms in own:
            for term in set(terms):
                holders[term] = holders.get(term, 0) + 1
        kept = sorted((t for t, n in holders.items() if n >= least), key=str.encode)

        def share(groups):
            counts = {t: 0 for t in kept}
            for _, source, terms in own:
                if source in groups:
                    for t in terms:
                        if t in counts:
                            counts[t] += 1
            total = sum(counts.values()) + len(kept)
            return counts, {t: 1 + 10**9 * (counts[t] + 1) // total for t in kept}

        sources = sorted({d[1] for d in own})
        tables = {s: share({s}) for s in sources}
        whole = share(set(sources))[1]
        for s in sources:
            counts, p = tables[s]
            pairs = [(-sum((p[t] - tables[o][1][t]) ** 2 // tables[o][1][t] for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-((p[t] - whole[t]) ** 2 // whole[t]), t.encode(), t) for t in kept if counts[t] and p[t] > whole[t]]
            out += [(lang, s, "pair", item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", item, -v, k + 1) for k, (v, _, item) in enumerate(sorted(terms)[:most])]
    return sorted(out)


def rows_of(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdeéßЖ中😀" for b in ("x", "Y", "zz", "ö", "")]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randrange(40))) + "-it's 3 a_b\x00c\u0085d", rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S", "ü", None, ""])) for _ in range(150)]
    rows += [("hot words hot", "en", "s1")] * 200 + [(None, "fr", "only"), ("rare", "it", "a"), ("", "it", "b"), ("12 34", "it", None)]
    return [*rows, ("long " * 200_000, "en", "s2"), ("x" * 300_000, "en", "s2")]


@pytest.mark.parametrize("cells,held", [(1 << 20, 400_000), (20, 30)])
def test_against_plain_rule(spark, monkeypatch, cells, held):
    monkeypatch.setattr(dv, "CELLS", cells)
    monkeypatch.setattr(dv, "HELD", held)
    monkeypatch.setattr(dv, "PIECE", 50_000)
    rows = rows_of()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, n int, `a.term` int").repartition(4)
    assert sorted(map(tuple, dv.audit(docs).collect())) == plain(rows)
    assert sorted(map(tuple, dv.audit(docs, least=1, most=3).collect())) == plain(rows, 1, 3)
    assert dv.audit(docs.limit(0)).count() == 0


def test_arithmetic_is_exact():
    rng = random.Random(1)
    for total in (1, 7, 10**9, 9 * 10**15):
        c = [0, *(rng.randrange(total) for _ in range(50))]
        assert dv.scaled(np.array(c), total).tolist() == [1 + 10**9 * (x + 1) // total for x in c]
    big = np.array([(1 << 62) + 12345, 3, (1 << 53) + 1])
    assert dv.dense(np.array([1, 0, 1]), np.array([0, 1, 1]), big, 2, 2).tolist() == [[0, 3], [(1 << 62) + 12345, (1 << 53) + 1]]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_oracle(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = duck.execute(ORACLES["op13_divergence"]).fetchall()
    assert sorted(map(tuple, QUERIES["op13_divergence"](spark, folder).collect())) == sorted(want)
