"""How sources of a language differ in their terms: exact divergences by integer dictionaries of dense chunks.

Terms of a language are dealt into chunks by hash. A chunk's kept terms are one sorted array of UTF-8, whose places are
their ids; occurrences become ids by binary search and counts of all sources a dense matrix by counting ids, one row a
source. All pairs of sources and all terms of a chunk are then integer arithmetic on rows, and ids order ties as UTF-8
does. A chunk has so many terms that its matrix holds about CELLS numbers, for few sources or for many.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, dropped, partitions, written

#: Documents of a language that a kept term is in, and ranks of terms that are given.
LEAST_DOCS, MOST_TERMS = 3, 200
#: Numbers of a chunk's matrix; counted terms that a task holds; bytes of a text that are split at once.
CELLS, HELD, PIECE = 1 << 20, 1_000_000, 1 << 22
BILLION = 1_000_000_000

#: A-Z becomes a-z; all other ASCII but letters becomes a blank, so that what is between blanks are terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(raw: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes of it at a time, cut between terms."""
    plain = (raw or b"").translate(_LETTERS)
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE) if at + PIECE < len(plain) else -1
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term of a group, and a row of no term for each group."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for lang, source, raw in zip(*(column.to_pylist() for column in batch.slice(at, 64).columns), strict=True):
                    if (lang, source) not in held:
                        held[lang, source] = Counter({b"": 0}), Counter()
                    counts, holders = held[lang, source]
                    before, seen = len(counts), set()
                    for part in terms_of(raw):
                        counts.update(part)
                        seen.update(part)
                    holders.update(seen)
                    size += len(counts) - before
                if size >= HELD:
                    yield from told(held)
                    held, size = {}, 0
        yield from told(held)

    def told(held: dict) -> Iterator[pa.RecordBatch]:
        while held:
            (lang, source), (counts, holders) = held.popitem()
            terms = list(counts)
            for at in range(0, len(terms), 1 << 14):
                part = terms[at : at + (1 << 14)]
                names = [pa.repeat(pa.scalar(x, pa.string()), len(part)) for x in (lang, source)]
                numbers = [pa.array([x[term] for term in part], pa.int64()) for x in (counts, holders)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(part, pa.binary()), *numbers], schema=schema)

    read = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    given = docs.select(read(lang_col).alias("lang"), read(source_col).alias("source"), F.col(f"`{text_col}`").cast("binary").alias("raw"))
    parts = given.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def chunked(counts: DataFrame, ways: int, least: int) -> DataFrame:
    """``lang, chunk, terms, sources, place, id, n``: a row for each chunk of a language, the first also where it keeps no term.

    ``terms``: the sorted kept terms; ``sources``: the sorted sources that hold any; ``place, id, n``: the counts that aren't 0,
    by place in sources and in terms. All rows of a term meet in its chunk, which knows in how many documents it is.
    """
    kind = "lang string, chunk int, terms array<binary>, sources array<string>, place array<int>, id array<int>, n array<long>"
    many = pa.list_
    schema = pa.schema([("lang", pa.string()), ("chunk", pa.int32()), ("terms", many(pa.binary())), ("sources", many(pa.string())), ("place", many(pa.int32())), ("id", many(pa.int32())), ("n", many(pa.int64()))])

    def encoded(lang: str, chunk: int, parts: list[list[np.ndarray]]) -> tuple:
        names, terms, n, docs = (np.concatenate(column) for column in zip(*parts, strict=True))
        names, terms, n, docs = (column[terms != b""] for column in (names, terms, n, docs))
        if not len(terms):
            return lang, chunk, [], [], [], [], []
        starts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
        kept = terms[starts][np.add.reduceat(docs, starts) >= least]
        if not len(kept):
            return lang, chunk, [], [], [], [], []
        ids = np.minimum(np.searchsorted(kept, terms), len(kept) - 1)
        held = np.flatnonzero(kept[ids] == terms)
        sources, place = np.unique(names[held], return_inverse=True)
        return lang, chunk, kept.tolist(), sources.tolist(), place, ids[held], n[held]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            last, held = None, []
            for batch in batches:
                if not batch.num_rows:
                    continue
                langs, chunks, *columns = (column.to_numpy(zero_copy_only=False) for column in batch.columns)
                cuts = np.flatnonzero((langs[1:] != langs[:-1]) | (chunks[1:] != chunks[:-1])) + 1
                for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                    key = langs[low], int(chunks[low])
                    if key != last:
                        if last is not None:
                            yield encoded(*last, held)
                        last, held = key, []
                    held.append([column[low:high] for column in columns])
            if last is not None:
                yield encoded(*last, held)

        return batches_of(rows(), schema, weigh=lambda row: 40 * len(row[2]) + 16 * len(row[6]))

    chunk = F.when(F.length("term") == 0, 0).otherwise(F.pmod(F.xxhash64("term"), F.lit(ways))).cast("int")
    dealt = counts.select("lang", chunk.alias("chunk"), "source", "term", "n", "docs").repartition(partitions(counts.sparkSession), "lang", "chunk")
    return dealt.sortWithinPartitions("lang", "chunk", "term", "source").mapInArrow(run, kind)


def totals_of(chunks: DataFrame) -> DataFrame:
    """``lang, source, n``: occurrences of kept terms of the groups; of a null source, the number of the language's kept terms."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for lang, size, sources, place, n in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                    yield lang, None, size
                    sums = np.zeros(len(sources), np.int64)
                    np.add.at(sums, np.array(place, np.int64), np.array(n, np.int64))
                    yield from ((lang, source, total) for source, total in zip(sources, sums.tolist(), strict=True))

        return batches_of(rows(), schema)

    sizes = chunks.select("lang", F.size("terms").cast("long").alias("size"), "sources", "place", "n")
    return sizes.mapInArrow(run, "lang string, source string, n long").groupBy("lang", "source").agg(F.sum("n").alias("n"))


def facts_of(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, kept, groups``: the number of a language's kept terms, and its sorted sources with their sums."""
    groups = counts.filter("length(term) = 0").select("lang", "source").join(totals.filter("source IS NOT NULL").hint("merge"), ["lang", "source"], "left")
    groups = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("groups"))
    return groups.join(totals.filter("source IS NULL").select("lang", F.col("n").alias("kept")).hint("merge"), "lang")


def scaled(c: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (c + 1) / total), exact for totals below 2^63 / 1000: long division, three digits at a time."""
    whole, rest = np.divmod(c + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def dense(place: np.ndarray, ids: np.ndarray, n: np.ndarray, rows: int, width: int) -> np.ndarray:
    """A matrix of counts by source and id. Halves of the counts are added as doubles, which hold each of them."""
    at = place * width + ids
    low, high = (np.bincount(at, weights=half, minlength=rows * width).astype(np.int64) for half in (n & 0x7FFFFFFF, n >> 31))
    return ((high << 31) + low).reshape(rows, width)


def divergences(counts: np.ndarray, sums: np.ndarray, kept: int, most: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Sums of floor((p - q)^2 / q) over the terms of a chunk, by source of p and of q; ids and values of each source's best terms."""
    size = len(sums)
    if not counts.shape[1]:
        return np.zeros((size, size), np.int64), [(np.zeros(0, int), np.zeros(0, np.int64))] * size
    p = scaled(counts, (sums + kept)[:, None])
    whole = scaled(counts.sum(axis=0), int(sums.sum()) + kept)
    pairs = np.zeros((size, size), np.int64)
    for other in range(size):
        apart = p - p[other]
        pairs[:, other] = (apart * apart // p[other]).sum(axis=1)
    best = []
    for own, n in zip(p, counts, strict=True):
        ids = np.flatnonzero((n > 0) & (own > whole))
        apart = own[ids] - whole[ids]
        value = apart * apart // whole[ids]
        first = np.argsort(-value, kind="stable")[:most]
        best.append((ids[first], value[first]))
    return pairs, best


def compared(chunks: DataFrame, facts: DataFrame, ways: int, most: int) -> DataFrame:
    """``lang, source, part, item, value``: partial sums of pairs, and the best terms of each chunk."""
    kind = "lang string, source string, part string, item binary, value long"
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.binary()), ("value", pa.int64())])
    here = facts.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    met = chunks.join(here.hint("merge"), ["lang", "chunk"])
    met = met.select("lang", "kept", F.col("groups.source").alias("names"), F.col("groups.n").alias("sums"), "terms", "sources", "place", "id", "n")

    def pairs_of(lang: str, names: list[str], sums: np.ndarray) -> Iterator[tuple]:
        raw = [name.encode() for name in names]
        for i, row in enumerate(sums.tolist()):
            for j, value in enumerate(row):
                if i != j:
                    yield lang, names[i], "pair", raw[j], value

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held: dict[str, tuple[list[str], np.ndarray]] = {}
            for batch in batches:
                for at in range(batch.num_rows):
                    lang, kept, names, sums, terms, sources, place, ids, n = (column[at].as_py() for column in batch.columns)
                    where = {name: k for k, name in enumerate(names)}
                    rank = np.array([where[name] for name in sources], np.int64)
                    place = rank[np.array(place, np.int64)] if place else np.zeros(0, np.int64)
                    table = dense(place, np.array(ids, np.int64), np.array(n, np.int64), len(names), len(terms))
                    pairs, best = divergences(table, np.array(sums, np.int64), kept, most)
                    for name, (found, values) in zip(names, best, strict=True):
                        for k, value in zip(found.tolist(), values.tolist(), strict=True):
                            yield lang, name, "term", terms[k], value
                    if lang in held:
                        pairs += held.pop(lang)[1]
                    # Sums wait for the language's next chunk while they are few.
                    held[lang] = names, pairs
                    if sum(len(own) ** 2 for own, _ in held.values()) > CELLS:
                        for own in list(held):
                            yield from pairs_of(own, *held.pop(own))
            for own in list(held):
                yield from pairs_of(own, *held.pop(own))

        return batches_of(rows(), schema, most=1 << 15)

    return met.mapInArrow(run, kind)


def audit(docs: DataFrame, least: int = LEAST_DOCS, most: int = MOST_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source differs from each other of its language, and in what terms from all.

    Terms are runs of ASCII letters, lower-cased, and all other characters beyond ASCII. A language keeps those in ``least`` of
    its documents. Counts become shares of 10^9 with one added to each; a difference is (p - q)^2 / q, rounded down. Part ``pair``: the
    sum over all kept terms to each other source, 0 where none is kept. Part ``term``: the ``most`` terms of the source's that exceed the
    language's share most. Ranks go by falling value, then by UTF-8.

    Null text, lang and source are empty ones, which are a language and a source of their own. Repeated rows are documents each. A
    group without terms has its pairs. Other columns are left out; an empty table gives none. All is exact while a group has fewer
    than 9 * 10^15 occurrences. Pairs of a language's sources are the result, so they grow with their square; its
    sources are in one row of facts.
    """
    counts = written(term_counts(docs, text_col, lang_col, source_col), "counts")
    sizes = counts.groupBy("lang").agg((F.approx_count_distinct("term", 0.02) * F.sum(F.when(F.length("term") == 0, 1).otherwise(0))).alias("cells"))
    ways = max(1, -(-int(sizes.agg(F.max("cells")).first()[0] or 0) // CELLS))
    chunks = written(chunked(counts, ways, least), "chunks")
    facts = written(facts_of(counts, totals_of(chunks)), "facts")
    found = written(compared(chunks, facts, ways, most), "differences")
    dropped(chunks)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    terms = found.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= most)
    out = pairs.withColumn("rank", rank).unionByName(terms)
    return out.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")


#: The rows of ``op13_divergence``.
SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), words AS (
  SELECT d, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST_DOCS}
), sizes AS (
  SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) GROUP BY ALL
), shares AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, 1 + ({BILLION}::HUGEINT * (coalesce(c, 0) + 1)) // (n + v) AS p
  FROM groups JOIN sizes USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
), whole AS (
  SELECT lang, term, 1 + ({BILLION}::HUGEINT * (sum(c) + 1)) // (sum(sum(c)) OVER (PARTITION BY lang) + any_value(v)) AS q FROM shares JOIN sizes USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {MOST_TERMS}
"""
