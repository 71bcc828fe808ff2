"""Exact top-k by inner product, with cover trees over queries and data searched together.

Vectors become integers by floor(1024 x), so scores are exact. Data are packed into blocks with a cover tree each, queries
likewise; a task meets each pack of queries with its blocks and goes down both trees at once. A pair of nodes with centres
q and p and covering radii r and s holds no score over q.p + r|p| + s|q| + rs; it is pruned when that is below the worst
k-th score of the queries under its query node.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, partitions, rows_of, written

SCALE = 1024.0
#: Rows of a data block and of a query pack, and of their nodes that aren't split; packs that one task holds together.
BLOCK_ROWS, PACK_ROWS, LEAF, PACK_LEAF, PACKS = 4096, 512, 48, 8, 8
#: A node's radius divided by this covers each of its children; centres of siblings are farther apart than that.
BASE = 1.3
#: What 64 bits hold.
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Sums below this are exact in 64-bit floats.
EXACT = float(1 << 53)


@dataclass
class Node:
    """Rows low to high of the tree's order; those before ``own`` are in no child."""

    centre: int
    radius: float
    low: int
    own: int = 0
    high: int = 0
    kids: list[Node] = field(default_factory=list)


@dataclass
class CoverTree:
    """Rows in tree order. A child's radius is its parent's divided by BASE at most, and centres of siblings are farther apart than that.

    A node of more than ``leaf`` rows is split, unless its children would be single rows for the most part: those are
    scored at once, which is what their bounds would cost.
    """

    ids: np.ndarray
    x: np.ndarray
    root: Node
    norms: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> CoverTree:
        order: list[np.ndarray] = []
        place = 0

        def spread(rows: np.ndarray, centre: int) -> np.ndarray:
            return np.sqrt(((x[rows] - x[centre]) ** 2).sum(axis=1))

        def centred(rows: np.ndarray) -> int:
            return int(rows[np.argmin(((x[rows] - x[rows].mean(axis=0)) ** 2).sum(axis=1))])

        # Depth first with the work kept on a list: (node, rows of it, their distances to the centre).
        first = centred(np.arange(len(x)))
        root = Node(first, 0.0, 0)
        work: list[tuple] = [("open", root, np.arange(len(x)), spread(np.arange(len(x)), first))]
        while work:
            what, node, rows, far = work.pop()
            if what == "close":
                node.high = place
                continue
            node.radius, node.low = float(far.max(initial=0.0)), place
            groups: list[tuple] = []
            if len(rows) > leaf and node.radius > 0:
                reach, left, distance, centre = node.radius / BASE, rows, far, node.centre
                while len(left):
                    near = distance <= reach
                    groups.append((centre, left[near], distance[near]))
                    left = left[~near]
                    if len(left):
                        centre = int(left[0])
                        distance = spread(left, centre)
                if 4 * len(groups) > 3 * len(rows):
                    groups = []
            own = np.zeros(0, int) if groups else rows
            order.append(own)
            place += len(own)
            node.own = place
            work.append(("close", node, None, None))
            for centre, part, distance in reversed(groups):
                kid = Node(centre, 0.0, 0)
                node.kids.insert(0, kid)
                work.append(("open", kid, part, distance))
        ranks = np.concatenate([np.zeros(0, int), *order])
        where = np.empty(len(ranks), int)
        where[ranks] = np.arange(len(ranks))
        nodes = [root]
        while nodes:
            node = nodes.pop()
            node.centre = int(where[node.centre])
            nodes += node.kids
        return cls(ids[ranks], x[ranks], root, np.sqrt((x[ranks] ** 2).sum(axis=1)))


    def nodes(self) -> int:
        count, work = 0, [self.root]
        while work:
            count += 1
            work += work.pop().kids
        return count


class Best:
    """The k best scores of each query so far; ties go to the smaller id."""

    def __init__(self, queries: CoverTree, k: int):
        self.queries, self.k = queries, k
        self.rows: list[list[tuple]] = [[] for _ in queries.ids]
        self.worst = np.full(len(queries.ids), -np.inf)

    def add(self, low: int, high: int, ids: np.ndarray, x: np.ndarray) -> None:
        q = self.queries.x[low:high]
        bound = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, x.shape[1])
        if bound < EXACT:
            scores = q @ x.T
        else:
            whole = lambda a: np.array([[int(v) for v in row] for row in a.tolist()], object).reshape(a.shape)
            scores = whole(q) @ whole(x).T if x.shape[1] else np.zeros((len(q), len(x)))
            scores = np.clip(scores, LOWEST, HIGHEST)
        may = np.asarray(scores >= self.worst[low:high, None], bool) & (ids[None, :] != self.queries.ids[low:high, None])
        for row in np.flatnonzero(may.any(axis=1)).tolist():
            cols = np.flatnonzero(may[row])
            found = self.rows[low + row] + [(-int(s), int(i)) for s, i in zip(scores[row, cols].tolist(), ids[cols].tolist(), strict=True)]
            found.sort()
            del found[self.k :]
            self.rows[low + row] = found
            if len(found) == self.k:
                self.worst[low + row] = np.nextafter(float(-found[-1][0]), -np.inf)


def search(best: Best, data: CoverTree) -> int:
    """Go through all pairs of nodes that may hold a better score, the best bounds first. The number of pairs of rows scored."""
    queries, scored = best.queries, 0
    work = [(queries.root, data.root, np.inf)]
    while work:
        q, p, bound = work.pop()
        if q.low == q.high or p.low == p.high or bound < best.worst[q.low : q.high].min():
            continue
        if q.kids and (q.radius >= p.radius or not p.kids):
            # Rows of a query node in no child are a group of their own, with the node's centre and radius.
            parts = [(kid, p) for kid in q.kids]
            if q.own > q.low:
                parts.append((Node(q.centre, q.radius, q.low, q.own, q.own), p))
        elif p.kids:
            parts = [(q, kid) for kid in p.kids]
            if p.own > p.low:
                parts.append((q, Node(p.centre, p.radius, p.low, p.own, p.own)))
        else:
            best.add(q.low, q.high, data.ids[p.low : p.high], data.x[p.low : p.high])
            scored += (q.high - q.low) * (p.high - p.low)
            continue
        a, b = [x.centre for x, _ in parts], [y.centre for _, y in parts]
        r, s = np.array([x.radius for x, _ in parts]), np.array([y.radius for _, y in parts])
        top = (queries.x[a] * data.x[b]).sum(axis=1) + r * data.norms[b] + s * queries.norms[a] + r * s
        top += np.abs(top) * 1e-9 + 1e-6
        work += [(*parts[at], float(top[at])) for at in np.argsort(top).tolist()]
    return scored


def whole_numbers(vectors: pa.Array) -> list[np.ndarray | None]:
    """floor(1024 x) of each component; None for a vector that takes no part."""
    out = []
    for vector in vectors.to_pylist():
        if vector is None or None in vector:
            out.append(None)
            continue
        x = np.floor(SCALE * np.array(vector, np.float64))
        out.append(x if np.isfinite(x).all() else None)
    return out


def packed(vectors: DataFrame, rows: int, leaf: int) -> DataFrame:
    """``dim, blob``: cover trees of ``rows`` vectors of one length at most. ``vectors``: ``id, vector``."""
    schema = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("seq", pa.int32()), ("blob", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def trees() -> Iterator[tuple]:
            held: dict[int, list] = {}
            part, seq = TaskContext.get().partitionId(), 0
            for batch in batches:
                for key, x in zip(batch.column(0).to_pylist(), whole_numbers(batch.column(1)), strict=True):
                    if x is None:
                        continue
                    own = held.setdefault(len(x), [])
                    own.append((key, x))
                    if len(own) == rows:
                        yield tree(held.pop(len(x)), part, seq)
                        seq += 1
            for own in held.values():
                yield tree(own, part, seq)
                seq += 1

        return batches_of(trees(), schema, weigh=lambda row: len(row[-1]))

    def tree(own: list, part: int, seq: int) -> tuple:
        made = CoverTree.of(np.array([key for key, _ in own], np.int64), np.array([x for _, x in own]).reshape(len(own), -1), leaf)
        return made.x.shape[1], part, seq, pickle.dumps(made)

    return vectors.mapInArrow(run, "dim int, part int, seq int, blob binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", groups: int | None = None) -> DataFrame:
    """``query_id, rank, id_col, score``: the k best of ``vectors`` for each of ``queries``, fewer if there are no more.

    A query never finds a row with its own id. Ties go to the smaller id. Null ids, null vectors and vectors with null or
    non-finite components take no part; vectors of other lengths than the query's don't either. An id is one query: of
    several vectors with it the smallest counts. Repeated rows of data each count. Scores that 64 bits can't hold become the
    nearest that they can before they are ranked. Other columns are left out; empty tables give no rows.

    Blocks of data are dealt into ``groups`` (by default the shuffle partitions) and packs of queries into sets of PACKS. A
    task holds one set and streams the blocks of a group past it, each once, and sends k rows a query.
    """
    shape = (F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    groups = groups or partitions(vectors.sparkSession)
    fine = "id IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND abs(x) < double('Infinity'))"
    blocks = written(packed(vectors.select(*shape).filter(fine), BLOCK_ROWS, LEAF), "blocks")
    asked = written(queries.select(*shape).filter(fine).groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    parts = max(1, -(-asked.count() // PACK_ROWS))
    sets = -(-parts // PACKS)
    packs = written(packed(asked.repartition(parts, "id"), PACK_ROWS, PACK_LEAF), "packs").withColumn("set", F.pmod("part", F.lit(sets)))

    def every(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    held = packs.select("dim", every(groups, "group"), "set", F.lit(0).alias("kind"), "part", "seq", "blob")
    met = blocks.select("dim", F.pmod(F.hash("part", "seq"), F.lit(groups)).alias("group"), every(sets, "set"), F.lit(1).alias("kind"), "part", "seq", "blob")
    stream = held.unionByName(met).repartition(groups * sets, "group", "set").sortWithinPartitions("dim", "group", "set", "kind", "part", "seq")
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            last, bests = None, []
            for batch in batches:
                for at in range(batch.num_rows):
                    *key, kind, _, _, blob = (column[at].as_py() for column in batch.columns)
                    if key != last:
                        yield from results(bests)
                        last, bests = key, []
                    if kind == 0:
                        bests.append(Best(pickle.loads(blob), k))
                    elif bests:
                        block = pickle.loads(blob)
                        for best in bests:
                            search(best, block)
            yield from results(bests)

        return batches_of(rows(), schema)

    def results(bests: list[Best]) -> Iterator[tuple]:
        for best in bests:
            for query, found in zip(best.queries.ids.tolist(), best.rows, strict=True):
                for score, key in found:
                    yield query, key, -score

    found = stream.mapInArrow(run, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


#: The rows of ``op4_cover_tree``.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
