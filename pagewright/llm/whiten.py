"""Whitening of embeddings: the covariance of all pairs of dimensions in tiles, summed over blocks of rows, decomposed once.

Vectors are whole numbers, so sums, centring and distances are exact. The rows to fit on, each distinct vector once, are
cut into blocks of rows and those into column blocks of TILE dimensions; the column blocks of a row block meet by its key,
each pair of them is multiplied, and products are summed by their tile. What reaches the driver are sums a dimension and
the tiles: the square of the dimension, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, partitions, written

#: The shift of the definition, x = floor(64 c) + 1000000, falls out of n x - S, so it isn't added.
SCALE = 64.0
#: Dimensions of a column block, entries of a row block, components that are returned.
TILE, BLOCK_CELLS, COMPONENTS = 32, 1 << 18, 16
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def whole_numbers(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(dimensions, rows, x)`` for each length of vectors in a batch: x = floor(64 c) of those without null or non-finite entries."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.where(np.asarray(vectors.is_valid()), np.asarray(vectors.value_lengths().fill_null(0)), -1)
    starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    flat = vectors.flatten()
    values = np.asarray(flat.fill_null(float("nan")).cast(pa.float64()), np.float64)
    for dim in sorted(set(sizes.tolist()) - {-1}):
        rows = np.flatnonzero(sizes == dim)
        c = values[starts[rows][:, None] + np.arange(dim)] if dim else np.zeros((len(rows), 0))
        fine = np.isfinite(c).all(axis=1)
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(SCALE * c[fine]), -float(1 << 62), float(1 << 62))
        yield int(dim), rows[fine], x.astype(np.int64)


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest of 1, 2, 4 or 8 bytes each that hold them all, one way for each array."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return bytes([width]) + np.ascontiguousarray(x, f"<i{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64)


def fit_list(vectors: DataFrame, vector_col: str) -> DataFrame:
    """``dim, x``: each distinct vector of whole numbers once; copies within a task's rows are one before they are shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, x in whole_numbers(batch.column(0)):
                if not dim:
                    continue
                found = list({packed(row) for row in x})
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(found), pa.int32()), pa.array(found, pa.binary())], ["dim", "x"])

    given = vectors.select(F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).filter("vector IS NOT NULL")
    return given.mapInArrow(run, "dim int, x binary").distinct()


def column_blocks(distinct: DataFrame, size: int) -> DataFrame:
    """``dim, block, tile, x``: row blocks of about BLOCK_CELLS entries, each as column blocks of ``size`` dimensions."""
    schema = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("tile", pa.int32()), ("x", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held: dict[int, list] = {}
            block = TaskContext.get().partitionId() << 32
            for batch in batches:
                for dim, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    own = held.setdefault(dim, [])
                    own.append(raw)
                    if len(own) * dim >= BLOCK_CELLS:
                        yield from cut(dim, block, held.pop(dim))
                        block += 1
            for dim, own in held.items():
                yield from cut(dim, block, own)
                block += 1

        return batches_of(rows(), schema, weigh=lambda row: len(row[-1]))

    def cut(dim: int, block: int, own: list) -> Iterator[tuple]:
        x = np.stack([unpacked(raw) for raw in own])
        for tile in range(-(-dim // size)):
            yield dim, block, tile, packed(x[:, tile * size : (tile + 1) * size].ravel())

    return distinct.mapInArrow(run, "dim int, block long, tile int, x binary")


def width(dim: int, tile: int, size: int) -> int:
    return min(size, dim - tile * size)


def sums_of(blocks: DataFrame, size: int) -> dict[int, tuple[int, np.ndarray]]:
    """The number of fitted vectors of each length and their exact sums a dimension (of floor(64 c), as Python's integers)."""
    schema = pa.schema([("dim", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for dim, tile, raw in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                    wide = width(dim, tile, size)
                    x = unpacked(raw).reshape(-1, wide)
                    # Halves of 32 bits, so that sums of any numbers of a block fit.
                    for j, (high, low) in enumerate(zip((x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist(), strict=True)):
                        yield dim, tile * size + j, len(x), high, low

        return batches_of(rows(), schema)

    parts = blocks.select("dim", "tile", "x").mapInArrow(run, "dim int, j int, n long, high long, low long")
    total = parts.groupBy("dim", "j").agg(F.sum("n"), F.sum(F.col("high").cast("decimal(38,0)")), F.sum(F.col("low").cast("decimal(38,0)"))).collect()
    out: dict[int, tuple[int, np.ndarray]] = {}
    for dim, j, n, high, low in total:
        out.setdefault(dim, (n, np.zeros(dim, object)))[1][j] = (int(high) << 32) + int(low)
    return out


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n x - S, exact: 64-bit numbers where all fit, else Python's integers."""
    most = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max((abs(v) for v in s.tolist()), default=0)
    if most < 1 << 62:
        return n * x - s.astype(np.int64)
    return x.astype(object) * n - s


def squares(d: np.ndarray) -> np.ndarray:
    """Sums of the squares of each row, exact; what 64 bits can't hold becomes the greatest that they can."""
    most = max(abs(int(d.max(initial=0))), abs(int(d.min(initial=0)))) if d.size else 0
    if most * most * max(1, d.shape[1]) < HIGHEST:
        return (d.astype(np.int64) ** 2).sum(axis=1)
    return np.array([min(HIGHEST, sum(v * v for v in row)) for row in d.astype(object).tolist()], np.int64)


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """x - S / n as doubles, rounded once after exact subtraction and once by the division."""
    return deviations(x, n, s).astype(np.float64) / n


def summed(parts: DataFrame, kind: str) -> DataFrame:
    """Arrays of doubles ``dim, i, j, at, x`` (bytes) summed by ``dim, i, j`` in the order of ``at``, as ``dim, i, j, x``."""
    schema = pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("x", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            last, held = None, None
            for batch in batches:
                for *key, _, raw in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                    x = np.frombuffer(raw, np.float64)
                    if key != last:
                        if last is not None:
                            yield *last, held.tobytes()
                        last, held = key, x.copy()
                    else:
                        held += x
            if last is not None:
                yield *last, held.tobytes()

        return batches_of(rows(), schema, weigh=lambda row: len(row[-1]))

    ordered = parts.repartition(partitions(parts.sparkSession), "dim", "i", "j").sortWithinPartitions("dim", "i", "j", "at")
    return ordered.mapInArrow(run, kind)


def row_blocks(blocks: DataFrame) -> DataFrame:
    """Column blocks shuffled by their row block, in order."""
    keyed = blocks.repartition(partitions(blocks.sparkSession), "dim", "block")
    return keyed.sortWithinPartitions("dim", "block", "tile").select("dim", "block", "tile", "x")


def by_block(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``dim, column blocks`` of each row block in a stream of ``row_blocks``."""
    last, held = None, []
    for batch in batches:
        for dim, block, tile, raw in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if (dim, block) != last:
                if held:
                    yield last[0], held
                last, held = (dim, block), []
            held.append(unpacked(raw).reshape(-1, width(dim, tile, size)))
    if held:
        yield last[0], held


def over_blocks(blocks: DataFrame, size: int, products: Callable[[int, list[np.ndarray]], Iterator[tuple[int, int, np.ndarray]]]) -> dict[tuple[int, int, int], np.ndarray]:
    """The sums of ``(i, j, matrix)`` that ``products`` gives of each row block, by ``dim, i, j``. A task adds its own first."""
    kind, part = "dim int, i int, j int, x binary", pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("at", pa.int32()), ("x", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for dim, tiles in by_block(batches, size):
            for i, j, x in products(dim, tiles):
                held[dim, i, j] = held[dim, i, j] + x if (dim, i, j) in held else x
        at = TaskContext.get().partitionId()
        return batches_of(((*key, at, x.tobytes()) for key, x in sorted(held.items(), key=lambda kv: kv[0])), part, weigh=lambda row: len(row[-1]))

    parts = row_blocks(blocks).mapInArrow(run, "dim int, i int, j int, at int, x binary")
    return {(dim, i, j): np.frombuffer(raw, np.float64) for dim, i, j, raw in summed(parts, kind).collect()}


@dataclass
class Whitening:
    """Of vectors of one length: their number and sums, directions over the root of their variance, shares of all variance."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.directions


def covariances(blocks: DataFrame, size: int, sums: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The covariance matrix of each length of vectors, by tiles of ``size`` by ``size`` pairs of dimensions."""

    def products(dim: int, tiles: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        n, s = sums.get(dim, (1, np.zeros(0, object)))
        z = [centred(x, n, s[k * size : (k + 1) * size]) for k, x in enumerate(tiles)]
        for i in range(len(z)):
            for j in range(i, len(z)):
                yield i, j, z[i].T @ z[j]

    out = {dim: np.zeros((dim, dim)) for dim in sums}
    for (dim, i, j), flat in over_blocks(blocks, size, products).items():
        if dim in out:
            tile = flat.reshape(width(dim, i, size), width(dim, j, size)) / sums[dim][0]
            rows, cols = slice(i * size, i * size + tile.shape[0]), slice(j * size, j * size + tile.shape[1])
            out[dim][rows, cols] = tile
            out[dim][cols, rows] = tile.T
    return out


def fit(vectors: DataFrame, most: int = COMPONENTS, vector_col: str = "embedding", size: int = TILE) -> dict[int, Whitening]:
    """A whitening for each length of vectors in the table: of their distinct vectors, up to ``most`` components, in tiles of ``size``.

    Directions whose variance is zero but for rounding can't be whitened and are none. Three passes read the distinct vectors
    (a byte an entry mostly) from the shared folder; the driver holds sums, tiles and directions.
    """
    blocks = written(column_blocks(fit_list(vectors, vector_col), size), "column-blocks")
    sums = sums_of(blocks, size)
    models = {}
    for dim, v in covariances(blocks, size, sums).items():
        values, directions = np.linalg.eigh(v)
        values, directions = values[::-1], directions[:, ::-1]
        sound = values > max(0.0, values[0]) * dim * np.finfo(float).eps
        count = min(most, int(sound.sum()))
        n, s = sums[dim]
        models[dim] = Whitening(n, s, directions[:, :count] / np.sqrt(values[:count]), values[:count] / (np.trace(v) or 1.0))

    def second(dim: int, tiles: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        if dim in models:  # sums of x - S / n are zero, so what is projected is centred
            y = models[dim].apply(np.concatenate(tiles, axis=1))
            yield 0, 0, y.T @ y

    for (dim, _, _), flat in over_blocks(blocks, size, second).items():
        count = models[dim].directions.shape[1]
        models[dim].identity_error = float(np.abs(flat.reshape(count, count) / models[dim].n - np.eye(count)).max(initial=0.0))
    return models


def whiten(vectors: DataFrame, models: dict[int, Whitening], id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component, from 1.

    Null vectors and vectors with null or non-finite entries have no rows; neither have vectors of a length that wasn't
    fitted, empty ones, and those of a length with one distinct vector, which has no direction. Lengths are tables of their own. Ids may be
    null or repeated. ``deviation`` beyond 64 bits becomes the greatest long; entries beyond 2^62 / 64 count as that. Other
    columns are left out; an empty table gives none.
    """
    kind = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = pa.schema([("row", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                for dim, rows, x in whole_numbers(part.column(1)):
                    model = models.get(dim)
                    if model is None or not model.directions.shape[1] or not len(rows):
                        continue
                    count, d = model.directions.shape[1], squares(deviations(x, model.n, model.sums))
                    each = np.repeat(rows, count)
                    columns = [part.column(0).take(pa.array(each)), np.tile(np.arange(1, count + 1), len(rows)), np.full(len(each), model.n), np.repeat(d, count)]
                    columns += [model.apply(x).ravel(), np.tile(model.explained, len(rows)), np.full(len(each), model.identity_error)]
                    yield pa.RecordBatch.from_arrays([columns[0], *(pa.array(c, t.type) for c, t in zip(columns[1:], list(schema)[1:], strict=True))], ["id", *schema.names[1:]])

    given = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).filter("vector IS NOT NULL")
    return given.mapInArrow(run, f"id {dict(given.dtypes)['id']}, {kind}").withColumnRenamed("id", id_col)
