"""Anchors in pages, scored matches, greedy links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .bloom import among


def anchor_pages(pages: DataFrame, blocks: DataFrame, page_key: str, block_key: str, words: int = 8, shingle: int = 5) -> DataFrame:
    """``page_key, block_key``: pages whose words hold the first words of a block. Both: key and ``text``.

    The first shingle of an anchor is joined with the shingles of the pages by hash, so no block meets a page that lacks
    it; the whole anchor is looked for in those alone. Only shingles that may begin an anchor, and the texts of pages that hold
    one, are shuffled.
    """
    anchors = blocks.select(block_key, F.slice(F.split(T.anchor_words(F.col("text")), " "), 1, words).alias("a")).filter(F.size("a") >= words)
    anchors = anchors.select(block_key, F.xxhash64(F.array_join(F.slice("a", 1, shingle), " ")).alias("h"), F.concat(F.lit(" "), F.array_join("a", " "), F.lit(" ")).alias("anchor"))
    own = pages.select(page_key, T.anchor_words(F.col("text")).alias("words")).withColumn("w", F.split("words", " ")).filter(F.size("w") >= shingle)
    hashes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (shingle - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, shingle), " "))))
    shingles = own.select(page_key, F.explode(hashes).alias("h"))
    near = among(shingles, anchors, "h").join(anchors, "h").select(page_key, block_key, "anchor").distinct()
    texts = among(pages.select(page_key, "text"), near, page_key).select(page_key, F.concat(F.lit(" "), T.anchor_words(F.col("text")), F.lit(" ")).alias("words"))
    return near.join(texts, page_key).filter(F.contains("words", "anchor")).select(page_key, block_key)


def best_matches(pairs: DataFrame, key: str, order: str, least: float = 0.55, enough: float = 0.92) -> DataFrame:
    """Of a key's candidates in order the best score, or the first that is enough. ``pairs``: ``key, order, score``."""
    first = F.min(F.when(F.col("score") >= enough, F.col(order)))
    best = F.max_by(order, F.struct("score", -F.col(order)))
    out = pairs.filter(F.col("score") >= least).groupBy(key).agg(first.alias("_first"), best.alias("_best"))
    return out.select(key, F.coalesce("_first", "_best").alias(order))


def score(element: str, block: str) -> float:
    """The score of ``functions.text.match_score`` for one pair."""
    if not element or not block:
        return 0.0
    if element == block:
        return 1.0
    if element in block:
        return min(0.98, len(element) / len(block) + 0.62)
    if block in element:
        return min(0.96, len(block) / len(element) + 0.55)
    words = [w for w in element.split(" ") if len(w) > 2]
    return sum(w in block for w in words) / len(words) if words else 0.0


#: A block is looked for from so many before the last link to so many after it; scores that link, and that end the search.
BACK, AHEAD, LEAST, ENOUGH = 1, 18, 0.55, 0.92


class Linker:
    """Elements of one document linked near the block of the one before. A link may step back by one, so none of its blocks is let go."""

    def __init__(self) -> None:
        self.cursor, self.blocks = 0, []

    def link(self, text: str) -> tuple[int, float] | None:
        best, words, least = None, None, LEAST
        for at in range(max(0, self.cursor - BACK), min(len(self.blocks), self.cursor + AHEAD)):
            block = self.blocks[at][1]
            if not block:
                continue
            if text in block or block in text:
                value = score(text, block)
            else:  # the share of words as in ``score``, left off where it can't reach what counts
                if words is None:
                    words = [w for w in text.split(" ") if len(w) > 2]
                    count = len(words)
                missing, most = 0, count - least * count + 1e-6
                for word in words:
                    if word not in block:
                        missing += 1
                        if missing > most:
                            break
                if not count or missing > most:
                    continue
                value = (count - missing) / count
            if value >= LEAST and (best is None or value > best[1]):
                best, least = (at, value), value
            if value >= ENOUGH:
                break
        if best is None:
            return None
        self.cursor = best[0]
        return self.blocks[best[0]][0], best[1]


def link_in_order(elements: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """``key, element, block, score``: elements in order, each linked near the block of the one before. Both: ``key, ord, text``.

    Both sides are one sorted stream, shuffled once: a document's blocks, then its elements, each linked as it comes. A task
    holds one document's blocks and a batch of rows. Elements of less than two characters are passed over.
    """
    sides = [x.select(F.col(key).cast("long").alias("key"), F.lit(side).alias("side"), F.col("ord").cast("long").alias("ord"), T.match_text(F.col("text")).alias("text")) for side, x in enumerate((blocks, elements))]
    both = sides[0].unionByName(sides[1].filter(F.length("text") >= 2)).filter("key IS NOT NULL")
    stream = both.repartition("key").sortWithinPartitions("key", "side", "ord")
    schema = pa.schema([(key, pa.int64()), ("element", pa.int64()), ("block", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, linker = None, Linker()
        for batch in batches:
            found = []
            for own, side, ord_, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if own != last:
                    last, linker = own, Linker()
                if side == 0:
                    linker.blocks.append((ord_, text or ""))
                elif match := linker.link(text):
                    found.append((own, ord_, *match))
            columns = zip(*found, strict=True) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return stream.mapInArrow(run, f"`{key}` long, element long, block long, score double")


def nearest(targets: DataFrame, entries: DataFrame, keys: list[str], target: str, place: str, entry: str) -> DataFrame:
    """The entry of the same keys nearest to each target, the first of ties."""
    distance = F.abs(F.col(place) - F.col(target))
    joined = targets.join(entries, keys)
    return joined.groupBy(*keys, target).agg(F.min_by(entry, F.struct(distance, F.col(entry))).alias(entry))


def next_with_label(cursors: DataFrame, blocks: DataFrame, key: str, labels: tuple[str, ...]) -> DataFrame:
    """The first block with a label at or after the place before the cursor. ``cursors``: ``key, cursor``; ``blocks``: ``key, ord, label``."""
    wanted = blocks.filter(F.lower("label").isin(*labels)).select(key, "ord")
    joined = cursors.join(wanted, key, "left").filter(F.col("ord").isNull() | (F.col("ord") >= F.greatest(F.lit(0), F.col("cursor") - 1)))
    found = joined.groupBy(key, "cursor").agg(F.min("ord").alias("ord"))
    return cursors.join(found, [key, "cursor"], "left")


def first_in_order(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The first row of a key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")
