"""Benchmark items in training texts: BM25 with block-max WAND over every passage, then overlap of question and answer."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, rows_of, text_of

WORD = re.compile(r"\w+")
#: BM25's saturation and length weight.
K1, B = 1.2, 0.75
#: Words of a passage, and between the starts of two.
WINDOW, STRIDE = 64, 32
#: A passage is a candidate for an item when its score is such a share of the item's own, of an item of more than LONG
#: words of its best stretch of WINDOW words. Two passages hold a copy of the others, or of that stretch, so that one has half.
THRESHOLD = 0.5
LONG = 2 * WINDOW - STRIDE + 1
#: Shares of the words of question and answer that matched runs of three words must cover.
QUESTION, ANSWER = 0.6, 0.6
#: Items of an index, and of one of its blocks; more items make more indexes, each broadcast for a pass of its own.
MOST_ITEMS, BLOCK = 4096, 4
RUN = 3
#: Strides of text whose bounds are in memory at once.
SLAB = 1024


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The answer is the last sentence and five words at least, the question what is before it; a short item is all answer."""
    words = words_of(text)
    sentences = [n for n in (len(words_of(s)) for s in re.split(r"(?<=[.!?])\s+", text)) if n]
    cut = max(0, len(words) - max(5, sentences[-1] if sentences else 0))
    return (words[:cut], words[cut:]) if cut else ([], words)


def best_stretch(words: list[str], impact: dict[str, float]) -> float:
    """The most that the different words of WINDOW words in a row sum to, less what rounding may add."""
    counts: Counter = Counter()
    total = best = 0.0
    for at, word in enumerate(words):
        total += 0 if counts[word] else impact[word]
        counts[word] += 1
        if at >= WINDOW:
            gone = words[at - WINDOW]
            counts[gone] -= 1
            total -= 0 if counts[gone] else impact[gone]
        best = max(best, total)
    return best * (1 - 1e-9)


@dataclass
class Index:
    """Inverted lists of items with BM25 impacts as shares of each item's own score (or its best stretch's), and their maxima by block.

    ``bounds[t, k]`` is the largest impact of term t in block k; row 0 is of unknown words. ``lists[t]`` holds the items
    (ascending) and impacts of term t.
    """

    ids: list
    items: list[tuple[list[str], list[str]]]
    terms: dict[str, int]
    lists: list[tuple[list[int], list[float]]]
    bounds: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple], total: int, frequency: dict[str, int], mean: float) -> Index:
        """``rows`` of item id and text; total, document frequencies and mean length are of all items."""
        terms: dict[str, int] = {}
        postings: list[list[tuple[int, float]]] = [[]]
        for at, (_, text) in enumerate(rows):
            words = words_of(text)
            counts = Counter(words)
            size = sum(counts.values())
            impact = {}
            for word, n in counts.items():
                idf = math.log(1 + (total - frequency[word] + 0.5) / (frequency[word] + 0.5))
                impact[word] = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean))
            own = sum(impact.values()) if size <= LONG else best_stretch(words, impact)
            for word, value in impact.items():
                if word not in terms:
                    terms[word] = len(postings)
                    postings.append([])
                postings[terms[word]].append((at, value / own))
        lists = [([i for i, _ in p], [v for _, v in p]) for p in postings]
        bounds = np.zeros((len(lists), -(-len(rows) // BLOCK)), np.float32)
        for t, (at, value) in enumerate(lists):
            np.maximum.at(bounds[t], np.array(at, np.int64) // BLOCK, value)
        return cls([key for key, _ in rows], [question_and_answer(text) for _, text in rows], terms, lists, bounds)

    def wand(self, terms: list[int], least: float, blocks: list[int]) -> Iterator[tuple[int, float]]:
        """Items whose impacts of these terms sum to ``least`` or more, document at a time, by pivots in the blocks whose maxima reach it."""
        slack = least - 1e-4  # bounds are 32-bit
        for block in blocks:
            own = []
            for t in terms:
                top = float(self.bounds[t, block])
                if top:
                    items, values = self.lists[t]
                    own.append([bisect_left(items, block * BLOCK), bisect_left(items, (block + 1) * BLOCK), top, items, values])
            while True:
                own = [x for x in own if x[0] < x[1]]
                own.sort(key=lambda x: x[3][x[0]])
                total, pivot = 0.0, None
                for at, _, top, items, _ in own:
                    total += top
                    if total >= slack:
                        pivot = items[at]
                        break
                if pivot is None:
                    break
                score = 0.0
                for x in own:
                    at, end, _, items, values = x
                    if items[at] > pivot:
                        break
                    at = bisect_left(items, pivot, at, end)
                    if at < end and items[at] == pivot:
                        score += values[at]
                        at += 1
                    x[0] = at
                if score >= least:
                    yield pivot, score

    def candidates(self, words: list[str]) -> dict[int, tuple[float, int, int]]:
        """Item to its best passage's score and the first and last words of the passages that are candidates for it."""
        known = self.terms
        ids = np.array([known.get(word, 0) for word in words], np.int64)
        found: dict[int, tuple[float, int, int]] = {}
        some = np.flatnonzero(ids)
        count = -(-len(ids) // STRIDE)
        for first in range(0, count if len(some) else 0, SLAB):
            # Upper bounds by block of each stride, a word once, and so of the passage of two strides that begins there.
            last = min(count, first + SLAB + 1)
            own = some[np.searchsorted(some, first * STRIDE) : np.searchsorted(some, last * STRIDE)]
            if not len(own):
                continue
            keys = np.unique(own // STRIDE * len(self.lists) + ids[own])
            stride = keys // len(self.lists)
            begins = np.flatnonzero(np.concatenate([[True], stride[1:] != stride[:-1]]))
            sums = np.zeros((last - first + 1, self.bounds.shape[1]), np.float32)
            sums[stride[begins] - first] = np.add.reduceat(self.bounds[keys % len(self.lists)], begins, axis=0)
            tops = (sums[:-1] + sums[1:])[: min(SLAB, max(1, count - 1 - first))] >= THRESHOLD - 1e-4
            for at in np.flatnonzero(tops.any(axis=1)).tolist():
                start = (first + at) * STRIDE
                terms = np.unique(ids[start : start + WINDOW])
                for item, score in self.wand(terms[terms > 0].tolist(), THRESHOLD, np.flatnonzero(tops[at]).tolist()):
                    best, a, b = found.get(item, (0.0, start, start))
                    found[item] = max(best, score), min(a, start), max(b, start + WINDOW)
        return found

    def overlaps(self, words: list[str], item: int, start: int, end: int) -> tuple[float, float]:
        """Shares of the words of question and answer in runs that are also in the text around its passages."""
        question, answer = self.items[item]
        whole = question + answer
        near = words[max(0, start - len(whole)) : end + len(whole)]
        run = min(RUN, len(whole))
        there = set(zip(*(near[k:] for k in range(run)), strict=False))
        covered = np.zeros(len(whole), bool)
        for at in range(len(whole) - run + 1):
            if tuple(whole[at : at + run]) in there:
                covered[at : at + run] = True
        cut = len(question)
        return float(covered[:cut].mean()) if cut else 1.0, float(covered[cut:].mean())

    def leaks(self, text: str) -> Iterator[tuple]:
        """``item id, score, question overlap, answer overlap`` of each item in a text."""
        words = words_of(text)
        for item, (score, start, end) in sorted(self.candidates(words).items()):
            question, answer = self.overlaps(words, item, start, end)
            if question >= QUESTION and answer >= ANSWER:
                yield self.ids[item], score, question, answer


def indexes(items: DataFrame, item_col: str = "item_id", text_col: str = "text", most_items: int = MOST_ITEMS) -> Iterator[Index]:
    """An index of MOST_ITEMS items at a time, with statistics of all; items without words are left out."""
    rows = items.select(F.col(item_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).filter(F.col("text").rlike(r"(?U)\w"))
    rows = rows.distinct()
    total = rows.count()
    parts = max(1, -(-total // max(1, most_items * 9 // 10)))
    mean_of, all_counts = 0, Counter()
    own: list[list[tuple]] = []
    for part in range(parts):
        held = [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).orderBy("id", "text").toLocalIterator()]
        for _, text in held:
            words = words_of(text)
            mean_of += len(words)
            all_counts.update(set(words))
        own.append(held if parts == 1 else [])
    for part in range(parts):
        held = own[part] or [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).orderBy("id", "text").toLocalIterator()]
        if held:
            yield Index.of(held, total, all_counts, mean_of / total)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", most_items: int = MOST_ITEMS) -> DataFrame:
    """``id_col, item_col, score, question_overlap, answer_overlap``: the items in each document's whole text.

    Every passage of WINDOW words (the last may be shorter) is a query; all items from THRESHOLD of their own score on
    (of their best stretch's, if they have more than LONG words; the score may then be over 1) are candidates, and those stay whose question and answer are both in the text around. Null texts and items hold
    nothing; rows with null ids and repeated rows are searched too; other columns are left out; empty tables give no rows.
    The index goes to every task, ``most_items`` items at a time, with a pass over the documents for each.
    """
    schema = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw"))
    kind = "id long, item long, score double, question_overlap double, answer_overlap double"
    out = None
    for index in indexes(items, item_col, "text", most_items):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            return batches_of(((key, *leak) for key, raw in rows_of(batches) for leak in index.leaks(text_of(raw))), schema)

        found = given.mapInArrow(run, kind)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = given.limit(0).selectExpr("id", *(f"cast(null AS {k.split()[1]}) AS {k.split()[0]}" for k in kind.split(", ")[1:]))
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item. Rows with null ids stay, since nothing tells them apart."""
    held = find_leaks(docs, items, id_col, text_col).select(F.col(id_col).alias("_leaky")).distinct()
    return docs.join(held, docs[id_col].cast("long") == held["_leaky"], "left_anti")
