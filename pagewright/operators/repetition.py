"""Detectors of texts that repeat themselves."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Words of table markup, whose runs are no repetition.
LAYOUT_WORDS = ("td", "tr", "th", "li", "left", "right", "text", "rowspan", "colspan")
BIBLIOGRAPHY = "arxiv preprint arxiv"


def repeated_lines(docs: DataFrame, key: str, text: Column, least_chars: int = 24, least_count: int = 4, last: int = 32) -> DataFrame:
    """``key, line, n``: long lines that recur among the last long lines of a document."""
    lines = F.transform(F.split(F.lower(T.normalize_newlines(text)), "\n"), lambda x: T.strip(F.regexp_replace(x, r"(?U)\s+", " ")))
    recent = F.slice(F.reverse(F.filter(lines, lambda x: F.length(x) >= least_chars)), 1, last)
    return docs.select(key, F.explode(recent).alias("line")).groupBy(key, "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


@dataclass(frozen=True)
class Runs:
    """What counts as a run of grams: their sizes, the window at a text's end, repetitions of exact and of dense runs."""

    sizes: tuple[int, ...] = (3, 4, 5, 6)
    tail: int = 4000
    exact: int = 4
    dense: int = 12
    extra_gap: int = 3
    least_words: int = 48
    least_letters: int = 12

    def counts(self, words: Sequence[str]) -> bool:
        """Whether a gram may repeat at all: long enough, not numbers alone, and with one word of table markup at most."""
        return sum(map(len, words)) >= self.least_letters and not all(w[0].isdigit() for w in words) and sum(w in LAYOUT_WORDS for w in words) < 2

    def found(self, gram: str, longest_exact: int, longest_dense: int) -> bool:
        return longest_exact >= self.exact or (longest_dense >= self.dense and gram != BIBLIOGRAPHY)


WORD = re.compile(r"[A-Za-z][A-Za-z-]+|[0-9]+")


def longest_run(places: Sequence[int], widest: int) -> int:
    """The most places in order of which each is at most ``widest`` after the one before."""
    best = run = 0
    last = None
    for at in places:
        run = run + 1 if last is not None and at - last <= widest else 1
        best, last = max(best, run), at
    return best


def runs_of(text: str | None, rule: Runs = Runs()) -> list[tuple[int, str, int, int]]:
    """``n, gram, longest exact run, longest dense run`` of a text's tail, by rolling hashes of word numbers.

    A gram that recurs k times has words that do, so only places where n such words follow each other are hashed. What
    shares a hash is told apart by its words.
    """
    words = WORD.findall((text or "").replace("\r\n", "\n").replace("\r", "\n")[-rule.tail :].lower())
    if len(words) < rule.least_words:
        return []
    least = min(rule.exact, rule.dense)
    numbers = dict(zip(words, range(len(words)), strict=True))
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    often = np.bincount(ids)[ids] >= least
    follow = np.concatenate([[0], np.cumsum(often)])
    keys = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    rolled, out = np.zeros(len(words), np.uint64), []
    for n in range(1, max(rule.sizes) + 1):
        rolled = rolled[: len(words) - n + 1] * np.uint64(0x100000001B3) + (keys[n - 1 :] ^ (keys[n - 1 :] >> np.uint64(29)))
        if n not in rule.sizes:
            continue
        starts = np.flatnonzero(follow[n:] - follow[:-n] == n)
        if len(starts) < least:
            continue
        order = starts[np.argsort(rolled[starts], kind="stable")]
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(rolled[order])) + 1, [len(order)]])
        for k in np.flatnonzero(np.diff(bounds) >= least).tolist():
            places: dict[tuple, list[int]] = {}
            for at in order[bounds[k] : bounds[k + 1]].tolist():
                places.setdefault(tuple(words[at : at + n]), []).append(at)
            for gram, where in places.items():
                if len(where) >= least and rule.counts(gram):
                    longest = longest_run(where, n), longest_run(where, n + rule.extra_gap)
                    if rule.found(" ".join(gram), *longest):
                        out.append((n, " ".join(gram), *longest))
    return out


def ngram_runs(docs: DataFrame, key: str, text: Column, rule: Runs = Runs()) -> DataFrame:
    """``key, n, gram, longest_exact, longest_dense``: grams that recur in a run of positions, exact or dense, in a document's tail.

    Grams of short or only numeric words and of table markup don't count. One pass without a shuffle: the tails alone go to
    Python, and only runs come back.
    """
    kind = dict(docs.dtypes)[key]
    columns = [("n", pa.int32()), ("gram", pa.string()), ("longest_exact", pa.int64()), ("longest_dense", pa.int64())]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(at, *row) for at, raw in enumerate(batch.column(1).to_pylist()) for row in runs_of(raw, rule)]
            rows = [list(column) for column in zip(*found, strict=True)] or [[]] * 5
            keys = batch.column(0).take(pa.array(rows[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(values, t) for values, (_, t) in zip(rows[1:], columns, strict=True))], [key, *(name for name, _ in columns)])

    # A tail of line ends as two characters is twice as long; one more tells whether it begins within such a pair.
    tails = docs.select(key, F.right(text, F.lit(2 * rule.tail + 1)).alias("_tail"))
    return tails.mapInArrow(run, f"`{key}` {kind}, n int, gram string, longest_exact long, longest_dense long")


class LoopDetector:
    """``runs_of`` on a growing text, told delta by delta: whether its tail now holds a run.

    It keeps the tail's words with their places in the text and, of each gram, the places that it is at. A delta takes off
    words that the window left behind or that grew, and puts on new ones, at the ends of those lists; only lists that
    became longer are looked at. The state is of the window's size, whatever the text's.
    """

    def __init__(self, rule: Runs = Runs()):
        self.rule, self.tail, self.total, self.first = rule, "", 0, 0
        self.words: deque[tuple[int, int, str]] = deque()
        self.places: dict[tuple[str, ...], deque[int]] = {}
        self.grown: set[tuple[str, ...]] = set()
        self.after_return = False

    def state(self) -> str:
        return json.dumps([self.tail, self.total, self.first, list(self.words), self.after_return, sorted(map(list, self.grown))])

    @classmethod
    def of(cls, state: str | None, rule: Runs = Runs()) -> LoopDetector:
        own = cls(rule)
        if state:
            own.tail, own.total, first, words, own.after_return, grown = json.loads(state)
            own.first = first
            for word in words:
                own._push(tuple(word))
            own.grown = set(map(tuple, grown)) if len(own.words) >= rule.least_words else set(own.places)
        return own

    def _grams(self, at: int, front: bool) -> Iterator[tuple[str, ...]]:
        """Grams that begin (or else end) with the word at a place of ``words``."""
        for n in self.rule.sizes:
            low = at if front else at - n + 1
            if 0 <= low and low + n <= len(self.words):
                gram = tuple(self.words[k][2] for k in range(low, low + n))
                if self.rule.counts(gram):
                    yield gram

    def _push(self, word: tuple[int, int, str], front: bool = False) -> None:
        if front:
            self.words.appendleft(word)
            self.first -= 1
        else:
            self.words.append(word)
        for gram in self._grams(0 if front else len(self.words) - 1, front):
            held = self.places.setdefault(gram, deque())
            if front:
                held.appendleft(self.first)
            else:
                held.append(self.first + len(self.words) - len(gram))
            self.grown.add(gram)

    def _pop(self, front: bool) -> tuple[int, int, str]:
        for gram in self._grams(0 if front else len(self.words) - 1, front):
            held = self.places[gram]
            held.popleft() if front else held.pop()
            if not held:
                del self.places[gram]
        if front:
            self.first += 1
            return self.words.popleft()
        return self.words.pop()

    def feed(self, delta: str) -> tuple[int, str] | None:
        """Add to the text; the smallest run ``n, gram`` of its tail, if there is one that wasn't told of an earlier delta."""
        if self.after_return and delta.startswith("\n"):
            delta = delta[1:]
        if not delta:
            return None
        self.after_return = delta.endswith("\r")
        text = delta.replace("\r\n", "\n").replace("\r", "\n")
        begin = self.total - len(self.tail)
        whole = self.tail + text
        resume = len(self.tail)
        while resume and _within(whole[resume - 1]):
            resume -= 1
        while self.words and self.words[-1][0] >= begin + resume:
            self._pop(False)
        for low, high, word in _spans(whole[resume:]):
            self._push((begin + resume + low, begin + resume + high, word))
        self.total += len(text)
        edge = self.total - self.rule.tail
        while self.words and self.words[0][1] <= edge:
            self._pop(True)
        cut = edge - begin
        if cut > 0:
            if _within(whole[cut - 1]) and _within(whole[cut]):
                # The window begins within a run of letters and digits: what is left of it is cut into words anew.
                end = cut
                while end < len(whole) and _within(whole[end]):
                    end += 1
                while self.words and self.words[0][0] < begin + end:
                    self._pop(True)
                for low, high, word in reversed(list(_spans(whole[cut:end]))):
                    self._push((begin + cut + low, begin + cut + high, word), True)
            whole = whole[cut:]
        self.tail = whole
        if len(self.words) < self.rule.least_words:
            self.grown = set(self.places)
            return None
        grown, self.grown, best = self.grown, set(), None
        for gram in grown:
            held = self.places.get(gram, ())
            if len(held) >= min(self.rule.exact, self.rule.dense) and (best is None or (len(gram), " ".join(gram)) < best):
                n = len(gram)
                if self.rule.found(" ".join(gram), longest_run(held, n), longest_run(held, n + self.rule.extra_gap)):
                    best = n, " ".join(gram)
        return best


def _within(c: str) -> bool:
    """Whether a character, in lower case, may stand in a word; others part words."""
    return any(x.isascii() and (x.isalnum() or x == "-") for x in c.lower())


def _spans(text: str) -> Iterator[tuple[int, int, str]]:
    """Words of a text in lower case with their places in the text as it is; a few letters become two in lower case."""
    low = text.lower()
    if len(low) == len(text):
        for match in WORD.finditer(low):
            yield match.start(), match.end(), match.group()
        return
    where = [k for k, c in enumerate(text) for _ in c.lower()]
    for match in WORD.finditer(low):
        yield where[match.start()], where[match.end() - 1] + 1, match.group()


def first_lines_only(docs: DataFrame, key: str, text: Column, least_chars: int = 8) -> DataFrame:
    """``key, text`` up to where a document begins again with its first line, two lines or more on."""
    lines = F.transform(F.split(T.normalize_newlines(text), "\n"), lambda x: x)
    out = docs.select(key, text.alias("_text"), lines.alias("_lines"))
    filled = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("i"), T.strip(x).alias("s"))), lambda e: e["s"] != "")
    out = out.withColumn("_filled", filled).withColumn("_first", F.get("_filled", F.lit(0)))
    # The k-th filled line (from 0) has k - 1 filled lines between itself and the first.
    again = F.filter(F.transform("_filled", lambda e, k: F.struct(e["i"].alias("i"), e["s"].alias("s"), k.alias("k"))), lambda e: (e["k"] >= 2) & (e["s"] == F.col("_first")["s"]))
    cut = F.get(again, F.lit(0))["i"]
    kept = F.regexp_replace(F.array_join(F.slice("_lines", F.lit(1), F.greatest(cut, F.lit(1))), "\n"), r"(?U)\s+\z", "")
    return out.select(key, F.when(cut.isNotNull() & (F.length(F.col("_first")["s"]) >= least_chars), kept).otherwise(F.col("_text")).alias("text"))


def tail_unit(text: str, least_text: int = 800, longest_unit: int = 200, least_chars: int = 100, least_times: int = 5) -> str:
    """The text with its periodic tail cut to one unit and what is left of another; the shortest unit counts."""
    if len(text) < least_text:
        return text
    backward = text[::-1]
    for unit in range(1, min(longest_unit, len(text) - 1) + 1):
        if backward[:unit] != backward[unit : 2 * unit]:
            continue
        # How far the text read backward agrees with itself a unit on: doubling, then halving.
        low, high = unit, len(text) - unit
        while low < high:
            middle = (low + high + 1) // 2
            if backward[:middle] == backward[unit : unit + middle]:
                low = middle
            else:
                high = middle - 1
        total = low + unit
        times, rest = divmod(total, unit)
        if times >= least_times and total >= least_chars:
            return text[: len(text) - total + unit] + text[len(text) - rest :]
    return text


#: Bytes of a batch of texts that goes to Python, about, and rows of it that are Python's texts at once.
BATCH_BYTES, SLICE = 4 << 20, 128


def without_repeated_tail(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, text``; only texts long enough go to Python, in one scan.

    Batches are cut by bytes and turned into Python's texts a slice at a time, so a worker's memory follows neither the
    rows of a task nor the length of texts.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        parts = [texts.slice(at, SLICE) for at in range(0, len(texts), SLICE)]
        return pa.concat_arrays([pa.array([None if x is None else tail_unit(x) for x in part.to_pylist()], pa.string()) for part in parts] or [texts])

    long = F.length(text) >= 800
    return docs.select(key, F.when(long, cut(F.when(long, text))).otherwise(text).alias("text"))
