"""Keyed state with timers: heartbeats of silent streams, leases that expire, the guard of generated text.

Each is a processor of Spark's ``transformWithState``; sessions need the RocksDB state store (``ROCKSDB``). Events have
numbers within their key; what comes early waits in state until the gap before it closes, so that decisions are those of
a fold in order, however events arrive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from ..functions.text import BOX_TRACE, DECODER_TRACE
from ..operators.repetition import LoopDetector, Runs
from ..sources import publish

#: What a session needs for the streams of this module.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Seconds of silence before a beat; attempts of a generation.
IDLE, ATTEMPTS = 20.0, 3


def frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({name: pd.Series([row[k] for row in rows], dtype=object) for k, name in enumerate(columns)})


def plain(value):
    """Pandas' missing values as None."""
    return None if value is None or value is pd.NA or value is pd.NaT or value != value else value


class _Beats(StatefulProcessor):
    """A key's clock: when it began, how often it was told to be silent, and when it will be again. Other timers of its are passed over."""

    def __init__(self, idle: float):
        self.idle = max(1, round(idle * 1000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "began long, beats long, due long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        text = ended = False
        for part in rows:
            text, ended = text or bool(part["has_text"].any()), ended or bool(part["ended"].any())
        if ended:
            self.clock.clear()
        elif text:
            self.clock.update((0, 0, 0))
        elif not self.clock.exists():
            now = timerValues.getCurrentProcessingTimeInMs()
            self._wait(now, 0, now)
        return iter(())

    def _wait(self, began: int, beats: int, now: int) -> None:
        self.clock.update((began, beats, now + self.idle))
        self.handle.registerTimer(now + self.idle)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.clock.get() if self.clock.exists() else None
        if held is None or held[2] != expiredTimerInfo.getExpiryTimeInMs():
            return iter(())
        now = timerValues.getCurrentProcessingTimeInMs()
        self._wait(held[0], held[1] + 1, now)
        return iter([frame([(key[0], held[1] + 1, (now - held[0]) / 1000)], ["stream", "beat", "elapsed"])])

    def close(self) -> None:
        pass


def heartbeats(events: DataFrame, idle: float = IDLE) -> DataFrame:
    """``stream, beat long, elapsed double``: a beat whenever a stream of events had no text for ``idle`` seconds since it began or since its last beat.

    ``events``: a stream of ``stream string, has_text boolean, ended boolean``. Beats are told by a processing-time timer, with no further event of the
    stream or of any other; they end with its first text or its end. Events without text don't put a beat off.
    """
    rows = events.select(F.col("stream").cast("string"), F.coalesce("has_text", F.lit(False)).alias("has_text"), F.coalesce("ended", F.lit(False)).alias("ended"))
    return rows.groupBy("stream").transformWithStateInPandas(_Beats(idle), "stream string, beat long, elapsed double", "append", "processingTime")


REQUEST = ["at", "kind", "lease", "model", "ttl"]


class _Leases(StatefulProcessor):
    """A pool's leases. Those that expire are in a map with a time to live; a timer tells of each, with or without a request."""

    columns = ["pool", "seq", "lease", "kind", "accepted"]

    def __init__(self, most: int, longest: float, first: int):
        self.most, self.longest, self.first = most, max(1, round(longest * 1000)), first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "seq long")
        self.waiting = handle.getMapState("waiting", "seq long", "at double, kind string, lease string, model string, ttl double")
        self.passing = handle.getMapState("passing", "lease string", "model string, expires double", ttlDurationMs=self.longest)
        self.lasting = handle.getMapState("lasting", "lease string", "model string, expires double")
        self.due = handle.getMapState("due", "lease string", "at long")

    def _live(self) -> dict[str, tuple]:
        return {k[0]: v for state in (self.passing, self.lasting) for k, v in list(state.iterator())}

    def _drop(self, lease: str) -> None:
        for state in (self.passing, self.lasting, self.due):
            state.removeKey((lease,))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        now = timerValues.getCurrentProcessingTimeInMs()
        for row in initialState.astype(object).where(initialState.notna(), None).itertuples():
            if row.part == "next":
                self.next.update((int(row.seq),))
            elif row.part == "waiting":
                self.waiting.updateValue((int(row.seq),), (row.at, row.kind, row.lease, row.model, row.ttl))
            elif row.due is None:
                self.lasting.updateValue((row.lease,), (row.model, row.expires))
            else:
                self.passing.updateValue((row.lease,), (row.model, row.expires))
                self.due.updateValue((row.lease,), (int(row.due),))
                self.handle.registerTimer(max(int(row.due), now + 1))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, seq = timerValues.getCurrentProcessingTimeInMs(), self.next.get()[0] if self.next.exists() else self.first
        early = {}
        for part in rows:
            for row in part[["seq", *REQUEST]].itertuples(index=False):
                if row.seq >= seq:
                    early[int(row.seq)] = tuple(map(plain, row[1:]))
        found, live, begun = [], None, seq
        while True:
            request = early.pop(seq, None) or (self.waiting.getValue((seq,)) if self.waiting.containsKey((seq,)) else None)
            if request is None:
                break
            self.waiting.removeKey((seq,))
            live = self._live() if live is None else live
            found.append(self._decided(key[0], seq, request, live, now))
            seq += 1
        for number, request in early.items():
            self.waiting.updateValue((number,), request)
        if seq != begun:
            self.next.update((seq,))
        return iter([frame(found, self.columns)])

    def _decided(self, pool: str, seq: int, request: tuple, live: dict[str, tuple], now: int) -> tuple:
        at, kind, lease, model, ttl = request
        for name in [k for k, v in live.items() if v[1] is not None and v[1] <= at]:
            self._drop(name)
            del live[name]
        if kind == "release":
            held = live.pop(lease, None) is not None
            if held:
                self._drop(lease)
            return pool, seq, lease, kind, held
        fits = lease not in live and len(live) < self.most and all(v[0] == model for v in live.values())
        if fits and ttl is not None and ttl > 0:
            live[lease] = model, at + ttl
            due = now + min(self.longest, max(1, round(ttl * 1000)))
            self.passing.updateValue((lease,), live[lease])
            self.due.updateValue((lease,), (due,))
            self.handle.registerTimer(due)
        elif fits:
            live[lease] = model, None
            self.lasting.updateValue((lease,), live[lease])
        return pool, seq, lease, kind, fits

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        gone = sorted(k[0] for k, v in list(self.due.iterator()) if v[0] <= until)
        for lease in gone:
            self._drop(lease)
        return iter([frame([(key[0], None, lease, "expired", None) for lease in gone], self.columns)])

    def close(self) -> None:
        pass


def leases(requests: DataFrame, most: int = 1, longest: float = 86_400.0, first: int = 1, start: DataFrame | None = None) -> DataFrame:
    """``pool, seq, lease, kind, accepted``: decisions on a stream of requests, and a row of kind ``expired`` for each lease that ran out.

    ``requests``: ``pool string, seq long, at double, kind string, lease string, model string, ttl double``, numbered from ``first`` in their pool
    without gaps; decisions are those of ``folds.leases`` in the order of their numbers, a request whose predecessor is missing
    waits, a number that was decided is passed over. A lease runs out by the clock of its requests when another is decided, and by
    the time of processing when nothing comes; ``longest`` seconds bound that. ``start``: rows of ``lease_snapshot``.
    """
    kind = "pool string, seq long, lease string, kind string, accepted boolean"
    keyed = requests.groupBy("pool")
    return keyed.transformWithStateInPandas(_Leases(most, longest, first), kind, "append", "processingTime", initialState=None if start is None else start.groupBy("pool"))


SNAPSHOT = "pool string, part string, lease string, model string, expires double, due long, seq long, at double, kind string, ttl double"


def lease_snapshot(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of a stopped ``leases`` query as rows ``SNAPSHOT``, in sorted keys: parts ``next``, ``live`` and ``waiting`` of each pool."""

    def state(name: str) -> DataFrame:
        return spark.read.format("statestore").option("stateVarName", name).load(checkpoint)

    pool = F.col("key.pool").alias("pool")
    none = {name: F.lit(None).cast(kind).alias(name) for name, kind in (field.split(" ") for field in SNAPSHOT.split(", "))}

    def rows(df: DataFrame, part: str, **given) -> DataFrame:
        columns = none | {"pool": pool, "part": F.lit(part).alias("part")} | {k: v.alias(k) for k, v in given.items()}
        return df.select(*columns.values())

    def live(name: str) -> DataFrame:
        return state(name).select("key", F.col("user_map_key.lease").alias("lease"), F.col("user_map_value").alias("value"))

    due = state("due").select(F.col("key").alias("k"), F.col("user_map_key.lease").alias("l"), F.col("user_map_value.at").alias("due"))
    # Values with a time to live come with the time of their end.
    passing = live("passing").withColumn("value", F.col("value.value")) if "value" in live("passing").select("value.*").columns else live("passing")
    dated = passing.join(due, (F.col("key") == F.col("k")) & (F.col("lease") == F.col("l")))
    out = rows(state("next"), "next", seq=F.col("value.seq"))
    out = out.unionByName(rows(dated, "live", lease=F.col("lease"), model=F.col("value.model"), expires=F.col("value.expires"), due=F.col("due")))
    out = out.unionByName(rows(live("lasting"), "live", lease=F.col("lease"), model=F.col("value.model"), expires=F.col("value.expires")))
    value = {name: F.col(f"user_map_value.{name}") for name in REQUEST}
    out = out.unionByName(rows(state("waiting"), "waiting", seq=F.col("user_map_key.seq"), **value))
    return out.orderBy("pool", "part", "lease", "seq")


def save_leases(snapshot: DataFrame, folder: str) -> None:
    """Publish a snapshot as sorted lines of JSON: the old one stays until the new one is whole."""
    publish.publish(snapshot.sparkSession, folder, snapshot.orderBy("pool", "part", "lease", "seq").coalesce(1).write.json)


def load_leases(spark: SparkSession, folder: str) -> DataFrame:
    """A published snapshot, to start from; none is an empty one. One that isn't sound raises, rather than let a lease through twice."""
    if publish.current(spark, folder) is None:
        return spark.createDataFrame([], SNAPSHOT)
    rows = publish.read(spark, folder, "json", schema=SNAPSHOT + ", _corrupt_record string", columnNameOfCorruptRecord="_corrupt_record").cache()
    named = (F.col("part") == "live") & F.col("lease").isNotNull() & F.col("model").isNotNull() | F.col("part").isin("next", "waiting") & F.col("seq").isNotNull()
    broken = rows.filter(F.col("_corrupt_record").isNotNull() | F.col("pool").isNull() | ~F.coalesce(named, F.lit(False))).count()
    twice = rows.groupBy("pool", "part", "lease", F.when(F.col("part") == "waiting", F.col("seq")).alias("seq")).agg(F.count("*").alias("n")).filter("n > 1").count()
    rows.unpersist()
    if broken or twice:
        raise ValueError(f"the lease snapshot at {folder} has {broken} broken and {twice} repeated rows")
    return rows.drop("_corrupt_record")


LATEX_RUN = re.compile(r"(?:\\(?:left|right|middle|text|frac|begin|end)\s*){6,}", re.IGNORECASE)
CONTEXT = re.compile(r"maximum context length of\s+(\d+)\s+tokens.*?(\d+)\s+tokens from the input messages and\s+(\d+)\s+tokens for the completion", re.IGNORECASE | re.DOTALL)


def tail_trace(tail: str) -> str | None:
    """What a tail shows besides grams: LaTeX commands in a row, one long line four times, traces of a decoder's layout."""
    low = tail.lower()
    if LATEX_RUN.search(low):
        return "repeated LaTeX command"
    lines = [line for line in (" ".join(x.split()) for x in low.split("\n")) if len(line) >= 24][-32:]
    again = next((line for k, line in enumerate(lines) if lines[: k + 1].count(line) >= 4), None)
    if again:
        return again[:160]
    if "<|det|>" in low:
        return None
    boxes, traces = len(re.findall(BOX_TRACE, low)), len(re.findall(DECODER_TRACE, low))
    numbered = sum(bool(re.match(r"\s*[0-9]{1,3}\s*:", line)) for line in low.split("\n"))
    if boxes >= 2 and (numbered >= 3 or traces >= 2):
        return "layout coordinate trace"
    return "decoder trace" if numbered >= 6 and traces >= 2 else None


class _Guard(StatefulProcessor):
    """A generation: its attempt, what was tried to mend it, and the detector of its text's window."""

    columns = ["stream", "attempt", "seq", "action", "reason", "max_tokens"]

    def __init__(self, rule: Runs, reserve: int, traces: bool):
        self.rule, self.reserve, self.traces = rule, reserve, traces

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "attempt int, seq long, context boolean, loop boolean, max_tokens long, ended boolean, detector string")
        self.waiting = handle.getMapState("waiting", "attempt int, seq long", "kind string, text string, max_tokens long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempt, seq, context, loop, budget, ended, state = self.run.get() if self.run.exists() else (1, 1, False, False, None, False, None)
        early: dict[tuple[int, int], tuple] = {}
        for part in rows:
            for row in part[["attempt", "seq", "kind", "text", "max_tokens"]].itertuples(index=False):
                if (row.attempt, row.seq) >= (attempt, seq):
                    early[int(row.attempt), int(row.seq)] = row.kind, plain(row.text), plain(row.max_tokens)
        found, detector = [], LoopDetector.of(state, self.rule)
        while not ended:
            at = attempt, seq
            event = early.pop(at, None) or (self.waiting.getValue(at) if self.waiting.containsKey(at) else None)
            if event is None:
                break
            if self.waiting.containsKey(at):
                self.waiting.removeKey(at)
            kind, text, tokens = event
            budget = int(tokens) if tokens is not None else budget
            mended, why, fewer = False, None, None
            if kind == "delta":
                gram = detector.feed(text or "")
                why = gram[1] if gram else tail_trace(detector.tail) if self.traces else None
                if why:
                    mended, loop = not loop, True
            elif kind == "error":
                why, match = text or "", CONTEXT.search(text or "")
                left = int(match[1]) - int(match[2]) - max(0, self.reserve) if match and not context else 0
                if 0 < left < (budget or (int(match[3]) if match else 0)):
                    mended, context, fewer, budget = True, True, left, left
            else:
                found.append((key[0], attempt, seq, "final", None, None))
                ended = True
            seq += 1
            if why is not None and mended and attempt < ATTEMPTS:
                found.append((key[0], attempt, seq - 1, "retry", why, fewer))
                attempt, seq, detector = attempt + 1, 1, LoopDetector(self.rule)
            elif why is not None:
                found.append((key[0], attempt, seq - 1, "error", why, None))
                ended = True
        if ended:
            self.waiting.clear()
            detector = LoopDetector(self.rule)
        else:
            for at, event in early.items():
                if at >= (attempt, seq):
                    self.waiting.updateValue(at, event)
        self.run.update((attempt, seq, context, loop, budget, ended, detector.state()))
        return iter([frame(found, self.columns)])

    def close(self) -> None:
        pass


def guard(events: DataFrame, rule: Runs = Runs(), reserve: int = 128, traces: bool = True) -> DataFrame:
    """``stream, attempt, seq, action, reason, max_tokens``: where a generation is to be stopped, and whether to try again.

    ``events``: a stream of ``stream string, attempt int, seq long, kind string, text string, max_tokens long``: deltas of a text, an ``error`` of the server, or
    its ``end``, numbered from 1 in each attempt. A text that repeats itself or shows a decoder's trace is stopped at the delta that
    shows it; it is tried again once, and once more with fewer tokens after an error about the context's length, three attempts
    in all. Then it is an error; an end is final. Events of an attempt that was stopped are passed over, early ones wait.
    """
    kind = "stream string, attempt int, seq long, action string, reason string, max_tokens long"
    return events.groupBy("stream").transformWithStateInPandas(_Guard(rule, reserve, traces), kind, "append", "none")
