"""State machines over ordered events, as batch folds and over streams. Order is a sequence number, never arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Characters after which a grown text is shown, and seconds after which it is shown anyway.
SHOW_CHARS, SHOW_SECONDS = 24, 0.25
BOUNDARIES = (".", "\n", "。", "！", "？", "；", "，")


def parse_events(lines: DataFrame, column: str) -> DataFrame:
    """Event lines in JSON (``stream, seq, type, markdown``); lines that aren't events are left out."""
    kind = "stream string, seq long, type string, markdown string"
    return lines.select(F.from_json(column, kind).alias("e")).select("e.*").filter("type IS NOT NULL")


def event_lines(events: DataFrame) -> DataFrame:
    """Events as JSON lines, null fields left out."""
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def final_text(events: DataFrame) -> DataFrame:
    """``stream, markdown, failed``: the final text, else the last progress; whether an error came."""
    last = lambda kind: F.max_by(F.when(F.col("type") == kind, F.col("markdown")), F.when(F.col("type") == kind, F.col("seq")))
    out = events.groupBy("stream").agg(F.coalesce(last("final"), last("progress")).alias("markdown"), F.bool_or(F.col("type") == "error").alias("failed"))
    return out.select("stream", "markdown", "failed")


def stable_release(samples: DataFrame, key: str, order: str, value: Column, minimum: float, tolerance: float, needed: int) -> DataFrame:
    """``key, at``: where a run of samples first was long enough: none below the minimum, all within the tolerance.

    A sample out of tolerance begins a new run, one below the minimum ends it. A key's samples are folded in order in the
    JVM; the state is four numbers, the samples are one key's.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.cast("double").alias("v"))))
    empty = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(None).cast(dict(samples.dtypes)[order]).alias("at"))

    def step(s: Column, e: Column) -> Column:
        low, high = F.least(s["low"], e["v"]), F.greatest(s["high"], e["v"])
        below, goes_on = e["v"] < minimum, (s["n"] > 0) & (high - low <= tolerance)
        n = F.when(below, 0).when(goes_on, s["n"] + 1).otherwise(1)
        at = F.when(s["at"].isNull() & (n >= needed), e["o"]).otherwise(s["at"])
        return F.struct(n.alias("n"), F.when(goes_on, low).otherwise(e["v"]).alias("low"), F.when(goes_on, high).otherwise(e["v"]).alias("high"), at.alias("at"))

    return samples.groupBy(key).agg(F.aggregate(ordered, empty, step, lambda s: s["at"]).alias("at")).filter("at IS NOT NULL")


def changed_values(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before with the same key; the first always counts."""
    before = F.lag(F.struct(F.col(value))).over(Window.partitionBy(*key).orderBy(order))
    return rows.withColumn("_before", before).filter(F.col("_before").isNull() | ~F.col("_before")[value].eqNullSafe(F.col(value))).drop("_before")


def shown(text: str, last_size: int, last_time: float, now: float) -> bool:
    return len(text) - last_size >= SHOW_CHARS or text.endswith(BOUNDARIES) or now - last_time >= SHOW_SECONDS


def snapshots(deltas: DataFrame, stream: bool = False) -> DataFrame:
    """``stream, seq, markdown``: the growing text where it is shown. ``deltas``: ``stream, seq, at double, delta``.

    In a stream the state of each key is its text and what was shown last; a batch is folded the same way.
    """
    out, state = "stream string, seq long, markdown string", "text string, size long, time double"

    def fold(rows: pd.DataFrame, text: str, size: int, time: float) -> tuple[list, str, int, float]:
        found = []
        for row in rows.sort_values("seq").itertuples():
            text += row.delta or ""
            if text and len(text) != size and shown(text, size, time, row.at):
                found.append((row.stream, row.seq, text))
                size, time = len(text), row.at
        return found, text, size, time

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        found, *rest = fold(pd.concat(list(batches)), *(held.get if held.exists else ("", 0, 0.0)))
        held.update(tuple(rest))
        yield pd.DataFrame(found, columns=["stream", "seq", "markdown"])

    if stream:
        return deltas.groupBy("stream").applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)
    return deltas.groupBy("stream").applyInPandas(lambda rows: pd.DataFrame(fold(rows, "", 0, 0.0)[0], columns=["stream", "seq", "markdown"]), out)


def unsent(images: DataFrame) -> DataFrame:
    """A stream of ``stream, seq, path, data``: images whose data differs from what was sent last for the path."""
    kind = "stream string, seq long, path string, data string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        last, found = held.get[0] if held.exists else None, []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            if row.data != last:
                found.append(tuple(row))
                last = row.data
        held.update((last,))
        yield pd.DataFrame(found, columns=["stream", "seq", "path", "data"])

    return images.groupBy("stream", "path").applyInPandasWithState(step, kind, "data string", "append", GroupStateTimeout.NoTimeout)


def leases(requests: DataFrame, most: int = 1) -> DataFrame:
    """``pool, seq, lease, kind, accepted``: requests folded in order. ``requests``: ``pool, seq, at double, kind, lease, model, ttl double``.

    A lease is accepted when fewer than ``most`` live ones are held and all are of its model; expired ones go first. A pool's
    requests come in a sorted stream; what is held of it are its live leases, ``most`` at most.
    """
    columns = ["pool", "seq", "at", "kind", "lease", "model", "ttl"]

    def decided(seq: int, at: float, kind: str, lease: str, model: str, ttl: float | None, live: dict[str, tuple]) -> bool:
        for name in [k for k, v in live.items() if v[1] is not None and v[1] <= at]:
            del live[name]
        if kind == "release":
            return live.pop(lease, None) is not None
        fits = lease not in live and len(live) < most and all(held == model for held, _ in live.values())
        if fits:
            live[lease] = model, at + ttl if ttl and ttl > 0 else None
        return fits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, live = None, {}
        for batch in batches:
            values = [column.to_pylist() for column in batch.columns]
            accepted = []
            for pool, *request in zip(*values, strict=True):
                if pool != last:
                    last, live = pool, {}
                accepted.append(decided(*request, live))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 4, 3)), pa.array(accepted, pa.bool_())], ["pool", "seq", "lease", "kind", "accepted"])

    given = requests.select(F.col("pool").cast("string"), *(F.col(c) for c in columns[1:]))
    return given.repartition("pool").sortWithinPartitions("pool", "seq").mapInArrow(run, "pool string, seq long, lease string, kind string, accepted boolean")


def heartbeats(events: DataFrame, idle: float = 20.0) -> DataFrame:
    """``stream, at``: when a stream that began at 0 is told to be silent, every ``idle`` seconds until its first text, or else its last event.

    ``events``: ``stream, at double, has_text``. Events without text don't put a beat off.
    """
    end = F.coalesce(F.min(F.when(F.col("has_text"), F.col("at"))), F.max("at"))
    beats = events.groupBy("stream").agg(F.floor(end / idle).cast("int").alias("n")).filter("n > 0")
    return beats.select("stream", F.explode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: k * idle)).alias("at"))


def guarded(snapshots_: DataFrame, key: str, order: str, text: Column) -> DataFrame:
    """``key, order``: the first snapshot of a stream that repeats itself or shows a decoder's trace, where a run is stopped."""
    from ..functions.text import structural_artifact
    from ..operators.repetition import ngram_runs

    whole = snapshots_.withColumn("_id", F.struct(key, order))
    looped = ngram_runs(whole, "_id", text).select("_id").distinct().select("_id.*")
    traced = snapshots_.filter(structural_artifact(text).isNotNull()).select(key, order)
    return looped.unionByName(traced).groupBy(key).agg(F.min(order).alias(order))
