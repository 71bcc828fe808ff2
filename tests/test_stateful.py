"""Streams with timers and state, against their batch folds; restarts from a snapshot."""

import json
import random
import re
import time
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.operators import repetition
from pagewright.operators.repetition import LoopDetector, Runs, runs_of
from pagewright.sources import publish
from pagewright.streaming import folds, stateful


@pytest.fixture(scope="module")
def stated(spark):
    for key, value in stateful.ROCKSDB.items():
        spark.conf.set(key, value)
    yield spark
    for key in stateful.ROCKSDB:
        spark.conf.unset(key)


class Run:
    """A query over a folder of JSON files, each file a micro-batch."""

    def __init__(self, spark, root, kind, operator, name, every=None):
        self.spark, self.root, self.kind, self.name, self.count = spark, Path(root) / name, kind, name, 0
        (self.root / "in").mkdir(parents=True)
        self.checkpoint = str(self.root / "c")
        source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(self.root / "in"))
        writer = operator(source).writeStream.format("memory").queryName(name).option("checkpointLocation", self.checkpoint)
        self.query = (writer.trigger(processingTime=every) if every else writer).start()

    def put(self, rows):
        names = [c.split(" ")[0] for c in self.kind.split(", ")]
        self.count += 1
        temporary = self.root / f"{self.count:04d}.json"
        temporary.write_text("\n".join(json.dumps(dict(zip(names, row, strict=True))) for row in rows))
        temporary.rename(self.root / "in" / temporary.name)
        return self

    def taken(self):
        """Whether all files are behind it; a query with timers never has nothing to do."""
        said = self.query.lastProgress
        end = said and said["sources"][0]["endOffset"]
        number = re.search(r"logOffset\D*(\d+)", str(end))
        return number is not None and int(number[1]) >= self.count - 1

    def rows(self):
        return self.until(lambda _: self.taken())

    def until(self, enough, seconds=90):
        end = time.time() + seconds
        while time.time() < end and self.query.isActive:
            found = [tuple(r) for r in self.spark.table(self.name).collect()]
            if enough(found):
                return found
            time.sleep(0.2)
        raise AssertionError((self.query.exception(), [tuple(r) for r in self.spark.table(self.name).collect()]))


EVENTS = "stream string, has_text boolean, ended boolean"


def test_a_silent_stream_beats_with_no_further_event(stated, tmp_path):
    run = Run(stated, tmp_path, EVENTS, lambda x: stateful.heartbeats(x, 1.0), "silent", every="200 milliseconds")
    try:
        run.put([("quiet", False, False), ("talks", True, False), ("ends", False, True)])
        found = run.until(lambda rows: sum(r[0] == "quiet" for r in rows) >= 3)
        own = [r for r in found if r[0] == "quiet"]
        assert [r[1] for r in own] == list(range(1, len(own) + 1)) and all(b[2] - a[2] >= 0.9 for a, b in zip([("", 0, 0.0), *own], own, strict=False))
        assert {r[0] for r in found} == {"quiet"}
        run.put([("quiet", True, False)])
        after = len(run.rows())
        time.sleep(2.5)
        assert stated.table("silent").count() == after
    finally:
        run.query.stop()


REQUESTS = "pool string, seq long, at double, kind string, lease string, model string, ttl double"


def requests(seed=2, pools=3, each=40):
    rng = random.Random(seed)
    rows = []
    for pool in range(pools):
        at = 0.0
        for seq in range(1, each + 1):
            at += rng.random() * 4
            kind = rng.choice(["acquire", "acquire", "release"])
            rows.append((f"p{pool}", seq, round(at, 3), kind, f"l{rng.randrange(6)}", rng.choice(["m", "m", "n"]), rng.choice([None, 500.0, 900.0, 0.0, 3000.0])))
    # Long times to live in the requests' own clock: what runs out there does so long before it would by the wall's.
    return [(p, s, at * 200, k, lease, m, t) for p, s, at, k, lease, m, t in rows]


def test_leases_in_any_order_of_arrival(stated, tmp_path):
    rows = requests()
    want = sorted(map(tuple, folds.leases(stated.createDataFrame(rows, REQUESTS), most=2).collect()))
    assert {r[4] for r in want} == {True, False}
    shuffled = rows + rows[::7]  # some come twice
    random.Random(1).shuffle(shuffled)
    run = Run(stated, tmp_path, REQUESTS, lambda x: stateful.leases(x, most=2), "shuffled")
    try:
        for at in range(0, len(shuffled), 30):
            run.put(shuffled[at : at + 30])
        assert sorted(run.rows()) == want
    finally:
        run.query.stop()


def test_a_lease_expires_without_a_request(stated, tmp_path):
    run = Run(stated, tmp_path, REQUESTS, lambda x: stateful.leases(x, most=1, longest=60.0), "expiring", every="200 milliseconds")
    try:
        run.put([("p", 1, 0.0, "acquire", "a", "m", 2.0), ("q", 1, 0.0, "acquire", "b", "m", None), ("p", 2, 0.5, "acquire", "c", "m", 1.0)])
        found = run.until(lambda rows: any(r[3] == "expired" for r in rows))
        assert sorted(found, key=str) == sorted([("p", 1, "a", "acquire", True), ("p", 2, "c", "acquire", False), ("p", None, "a", "expired", None), ("q", 1, "b", "acquire", True)], key=str)
        run.put([("p", 3, 0.6, "acquire", "d", "n", 0.0), ("q", 2, 0.6, "acquire", "e", "m", 0.0)])
        assert {("p", 3, "d", "acquire", True), ("q", 2, "e", "acquire", False)} <= set(run.until(lambda rows: len(rows) >= 6))
    finally:
        run.query.stop()


def test_restart_from_a_snapshot(stated, tmp_path):
    rows = requests(seed=9)
    want = sorted(map(tuple, folds.leases(stated.createDataFrame(rows, REQUESTS), most=2).collect()))
    early, late = [r for r in rows if r[1] <= 20 or r[1] == 25], [r for r in rows if r[1] > 20 and r[1] != 25]
    first = Run(stated, tmp_path, REQUESTS, lambda x: stateful.leases(x, most=2), "before")
    decided = first.put(early).rows()
    first.query.stop()
    folder = str(tmp_path / "snapshot")
    assert stateful.load_leases(stated, folder).count() == 0
    state = stateful.lease_snapshot(stated, first.checkpoint)
    stateful.save_leases(state, folder)
    kept = stateful.load_leases(stated, folder).collect()
    assert [(r.pool, r.seq) for r in kept if r.part == "waiting"] == [("p0", 25), ("p1", 25), ("p2", 25)]
    assert [(r.pool, r.seq) for r in kept if r.part == "next"] == [(f"p{k}", 21) for k in range(3)] and any(r.part == "live" for r in kept)
    lines = [json.loads(x) for p in Path(publish.current(stated, folder)).glob("*.json") for x in p.read_text().splitlines()]
    key = [(x["pool"], x["part"], x.get("lease", ""), x.get("seq", 0)) for x in lines]
    assert key == sorted(key) and len(key) == len(kept)
    second = Run(stated, tmp_path, REQUESTS, lambda x: stateful.leases(x, most=2, start=stateful.load_leases(stated, folder)), "after")
    try:
        assert sorted(decided + second.put(late).rows()) == want
    finally:
        second.query.stop()


def test_a_broken_snapshot_raises(stated, tmp_path):
    sound = {"pool": "p", "part": "live", "lease": "a", "model": "m"}
    for k, rows in enumerate(([sound, sound], [sound | {"model": None}], [{"part": "next", "seq": 1}], [sound | {"part": "odd"}], [{"pool": "p", "part": "next"}])):
        folder = str(tmp_path / str(k))
        publish.publish(stated, folder, stated.createDataFrame([(json.dumps(r),) for r in rows], "value string").write.text)
        with pytest.raises(ValueError, match="lease snapshot"):
            stateful.load_leases(stated, folder)
    folder = str(tmp_path / "text")
    publish.publish(stated, folder, stated.createDataFrame([("{broken",)], "value string").write.text)
    with pytest.raises(ValueError, match="1 broken"):
        stateful.load_leases(stated, folder)


GENERATED = "stream string, attempt int, seq long, kind string, text string, max_tokens long"
FINE = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))


def deltas(stream, attempt, text, size, start=1):
    return [(stream, attempt, start + k, "delta", text[at : at + size], None) for k, at in enumerate(range(0, len(text), size))]


def test_guard_is_the_batch_rule_on_documents_cut_into_deltas(stated, tmp_path):
    docs = stated.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 1500).alias("text")).limit(25).collect()
    rng = random.Random(4)
    texts = {str(r.doc_id): (r.text or "") + (" so it goes on and on," * rng.randrange(2, 9) if r.doc_id % 2 else "") for r in docs}
    texts |= {"crlf": FINE + "\r\nagain and again it says\r\n" * 6, "numbers": "1 2 3 4 5 " * 60, "markup": "td tr td th " * 60}
    rows = [row for stream, text in texts.items() for row in deltas(stream, 1, text, 37)]
    prefixes = [(f"{s}:{seq}", texts[s][: 37 * seq]) for s, _, seq, *_ in rows]
    found = repetition.ngram_runs(stated.createDataFrame(prefixes, "id string, text string"), "id", F.col("text")).groupBy("id").agg(F.min(F.struct("n", "gram")).alias("g")).collect()
    want = {}
    for r in found:
        stream, seq = r.id.rsplit(":", 1)
        if stream not in want or int(seq) < want[stream][0]:
            want[stream] = int(seq), r.g.gram
    assert {"crlf"} < set(want) and not {"numbers", "markup"} & set(want) and len(want) < len(texts)
    random.Random(5).shuffle(rows)
    run = Run(stated, tmp_path, GENERATED, lambda x: stateful.guard(x, traces=False), "guarded")
    try:
        for at in range(0, len(rows), 400):
            run.put(rows[at : at + 400])
        got = run.rows()
    finally:
        run.query.stop()
    assert {r[0]: (r[2], r[4]) for r in got} == want and {r[3] for r in got} == {"retry"}


def test_guard_has_three_attempts(stated, tmp_path):
    loop = FINE + " the same phrase again" * 8
    error = "This model's maximum context length of 1000 tokens. You requested 300 tokens from the input messages and 900 tokens for the completion"
    rows = [*deltas("loops", 1, loop, 50), *deltas("loops", 2, loop, 50)]
    rows += [("mended", 1, 1, "error", error, 900), *deltas("mended", 2, loop, 50), *deltas("mended", 3, FINE, 50), ("mended", 3, 10, "end", None, None)]
    rows += [("down", 1, 1, "error", "no such model", None), ("twice", 1, 1, "error", error, 900), ("twice", 2, 1, "error", error, None)]
    rows += [("trace", 1, 1, "delta", "text [1, 2, 3, 4] text [1, 2, 3, 4]\nend if ", None), ("trace", 1, 2, "delta", "end while\n", None), ("fine", 1, 1, "delta", FINE, None), ("fine", 1, 2, "end", None, None)]
    assert len(deltas("", 3, FINE, 50)) == 9
    run = Run(stated, tmp_path, GENERATED, stateful.guard, "attempts")
    try:
        for at in range(0, len(rows), 9):
            run.put(rows[::-1][at : at + 9])
        got = {}
        for stream, attempt, _, action, reason, tokens in sorted(run.rows(), key=lambda r: (r[0], r[1])):
            got.setdefault(stream, []).append((attempt, action, tokens, (reason or "")[:9]))
    finally:
        run.query.stop()
    assert got == {
        "loops": [(1, "retry", None, "again the"), (2, "error", None, "again the")],
        "mended": [(1, "retry", 572, "This mode"), (2, "retry", None, "again the"), (3, "final", None, "")],
        "down": [(1, "error", None, "no such m")],
        "twice": [(1, "retry", 572, "This mode"), (2, "error", None, "This mode")],
        "trace": [(1, "retry", None, "layout co")],
        "fine": [(1, "final", None, "")],
    }


PIECES = ["alpha", "beta", "td", "12", "gamma-ray", "x", "Kelvin", "İstan", "the", "e9f", " ", " ", "\n", "\r\n", "\r", ",", "-"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=120), st.lists(st.sampled_from(PIECES), min_size=3, max_size=9), st.integers(0, 14), st.sampled_from([250, 400, 4000]), st.randoms())
def test_detector_is_the_whole_rule_at_each_delta(head, unit, times, tail, rng):
    rule, text = Runs(tail=tail), " ".join(head) + " " + " ".join(unit * times)
    detector, at = LoopDetector(rule), 0
    while at < len(text):
        step = rng.choice([1, 3, 9, 40])
        got = detector.feed(text[at : at + step])
        at += step
        want = runs_of(text[:at], rule)
        assert got == (min((n, gram) for n, gram, *_ in want) if want else None)
        if want:
            break
        if rng.random() < 0.3:
            detector = LoopDetector.of(detector.state(), rule)


def test_first_snapshot_that_repeats_itself(spark):
    loop = FINE + " the same phrase again" * 8
    rows = [("loop", 1, FINE), ("loop", 2, loop), ("loop", 3, loop + " more"), ("trace", 1, "text [1, 2, 3, 4] text [1, 2, 3, 4]\nend if end while"), ("ok", 1, FINE)]
    found = folds.guarded(spark.createDataFrame(rows, "stream string, seq long, text string"), "stream", "seq", F.col("text"))
    assert sorted(map(tuple, found.collect())) == [("loop", 2), ("trace", 1)]


def test_batch_beats(spark):
    beats = [("a", 50.0, False), ("b", 5.0, False), ("b", 30.0, True), ("a", 99.0, True), ("b", 99.0, False), ("a", 200.0, False), ("c", 45.0, False)]
    got = sorted(map(tuple, folds.heartbeats(spark.createDataFrame(beats, "stream string, at double, has_text boolean")).collect()))
    assert got == [("a", 20.0), ("a", 40.0), ("a", 60.0), ("a", 80.0), ("b", 20.0), ("c", 20.0), ("c", 40.0)]
