"""Sinks that replace at once, files of their own names, watched folders, calls of backends."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from pagewright.sources import files, publish, watch
from pagewright.sources.named_files import NamedFiles


def rows_at(spark, folder, form="json"):
    return sorted(map(tuple, publish.read(spark, folder, form).select("id", "v").collect()))


def failing(spark):
    """Rows of which some are written before a task raises."""
    return spark.range(1000, numPartitions=4).select("id", F.when(F.col("id") == 900, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("v"))


def test_a_failing_write_leaves_the_old_rows(spark, tmp_path):
    folder = str(tmp_path / "out")
    with pytest.raises(Exception, match="broken"):
        files.write_json(failing(spark), folder)
    assert publish.current(spark, folder) is None
    with pytest.raises(FileNotFoundError):
        publish.read(spark, folder, "json")
    files.write_json(spark.createDataFrame([(1, 1), (2, 2)], "id long, v long"), folder)
    for _ in range(2):
        with pytest.raises(Exception, match="broken"):
            files.write_json(failing(spark), folder)
        assert rows_at(spark, folder) == [(1, 1), (2, 2)]
    assert len([x for x in os.listdir(folder) if x.startswith("version-")]) == 1


def test_a_reader_sees_one_version(spark, tmp_path):
    folder = str(tmp_path / "out")
    of = lambda n: spark.createDataFrame([(i, n) for i in range(50)], "id long, v long")
    files.write_json(of(0), folder)
    began = publish.read(spark, folder, "json", schema="id long, v long")
    seen = []

    def halfway(at):
        of(1).write.json(at)
        seen.append(rows_at(spark, folder))  # the new rows are written, and not yet published

    publish.publish(spark, folder, halfway)
    assert seen == [[(i, 0) for i in range(50)]]
    assert rows_at(spark, folder) == [(i, 1) for i in range(50)]
    assert {r.v for r in began.collect()} == {0}  # its version is kept for one more
    for n in range(2, 6):
        files.write_json(of(n), folder)
        assert {r[1] for r in rows_at(spark, folder)} == {n}
    assert len([x for x in os.listdir(folder) if x.startswith("version-")]) == 2


def test_tables_of_one_version_change_together(spark, tmp_path):
    folder = str(tmp_path)
    files.write_split(spark.createDataFrame([("a", "n", "old")], "id string, name string, markdown string"), folder, ["markdown"])
    with pytest.raises(Exception, match="broken"):
        files.write_split(spark.createDataFrame([("b", "n")], "id string, name string").withColumn("markdown", F.raise_error(F.lit("broken")).cast("string")), folder, ["markdown"])
    assert publish.read(spark, folder, "parquet", "tasks").first().id == "a" and publish.read(spark, folder, "parquet", "results").first().markdown == "old"


def found(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_export_as_files(spark, tmp_path):
    folder = tmp_path / "e"
    kind = "stem string, markdown string, json string, images map<string,string>"
    first = [("a.m", "![x](img/x.png) <img src=\"img/x.png\"> ](other)", "{}", {"img/x.png": "aGk=", "../evil": "aGk=", "bad.png": "%%%"}), ("b.m", "# ü", None, None)]
    files.export(spark.createDataFrame(first, kind).repartition(2), str(folder))
    want = {"a.m.md": b"![x](a.m.assets/img/x.png) <img src=\"a.m.assets/img/x.png\"> ](other)", "a.m.json": b"{}", "a.m.assets/img/x.png": b"hi", "b.m.md": "# ü".encode(), "b.m.json": b""}
    assert found(folder) == want
    files.export(spark.createDataFrame([("c.m", "c", "[]", {}), ("b.m", "new", "1", {})], kind), str(folder), append=True)
    assert found(folder) == want | {"c.m.md": b"c", "c.m.json": b"[]", "b.m.md": b"new", "b.m.json": b"1"}
    with pytest.raises(ValueError, match="more than once"):
        files.export(spark.createDataFrame([("c", "", "", {}), ("c", "", "", {})], kind), str(folder))
    files.export(spark.createDataFrame([("d", "d", "{}", {})], kind), str(folder))
    assert found(folder) == {"d.md": b"d", "d.json": b"{}"}
    assert os.listdir(tmp_path) == ["e"]


def test_an_aborted_export_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(NamedFiles)
    folder = tmp_path / "e"
    rows = spark.range(400, numPartitions=4).select(F.concat("id", F.lit(".md")).alias("name"), F.when(F.col("id") == 390, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    for mode in ("overwrite", "append"):
        with pytest.raises(Exception, match="broken"):
            rows.write.format("named_files").mode(mode).save(str(folder))
        assert os.listdir(tmp_path) == []
    rows.filter("id < 3").write.format("named_files").mode("overwrite").save(str(folder))
    with pytest.raises(Exception, match="broken"):
        rows.write.format("named_files").mode("overwrite").save(str(folder))
    assert sorted(found(folder)) == ["0.md", "1.md", "2.md"]
    for name in ("../x", "/x", "a//b", "", "a\\b"):
        with pytest.raises(Exception, match="not a name below"):
            spark.createDataFrame([(name, b"")], "name string, content binary").write.format("named_files").mode("overwrite").save(str(folder))
    assert sorted(found(folder)) == ["0.md", "1.md", "2.md"]


class Folder:
    """A watched folder, and work that fails on files whose content begins with ``bad``."""

    def __init__(self, spark, root):
        self.spark, self.watched, self.ledger, self.done = spark, root / "in", str(root / "ledger"), []
        self.watched.mkdir()

    def put(self, name, content, at):
        (self.watched / name).write_bytes(content)
        os.utime(self.watched / name, (at, at))

    def work(self, fresh):
        texts = self.spark.read.format("binaryFile").load(str(self.watched)).select("path", F.col("content").cast("string").alias("text"))
        out = fresh.join(texts, "path").withColumn("error", F.when(F.startswith("text", F.lit("bad")), F.lit("cannot be read")))
        self.done += sorted(os.path.basename(r.path) for r in out.filter("error IS NULL").select("path").collect())
        return out

    def tick(self):
        self.done.clear()
        counts = watch.tick(self.spark, str(self.watched), self.ledger, self.work)
        return self.done.copy(), counts


def test_failures_come_again_and_finished_files_do_not(spark, tmp_path):
    folder = Folder(spark, tmp_path)
    assert folder.tick() == ([], (0, 0))
    for name, content in (("a.pdf", b"fine"), ("b.PNG", b"bad"), ("skip.txt", b"fine")):
        folder.put(name, content, 1000)
    assert folder.tick() == (["a.pdf"], (1, 1))
    assert folder.tick() == ([], (0, 1))
    folder.put("b.PNG", b"now fine", 1000)
    assert folder.tick() == (["b.PNG"], (1, 0))
    assert folder.tick() == ([], (0, 0))
    folder.put("a.pdf", b"fine", 2000)  # touched: another file
    assert folder.tick() == (["a.pdf"], (1, 0))
    folder.put("c.pdf", b"x", 1)  # older than all that was seen
    assert watch.tick(spark, str(folder.watched), folder.ledger, lambda fresh: 1 / 0) == (0, 1)
    assert folder.tick() == (["c.pdf"], (1, 0))
    assert watch.watch(spark, str(folder.watched), folder.ledger, "", folder.work, once=True) is None


def test_a_watch_ticks_on(spark, tmp_path):
    folder = Folder(spark, tmp_path)
    folder.put("a.pdf", b"fine", 1000)
    query = watch.watch(spark, str(folder.watched), folder.ledger, str(tmp_path / "c"), folder.work, interval=0.1)
    try:
        def wait(count):
            until = time.time() + 90
            while len(folder.done) < count and time.time() < until and query.isActive:
                time.sleep(0.1)
            return sorted(folder.done)

        assert wait(1) == ["a.pdf"]
        folder.put("b.pdf", b"fine", 1000)
        assert wait(2) == ["a.pdf", "b.pdf"]
    finally:
        query.stop()


def test_only_failing_pages_have_an_error(spark):
    backends = files.PageBackends(str.strip)

    def batch(pages):
        if (pages["text"] == "bad").any():
            raise ValueError("a bad page")
        return pages.assign(raw=pages["text"] + " ")

    backends.register("batch", batch)
    backends.register_calls("calls", lambda: lambda text: 1 / 0 if text == "bad" else text + " ", at_once=3)
    pages = spark.createDataFrame([(1, i, "bad" if i in (3, 17) else f"t{i}") for i in range(40)], "doc_id long, page int, text string").coalesce(1)
    for name, said in (("batch", "a bad page"), ("calls", "division")):
        got = backends.run(pages, name).collect()
        assert [r.page for r in got] == list(range(40))
        assert {r.page for r in got if r.error} == {3, 17} and all(said in r.error and r.raw is None for r in got if r.error)
        assert all(r.raw == f"t{r.page}" for r in got if not r.error)


def test_calls_are_bounded_and_concurrent(spark):
    def make():
        lock, now = threading.Lock(), [0, 0]

        def call(text):
            with lock:
                now[0] += 1
                now[1] = max(now)
            time.sleep(0.01 if int(text) % 3 else 0.05)
            with lock:
                now[0] -= 1
            return str(now[1])

        return call

    backends = files.PageBackends()
    backends.register_calls("slow", make, at_once=4)
    pages = spark.createDataFrame([(1, i, str(i)) for i in range(60)], "doc_id long, page int, text string").coalesce(1)
    got = backends.run(pages, "slow").collect()
    assert [r.page for r in got] == list(range(60)) and max(int(r.raw) for r in got) == 4
