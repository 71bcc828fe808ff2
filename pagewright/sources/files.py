"""Files by extension, framed logs, sidecars, exports, and model backends."""

from __future__ import annotations

import json
import struct
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import from_base64, is_safe_path
from .named_files import NamedFiles
from .publish import publish

# The extensions that are taken in.
EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff", "doc", "docx", "ppt", "pptx", "xls", "xlsx")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def discover(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """``path, modificationTime, length`` of files of known extensions; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", "modificationTime", "length").filter(extension(F.col("path")).isin(*EXTENSIONS))


def within(files: DataFrame, most: int) -> DataFrame:
    """Files of ``discover`` that hold something and no more than ``most`` bytes."""
    return files.filter((F.col("length") > 0) & (F.col("length") <= most))


def read_settings(spark: SparkSession, path: str) -> dict:
    """The object of a JSON file; empty where the file is missing, broken or no object. A mark of byte order is passed over."""
    if not matching(spark, path):
        return {}
    raw = spark.read.format("binaryFile").load(path).select("content").first()
    try:
        found = json.loads(bytes(raw.content).decode("utf-8-sig")) if raw else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, as a published version: readers (``publish.read``) see all of it or all of the one before."""
    publish(df.sparkSession, path, df.write.json)


def write_markdown(docs: DataFrame, folder: str, key: str, markdown: str) -> None:
    """A folder of Markdown for each key, as a published version."""
    named = docs.select(F.col(key).cast("string").alias("id"), F.col(markdown).alias("value"))
    publish(docs.sparkSession, folder, named.write.partitionBy("id").option("lineSep", "\n").text)


def file_kind(content: Column, given: Column) -> Column:
    """0 for a PDF by its first bytes or their base64, else 1; a given kind wins."""
    text = content.cast("string")
    return F.coalesce(given, F.when(text.startswith("%PDF-") | text.startswith("JVBERi0"), 0).otherwise(1))


def matching(spark: SparkSession, pattern: str) -> bool:
    """Whether a path of a store that Spark reads matches."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(target.getFileSystem(conf).globStatus(target))


def read_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """``id`` and the fields of each task's summary, or of the task itself where it has none; broken files are left out."""
    kind = "id string, name string, status string, updatedAt string, createdAt string, pageCount int, _corrupt_record string"

    def read(name: str) -> DataFrame:
        files = spark.read.schema(kind).option("multiLine", "true").option("mode", "PERMISSIVE").json(f"{folder}/*/{name}.json")
        return files.filter("_corrupt_record IS NULL AND id IS NOT NULL").drop("_corrupt_record")

    tasks = read("task")
    if not matching(spark, f"{folder}/*/summary.json"):
        return tasks
    summaries = read("summary")
    return summaries.unionByName(tasks.join(summaries.select("id"), "id", "left_anti"))


def framed_log(logs: DataFrame, key: str, column: str) -> DataFrame:
    """``key, text`` of a log in frames: eight bytes of head, the last four the length, big-endian."""

    @F.arrow_udf("string")
    def decoded(raw: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unframed(x) for x in raw.to_pylist()], pa.string())

    return logs.select(key, decoded(F.col(column)).alias("text"))


def unframed(raw: bytes) -> str:
    parts, at = [], 0
    while at + 8 <= len(raw):
        (size,) = struct.unpack_from(">I", raw, at + 4)
        parts.append(raw[at + 8 : at + 8 + size])
        at += 8 + size
    return (b"".join(parts) if parts else raw).decode("utf-8", "replace")


def write_split(tasks: DataFrame, folder: str, heavy: list[str], key: str = "id") -> None:
    """Metadata and heavy columns as two tables by key, ``tasks`` and ``results``, published together; the second is only read for details."""

    def both(at: str) -> None:
        tasks.drop(*heavy).write.parquet(f"{at}/tasks")
        tasks.select(key, *heavy).write.parquet(f"{at}/results")

    publish(tasks.sparkSession, folder, both)


def comparison_report(runs: DataFrame) -> DataFrame:
    """One Markdown table of runs, ordered by file and model: a report for people, so one row."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "file", "model", "status", F.col("seconds").cast("string"), F.col("characters").cast("string")), F.lit(" |"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("file", "model", line.alias("line")))), lambda e: e["line"])
    head = "| file | model | status | seconds | characters |\n| --- | --- | --- | --- | --- |\n"
    return runs.agg(F.concat(F.lit(head), F.array_join(rows, "\n")).alias("markdown"))


class PageBackends:
    """Named functions from page rows to raw text; a model is one of them. ``echo`` gives back the text it is given.

    A backend is made by its factory once a task, so that a model is loaded once, and what it gives goes through the
    steps that all backends share and then through its own. A page that fails has its error and takes no other with it.
    """

    def __init__(self, *shared) -> None:
        self.shared = shared
        self.factories = {"echo": (lambda: lambda pages: pages.assign(raw=pages["text"].fillna("")), (), 0)}

    def register(self, name: str, runner) -> None:
        self.register_factory(name, lambda: runner)

    def register_factory(self, name: str, make, *steps) -> None:
        """``make`` gives a function of a batch of pages that adds ``raw``; ``steps`` are functions of one raw text."""
        self.factories[name] = (make, steps, 0)

    def register_calls(self, name: str, make, *steps, at_once: int = 1) -> None:
        """``make`` gives a function of one page (its text) to raw text, such as a request to a server; a task makes ``at_once`` calls at a time."""
        self.factories[name] = (make, steps, max(1, at_once))

    def run(self, pages: DataFrame, name: str) -> DataFrame:
        """``doc_id, page, raw, error``: one of the last two is null. Pages stay in order within a partition.

        Calls at a time are ``at_once`` in each task, times the tasks that run; no more pages than that are held beyond a batch.
        """
        (make, steps, at_once), shared = self.factories[name], self.shared

        def finished(done: pd.DataFrame) -> pd.DataFrame:
            for step in (*shared, *steps):
                done["raw"] = done["raw"].map(step)
            return done.assign(error=None)[["doc_id", "page", "raw", "error"]]

        def together(runner: Callable, batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
            """A batch at once; where that fails its halves, so that only pages that fail alone have an error."""
            try:
                yield finished(runner(batch))
            except Exception as error:
                if len(batch) == 1:
                    yield batch.assign(raw=None, error=str(error))[["doc_id", "page", "raw", "error"]]
                    return
                half = len(batch) // 2
                yield from together(runner, batch.iloc[:half])
                yield from together(runner, batch.iloc[half:])

        def apart(runner: Callable, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def told(doc_id: int, page: int, job) -> tuple:
                try:
                    raw = job.result()
                    for step in (*shared, *steps):
                        raw = step(raw)
                    return doc_id, page, raw, None
                except Exception as error:
                    return doc_id, page, None, str(error)

            with ThreadPoolExecutor(at_once) as pool:
                waiting: deque = deque()
                for batch in batches:
                    rows = []
                    for row in batch.itertuples():
                        waiting.append((row.doc_id, row.page, pool.submit(runner, row.text)))
                        if len(waiting) > at_once:
                            rows.append(told(*waiting.popleft()))
                    yield pd.DataFrame(rows, columns=["doc_id", "page", "raw", "error"])
                yield pd.DataFrame([told(*job) for job in waiting], columns=["doc_id", "page", "raw", "error"])

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            runner = make()
            if at_once:
                yield from apart(runner, batches)
            else:
                for batch in batches:
                    yield from together(runner, batch)

        return pages.select("doc_id", "page", "text").mapInPandas(call, "doc_id long, page int, raw string, error string")


def export(results: DataFrame, folder: str, stem: str = "stem", append: bool = False) -> None:
    """``stem.md``, ``stem.json`` and ``stem.assets/...`` of each row, as files of these names; all of a job's or none.

    ``results``: ``stem, markdown, json, images map of paths to base64``. Images with an unsafe path or broken data are left out. The
    Markdown names the others by their new places, in links and in ``src`` attributes. A stem that occurs twice raises.
    """
    spark = results.sparkSession
    spark.dataSource.register(NamedFiles)
    twice = results.groupBy(stem).agg(F.count("*").alias("n")).filter("n > 1").select(stem).first()
    if twice:
        raise ValueError(f"stem {twice[0]!r} occurs more than once")
    fine = F.map_filter("images", lambda path, data: is_safe_path(path) & from_base64(data).isNotNull())
    rows = results.select(F.col(stem).alias("stem"), "markdown", "json", F.coalesce(fine, F.create_map().cast("map<string,string>")).alias("images"))

    def asset(path: Column) -> Column:
        return F.concat("stem", F.lit(".assets/"), F.replace(path, F.lit("\\"), F.lit("/")))

    def placed(text: Column, path: Column) -> Column:
        at = asset(path)
        for before, after in (("](", ")"), ('src="', '"'), ("src='", "'")):
            text = F.replace(text, F.concat(F.lit(before), path, F.lit(after)), F.concat(F.lit(before), at, F.lit(after)))
        return text

    markdown = F.aggregate(F.map_keys("images"), F.col("markdown"), placed)
    own = F.array(*[F.struct(F.concat("stem", F.lit(f".{kind}")).alias("name"), F.coalesce(text, F.lit("")).cast("binary").alias("content")) for kind, text in (("md", markdown), ("json", F.col("json")))])
    assets = F.transform(F.map_entries("images"), lambda e: F.struct(asset(e["key"]).alias("name"), from_base64(e["value"]).alias("content")))
    files = rows.select(F.explode(F.concat(own, assets)).alias("file")).select("file.*")
    files.write.format("named_files").mode("append" if append else "overwrite").save(folder)


def newest(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``path, text`` of the newest file of a pattern that isn't blank."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    texts = files.select("path", "modificationTime", F.col("content").cast("string").alias("text"))
    return texts.filter(F.col("text").rlike(r"\S")).orderBy(F.desc("modificationTime"), "path").limit(1).select("path", "text")
