"""What the operators share: tables in the shared folder, Arrow helpers, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..operators.bloom import among, marked  # noqa: F401  the operators take both from here

#: Rows that leave Python go in batches of about so many bytes.
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset and all runs in one process, as in tests, a local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir is unset; executors need a folder that they share")
        folder = getattr(spark.sparkContext, "_pagewright_folder", None)
        if folder is None:
            folder = spark.sparkContext._pagewright_folder = tempfile.mkdtemp(prefix="pagewright-")
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table from ``written``, when nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches to Python of a few MB, so that a worker's memory doesn't follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def without(rows: DataFrame, gone: DataFrame, column: str, on: list[str]) -> DataFrame:
    """Rows that ``gone`` doesn't hold, by ``on`` (``column`` among them); only rows that it may hold are shuffled."""
    told = marked(rows, gone, column)
    return told.filter("NOT _may").drop("_may").unionByName(told.filter("_may").drop("_may").join(gone.hint("merge"), on, "left_anti").select(*rows.columns))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def text_of(raw: bytes | None) -> str:
    """Null is the empty text; bytes that aren't UTF-8 become U+FFFD."""
    return "" if raw is None else raw.decode("utf-8", "replace")


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches, a slice at a time, so that few Python objects live at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(column.to_pylist() for column in part.columns), strict=True)


def batches_of(rows: Iterable[tuple], schema: pa.Schema, weigh=None, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of ``most`` rows at most, cut earlier when ``weigh`` of the rows sums to BATCH_BYTES."""
    held: list[tuple] = []
    weight = 0

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        weight += weigh(row) if weigh else 0
        if len(held) >= most or weight >= BATCH_BYTES:
            yield batch()
            held, weight = [], 0
    if held:
        yield batch()


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash, remembered for up to ``most`` words."""

    def __init__(self, most: int = 250_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words, in order; of the whole sequence when it is shorter; none of none."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ words[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mixed(out + np.uint64(n))
