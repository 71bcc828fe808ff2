"""Results that replace older ones in one step: versions beside each other, and a pointer that names the one to read.

A version is a folder of its own below the published one. It is written whole, then a small file that names it takes the
place of the pointer by a rename that overwrites, which a file system does at once. A writer that fails leaves the
pointer and the older rows alone; a reader asks the pointer once and then reads files that nobody changes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _store(spark: SparkSession, path: str) -> tuple:
    """Hadoop's path, its file system, and a function that makes paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = make(path)
    return root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _point(spark: SparkSession, folder: str, version: str) -> None:
    """Let the pointer name a version: a temporary file, renamed over the old pointer."""
    root, fs, make = _store(spark, folder)
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    beside, target = make(root, f".{POINTER}-{uuid.uuid4().hex}"), make(root, POINTER)
    out = fs.create(beside, True)
    out.write(bytearray(version.encode()))
    out.hsync()
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    try:
        context.rename(fs.makeQualified(beside), fs.makeQualified(target), how)
    except Exception:
        fs.delete(beside, False)
        raise


def current(spark: SparkSession, folder: str) -> str | None:
    """The folder of the published version; None where nothing was published."""
    root, fs, make = _store(spark, folder)
    pointer = make(root, POINTER)
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        name = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return f"{folder.rstrip('/')}/{name}"


def publish(spark: SparkSession, folder: str, write: Callable[[str], None], keep: int = 1) -> str:
    """Call ``write`` with a new folder and, when it returns, turn readers to that. Gives the folder.

    If ``write`` raises, what it wrote goes and all else stays. ``keep`` older versions stay for readers that have begun; a
    folder of one writer at a time is meant, of several the last to finish wins.
    """
    root, fs, make = _store(spark, folder)
    before = current(spark, folder)
    fs.mkdirs(root)
    older = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("version-")]
    version = f"version-{len(older) and max(int(name.split('-')[1]) for name in older) + 1:012d}-{uuid.uuid4().hex}"
    target = f"{folder.rstrip('/')}/{version}"
    try:
        write(target)
        _point(spark, folder, version)
    except Exception:
        fs.delete(make(target), True)
        raise
    spared = {name for name in sorted(older)[-keep:]} if keep else set()
    spared |= {before.rpartition("/")[2]} if before and keep else set()
    for name in older:
        if name not in spared:
            fs.delete(make(root, name), True)
    return target


def read(spark: SparkSession, folder: str, form: str, part: str = "", schema: str | None = None, **options) -> DataFrame:
    """The rows of the published version, or of a table in it; a folder without one raises."""
    at = current(spark, folder)
    if at is None:
        raise FileNotFoundError(f"nothing is published at {folder}")
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema else reader).load(f"{at}/{part}" if part else at)
