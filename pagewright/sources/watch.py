"""Watching a folder: each (path, time, size) is worked on until it was finished once; failures come again on the next tick.

What is finished is a ledger, a table in a store that Spark writes, so a tick is an anti-join of a listing with it, the
listing is Spark's own over any of its stores, and what a stream has to remember is the number of its tick.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .files import discover, matching

#: Seconds between ticks, at least.
LEAST_INTERVAL = 0.5
MARK = ["path", "modificationTime", "length"]
log = logging.getLogger(__name__)


def unfinished(spark: SparkSession, folder: str, ledger: str, recursive: bool = False) -> DataFrame:
    """``path, modificationTime, length`` of the files that the ledger doesn't hold as they are now; a changed file is another."""
    files = discover(spark, folder, recursive)
    if not matching(spark, f"{ledger}/*"):
        return files
    done = spark.read.schema("path string, modificationTime timestamp, length long").parquet(ledger)
    return files.join(done, MARK, "left_anti")


def tick(spark: SparkSession, folder: str, ledger: str, work: Callable[[DataFrame], DataFrame], recursive: bool = False) -> tuple[int, int]:
    """Give ``work`` the unfinished files; numbers of files that it finished and that failed.

    ``work`` takes ``path, modificationTime, length`` and gives them with ``error string``, null for what is finished. Files that it
    leaves out, or all if it raises, are unfinished. Outcomes are in the ledger before the next tick lists files; a tick that
    dies between the work and the ledger does the work again, so outputs are meant to be replaced by name.
    """
    fresh = unfinished(spark, folder, ledger, recursive)
    try:
        outcome = work(fresh).select(*MARK, F.col("error").cast("string").alias("error")).persist()
        try:
            counts = {r.failed: r.n for r in outcome.groupBy(F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n")).collect()}
            if counts.get(False):
                outcome.filter("error IS NULL").select(*MARK).write.mode("append").parquet(ledger)
        finally:
            outcome.unpersist()
    except Exception:  # one bad tick doesn't end the watch
        log.exception("a tick over %s failed", folder)
        return 0, fresh.count()
    return counts.get(False, 0), counts.get(True, 0)


def watch(spark: SparkSession, folder: str, ledger: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], recursive: bool = False, once: bool = False, interval: float = 2.0) -> StreamingQuery | None:
    """``tick`` every ``interval`` seconds, as a streaming query; with ``once`` a single tick, and no query.

    The stream's source is a clock of Spark's that counts its ticks; ``checkpoint`` holds that count.
    """
    if once:
        tick(spark, folder, ledger, work, recursive)
        return None
    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    each = clock.writeStream.foreachBatch(lambda _, number: tick(spark, folder, ledger, work, recursive) and None)
    return each.option("checkpointLocation", checkpoint).trigger(processingTime=f"{round(max(interval, LEAST_INTERVAL) * 1000)} milliseconds").start()
