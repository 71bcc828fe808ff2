"""Rows whose key may be among given keys, by a Bloom filter of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits of a filter: 8 MB whatever the number of keys, so it can be broadcast.
WORDS = 1 << 20


def marked(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """``_may``: whether a row's column may be in keys; never false where it is."""
    word, bit = F.pmod(F.xxhash64(column), F.lit(WORDS)), F.expr(f"shiftleft(1L, pmod(hash({column}), 64))")
    bloom = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    found = rows.withColumn("_word", word).join(F.broadcast(bloom), "_word", "left")
    return found.withColumn("_may", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_bits")


def among(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows whose column may be in keys: all of those, and few others while keys are fewer than some ten millions."""
    return marked(rows, keys, column).filter("_may").drop("_may")
