"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, comp`` of every id on an edge: comp is the smallest id that links reach.

    Large-star and small-star rounds alternate until the edges stop changing, each round written to the shared folder.
    Every step aggregates before it joins, so a hub's neighbours never meet in one task; the number of rounds grows with
    the logarithm of the longest path. Nothing is collected but one checksum a round.
    """
    x, y = F.least(a, b).cast("long"), F.greatest(a, b).cast("long")
    now = written(edges.select(y.alias("u"), x.alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        # Large star: neighbours above u go to the smallest of u and its neighbours.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: u and its neighbours below go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, now = now, written(small.filter("u <> v").distinct(), "edges")
        dropped(before)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("comp"))
    return stars.unionByName(roots).groupBy("id").agg(F.min("comp").alias("comp"))
