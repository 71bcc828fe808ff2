"""Mixing sources to target weights: weighted sampling without replacement by exponential keys, to budgets of words.

A document's key is an exponential variate divided by its quality weight; the smallest keys of a source are then a sample
in which each next document is drawn in proportion to its weight. Documents are sorted by key within their source and
their sizes summed along that order. A source whose target is so many times its size gives all its documents as often as
that goes whole, and the remainder from the front of the order.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

#: Weights of the sources in their order, repeating; how often a document may be taken; names the drawing.
WEIGHTS, MOST_EPOCHS, SEED = (1, 2, 3), 3, 11
#: Quality weights of documents by their label, and of those without one.
QUALITY, UNLABELLED = {0: 1.0, 1: 3.0}, 2.0
#: ASCII white space; words are what is between.
BLANKS = " \t\n\x0b\x0c\r"
EXACT = "decimal(38,0)"


def words(text: Column) -> Column:
    """The number of runs of other characters than ASCII white space, by one replacement and no array; 0 of null."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.rtrim(marks, F.lit(BLANKS))), F.lit(0)).cast("long")


def exponential(key: Column, seed: int) -> Column:
    """An exponential variate of a key: minus the logarithm of 52 bits of a digest, as a number between 0 and 1."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52)))


def running(rows: DataFrame, group: list[str], order: list[str], value: Column, facts: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` (long) over the rows of its group that come before in ``order``.

    Rows go to ranges of (group, order), so a group of any size is spread; sums of a group within each range are few rows,
    as many as there are ranges and groups, and tell what came before a range. ``order`` must tell rows apart. ``facts`` are
    columns of each group; they come in with those sums, so no large group meets one row of theirs.
    """
    ranges = rows.withColumn("_value", value.cast("long")).repartitionByRange(partitions(rows.sparkSession), *group, *order)
    ranges = written(ranges.withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("_range", *group).agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    more = []
    if facts is not None:
        sums = sums.join(facts.hint("merge"), group)
        more = [c for c in facts.columns if c not in group]
    own = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = ranges.join(sums.hint("merge"), ["_range", *group])
    before = F.col("_base") + F.coalesce(F.sum("_value").over(own), F.lit(0))
    return met.withColumn("before", before).select(*rows.columns, *more, "before")


def sources_of(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """``none, source, source_size, weight`` of each source, by code point, null last; weights repeat along that order."""
    found = written(sizes.groupBy("none", "source").agg(F.sum("size").alias("source_size")), "sources")
    placed = running(found, [], ["none", "source"], F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("before", F.lit(len(weights))) + 1).cast("int"))
    return written(placed.select("none", "source", "source_size", weight.cast("long").alias("weight")), "sources")


def targets(sources: DataFrame, most: int) -> DataFrame:
    """``sources`` with ``target``: shares of all sizes by weight, at most ``most`` times a source's size, the excess reshared.

    A level L is sought at which the sum of min(most * size, L * weight) is the sum of all sizes. Each round stops the
    sources that are above at the present level and raises it for the others: Newton's method on a concave function of
    straight pieces, whose rounds grow with the logarithm of the sizes. A round gives the driver three numbers.
    """
    whole = sources.agg(F.sum(F.col("source_size").cast(EXACT)), F.sum(F.col("weight").cast(EXACT))).first()
    total, weight = (int(v or 0) for v in whole)
    rest, share, known = total, weight, -1
    number = lambda n: F.lit(Decimal(n)).cast(EXACT)
    most_of = F.col("source_size").cast(EXACT) * most

    def above() -> Column:
        return most_of * number(share) < F.col("weight").cast(EXACT) * number(rest)

    while True:
        stopped, size, weights = sources.filter(above()).agg(F.count("*"), F.sum(most_of), F.sum(F.col("weight").cast(EXACT))).first()
        if stopped == known:
            break
        known, rest, share = stopped, total - int(size or 0), weight - int(weights or 0)
    level = (F.col("weight").cast(EXACT) * number(rest)).cast("double") / F.lit(float(max(1, share)))
    return sources.withColumn("target", F.when(above(), most_of.cast("double")).otherwise(level))


def plan(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id_col, size, source_size, target, taken, copies, source, print`` for each row of docs.

    ``quality``: ``id_col, weight double`` above 0, one row an id at most (of several the largest counts); documents without
    one weigh UNLABELLED. ``copies`` is how often the mix takes a document, ``taken`` that times its size in words; ``print``
    is a hash of its text. Of a source's order whole documents are taken while that brings the sum nearer to its target, so it
    misses the target by half the size of one of its documents at most. The drawing depends on ids and ``seed`` alone.

    Null text and texts without words have size 0. A null source is a source, the last. Rows with null or repeated ids each
    count; such rows draw equal variates and go by size and text. Other columns are left out; an empty table gives none.
    """
    key, source = F.col(f"`{id_col}`"), F.col(f"`{source_col}`").cast("string")
    text = F.col(f"`{text_col}`")
    sizes = docs.select(key.alias("id"), source.isNull().cast("int").alias("none"), F.coalesce(source, F.lit("")).alias("source"), words(text).alias("size"), F.xxhash64(text).alias("print"))
    sizes = sizes.withColumn("row", F.monotonically_increasing_id())
    if quality is not None:
        told = quality.select(F.col(f"`{id_col}`").alias("id"), F.col("weight").cast("double").alias("weight")).filter("weight > 0").groupBy("id").agg(F.max("weight").alias("weight"))
        # Rows without an id meet nothing and stay where they are.
        sizes = sizes.filter("id IS NOT NULL").join(told.hint("merge"), "id", "left").unionByName(sizes.filter("id IS NULL").withColumn("weight", F.lit(None).cast("double")))
    else:
        sizes = sizes.withColumn("weight", F.lit(None).cast("double"))
    sizes = sizes.withColumn("key", exponential(F.col("id"), seed) / F.coalesce("weight", F.lit(UNLABELLED))).drop("weight")
    sizes = written(sizes, "sizes")
    facts = written(targets(sources_of(sizes, weights), most).drop("weight"), "targets")
    order = ["key", "id", "size", "print", "row"]
    placed = running(sizes, ["none", "source"], order, F.col("size"), facts)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.col("target") - epochs * F.col("source_size")
    fits = (F.col("size") > 0) & (2.0 * F.col("before") + F.col("size") <= 2.0 * left)
    out = placed.withColumn("copies", (epochs + F.when(fits, 1).otherwise(0)).cast("long"))
    taken, named = (F.col("copies") * F.col("size")).alias("taken"), F.when(F.col("none") == 0, F.col("source")).alias("source")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", taken, "copies", named, "print")


def mixture(docs: DataFrame, planned: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of ``docs`` that ``planned`` (of ``plan``) takes, each as often as it says, with ``epoch`` from 1; its columns else.

    Rows of one id, text and source are the same document; one of them stands for all, as often as all are taken. An old
    column ``epoch`` is replaced. Texts are shuffled once, only those of documents that are taken.
    """
    same = ["_id", "_print", "_source"]
    id_, source = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")).alias("_id"), F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("-")).alias("_source")
    chosen = planned.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")).alias("_id"), F.col("print").alias("_print"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("_source"), "copies")
    chosen = chosen.groupBy(*same).agg(F.sum("copies").alias("_copies")).filter("_copies > 0")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "epoch"]).alias("_row"), id_, F.xxhash64(F.col(f"`{text_col}`")).alias("_print"), source)
    met = rows.join(chosen.hint("merge"), same).dropDuplicates(same)
    return met.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("epoch")).select("_row.*", "epoch")


def labelled_quality(labels: DataFrame) -> DataFrame:
    """``doc_id, weight`` by the label ``quality``; other values weigh as documents without one."""
    weight = F.coalesce(*[F.when(F.col("quality") == k, F.lit(w)) for k, w in QUALITY.items()])
    return labels.select("doc_id", weight.alias("weight")).filter("weight IS NOT NULL")


#: The rows of ``op11_mix_sources``.
SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, row_number() OVER () AS row
  FROM documents
), weighed AS (
  SELECT sizes.*, -ln((('0x' || substr(md5('{SEED}:' || coalesce(sizes.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / coalesce(w, {UNLABELLED}::DOUBLE) AS key
  FROM sizes LEFT JOIN (SELECT doc_id, max(CASE quality {" ".join(f"WHEN {k} THEN {w}::DOUBLE" for k, w in QUALITY.items())} END) AS w FROM labels GROUP BY doc_id) l USING (doc_id)
), sources AS (
  SELECT none, source, s, [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY none, source) - 1) % {len(WEIGHTS)} + 1]::HUGEINT AS w
  FROM (SELECT none, source, sum(size)::HUGEINT AS s FROM sizes GROUP BY none, source)
), stopped AS (
  -- By the share of its weight that a source can take, the fewest first: prefixes of this order are what the level stops.
  SELECT *, {MOST_EPOCHS} * s * (ws - wb) < w * (ss - {MOST_EPOCHS} * sb) AS above FROM (
    SELECT *, sum(s) OVER () AS ss, sum(w) OVER () AS ws, coalesce(sum(s) OVER before, 0) AS sb, coalesce(sum(w) OVER before, 0) AS wb
    FROM sources WINDOW before AS (ORDER BY s::DOUBLE / w::DOUBLE, none, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
), level AS (
  SELECT sum(s) - {MOST_EPOCHS} * coalesce(sum(s) FILTER (WHERE above), 0) AS rest, sum(w) - coalesce(sum(w) FILTER (WHERE above), 0) AS share FROM stopped
), facts AS (
  SELECT none, source, s::BIGINT AS source_size, CASE WHEN above THEN ({MOST_EPOCHS} * s)::DOUBLE ELSE (w * rest)::DOUBLE / share::DOUBLE END AS target FROM stopped, level
), placed AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY none, source ORDER BY key, doc_id, size, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM weighed JOIN facts USING (none, source)
)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN size > 0 AND 2.0 * before + size <= 2.0 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
