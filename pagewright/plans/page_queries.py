"""Page budgets, orders, durations, dates and edits, over the driver's tables where they have the columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import geometry as G
from ..functions import records as R
from ..operators import blocks, catalog, results
from .registry import Fixture, query, table

DPI = 180


@query(
    "pixel_budget",
    f"""
    SELECT p_brand, sum(floor((p_size * 10 + 200) * ({DPI} / 72.0::DOUBLE))::BIGINT * floor(p_retailprice * ({DPI} / 72.0::DOUBLE))::BIGINT)::BIGINT AS pixels,
           sum(floor((p_size * 10 + 200) * ({DPI} / 72.0::DOUBLE))::BIGINT * floor(p_retailprice * ({DPI} / 72.0::DOUBLE))::BIGINT) > 50000000 AS over
    FROM part GROUP BY p_brand
    """,
)
def pixel_budget(spark, sf_dir):
    """Parts stand for pages, brands for documents."""
    pixels = F.sum(G.rendered_pixels(F.col("p_size") * 10 + 200, F.col("p_retailprice"), DPI))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(pixels.alias("pixels"), (pixels > 50_000_000).alias("over"))


@query("page_order", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS place FROM (SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY 1, 2 LIMIT 40)")
def page_order(spark, sf_dir):
    """Pages, then places on them; a page of the catalog is what it returns."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber").limit(40)
    first = rows.agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber"))).alias("rows"))
    return first.select(F.posexplode("rows").alias("place", "row")).select("row.*", (F.col("place") + 1).cast("long").alias("place"))


@query("newest_first", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders QUALIFY place <= 30")
def newest_first(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(30).select("o_orderkey", "o_orderdate")
    listed = rows.agg(F.array_sort(F.collect_list(F.struct((-F.unix_date(F.col("o_orderdate").cast("date"))).alias("day"), "o_orderkey"))).alias("rows"))
    return listed.select(F.posexplode("rows").alias("place", "row")).select("row.o_orderkey", (F.col("place") + 1).cast("long").alias("place"))


@query(
    "edited_texts",
    """
    SELECT item_id, substr(text, 1, 3) || '[' || substr(text, 6, 5) || '](' || substr(text, 13) AS text FROM benchmark WHERE length(text) > 20
    """,
)
def edited_texts(spark, sf_dir):
    """Two edits, given in rising order and applied from the last."""
    edit = lambda start, end, by: F.struct(F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(by).alias("by"))
    items = table(spark, sf_dir, "benchmark").filter(F.length("text") > 20)
    return items.select("item_id", results.edits_applied(F.col("text"), F.array(edit(3, 5, "["), edit(10, 12, "]("))).alias("text"))


@query(
    "durations",
    """
    SELECT event_id, round_even((epoch_us(ts) - epoch_us(before)) / 1e6::DOUBLE, 3) AS elapsed, coalesce(greatest(0, floor((epoch_us(TIMESTAMP '2024-06-01') - epoch_us(before)) / 1e6::DOUBLE)), 0)::BIGINT AS progress
    FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    """,
)
def durations(spark, sf_dir):
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    now = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), before.cast("timestamp").alias("before"))
    return rows.select("event_id", C.elapsed(F.col("before"), F.col("ts")).alias("elapsed"), C.progress_seconds(F.col("before"), now).alias("progress"))


@query(
    "display_dates",
    """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, CASE WHEN year(ts) = 2024 THEN strftime(ts, '%m/%d, %H:%M') ELSE strftime(ts, '%m/%d/%Y, %H:%M') END AS shown,
           strftime(ts - INTERVAL 400 DAY, '%m/%d/%Y, %H:%M') AS earlier FROM events WHERE year(ts) = 2024
    """,
)
def display_dates(spark, sf_dir):
    now = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).filter(F.year("ts") == 2024)
    earlier = F.col("ts") - F.expr("INTERVAL 400 DAYS")
    return rows.select("event_id", C.utc_stamp(F.col("ts")).alias("stamp"), C.display_date(F.col("ts"), now).alias("shown"), C.display_date(earlier, now).alias("earlier"))


@query(
    "light_batches",
    "SELECT l_orderkey, string_agg(l_linenumber || ':' || l_quantity::BIGINT, ',' ORDER BY l_linenumber, l_quantity::BIGINT) AS batches FROM lineitem GROUP BY l_orderkey",
)
def light_batches(spark, sf_dir):
    """Line items stand for batches, their comments and dates for what is heavy."""
    lines = table(spark, sf_dir, "lineitem")
    held = F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("pages"), F.col("l_shipdate").alias("text"))))
    out = lines.groupBy("l_orderkey").agg(held.alias("b")).select("l_orderkey", R.light_batches(F.col("b"), "text").alias("b"))
    shown = F.transform("b", lambda x: F.concat_ws(":", *[x[c].cast("string") for c in ("l_linenumber", "pages")]))
    return out.select("l_orderkey", F.array_join(shown, ",").alias("batches"))


POLYGONS = Fixture(
    "case_id long, xs array<double>, ys array<double>, width double, height double",
    ((1, (3.0, 9.5, 8.0, 2.0), (4.0, 4.5, 11.0, 10.0), 5.0, 50.0), (2, (-1.0, 0.0), (7.0, 2.0), 10.0, 3.0), (3, (5.0, 5.0, 5.0), (6.0, 6.0, 6.0), 5.0, 6.0)),
    "SELECT vec_id AS case_id, @array(floor(@at(embedding, 1) * 1000@single), floor(@at(embedding, 2) * 1000@single), floor(@at(embedding, 3) * 1000@single)) AS xs, @array(floor(@at(embedding, 4) * 1000@single), floor(@at(embedding, 5) * 1000@single), floor(@at(embedding, 6) * 1000@single)) AS ys, 50 AS width, 40 AS height FROM {embeddings} WHERE embedding IS NOT NULL",
)


@query(
    "polygon_boxes",
    f"""
    SELECT case_id, list_min(xs) || ',' || list_min(ys) || ',' || list_max(xs) || ',' || list_max(ys) AS box, greatest(width, list_max(xs)) || ',' || greatest(height, list_max(ys)) AS bounds FROM {POLYGONS.sql()}
    """,
)
def polygon_boxes(spark, sf_dir):
    points = F.transform(F.arrays_zip("xs", "ys"), lambda p: F.array(p["xs"], p["ys"]))
    rows = POLYGONS.frame(spark, sf_dir).withColumn("box", G.polygon_box(points))
    bounds = G.coordinate_bounds_of(F.col("width"), F.col("height"), F.array("box"))
    return rows.select("case_id", F.array_join("box", ",").alias("box"), F.array_join(bounds, ",").alias("bounds"))


@query(
    "base64_texts",
    "SELECT doc_id, length(text) > 0 AS whole, md5(text) AS md5, NULL::VARCHAR AS broken FROM documents WHERE text IS NOT NULL",
)
def base64_texts(spark, sf_dir):
    """Texts there and back, behind a data URL's head and with line ends between; what isn't base64 is null."""
    coded = F.concat(F.lit("data:text/plain;base64,"), F.regexp_replace(F.base64(F.col("text").cast("binary")), "(.{60})", "$1\n"))
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", C.from_base64(coded).alias("raw"), C.from_base64(F.concat(F.lit("%"), coded)).cast("string").alias("broken"))
    return docs.select("doc_id", (F.length("raw") > 0).alias("whole"), F.md5("raw").alias("md5"), "broken")


@query("page_rows", "SELECT conv_id, turn, role FROM conversations WHERE turn >= 1 AND turn < 4")
def page_rows(spark, sf_dir):
    """Turns of conversations as pages of documents."""
    return catalog.page_rows(table(spark, sf_dir, "conversations"), 1, 3, "turn").select("conv_id", "turn", "role")


@query("page_counts", "SELECT conv_id, count(*) AS pages FROM conversations GROUP BY conv_id")
def page_counts(spark, sf_dir):
    return catalog.page_counts(table(spark, sf_dir, "conversations"), "conv_id", 100_000)


_CROPS = """
  SELECT user_id, event_id, event_type, event_id % 3 AS page,
         value >= 2 AND event_type IN ('click', 'view') AND least(800, floor(value * 10)) > least(800, floor(value)) AS cut
  FROM events
"""


@query(
    "crop_numbers",
    f"""
    SELECT event_id, CASE WHEN cut THEN sum(cut::INTEGER) OVER (PARTITION BY user_id, page ORDER BY event_id) END::BIGINT AS on_page, CASE WHEN cut THEN sum(cut::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id) END::BIGINT AS in_document
    FROM ({_CROPS})
    """,
)
def crop_numbers(spark, sf_dir):
    """Events as blocks whose boxes come from their value: crops numbered by page and through the document."""
    box = F.array(F.floor("value").cast("double"), F.lit(0.0), F.when(F.col("value") >= 2, F.floor(F.col("value") * 10).cast("double")).otherwise(0.0), F.lit(500.0))
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 3).alias("page"), F.col("event_id").alias("ord"), F.col("event_type").alias("kind"), box.alias("box"))
    pixels = G.outward_pixels(F.transform("box", lambda v: F.least(v, F.lit(800.0))), F.lit(1000), F.lit(1000))
    found = blocks.number_crops(rows, ["user_id", "page"], ("click", "view"), pixels).withColumnRenamed("crop", "on_page")
    return blocks.number_crops(found, ["user_id"], ("click", "view"), pixels).select(F.col("ord").alias("event_id"), "on_page", F.col("crop").alias("in_document"))
