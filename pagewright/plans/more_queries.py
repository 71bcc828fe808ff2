"""Remaining catalog, page and stream rules on fixtures with expected rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import blocks, catalog, tables
from .record_queries import _want
from .registry import case, query, table


@case("anchored_pages", _want("doc_id long, ord long, page int, confidence string", (1, 0, 1, "caption"), (1, 1, 1, "text"), (1, 2, 2, "heuristic"), (1, 3, 0, "text")))
def anchored_pages(spark, sf_dir):
    rows = [
        (1, 0, "image", None, [0.0, 10.0, 1.0, 20.0]), (1, 1, "figure_caption", "The middle page says this clearly", [0.0, 900.0, 1.0, 950.0]),
        (1, 2, "text", "no anchor here at all", [0.0, 100.0, 1.0, 120.0]), (1, 3, "text", "First page, its very own words", None),
    ]
    found = spark.createDataFrame(rows, "doc_id long, ord long, label string, text string, box array<double>")
    pages = spark.createDataFrame([(1, 0, "First page its very own words are these"), (1, 1, "On it: the middle page says this clearly."), (1, 2, "last")], "doc_id long, page int, text string")
    return blocks.anchored_pages(found, pages, "doc_id").select("doc_id", "ord", "page", "confidence")


@case("clean_blocks", _want("case_id long, text string", (1, ""), (2, ""), (3, "<table><tr></table>"), (4, "\\( x \\)"), (5, "\\( 6 \\div 2 \\)"), (6, "see  here")))
def clean_blocks(spark, sf_dir):
    rows = [(1, "[Non-Text]"), (2, " The image is too blurry to recognize any text content. "), (3, "<table><tr>"), (4, "\\[\n x \n\\]"), (5, "6 ÷ 2"), (6, "see \\tag{1} here")]
    return spark.createDataFrame(rows, "case_id long, text string").select("case_id", tables.cleaned("text").alias("text"))


@case("model_catalog", _want("ord long, id string, name string, port int", (0, "b", "B", 2), (2, "a", "A", 1)))
def model_catalog(spark, sf_dir):
    ids = spark.createDataFrame([(0, "b"), (1, "x"), (2, "a")], "ord long, id string")
    definitions = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string")
    runtime = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, port int")
    return catalog.model_catalog(ids, definitions, runtime).select("ord", "id", "name", "port")


@query("label_names", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' ELSE lang END AS shown FROM documents")
def label_names(spark, sf_dir):
    one = spark.createDataFrame([("en", "English")], "label string, name string")
    two = spark.createDataFrame([("en", "no"), ("fr", "French")], "label string, name string")
    return catalog.with_labels(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", [one, two]).select("doc_id", "shown")


@query("lease_models", "SELECT user_id, count(DISTINCT event_type) AS models, count(*) AS leases, count(DISTINCT event_type) > 1 AS mixed FROM events GROUP BY user_id")
def lease_models(spark, sf_dir):
    return catalog.lease_models(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("model")), "user_id")


@case("chosen_device", _want("index int, device_id string", (1, "g1")))
def chosen_device(spark, sf_dir):
    devices = spark.createDataFrame([(0, "g0"), (1, "g1")], "index int, device_id string")
    return catalog.chosen_device(devices, "nowhere", 1).select("index", "device_id")


@case("first_available", _want("image string", ("second",)))
def first_available(spark, sf_dir):
    preferences = spark.createDataFrame([(1, "first"), (2, "second"), (3, "third")], "ord int, image string")
    return catalog.first_available(preferences, spark.createDataFrame([("third",), ("second",)], "image string"), "image", "ord")


@case("services", _want("model string, ord int, service string", ("a", 0, "s1"), ("a", 1, "s2")))
def services(spark, sf_dir):
    models = spark.createDataFrame([("a",), ("b",)], "model string")
    return catalog.services_of(models, spark.createDataFrame([("a", ["s1", "s2"])], "model string, services array<string>"), "model")


@case("combined_images", _want("doc_id long, names string", (1, "ocr_images/1_a.png=x,ocr_images/2_a.png=y")))
def combined_images(spark, sf_dir):
    pages = spark.createDataFrame([(1, 1, {"a.png": "x"}), (1, 2, {"a.png": "y"})], "doc_id long, batch int, images map<string,string>")
    entries = F.array_sort(F.map_entries("images"))
    return catalog.combined_images(pages, "doc_id", "batch").select("doc_id", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("names"))


@case("small_rules", _want("case_id long, compact boolean, parser boolean, locked boolean, copied string, cache string", (1, True, True, False, '{"case_id":1}', "1:a:"), (2, False, True, True, "md", "2:b:x"), (3, True, False, True, "", "3::")))
def small_rules(spark, sf_dir):
    rows = [(1, 1, None, "hpd", None, "json", None, "a", None, False, 0), (2, 2, None, "x", ["HPD"], "md", "md", "b", "x", None, 2), (3, 2, "heavy", None, ["q"], "md", None, None, None, True, None)]
    frame = spark.createDataFrame(rows, "case_id long, v int, h string, m string, p array<string>, view string, md string, a string, b string, proc boolean, active int")
    return frame.select(
        "case_id", R.needs_compaction(F.col("v"), F.col("h")).alias("compact"), R.uses_parser(F.col("m"), F.col("p"), "hpd").alias("parser"),
        R.history_locked(F.col("proc"), F.lit(None).cast("boolean"), F.col("active")).alias("locked"),
        R.copied_text(F.col("view"), F.struct("case_id"), F.col("md")).alias("copied"), R.cache_key(F.col("case_id"), F.col("a"), F.col("b")).alias("cache"),
    )


@case("zipped_pages", _want("case_id long, pages string", (1, "a=1;b=2"), (2, "")))
def zipped_pages(spark, sf_dir):
    frame = spark.createDataFrame([(1, ["a", "b", "c"], ["1", "2"]), (2, [], ["1"])], "case_id long, t array<string>, i array<string>")
    return frame.select("case_id", F.array_join(F.transform(R.zipped_pages(F.col("t"), F.col("i")), lambda p: F.concat_ws("=", p["text"], p["images"])), ";").alias("pages"))


@case("record_structs", _want("id string, size long, label string, percent string", ("m", None, "text", "10.0,20.0,30.0,40.0")))
def record_structs(spark, sf_dir):
    frame = spark.createDataFrame([("m", "", 0, [10.0, 20.0, 40.0, 60.0])], "m string, n string, s long, b array<double>")
    run = R.benchmark_record(F.col("m"), F.col("n"), F.lit("pdf"), F.col("s"), F.lit(0), F.col("n"))
    block = R.block_record(F.lit(None).cast("string"), F.col("n"), F.col("b"), F.lit(0))
    return frame.select(run["modelId"].alias("id"), run["sizeBytes"].alias("size"), block["block_label"].alias("label"), F.array_join(R.percent_box(F.col("b"), F.lit(100), F.lit(100)), ",").alias("percent"))
