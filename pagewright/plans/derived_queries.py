"""Rules of labels, states, names and boxes over columns that the given tables derive, with computed oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as T
from ..operators import blocks, catalog, results
from .registry import query, table


def _quoted(names) -> str:
    return ", ".join(f"'{name}'" for name in names)


@query(
    "ignore_labels",
    f"""
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'number,' ELSE '' END || 'footnote,' || CASE WHEN doc_id % 3 = 0 THEN 'header,header_image,' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN 'footer,footer_image,' ELSE '' END || 'aside_text' AS sent,
           CASE WHEN doc_id % 4 = 0 THEN '{",".join(sorted(R.DEFAULT_IGNORED))}' ELSE least(lang, source) || ',' || greatest(lang, source) END AS used
    FROM documents
    """,
)
def ignore_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    every = lambda n: F.col("doc_id") % n == 0
    asked = F.when(every(4), F.array().cast("array<string>")).otherwise(F.array("source", "lang", "source"))
    return docs.select("doc_id", F.array_join(R.ignored_labels(every(2), every(3), every(5)), ",").alias("sent"), F.array_join(R.requested_ignores(asked), ",").alias("used"))


@query("nested_labels", "SELECT doc_id, lang || ',' || source || ',x' AS labels FROM documents")
def nested_labels(spark, sf_dir):
    listed = F.concat(F.lit('["'), "source", F.lit('", " X"]'))
    items = F.array(F.concat(F.lit(" "), F.upper("lang")), listed, F.lit(""), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(R.flat_labels(items), ",").alias("labels"))


@query(
    "exclusively_ready",
    """
    SELECT event_id, coalesce(value > 10, false) AND event_id % 5 > 0 AND event_type = 'click' AND (event_id % 3 > 0 OR event_type = 'click') AND event_id % 7 <> 1 AS ok
    FROM events
    """,
)
def exclusively_ready(spark, sf_dir):
    """Events as models that run; some are ready, alone or not, and some are not the active one."""
    running = F.array("event_type", "event_type")
    ready = F.when(F.col("event_id") % 3 == 0, F.array("event_type"))
    active = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 7 == 1, "other").when(F.col("event_id") % 7 == 2, "click")
    return table(spark, sf_dir, "events").select("event_id", R.is_exclusively_ready(F.lit("click"), F.col("value") > 10, F.col("event_id") % 5 == 0, running, ready, active).alias("ok"))


_TASKS = """
  SELECT event_id, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'error' ELSE 'completed' END AS s,
         CASE event_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing' END AS b1, CASE WHEN event_id % 3 = 0 THEN 'pending' ELSE 'completed' END AS b2,
         event_id % 4 AS results, event_id % 5 AS done, event_id % 7 AS pages, event_id % 2 = 0 AS loaded
  FROM events
"""


@query(
    "task_states",
    f"""
    SELECT event_id, s <> 'processing' AND coalesce(b1, '') <> 'processing' AND s IN ('pending', 'error') AND CASE WHEN b1 IS NOT NULL THEN (b1 = 'completed' OR b2 = 'completed') AND (b1 <> 'completed' OR b2 <> 'completed') ELSE done > 0 AND (pages = 0 OR done < pages) END AS resumes,
           CASE WHEN s <> 'processing' THEN s WHEN coalesce(b1 = 'completed' AND b2 = 'completed' AND results >= 2, false) OR (NOT loaded AND done >= pages) THEN 'completed' ELSE 'pending' END AS status
    FROM ({_TASKS})
    """,
)
def task_states(spark, sf_dir):
    rows = spark.sql(_TASKS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events")).withColumn("b", F.when(F.col("b1").isNotNull(), F.array("b1", "b2")))
    known = F.coalesce("b", F.array().cast("array<string>"))
    status = R.reconciled_status(F.col("s"), known, F.col("results"), F.col("done"), F.col("pages"), F.col("loaded"))
    return rows.select("event_id", R.resumes(F.col("s"), F.col("b"), F.col("done"), F.col("pages")).alias("resumes"), status.alias("status"))


@query(
    "plan_checks",
    """
    SELECT doc_id, lang <> 'de' AND n_chars > 0 AND doc_id % 3 <> 1 AND (doc_id % 3 = 0 OR doc_id % 4 <> 0 OR n_chars > 400) AS replans
    FROM documents
    """,
)
def plan_checks(spark, sf_dir):
    """Documents with a plan of a batch or none, of the size that is wanted or of another."""
    batch = F.array(F.struct(F.when(F.col("doc_id") % 3 == 1, "completed").otherwise("pending").alias("status"), F.col("n_chars").cast("int").alias("pages")))
    batches = F.when(F.col("doc_id") % 3 == 0, F.slice(batch, 1, 0)).otherwise(batch)
    kind = F.when(F.col("lang") == "de", "image").when(F.col("lang") == "en", "pdf").otherwise("office")
    return table(spark, sf_dir, "documents").select("doc_id", R.replans(kind, F.lit(True), F.col("n_chars"), batches, 4 + F.col("doc_id") % 4, F.lit(4)).alias("replans"))


@query(
    "image_sources",
    """
    SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'data:image/jpeg;base64,' || md5(url) WHEN page_id % 4 = 1 THEN 'ocr_images/' || page_id WHEN page_id % 4 = 2 THEN 'data:image/jpeg;base64,' ELSE url END AS source,
           CASE WHEN page_id % 4 = 2 THEN NULL ELSE false END AS cjk
    FROM pages
    """,
)
def image_sources(spark, sf_dir):
    given = F.when(F.col("page_id") % 4 == 0, F.md5("url")).when(F.col("page_id") % 4 == 1, F.concat(F.lit("ocr_images/"), "page_id")).when(F.col("page_id") % 4 == 3, F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", R.image_source(given).alias("source"), R.has_cjk(given).alias("cjk"))


@query("image_names", "SELECT doc_id, 'ocr_images/b' || doc_id || '_' || lang || '_' || source || '.png=' || lang || ',ocr_images/b' || doc_id || '_zz.png=' || source AS names FROM documents")
def image_names(spark, sf_dir):
    images = F.create_map(F.concat_ws("/", "lang", F.concat("source", F.lit(".png"))), F.col("lang"), F.lit("zz.png"), F.col("source"))
    entries = F.array_sort(F.map_entries(R.namespaced(images, F.concat(F.lit("b"), "doc_id"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("names"))


_SIDES = ", ".join(f"floor(embedding[{i}] * 2000) AS s{i}" for i in (1, 2, 3, 4))


@query(
    "point_boxes",
    f"""
    SELECT vec_id, list_transform([[least(s1, s3), 100], [least(s2, s4), 200], [greatest(s1, s3), 100], [greatest(s2, s4), 200]], lambda x: greatest(0, least(x[2], x[1]))::INTEGER) AS box
    FROM (SELECT vec_id, {_SIDES} FROM embeddings WHERE embedding IS NOT NULL) WHERE greatest(abs(s1), abs(s2), abs(s3), abs(s4)) > 1.5
    """,
)
def point_boxes(spark, sf_dir):
    """Components as the corners of boxes on pages of 100 by 200; multiplied in single precision, as they are stored."""
    points = F.transform(F.slice("embedding", 1, 4), lambda v: F.floor(v * F.lit(2000).cast("float")).cast("double"))
    rows = table(spark, sf_dir, "embeddings").filter("embedding IS NOT NULL").select("vec_id", points.alias("p")).filter(F.array_max(F.transform("p", F.abs)) > 1.5)
    return rows.select("vec_id", R.point_box(F.col("p"), F.lit(100), F.lit(200)).alias("box"))


@query("zipped_pages", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN lang || '=' || source ELSE lang || '=' || source || ';' || source || '=' || lang END AS pages FROM documents")
def zipped_pages(spark, sf_dir):
    images = F.slice(F.array("source", "lang"), F.lit(1), (F.col("doc_id") % 3).cast("int"))
    pages = R.zipped_pages(F.array("lang", "source", F.lit("c")), images)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(pages, lambda p: F.concat_ws("=", p["text"], p["images"])), ";").alias("pages"))


@query(
    "record_structs",
    """
    SELECT vec_id, CASE WHEN vec_id % 3 > 0 THEN 'm' || vec_id END AS id, nullif(vec_id % 4, 0) AS size, CASE WHEN vec_id % 2 = 0 THEN 'title' ELSE 'text' END AS label,
           [x / 1.0, x * 2 / 2.0, (x + 10 - x) / 1.0, (x + 30 - x * 2) / 2.0] AS percent
    FROM (SELECT *, vec_id % 50 AS x FROM embeddings)
    """,
)
def record_structs(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("x", (F.col("vec_id") % 50).cast("double"))
    run = R.benchmark_record(F.when(F.col("vec_id") % 3 > 0, F.concat(F.lit("m"), "vec_id")).otherwise(""), F.lit("n"), F.lit("pdf"), F.col("vec_id") % 4, F.lit(0), F.lit(""))
    block = R.block_record(F.when(F.col("vec_id") % 2 == 0, "title"), F.lit(None).cast("string"), F.array("x"), F.lit(0))
    percent = R.percent_box(F.array(F.col("x"), F.col("x") * 2, F.col("x") + 10, F.col("x") + 30), F.lit(100), F.lit(200))
    return rows.select("vec_id", run["modelId"].alias("id"), run["sizeBytes"].alias("size"), block["block_label"].alias("label"), percent.alias("percent"))


@query(
    "combined_images",
    """
    SELECT user_id, string_agg('ocr_images/' || event_id || '_' || event_type || '.png=v' || event_id, ',' ORDER BY 'ocr_images/' || event_id || '_' || event_type || '.png') AS names FROM events GROUP BY user_id
    """,
)
def combined_images(spark, sf_dir):
    """Users as documents whose events are batches with an image each."""
    images = F.create_map(F.concat("event_type", F.lit(".png")), F.concat(F.lit("v"), F.col("event_id").cast("string")))
    pages = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("batch"), images.alias("images"))
    entries = F.array_sort(F.map_entries("images"))
    return catalog.combined_images(pages, "user_id", "batch").select("user_id", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("names"))


@query("stashed_math", "SELECT doc_id, lang || ' @@math0@@ b @@math1@@ ' || source AS text, true AS restored FROM documents")
def stashed_math(spark, sf_dir):
    said = F.concat("lang", F.lit(" $x_"), "source", F.lit("$ b $$y\nz"), "lang", F.lit("$$ "), "source")
    rows = table(spark, sf_dir, "documents").select("doc_id", said.alias("t")).withColumn("s", results.stashed("t"))
    return rows.select("doc_id", "s.text", (results.unstashed(F.col("s.text"), F.col("s.math")) == F.col("t")).alias("restored"))


_LABELLED = """
  SELECT user_id, event_id, event_id % 9 AS page, CASE event_type WHEN 'click' THEN 'Image' WHEN 'view' THEN 'figure_caption' WHEN 'error' THEN 'text' ELSE 'table' END AS label, CASE WHEN value > 15 THEN 'text' ELSE 'heuristic' END AS confidence
  FROM events
"""


@query(
    "caption_backfill",
    f"""
    WITH n AS (
      SELECT *, coalesce({", ".join(f"CASE WHEN lead(label, {k}) OVER w IN ({_quoted(T.CAPTION_LABELS)}) AND lead(confidence, {k}) OVER w = 'text' THEN lead(page, {k}) OVER w END" for k in (1, 2, 3))}) AS found
      FROM ({_LABELLED}) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
    )
    SELECT event_id, CASE WHEN take THEN found ELSE page END AS page, CASE WHEN take THEN 'caption' ELSE confidence END AS confidence
    FROM (SELECT *, found IS NOT NULL AND confidence <> 'text' AND lower(label) IN ({_quoted(T.VISUAL_LABELS)}, 'table', 'algorithm') AS take FROM n)
    """,
)
def caption_backfill(spark, sf_dir):
    rows = spark.sql(_LABELLED.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events")).withColumnRenamed("event_id", "ord")
    return blocks.backfill_pages(rows, "user_id").select(F.col("ord").alias("event_id"), "page", "confidence")


@query(
    "gpu_rows",
    "SELECT event_id || ', GPU-' || user_id || ', Card, ' || event_type AS device, 8192 + (event_id % 100)::INTEGER AS total_mib, (event_id % 8000)::INTEGER AS free_mib FROM events WHERE event_id % 5 > 0",
)
def gpu_rows(spark, sf_dir):
    """Events as lines of a device listing, some of them broken."""
    pattern = r"^(.*),\s*([0-9]+)\s*,\s*([0-9]+)\s*\z"
    line = F.concat(F.concat_ws(", ", "event_id", F.concat(F.lit("GPU-"), "user_id"), F.lit("Card"), "event_type", 8192 + F.col("event_id") % 100), F.when(F.col("event_id") % 5 == 0, ", x").otherwise(F.concat(F.lit(" ,"), F.col("event_id") % 8000)))
    rows = table(spark, sf_dir, "events").select(line.alias("line")).filter(F.col("line").rlike(pattern))
    return rows.select(*[F.regexp_extract("line", pattern, k).cast(kind).alias(name) for k, (name, kind) in enumerate((("device", "string"), ("total_mib", "int"), ("free_mib", "int")), 1)])
