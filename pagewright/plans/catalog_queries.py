"""Catalog operators over the driver's tables: orders stand for tasks, line items for their batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import text as T
from ..operators import catalog
from .registry import Fixture, case, query, table

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'processing' END"
_SUMS = """
  SELECT l_orderkey, count(*) AS batch_count, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity::BIGINT ELSE 0 END)::BIGINT AS completed_pages,
         bool_or(l_linestatus = 'F') AS any_completed, bool_and(l_linestatus = 'F') AS all_completed FROM lineitem GROUP BY l_orderkey
"""


def _tasks(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), "o_orderdate", "o_orderpriority", "o_totalprice")


def _batches(spark, sf_dir):
    done = F.when(F.col("l_linestatus") == "F", "completed").otherwise("pending")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), done.alias("status"), F.col("l_quantity").cast("long").alias("page_count"))


@query(
    "task_summary",
    f"""
    SELECT o_orderkey AS id, {_STATUS} AS status, coalesce(batch_count, 0) AS batch_count, coalesce(completed_pages, 0) AS completed_pages,
           coalesce(any_completed, false) AS any_completed, coalesce(all_completed, true) AS all_completed
    FROM orders LEFT JOIN ({_SUMS}) ON o_orderkey = l_orderkey
    """,
)
def task_summary(spark, sf_dir):
    out = catalog.summarize(_tasks(spark, sf_dir), _batches(spark, sf_dir), "id")
    return out.select("id", "status", "batch_count", "completed_pages", "any_completed", "all_completed")


@query(
    "status_ladder",
    f"""
    WITH s AS (SELECT o_orderkey AS id, {_STATUS} AS status, coalesce(batch_count, 0) AS n, coalesce(any_completed, false) AS a, coalesce(all_completed, true) AS b
               FROM orders LEFT JOIN ({_SUMS}) ON o_orderkey = l_orderkey)
    SELECT label, count(*) AS tasks FROM (SELECT CASE WHEN status = 'error' THEN 'error' WHEN n > 0 AND b THEN 'completed' WHEN a THEN 'partial'
      WHEN status = 'processing' THEN 'processing' ELSE 'pending' END AS label FROM s) GROUP BY label
    """,
)
def status_ladder(spark, sf_dir):
    out = catalog.summarize(_tasks(spark, sf_dir), _batches(spark, sf_dir), "id")
    label = catalog.status_label(F.col("status"), F.col("any_completed"), F.col("all_completed"), F.col("batch_count"))
    return out.groupBy(label.alias("label")).agg(F.count("*").alias("tasks"))


@query("hydrate", "SELECT d.doc_id, d.source, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents d LEFT JOIN labels USING (doc_id)")
def hydrate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return catalog.hydrate(docs, table(spark, sf_dir, "labels"), "doc_id", {"quality": -1, "toxic": -1})


@query("point_read", "SELECT d.doc_id, length(text) AS characters, coalesce(quality, -1) AS quality FROM documents d LEFT JOIN labels USING (doc_id) WHERE d.doc_id = 17")
def point_read(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("doc_id = 17").select("doc_id", F.length("text").cast("long").alias("characters"))
    return catalog.hydrate(docs, table(spark, sf_dir, "labels").filter("doc_id = 17"), "doc_id", {"quality": -1})


@query(
    "preserve_result",
    "SELECT d.doc_id, coalesce(CASE WHEN n_chars > 1500 THEN 1 END, quality) AS quality FROM documents d LEFT JOIN labels USING (doc_id)",
)
def preserve_result(spark, sf_dir):
    new = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 1500, 1).alias("quality"))
    return catalog.preserve(new, table(spark, sf_dir, "labels"), "doc_id", ["quality"])


@query(
    "catalog_upsert",
    "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce('q' || quality, d.source) AS source FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id",
)
def catalog_upsert(spark, sf_dir):
    have = table(spark, sf_dir, "documents").select("doc_id", "source")
    changes = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source"))
    return catalog.upsert(have, changes, "doc_id")


@query(
    "dedupe_latest",
    """
    SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) || lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k = 1
    """,
)
def dedupe_latest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.md5("text").alias("m"), "lang")
    return catalog.keep_latest(docs, [F.col("m"), F.col("lang")], F.col("n_chars"), F.col("doc_id")).select("doc_id", "source", "n_chars")


@query("catalog_search", "SELECT p_partkey, p_name FROM part WHERE p_size > 10 AND contains(lower(p_name), 'an')")
def catalog_search(spark, sf_dir):
    return catalog.search(table(spark, sf_dir, "part"), F.col("p_name"), "AN", F.col("p_size") > 10).select("p_partkey", "p_name")


@query("catalog_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def catalog_page(spark, sf_dir):
    return catalog.page_of(table(spark, sf_dir, "orders"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 50, 25).select("o_orderkey", "o_totalprice")


_PLAN = """
  SELECT doc_id, pages, start_page, least(start_page + 3, pages)::INTEGER AS end_page, (least(start_page + 3, pages) - start_page + 1)::INTEGER AS page_count
  FROM (SELECT doc_id, pages, unnest(range(1, pages + 1, 4))::INTEGER AS start_page FROM (SELECT doc_id, ceil(n_chars / 500)::INTEGER AS pages FROM documents))
"""


@query("batch_plan", f"SELECT doc_id, start_page, end_page, page_count, CASE WHEN start_page = end_page THEN 'page ' || start_page ELSE 'pages ' || start_page || '-' || end_page END AS label FROM ({_PLAN})")
def batch_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.ceil(F.col("n_chars") / 500).cast("int").alias("pages"))
    return catalog.batch_plan(docs, F.col("pages"), F.lit(4)).select("doc_id", "start_page", "end_page", "page_count", "label")


@query("page_range", f"SELECT doc_id, start_page, end_page FROM ({_PLAN}) WHERE start_page <= least(7, pages) AND end_page >= 3")
def page_range(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.ceil(F.col("n_chars") / 500).cast("int").alias("pages"))
    plan = catalog.batch_plan(docs, F.col("pages"), F.lit(4))
    return catalog.page_range(plan, 3, 7, F.col("pages")).select("doc_id", "start_page", "end_page")


THRESHOLDS = Fixture("name string, minimum int, recommended int", (("small", 0, 2000), ("medium", 3000, 6000), ("large", 7000, 9000)))


@query(
    "theta_levels",
    f"SELECT c_custkey, name, CASE WHEN c_acctbal >= recommended THEN 'recommended' WHEN c_acctbal >= minimum THEN 'low' ELSE 'unsupported' END AS level FROM customer CROSS JOIN {THRESHOLDS.sql()}",
)
def theta_levels(spark, sf_dir):
    return catalog.levels(table(spark, sf_dir, "customer"), F.col("c_acctbal"), THRESHOLDS.frame(spark, sf_dir)).select("c_custkey", "name", "level")


@query(
    "unseen_files",
    "SELECT user_id, ts, value FROM events e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'view' AND s.user_id = e.user_id AND s.value > 90)",
)
def unseen_files(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    seen = events.filter("event_type = 'view' AND value > 90").select("user_id")
    return catalog.without(events.filter("event_type = 'click'").select("user_id", "ts", "value"), seen, ["user_id"])


MODELS = Fixture("model string, enabled boolean", (("m1", True), ("m2", False), ("m3", True)))


@query(
    "model_matrix",
    f"""
    SELECT source, model, count(*) AS runs, count(*) FILTER (WHERE n_chars < 300) AS failed, coalesce(sum(length(text)) FILTER (WHERE n_chars >= 300), 0)::BIGINT AS characters,
           round_even(sum(n_chars / 1000), 3)::DOUBLE AS seconds
    FROM documents CROSS JOIN {MODELS.sql()} WHERE enabled GROUP BY source, model
    """,
)
def model_matrix(spark, sf_dir):
    runs = table(spark, sf_dir, "documents").crossJoin(F.broadcast(MODELS.frame(spark, sf_dir).filter("enabled")))
    failed = F.col("n_chars") < 300
    runs = runs.select("source", "model", F.when(failed, "short").alias("error"), F.when(~failed, F.col("text")).alias("text"), (F.col("n_chars") / 1000).alias("seconds"))
    return catalog.run_metrics(runs, ["source", "model"])


@query(
    "unique_stems",
    """
    WITH s AS (SELECT doc_id, 'in/' || source || '/' || lang || '.txt' AS path, lang || '.m1' AS stem, substr(sha256('in/' || source || '/' || lang || '.txt'), 1, 8) AS h
               FROM (SELECT min(doc_id) AS doc_id, source, lang FROM documents GROUP BY source, lang)),
    n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY path) AS n FROM s)
    SELECT doc_id, CASE WHEN n = 1 THEN stem ELSE stem || '-' || h END AS stem FROM n
    """,
)
def unique_stems(spark, sf_dir):
    files = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.min("doc_id").alias("doc_id"))
    files = files.withColumn("path", F.concat(F.lit("in/"), "source", F.lit("/"), "lang", F.lit(".txt")))
    return catalog.unique_stems(files, T.output_stem(F.col("path"), F.lit("m1")), F.col("path")).select("doc_id", "stem")


@query("thread_concat", "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE text <> '') AS text FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE text <> '') > 0")
def thread_concat(spark, sf_dir):
    return catalog.concat_parts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query(
    "thread_join_continuation",
    r"""
    WITH p AS (SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '') AS x FROM conversations),
    l AS (SELECT *, lag(x) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM p WHERE x <> ''),
    m AS (SELECT conv_id, turn, CASE WHEN before IS NULL THEN '' WHEN regexp_matches(before, '[A-Za-z0-9,)\]%''”’]$') AND NOT regexp_matches(before, '(?:^|\n)!\[[^\]]*\]\([^)]+\)\s*$')
            AND regexp_matches(x, '^[a-z]') THEN ' ' ELSE chr(10) || chr(10) END || x AS x FROM l)
    SELECT conv_id, string_agg(x, '' ORDER BY turn) AS text FROM m GROUP BY conv_id
    """,
)
def thread_join_continuation(spark, sf_dir):
    return catalog.join_continuations(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


PARTS = Fixture("doc_id long, ord long, part string", ((1, 1, "ends open"), (1, 2, "goes on"), (1, 3, "Done."), (1, 4, "new"), (2, 1, "![a](b)"), (2, 2, "lower"), (2, 3, "  "), (2, 4, "# Head"), (3, 1, "x:"), (3, 2, "y")))


@case("continuation_cases", "SELECT unnest([1, 2, 3])::BIGINT AS doc_id, unnest(['ends open goes on' || chr(10) || chr(10) || 'Done.' || chr(10) || chr(10) || 'new', '![a](b)' || chr(10) || chr(10) || 'lower' || chr(10) || chr(10) || '# Head', 'x:' || chr(10) || chr(10) || 'y']) AS part")
def continuation_cases(spark, sf_dir):
    return catalog.join_continuations(PARTS.frame(spark, sf_dir), "doc_id", "ord", "part")


SERVICES = Fixture("id string, running boolean, ready boolean", (("a", True, False), ("b", True, True), ("c", False, True), ("d", None, True)))


@case(
    "exclusive_runtime",
    f"SELECT string_agg(id, ',' ORDER BY id) FILTER (WHERE running) AS running_ids, string_agg(id, ',' ORDER BY id) FILTER (WHERE running AND ready) AS ready_ids, count(*) FILTER (WHERE running) > 1 AS violation FROM {SERVICES.sql()}",
)
def exclusive_runtime(spark, sf_dir):
    return catalog.exclusivity(SERVICES.frame(spark, sf_dir))


IMAGES = Fixture("doc_id long, ord long, name string, value string", ((1, 1, "a", "x"), (1, 2, "a", "y"), (1, 2, "b", "z"), (2, 1, "a", "q"), (2, 3, "c", "r"), (2, 4, "c", "s")), "SELECT user_id AS doc_id, event_id AS ord, event_type AS name, 'v' || event_id AS value FROM {events}")


@query(
    "image_map_merge",
    f"""
    SELECT doc_id, string_agg(name || '=' || l, ',' ORDER BY name) AS last_wins, string_agg(name || '=' || f, ',' ORDER BY name) AS first_wins
    FROM (SELECT doc_id, name, arg_max(value, ord) AS l, arg_min(value, ord) AS f FROM {IMAGES.sql()} GROUP BY doc_id, name) GROUP BY doc_id
    """,
)
def image_map_merge(spark, sf_dir):
    maps = IMAGES.frame(spark, sf_dir).groupBy("doc_id", "ord").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))

    def said(wins: bool, name: str):
        out = catalog.merge_maps(maps, "doc_id", "ord", "m", wins)
        pairs = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
        return out.select("doc_id", F.array_join(pairs, ",").alias(name))

    return said(True, "last_wins").join(said(False, "first_wins"), "doc_id")


@query("enabled_only", f"SELECT o_orderkey FROM orders WHERE 'm' || (o_orderkey % 4) IN (SELECT model FROM {MODELS.sql()} WHERE enabled)")
def enabled_only(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("m"), (F.col("o_orderkey") % 4).cast("string")).alias("model"))
    return tasks.join(MODELS.frame(spark, sf_dir).filter("enabled"), "model", "left_semi").select("o_orderkey")


@query("appended_results", "SELECT doc_id, 'document' AS kind, NULL::INTEGER AS quality FROM documents UNION ALL SELECT doc_id, 'label', quality FROM labels")
def appended_results(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("document").alias("kind"))
    return docs.unionByName(table(spark, sf_dir, "labels").select("doc_id", F.lit("label").alias("kind"), "quality"), allowMissingColumns=True)


LEASES = Fixture("lease string, model string, created double, ttl double", (("a", "m1", 100.0, 50.0), ("b", "m1", 100.0, 0.0), ("c", "m2", 10.0, 20.0), ("d", None, 150.0, 0.5)), "SELECT 'l' || event_id AS lease, CASE WHEN event_id % 5 > 0 THEN event_type END AS model, event_id % 200 AS created, event_id % 4 * 25 AS ttl FROM {events}")


@query(
    "live_leases",
    f"SELECT lease, CASE WHEN ttl > 0 THEN created + ttl END AS expires FROM {LEASES.sql()} WHERE NOT coalesce(ttl > 0 AND created + ttl <= 120, false)",
)
def live_leases(spark, sf_dir):
    leases = LEASES.frame(spark, sf_dir).withColumn("expires", C.expiry(F.col("created"), F.col("ttl")))
    return leases.filter(F.col("expires").isNull() | (F.col("expires") > 120)).select("lease", "expires")


GPUS = Fixture("line string", (("0, GPU-1, Card, with comma, 8192, 4000",), ("bad line",), ("1, GPU-2, Plain, 16384, x",), ("2, GPU-3, Plain, 100, 50",)))


@case("gpu_rows", "SELECT unnest(['0, GPU-1, Card, with comma', '2, GPU-3, Plain']) AS device, unnest([8192, 100])::INTEGER AS total_mib, unnest([4000, 50])::INTEGER AS free_mib")
def gpu_rows(spark, sf_dir):
    pattern = r"^(.*),\s*([0-9]+)\s*,\s*([0-9]+)\s*\z"
    rows = GPUS.frame(spark, sf_dir).filter(F.col("line").rlike(pattern))
    return rows.select(*[F.regexp_extract("line", pattern, k).cast(kind).alias(name) for k, (name, kind) in enumerate((("device", "string"), ("total_mib", "int"), ("free_mib", "int")), 1)])


@query("page_budget", "SELECT lang, count(*) AS docs, sum(ceil(n_chars / 500)::BIGINT)::BIGINT AS pages, sum(ceil(n_chars / 500)) > 500 AS over FROM documents GROUP BY lang")
def page_budget(spark, sf_dir):
    pages = F.ceil(F.col("n_chars") / 500)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(pages).alias("pages"), (F.sum(pages) > 500).alias("over"))


@query("ordered_catalog", "SELECT source, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY source")
def ordered_catalog(spark, sf_dir):
    """Distinct names in order of their first row."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
