"""Record rules, result assembly and nested results; oracles are expected rows or SQL over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import results
from .registry import Fixture, case, query, table


def _want(columns: str, *rows: tuple) -> str:
    return f"SELECT * FROM {Fixture(columns, rows).sql()}"


RESPONSES = Fixture("case_id long, m string, t string, r string", ((1, "m", "t", "r"), (2, "", "t", "r"), (3, None, "t", "r"), (4, None, "", "r"), (5, None, None, None), (6, None, None, "")), "SELECT doc_id AS case_id, CASE WHEN doc_id % 3 = 1 THEN '' WHEN doc_id % 3 = 2 THEN source END AS m, CASE WHEN doc_id % 4 = 1 THEN '' WHEN doc_id % 4 > 1 THEN lang END AS t, CASE WHEN doc_id % 5 > 0 THEN source || lang END AS r FROM {documents}")


@query("response_texts", f"SELECT case_id, CASE WHEN m IS NOT NULL THEN m WHEN t <> '' THEN t WHEN r <> '' THEN r ELSE '' END AS text FROM {RESPONSES.sql()}")
def response_texts(spark, sf_dir):
    return RESPONSES.frame(spark, sf_dir).select("case_id", R.response_text(F.col("m"), F.col("t"), F.col("r")).alias("text"))


PAYLOADS = Fixture("case_id long, f string, k int, t double", ((1, "x", 0, None), (2, "y", None, 0.5), (3, None, None, None), (4, "q", 1, 2.25)), "SELECT doc_id AS case_id, CASE WHEN doc_id % 3 > 0 THEN lang END AS f, CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 - 1 END AS k, CASE WHEN doc_id % 5 > 0 THEN (doc_id % 5) * 0.25 END AS t FROM {documents}")


@query(
    "request_payload",
    f"""
    SELECT case_id, '{{' || array_to_string(list_filter(['"file":"' || f || '"', '"fileType":' || k, '"temperature":' || t], lambda x: x IS NOT NULL), ',') || '}}' AS payload FROM {PAYLOADS.sql()}
    """,
)
def request_payload(spark, sf_dir):
    return PAYLOADS.frame(spark, sf_dir).select("case_id", R.payload(file=F.col("f"), fileType=F.col("k"), temperature=F.col("t")).alias("payload"))


ALIASES = Fixture("case_id long, l array<string>, p array<string>, r array<string>, m string", ((1, ("a", "b"), ("x",), None, "m"), (2, None, ("c",), ("d",), "m"), (3, None, None, None, "text"), (4, None, None, ("e", "f"), None), (5, None, None, None, None)), "SELECT doc_id AS case_id, CASE WHEN doc_id % 2 = 0 THEN @array(lang, source) END AS l, CASE WHEN doc_id % 3 = 0 THEN @array(source) END AS p, CASE WHEN doc_id % 5 < 3 THEN @array(lang, lang) END AS r, CASE WHEN doc_id % 7 > 0 THEN source END AS m FROM {documents}")


@query("result_aliases", f"SELECT case_id, array_to_string(CASE WHEN l IS NOT NULL THEN l WHEN p IS NOT NULL THEN p WHEN r IS NOT NULL THEN r ELSE [coalesce(m, '')] END, ',') AS found FROM {ALIASES.sql()}")
def result_aliases(spark, sf_dir):
    return ALIASES.frame(spark, sf_dir).select("case_id", F.array_join(R.results_of(F.col("l"), F.col("p"), F.col("r"), F.col("m")), ",").alias("found"))


MODELS = Fixture("i string, n string, l string", (("a", "", None), (None, "n", "L"), ("", None, ""), ("x", "y", "z"), ("only", None, "")), "SELECT CASE WHEN doc_id % 3 = 1 THEN '' WHEN doc_id % 3 = 2 THEN 'i' || doc_id END AS i, CASE WHEN doc_id % 4 = 1 THEN '' WHEN doc_id % 4 > 1 THEN source END AS n, CASE WHEN doc_id % 5 > 0 THEN lang END AS l FROM {documents}")


@query(
    "model_records",
    f"""
    SELECT CASE WHEN i <> '' THEN i WHEN n <> '' THEN n ELSE 'd' END AS id, CASE WHEN n <> '' THEN n WHEN i <> '' THEN i ELSE 'd' END AS name,
           CASE WHEN l <> '' THEN l WHEN n <> '' THEN n WHEN i <> '' THEN i ELSE 'd' END AS label FROM {MODELS.sql()}
    """,
)
def model_records(spark, sf_dir):
    return MODELS.frame(spark, sf_dir).select(R.model_record(F.col("i"), F.col("n"), F.col("l"), "d").alias("m")).select("m.*")


@query("page_lineage", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN conv_id + turn END AS source_page FROM conversations")
def page_lineage(spark, sf_dir):
    parser = F.when(F.col("role") == "user", "hpd-parsing").otherwise("other")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.source_page(parser, F.col("conv_id"), F.col("turn")).alias("source_page"))


@case("ignore_labels", _want("case_id long, sent string, used string", (1, "number,footnote,header,header_image,aside_text", "footer,page_footnote"), (2, "footnote,footer,footer_image,aside_text", "footer,header,page_number")))
def ignore_labels(spark, sf_dir):
    frame = spark.createDataFrame([(1, True, True, False, ["footnote", "footer_image", "footer"]), (2, False, False, True, [])], "case_id long, n boolean, h boolean, f boolean, asked array<string>")
    return frame.select("case_id", F.array_join(R.ignored_labels(F.col("n"), F.col("h"), F.col("f")), ",").alias("sent"), F.array_join(R.requested_ignores(F.col("asked")), ",").alias("used"))


@case("nested_labels", _want("case_id long, labels string", (1, "a,b,c"), (2, ""), (3, "[x")))
def nested_labels(spark, sf_dir):
    frame = spark.createDataFrame([(1, ["A ", '["b", "C", "a"]', "a"]), (2, ["", "[]"]), (3, ["[x"])], "case_id long, items array<string>")
    return frame.select("case_id", F.array_join(R.flat_labels(F.col("items")), ",").alias("labels"))


@case("exclusively_ready", _want("case_id long, ok boolean", (1, True), (2, False), (3, False), (4, False), (5, True)))
def exclusively_ready(spark, sf_dir):
    rows = [(1, True, None, ["m"], ["m", "m"], "m"), (2, True, None, ["m", "n"], None, None), (3, True, True, None, None, None), (4, True, None, None, None, "n"), (5, True, False, None, None, "")]
    frame = spark.createDataFrame(rows, "case_id long, r boolean, v boolean, run array<string>, ready array<string>, active string")
    return frame.select("case_id", R.is_exclusively_ready(F.lit("m"), F.col("r"), F.col("v"), F.col("run"), F.col("ready"), F.col("active")).alias("ok"))


@case("task_states", _want("case_id long, resumes boolean, status string", (1, True, "pending"), (2, False, "completed"), (3, False, "pending"), (4, True, "error"), (5, False, "completed")))
def task_states(spark, sf_dir):
    rows = [
        (1, "pending", ["completed", "pending"], 0, 3, 9, True), (2, "processing", ["completed"], 1, 3, 3, True), (3, "processing", ["completed", "processing"], 1, 1, 9, True),
        (4, "error", None, 0, 2, None, False), (5, "processing", None, 0, 9, 9, False),
    ]
    frame = spark.createDataFrame(rows, "case_id long, s string, b array<string>, results int, done int, pages int, loaded boolean")
    batches = F.coalesce("b", F.array().cast("array<string>"))
    return frame.select("case_id", R.resumes(F.col("s"), F.col("b"), F.col("done"), F.col("pages")).alias("resumes"), R.reconciled_status(F.col("s"), batches, F.col("results"), F.col("done"), F.col("pages"), F.col("loaded")).alias("status"))


@case("plan_checks", _want("case_id long, replans boolean", (1, True), (2, False), (3, True), (4, False), (5, False)))
def plan_checks(spark, sf_dir):
    rows = [(1, "pdf", True, 5, [], 1), (2, "pdf", True, 5, [("completed", 1)], 2), (3, "office", True, 5, [("pending", 1)], 2), (4, "image", True, 5, [], 1), (5, "pdf", True, 5, [("pending", 4)], 4)]
    frame = spark.createDataFrame(rows, "case_id long, k string, src boolean, pages int, b array<struct<status:string,pages:int>>, planned int")
    return frame.select("case_id", R.replans(F.col("k"), F.col("src"), F.col("pages"), F.col("b"), F.col("planned"), F.lit(4)).alias("replans"))


STATES = Fixture("case_id long, m boolean, h boolean, a boolean, v boolean", ((1, True, True, True, True), (2, False, True, True, True), (3, False, False, True, True), (4, False, False, True, False), (5, False, False, False, False)), "SELECT doc_id AS case_id, doc_id % 7 = 0 AS m, doc_id % 3 = 0 AS h, doc_id % 2 = 0 AS a, doc_id % 2 = 0 AND n_chars % 2 = 0 AS v FROM {documents}")


@query("runtime_states", f"SELECT case_id, CASE WHEN m THEN 'missing' WHEN h THEN 'ready' WHEN v THEN 'starting' WHEN a THEN 'partial' ELSE 'stopped' END AS state FROM {STATES.sql()}")
def runtime_states(spark, sf_dir):
    return STATES.frame(spark, sf_dir).select("case_id", R.runtime_state(F.col("m"), F.col("h"), F.lit("ready"), F.col("a"), F.col("v")).alias("state"))


LEASES = Fixture("case_id long, l string, m string, c double, e double", ((1, "a", "m", 1.0, 2.0), (2, "a", "m", 1.0, None), (3, "", "m", 1.0, 2.0), (4, "a", "m", 3.0, 2.0), (5, "a", "m", float("inf"), None), (6, "a", "", 1.0, 2.0)), "SELECT event_id AS case_id, CASE WHEN event_id % 5 > 0 THEN 'l' || event_id ELSE '' END AS l, CASE WHEN event_id % 7 > 0 THEN event_type END AS m, value AS c, CASE WHEN event_id % 3 > 0 THEN value + event_id % 5 - 1 END AS e FROM {events}")


@query("lease_checks", f"SELECT case_id, l <> '' AND m IS NOT NULL AND isfinite(c) AND (e IS NULL OR isfinite(e) AND e >= c) AS valid FROM {LEASES.sql()}")
def lease_checks(spark, sf_dir):
    return LEASES.frame(spark, sf_dir).select("case_id", R.valid_lease(F.col("l"), F.col("m"), F.col("c"), F.col("e")).alias("valid"))


@case("image_sources", _want("case_id long, source string, cjk boolean", (1, "https://x/a.png", False), (2, "ocr_images/q", False), (3, "data:image/jpeg;base64,漢", True), (4, "data:image/jpeg;base64,", None)))
def image_sources(spark, sf_dir):
    frame = spark.createDataFrame([(1, "https://x/a.png"), (2, "ocr_images/q"), (3, "漢"), (4, None)], "case_id long, v string")
    return frame.select("case_id", R.image_source(F.col("v")).alias("source"), R.has_cjk(F.col("v")).alias("cjk"))


@query("source_meta", "SELECT doc_id, CASE lang WHEN 'en' THEN 'PDF' WHEN 'de' THEN 'Image' ELSE 'Office as PDF · ' || source END || ' · ' || n_chars || CASE WHEN n_chars = 1 THEN ' page' ELSE ' pages' END AS meta FROM documents")
def source_meta(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "pdf").when(F.col("lang") == "de", "image").otherwise("office")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" · ", R.source_label(kind, F.col("source")), R.page_count_label(F.col("n_chars"))).alias("meta"))


@case("image_names", _want("case_id long, names string", (1, "ocr_images/b1_a_b.png=x,ocr_images/b1_c.png=y")))
def image_names(spark, sf_dir):
    frame = spark.createDataFrame([(1, {"a/b.png": "x", "c.png": "y"})], "case_id long, m map<string,string>")
    entries = F.array_sort(F.map_entries(R.namespaced(F.col("m"), F.lit("b1"))))
    return frame.select("case_id", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("names"))


@query(
    "benchmark_ngrams",
    r"""
    SELECT item_id, count(*) AS grams, count(DISTINCT g) AS distinct_grams FROM (
      SELECT item_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark)))
    GROUP BY item_id
    """,
)
def benchmark_ngrams(spark, sf_dir):
    grams = R.ngrams(F.col("text"), 3)
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(grams).cast("long").alias("grams"), F.size(F.array_distinct(grams)).cast("long").alias("distinct_grams")).filter("grams > 0")


JSONS = Fixture("case_id long, t string", ((1, '{"a":1}'), (2, '{"a":1,"a":2}'), (3, "[1]"), (4, "{bad"), (5, "null"), (6, "{}"), (7, '{"a":{"b":[1,2]},"c":"x"}'), (8, "7")), "SELECT event_id AS case_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '[' || event_id || ']' WHEN 2 THEN '{{bad' ELSE '{{\"a\":1,\"a\":' || event_id || '}}' END AS t FROM {events}")


@query("strict_json", f"SELECT case_id, CASE WHEN json_valid(t) THEN json_type(t) = 'OBJECT' AND len(json_keys(t)) = len(list_distinct(json_keys(t))) ELSE false END AS kept FROM {JSONS.sql()}")
def strict_json(spark, sf_dir):
    return JSONS.frame(spark, sf_dir).select("case_id", R.strict_object(F.col("t")).isNotNull().alias("kept"))


CONTENTS = Fixture(
    "case_id long, k string, c string",
    ((1, "title", " T "), (2, "title", "# given"), (3, "equation", "x"), (4, "formula", "$x$"), (5, "code", "c"), (6, "title", " "), (7, "text", "plain"), (8, "code", "```\nd\n```"), (9, "equation_block", "\\[y\\]"), (10, "formula", " z ")),
    "SELECT doc_id AS case_id, CASE doc_id % 6 WHEN 0 THEN 'title' WHEN 1 THEN 'equation' WHEN 2 THEN 'code' WHEN 3 THEN 'formula' WHEN 4 THEN 'text' ELSE 'table' END AS k, replace(substr(text, 1, 60), chr(10), ' ') AS c FROM {documents}",
)


@query(
    "content_formats",
    f"""
    SELECT case_id, CASE WHEN t = '' THEN '' WHEN k = 'title' AND t NOT LIKE '#%' THEN '# ' || t
      WHEN k IN ('equation', 'equation_block', 'formula') AND NOT (t LIKE '$%' OR starts_with(t, chr(92) || '(') OR starts_with(t, chr(92) || '[')) THEN '$$' || chr(10) || t || chr(10) || '$$'
      WHEN k = 'code' AND NOT starts_with(t, '```') THEN '```' || chr(10) || t || chr(10) || '```' ELSE t END AS markdown FROM (SELECT *, trim(c) AS t FROM {CONTENTS.sql()})
    """,
)
def content_formats(spark, sf_dir):
    return CONTENTS.frame(spark, sf_dir).select("case_id", R.content_format(F.col("k"), F.col("c")).alias("markdown"))


@query(
    "text_hashes",
    """
    SELECT item_id, lower(to_base(list_reduce([0::BIGINT] || u, lambda h, c: (h * 31 + c) & 4294967295), 36)) AS h31, lower(to_base(list_reduce([5381::BIGINT] || u, lambda h, c: xor((h * 33) & 4294967295, c)), 36)) AS h33
    FROM (SELECT item_id, list_transform(string_split(text, ''), lambda c: ord(c)::BIGINT) AS u FROM benchmark)
    """,
)
def text_hashes(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", R.hash31(F.col("text")).alias("h31"), R.hash33(F.col("text")).alias("h33"))


@case("point_boxes", _want("case_id long, box string", (1, "10,20,30,40"), (2, "0,5,100,50"), (3, "25,50,75,100"), (4, "2,4,100,200")))
def point_boxes(spark, sf_dir):
    rows = [(1, [30.0, 20.0, 10.0, 40.0]), (2, [-5.0, 5.0, 120.0, 5.0, 120.0, 50.0, -5.0, 50.0]), (3, [0.25, 0.25, 0.75, 0.5]), (4, [2.5, 3.5, 500.0, 900.0])]
    frame = spark.createDataFrame(rows, "case_id long, p array<double>")
    return frame.select("case_id", F.array_join(R.point_box(F.col("p"), F.lit(100), F.lit(200)), ",").alias("box"))


MEASURED = Fixture(
    "case_id long, p string, b array<double>, w int, h int",
    ((1, "HPD-parsing", (1.0, 2.0, 900.0, 1000.0), 800, 600), (2, "other", (1.0, 2.0, 3.0, 4.0), 800, 600), (3, "unlimited-ocr", (1.0, 2.0, 3.0, 4.0), 1024, 1024), (4, "unlimited-ocr", (1.0, 2.0, 3.0, 4.0), 1024, 768),
     (5, "x", (1.0, 2.0, 3.0, 4.0), 0, 9), (6, "hpd-parsing", (1.0, -1001.0, 3.0, 4.0), 80, 90), (7, "hpd-parsing", (1.0, 2.0), 80, 90)),
    "SELECT vec_id AS case_id, CASE vec_id % 3 WHEN 0 THEN 'HPD-parsing' WHEN 1 THEN 'other' ELSE 'unlimited-ocr' END AS p, @array(floor(abs(@at(embedding, 1)) * 4000@single), floor(abs(@at(embedding, 2)) * 4000@single), floor(abs(@at(embedding, 3)) * 4000@single), floor(abs(@at(embedding, 4)) * 4000@single)) AS b, CASE WHEN vec_id % 5 > 0 THEN 800 ELSE 1024 END AS w, CASE WHEN vec_id % 5 > 0 THEN 600 ELSE 1024 END AS h FROM {embeddings} WHERE embedding IS NOT NULL",
)


@query(
    "coordinate_bounds",
    f"""
    SELECT case_id, CASE WHEN w = 0 OR h = 0 THEN NULL WHEN len(b) >= 4 AND list_max(list_transform(b[1:4], lambda x: abs(x))) <= 1000.5 AND (lower(p) = 'hpd-parsing' OR lower(p) = 'unlimited-ocr' AND w = 1024 AND h = 1024)
      THEN '1000.0,1000.0' ELSE w::DOUBLE || ',' || h::DOUBLE END AS bounds FROM {MEASURED.sql()}
    """,
)
def coordinate_bounds(spark, sf_dir):
    return MEASURED.frame(spark, sf_dir).select("case_id", F.array_join(R.coordinate_bounds(F.col("p"), F.col("b"), F.col("w"), F.col("h")), ",").alias("bounds"))


@query("stream_pages", "SELECT conv_id, turn, least(greatest(turn, 2), 4)::BIGINT AS page FROM conversations")
def stream_pages(spark, sf_dir):
    page = R.clamped_page(F.col("turn"), F.lit(2).cast("long"), F.lit(3).cast("long"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", page.alias("page"))


PLACED = Fixture("doc_id long, page int, ord long, label string", ((1, 0, 0, "title"), (1, 0, 1, "text"), (1, 2, 2, "image"), (2, 0, 0, "text")), "SELECT conv_id AS doc_id, turn % 3 AS page, turn AS ord, role AS label FROM {conversations}")


SPINES = Fixture("doc_id long, pages int", ((1, 3), (2, 1), (3, 0)), "SELECT DISTINCT conv_id AS doc_id, 1 + conv_id % 4 AS pages FROM {conversations}")


@query(
    "page_spine",
    f"""
    SELECT d.doc_id, d.page, count(b.ord) AS n_blocks, coalesce(string_agg(b.label, ',' ORDER BY b.ord), '') AS labels
    FROM (SELECT doc_id, unnest(range(0, greatest(pages, 1)))::INTEGER AS page FROM {SPINES.sql()}) d LEFT JOIN {PLACED.sql()} b ON d.doc_id = b.doc_id AND d.page = b.page GROUP BY d.doc_id, d.page
    """,
)
def page_spine(spark, sf_dir):
    return results.page_spine(SPINES.frame(spark, sf_dir), PLACED.frame(spark, sf_dir), "doc_id", F.col("pages"))


@query("document_texts", "SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def document_texts(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("page"), "text")
    return results.document_text(pages, "conv_id", "\n\n---\n\n", keep_empty=True)


@case("render_blocks", _want("doc_id long, page int, idx int, label string, content string", (1, 7, 0, "text", "shown"), (1, 7, 1, "image", ""), (1, 2, 0, "title", "T")))
def render_blocks(spark, sf_dir):
    block = "block_bbox array<double>, bbox array<double>, block_label string, label string, block_content string, text string"
    box = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, 0, 7, [(box, None, "text", None, "shown", None), (None, box, "", "image", None, None), (box, None, "footer", None, "x", None), ([1.0], None, "text", None, "x", None), (box, None, "text", None, " ", None)]), (1, 1, 0, [(None, box, None, "title", None, "T")]), (2, 0, 1, None)]
    frame = spark.createDataFrame(rows, f"doc_id long, pos int, page int, blocks array<struct<{', '.join(x.replace(' ', ':', 1) for x in block.split(', '))}>>")
    return results.render_blocks(frame, "doc_id", ["footer"])


@query("edited_lines", "SELECT d.doc_id, CASE WHEN quality = 0 THEN 'edited' ELSE source END AS text FROM documents d LEFT JOIN labels USING (doc_id)")
def edited_lines(spark, sf_dir):
    edits = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id", F.lit("edited").alias("text"))
    return results.edited(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("text")), edits, ["doc_id"])


IMAGES = Fixture("page_id long, m string", ((1, 'a <img src="images/bbox_1_2_3_4.jpg"> b <img src="images/bbox_5_6_7_8.jpg" />'), (2, "none"), (3, '<img src="images/bbox_10_0_30_40.jpg">')), "SELECT page_id, 'a <img src=\"images/bbox_' || page_id || '_2_3_4.jpg\"> ' || substr(html, 1, 100) || CASE WHEN page_id % 2 = 0 THEN ' <img src=\"images/bbox_5_6_' || page_id % 100 || '_8.jpg\" />' ELSE '' END AS m FROM {pages}")


@query(
    "box_images",
    f"""
    SELECT page_id, (i - 1)::INTEGER AS idx, array_to_string(list_transform(string_split(found[i], '_'), lambda x: x::DOUBLE), ',') AS box
    FROM (SELECT page_id, found, unnest(range(1, len(found) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(m, 'bbox_(\\d+_\\d+_\\d+_\\d+)', 1) AS found FROM {IMAGES.sql()}))
    """,
)
def box_images(spark, sf_dir):
    return results.box_images(IMAGES.frame(spark, sf_dir), ["page_id"], "m").select("page_id", "idx", F.array_join("box", ",").alias("box"))


@case("current_position", _want("doc_id long, page int, progress double", (1, 1, 0.2), (2, 3, 0.0), (3, 2, 0.5)))
def current_position(spark, sf_dir):
    rows = [(1, 0, 1, [0.0, 100.0, 1.0, 300.0], "text"), (1, 1, 2, [0.0, 0.0, 1.0, 1.0], "heuristic"), (2, 0, 3, None, "text"), (3, 0, 1, [0.0, 0.0, 1.0, 10.0], "heuristic"), (3, 1, 2, [0.0, 400.0, 1.0, 600.0], "heuristic")]
    return results.current_position(spark.createDataFrame(rows, "doc_id long, ord long, page int, box array<double>, confidence string"), "doc_id")


@query("new_suffix", "SELECT conv_id, turn FROM conversations c WHERE turn >= (SELECT min(turn) FROM conversations x WHERE x.conv_id = c.conv_id AND (x.turn % 3 = 2 OR x.turn > 3))")
def new_suffix(spark, sf_dir):
    new = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5("text").alias("mark"))
    old = new.filter("turn <= 3").withColumn("mark", F.when(F.col("turn") % 3 == 2, "changed").otherwise(F.col("mark")))
    return results.new_suffix(old, new, ["conv_id"], "turn", "mark").select("conv_id", "turn")


ATTEMPTS = Fixture("key long, attempt int, error string", ((1, 1, "oom"), (1, 2, "oom"), (1, 3, None), (1, 4, None), (2, 1, "other"), (2, 2, None), (3, 1, None), (4, 1, "oom")), "SELECT user_id AS key, event_id AS attempt, CASE event_type WHEN 'error' THEN 'oom' WHEN 'view' THEN 'other' END AS error FROM {events}")


@query(
    "first_success",
    f"""
    SELECT key, min(attempt) AS attempt FROM {ATTEMPTS.sql()} a WHERE error IS NULL
      AND NOT EXISTS (SELECT 1 FROM {ATTEMPTS.sql()} b WHERE b.key = a.key AND b.attempt < a.attempt AND b.error <> 'oom') GROUP BY key
    """,
)
def first_success(spark, sf_dir):
    return results.first_success(ATTEMPTS.frame(spark, sf_dir), "key", "attempt")


@case("result_markdown", _want("case_id long, markdown string, light string", (1, "top", '{"markdown":"top","a":[{"markdown":"x"}]}'), (2, "p1\n\np2", '{"pages":[{"markdown":{"text":"p1"}},{"markdown":"p2"},{"markdown":"p1"}]}'), (3, None, None)))
def result_markdown(spark, sf_dir):
    rows = [(1, '{"markdown":"top","a":[{"markdown":"x","inputImage":"big"}]}'), (2, '{"pages":[{"markdown":{"text":"p1"}},{"markdown":"p2","outputImages":{"a":1}},{"markdown":"p1"}]}'), (3, "broken")]
    frame = spark.createDataFrame(rows, "case_id long, t string")
    return frame.select("case_id", results.result_markdown("t").alias("markdown"), results.light_json("t", "inputImage", "outputImages").alias("light"))


@case("stashed_math", _want("case_id long, text string, restored boolean", (1, "a @@math0@@ b @@math1@@", True), (2, "plain", True), (3, "@@math0@@ and @@math1@@", True)))
def stashed_math(spark, sf_dir):
    frame = spark.createDataFrame([(1, "a $x$ b $$y\nz$$"), (2, "plain"), (3, "\\(q\\) and \\[r\\]")], "case_id long, t string").withColumn("s", results.stashed("t"))
    return frame.select("case_id", "s.text", (results.unstashed(F.col("s.text"), F.col("s.math")) == F.col("t")).alias("restored"))
