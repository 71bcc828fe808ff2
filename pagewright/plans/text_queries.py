"""Text rules over documents and fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce as C
from ..functions import geometry as G
from ..functions import text as T
from ..operators import linking, messages, repetition, tables
from .registry import Fixture, case, query, table

# DuckDB spellings of the shared rules.
STRIP = r"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"
NEWLINES = "replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
COMPACT = STRIP.format(x=r"regexp_replace(regexp_replace(" + NEWLINES + r", '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
ANCHOR = "array_to_string(regexp_extract_all(lower({x}), '[a-z0-9]+'), ' ')"
_PUNCTUATION = """[{{}}^_`~|()\\[\\]<>#*_.,:;''"!?，。；：！？、]"""
_BARE = r"regexp_replace(regexp_replace({x}, '\$+', ' ', 'g'), '\\[a-zA-Z]+', ' ', 'g')"
MATCH = "lower(" + STRIP.format(x=rf"regexp_replace(regexp_replace({_BARE}, '{_PUNCTUATION}', ' ', 'g'), '\s+', ' ', 'g')") + ")"


@query("compact_text", f"SELECT doc_id, {COMPACT.format(x='text')} AS text FROM documents")
def compact_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.compact(F.col("text")).alias("text"))


TEXTS = Fixture("case_id long, text string", ((1, "a\r\nb\rc"), (2, "  x \t y\n\n\n\n z  "), (3, ""), (4, None), (5, "\n\n"), (6, "one\n\ntwo")), "SELECT doc_id AS case_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN replace(substr(text, 1, 400), ' ', chr(9) || '  ') || chr(13) || chr(10) ELSE '  ' || text || chr(10) || chr(10) || chr(10) || lang END AS text FROM {documents}")


@query("compact_cases", f"SELECT case_id, {COMPACT.format(x='text')} AS text FROM {TEXTS.sql()}")
def compact_cases(spark, sf_dir):
    return TEXTS.frame(spark, sf_dir).select("case_id", T.compact(F.col("text")).alias("text"))


@query("anchor_normalize", f"SELECT doc_id, {ANCHOR.format(x='text')} AS text FROM documents")
def anchor_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.anchor_words(F.col("text")).alias("text"))


@query("match_normalize", f"SELECT doc_id, {MATCH.format(x='text')} AS text FROM documents")
def match_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.match_text(F.col("text")).alias("text"))


@query("escape_html", "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS text FROM documents")
def escape_html(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.escape_html(F.col("text")).alias("text"))


@query(
    "longest_line",
    "SELECT doc_id, max(length(line))::BIGINT AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id",
)
def longest_line(spark, sf_dir):
    lines = F.transform(F.split("text", "\n"), F.length)
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.array_max(lines).cast("long").alias("longest"))


ROOMY = STRIP.format(x=r"regexp_replace(line, '\s+', ' ', 'g')")


@query(
    "repeat_lines",
    f"""
    WITH l AS (
      SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS pos
      FROM (SELECT doc_id, string_split(lower({NEWLINES.format(x='text')}), chr(10)) AS s FROM documents)
    ), c AS (SELECT doc_id, {ROOMY} AS line, pos FROM l),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS k FROM c WHERE length(line) >= 24)
    SELECT doc_id, line, count(*) AS n FROM r WHERE k <= 32 GROUP BY doc_id, line HAVING count(*) >= 4
    """,
)
def repeat_lines(spark, sf_dir):
    return repetition.repeated_lines(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query(
    "ngram_runs",
    rf"""
    WITH w AS (
      SELECT doc_id, regexp_extract_all(lower(right({NEWLINES.format(x='text')}, 4000)), '[A-Za-z][A-Za-z-]+|[0-9]+') AS w FROM documents
    ), s AS (SELECT doc_id, w, unnest([3, 4, 5, 6]) AS n FROM w WHERE len(w) >= 48),
    g AS (SELECT doc_id, n, p, list_slice(w, p + 1, p + n) AS g FROM (SELECT doc_id, n, w, unnest(range(0, len(w) - n + 1)) AS p FROM s)),
    f AS (
      SELECT doc_id, n, p, array_to_string(g, ' ') AS gram FROM g
      WHERE list_sum(list_transform(g, lambda x: length(x))) >= 12
        AND len(list_filter(g, lambda x: NOT regexp_full_match(x, '[0-9]+'))) > 0
        AND len(list_filter(g, lambda x: x IN ('td','tr','th','li','left','right','text','rowspan','colspan'))) < 2
    ), d AS (SELECT *, p - lag(p) OVER (PARTITION BY doc_id, n, gram ORDER BY p) AS gap FROM f),
    i AS (
      SELECT *, coalesce(sum(CASE WHEN gap > n THEN 1 ELSE 0 END) OVER q, 0) AS near,
             coalesce(sum(CASE WHEN gap > n + 3 THEN 1 ELSE 0 END) OVER q, 0) AS wide
      FROM d WINDOW q AS (PARTITION BY doc_id, n, gram ORDER BY p)
    ), a AS (SELECT doc_id, n, gram, max(c) AS longest_exact FROM (SELECT doc_id, n, gram, near, count(*) AS c FROM i GROUP BY ALL) GROUP BY ALL),
    b AS (SELECT doc_id, n, gram, max(c) AS longest_dense FROM (SELECT doc_id, n, gram, wide, count(*) AS c FROM i GROUP BY ALL) GROUP BY ALL)
    SELECT doc_id, n::INTEGER AS n, gram, longest_exact, longest_dense FROM a JOIN b USING (doc_id, n, gram)
    WHERE longest_exact >= 4 OR (longest_dense >= 12 AND gram <> 'arxiv preprint arxiv')
    """,
)
def ngram_runs(spark, sf_dir):
    return repetition.ngram_runs(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


TRACES = Fixture(
    "case_id long, text string",
    (
        (1, "1: while x\n2: text [1, 2, 3, 4]\n3: text [5, 6, 7, 8]\n end while"), (2, "plain words\nand more"),
        (3, "1: a\n2: b\n3: c\n4: d\n5: e\n6: f\nend if\noutput: x"), (4, "<|det|>text [1,2,3,4]<|/det|> 1: a"), (5, None),
        (6, "text [1, 2, 3, 4] text [1, 2, 3] text [9, 9, 9, 9]\nEnd  While end if"),
    ),
    "SELECT doc_id AS case_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '1: ' || substr(text, 1, 30) || chr(10) || '2: text [1, 2, 3, ' || doc_id || ']' || chr(10) || '3: text [5, 6, 7, 8]' || chr(10) || ' 4 : z' WHEN 2 THEN '1: a' || chr(10) || '2: b' || chr(10) || '3: c' || chr(10) || '4: d' || chr(10) || '5: e' || chr(10) || '6: ' || lang || chr(10) || 'end if' || chr(10) || 'output: ' || n_chars ELSE '<|det|>' || substr(text, 1, 50) END AS text FROM {documents}",
)


@query(
    "structural_artifacts",
    rf"""
    WITH t AS (SELECT case_id, {NEWLINES.format(x='text')} AS x FROM {TRACES.sql()}),
    c AS (SELECT case_id, x, len(regexp_extract_all(x, '(?i)\btext\s*\[[^\]\n]*-?\d+(?:\.\d+)?\s*,\s*-?\d+(?:\.\d+)?\s*,\s*-?\d+(?:\.\d+)?\s*,\s*-?\d+(?:\.\d+)?\s*\]')) AS boxes,
             len(list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '^\s*[0-9]{{1,3}}\s*:'))) AS numbered,
             len(regexp_extract_all(x, '(?i)\b(?:end\s+while\b|end\s+if\b|output:)')) AS traces FROM t)
    SELECT case_id, CASE WHEN contains(x, '<|det|>') THEN NULL WHEN boxes >= 2 AND (numbered >= 3 OR traces >= 2) THEN 'layout coordinate trace'
                         WHEN numbered >= 6 AND traces >= 2 THEN 'decoder trace' END AS artifact FROM c
    """,
)
def structural_artifacts(spark, sf_dir):
    return TRACES.frame(spark, sf_dir).select("case_id", T.structural_artifact(F.col("text")).alias("artifact"))


RESTARTS = Fixture(
    "case_id long, text string",
    ((1, "A title line\nbody one\nbody two\nA title line\nbody one"), (2, "short\nx\ny\nshort"), (3, "A title line\nA title line\nb"), (4, "\n\nSome heading\n\nq\nr\n  Some heading  \nq"), (5, ""), (6, "no repeat at all\nhere")),
    "SELECT doc_id AS case_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || substr(text, 1, 300) ELSE text END AS text FROM {documents}",
)


@query(
    "restart_truncate",
    f"""
    WITH l AS (
      SELECT case_id, text, unnest(s) AS line, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT case_id, text, string_split(text, chr(10)) AS s FROM {RESTARTS.sql()})
    ), f AS (SELECT *, {STRIP.format(x='line')} AS t FROM l),
    k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos) - 1 AS k, first_value(t) OVER (PARTITION BY case_id ORDER BY pos) AS head FROM f WHERE t <> ''),
    cut AS (SELECT case_id, min(pos) AS cut FROM k WHERE k >= 2 AND t = head AND length(head) >= 8 GROUP BY case_id),
    j AS (SELECT l.case_id, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '\\s+$', '') AS kept FROM l JOIN cut USING (case_id) WHERE pos < cut GROUP BY l.case_id)
    SELECT v.case_id, coalesce(kept, v.text) AS text FROM {RESTARTS.sql()} v LEFT JOIN j USING (case_id)
    """,
)
def restart_truncate(spark, sf_dir):
    return repetition.first_lines_only(RESTARTS.frame(spark, sf_dir), "case_id", F.col("text"))


@query("repeat_tail")
def repeat_tail(spark, sf_dir):
    return repetition.without_repeated_tail(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


WORDS8 = "list_slice(string_split(" + ANCHOR + ", ' '), 1, 8)"


@query(
    "anchor_join",
    f"""
    WITH a AS (SELECT item_id, ' ' || array_to_string(w, ' ') || ' ' AS anchor FROM (SELECT item_id, {WORDS8.format(x='text')} AS w FROM benchmark) WHERE len(w) >= 8),
    p AS (SELECT doc_id, ' ' || {ANCHOR.format(x='text')} || ' ' AS words FROM documents)
    SELECT doc_id, item_id FROM p JOIN a ON contains(words, anchor)
    """,
)
def anchor_join(spark, sf_dir):
    return linking.anchor_pages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


PAIRS = Fixture(
    "element_id long, ord long, element string, block string",
    (
        (1, 0, "alpha beta gamma", "alpha beta gamma"), (1, 1, "alpha beta gamma", "alpha beta gamma delta"), (2, 0, "alpha beta", "zeta eta theta"),
        (2, 1, "alpha beta", "x alpha beta y and a lot more of this text here"), (2, 2, "alpha beta", "alpha beta z"), (3, 0, "one two three four", "one two"),
        (4, 0, "", "a"), (5, 0, "to of in", "ab"), (6, 0, "lorem ipsum dolor", "ipsum and dolor but"), (7, 0, "same", "same"), (7, 1, "same", "same"),
    ),
    "SELECT doc_id AS element_id, k AS ord, lower(substr(text, 1, 30)) AS element, lower(substr(text, 1 + 8 * k, 20 + 10 * k)) AS block FROM {documents} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) AS ks WHERE text IS NOT NULL",
)
SCORE = """CASE WHEN element = '' OR block = '' THEN 0.0 WHEN element = block THEN 1.0
  WHEN contains(block, element) THEN least(0.98, length(element) / length(block) + 0.62)
  WHEN contains(element, block) THEN least(0.96, length(block) / length(element) + 0.55)
  WHEN len(list_filter(string_split(element, ' '), lambda w: length(w) > 2)) = 0 THEN 0.0
  ELSE len(list_filter(string_split(element, ' '), lambda w: length(w) > 2 AND contains(block, w))) / len(list_filter(string_split(element, ' '), lambda w: length(w) > 2)) END"""


@query("match_scores", f"SELECT element_id, ord, round(({SCORE})::DOUBLE, 6) AS score FROM {PAIRS.sql()}")
def match_scores(spark, sf_dir):
    return PAIRS.frame(spark, sf_dir).select("element_id", "ord", F.round(T.match_score(F.col("element"), F.col("block")), 6).alias("score"))


@query(
    "best_matches",
    f"""
    WITH s AS (SELECT element_id, ord, ({SCORE})::DOUBLE AS score FROM {PAIRS.sql()}), k AS (SELECT * FROM s WHERE score >= 0.55)
    SELECT element_id, coalesce(min(ord) FILTER (WHERE score >= 0.92), arg_max(ord, score - ord * 1e-9)) AS ord FROM k GROUP BY element_id
    """,
)
def best_matches(spark, sf_dir):
    pairs = PAIRS.frame(spark, sf_dir).withColumn("score", T.match_score(F.col("element"), F.col("block")))
    return linking.best_matches(pairs, "element_id", "ord")


@query(
    "greedy_links",
    rf"""
    WITH RECURSIVE p AS (
      SELECT doc_id, side, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS ord FROM (
        SELECT doc_id, 1 AS side, string_split(text, '. ') AS s FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 0, string_split(text, chr(10)) FROM documents WHERE text IS NOT NULL)
    ), m AS (SELECT doc_id, side, ord, {MATCH.format(x="t")} AS text FROM p),
    e AS (SELECT doc_id, ord, text, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM m WHERE side = 1 AND length(text) >= 2),
    b AS (SELECT doc_id, ord, text FROM m WHERE side = 0
    ), f AS (
      SELECT DISTINCT doc_id, 0::BIGINT AS k, 0::BIGINT AS cursor, NULL::BIGINT AS element, NULL::BIGINT AS block, NULL::DOUBLE AS score FROM e
      UNION ALL
      SELECT doc_id, k, coalesce(CASE WHEN near.ord IS NOT NULL THEN near.ord ELSE best.ord END, cursor), element, CASE WHEN near.ord IS NOT NULL THEN near.ord ELSE best.ord END, CASE WHEN near.ord IS NOT NULL THEN near.score ELSE best.score END
      FROM (
        SELECT doc_id, k, any_value(cursor) AS cursor, any_value(element) AS element,
               min(struct_pack(ord := ord, score := score)) FILTER (WHERE score >= 0.92) AS near,
               max(struct_pack(score := score, back := -ord, ord := ord)) FILTER (WHERE score >= 0.55) AS best
        FROM (
          SELECT doc_id, k, cursor, e_ord AS element, ord, ({SCORE})::DOUBLE AS score
          FROM (SELECT f.doc_id, e.k, f.cursor, e.ord AS e_ord, e.text AS element, b.ord, b.text AS block
                FROM f JOIN e ON e.doc_id = f.doc_id AND e.k = f.k + 1 LEFT JOIN b ON b.doc_id = f.doc_id AND b.ord >= f.cursor - 1 AND b.ord < f.cursor + 18)
        ) GROUP BY doc_id, k
      )
    )
    SELECT doc_id, element, block, score FROM f WHERE block IS NOT NULL
    """,
)
def greedy_links(spark, sf_dir):
    """Sentences of documents linked in order to their own lines."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    elements = docs.select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("ord", "text"))
    blocks = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return linking.link_in_order(elements, blocks, "doc_id")


VALUES = Fixture(
    "case_id long, raw string",
    ((1, " YES "), (2, "0"), (3, None), (4, "12"), (5, " -3x"), (6, "999"), (7, ""), (8, "on"), (9, "1e3"), (10, "2024-01-02T03:04:05Z"), (11, "abc"), (12, "1700000000"), (13, "99999999999999999999")),
    "SELECT event_id AS case_id, CASE event_id % 9 WHEN 0 THEN ' ' || event_id || ' ' WHEN 1 THEN event_type WHEN 2 THEN NULL WHEN 3 THEN ' -' || user_id || 'x' WHEN 4 THEN 'On' WHEN 5 THEN '2024-01-' || lpad(CAST(event_id % 28 + 1 AS STRING), 2, '0') || 'T03:04:05Z' WHEN 6 THEN '1700' || lpad(CAST(event_id % 1000000 AS STRING), 6, '0') WHEN 7 THEN '' ELSE event_id || '9999999999999999' END AS raw FROM {events}",
)


@query(
    "coercions",
    rf"""
    SELECT case_id, CASE WHEN raw IS NULL THEN true ELSE lower({STRIP.format(x='raw')}) IN ('1', 'true', 'yes', 'on') END AS flag,
           greatest(1, coalesce(CASE WHEN regexp_full_match(raw, '\s*[+-]?[0-9]+\s*') THEN try_cast(raw AS INTEGER) END, 5)) AS floored,
           coalesce(least(400, greatest(1, try_cast(nullif(regexp_extract(raw, '^\s*([+-]?[0-9]+)', 1), '') AS HUGEINT)))::INTEGER, 1) AS batch,
           coalesce(try_cast(nullif({STRIP.format(x='raw')}, '') AS DOUBLE), epoch_us(CASE WHEN regexp_matches({STRIP.format(x='raw')}, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN try_cast({STRIP.format(x='raw')} AS TIMESTAMPTZ) END) / 1e6, 0) AS moment
    FROM {VALUES.sql()}
    """,
)
def coercions(spark, sf_dir):
    raw = F.col("raw")
    return VALUES.frame(spark, sf_dir).select("case_id", C.to_bool(raw, True).alias("flag"), C.at_least(raw, "int", 5, 1).alias("floored"), C.batch_size(raw).alias("batch"), C.epoch(raw).alias("moment"))


@query(
    "mixed_timestamps",
    "SELECT event_id, epoch_us(ts) / 1e6 AS moment, CASE WHEN value > 50 THEN epoch_us(ts) / 1e6 + value END AS expires FROM events",
)
def mixed_timestamps(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    moment = C.epoch(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return events.select("event_id", moment.alias("moment"), F.when(F.col("value") > 50, moment + F.col("value")).alias("expires"))


@query("url_origin", r"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) AS origin FROM pages")
def url_origin(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.origin(F.col("url")).alias("origin"))


PATHS = Fixture("case_id long, path string", ((1, "images/a.png"), (2, "/abs"), (3, "a/../b"), (4, "c:\\x"), (5, "a\\b"), (6, ""), (7, "./a"), (8, "a//b")), "SELECT page_id AS case_id, CASE page_id % 6 WHEN 0 THEN 'images/' || substr(url, 9) WHEN 1 THEN substr(url, 8) WHEN 2 THEN 'a/../' || page_id WHEN 3 THEN replace(url, '/', chr(92)) WHEN 4 THEN url ELSE 'p' || page_id || '.png' END AS path FROM {pages}")


@query(
    "safe_paths",
    "SELECT case_id, len(list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda p: p IN ('', '.', '..') OR contains(p, ':'))) = 0 AS safe, "
    f"regexp_full_match(path, '[A-Za-z0-9_-]{{6,80}}') AS task_id FROM {PATHS.sql()}",
)
def safe_paths(spark, sf_dir):
    return PATHS.frame(spark, sf_dir).select("case_id", C.is_safe_path(F.col("path")).alias("safe"), C.is_task_id(F.col("path")).alias("task_id"))


@query(
    "event_json",
    "SELECT event_id, event_type, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value FROM events WHERE json_valid(props) AND len(json_keys(props)) > 0",
)
def event_json(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "map<string,string>")).filter(F.size("p") > 0)
    return events.select("event_id", "event_type", F.element_at("p", F.get(F.json_object_keys("props"), F.lit(0))).alias("first_value"))


SSE = Fixture(
    "seq long, line string",
    ((1, 'data: {"choices":[{"delta":{"content":"Hel"}}]}'), (2, ": ping"), (3, 'data: {"choices":[{"delta":{"content":"lo"}}]}'), (4, "data: broken"), (5, "data: [DONE]"), (6, 'data: {"choices":[{"delta":{"content":"late"}}]}')),
    "SELECT doc_id AS seq, CASE doc_id % 5 WHEN 0 THEN ': ping' WHEN 1 THEN 'data: broken' ELSE 'data: {{\"choices\":[{{\"delta\":{{\"content\":\"' || source || '\"}}}}]}}' END AS line FROM {documents}",
)


@query(
    "sse_deltas",
    f"""
    WITH v AS (SELECT seq, substr(line, 7) AS data FROM {SSE.sql()} WHERE starts_with(line, 'data: ')), e AS (SELECT min(seq) AS stop FROM v WHERE data = '[DONE]')
    SELECT seq, json_extract_string(data, '$.choices[0].delta.content') AS content FROM v, e
    WHERE seq < coalesce(stop, 9223372036854775807) AND CASE WHEN json_valid(data) THEN json_extract_string(data, '$.choices[0].delta.content') IS NOT NULL ELSE false END
    """,
)
def sse_deltas(spark, sf_dir):
    data = SSE.frame(spark, sf_dir).filter(F.col("line").startswith("data: ")).select("seq", F.expr("substr(line, 7)").alias("data"))
    stop = data.filter("data = '[DONE]'").agg(F.min("seq").alias("stop"))
    found = data.crossJoin(F.broadcast(stop)).filter("stop IS NULL OR seq < stop")
    return found.select("seq", F.get_json_object("data", "$.choices[0].delta.content").alias("content")).filter("content IS NOT NULL")


PROSE = Fixture(
    "case_id long, kind string, text string",
    (
        (1, "text", "A hyphen-\nated word\nand a line"), (2, "list", "- one\n- two\n\n3) three"), (3, "doc_title", "My title"), (4, "paragraph_title", "3.2.1 Method"),
        (5, "title", "IV. Results here"), (6, "section_title", "## Given level"), (7, "formula", "\\[ x = 1 \\]"), (8, "reference", "[12] A. Author, Title."), (9, "reference", "No number"),
        (10, "text", "Abstract - We show it."), (11, "text", "* starred"), (12, "figure_title", "Fig 1. A\nthing"), (13, "table_caption", "Table 2"), (14, "text", ""), (15, "title", "REFERENCES"),
        (16, "subtitle", "Words only"), (17, "title", "B) Letter"), (18, "title", "Words"), (19, "formula", "$$y$$"), (20, "formula", "  "),
        (21, "header", "Journal of things"), (22, "footer", "foot"), (23, "header_image", "x"), (24, "footer_image", "x"), (25, "page_number", "12"), (26, "page_num", "12"), (27, "number", "(3)"), (28, "seal", "s"),
        (29, "table", "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>"), (30, "text", "see <TABLE><tr><td>x</td></tr><tr><td>y</td></tr></TABLE> there"), (31, "table", "no rows"),
        (32, "image_caption", " "), (33, "text", "Keywords: a, b"), (34, "title", " "), (35, "text", "+ plus"), (36, "ref_text", "[3]"), (37, "text", None), (38, "equation", "$$a$$"), (39, "text", "摘要：无"), (40, "paragraph_title", "xi. Roman"),
    ),
    "SELECT doc_id AS case_id, CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'list' WHEN 2 THEN 'doc_title' WHEN 3 THEN 'paragraph_title' ELSE 'table' END AS kind, text FROM {documents}",
)
_NL = "chr(10)"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def prose_sql(x: str) -> str:
    """DuckDB's text of ``functions.text.prose``."""
    text = strip_sql(f"replace(replace({x}, chr(13) || {_NL}, {_NL}), chr(13), {_NL})")
    text = f"regexp_replace({text}, '([A-Za-z])-\\s*\\n\\s*([a-z])', '\\1\\2', 'g')"
    lines = f"list_filter(list_transform(string_split({text}, {_NL}), lambda l: {strip_sql("regexp_replace(l, '[ \\t]+', ' ', 'g')")}), lambda l: l <> '')"
    listed = f"len(list_filter({lines}, lambda l: NOT regexp_matches(l, '^(?:[-*+]\\s+|\\d+[.)]\\s+)'))) = 0"
    return f"(CASE WHEN {listed} THEN array_to_string({lines}, {_NL}) ELSE regexp_replace(array_to_string({lines}, ' '), '\\s+', ' ', 'g') END)"


def block_sql(rows: str) -> str:
    """DuckDB's text of ``functions.text.page_block``, over rows with ``kind, text`` and simple tables."""
    names = lambda *sets: ", ".join(f"'{x}'" for kinds in sets for x in kinds)
    cells = "list_transform(regexp_extract_all(r, '<t[hd]>(.*?)</t[hd]>', 1), lambda c: trim(c))"
    table_rows = f"list_transform(regexp_extract_all(tag, '(?i)<tr>(.*?)</tr>', 1), lambda r: '| ' || array_to_string({cells}, ' | ') || ' |')"
    marks = "list_transform(regexp_extract_all(regexp_extract(tag, '(?i)<tr>(.*?)</tr>', 1), '<t[hd]>'), lambda c: '---')"
    return f"""
      SELECT *, CASE
        WHEN coalesce(text, '') = '' OR kind IN ({names(T.PAGE_SKIPPED)}) THEN ''
        WHEN kind IN ({names(T.PAGE_TITLES)}) THEN CASE WHEN title = '' THEN '' ELSE repeat('#', level) || ' ' || title END
        WHEN kind IN ({names(T.PAGE_FORMULAS)}) THEN CASE WHEN formula = '' THEN '' ELSE '$$' || {_NL} || formula || {_NL} || '$$' END
        WHEN kind = 'table' OR contains(lower(text), '<table') THEN CASE WHEN tag = '' THEN text ELSE replace(text, tag, array_to_string(list_concat([({table_rows})[1]], list_concat(['| ' || array_to_string({marks}, ' | ') || ' |'], ({table_rows})[2:])), {_NL})) END
        WHEN kind IN ({names(T.PAGE_CAPTIONS)}) THEN CASE WHEN body = '' THEN '' ELSE '*' || body || '*' END
        WHEN kind = 'table_caption' THEN CASE WHEN body = '' THEN '' ELSE '**' || body || '**' END
        WHEN kind IN ({names(T.PAGE_REFERENCES)}) THEN CASE WHEN regexp_matches(body, '^\\[\\d+\\]') THEN regexp_replace(body, '(?s)^\\[(\\d+)\\]\\s*(.*)$', '\\1. \\2') ELSE '- ' || body END
        WHEN regexp_matches(body, '(?is)^(abstract|摘要|index terms|keywords|关键词)\\s*[—–:-]\\s*.+$') THEN '## ' || upper(body[1]) || lower(regexp_extract(body, '(?i)^(abstract|摘要|index terms|keywords|关键词)', 1)[2:]) || {_NL} || {_NL} || {strip_sql("regexp_extract(body, '(?is)^(?:abstract|摘要|index terms|keywords|关键词)\\s*[—–:-]\\s*(.+)$', 1)")}
        ELSE regexp_replace(body, '^[-*+]\\s+', '- ') END AS markdown
      FROM (SELECT *, CASE
          WHEN hashes <> '' THEN len(hashes) WHEN kind = 'doc_title' THEN 1
          WHEN regexp_matches(title, '(?i)^(?:[ivxlcdm]{{2,}}|[ivx])\\.\\s') THEN 2
          WHEN regexp_matches(title, '^\\d+(?:\\.\\d+)*[.)]?\\s') THEN least(6, 2 + len(string_split(regexp_extract(title, '^(\\d+(?:\\.\\d+)*)', 1), '.')) - 1)
          WHEN regexp_matches(title, '^[A-Z][.)]\\s') THEN 3 WHEN regexp_matches(title, '(?i)^(?:abstract|acknowledgments?|references|appendix\\b)') THEN 2
          WHEN kind IN ('paragraph_title', 'subtitle') THEN 3 ELSE 2 END AS level
        FROM (SELECT *, {prose_sql("text")} AS body, regexp_extract({strip_sql("text")}, '^(#{{1,6}})\\s+', 1) AS hashes, {prose_sql("regexp_replace(text, '^#{1,6}\\s*', '')")} AS title,
                {strip_sql("regexp_replace(" + strip_sql("text") + ", '(?s)^(?:\\\\\\((.*)\\\\\\)|\\\\\\[(.*)\\\\\\]|\\$\\$(.*)\\$\\$)$', '\\1\\2\\3')")} AS formula, regexp_extract(text, '(?is)<table\\b[^>]*>.*?</table>') AS tag FROM ({rows})))
    """


@query("page_block_markdown", f"SELECT case_id, markdown FROM ({block_sql(PROSE.sql())})")
def page_block_markdown(spark, sf_dir):
    frame = PROSE.frame(spark, sf_dir).withColumn("tabled", tables.tables_in("text"))
    return frame.select("case_id", T.page_block(F.col("kind"), F.col("text"), F.col("tabled")).alias("markdown"))


BOXES = Fixture(
    "case_id long, box array<double>, width int, height int",
    (
        (1, (100.0, 200.0, 300.5, 400.2), 1000, 2000), (2, (0.0, 0.0, 1200.0, 900.0), 800, 600), (3, (500.0, 500.0, 400.0, 600.0), 1000, 1000), (4, (2.5, 2.5, 7.5, 7.5), 1000, 1000),
        (5, (100.0, 300.0, 500.0, 900.0), 2000, 2000), (6, (-5.0, -5.0, 10.0, 10.0), 100, 100), (7, (float("inf"), 1.0, 2.0, 3.0), 100, 100), (8, (10.0, 10.0, 3000.0, 2500.0), 1500, 1250), (9, (1.0, 2.0), 10, 10),
    ),
    "SELECT vec_id AS case_id, @array(floor(@at(embedding, 1) * 1000@single) / 2, floor(@at(embedding, 2) * 1000@single) / 2, floor(@at(embedding, 3) * 1000@single) / 2, floor(@at(embedding, 4) * 1000@single) / 2) AS box, 800 + vec_id % 7 * 100 AS width, 2000 AS height FROM {embeddings} WHERE embedding IS NOT NULL",
)
_SIDES = f"(SELECT case_id, width, height, box[1] AS x1, box[2] AS y1, box[3] AS x2, box[4] AS y2, len(box) >= 4 AND len(list_filter(box, lambda v: NOT isfinite(v))) = 0 AS ok FROM {BOXES.sql()})"


@query(
    "bbox_pixels",
    f"""
    WITH s AS (SELECT case_id, greatest(0, least(width, trunc(x1 / 1000 * width)))::INTEGER AS l, greatest(0, least(height, trunc(y1 / 1000 * height)))::INTEGER AS t,
                      greatest(0, least(width, ceil(x2 / 1000 * width)))::INTEGER AS r, greatest(0, least(height, ceil(y2 / 1000 * height)))::INTEGER AS b FROM {_SIDES} WHERE ok)
    SELECT case_id, l || ',' || t || ',' || r || ',' || b AS pixels FROM s WHERE r > l AND b > t
    """,
)
def bbox_pixels(spark, sf_dir):
    pixels = G.outward_pixels(F.col("box"), F.col("width"), F.col("height"))
    out = BOXES.frame(spark, sf_dir).filter(G.is_finite_box(F.col("box")))
    return out.select("case_id", pixels.alias("p")).filter("p IS NOT NULL").select("case_id", F.array_join("p", ",").alias("pixels"))


@query(
    "bbox_round",
    f"""
    WITH s AS (SELECT case_id, greatest(0, least(width, round_even(x1 * width / 1000, 0)))::INTEGER AS l, greatest(0, least(height, round_even(y1 * height / 1000, 0)))::INTEGER AS t,
                      greatest(0, least(width, round_even(x2 * width / 1000, 0)))::INTEGER AS r, greatest(0, least(height, round_even(y2 * height / 1000, 0)))::INTEGER AS b FROM {_SIDES} WHERE ok)
    SELECT case_id, l || ',' || t || ',' || r || ',' || b AS pixels FROM s WHERE r > l AND b > t
    """,
)
def bbox_round(spark, sf_dir):
    out = BOXES.frame(spark, sf_dir).filter(G.is_finite_box(F.col("box")))
    pixels = G.nearest_pixels(F.col("box"), F.col("width"), F.col("height"))
    return out.select("case_id", pixels.alias("p")).filter("p IS NOT NULL").select("case_id", F.array_join("p", ",").alias("pixels"))


@query(
    "bbox_scale",
    f"""
    WITH g AS (SELECT *, width > 1400 AND greatest(x1, y1, x2, y2) <= 1150 AS n, x2 > width OR y2 > height AS e, least(width / greatest(x2, 1), height / greatest(y2, 1)) AS k
               FROM {_SIDES} WHERE ok AND x2 > x1 AND y2 > y1),
    h AS (SELECT *, CASE WHEN n THEN width / 1000 WHEN e THEN k ELSE 1 END AS sx, CASE WHEN n THEN height / 1000 WHEN e THEN k ELSE 1 END AS sy FROM g),
    p AS (SELECT *, greatest(6, trunc((x2 * sx - x1 * sx) * 0.02)) AS px, greatest(6, trunc((y2 * sy - y1 * sy) * 0.02)) AS py FROM h),
    q AS (SELECT case_id, greatest(0, trunc(x1 * sx) - px)::INTEGER AS l, greatest(0, trunc(y1 * sy) - py)::INTEGER AS t,
                 least(width, trunc(x2 * sx) + px)::INTEGER AS r, least(height, trunc(y2 * sy) + py)::INTEGER AS b FROM p)
    SELECT case_id, l || ',' || t || ',' || r || ',' || b AS pixels FROM q WHERE r > l AND b > t
    """,
)
def bbox_scale(spark, sf_dir):
    out = BOXES.frame(spark, sf_dir).filter(G.is_finite_box(F.col("box")))
    pixels = G.crop_pixels(F.col("box"), F.col("width"), F.col("height"))
    return out.select("case_id", pixels.alias("p")).filter("p IS NOT NULL").select("case_id", F.array_join("p", ",").alias("pixels"))


PROGRESS = Fixture("case_id long, box array<double>, height int", ((1, (0.0, 0.0, 5.0, 500.0), 1000), (2, (0.0, 900.0, 1.0, 1500.0), 1000), (3, (0.0, -50.0, 1.0, 10.0), 100)), "SELECT vec_id AS case_id, @array(0.0, floor(@at(embedding, 2) * 1000@single), 1.0, floor(@at(embedding, 4) * 9000@single)) AS box, 1000 AS height FROM {embeddings} WHERE embedding IS NOT NULL")


@query("vertical_progress", f"SELECT case_id, least(greatest((box[2] + box[4]) / 2 / greatest(height, 1), 0), 1)::DOUBLE AS progress FROM {PROGRESS.sql()}")
def vertical_progress(spark, sf_dir):
    return PROGRESS.frame(spark, sf_dir).select("case_id", G.vertical_progress(F.col("box"), F.col("height")).alias("progress"))


LABELS = Fixture("case_id long, size long, start int, finish int, name string", ((1, 0, 1, 1, "a/b.pdf"), (2, 2048, 1, 10, "x.y.png"), (3, 5000000, 3, 7, "n|o?.txt"), (4, None, 2, 2, "plain")), "SELECT doc_id AS case_id, CASE WHEN doc_id % 6 > 0 THEN n_chars * 194 * (doc_id % 6 - 1) + 1 END AS size, 1 + doc_id % 3 AS start, 1 + doc_id % 3 + doc_id % 2 AS finish, source || '/' || lang || '.' || doc_id AS name FROM {documents}")


@query(
    "labels_and_names",
    f"""
    SELECT case_id, CASE WHEN coalesce(size, 0) = 0 THEN 'unknown' WHEN size < 1048576 THEN printf('%.1fKB', size / 1024) ELSE printf('%.2fMB', size / 1024 / 1024) END AS size,
           CASE WHEN start = finish THEN 'page ' || start ELSE 'pages ' || start || '-' || finish END AS pages,
           regexp_replace(regexp_replace(name, '\\.[^.]+$', ''), '[\\\\/:*?"<>|]', '_', 'g') || '.md' AS download FROM {LABELS.sql()}
    """,
)
def labels_and_names(spark, sf_dir):
    return LABELS.frame(spark, sf_dir).select("case_id", T.size_label(F.col("size")).alias("size"), T.page_label(F.col("start"), F.col("finish")).alias("pages"), T.download_name(F.col("name"), F.lit("md")).alias("download"))


@query("token_documents", r"SELECT source, count(*) AS n FROM documents WHERE regexp_full_match(source, '[A-Za-z]{2,8}[0-9]{2,8}[A-Za-z0-9-]*') GROUP BY source")
def token_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(T.is_token(F.col("source"))).groupBy("source").agg(F.count("*").alias("n"))


LIMITS = Fixture(
    "case_id long, message string, budget long",
    ((1, "This model's maximum context length is 8192 tokens. (2000 tokens from the input messages and 8000 tokens for the completion)", 8000), (2, "maximum context length of 4096 tokens: 1000 tokens from the input messages and 4000 tokens for the completion", 4000), (3, "other", 10), (4, "maximum context length of 4096 tokens, 100 tokens from the input messages and 5 tokens for the completion", 5)),
    "SELECT doc_id AS case_id, 'This model has a maximum context length of ' || (4096 + doc_id % 5000) || ' tokens, ' || n_chars || ' tokens from the input messages and 8000 tokens for the completion' AS message, 3000 AS budget FROM {documents}",
)


_CONTEXT = r"(?is)maximum context length of\s+(\d+)\s+tokens.*?(\d+)\s+tokens from the input messages and\s+(\d+)\s+tokens for the completion"


@query(
    "context_limits",
    f"""
    SELECT case_id, CASE WHEN own > 0 AND own < budget THEN own END AS budget
    FROM (SELECT *, try_cast(regexp_extract(message, '{_CONTEXT}', 1) AS BIGINT) - try_cast(regexp_extract(message, '{_CONTEXT}', 2) AS BIGINT) - 128 AS own FROM {LIMITS.sql()})
    """,
)
def context_limits(spark, sf_dir):
    return LIMITS.frame(spark, sf_dir).select("case_id", T.context_limit(F.col("message"), F.col("budget")).alias("budget"))


@case("status_free", f"SELECT case_id, CASE case_id WHEN 1 THEN 'before' || chr(10) || chr(10) || chr(10) || chr(10) || 'after' WHEN 2 THEN 'kept' ELSE '' END AS text FROM (SELECT unnest([1, 2, 3])::BIGINT AS case_id)")
def status_free(spark, sf_dir):
    rows = [(1, "before\n\n**Unlimited-OCR status**\n\nworking\n\nafter"), (2, "kept"), (3, "**Unlimited-OCR status**\nline")]
    return spark.createDataFrame(rows, "case_id long, text string").select("case_id", T.without_status(F.col("text")).alias("text"))


@case("interpolated", "SELECT unnest([1, 2])::BIGINT AS case_id, unnest(['Hi Ann, {missing} 3', 'img/z.png and q']) AS text")
def interpolated(spark, sf_dir):
    rows = [(1, "Hi {name}, {missing} {n}", {"name": "Ann", "n": "3"}), (2, "a.png and b", {"a.png": "img/z.png", "b": "q"})]
    frame = spark.createDataFrame(rows, "case_id long, text string, m map<string,string>")
    return frame.select("case_id", F.when(F.col("case_id") == 1, T.interpolate(F.col("text"), F.col("m"))).otherwise(T.rewrite_paths(F.col("text"), F.col("m"))).alias("text"))


_ENGLISH = {"就绪": "ready", "启动失败": "failed to start", "正在读取 {count} 个文件...": "Reading {count} files...", "{done}/{total} 解析中": "{done} of {total} parsed", "解析失败：{detail}": "Parsing failed: {detail}", "登录": "Log in"}
NOTICES = Fixture(
    "case_id long, text string",
    ((1, "登录"), (2, "m 就绪"), (3, "m 启动失败"), (4, "m 启动中"), (5, "正在读取 12 个文件..."), (6, "正在读取 x 个文件..."), (7, "3/9 解析中"), (8, "解析失败：a：b"), (9, None), (10, ""), (11, "other"), (12, "x\n就绪")),
    "SELECT doc_id AS case_id, CASE doc_id % 8 WHEN 0 THEN '登录' WHEN 1 THEN source || ' 就绪' WHEN 2 THEN lang || ' 启动失败' WHEN 3 THEN '正在读取 ' || n_chars || ' 个文件...' WHEN 4 THEN doc_id || '/' || n_chars || ' 解析中' WHEN 5 THEN '解析失败：' || source WHEN 6 THEN substr(text, 1, 50) || ' 启动中' ELSE text END AS text FROM {documents}",
)


@query(
    "translated_messages",
    rf"""
    SELECT case_id, CASE WHEN text = '登录' THEN 'Log in'
      WHEN regexp_full_match(text, '[^\n\r]+ 就绪') THEN regexp_replace(text, ' 就绪$', ' ready') WHEN regexp_full_match(text, '[^\n\r]+ 启动失败') THEN regexp_replace(text, ' 启动失败$', ' failed to start')
      WHEN regexp_full_match(text, '正在读取 [0-9]+ 个文件\.\.\.') THEN regexp_replace(text, '正在读取 ([0-9]+) 个文件\.\.\.', 'Reading \1 files...')
      WHEN regexp_full_match(text, '[0-9]+/[0-9]+ 解析中') THEN regexp_replace(text, '([0-9]+)/([0-9]+) 解析中', '\1 of \2 parsed')
      WHEN regexp_full_match(text, '解析失败：[^\n\r]+') THEN regexp_replace(text, '解析失败：', 'Parsing failed: ') ELSE text END AS text
    FROM {NOTICES.sql()}
    """,
)
def translated_messages(spark, sf_dir):
    return messages.translated(NOTICES.frame(spark, sf_dir), "text", _ENGLISH).select("case_id", F.col("translated").alias("text"))
