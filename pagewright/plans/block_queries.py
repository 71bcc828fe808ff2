"""Block parsers, renderers and page rules on fixtures of tagged output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks, linking, tables
from .registry import Fixture, case, query, table
from .text_queries import block_sql, prose_sql, strip_sql

DET = Fixture(
    "doc_id long, raw string",
    (
        (1, "<|det|>header [0, 0, 9, 9]<|/det|>skip me<|det|>title [10, 20, 30, 40]<|/det|> Main  title \n<|det|>text [1, 2, 3, 4]<|/det|>Body\n\n\n\nmore<|det|>title [1,1,2,2]<|/det|>Second"),
        (2, "lead <|det|> image <|/det|>a picture<|det|>figure_caption [5.5, 6, 7]<|/det|>Caption here<|det|>formula [1, 2, 3, 4]<|/det|>x = 1"),
        (3, "no tags at all"), (4, None), (5, "<|det|>title [0,0,1,1]<|/det|>   <|det|>section_title [0,0,1,1]<|/det|>Real"),
    ),
    "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text ELSE '<|det|>header [0, 0, 9, 9]<|/det|>skip<|det|>title [' || doc_id % 100 || ', 20, 30.5, 40]<|/det|> ' || substr(text, 1, 40) || '<|det|>text [1, 2, 3, 4]<|/det|>' || substr(text, 41, 200) || '<|det|> image <|/det|>' || lang || '<|det|>title [1,1,2,2]<|/det|>' || source END AS raw FROM {documents}",
)
_TAG = r"<\|det\|>\s*([A-Za-z_][\w-]*)\s*(\[[^\]]*\])?\s*<\|/det\|>"
_CUT = "regexp_split_to_array(raw, '<\\|det\\|>\\s*[A-Za-z_][\\w-]*\\s*(?:\\[[^\\]]*\\])?\\s*<\\|/det\\|>')"
_DETS = f"""
  SELECT doc_id, i - 1 AS ord, labels[i] AS label, boxes[i] AS raw_box, parts[i + 1] AS text
  FROM (SELECT doc_id, regexp_extract_all(raw, '{_TAG}', 1) AS labels, regexp_extract_all(raw, '{_TAG}', 2) AS boxes, {_CUT} AS parts, unnest(range(1, len(regexp_extract_all(raw, '{_TAG}', 1)) + 1)) AS i FROM {DET.sql()})
"""


@query(
    "det_blocks",
    f"""
    SELECT doc_id, ord::INTEGER AS ord, label, text, CASE WHEN len(n) >= 4 THEN array_to_string(list_transform(n[1:4], lambda x: x::DOUBLE), ',') END AS box
    FROM (SELECT *, regexp_extract_all(raw_box, '-?\\d+(?:\\.\\d+)?') AS n FROM ({_DETS}))
    """,
)
def det_blocks(spark, sf_dir):
    out = blocks.det_blocks(DET.frame(spark, sf_dir), "doc_id", F.col("raw"))
    return out.select("doc_id", "ord", "label", "text", F.array_join("box", ",").alias("box"))


def _names(*sets) -> str:
    return ", ".join(f"'{x}'" for kinds in sets for x in kinds)


_COMPACT = strip_sql("regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")


@query(
    "det_markdown",
    f"""
    WITH b AS (SELECT doc_id, ord, lower(trim(label)) AS kind, {_COMPACT} AS text FROM ({_DETS})),
    t AS (SELECT *, sum(CASE WHEN kind IN ({_names(T.TITLE_LABELS)}) AND text <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS seen FROM b),
    l AS (SELECT doc_id, ord, CASE WHEN text = '' OR kind IN ({_names(T.SKIPPED_LABELS)}) THEN '' WHEN kind IN ({_names(T.TITLE_LABELS)}) THEN CASE WHEN seen = 1 THEN '# ' ELSE '## ' END || text
            WHEN kind IN ({_names(T.CAPTION_LABELS)}) THEN '*' || text || '*' WHEN kind IN ({_names(T.FORMULA_LABELS)}) THEN '$$' || chr(10) || text || chr(10) || '$$'
            WHEN kind IN ({_names(T.VISUAL_LABELS)}) THEN '**' || upper(kind[1]) || kind[2:] || ':** ' || text ELSE text END AS line FROM t)
    SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY ord) AS markdown FROM l WHERE line <> '' GROUP BY doc_id
    """,
)
def det_markdown(spark, sf_dir):
    return blocks.det_markdown(blocks.det_blocks(DET.frame(spark, sf_dir), "doc_id", F.col("raw")), "doc_id")


PAGES = Fixture(
    "doc_id long, page int, raw string",
    (
        (1, 0, "<BLOCK>title [1, 2, 3, 4]<CHILD>A heading<BLOCK>text [1, 2, 3, 4]<FORK><CHILD> Some text <FORK>rest<BLOCK>chart [0,0,1,1]<CHILD>ignored<BLOCK>figure_title [1,1,2,2]<CHILD>Fig. 1 Growth. More"),
        (2, 1, "<BLOCK>title [1,2]<CHILD>Not first page<BLOCK><CHILD>odd<BLOCK>image [0, 0, 5, 5]<BLOCK>text [1,1,1,1]<CHILD>x"),
        (3, 0, "<BLOCK>header [0,0,9,9]<CHILD>Running head<BLOCK>text [1,1,2,2]<CHILD>[Non-Text]<BLOCK>equation [1,1,2,2]<CHILD>\\alpha = b \\tag{1}<BLOCK>subtitle [2,2,3,3]<CHILD>Small<BLOCK>title [2,2,3,3]<CHILD>Later"),
        (4, 0, "<BLOCK>figure [0,0,1,1]<BLOCK>chart [0,0,1,1]<BLOCK>image_caption [1,1,2,2]<CHILD>Figure 3b. [Left] shown. Right not.<BLOCK>page_number [0,0,1,1]<CHILD>7<BLOCK>table [0,0,1,1]<CHILD><table><tr><td>k</td></tr><tr><td>v</td></tr>"),
    ),
    "SELECT doc_id, doc_id % 2 AS page, '<BLOCK>title [1, 2, 3, 4]<CHILD>' || source || '<BLOCK>text [1, 2, 3, ' || doc_id % 100 || ']<FORK><CHILD> ' || lang || ' says <FORK>rest<BLOCK>chart [0,0,1,1]<CHILD>ignored<BLOCK>figure_title [1,1,2,2]<CHILD>Fig. ' || doc_id % 10 || ' Growth of ' || source || '. More<BLOCK>header [0,0,9,9]<CHILD>Running head' AS raw FROM {documents}",
)
_PAGE_BLOCKS = f"""
  SELECT doc_id, page, ord, CASE WHEN kind = '' THEN 'unknown' ELSE kind END AS kind, CASE WHEN len(n) = 4 THEN list_transform(n, lambda x: x::DOUBLE) END AS box,
         CASE WHEN lower(kind) IN ({_names(blocks.EMPTY_KINDS)}) OR body = '[Non-Text]' THEN '' WHEN body LIKE '<table>%' AND body NOT LIKE '%</table>' THEN body || '</table>' ELSE regexp_replace(body, '\\s*\\\\tag\\s*\\{{[^{{}}]*\\}}', '') END AS text
  FROM (SELECT *, regexp_extract(part, '^\\s*([a-zA-Z_]+)', 1) AS kind, regexp_extract_all(regexp_extract(part, '^\\s*[a-zA-Z_]+\\s*\\[\\s*([-0-9.,\\s]+)\\]', 1), '-?[0-9.]+') AS n,
               {strip_sql("string_split_regex(regexp_extract(part, '(?s)<CHILD>(.*)', 1), '<(?:FORK|CHILD|BLOCK)>')[1]")} AS body
        FROM (SELECT doc_id, page, i - 1 AS ord, parts[i + 1] AS part FROM (SELECT doc_id, page, string_split(raw, '<BLOCK>') AS parts, unnest(range(1, len(string_split(raw, '<BLOCK>')))) AS i FROM {PAGES.sql()})))
"""
_TITLED = f"""
  SELECT doc_id, page, ord, box, text, CASE WHEN title AND ord = min(CASE WHEN title THEN ord END) OVER (PARTITION BY doc_id) THEN 'doc_title' ELSE kind END AS kind
  FROM (SELECT *, kind IN ({_names(T.PAGE_TITLES)}) AND trim(text) <> '' AND page = 0 AS title FROM ({_PAGE_BLOCKS}))
"""


def _caption(k: int) -> str:
    said = f"string_split_regex(regexp_replace({prose_sql(f't{k}')}, '^(?i:fig(?:ure)?\\.?\\s*\\d+[a-z]?\\.?\\s*)', ''), '[.!?]\\s+')"
    whole = f"regexp_replace({prose_sql(f't{k}')}, '^(?i:fig(?:ure)?\\.?\\s*\\d+[a-z]?\\.?\\s*)', '')"
    first = f"CASE WHEN len({said}) > 1 THEN {whole}[:len({said}[1]) + 1] ELSE {whole} END"
    return f"CASE WHEN lower(k{k}) IN ({_names(T.PAGE_CAPTIONS)}) AND coalesce(t{k}, '') <> '' THEN replace(replace(({first})[:140], '[', ''), ']', '') END"


@query(
    "page_blocks",
    f"""
    WITH v AS (SELECT *, lower(kind) IN ({_names(blocks.VISUAL_KINDS)}) AS shown, lead(kind) OVER w AS k1, lead(text) OVER w AS t1, lead(kind, 2) OVER w AS k2, lead(text, 2) OVER w AS t2 FROM ({_TITLED}) WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
    n AS (SELECT *, CASE WHEN shown THEN sum(shown::INTEGER) OVER (PARTITION BY doc_id ORDER BY ord) END::BIGINT AS visual FROM v)
    SELECT doc_id, ord::INTEGER AS ord, kind, array_to_string(box, ',') AS box, text, visual,
           CASE WHEN shown THEN coalesce({_caption(1)}, CASE WHEN lower(k1) IN ({_names(blocks.VISUAL_KINDS)}) THEN {_caption(2)} END, kind || ' ' || visual) END AS alt
    FROM n
    """,
)
def page_blocks(spark, sf_dir):
    found = blocks.page_blocks(PAGES.frame(spark, sf_dir), "doc_id", F.col("raw")).join(PAGES.frame(spark, sf_dir).select("doc_id", "page"), "doc_id")
    out = blocks.alt_texts(blocks.promote_title(found, "doc_id"), ["doc_id"])
    return out.select("doc_id", "ord", "kind", F.array_join("box", ",").alias("box"), "text", "visual", "alt")


@query("page_markdown", f"SELECT doc_id, string_agg(markdown, chr(10) || chr(10) ORDER BY ord) AS markdown FROM ({block_sql(f'SELECT doc_id, ord, lower(kind) AS kind, text FROM ({_TITLED})')}) WHERE markdown <> '' GROUP BY doc_id")
def page_markdown(spark, sf_dir):
    found = blocks.page_blocks(PAGES.frame(spark, sf_dir), "doc_id", F.col("raw")).join(PAGES.frame(spark, sf_dir).select("doc_id", "page"), "doc_id")
    return blocks.page_markdown(blocks.promote_title(found, "doc_id"), "doc_id")


TOPS = Fixture(
    "doc_id long, ord long, box array<double>",
    tuple((d, i, None if y is None else (0.0, float(y), 10.0, float(y) + 5)) for d, ys in ((1, (10, 500, None, 100, 90, 400, 20)), (2, (900, 821, 819, 10)), (3, (None, 5))) for i, y in enumerate(ys)),
    "SELECT user_id AS doc_id, event_id AS ord, CASE WHEN event_id % 5 > 0 THEN @array(0.0, floor(value) * 20, 10.0, floor(value) * 20 + 5) END AS box FROM {events}",
)


@query(
    "page_assign",
    f"""
    WITH b AS (SELECT doc_id, ord, box[2] AS y, last_value(box[2] IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {TOPS.sql()})
    SELECT doc_id, ord, least(sum(CASE WHEN before > y + 80 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord), 1)::INTEGER AS page FROM b
    """,
)
def page_assign(spark, sf_dir):
    return blocks.assign_pages(TOPS.frame(spark, sf_dir), "doc_id", F.lit(2)).select("doc_id", "ord", "page")


CAPTIONS = Fixture(
    "doc_id long, ord long, label string, page int, confidence string",
    ((1, 0, "image", 0, "heuristic"), (1, 1, "text", 0, "heuristic"), (1, 2, "figure_caption", 3, "text"), (1, 3, "table", 3, "text"), (1, 4, "chart", 4, "heuristic"), (1, 5, "image_caption", 6, "heuristic"), (2, 0, "text", 0, "text")),
)


@case("caption_backfill", f"SELECT doc_id, ord, CASE WHEN doc_id = 1 AND ord = 0 THEN 3 ELSE page END::INTEGER AS page, CASE WHEN doc_id = 1 AND ord = 0 THEN 'caption' ELSE confidence END AS confidence FROM {CAPTIONS.sql()}")
def caption_backfill(spark, sf_dir):
    return blocks.backfill_pages(CAPTIONS.frame(spark, sf_dir), "doc_id").select("doc_id", "ord", "page", "confidence")


LINES = Fixture(
    "page_id long, texts array<string>, scores array<double>",
    ((1, ("one", " ", "two"), (0.9, 0.1)), (2, (), ()), (3, ("x",), (0.5, 0.6, 0.7))),
    "SELECT doc_id AS page_id, @array(lang, ' ', source, substr(text, 1, 10)) AS texts, @array(doc_id % 10 / 10.0, 0.5, 0.25) AS scores FROM {documents}",
)


@query(
    "ocr_lines",
    f"SELECT page_id, (i - 1)::INTEGER AS idx, texts[i] AS text, scores[i] AS score FROM (SELECT *, unnest(range(1, len(texts) + 1)) AS i FROM {LINES.sql()}) WHERE trim(texts[i]) <> ''",
)
def ocr_lines(spark, sf_dir):
    pages = LINES.frame(spark, sf_dir).withColumn("boxes", F.lit(None).cast("array<array<double>>"))
    return blocks.text_lines(pages, ["page_id"]).select("page_id", "idx", "text", "score")


STDOUT = Fixture("doc_id long, ord long, line string", ((1, 0, "INFO: start"), (1, 1, "noise before"), (1, 2, " <|det|>text [1,2,3,4]<|/det|> Body "), (1, 3, ""), (1, 4, "=== x"), (1, 5, "more"), (2, 0, "nothing")))


@case("layout_output", "SELECT 1::BIGINT AS doc_id, '<|det|>text [1,2,3,4]<|/det|> Body' || chr(10) || 'more' AS text")
def layout_output(spark, sf_dir):
    return blocks.layout_output(STDOUT.frame(spark, sf_dir), "doc_id")


SPANS = (
    "<table><tr><td rowspan=2>Name</td><td colspan=2>Points</td></tr><tr><td>X</td><td>Y</td></tr><tr><td>Us</td><td>1</td><td>2</td></tr></table>",
    "<table><tr><th>a|b</th><th>c<br>d</th></tr><tr><td> 1  2 </td><td></td></tr></table>",
    "no table",
)
TABLES = Fixture("table_id long, html string", tuple(enumerate(SPANS, 1)))
TABLES_WANT = Fixture(
    "table_id long, markdown string",
    ((1, "| Name | Points / X | Points / Y |\n| --- | --- | --- |\n| Us | 1 | 2 |"), (2, "| a\\|b |\n| --- |\n| 1 2 |"), (3, "no table")),
)


@case("html_table", f"SELECT * FROM {TABLES_WANT.sql()}")
def html_table(spark, sf_dir):
    return TABLES.frame(spark, sf_dir).select("table_id", tables.to_markdown("html").alias("markdown"))


@case("html_cells")
def html_cells(spark, sf_dir):
    """Cells of tables with spans laid out, one row a place."""
    return tables.cells(TABLES.frame(spark, sf_dir), "table_id", "html")


@query("html_blocks")
def html_blocks(spark, sf_dir):
    """Block elements of pages in order."""
    return tables.page_elements(table(spark, sf_dir, "pages"), "page_id", "html")


@query("page_links", r'''SELECT page_id, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\s+href="([^"]*)"', 1)) FROM pages) GROUP BY page_id''')
def page_links(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("links")).filter("links > 0")


FORMULAS = (
    (1, r"\left( x + y \right)"), (2, r"\left( \frac{a}{b} \right)"), (3, r"\[ a \right] \quad \dots \]"), (4, "3 ÷ 4 = 0.75"), (5, "plain words ÷ more"),
    (6, r"\left[ \left( a \right) \right]"), (7, "x ≤ 2"), (8, None),
)


@case("formula_repair")
def formula_repair(spark, sf_dir):
    frame = spark.createDataFrame(list(FORMULAS), "case_id long, text string")
    return frame.select("case_id", tables.repaired_formula("text").alias("text"))


TARGETS = Fixture("page long, target double", ((1, 0.25), (1, 0.75), (1, 0.5), (2, 9.0), (3, 0.1)), "SELECT o_custkey AS page, o_orderkey % 100 / 4.0 AS target FROM {orders}")
PLACES = Fixture("page long, entry long, place double", ((1, 1, 0.0), (1, 2, 0.5), (1, 3, 1.0), (2, 4, 0.25)), "SELECT user_id AS page, event_id AS entry, event_id % 32 * 1.0 AS place FROM {events}")


@query(
    "nearest_entry",
    f"""
    SELECT page, target, entry FROM (SELECT t.page, target, entry, row_number() OVER (PARTITION BY t.page, target ORDER BY abs(place - target), entry) AS n
      FROM {TARGETS.sql()} t JOIN {PLACES.sql()} p ON t.page = p.page) WHERE n = 1
    """,
)
def nearest_entry(spark, sf_dir):
    return linking.nearest(TARGETS.frame(spark, sf_dir), PLACES.frame(spark, sf_dir), ["page"], "target", "place", "entry").filter("entry IS NOT NULL").select("page", "target", "entry")


CURSORS = Fixture("doc_id long, cursor long", ((1, 0), (1, 3), (1, 9), (2, 1)), "SELECT DISTINCT conv_id AS doc_id, conv_id % 5 AS cursor FROM {conversations}")
LABELLED = Fixture("doc_id long, ord long, label string", ((1, 0, "text"), (1, 1, "Image"), (1, 4, "chart"), (1, 6, "text"), (2, 0, "image")), "SELECT conv_id AS doc_id, turn AS ord, CASE turn % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'Image' WHEN 2 THEN role ELSE 'chart' END AS label FROM {conversations}")


@query(
    "next_labelled",
    f"SELECT c.doc_id, cursor, (SELECT min(ord) FROM {LABELLED.sql()} b WHERE b.doc_id = c.doc_id AND ord >= greatest(0, cursor - 1) AND lower(label) IN ('image', 'chart')) AS ord FROM {CURSORS.sql()} c",
)
def next_labelled(spark, sf_dir):
    return linking.next_with_label(CURSORS.frame(spark, sf_dir), LABELLED.frame(spark, sf_dir), "doc_id", ("image", "chart"))
