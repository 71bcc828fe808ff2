"""Behaviours that the oracles don't hold: Python rules, streams, files."""

import json
import os
import random
import re
import struct
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import geometry
from pagewright.operators import blocks, catalog, linking, messages, repetition, tables
from pagewright.sources import files, publish
from pagewright.streaming import folds


def test_table_with_drifted_spans():
    row = lambda *cells: "<tr>" + "".join(f"<td{a}>{t}</td>" for a, t in cells) + "</tr>"
    plain = lambda *texts: row(*[("", t) for t in texts])
    html = "<table>" + row((" rowspan=3", "Model"), (" rowspan=3", "Kind"), (" colspan=5", "In"), (" colspan=3", "Out"), (" colspan=2", "All"), ("", ""))
    html += row((" colspan=2", "A"), (" colspan=3", "B"), (" colspan=3", "C"), (" colspan=2", "Mean"), ("", "")) + plain("x", "y", "z", "x", "y", "z", "x", "y", "z", "x", "y")
    html += plain("M", "k", *map(str, range(1, 12))) + "</table>"
    head, _, body = tables.table_markdown(html).split("\n")
    assert head == "| " + " | ".join(["Model", "Kind", *[f"{p} / {g} / {m}" for p, g in (("In", "A"), ("In", "B"), ("Out", "C")) for m in "xyz"], "All / Mean / x", "All / Mean / y"]) + " |"
    assert body.count("|") == 14


def test_table_with_metrics_given_once():
    cells = lambda *pairs: "<tr>" + "".join(f"<td {a}>{t}</td>" for a, t in pairs) + "</tr>"
    html = "<table>" + cells(("rowspan=2", "Model"), ("colspan=4", "In"), ("colspan=2", "Out"))
    html += cells(("colspan=2", "A"), ("colspan=2", "B"), ("colspan=2", "C"), ("", "x"), ("", "y")) + cells(*[("", str(i)) for i in range(7)]) + "</table>"
    assert tables.table_markdown(html).split("\n")[0] == "| Model | In / A / x | In / A / y | In / B / x | In / B / y | Out / C / x | Out / C / y |"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (r"\left( x \right)", "( x )"),
        (r"\left( \frac{a}{b} \right)", r"\left( \frac{a}{b} \right)"),
        (r"\left[ \left( a \right) \right]", r"\left[ ( a ) \right]"),
        (r"some words x \quad \dots", "some words x"),
        ("3 ÷ 4 = 0.75", r"\( 3 \div 4 = 0.75 \)"),
        ("some words ÷", "some words ÷"),
    ],
)
def test_formulas(text, want):
    assert tables.repair(text) == want


@settings(max_examples=80, deadline=None)
@given(st.text("ab", min_size=1, max_size=30), st.integers(1, 60), st.text("abc", max_size=900))
def test_tail_unit_is_the_plain_rule(unit, times, head):
    text = head + unit * times
    assert tables and repetition.tail_unit(text) == plain_tail(text)


def plain_tail(text):
    if len(text) < 800:
        return text
    for unit in range(1, min(200, len(text) - 1) + 1):
        same = 0
        while same < len(text) - unit and text[len(text) - 1 - same] == text[len(text) - 1 - same - unit]:
            same += 1
        if same and same + unit >= 100 and (same + unit) // unit >= 5:
            total = same + unit
            return text[: len(text) - total + unit] + text[len(text) - total % unit :]
    return text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=4), st.lists(st.integers(1, 4), min_size=1, max_size=5))
def test_groups_go_to_parents_in_order(spans, widths):
    parents = [tables.Cell(f"p{i}", False, 1, n) for i, n in enumerate(spans)]
    owners = tables.spread(parents, widths)
    assert len(owners) == len(widths)
    assert owners == sorted(owners)


def test_page_assignment_is_the_sequential_rule(spark):
    rng = random.Random(1)
    rows, want = [], []
    for doc in range(40):
        page, last = 0, None
        for n in range(rng.randrange(1, 12)):
            y = rng.choice([None, *range(0, 1000, 37)])
            if y is not None:
                page = page + 1 if last is not None and y + 80 < last and page < 2 else page
                last = y
            rows.append((doc, n, None if y is None else [0.0, float(y), 1.0, float(y)]))
            want.append((doc, n, page))
    frame = spark.createDataFrame(rows, "doc_id long, ord long, box array<double>")
    got = blocks.assign_pages(frame, "doc_id", F.lit(3)).select("doc_id", "ord", "page").collect()
    assert sorted(map(tuple, got)) == want


def test_batches_cover_all_pages_once(spark):
    plan = catalog.batch_plan(spark.range(0, 30).withColumn("n", F.col("id").cast("int")), F.col("n"), F.lit(7)).collect()
    for pages in range(30):
        own = sorted((r.start_page, r.end_page) for r in plan if r.n == pages)
        assert [p for a, b in own for p in range(a, b + 1)] == list(range(1, pages + 1))


def test_stems_stay_unique(spark):
    rows = [(f"/{a}/x.pdf",) for a in "abc"] + [("/a/x.pdf",)]
    out = catalog.unique_stems(spark.createDataFrame(rows, "path string"), F.lit("x.m"), F.col("path")).collect()
    assert len({r.stem for r in out}) == 4


def test_greedy_links(spark):
    elements = spark.createDataFrame([(1, 0, "Alpha beta gamma"), (1, 1, "Delta epsilon zeta"), (1, 2, "nothing like it")], "doc_id long, ord long, text string")
    found = spark.createDataFrame([(1, 0, "alpha beta gamma"), (1, 1, "delta epsilon zeta eta")], "doc_id long, ord long, text string")
    assert [tuple(r)[:3] for r in linking.link_in_order(elements, found, "doc_id").orderBy("element").collect()] == [(1, 0, 0), (1, 1, 1)]


def plain_links(elements, blocks):
    """Each element against the blocks near the last link, all in memory."""
    cursor, out = 0, []
    for ord_, text in enumerate(elements):
        best = None
        for at in range(max(0, cursor - 1), min(len(blocks), cursor + 18)) if len(text) >= 2 else ():
            value = linking.score(text, blocks[at])
            if value >= 0.55 and (best is None or value > best[1]):
                best = at, value
            if value >= 0.92:
                break
        if best:
            cursor = best[0]
            out.append((ord_, best[0], best[1]))
    return out


def test_links_in_a_stream_are_the_plain_rule(spark):
    rng = random.Random(8)
    vocabulary = [f"word{a}{b}" for a in "abcdefgh" for b in "xyz"]
    documents = {}
    for doc in range(12):
        blocks = [" ".join(rng.choices(vocabulary, k=rng.randrange(2, 9))) for _ in range(rng.choice([0, 3, 40, 150]))]
        elements = [" ".join(w for w in rng.choice(blocks).split() if rng.random() < 0.8) if blocks and rng.random() < 0.4 else rng.choice([*blocks, "other text altogether"]) if rng.random() < 0.5 else "" for _ in range(rng.choice([0, 5, 60]))]
        elements += sorted(blocks[::2], key=blocks.index)
        documents[doc] = elements, blocks
    side = lambda k: spark.createDataFrame([(doc, 3 * i, text, 1) for doc, both in documents.items() for i, text in enumerate(both[k])], "doc_id long, ord long, text string, score int")
    got = sorted(map(tuple, linking.link_in_order(side(0).repartition(3), side(1).repartition(2), "doc_id").collect()))
    want = sorted((doc, 3 * e, 3 * b, value) for doc, (elements, blocks) in documents.items() for e, b, value in plain_links(elements, blocks))
    assert got == want and len(want) > 100


def test_messages_are_the_first_pattern_that_matches():
    rng = random.Random(6)
    english = {t: f"<{i} {t}>" for i, t in enumerate(messages.MESSAGES) if i % 3} | {"就绪": "ready", "未就绪": "not ready"}
    own = messages.Messages(english)
    assert own.of("a 未就绪") == "a not ready" and own.of("a b 就绪") == "a b ready" and own.of("a 待启动") == "a 待启动" and own.of(None) is None
    assert own.of("第 3-9 页") == "<13 第 3-9 页>" and own.of("第 x 页") == "第 x 页" and own.of("12/x 解析中") == "12/x 解析中"
    plain = [re.compile(re.sub(r"\\\{(\w+)\\\}", lambda m: r"(\d+)" if m[1] in messages.NUMBERS else "(.+)", re.escape(t))) for t in messages.MESSAGES]
    for _ in range(400):
        text = re.sub(r"\{\w+\}", lambda m: rng.choice(["7", "x y", "就绪", "：", "3/4"]), rng.choice(messages.MESSAGES))
        text = rng.choice(["", " 就绪", "z"]) + text if rng.random() < 0.3 else text
        matching = [k for k, p in enumerate(plain) if p.fullmatch(text)]
        assert set(matching) <= set(own.candidates(text)) and len(own.candidates(text)) < 8
        if not matching:
            assert own.of(text) == (english.get(text) or text)
        elif matching[0] >= messages.STATES and messages.MESSAGES[matching[0]] in english:
            assert own.of(text).startswith(f"<{matching[0]} ")


def test_crops_are_numbered_where_they_can_be_cut(spark):
    rows = [(1, 0, 0, "image", [0.0, 0.0, 9.0, 9.0]), (1, 0, 1, "image", [5.0, 5.0, 5.0, 9.0]), (1, 0, 2, "TABLE", [0.0, 0.0, 9.0, 9.0]), (1, 1, 3, "text", [0.0, 0.0, 9.0, 9.0]), (1, 1, 4, "chart", [0.0, 0.0, 9.0, 9.0]), (1, 1, 5, "chart", None), (2, 0, 0, "chart", [1.0, 1.0, 2.0, 2.0])]
    frame = spark.createDataFrame(rows, "doc long, page int, ord long, kind string, box array<double>")
    pixels = geometry.outward_pixels(F.col("box"), F.lit(1000), F.lit(1000))
    number = lambda *key: [r.crop for r in blocks.number_crops(frame, list(key), ("image", "table", "chart"), pixels).orderBy("doc", "ord").collect()]
    assert number("doc", "page") == [1, None, 2, None, 1, None, 1] and number("doc") == [1, None, 2, None, 3, None, 1]


def test_page_rows_and_their_cap(spark, tmp_path):
    spark.range(20).selectExpr("id % 2 AS doc", "CAST(id / 2 AS int) AS page").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    chosen = catalog.page_rows(pages, 3, 4)
    assert sorted({r.page for r in chosen.collect()}) == [3, 4, 5, 6] and catalog.page_rows(pages, 8, 50).count() == 4 and catalog.page_rows(pages, 8).count() == 4 and catalog.page_rows(pages, -2, 5).count() == 6
    plan = chosen._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(page,3)" in plan and "LessThan(page,7)" in plan
    assert {r.pages for r in catalog.page_counts(pages, "doc", 10).collect()} == {10}
    with pytest.raises(Exception, match="has more than 9 pages"):
        catalog.page_counts(pages, "doc", 9).collect()


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"s{i % 3}", i // 3, i / 10, rng.choice(["word ", "end.", "a rather long piece of text ", "x"])) for i in range(60)]
    kind = "stream string, seq long, at double, delta string"
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], kind).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    want = sorted(map(tuple, folds.snapshots(spark.createDataFrame(rows, kind)).collect()))
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run = folds.snapshots(source, stream=True).writeStream.format("memory").queryName("shown").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("shown").collect())) == want


def test_unsent_images(spark, tmp_path):
    rows = [("s", 1, "a", "x"), ("s", 2, "a", "x"), ("s", 3, "a", "y"), ("s", 4, "b", "x")]
    kind = "stream string, seq long, path string, data string"
    spark.createDataFrame(rows, kind).coalesce(1).write.json(str(tmp_path / "in"))
    source = spark.readStream.schema(kind).json(str(tmp_path / "in"))
    run = folds.unsent(source).writeStream.format("memory").queryName("unsent").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(r.seq for r in spark.table("unsent").collect()) == [1, 3, 4]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.PDF", "b.txt", "sub/c.png"):
        (tmp_path / name).write_bytes(b"%PDF-1")
    assert files.discover(spark, str(tmp_path)).count() == 1
    assert files.discover(spark, str(tmp_path), recursive=True).count() == 2
    raw = struct.pack(">BxxxI", 1, 3) + b"abc" + struct.pack(">BxxxI", 2, 2) + b"de"
    frame = spark.createDataFrame([(1, bytearray(raw)), (2, None)], "k long, raw binary")
    assert sorted(map(tuple, files.framed_log(frame, "k", "raw").collect())) == [(1, "abcde"), (2, None)]
    kinds = spark.createDataFrame([(bytearray(b"%PDF-"), None), (bytearray(b"x"), None), (bytearray(b"x"), 0)], "c binary, g int")
    assert [r[0] for r in kinds.select(files.file_kind(F.col("c"), F.col("g"))).collect()] == [0, 1, 0]


def test_task_scan(spark, tmp_path):
    for name, task, summary in (("t1", {"id": "t1", "name": "old"}, {"id": "t1", "name": "new"}), ("t2", {"id": "t2", "name": "only"}, None)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "task.json").write_text(json.dumps(task))
        if summary:
            (tmp_path / name / "summary.json").write_text(json.dumps(summary))
    (tmp_path / "t3").mkdir()
    (tmp_path / "t3" / "task.json").write_text("{broken")
    assert sorted((r.id, r.name) for r in files.read_tasks(spark, str(tmp_path)).collect()) == [("t1", "new"), ("t2", "only")]


def test_backends_keep_failures_apart(spark):
    backends = files.PageBackends()
    backends.register("broken", lambda pages: 1 / 0)
    pages = spark.createDataFrame([(1, 0, "x")], "doc_id long, page int, text string")
    assert backends.run(pages, "echo").first().raw == "x"
    assert "division" in backends.run(pages, "broken").first().error


def test_backends_made_by_a_factory_share_steps(spark):
    backends = files.PageBackends(str.strip)

    def make():
        held = []  # once a task, not once a batch

        def runner(pages):
            held.append(1)
            return pages.assign(raw=[f"  {text}{len(held)} " for text in pages["text"]])

        return runner

    backends.register_factory("counting", make, str.upper)
    pages = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "doc_id long, page int, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert sorted(r.raw for r in backends.run(pages, "counting").collect()) == ["X1", "Y2"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_report(spark):
    runs = spark.createDataFrame([("b", "m", "ok", 1.5, 3), ("a", "m", "error", 0.1, 0)], "file string, model string, status string, seconds double, characters long")
    assert files.comparison_report(runs).first().markdown.split("\n")[2:] == ["| a | m | error | 0.1 | 0 |", "| b | m | ok | 1.5 | 3 |"]


def test_split_write(spark, tmp_path):
    tasks = spark.createDataFrame([("a", "n", "heavy")], "id string, name string, markdown string")
    files.write_split(tasks, str(tmp_path), ["markdown"])
    metadata, heavy = (publish.read(spark, str(tmp_path), "parquet", part) for part in ("tasks", "results"))
    assert metadata.columns == ["id", "name"]
    assert catalog.hydrate(metadata, heavy, "id", {"markdown": ""}).first().markdown == "heavy"


def test_newest(spark, tmp_path):
    for n, (name, text) in enumerate((("1.mmd", "old"), ("2.mmd", "new"), ("3.mmd", "  "))):
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (1000 + n, 1000 + n))
    assert files.newest(spark, str(tmp_path), "*.mmd").first().text == "new"


def test_settings_sizes_and_exports(spark, tmp_path):
    path = tmp_path / "settings.json"
    assert files.read_settings(spark, str(path)) == {}
    for raw, want in ((b"\xef\xbb\xbf{\"a\": 1}", {"a": 1}), (b"[1]", {}), (b"{bad", {}), (b"", {})):
        path.write_bytes(raw)
        assert files.read_settings(spark, str(path)) == want
    for name, size in (("a.pdf", 0), ("b.pdf", 5), ("c.pdf", 50)):
        (tmp_path / name).write_bytes(b"x" * size)
    assert [r.length for r in files.within(files.discover(spark, str(tmp_path)), 10).collect()] == [5]
    docs = spark.createDataFrame([(1, "# A\nb"), (2, "c")], "id long, markdown string")
    for _ in range(2):  # the second replaces the first
        files.write_json(docs, str(tmp_path / "j"))
        files.write_markdown(docs, str(tmp_path / "m"), "id", "markdown")
    assert sorted(map(tuple, publish.read(spark, str(tmp_path / "j"), "json").select("id", "markdown").collect())) == [(1, "# A\nb"), (2, "c")]
    assert (next((Path(publish.current(spark, str(tmp_path / "m"))) / "id=1").glob("*.txt"))).read_text() == "# A\nb\n"


def test_percent_boxes_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from pagewright import plans

    spark.range(100).selectExpr("id AS vec_id", "array(float(0)) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = duck.execute(f"SELECT vec_id, percent FROM ({plans.oracle_sql()['record_structs']})").fetchall()
    got = plans.queries()["record_structs"](spark, str(tmp_path)).select("vec_id", "percent").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("name", ["bbox_pixels", "coordinate_bounds", "point_boxes", "polygon_boxes", "vertical_progress"])
def test_single_precision_of_components(spark, tmp_path, name):
    import duckdb

    from pagewright import plans

    values = [-0.14100000262, 0.14399999380, -0.15800000727, -0.32800000906, -0.18400000035, 0.21199999749, 0.16099999845, 0.09749999642, 0.42849999666]
    rows = [(i, [values[(i + k) % len(values)] for k in range(6)]) for i in range(len(values))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = duck.execute(plans.oracle_sql()[name])
    want = sorted(map(repr, found.fetchall()))
    assert sorted(repr(tuple(r)) for r in plans.queries()[name](spark, str(tmp_path)).select(*[d[0] for d in found.description]).collect()) == want


def test_blocks_compute_their_prose_once(spark):
    from pagewright.functions import text as T

    plan = spark.range(1).select(T.page_block(F.lit("text"), F.col("id").cast("string")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") <= 5  # one for each kind with prose


def test_links_read_a_text_at_most_twice(spark):
    from pagewright.functions import text as T

    frame = spark.createDataFrame([("$$a  \\alpha\u2003B_c.$\\$x", "a b c \\ x"), ("\\x$y", "y"), (" \xa0A ", "a")], "t string, want string")
    out = frame.select("want", T.match_text(F.col("t")).alias("got"))
    assert [r.got for r in out.collect()] == [r.want for r in out.collect()]
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_replace(") <= 2


def test_tails_go_to_python_in_small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = [(1, "x" * 900 + "abcdefg" * 40), (2, "short"), (3, None), *((k, "y" * 799 + f"{k:010d}" * 30) for k in range(4, 400))]
    try:
        out = repetition.without_repeated_tail(spark.createDataFrame(texts, "k long, text string"), "k", F.col("text"))
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
        assert {r.k: r.text for r in out.collect()} == {k: t and repetition.tail_unit(t) for k, t in texts}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
