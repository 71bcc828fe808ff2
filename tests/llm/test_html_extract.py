import html as entities
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.llm import html_extract as he
from pagewright.llm.queries import QUERIES


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a<p>b", "a b"),
        ("<article><h1>T &amp; U</h1><p><b>x<br>y<p>z&nbsp;&lt;w</article><footer>f</footer>", "T & U x y z <w"),
        ("<body><nav>n</nav><main><p>m</p><aside>s</aside></main>", "m"),
        ("<article>foo<b>bar</b> <i>baz</i></article>", "foobar baz"),
        ('<article><script>var t="</p>";</script>in<style>p{}</style></article>', "in"),
        ('<article><p>ok</p><div class="ad">buy</div><div id="comments">c</div><form>f<input></form></article>', "ok"),
        ("<article><header><h1>H</h1></header><p>x</p><header>top</header></article>", "H x"),
        ("<article><p>a < b and c<d </article>", "a < b and c<d"),
        ("<article><p>if a<b then the rest of the page</p>, <i", "if a<b then the rest of the page , <i"),
        ('<article class="post has-sidebar" id="related-work"><p class="banner">Body</p><h2 id="notice">text</h2></article>', "Body text"),
        ('<div class="sidebar"><form><article class="comments"><p>in</p><div class="share-price no-comments">9</div><div class="x share">s</div></article></form></div>', "in 9"),
        ("<article><!-- no --><p>yes<!-- > --> still</article>", "yes still"),
        ("<article><p>one</p></article><article class='comment'>reply</article>", "one"),
        ('<article><p title="a > b">q</p><p hidden>h</p></article>', "q"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "1 2 3 4"),
        ("", ""),
        ("<", "<"),
        ("plain text", "plain text"),
        ("<article></article>", ""),
    ],
)
def test_pages(page, text):
    assert he.extract(page) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "<table>", "<td>", "x", " y ", "&amp;", "<", ">", "<!--", "-->", "<a href='>", "</", "<article>", "</article>"]), max_size=40).map("".join))
def test_never_fails(page):
    he.extract(page)
    he.subtrees(page)


def test_deep_and_long_pages():
    assert he.extract("<div>" * 30_000 + "deep") == "deep"
    assert he.extract("<article>" + "<p>word " * 30_000) == " ".join(["word"] * 30_000)
    assert he.extract("<b>" * 20_000 + "</i>" * 20_000 + "x") == "x"


def pages_of(n=14):
    rows = []
    for i in range(n):
        box = "<div><p>Subscribe to our letter</p></div>"
        rows.append((i, f"http://a.example/{i}", f"<body><div>Site menu <a>home</a></div><div><p>Body {i}</p>{box}</div></body>", "t"))
    rows += [(100 + i, "http://b.example/", "<body><div>Site menu <a>home</a></div><p>same</p></body>", "t") for i in range(30)]
    return [*rows, (200, None, "<p>no url</p>", "t"), (None, "http://a.example/x", None, "t"), (201, "bad", "", "t"), (0, "http://a.example/0", rows[0][2], "t")]


def plain_templates(rows):
    """Host to the hashes on pages with MIN_PAGES different bodies, counted page by page."""
    bodies = {}
    for _, url, page, *_ in rows:
        host = re.match(r"https?://([^/]+)", url or "")
        if host and page is not None:
            body, hashes = he.subtrees(page)
            for x in hashes:
                bodies.setdefault((host[1], x), set()).add(body)
    return {key for key, found in bodies.items() if len(found) >= he.MIN_PAGES}


def test_templates_of_a_host_go(spark):
    pages = spark.createDataFrame(pages_of(), "page_id long, url string, html string, n_chars string").withColumn("a.b", F.lit(1))
    out = he.extract_pages(pages)
    assert out.columns == ["page_id", "url", "a.b", "text", "n_chars"]
    rows = out.collect()
    assert len(rows) == len(pages_of())
    for row in rows:
        if row.page_id is not None and row.page_id < 100:
            assert row.text == f"Body {row.page_id}"
        elif row.page_id is not None and row.page_id < 200:
            assert row.text == "Site menu home same"  # copies of one page count once
        assert row.n_chars == len(row.text)
    assert he.extract_pages(pages.limit(0)).count() == 0


def test_counts_of_hosts_decide_without_article_elements(spark):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=n))
    rows, want = [], []
    for host in range(3):
        menu, legal, box = (f"<{t}><b>{words(3)} {host}</b><i>{words(4)}</i></{t}>" for t in ("div", "section", "ul"))
        for i in range(9 + 3 * host):
            body = [f"{words(30)} {host} {i} {k}" for k in range(4)]
            page = "<body>" + menu + "<div>" + "".join(f"<p>{x}</p>" for x in body[:2]) + (box if i % 2 else "") + "".join(f"<p>{x}</p>" for x in body[2:]) + "</div>" + legal + "</body>"
            rows.append((i, f"http://h{host}.example/{i}", page))
            said = lambda x: re.sub(r"<.*?>", "", x)
            if host == 0:  # nine pages: too few to tell
                body = [said(menu), *body[:2], *([said(box)] if i % 2 else []), *body[2:], said(legal)]
            elif host == 1 or host == 2:  # 12 and 15 pages, of which 6 and 7 have the box
                body = [*body[:2], *([said(box)] if i % 2 else []), *body[2:]]
            want.append(" ".join(body))
    rows.append((0, "http://h1.example/0", rows[0][2]))  # the id of another page, on another host
    want.append(want[0])
    rows.append((None, "http://h2.example/0", rows[-2][2]))
    want.append(want[-2])
    out = he.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(r.text for r in out.collect()) == sorted(want)
    given = he.read(spark.createDataFrame(rows, "page_id long, url string, html string"), "url", "html")
    assert {tuple(r) for r in he.templates(given)[1].collect()} == plain_templates(rows)
    assert plain_templates(rows)


def test_given_pages(spark):
    folder = "/root/testdata/sf0.001"
    source = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for row in QUERIES["op10_html_extract"](spark, folder).collect():
        inner = re.search(r"<article>(.*)</article>", source[row.page_id], re.DOTALL)[1]
        inner = re.sub(r"</?(p|br|h1)>", "\n", inner)
        assert row.text == " ".join(entities.unescape(re.sub(r"</?\w+[^>]*>", "", inner)).split())
