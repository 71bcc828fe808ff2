"""Main text of web pages: parse, remove what recurs on many pages of a host, keep the article."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, marked, rows_of, text_of, written

#: A subtree is a template when it is on pages of its host with so many different articles.
MIN_PAGES = 10
#: Tasks among which the pages with one template are dealt.
WAYS = 16

# Fixed values of HTML: elements by how they are read.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
BLOCK = set(
    """address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th
    thead tr ul""".split()
)
CLOSES_P = BLOCK - set("br body html td th tr tbody thead tfoot legend summary figcaption dd dt li".split()) | {"li", "dd", "dt"}
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"},
    "tfoot": {"tr", "td", "th", "thead", "tbody", "tfoot"},
}
#: Implied ends don't reach beyond these.
FENCE = set("table ul ol dl div section article aside nav body html blockquote td th select main form header footer".split())
#: Elements that are never part of an article, and their roles.
NOISE = set("nav footer aside form button select dialog menu audio video canvas object applet head search fieldset".split()) | RAW
NOISE_ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form".split())
#: Whole names in a class list, or whole ids, that mark a container as not of the article.
NOISE_NAMES = set(
    """ad ads adv advert adverts advertisement advertising adsense ad-slot ad-banner ad-container banner banners cookie cookies
    cookie-banner cookie-consent cookie-notice consent gdpr notice notices alert nav navbar navigation main-nav site-nav menu menus
    main-menu nav-menu sidebar sidebars left-sidebar right-sidebar breadcrumb breadcrumbs footer site-footer page-footer masthead
    site-header page-header comment comments comment-list comments-area comment-respond disqus disqus_thread reply replies respond
    share sharing share-buttons social social-links social-share related related-posts related-articles recommended promo promos
    promotion sponsor sponsored newsletter newsletter-signup subscribe subscription popup modal overlay pagination pager widget
    widgets toolbar skip skip-link paywall signup login""".split()
)
#: Content elements: inside an article they aren't templates, however often a text recurs.
CONTENT = set("p h1 h2 h3 h4 h5 h6 li blockquote pre td th tr tbody table dd dt figure figcaption br b i em strong a span code".split())

#: A tag ends before the next tag begins; what doesn't is text.
_tag = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)((?:[\s/]++|[^\s/>=<]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'<][^\s><]*+)?+)?+|=)*+)>""")
_attr = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")


class Node:
    """``noise``: an element that its kind, role or style keeps out; ``named``: a container that its names do; ``main``: an article's element."""

    __slots__ = ("tag", "noise", "named", "main", "kids", "hash", "parent")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent, self.kids, self.hash = tag, parent, [], 0
        self.noise, self.named, self.main = tag in NOISE, False, tag in ("article", "main")
        if attributes and not attributes.isspace():
            self._mark(attributes)

    def _mark(self, attributes: str) -> None:
        for name, a, b, c in _attr.findall(attributes):
            name, value = name.lower(), unescape(a or b or c).lower()
            if name in ("class", "id"):
                self.named |= self.tag not in ("html", "body", "main") and self.tag not in CONTENT and not NOISE_NAMES.isdisjoint(value.split())
            elif name == "role":
                self.noise |= value in NOISE_ROLES and not self.main
                self.main |= value in ("main", "article")
            elif name == "itemprop":
                self.main |= value == "articlebody"
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                self.noise = True
            elif name == "style":
                self.noise |= "display:none" in value.replace(" ", "")

    def close(self) -> None:
        """The subtree's hash: its tag and what is in it, white space and attributes aside."""
        parts = [self.tag]
        for kid in self.kids:
            parts.append(f"\x01{kid.hash:x}" if isinstance(kid, Node) else " ".join(kid.split()))
        self.hash = xxhash.xxh64_intdigest("\x00".join(p for p in parts if p).encode("utf-8", "surrogatepass")) >> 1


def parse(html: str) -> Node:
    """The tree of a page, with implied ends of paragraphs, items and cells; stray ends are skipped. Never fails."""
    root = top = Node("#root", None, "")
    opened: Counter[str] = Counter()
    at, size = 0, len(html)

    def pop_to(tags: set[str], fence: set[str]) -> None:
        """Close what is open up to the nearest of tags, unless one of the fence is nearer."""
        nonlocal top
        node = top
        while node is not root and node.tag not in tags:
            if node.tag in fence:
                return
            node = node.parent
        if node is root:
            return
        while True:
            done, top = top, top.parent
            opened[done.tag] -= 1
            done.close()
            if done is node:
                return

    while at < size:
        mark = html.find("<", at)
        if mark < 0 or mark == size - 1:
            top.kids.append(unescape(html[at:]))
            break
        if mark > at:
            top.kids.append(unescape(html[at:mark]))
        m = _tag.match(html, mark)
        if m is None:
            if html.startswith("<!--", mark):
                end = mark + 5 if html.startswith("<!-->", mark) else html.find("-->", mark + 4) + 3
                at = end if end > mark + 3 else size
            elif html[mark + 1] in "!?" or html[mark + 1] == "/" and not html[mark + 2 : mark + 3].isalpha():
                end = html.find(">", mark)
                at = size if end < 0 else end + 1
            else:
                top.kids.append("<")
                at = mark + 1
            continue
        at, (closing, tag, attributes) = m.end(), m.groups()
        tag = tag.lower()
        if closing:
            if opened[tag] > 0:
                pop_to({tag}, set())
            elif tag == "br":
                top.kids.append(Node("br", top, ""))
            continue
        if tag in CLOSES_P and opened["p"] > 0:
            pop_to({"p"}, {"button", "table", "td", "th"})
        for ended in CLOSED_BY.get(tag, ()):
            if opened[ended] > 0:
                pop_to({ended}, FENCE - CLOSED_BY[tag])
        node = Node(tag, top, attributes)
        top.kids.append(node)
        if tag in VOID or attributes.endswith("/") and tag in RAW:
            node.close()
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
            node.kids.append(html[at : end.start() if end else size])
            node.close()
            at = end.end() if end else size
        else:
            top = node
            opened[tag] += 1
    while top is not root:
        done, top = top, top.parent
        done.close()
    root.close()
    return root


def walk(node: Node, deleted: set[int], inside: bool) -> Iterator[Node | str]:
    """Texts and elements in page order, without noise and deleted subtrees."""
    stack: list = [node]
    while stack:
        here = stack.pop()
        yield here
        if isinstance(here, str):
            continue
        if here.tag in BLOCK:
            stack.append("\n")
        for kid in reversed(here.kids):
            if isinstance(kid, str):
                stack.append(kid)
            elif not (kid.noise or kid.named or kid.hash in deleted and not (inside and kid.tag in CONTENT) or kid.tag == "header" and not has_heading(kid)):
                stack.append(kid)


def has_heading(node: Node) -> bool:
    """Whether a header holds a title inside an article; headers of pages don't count."""
    up = node.parent
    while up is not None and not up.main:
        up = up.parent
    return up is not None and any(isinstance(x, Node) and x.tag in ("h1", "h2") for x in descendants(node))


def descendants(node: Node) -> Iterator[Node | str]:
    stack = [node]
    while stack:
        here = stack.pop()
        yield here
        if isinstance(here, Node):
            stack.extend(reversed(here.kids))


def article(root: Node) -> Node | None:
    """The outermost article (or else main element) with the most text, one without a name of NOISE_NAMES first; None without any.

    Names of elements around it don't matter, nor does a form around the page.
    """
    best, most = None, (False, -1)
    stack = [root]
    while stack:
        here = stack.pop()
        if here.noise and here.tag != "form":
            continue
        if here.main and here.tag == "main":
            inner = [x for x in descendants(here) if isinstance(x, Node) and x.main and x is not here and not x.noise and not x.named]
            if len(inner) == 1:
                stack.append(inner[0])
                continue
        if here.main:
            rank = not here.named, len(text_in(here, set(), True))
            if rank > most:
                best, most = here, rank
        else:
            stack.extend(x for x in reversed(here.kids) if isinstance(x, Node))
    return best


def text_in(node: Node, deleted: set[int], inside: bool) -> str:
    parts = []
    for x in walk(node, deleted, inside):
        if isinstance(x, str):
            parts.append(x)
        elif x.tag in BLOCK:
            parts.append("\n")
    return " ".join("".join(parts).split())


def extract(html: str, deleted: set[int] = frozenset()) -> str:
    """Blocks of the article in page order, joined by one space, white space in them turned into one."""
    root = parse(html)
    found = article(root)
    return text_in(root, deleted, False) if found is None else text_in(found, deleted, True)


def subtrees(html: str) -> tuple[int, list[int]]:
    """The hash of a page's article, and the hashes of its subtrees that could be templates, each once.

    Those outside the article, and what in it isn't content itself.
    """
    root = parse(html)
    found = article(root)
    hashes = set()
    stack = [(root, False)]
    while stack:
        here, inside = stack.pop()
        inside |= here is found
        for kid in here.kids:
            if isinstance(kid, Node) and not kid.noise and not (kid.named and inside):
                if kid is not found and not (inside and kid.tag in CONTENT) and kid.tag not in ("html", "body", "br"):
                    hashes.add(kid.hash)
                stack.append((kid, inside))
    body = found if found is not None else root
    return body.hash, sorted(hashes)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def read(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``row, html, host, page``: all other columns, the html as bytes, its host, and a hash of both; equal pages of a host have one."""
    kept = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in (html_col, "text", "n_chars")]).alias("row")
    out = pages.select(kept, F.col(f"`{html_col}`").cast("binary").alias("html"), host_of(F.col(f"`{url_col}`")).alias("host"))
    return out.withColumn("page", F.xxhash64("host", "html"))


def templates(given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(trees, found)``: ``host, page, body, subtrees`` of each page with a host, and ``host, subtree`` of templates.

    Pages of a host with the same article count once, so copies of a page don't make its article a template. Each
    (host, subtree, article) is counted once before subtrees are counted, so that no task gets a host's pages together.
    """
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("body", pa.int64()), ("subtrees", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(((host, page, *subtrees(text_of(raw))) for host, page, raw in rows_of(batches)), schema)

    some = given.filter("host <> '' AND html IS NOT NULL").select("host", "page", "html")
    trees = written(some.mapInArrow(run, "host string, page long, body long, subtrees array<long>"), "subtrees")
    seen = trees.select("host", "body", F.explode("subtrees").alias("subtree")).distinct().groupBy("host", "subtree").agg(F.count("*").alias("n"))
    return trees, written(seen.filter(F.col("n") >= MIN_PAGES).select("host", "subtree"), "templates")


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without its html, with ``text string, n_chars long`` of the whole html; columns of these names are replaced.

    Null and empty html: empty text. A null url: no templates. Repeated rows and ids stay, each with the text of its
    own html; other columns may have any names; an empty table gives an empty one. Pages meet the templates of their host by a
    join at every size, a template's pages in WAYS tasks; only pages that have one are shuffled for it.
    """
    given = read(pages, url_col, html_col)
    trees, found = templates(given)
    ways = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WAYS - 1).cast("long")))
    each = trees.select("host", "page", F.explode("subtrees").alias("subtree")).distinct().withColumn("way", F.pmod("page", F.lit(WAYS)))
    own = each.join(found.withColumn("way", ways), ["host", "subtree", "way"], "left_semi").groupBy("page").agg(F.collect_set("subtree").alias("deleted"))
    own = written(own, "deleted")
    may = marked(given, own, "page")
    none = may.filter("NOT _may").select("row", "html", F.lit(None).cast("array<long>").alias("deleted"))
    some = may.filter("_may").join(own.hint("merge"), "page", "left").select("row", "html", "deleted")

    @F.arrow_udf("string")
    def text(raw: pa.Array, deleted: pa.Array) -> pa.Array:
        return pa.array([extract(text_of(a), set(b or ())) for a, b in zip(raw.to_pylist(), deleted.to_pylist(), strict=True)], pa.string())

    out = none.unionByName(some).select("row", text("html", "deleted").alias("text"))
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "text", F.length("text").cast("long").alias("n_chars"))
