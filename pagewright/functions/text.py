"""Text rules as column expressions. White space is what Unicode calls so: patterns carry (?U)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of blocks by how they are rendered.
SKIPPED_LABELS = ("header", "footer", "number", "page_number", "page_num")
TITLE_LABELS = ("title", "section_title")
CAPTION_LABELS = ("image_caption", "figure_caption", "table_caption")
VISUAL_LABELS = ("image", "chart")
FORMULA_LABELS = ("formula", "display_formula")
PAGE_SKIPPED = ("header", "footer", "header_image", "footer_image", "page_number", "page_num", "number", "seal")
PAGE_TITLES = ("doc_title", "title", "section_title", "paragraph_title", "subtitle", "reference_title", "ref_title")
PAGE_FORMULAS = ("formula", "display_formula", "equation")
PAGE_CAPTIONS = ("image_caption", "figure_caption", "figure_title")
PAGE_REFERENCES = ("reference", "reference_content", "reference_text", "ref_text")


#: What (?U)\s matches.
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def normalize_newlines(c: Column) -> Column:
    return replaced(c, ("\r\n", "\n"), ("\r", "\n"))


def unescape_newlines(c: Column) -> Column:
    """Line ends, also those written out as backslash sequences."""
    return replaced(normalize_newlines(c), ("\\r\\n", "\n"), ("\\n", "\n"))


def compact(c: Column) -> Column:
    """Blanks to one, three or more line ends to two, white space at the ends off."""
    blanks = F.regexp_replace(normalize_newlines(c), "[ \t]+", " ")
    return strip(F.regexp_replace(blanks, "\n{3,}", "\n\n"))


def prose(c: Column) -> Column:
    """Hyphens at line ends joined, blank lines off; a list keeps its lines, all else becomes one."""
    text = F.regexp_replace(strip(normalize_newlines(c)), r"(?U)(?<=[A-Za-z])-\s*\n\s*(?=[a-z])", "")
    split = F.split(F.regexp_replace(text, "[ \t]{2,}|\t", " "), "\n")

    def told(lines: Column) -> Column:
        listed = F.forall(lines, lambda x: x.rlike(r"(?U)^(?:[-*+]\s+|\d+[.)]\s+)"))
        joined = strip(F.regexp_replace(F.array_join(lines, " "), r"(?U)\s{2,}|[^\S ]", " "))
        return F.when(F.size(lines) == 0, "").when(listed, F.array_join(lines, "\n")).otherwise(joined)

    return let(F.filter(F.transform(split, strip), lambda x: x != ""), told)


def heading_level(kind: Column, text: Column) -> Column:
    """Level of a title by its kind, its numbering or its keyword."""
    roman = F.regexp_extract(text, r"(?U)^((?i)[ivxlcdm]+)\.\s+", 1)
    number = F.regexp_extract(text, r"(?U)^(\d+(?:\.\d+)*)[.)]?\s+", 1)
    keyword = text.rlike(r"(?i)^(?:abstract|acknowledgments?|references|appendix\b)")
    return (
        F.when(kind == "doc_title", 1)
        .when((F.length(roman) > 1) | F.upper(roman).isin("I", "V", "X"), 2)
        .when(number != "", F.least(F.lit(6), F.lit(2) + F.length(F.regexp_replace(number, "[^.]", ""))))
        .when(text.rlike(r"(?U)^[A-Z][.)]\s+"), 3)
        .when(keyword, 2)
        .when(kind.isin("paragraph_title", "subtitle"), 3)
        .otherwise(2)
    )


def _between(text: Column, mark: str, end: str) -> Column:
    inside = strip(F.substring(text, F.lit(3), F.greatest(F.length(text) - 4, F.lit(0))))
    return F.when(text.startswith(mark) & text.endswith(end), inside)


def display_formula(c: Column) -> Column:
    text = strip(c)
    inner = F.coalesce(_between(text, "\\(", "\\)"), _between(text, "\\[", "\\]"), _between(text, "$$", "$$"), text)
    return F.when(inner != "", F.concat(F.lit("$$\n"), inner, F.lit("\n$$"))).otherwise("")


def reference_entry(c: Column) -> Column:

    def entry(text: Column) -> Column:
        number, rest = F.regexp_extract(text, r"(?sU)^\[(\d+)\]\s*(.*)", 1), F.regexp_extract(text, r"(?sU)^\[(\d+)\]\s*(.*)", 2)
        return F.when(number != "", F.concat(number, F.lit(". "), strip(rest))).otherwise(F.concat(F.lit("- "), text))

    return let(prose(c), entry)


def heading(kind: Column, text: Column) -> Column:
    """A title with as many hashes as it brings, or as its level has."""
    hashes = F.regexp_extract(strip(text), r"(?U)^(#{1,6})\s+", 1)

    def titled(title: Column) -> Column:
        level = F.when(hashes != "", F.length(hashes)).otherwise(heading_level(kind, title))
        return F.when(title != "", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), title)).otherwise("")

    return let(prose(F.regexp_replace(text, r"(?U)^#{1,6}\s*", "")), titled)


def marked(text: Column, mark: str) -> Column:
    """Prose between marks; nothing for nothing."""
    return let(prose(text), lambda body: F.when(body != "", F.concat(F.lit(mark), body, F.lit(mark))).otherwise(""))


def paragraph(text: Column) -> Column:
    """Prose, with what leads into an abstract or into keywords as a heading, and one sign for items."""
    lead = r"(?isU)^(abstract|摘要|index terms|keywords|关键词)\s*[—–:-]\s*(.+)$"

    def led(body: Column) -> Column:
        section = F.regexp_extract(body, lead, 1)
        titled = F.concat(F.lit("## "), F.initcap(section), F.lit("\n\n"), strip(F.regexp_extract(body, lead, 2)))
        return F.when(section != "", titled).otherwise(F.regexp_replace(body, r"(?U)^[-*+]\s+", "- "))

    return let(prose(text), led)


def page_block(kind: Column, text: Column, tabled: Column | None = None) -> Column:
    """Markdown of a block by its kind. ``tabled``: its text with HTML tables as Markdown, for tables and blocks that hold one.

    Running heads and feet, page numbers and seals have none, whatever their text.
    """
    held = F.lower(text).contains("<table")
    renderers = (
        ((F.coalesce(text, F.lit("")) == "") | kind.isin(*PAGE_SKIPPED), F.lit("")),
        (kind.isin(*PAGE_TITLES), heading(kind, text)),
        (kind.isin(*PAGE_FORMULAS), display_formula(text)),
        ((kind == "table") | held, text if tabled is None else tabled),
        (kind.isin(*PAGE_CAPTIONS), marked(text, "*")),
        (kind == "table_caption", marked(text, "**")),
        (kind.isin(*PAGE_REFERENCES), reference_entry(text)),
    )
    out = paragraph(text)
    for like, rendered in reversed(renderers):
        out = F.when(like, rendered).otherwise(out)
    return out


def tagged_block(label: Column, content: Column, first_title: Column) -> Column:
    """Markdown of a tagged block; ``first_title`` tells whether it is the first title with text."""
    kind, text = F.lower(strip(label)), compact(content)
    return (
        F.when((text == "") | kind.isin(*SKIPPED_LABELS), "")
        .when(kind.isin(*TITLE_LABELS), F.concat(F.when(first_title, "# ").otherwise("## "), text))
        .when(kind.isin(*CAPTION_LABELS), F.concat(F.lit("*"), text, F.lit("*")))
        .when(kind.isin(*FORMULA_LABELS), F.concat(F.lit("$$\n"), text, F.lit("\n$$")))
        .when(kind.isin(*VISUAL_LABELS), F.concat(F.lit("**"), F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))), F.lit(":** "), text))
        .otherwise(text)
    )


def anchor_words(c: Column) -> Column:
    """ASCII words and numbers in lower case, one blank between."""
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def match_text(c: Column) -> Column:
    """What two renderings of a text have in common: no dollar signs, commands or punctuation."""
    bare = F.when(F.contains(c, F.lit("\\")), F.regexp_replace(c, r"\\[a-zA-Z]+", " ")).otherwise(c)
    return F.lower(strip(F.regexp_replace(bare, "(?U)[\\s$\\{}^_`~|()\\[\\]<>#*.,:;'\"!?，。；：！？、]+", " ")))


def match_score(element: Column, block: Column) -> Column:
    """1 for equal texts, less for one inside the other, else the share of the element's longer words in the block."""
    words = F.filter(F.split(element, " "), lambda w: F.length(w) > 2)
    hits = F.size(F.filter(words, lambda w: F.contains(block, w)))
    return (
        F.when((F.coalesce(element, F.lit("")) == "") | (F.coalesce(block, F.lit("")) == ""), F.lit(0.0))
        .when(element == block, F.lit(1.0))
        .when(F.contains(block, element), F.least(F.lit(0.98), F.length(element) / F.length(block) + 0.62))
        .when(F.contains(element, block), F.least(F.lit(0.96), F.length(block) / F.length(element) + 0.55))
        .when(F.size(words) == 0, F.lit(0.0))
        .otherwise(hits / F.size(words))
    )


def without_thinking(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""))


STATUS = r"(?iU)(?:^|\n{2,})\s*\*\*unlimited-ocr status\*\*\s*\n+\s*[^\n]*(?=\n{2,}|\z)"


def without_status(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), STATUS, "\n\n"))


def escape_html(c: Column) -> Column:
    return replaced(c, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def rewrite_paths(c: Column, paths: Column) -> Column:
    """Each key of the map replaced by its value, in the map's order."""
    return F.aggregate(F.map_entries(paths), c, lambda text, e: F.replace(text, e["key"], e["value"]))


def interpolate(template: Column, values: Column) -> Column:
    """{name} replaced for the names in the map; others stay."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def output_stem(path: Column, model: Column) -> Column:
    """File name without its last extension, and the model with marks replaced."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.concat(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit("."), F.regexp_replace(model, r"(?U)[^\p{Alnum}_-]", "-"))


def download_name(name: Column, extension: Column) -> Column:
    return F.concat(F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), r'[\\/:*?"<>|]', "_"), F.lit("."), extension)


def digest8(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 8)


def size_label(size: Column) -> Column:
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "unknown")
        .when(size < 1024 * 1024, F.format_string("%.1fKB", size / 1024))
        .otherwise(F.format_string("%.2fMB", size / 1024 / 1024))
    )


def page_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("page "), start.cast("string"))).otherwise(F.concat_ws("-", F.concat(F.lit("pages "), start.cast("string")), end.cast("string")))


def is_token(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z]{2,8}[0-9]{2,8}[A-Za-z0-9-]*\z")


#: A box of four numbers after a label, and words that end a decoder's steps.
BOX_TRACE = r"(?i)\btext\s*\[(?=[^\]\n]*(?:-?\d+(?:\.\d+)?\s*,\s*){3}-?\d+(?:\.\d+)?\s*\])[^\]\n]*\]"
DECODER_TRACE = r"(?i)\b(?:end\s+while|end\s+if|output:)(?!\w)"


def structural_artifact(c: Column) -> Column:
    """Names the trace that a text shows of a decoder's own layout, if any."""
    text = normalize_newlines(c)
    boxes = F.regexp_count(text, F.lit(BOX_TRACE))
    numbered = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*[0-9]{1,3}\s*:")))
    traces = F.regexp_count(text, F.lit(DECODER_TRACE))
    return (
        F.when(F.contains(text, F.lit("<|det|>")), None)
        .when((boxes >= 2) & ((numbered >= 3) | (traces >= 2)), "layout coordinate trace")
        .when((numbered >= 6) & (traces >= 2), "decoder trace")
    )


def safe_fallback(c: Column) -> Column:
    return F.when(structural_artifact(c).isNotNull(), "").otherwise(compact(c))


def emits(text: Column, last: Column, last_size: Column) -> Column:
    """Whether a grown text is shown: 24 more characters, or the end of a sentence or line."""
    ends = text.rlike("[.\n。！？；，]\\z")
    return (text != last) & ((F.length(text) - last_size >= 24) | ends)


def context_limit(message: Column, budget: Column, reserve: int = 128) -> Column:
    """A smaller completion budget from a server's message about its context length; null if it isn't smaller."""
    pattern = r"(?is)maximum context length of\s+(\d+)\s+tokens.*?(\d+)\s+tokens from the input messages and\s+(\d+)\s+tokens for the completion"
    part = [F.nullif(F.regexp_extract(message, pattern, k), F.lit("")).cast("long") for k in (1, 2)]
    left = part[0] - part[1] - reserve
    return F.when((left > 0) & (left < budget), left)
