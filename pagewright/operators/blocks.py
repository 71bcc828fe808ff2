"""Tagged model output to blocks, pages for blocks, blocks to Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from . import tables

DET = r"<\|det\|>\s*([A-Za-z_][\w-]*)\s*(\[[^\]]*\])?\s*<\|/det\|>"
EMPTY_KINDS = ("chart", "seal")
VISUAL_KINDS = ("image", "figure", "chart")
# Beginnings of lines that a model prints beside its output.
NOISE_STARTS = ("INFO:", "WARNING:", "The attention mask", "Setting `pad_token_id`", "image:", "other:", "===", "%|")


def det_blocks(docs: DataFrame, key: str, raw: Column) -> DataFrame:
    """``key, ord, label, box, text``: a block for each tag pair, with the text up to the next."""
    text = T.normalize_newlines(raw)
    labels = F.regexp_extract_all(text, F.lit(DET), F.lit(1))
    boxes = F.regexp_extract_all(text, F.lit(DET), F.lit(2))
    parts = F.split(text, DET, -1)
    zipped = F.transform(labels, lambda label, i: F.struct(i.alias("ord"), label.alias("label"), F.get(boxes, i).alias("box"), F.get(parts, i + 1).alias("text")))
    out = docs.select(key, F.explode(zipped).alias("b")).select(key, "b.*")
    return out.withColumn("box", G.parse_box(F.col("box")))


def det_markdown(blocks: DataFrame, key: str) -> DataFrame:
    """``key, markdown``: blocks in order as Markdown, the first title with text on top level."""
    titled = (F.lower(T.strip("label")).isin(*T.TITLE_LABELS) & (T.compact(F.col("text")) != "")).cast("int")
    seen = F.sum(titled).over(Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lines = blocks.withColumn("_line", T.tagged_block(F.col("label"), F.col("text"), seen == 1)).filter("_line <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "_line"))), lambda e: e["_line"])
    return lines.groupBy(key).agg(F.array_join(ordered, "\n\n").alias("markdown"))


def page_blocks(docs: DataFrame, key: str, raw: Column) -> DataFrame:
    """``key, ord, kind, box, text`` of output in BLOCK and CHILD tags, texts cleaned; charts and seals have none."""
    parts = F.slice(F.split(raw, "<BLOCK>", -1), 2, 1_000_000_000)
    out = docs.select(key, F.posexplode(parts).alias("ord", "part"))
    head = r"^\s*([a-zA-Z_]+)"
    box = r"^\s*[a-zA-Z_]+\s*\[\s*([-0-9.,\s]+)\]"
    kind = F.regexp_extract("part", head, 1)
    numbers = F.regexp_extract_all(F.regexp_extract("part", box, 1), F.lit(r"-?[0-9.]+"), F.lit(0))
    child = F.regexp_extract("part", r"(?s)<CHILD>(.*)", 1)
    body = F.get(F.split(child, "<(?:FORK|CHILD|BLOCK)>"), F.lit(0))
    out = out.select(
        key, "ord", F.when(kind != "", kind).otherwise("unknown").alias("kind"),
        F.when(F.size(numbers) == 4, F.transform(numbers, lambda v: v.cast("double"))).alias("box"),
        F.when(F.lower(kind).isin(*EMPTY_KINDS), "").otherwise(T.strip(F.coalesce(body, F.lit("")))).alias("text"),
    )
    return out.withColumn("text", tables.cleaned("text"))


def promote_title(blocks: DataFrame, key: str, page: str = "page") -> DataFrame:
    """The first title with text of the first page becomes the document's title."""
    title = F.col("kind").isin(*T.PAGE_TITLES) & (T.strip(F.col("text")) != "") & (F.col(page) == 0)
    first = F.min(F.when(title, F.col("ord"))).over(Window.partitionBy(key))
    return blocks.withColumn("kind", F.when(title & (F.col("ord") == first), "doc_title").otherwise(F.col("kind")))


def number_visuals(blocks: DataFrame, key: list[str]) -> DataFrame:
    """``visual``: the running number of visual blocks within a key; null for others."""
    shown = F.lower("kind").isin(*VISUAL_KINDS)
    count = F.sum(shown.cast("int")).over(Window.partitionBy(*key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return blocks.withColumn("visual", F.when(shown, count))


def number_crops(blocks: DataFrame, key: list[str], kinds: tuple[str, ...], pixels: Column) -> DataFrame:
    """``crop``: the running number, from 1 within a key, of blocks of the kinds whose region can be cut out; null for others.

    ``pixels`` is a box as ``functions.geometry`` gives it, null where nothing can be cut. A key of document and page numbers the
    crops of each page, a document alone goes on over its pages; ``ord`` orders the blocks of a key.
    """
    cut = F.coalesce(F.lower("kind").isin(*kinds) & pixels.isNotNull(), F.lit(False))
    count = F.sum(cut.cast("long")).over(Window.partitionBy(*key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return blocks.withColumn("crop", F.when(cut, count))


def alt_texts(blocks: DataFrame, key: list[str]) -> DataFrame:
    """``alt`` of visual blocks: the first sentence of a caption within two blocks, over visual blocks only; else kind and number."""
    order = Window.partitionBy(*key).orderBy("ord")

    def caption(ahead: int) -> tuple[Column, Column]:
        kind, text = F.lower(F.lead("kind", ahead).over(order)), F.lead("text", ahead).over(order)
        bare = F.regexp_replace(T.prose(text), r"^(?i)(?:fig(?:ure)?\.?\s*\d+[a-z]?\.?\s*)", "")
        first = F.get(F.split(bare, r"(?<=[.!?])\s+", 2), F.lit(0))
        said = F.regexp_replace(F.substring(first, 1, 140), r"[\[\]]", "")
        return F.when(kind.isin(*T.PAGE_CAPTIONS) & (F.coalesce(text, F.lit("")) != ""), said), kind

    (one, kind), (two, _) = caption(1), caption(2)
    numbered = number_visuals(blocks, key)
    plain = F.concat_ws(" ", "kind", F.col("visual").cast("string"))
    found = F.coalesce(one, F.when(kind.isin(*VISUAL_KINDS), two), plain)
    return numbered.withColumn("alt", F.when(F.col("visual").isNotNull(), found))


def page_markdown(blocks: DataFrame, key: str) -> DataFrame:
    """``key, markdown`` of blocks in order, a blank line between; tables as Markdown's."""
    tabled = blocks.withColumn("_tabled", tables.tables_in("text"))
    lines = tabled.withColumn("_line", T.page_block(F.lower("kind"), F.col("text"), F.col("_tabled"))).filter("_line <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "_line"))), lambda e: e["_line"])
    return lines.groupBy(key).agg(F.array_join(ordered, "\n\n").alias("markdown"))


def assign_pages(blocks: DataFrame, key: str, pages: Column, drop: float = 80) -> DataFrame:
    """``page``: one more where a box begins well above the one before it; blocks without a box stay on the page."""
    order = Window.partitionBy(key).orderBy("ord")
    top = F.get("box", F.lit(1))
    before = F.last(top, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    resets = F.sum(F.coalesce((before > top + drop).cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return blocks.withColumn("page", F.least(resets.cast("int"), F.greatest(pages, F.lit(1)) - 1))


def backfill_pages(blocks: DataFrame, key: str, ahead: int = 3) -> DataFrame:
    """A visual block without a page anchored by text takes that of the first anchored caption among the next blocks."""
    order = Window.partitionBy(key).orderBy("ord")
    kind = F.lower(T.strip(F.col("label")))
    open_ = kind.isin(*T.VISUAL_LABELS, "table", "algorithm") & (F.col("confidence") != "text")
    nexts = [
        F.when(F.lower(T.strip(F.lead("label", k).over(order))).isin(*T.CAPTION_LABELS) & (F.lead("confidence", k).over(order) == "text"), F.lead("page", k).over(order))
        for k in range(1, ahead + 1)
    ]
    found = F.coalesce(*nexts)
    take = open_ & found.isNotNull()
    out = blocks.withColumns({"_page": F.when(take, found).otherwise(F.col("page")), "_confidence": F.when(take, "caption").otherwise(F.col("confidence"))})
    return out.drop("page", "confidence").withColumnsRenamed({"_page": "page", "_confidence": "confidence"})


def text_lines(pages: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, idx, text, score, box`` of pages that hold arrays ``texts, scores, boxes``; as many as texts, broken boxes null."""
    zipped = F.transform("texts", lambda t, i: F.struct(i.alias("idx"), t.alias("text"), F.get("scores", i).alias("score"), F.get("boxes", i).alias("box")))
    out = pages.select(*keys, F.explode(zipped).alias("l")).select(*keys, "l.*").filter(T.strip(F.col("text")) != "")
    return out.withColumn("box", F.when(G.is_proper_box(F.col("box")), F.col("box")))


def layout_output(lines: DataFrame, key: str) -> DataFrame:
    """``key, text``: what a model printed from its first tag on, noise left out. ``lines``: ``key, ord, line``."""
    noise = F.col("s") == ""
    for start in NOISE_STARTS:
        noise = noise | F.col("s").startswith(start)
    order = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.max(F.contains(F.col("s"), F.lit("<|det|>")).cast("int")).over(order)
    kept = lines.withColumn("s", T.strip(F.col("line"))).withColumn("_seen", seen).filter((F.col("_seen") == 1) & ~noise)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "s"))), lambda e: e["s"])
    return kept.groupBy(key).agg(F.array_join(ordered, "\n").alias("text"))


def anchored_pages(blocks: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """``key, ord, page, confidence``: pages of blocks by their words in the pages' texts, else by resets of position.

    ``blocks``: ``key, ord, label, text, box``; ``pages``: ``key, page, text``. Where a search begins depends on the page
    before, so a document's rows go through Python together; documents are independent. Visual blocks then take the page
    of an anchored caption behind them.
    """
    import pandas as pd

    def run(own: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        said = [f" {t} " for t in texts.sort_values("page")["text"].fillna("")]
        last, top, page, out = max(1, len(said)) - 1, None, 0, []
        for row in own.sort_values("ord").itertuples():
            words, y = (row.words or "").split(), None if row.top is None or pd.isna(row.top) else row.top
            found = anchor(words, said, page)
            if found is not None:
                page, confidence = found, "text"
                top = top if y is None else y
            else:
                if y is not None:
                    page += top is not None and y + 80 < top and page < last
                    top = y
                confidence = "heuristic" if last else "single-page"
            out.append((getattr(row, key), row.ord, row.label, page, confidence))
        return pd.DataFrame(out, columns=[key, "ord", "label", "page", "confidence"])

    left = blocks.select(key, "ord", "label", T.anchor_words(F.coalesce("text", F.lit(""))).alias("words"), F.get("box", F.lit(1)).alias("top"))
    right = pages.select(key, "page", T.anchor_words(F.coalesce("text", F.lit(""))).alias("text"))
    kind = f"{key} long, ord long, label string, page int, confidence string"
    placed = left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(run, kind)
    return backfill_pages(placed, key)


def anchor(words: list[str], pages: list[str], current: int, sizes: tuple[int, ...] = (18, 12, 8, 5)) -> int | None:
    """The page that alone holds the first words, the longest stretch first; of several the first from the current one on."""
    if len(words) < 4:
        return None
    stretches = [words[:n] for n in sizes if len(words) >= n] or [words[:6]]
    for stretch in stretches:
        text = " ".join(stretch)
        held = [i for i, page in enumerate(pages) if text in page] if len(text) >= 16 else []
        if held:
            return held[0] if len(held) == 1 else next((i for i in held if i >= current), held[0])
    return None
