"""Results of pages: assembly, flattening, edits, nested walks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import records as R
from ..functions import text as T

BOX_IMAGE = r'<img\s+src="images/bbox_(\d+)_(\d+)_(\d+)_(\d+)\.jpg"[^>]*>'


def page_spine(docs: DataFrame, blocks: DataFrame, key: str, pages: Column) -> DataFrame:
    """``key, page, n_blocks, labels``: every page of a document with its blocks' labels in order; pages without blocks too."""
    spine = docs.select(key, F.explode(F.sequence(F.lit(0), F.greatest(pages, F.lit(1)) - 1)).alias("page"))
    placed = blocks.groupBy(key, "page").agg(F.count("*").alias("n_blocks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda b: b["label"]), ",").alias("labels"))
    return spine.join(placed, [key, "page"], "left").select(key, "page", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce("labels", F.lit("")).alias("labels"))


def document_text(pages: DataFrame, key: str, separator: str = "\n\n", keep_empty: bool = False) -> DataFrame:
    """Page texts of a document in order with a separator; empty pages may keep their place."""
    shown = pages if keep_empty else pages.filter(F.coalesce(F.col("text"), F.lit("")) != "")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"])
    return shown.groupBy(key).agg(F.array_join(ordered, separator).alias("text"))


def render_blocks(pages: DataFrame, key: str, ignored: list[str]) -> DataFrame:
    """``key, page, idx, label, content``: blocks that are shown. ``pages``: ``key, pos, page, blocks`` of alias fields.

    A block needs a box of four numbers, and text unless its label is visual; a page number of 0 counts as none.
    """
    flat = pages.select(key, F.coalesce(F.nullif("page", F.lit(0)), F.col("pos") + 1).alias("page"), F.posexplode_outer("blocks").alias("idx", "b")).filter("b IS NOT NULL")
    box, label = F.coalesce("b.block_bbox", "b.bbox"), R.first_filled(F.col("b.block_label"), F.col("b.label"))
    content = F.coalesce("b.block_content", "b.text", F.lit(""))
    kept = (F.size(box) >= 4) & ~F.lower(label).isin(*ignored) & ((T.strip(content) != "") | R.is_visual(label))
    return flat.filter(kept).select(key, "page", "idx", label.alias("label"), content.alias("content"))


def edited(lines: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with the texts of edits where there is one."""
    own = edits.select(*keys, F.col("text").alias("_edit"))
    return lines.join(own, keys, "left").withColumn("text", F.coalesce("_edit", "text")).drop("_edit")


def box_images(pages: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``keys, idx, box`` of images that Markdown refers to by a box in its name."""
    sides = [F.regexp_extract_all(column, F.lit(BOX_IMAGE), F.lit(k)) for k in (1, 2, 3, 4)]
    zipped = F.transform(sides[0], lambda v, i: F.struct(i.alias("idx"), F.array(*[F.get(s, i).cast("double") for s in sides]).alias("box")))
    return pages.select(*keys, F.explode(zipped).alias("b")).select(*keys, "b.*")


def current_position(blocks: DataFrame, key: str) -> DataFrame:
    """``key, page, progress`` of the last block with a box, a sure one if there is any, else of the last block."""
    boxed, sure = F.col("box").isNotNull(), F.col("confidence").isin("text", "caption", "single-page")
    rank = F.struct((boxed & sure).alias("a"), boxed.alias("b"), F.col("ord").alias("c"))
    last = blocks.groupBy(key).agg(F.max_by(F.struct("page", "box"), rank).alias("x"))
    return last.select(key, F.coalesce("x.page", F.lit(0)).alias("page"), F.coalesce(G.vertical_progress(F.col("x.box"), F.lit(1000)), F.lit(0.0)).alias("progress"))


def new_suffix(old: DataFrame, new: DataFrame, keys: list[str], order: str, mark: str) -> DataFrame:
    """Rows of ``new`` from the first place on where it differs from ``old``; none of a key's rows before it changed."""
    before = old.select(*keys, order, F.col(mark).alias("_old"))
    both = new.join(before, [*keys, order], "left").withColumn("_same", F.col(mark).eqNullSafe(F.col("_old")))
    broken = F.max((~F.col("_same")).cast("int")).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("_broken", broken).filter("_broken = 1").drop("_old", "_same", "_broken")


def first_success(attempts: DataFrame, key: str, order: str) -> DataFrame:
    """The first attempt that worked, where all before it ran out of memory."""
    blocked = F.max((F.col("error").isNotNull() & (F.col("error") != "oom")).cast("int")).over(Window.partitionBy(key).orderBy(order))
    return attempts.withColumn("_blocked", blocked).filter("error IS NULL AND _blocked = 0").groupBy(key).agg(F.min(order).alias(order))


def fragments(value) -> Iterator[str]:
    """Markdown texts in a nested result, a text of the top level alone if there is one."""
    if isinstance(value, list):
        for item in value:
            yield from fragments(item)
    elif isinstance(value, dict):
        own = value.get("markdown")
        if isinstance(own, str):
            yield own
        elif isinstance(own, dict) and isinstance(own.get("text"), str):
            yield own["text"]
        for name, item in value.items():
            if name != "markdown":
                yield from fragments(item)


def without_keys(value, names: frozenset[str]):
    if isinstance(value, list):
        return [without_keys(item, names) for item in value]
    if isinstance(value, dict):
        return {k: without_keys(v, names) for k, v in value.items() if k not in names}
    return value


def _json_udf(column: str, function) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                out.append(function(json.loads(text)))
            except (TypeError, ValueError):
                out.append(None)
        return pa.array(out, pa.string())

    return run(F.col(column))


def result_markdown(column: str) -> Column:
    """Markdown of a result in JSON: of the top level, else its different fragments in order; null if it isn't JSON."""

    def of(value) -> str:
        top = value.get("markdown") if isinstance(value, dict) else None
        if isinstance(top, str) and top.strip():
            return top.strip()
        return "\n\n".join(dict.fromkeys(x.strip() for x in fragments(value) if x.strip()))

    return _json_udf(column, of)


def light_json(column: str, *names: str) -> Column:
    """JSON without the named fields at any depth; null if it isn't JSON."""
    dropped = frozenset(names)
    return _json_udf(column, lambda value: json.dumps(without_keys(value, dropped), ensure_ascii=False, separators=(",", ":")))


_math = re.compile(r"\$\$[\s\S]*?\$\$|\\\[[\s\S]*?\\\]|\\\([\s\S]*?\\\)|\$(?:[^$\n]|\\.)+?\$")


def stash(text: str) -> tuple[str, list[str]]:
    """A text with tokens for its formulas, and the formulas."""
    held: list[str] = []

    def token(m: re.Match) -> str:
        held.append(m[0])
        return f"@@math{len(held) - 1}@@"

    return _math.sub(token, text), held


def stashed(column: str) -> Column:
    """``struct<text, math array<string>>``; only texts with a mark of a formula go through Python."""

    @F.arrow_udf("text string, math array<string>")
    def run(texts: pa.Array) -> pa.Array:
        pairs = [("", []) if t is None else stash(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in pairs], pa.string()), pa.array([m for _, m in pairs], pa.list_(pa.string()))], ["text", "math"])

    return run(F.col(column))


def unstashed(text: Column, math: Column) -> Column:
    """Tokens replaced by the formulas that they stand for."""
    entries = F.transform(math, lambda m, i: F.struct(F.concat(F.lit("@@math"), i.cast("string"), F.lit("@@")).alias("k"), m.alias("v")))
    return F.aggregate(entries, text, lambda t, e: F.replace(t, e["k"], e["v"]))


def edits_applied(text: Column, edits: Column) -> Column:
    """A text with its edits, structs ``start, end, by`` (code points from 0, ends exclusive), the last start first, so that places hold."""
    descending = F.reverse(F.array_sort(edits))
    return F.aggregate(descending, text, lambda t, e: F.concat(F.substring(t, F.lit(1), e["start"]), e["by"], F.substring(t, e["end"] + 1, F.length(t))))
