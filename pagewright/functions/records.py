"""Task, model and result records as column expressions: defaults, states, aliases, images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Parsers that stamp lineage, labels and their other names, always ignored labels.
LINEAGE_PARSERS = ("pp-ocrv6", "unlimited-ocr", "ovis-ocr2", "hpd-parsing")
LABEL_ALIASES = {"number": "page_number", "header_image": "header", "footer_image": "footer", "footnote": "page_footnote"}
DEFAULT_IGNORED = ("header", "footer", "page_number")
VISUAL = ("image", "chart", "table", "algorithm")
FORMULAS = ("equation", "equation_block", "formula")


def first_filled(*columns: Column) -> Column:
    """The first that isn't null or empty, else the empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def response_text(markdown: Column, text: Column, result: Column) -> Column:
    """Markdown wins even where it is empty; the others only where they are filled."""
    return F.when(markdown.isNotNull(), markdown).otherwise(first_filled(text, result))


def payload(**fields: Column) -> Column:
    """A request in JSON with the fields that aren't null."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))


def results_of(layout: Column, pages: Column, results: Column, markdown: Column) -> Column:
    """The first list of results by its several names, else one result of the text."""
    return F.coalesce(layout, pages, results, F.array(F.coalesce(markdown, F.lit(""))))


def model_record(identity: Column, name: Column, label: Column, default: str) -> Column:
    known, called = F.nullif(identity, F.lit("")), F.nullif(name, F.lit(""))
    fallback = F.lit(default)
    return F.struct(
        F.coalesce(known, called, fallback).alias("id"),
        F.coalesce(called, known, fallback).alias("name"),
        F.coalesce(F.nullif(label, F.lit("")), called, known, fallback).alias("label"),
    )


def source_page(parser: Column, start: Column, position: Column) -> Column:
    return F.when(parser.isin(*LINEAGE_PARSERS), F.coalesce(start, F.lit(1)) + position)


def ignored_labels(numbers: Column, headers: Column, footers: Column) -> Column:
    """Labels that settings leave out, in the order that they are sent."""
    optional = lambda on, *names: F.when(on, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    return F.concat(
        optional(numbers, "number"), F.array(F.lit("footnote")), optional(headers, "header", "header_image"), optional(footers, "footer", "footer_image"), F.array(F.lit("aside_text")),
    )


def requested_ignores(labels: Column) -> Column:
    """Asked labels under their usual names; the defaults where none is asked."""
    names = F.create_map(*[F.lit(x) for pair in LABEL_ALIASES.items() for x in pair])
    asked = F.array_distinct(F.transform(labels, lambda x: F.coalesce(F.try_element_at(names, x), x)))
    return F.array_sort(F.when(F.size(labels) > 0, asked).otherwise(F.array(*map(F.lit, DEFAULT_IGNORED))))


def flat_labels(items: Column) -> Column:
    """Labels of a list whose items may be lists in JSON, in lower case, each once; those from lists come last."""
    parsed = F.transform(items, lambda x: F.from_json(x, "array<string>"))
    is_list = lambda x: x.rlike(r"^\s*\[.*\]\s*\z")
    plain = F.filter(items, lambda x: ~is_list(x))
    nested = F.flatten(F.filter(parsed, lambda x: x.isNotNull()))
    lower = F.transform(F.concat(plain, F.coalesce(nested, F.array().cast("array<string>"))), lambda x: F.lower(strip(x)))
    return F.array_distinct(F.filter(lower, lambda x: x != ""))


def light_batches(batches: Column, *heavy: str) -> Column:
    """Batches without their heavy fields."""
    return F.transform(batches, lambda b: b.dropFields(*heavy))


def is_exclusively_ready(model: Column, ready: Column, violation: Column, running: Column, ready_ids: Column, active: Column) -> Column:
    """Ready, and nothing else is: lists that are null say nothing."""
    only = lambda ids: ids.isNull() | (F.array_distinct(ids) == F.array(model))
    return F.coalesce(ready, F.lit(False)) & ~F.coalesce(violation, F.lit(False)) & only(running) & only(ready_ids) & (F.coalesce(F.nullif(active, F.lit("")), model) == model)


def resumes(status: Column, batches: Column, done_pages: Column, pages: Column) -> Column:
    """Whether a stopped task has done some of its work and not all. ``batches``: array of states, null if unknown."""
    done, left = F.exists(batches, lambda s: s == "completed"), F.exists(batches, lambda s: ~s.eqNullSafe(F.lit("completed")))
    active = (status == "processing") | F.coalesce(F.exists(batches, lambda s: s == "processing"), F.lit(False))
    by_pages = (F.coalesce(done_pages, F.lit(0)) > 0) & ((F.coalesce(pages, F.lit(0)) == 0) | (done_pages < pages))
    return ~active & status.isin("pending", "error") & F.when(batches.isNotNull(), done & left).otherwise(by_pages)


def replans(kind: Column, has_source: Column, pages: Column, batches: Column, planned: Column, wanted: Column, most: int = 400) -> Column:
    """Whether a plan is made anew: nothing is done yet, and there is none or its size is another. ``batches``: structs ``status, pages``."""
    none_done = ~F.exists(batches, lambda b: b["status"] == "completed")
    other = (F.size(batches) == 0) | (F.coalesce(planned, F.lit(0)) != wanted) | (planned > most) | F.exists(batches, lambda b: b["pages"] > most)
    return has_source & kind.isin("pdf", "office") & (F.coalesce(pages, F.lit(0)) > 0) & none_done & other


def reconciled_status(status: Column, batches: Column, results: Column, done_pages: Column, pages: Column, loaded: Column) -> Column:
    """What an interrupted task is after a restart: completed if all is there, else pending."""
    all_done = (F.size(batches) > 0) & F.forall(batches, lambda s: s == "completed") & (results >= F.size(batches))
    by_pages = ~loaded & pages.isNotNull() & (F.coalesce(done_pages, F.lit(0)) >= pages)
    return F.when(status != "processing", status).when(all_done | by_pages, "completed").otherwise("pending")


def runtime_state(missing: Column, healthy: Column, health_state: Column, any_running: Column, all_running: Column) -> Column:
    return F.when(missing, "missing").when(healthy, health_state).when(any_running & all_running, "starting").when(any_running, "partial").otherwise("stopped")


def valid_lease(lease: Column, model: Column, created: Column, expires: Column) -> Column:
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (F.coalesce(lease, F.lit("")) != "") & model.isNotNull() & finite(created) & (expires.isNull() | (finite(expires) & (expires >= created)))


def image_source(value: Column) -> Column:
    text = F.coalesce(value, F.lit(""))
    return F.when(text.rlike("(?i)^(https?:|data:|blob:|ocr_images/)"), text).otherwise(F.concat(F.lit("data:image/jpeg;base64,"), text))


def is_visual(label: Column) -> Column:
    return F.lower(F.coalesce(label, F.lit(""))).isin(*VISUAL)


def has_cjk(text: Column) -> Column:
    return text.rlike("[\\x{3400}-\\x{9fff}]")


def source_label(kind: Column, name: Column) -> Column:
    return F.when(kind == "office", F.concat(F.lit("Office as PDF · "), F.coalesce(name, F.lit("")))).when(kind == "image", "Image").otherwise("PDF")


def page_count_label(pages: Column) -> Column:
    return F.concat(pages.cast("string"), F.when(pages == 1, " page").otherwise(" pages"))


def namespaced(images: Column, batch: Column) -> Column:
    """Image names under their batch's folder, marks other than letters, digits, dots and dashes replaced."""
    return F.transform_keys(images, lambda name, _: F.concat(F.lit("ocr_images/"), batch, F.lit("_"), F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")))


def ngrams(text: Column, n: int) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def strict_object(text: Column) -> Column:
    """Valid JSON that is an object without a name twice, else null."""
    value = F.try_parse_json(text)
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), text)


def content_format(kind: Column, content: Column) -> Column:
    text = strip(content)
    fence = F.lit("```")
    return (
        F.when(text == "", "")
        .when((kind == "title") & ~text.startswith("#"), F.concat(F.lit("# "), text))
        .when(kind.isin(*FORMULAS) & ~(text.startswith("$") | text.startswith("\\(") | text.startswith("\\[")), F.concat(F.lit("$$\n"), text, F.lit("\n$$")))
        .when((kind == "code") & ~text.startswith("```"), F.concat(fence, F.lit("\n"), text, F.lit("\n"), fence))
        .otherwise(text)
    )


def _units(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def _base36(value: Column) -> Column:
    return F.lower(F.conv(value.cast("string"), 10, 36))


def hash31(text: Column) -> Column:
    """31 times the hash plus each character, in 32 bits, in base 36."""
    return _base36(F.aggregate(_units(text), F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))


def hash33(text: Column) -> Column:
    """33 times the hash from 5381, exclusive or each character, in 32 bits, in base 36."""
    return _base36(F.aggregate(_units(text), F.lit(5381).cast("long"), lambda h, c: (h * 33).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).bitwiseXOR(c)))


def point_box(points: Column, width: Column, height: Column) -> Column:
    """A pixel box of four or more numbers, pairs as points; up to 1.5 they are shares of the page; in order, within it."""
    xs, ys = F.filter(points, lambda v, i: i % 2 == 0), F.filter(points, lambda v, i: i % 2 == 1)
    many = F.size(points) >= 8
    at = lambda i: F.get(points, F.lit(i))
    sides = [F.when(many, f(v)).otherwise(at(i)) for i, (f, v) in enumerate(((F.array_min, xs), (F.array_min, ys), (F.array_max, xs), (F.array_max, ys)))]
    unit = F.greatest(*map(F.abs, sides)) <= 1.5
    scaled = [F.rint(F.when(unit, v * s).otherwise(v)) for v, s in zip(sides, (width, height, width, height), strict=True)]
    fit = lambda v, s: F.greatest(F.lit(0), F.least(s, v.cast("int")))
    ordered = [F.least(scaled[0], scaled[2]), F.least(scaled[1], scaled[3]), F.greatest(scaled[0], scaled[2]), F.greatest(scaled[1], scaled[3])]
    return F.when(F.size(points) >= 4, F.array(*[fit(v, s) for v, s in zip(ordered, (width, height, width, height), strict=True)]))


def coordinate_bounds(parser: Column, box: Column, width: Column, height: Column) -> Column:
    """The page size that a box is measured in: 1000 for parsers that normalize, if the box fits that, else the page's own."""
    largest = F.array_max(F.transform(F.slice(box, 1, 4), F.abs))
    fits = (F.size(box) >= 4) & (largest <= 1000.5)
    square = (F.round(width) == 1024) & (F.round(height) == 1024)
    unit = fits & ((F.lower(parser) == "hpd-parsing") | ((F.lower(parser) == "unlimited-ocr") & square))
    return F.when((F.coalesce(width, F.lit(0)) != 0) & (F.coalesce(height, F.lit(0)) != 0), F.when(unit, F.array(F.lit(1000.0), F.lit(1000.0))).otherwise(F.array(width.cast("double"), height.cast("double"))))


def clamped_page(page: Column, start: Column, count: Column) -> Column:
    """A page within a batch of pages from start."""
    return F.least(F.greatest(page, start), start + F.greatest(count, F.lit(1)) - 1)


def needs_compaction(version: Column, *heavy: Column) -> Column:
    """Whether a stored task is of an old version or still holds heavy fields."""
    held = F.lit(False)
    for column in heavy:
        held = held | column.isNotNull()
    return (F.coalesce(version, F.lit(0)) < 2) | held


def benchmark_record(model: Column, name: Column, kind: Column, size: Column, pages: Column, backend: Column) -> Column:
    """What a run is recorded with; zero sizes and counts are unknown."""
    return F.struct(
        F.nullif(model, F.lit("")).alias("modelId"), F.nullif(name, F.lit("")).alias("name"), kind.alias("kind"),
        F.nullif(size, F.lit(0)).alias("sizeBytes"), F.nullif(pages, F.lit(0)).alias("pageCount"), F.nullif(backend, F.lit("")).alias("backend"),
    )


def block_record(label: Column, content: Column, box: Column, order: Column) -> Column:
    return F.struct(F.coalesce(label, F.lit("text")).alias("block_label"), F.coalesce(content, F.lit("")).alias("block_content"), box.alias("block_bbox"), order.alias("block_order"))


def uses_parser(model: Column, parsers: Column, name: str) -> Column:
    """Whether a task or any of its pages is of a parser."""
    return (F.lower(F.coalesce(model, F.lit(""))) == name) | F.coalesce(F.exists(parsers, lambda p: F.lower(p) == name), F.lit(False))


def history_locked(processing: Column, switching: Column, active: Column) -> Column:
    return F.coalesce(processing, F.lit(False)) | F.coalesce(switching, F.lit(False)) | (F.coalesce(active, F.lit(0)) > 0)


def copied_text(view: Column, record: Column, markdown: Column) -> Column:
    """What a copy takes: the record in JSON in that view, else the Markdown."""
    return F.when(view == "json", F.to_json(record)).otherwise(F.coalesce(markdown, F.lit("")))


def cache_key(*parts: Column) -> Column:
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def zipped_pages(texts: Column, images: Column) -> Column:
    """Pages from parallel lists, as many as the shorter has."""
    count = F.least(F.size(texts), F.size(images))
    return F.slice(F.arrays_zip(texts.alias("text"), images.alias("images")), F.lit(1), count)


def percent_box(box: Column, width: Column, height: Column) -> Column:
    """A box as left, top, width and height in hundredths of its page; rounded once, in the division."""
    at = lambda i: F.get(box, F.lit(i))
    return F.array(at(0) * 100 / width, at(1) * 100 / height, (at(2) - at(0)) * 100 / width, (at(3) - at(1)) * 100 / height)


def polygon_bounds(xs: Column, width: Column) -> Column:
    """A page's width, or where a box goes beyond it, that."""
    return F.greatest(width, F.array_max(xs))
