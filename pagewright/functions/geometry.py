"""Boxes of four numbers as column expressions: x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normalized coordinates go up to this.
UNIT = 1000.0


def _parts(box: Column) -> list[Column]:
    return [F.get(box, F.lit(i)) for i in range(4)]


def _finite_parts(box: Column) -> list[Column]:
    """The four numbers, null unless all are finite, so that no cast overflows."""
    return [F.when(is_finite_box(box), x) for x in _parts(box)]


def _clamped(x: Column, most: Column) -> Column:
    return F.greatest(F.lit(0), F.least(most.cast("int"), x.cast("int")))


def is_finite_box(box: Column) -> Column:
    """Four finite numbers or more."""
    four = F.slice(box, 1, 4)
    return (F.size(box) >= 4) & F.forall(four, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def is_proper_box(box: Column) -> Column:
    x1, y1, x2, y2 = _parts(box)
    return is_finite_box(box) & (x2 > x1) & (y2 > y1)


def outward_pixels(box: Column, width: Column, height: Column) -> Column:
    """Pixels of a normalized box: the near sides cut off, the far sides rounded up; null if empty or not finite."""
    x1, y1, x2, y2 = _finite_parts(box)
    sides = [_clamped(x1 / UNIT * width, width), _clamped(y1 / UNIT * height, height), _clamped(F.ceil(x2 / UNIT * width), width), _clamped(F.ceil(y2 / UNIT * height), height)]
    fits = is_finite_box(box) & (width > 0) & (height > 0)
    return F.when(fits & (sides[2] > sides[0]) & (sides[3] > sides[1]), F.array(*sides))


def nearest_pixels(box: Column, width: Column, height: Column) -> Column:
    """Pixels of a normalized box, halves to even; null if empty."""
    x1, y1, x2, y2 = _finite_parts(box)
    sides = [_clamped(F.rint(v * s / UNIT), s) for v, s in ((x1, width), (y1, height), (x2, width), (y2, height))]
    return F.when((sides[2] > sides[0]) & (sides[3] > sides[1]), F.array(*sides))


def crop_pixels(box: Column, width: Column, height: Column) -> Column:
    """Pixels with a margin, of a box whose scale is guessed: normalized on large pages, shrunk where it exceeds the page."""
    x1, y1, x2, y2 = _finite_parts(box)
    normalized = (width > 1400) & (F.greatest(x1, y1, x2, y2) <= 1150)
    exceeds = (x2 > width) | (y2 > height)
    shrink = F.least(width / F.greatest(x2, F.lit(1.0)), height / F.greatest(y2, F.lit(1.0)))
    sx = F.when(normalized, width / UNIT).when(exceeds, shrink).otherwise(F.lit(1.0))
    sy = F.when(normalized, height / UNIT).when(exceeds, shrink).otherwise(F.lit(1.0))
    a, b, c, d = x1 * sx, y1 * sy, x2 * sx, y2 * sy
    px = F.greatest(F.lit(6), ((c - a) * 0.02).cast("int"))
    py = F.greatest(F.lit(6), ((d - b) * 0.02).cast("int"))
    left, top = F.greatest(F.lit(0), a.cast("int") - px), F.greatest(F.lit(0), b.cast("int") - py)
    right, bottom = F.least(width.cast("int"), c.cast("int") + px), F.least(height.cast("int"), d.cast("int") + py)
    return F.when((x2 > x1) & (y2 > y1) & (right > left) & (bottom > top), F.array(left, top, right, bottom))


def polygon_box(points: Column) -> Column:
    """The box around points, in order, of an array of arrays of two."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def vertical_progress(box: Column, height: Column) -> Column:
    """The middle of a box down its page, from 0 to 1."""
    return F.least(F.greatest((F.get(box, F.lit(1)) + F.get(box, F.lit(3))) / 2 / F.greatest(height, F.lit(1)), F.lit(0.0)), F.lit(1.0))


def parse_box(text: Column) -> Column:
    """The first four signed numbers of a text, or null."""
    found = F.regexp_extract_all(text, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    return F.when(F.size(found) >= 4, F.transform(F.slice(found, 1, 4), lambda v: v.cast("double")))


def limit_scale(width: Column, height: Column, pixels: Column, edge: Column) -> Column:
    """The scale, 1 at most, that keeps an image within pixels and its longer side within edge."""
    return F.least(F.lit(1.0), F.sqrt(pixels / (width * height)), edge / F.greatest(width, height))


def rendered_pixels(width: Column, height: Column, dpi: Column | int) -> Column:
    """Pixels of a page of points rendered at a resolution, each side cut to whole pixels."""
    scale = (dpi if isinstance(dpi, Column) else F.lit(dpi)) / F.lit(72.0)
    return F.floor(width * scale).cast("long") * F.floor(height * scale).cast("long")


def coordinate_bounds_of(width: Column, height: Column, boxes: Column) -> Column:
    """The larger of a page's sides and the far ends of its boxes, across and down."""
    far = lambda k: F.array_max(F.transform(boxes, lambda b: F.get(b, F.lit(k))))
    return F.array(F.greatest(width, F.coalesce(far(2), width)), F.greatest(height, F.coalesce(far(3), height)))
