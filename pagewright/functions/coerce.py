"""Coercion, defaults and validation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def to_bool(c: Column, default: bool = False) -> Column:
    return F.when(c.isNull(), F.lit(default)).otherwise(F.lower(strip(c)).isin("1", "true", "yes", "on"))


def optional(c: Column, kind: str) -> Column:
    """Null and empty are null; anything else must cast."""
    return F.nullif(c, F.lit("")).cast(kind)


def at_least(c: Column, kind: str, default: float, low: float) -> Column:
    return F.greatest(F.lit(low).cast(kind), F.coalesce(c.try_cast(kind), F.lit(default).cast(kind)))


def batch_size(c: Column, most: int = 400, default: int = 1) -> Column:
    """Leading digits of a text, from 1 to most."""
    digits = F.nullif(F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1), F.lit(""))
    parsed = F.least(F.greatest(digits.try_cast("decimal(38,0)"), F.lit(1)), F.lit(most)).cast("int")
    return F.coalesce(parsed, F.lit(default))


def csv_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda v: v != "")


def one_of(c: Column, allowed: tuple[str, ...], fallback: Column) -> Column:
    """A known name in lower case, else a known fallback, else null."""
    name, other = F.lower(strip(c)), F.lower(strip(fallback))
    return F.coalesce(F.when(name.isin(*allowed), name), F.when(other.isin(*allowed), other))


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def epoch(c: Column) -> Column:
    """A sortable number from a number, a number as text or an ISO time; else 0. Units stay as they are written."""
    text = F.nullif(strip(c), F.lit(""))
    moment = F.unix_micros(text.try_cast("timestamp")) / F.lit(1e6)
    return F.coalesce(text.try_cast("double"), F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), moment), F.lit(0.0))


def newest(updated: Column, created: Column) -> Column:
    return epoch(F.coalesce(F.nullif(updated, F.lit("")), created))


def expiry(created: Column, ttl: Column) -> Column:
    return F.when(ttl > 0, created + ttl)


def is_task_id(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9_-]{6,80}\z")


def is_safe_path(c: Column) -> Column:
    """Relative, without empty, dot, dot-dot or colon parts."""
    parts = F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/")
    return F.forall(parts, lambda p: ~p.isin("", ".", "..") & ~F.contains(p, F.lit(":")))


def from_base64(c: Column) -> Column:
    """Bytes of base64 with a data URL's head and white space tolerated; null where it isn't base64."""
    return F.try_to_binary(F.regexp_replace(F.regexp_replace(c, r"^data:[^,]*,", ""), r"\s", ""), F.lit("base64"))


def elapsed(began: Column, ended: Column) -> Column:
    """Seconds between two times, to the thousandth, halves to even; null while one is missing."""
    return F.bround((F.unix_micros(ended) - F.unix_micros(began)) / F.lit(1e6), 3)


def progress_seconds(began: Column, now: Column) -> Column:
    """Whole seconds since a time, never below 0; 0 where none is given."""
    return F.coalesce(F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(began)) / F.lit(1e6))), F.lit(0)).cast("long")


def utc_stamp(moment: Column) -> Column:
    """A time as ISO 8601 in UTC, to the second."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), moment.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def display_date(moment: Column, now: Column) -> Column:
    """Month, day, hour and minute; the year only where it isn't the present one."""
    same = F.year(moment) == F.year(now)
    return F.when(same, F.date_format(moment, "MM/dd, HH:mm")).otherwise(F.date_format(moment, "MM/dd/yyyy, HH:mm"))
