"""Scalar functions as columns; all of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Three-valued answers, and the text of an instance's name.
TRISTATE = ("yes", "no", "unknown")
INSTANCE_NAME = r"SM(\d+)-(\d+)\s+\((\d+)p\)"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def remap(v: str | Column, a: float, b: float, c: float, d: float) -> Column:
    """v from the range a..b to the range c..d, linearly."""
    return (_c(v) - a) * ((d - c) / (b - a)) + c


def welsch(r: str | Column, scale: float) -> Column:
    return F.exp(-0.5 * (_c(r) / scale) * (_c(r) / scale))


def huber(r: str | Column, scale: float) -> Column:
    return F.when(F.abs(_c(r)) <= scale, 1.0).otherwise(scale / F.abs(_c(r)))


def sigmoid(x: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


def gray(v: str | Column, lo: str | Column, hi: str | Column) -> Column:
    """An intensity as 0..255: truncated, 128 where it isn't a number or the range is empty."""
    v, lo, hi = _c(v).cast("double"), _c(lo), _c(hi)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (hi <= lo)
    return F.when(bad, 128).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (v - lo) / (hi - lo) * 255.0)).cast("int")).cast("short")


def plain_double(v: str | Column) -> Column:
    """Six decimals without trailing zeros, but one digit behind the point."""
    return F.regexp_replace(F.format_string("%.6f", _c(v).cast("double")), r"(\.[0-9]+?)0+$", "$1")


def duration_text(start: str | Column, end: str | Column) -> Column:
    """running (no end), unknown (no start), else `12s`, `3m 4s` or `2h 5m`."""
    s = (F.unix_seconds(_c(end).cast("timestamp")) - F.unix_seconds(_c(start).cast("timestamp"))).cast("long")
    whole = lambda n: F.floor(s / n).cast("long")
    return (F.when(_c(end).isNull(), "running").when(_c(start).isNull(), "unknown").when(s < 60, F.concat(s.cast("string"), F.lit("s")))
            .when(s < 3600, F.format_string("%dm %ds", whole(60), s % 60)).otherwise(F.format_string("%dh %dm", whole(3600), F.floor((s % 3600) / 60).cast("long"))))


def instance_name(cls: str | Column, instance: str | Column, n: str | Column) -> Column:
    return F.format_string("SM%d-%d (%dp)", _c(cls), _c(instance), _c(n))


def instance_class(name: str | Column, anywhere: bool = False) -> Column:
    """The class in an instance's name, -1 if it is none; the whole text must be a name, or hold one `anywhere`."""
    got = F.regexp_extract(_c(name), INSTANCE_NAME if anywhere else f"^{INSTANCE_NAME}$", 1)
    return F.coalesce(F.when(got != "", got.try_cast("int")), F.lit(-1))


def utc_epoch(text: str | Column) -> Column:
    """Seconds since 1970 of `2026-04-22T10:52:04Z`, -1 for other texts; the session's zone must be UTC."""
    head = F.regexp_extract(_c(text), r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})", 1)
    return F.coalesce(F.unix_seconds(F.try_to_timestamp(head, F.lit("yyyy-MM-dd'T'HH:mm:ss"))).cast("double"), F.lit(-1.0))


def filename_epoch(stem: str | Column) -> Column:
    """The same of a file name like `2026-04-22T10-52-05.043_9fa66e5c`; milliseconds are dropped."""
    return utc_epoch(F.regexp_replace(F.substring(_c(stem), 1, 19), r"^(.{13})-(..)-(..)$", "$1:$2:$3"))


def filename_id(stem: str | Column) -> Column:
    """What follows the last underscore; the whole stem if nothing does."""
    tail = F.substring_index(_c(stem), "_", -1)
    return F.when(tail == "", _c(stem)).otherwise(tail)


def md5_uuid(value: str | Column) -> Column:
    """A UUID made of the MD5 of a value."""
    return F.regexp_replace(F.md5(_c(value).cast("binary")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def palette(label: str | Column, size: int = 256) -> Column:
    """A colour (struct r, g, b) per label; labels repeat after `size`, negative ones are black. Colours follow from the label by
    steps of the golden ratio over the hue, so no table is needed."""
    k = F.pmod(_c(label), F.lit(size))
    h = (k * 0.6180339887498949) % 1.0 * 6.0
    level = F.when(k % 3 == 0, 255.0).when(k % 3 == 1, 200.0).otherwise(145.0)
    ramp = lambda shift: (level * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(((h + shift) % 6.0) - 3.0) - 1.0))).cast("int")
    dark = _c(label) < 0
    return F.struct(*(F.when(dark, 0).otherwise(ramp(s)).cast("short").alias(c) for c, s in (("r", 0.0), ("g", 4.0), ("b", 2.0))))
