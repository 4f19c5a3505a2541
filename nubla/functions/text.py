"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED, PLAIN = "áéíóúÁÉÍÓÚñÑüÜ", "aeiouAEIOUnNuU"


def remove_accents(text: Column) -> Column:
    """Fourteen Spanish letters without their marks; others stay."""
    return F.translate(text, ACCENTED, PLAIN)


def normalize(text: Column) -> Column:
    return F.lower(remove_accents(text))


def matches_ignoring_accents(a: Column, b: Column) -> Column:
    return normalize(a) == normalize(b)


def trim_space(text: Column) -> Column:
    """Without any white space at the ends (Spark's trim cuts blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_spaces(text: Column) -> Column:
    return trim_space(F.regexp_replace(text, r"\s+", " "))


def capitalize(text: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))


def escape_html(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def before(text: Column, start: Column, size: int) -> Column:
    """Up to ``size`` characters before an offset."""
    return F.substring(text, F.greatest(start - size, F.lit(0)) + 1, F.least(start, F.lit(size)))


def after(text: Column, end: Column, size: int) -> Column:
    return F.substring(text, end + 1, F.lit(size))


PAGE = 1024


def pages(text: Column) -> Column:
    """A text in pages of ``PAGE`` characters, from which pieces are taken in constant time: ``substring`` counts characters
    from the text's beginning."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PAGE).cast("int")), lambda i: F.substring(text, i * PAGE + 1, F.lit(PAGE)))


def ahead_of(pages: Column, start: Column, size: int) -> Column:
    """``before`` of a text in pages; ``size`` is a page at most."""
    page = F.floor(start / PAGE).cast("int")
    first = F.greatest(page - 1, F.lit(0))
    two = F.concat(F.get(pages, first), F.when(page > 0, F.coalesce(F.get(pages, page), F.lit(""))).otherwise(""))
    at = start - first * PAGE
    return F.substring(two, F.greatest(at - size, F.lit(0)) + 1, F.least(at, F.lit(size)))


def behind(pages: Column, end: Column, size: Column) -> Column:
    """``after`` of a text in pages; ``size`` is a page at most."""
    page = F.floor(end / PAGE).cast("int")
    two = F.concat(F.get(pages, page), F.coalesce(F.get(pages, page + 1), F.lit("")))
    return F.substring(two, end - page * PAGE + 1, size)


def sample(value: Column) -> Column:
    """How a column's first value is shown: 30 characters at most."""
    short = F.concat(F.substring(value, 1, 27), F.lit("..."))
    return F.when(value.isNull() | (value == ""), "(vacío)").when(F.length(value) > 30, short).otherwise(value)
