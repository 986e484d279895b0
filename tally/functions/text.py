"""Numbers, dates and quotes in text: Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_number(x: Column) -> Column:
    """A number as text with up to six decimals and no closing zeros."""
    text = F.round(x.cast("decimal(28,10)"), 6).cast("decimal(28,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def normal_quote(x: Column) -> Column:
    """Quotes for comparing: plain quotation marks and dashes, single spaces, lower case."""
    plain = F.translate(x, "‘’“”–— ", "''\"\"-- ")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def shows_value(quote: Column, value: Column) -> Column:
    """Whether a quote shows a value as a plain number, with grouping commas, in thousands, millions or billions, or as a percentage."""
    text = F.concat(F.lit(" "), F.regexp_replace(normal_quote(quote), r"(?<=\d),(?=\d{3})", ""), F.lit(" "))
    shown = lambda v: F.regexp_like(text, F.concat(F.lit(r"(^|[^\d.])"), F.regexp_replace(v, r"\.", r"\\."), F.lit(r"(?![\d]|\.\d)")))
    percent = F.concat(plain_number(value.cast("decimal(28,10)") * 100), F.lit(" ?%"))
    out = shown(plain_number(value)) | shown(percent)
    for power, words in ((3, "k|thousand"), (6, "m|mm|million"), (9, "b|bn|billion")):
        small = plain_number(value.cast("decimal(28,10)") / 10**power)
        out = out | ((F.abs(value) >= 10**power) & shown(F.concat(small, F.lit(rf" ?({words})\b"))))
    return out


def shows_date(quote: Column, day: Column) -> Column:
    """Whether a quote shows a date: 2025-01-31, January 31, 2025, 31 January 2025, Jan 31, 2025 or 1/31/2025."""
    text = normal_quote(quote)
    forms = ("yyyy-MM-dd", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "M/d/yyyy")
    found = F.lit(False)
    for form in forms:
        found = found | F.regexp_like(text, F.concat(F.lit(r"(^|[^0-9a-z/])"), F.lower(F.date_format(day, form)), F.lit(r"($|[^0-9a-z/])")))
    return found


def long_date(d: Column) -> Column:
    return F.date_format(d, "MMMM d, yyyy")


def span_label(start: Column, end: Column) -> Column:
    """One month's name, or both ends."""
    same = F.trunc(start, "MM") == F.trunc(end, "MM")
    return F.when(same, F.date_format(start, "MMM yyyy")).otherwise(F.concat_ws(" - ", F.date_format(start, "MMM yyyy"), F.date_format(end, "MMM yyyy")))
