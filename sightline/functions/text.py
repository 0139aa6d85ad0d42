"""Texts, labels, escapes and identifiers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

#: White space as scripts in pages trim it.
EDGES = r"^[\s ﻿]+|[\s ﻿]+$"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), EDGES, "")


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def divergence(base: Column, other: Column) -> Column:
    """0 to 1: edit distance of the first 500 characters by the longer length; numbers count 0.2 at most, short texts less."""
    a, b = F.substring(trimmed(base), 1, C.TEXT_COMPARED), F.substring(trimmed(other), 1, C.TEXT_COMPARED)
    longest = F.greatest(F.length(a), F.length(b))
    ratio = F.levenshtein(a, b) / longest
    digits = r"^[\d,.$%\s()\-+]+$"
    capped = F.when(a.rlike(digits) & b.rlike(digits), F.least(ratio, F.lit(0.20))).otherwise(ratio)
    return F.when(longest == 0, 0.0).otherwise(F.least(F.when(longest < 8, capped * 0.30).otherwise(capped), F.lit(1.0)))


def element_label(tag: Column, element_id: Column, classes: Column, most: int = 2) -> Column:
    """tag#id.class.class"""
    parts = F.filter(F.split(F.trim(F.coalesce(classes, F.lit(""))), r"\s+"), lambda c: c != "")
    named = F.when(F.coalesce(element_id, F.lit("")) != "", F.concat(F.lit("#"), element_id)).otherwise("")
    return F.concat(F.lower(F.coalesce(F.nullif(tag, F.lit("")), F.lit("unknown"))), named, F.when(F.size(parts) > 0, F.concat(F.lit("."), F.array_join(F.slice(parts, 1, most), "."))).otherwise(""))


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, named in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(named))
    return out


def escape_csv(text: Column) -> Column:
    """Formula signs get a quote in front; cells with separators are quoted."""
    guarded = F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(F.coalesce(text, F.lit("")))
    return F.when(guarded.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(guarded)


def escape_xpath(text: Column) -> Column:
    """An XPath string literal; texts with both kinds of quotes become a concat()."""
    parts = F.array_join(F.transform(F.split(text, "'"), lambda p: F.concat(F.lit("'"), p, F.lit("'"))), ", \"'\", ")
    return F.when(~F.contains(text, F.lit("'")), F.concat(F.lit("'"), text, F.lit("'"))).when(~F.contains(text, F.lit('"')), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.concat(F.lit("concat("), parts, F.lit(")")))


def any_matches(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def _sized(text: Column, least: int, most: int = 200) -> Column:
    return F.coalesce(F.length(text).between(least, most), F.lit(False))


def is_stable_id(text: Column) -> Column:
    return _sized(text, 2) & ~any_matches(text, C.DYNAMIC_IDS)


def is_stable_value(text: Column) -> Column:
    return _sized(text, 1) & ~any_matches(text, C.UNSTABLE_VALUES)


def is_stable_class(text: Column) -> Column:
    return (F.coalesce(F.trim(text), F.lit("")) != "") & ~any_matches(F.trim(text), C.DYNAMIC_CLASSES)


def is_static_text(text: Column) -> Column:
    """Texts that don't look like a number, a time, a price or a sign of work in progress."""
    return _sized(text, 2) & ~any_matches(text, C.DYNAMIC_TEXTS)


def escape_css(text: Column) -> Column:
    """A quoted attribute value's text for a selector."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"""([!"#$%&'()*+,./:;<=>?@\[\\\]^`{|}~])""", r"\\$1")


def css_identifier(text: Column) -> Column:
    """An identifier as CSSOM serialises it: a digit in front and control characters by code, other marks with a backslash."""
    point = lambda c: F.concat(F.lit("\\"), F.lower(F.hex(F.ascii(c))), F.lit(" "))
    first_digit = lambda i, c: c.rlike("[0-9]") & ((i == 0) | ((i == 1) & text.startswith("-")))
    one = lambda c, i: F.when(c == "\x00", "\ufffd").when(c.rlike(r"[\x01-\x1f\x7f]") | first_digit(i, c), point(c)).when((c == "-") & (F.length(text) == 1), "\\-").when(c.rlike(r"[A-Za-z0-9_-]|[^\x00-\x7f]"), c).otherwise(F.concat(F.lit("\\"), c))
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def element_ref(tag: Column, element_id: Column, classes: Column) -> Column:
    """How a neighbour is named: its label with up to three classes."""
    return element_label(tag, element_id, classes, 3)


def relative_time(then: Column, now: Column) -> Column:
    """just now, or minutes, hours or days ago."""
    minutes = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 60_000_000)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    hours = F.floor(minutes / 60)
    return F.when(minutes < 1, "just now").when(minutes < 60, ago(minutes, "m")).when(hours < 24, ago(hours, "h")).otherwise(ago(F.floor(hours / 24), "d"))


def file_timestamp(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd'T'HH-mm-ss")


def payload_estimate(elements: Column) -> Column:
    """Bytes that a message with so many elements is taken for."""
    return elements * 56 * 30


def header_like(cells: Column) -> Column:
    """Whether a record heads element rows: two of the known headings at least, repeats counted."""
    known = ["hpid", "tag name", "css selector", "xpath", "absolute hpid"]
    return F.size(F.filter(cells, lambda c: F.lower(F.trim(c)).isin(known))) >= 2
