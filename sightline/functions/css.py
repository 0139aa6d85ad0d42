"""CSS values as Column expressions: colours, sizes, fonts, shorthands."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def let(value: Column, use) -> Column:
    """use(value) with value computed once for a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def one_of(column: Column, names: list[str] | tuple[str, ...]) -> Column:
    return column.isin(list(names))


def js_round(x: Column) -> Column:
    """Half goes up, also below zero."""
    return F.floor(x + 0.5)


def js_number(x: Column) -> Column:
    """A number's shortest text: 1, 0.5."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def leading_number(text: Column) -> Column:
    """The number that a text begins with, else null."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def two_decimals(x: Column) -> Column:
    """Two decimals of the exact binary value, a tie going away from zero, as text.

    The product by 100 is taken with its rounding error (the number is split in two halves whose products are exact), so that
    1.015, which lies below its name, gives 1.01 and 0.125 gives 0.13.
    """

    def text(v: Column) -> Column:
        half = v * 134217729.0 - (v * 134217729.0 - v)
        product = v * 100.0
        error = (half * 100.0 - product) + (v - half) * 100.0
        n = F.floor(product) + F.when((product - F.floor(product) - 0.5) + error >= 0, 1).otherwise(0)
        return F.concat((n / F.lit(100)).cast("long").cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))

    return let(x, lambda v: F.when(F.abs(v) >= 1e13, F.format_string("%s", F.bround(v.cast("decimal(38,2)"), 2))).otherwise(F.concat(F.when(v < 0, "-").otherwise(""), text(F.abs(v)))))


def _rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    whole = lambda x: x.cast("long").cast("string")
    return F.concat(F.lit("rgba("), whole(r), F.lit(", "), whole(g), F.lit(", "), whole(b), F.lit(", "), a, F.lit(")"))


def hex_to_rgba(text: Column) -> Column:
    digits = F.substring(text, 2, 100)
    full = F.when(F.length(digits).isin(3, 4), F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    byte = lambda d, at: F.conv(F.substring(d, at, 2), 16, 10).cast("int")
    alpha = F.when(F.length(full) == 8, js_number(js_round(byte(full, 7) / 255.0 * 100) / 100)).otherwise("1")
    return F.when(full.rlike("^([0-9a-f]{6}|[0-9a-f]{8})$"), _rgba(byte(full, 1), byte(full, 3), byte(full, 5), alpha)).otherwise(text)


def _arguments(text: Column, name: str) -> Column:
    return F.transform(F.split(F.regexp_extract(text, name + r"a?\s*\(\s*([^)]+)\s*\)", 1), ","), lambda p: F.trim(p))


def _alpha(parts: Column) -> Column:
    return F.coalesce(js_number(leading_number(F.get(parts, F.lit(3)))), F.lit("1"))


def rgb_to_rgba(text: Column) -> Column:
    channel = lambda parts, i: js_round(leading_number(F.get(parts, F.lit(i))))
    return F.coalesce(let(_arguments(text, "rgb"), lambda p: _rgba(channel(p, 0), channel(p, 1), channel(p, 2), _alpha(p))), text)


def hsl_to_rgba(text: Column) -> Column:
    """Hue in degrees modulo 360; saturation and lightness in percent, kept within 0 and 100."""
    share = lambda parts, i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), leading_number(F.get(parts, F.lit(i))) / 100))

    def mixed(parts: Column) -> Column:
        hue, s, light = F.pmod(leading_number(F.get(parts, F.lit(0))), F.lit(360.0)), share(parts, 1), share(parts, 2)
        chroma = (1 - F.abs(2 * light - 1)) * s
        second = chroma * (1 - F.abs(hue / 60 % 2 - 1))
        sector, low = F.floor(hue / 60), light - chroma / 2
        shade = lambda c, x: F.when(sector.isin(*c), chroma).when(sector.isin(*x), second).otherwise(0.0)
        channel = lambda c, x: js_round((shade(c, x) + low) * 255)
        return _rgba(channel((0, 5), (1, 4)), channel((1, 2), (0, 3)), channel((3, 4), (2, 5)), _alpha(parts))

    return F.coalesce(let(_arguments(text, "hsl"), mixed), text)


def normalize_color(value: Column) -> Column:
    """rgba(r, g, b, a) of names, hex, rgb() and hsl(); keywords in lower case; anything else as it was."""
    text = F.lower(F.trim(value))
    names = F.from_json(F.lit(json.dumps(C.named_colors())), "map<string,string>")
    return (
        F.when(text == "transparent", "rgba(0, 0, 0, 0)")
        .when(one_of(text, C.COLOR_KEYWORDS), text)
        .when(text.startswith("#"), hex_to_rgba(text))
        .when(text.startswith("rgb"), rgb_to_rgba(text))
        .when(text.startswith("hsl"), hsl_to_rgba(text))
        .otherwise(F.coalesce(F.element_at(names, text), value))
    )


def normalize_unit(value: Column) -> Column:
    """Lengths in px with two decimals; percentages stay percentages, since no context of a parent is recorded."""
    text = F.lower(F.trim(value))
    parts = r"^([-+]?\d*\.?\d+)([a-z%]+)?$"
    number, unit = F.regexp_extract(text, parts, 1).try_cast("double"), F.regexp_extract(text, parts, 2)
    factor = reduce(lambda acc, x: acc.when(unit == x[0], x[1]), C.UNIT_FACTORS.items(), F.when(unit == "", 1.0))
    return (
        F.when(one_of(text, C.CSS_KEYWORDS), text)
        .when(text.isin("0", "0px"), "0px")
        .when(~text.rlike(parts), value)
        .when(unit == "%", F.concat(two_decimals(number), F.lit("%")))
        .otherwise(F.coalesce(F.concat(two_decimals(number * factor), F.lit("px")), value))
    )


def is_context_dependent(value: Column) -> Column:
    """Whether a size depends on a parent or the viewport."""
    return F.coalesce(F.lower(F.trim(value)).rlike("em|rem|%|vw|vh|vmin|vmax"), F.lit(False))


def normalize_font(value: Column) -> Column:
    """Families without quotes: generic ones in lower case, others capitalised."""

    def family(f: Column) -> Column:
        name = F.trim(F.regexp_replace(F.lower(F.trim(f)), "^['\"]|['\"]$", ""))
        capital = F.array_join(F.transform(F.split(name, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " ")
        alias = reduce(lambda acc, x: acc.when(name == x[0], x[1]), C.FONT_ALIASES.items(), F.when(one_of(name, C.GENERIC_FONTS), name))
        return alias.otherwise(capital)

    return F.array_join(F.transform(F.filter(F.split(value, ","), lambda f: F.trim(f) != ""), family), ", ")


_WHOLE = r"(?:0|[1-9]\d{0,8})"


def normalize_value(name: Column, value: Column) -> Column:
    """A value by the kind of its property; empty and null values stay.

    Whole pixels and rgb() of whole channels, as browsers write computed values, take a short way to the same text; all others go
    by the rules above, in a lambda, which keeps the code around it small enough to be compiled.
    """
    color, size = one_of(name, C.COLOR_PROPERTIES), one_of(name, C.SIZE_PROPERTIES)
    kind = lambda x: F.when(one_of(x["name"], C.COLOR_PROPERTIES), normalize_color(x["value"])).when(x["name"] == "font-family", normalize_font(x["value"])).otherwise(normalize_unit(x["value"]))
    return (
        F.when(value.isNull() | (value == "") | ~(color | size | (name == "font-family")), value)
        .when(size & (value != "0px") & value.rlike(rf"^{_WHOLE}px\z"), F.concat(F.substring(value, F.lit(1), F.length(value) - 2), F.lit(".00px")))
        .when(color & value.rlike(rf"^rgb\({_WHOLE}, {_WHOLE}, {_WHOLE}\)\z"), F.concat(F.lit("rgba("), F.substring(value, F.lit(5), F.length(value) - 5), F.lit(", 1)")))
        .otherwise(let(F.struct(name.alias("name"), value.alias("value")), kind))
    )


def side_values(value: Column) -> Column:
    """Top, right, bottom and left of one to four values."""
    parts = F.split(F.trim(value), r"\s+")
    pick = lambda p, *at: F.coalesce(*[F.get(p, F.lit(i)) for i in at])
    return let(parts, lambda p: F.array(pick(p, 0), pick(p, 1, 0), pick(p, 2, 0), pick(p, 3, 1, 0)))


def expand_shorthands(styles: Column) -> Column:
    """styles without shorthands; longhands that were absent or empty come from them, earlier shorthands first."""
    entry = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    of = lambda name: F.nullif(F.element_at(styles, F.lit(name)), F.lit(""))
    none = F.array().cast("array<struct<key:string,value:string>>")
    held = lambda name, made: F.when(of(name).isNull(), none).otherwise(let(made(of(name))[0], made(of(name))[1]))  # noqa: E731 - what is absent costs nothing
    found = [held(short, lambda v, longs=longs: (side_values(v), lambda s: F.array(*[entry(long, F.get(s, F.lit(i))) for i, long in enumerate(longs)]))) for short, longs in C.FOUR_SIDES.items()]

    words = lambda v: F.split(v, r"\s+")
    first = lambda w, test: F.get(F.filter(w, test), F.lit(0))
    is_width = lambda w: w.rlike(r"^\d") | w.isin("thin", "medium", "thick")
    is_style = lambda w: one_of(w, C.BORDER_STYLES)
    tries = (("width", is_width), ("style", is_style), ("color", lambda w: ~is_width(w) & ~is_style(w) & (w != "")))
    for kind, test in tries:  # a border's part counts only where the top side has none yet
        top = F.coalesce(of(f"border-top-{kind}"), F.get(side_values(of(f"border-{kind}")), F.lit(0)))
        part = lambda v, top=top, test=test: F.when(top.isNull(), F.try_element_at(F.filter(words(v), test), F.lit(-1)))
        found.append(held("border", lambda v, kind=kind, part=part: (part(v), lambda p: F.array(*[entry(f"border-{side}-{kind}", p) for side in ("top", "right", "bottom", "left")]))))
    color, image = (lambda v: F.nullif(F.regexp_extract(v, r"(?i)(#[0-9a-f]{3,8}|rgba?\([^)]+\)|hsla?\([^)]+\)|[a-z]+)", 1), F.lit(""))), (lambda v: F.nullif(F.regexp_extract(v, r"(url\([^)]+\))", 1), F.lit("")))
    found.append(held("background", lambda v: (v, lambda b: F.array(entry("background-color", color(b)), entry("background-image", image(b))))))
    slanted, heavy, sized = (lambda w: w.isin("italic", "oblique")), (lambda w: w.isin("bold", "bolder", "lighter") | w.rlike(r"^\d{3}$")), (lambda w: w.rlike(r"^\d") & ~w.rlike(r"^\d{3}$"))

    def of_font(w: Column) -> Column:
        size = lambda pattern: F.nullif(F.regexp_extract(first(w, sized), pattern, 1), F.lit(""))
        family = first(w, lambda x: ~slanted(x) & ~heavy(x) & ~sized(x) & (x != ""))
        return F.array(entry("font-style", first(w, slanted)), entry("font-weight", first(w, heavy)), entry("font-size", size(r"^([^/]+)")), entry("line-height", size(r"/(.+)")), entry("font-family", family))

    found.append(held("font", lambda v: (words(v), of_font)))

    kept = F.map_filter(styles, lambda k, v: ~one_of(k, C.SHORTHANDS))

    def filled(entries: Column, own: Column) -> Column:
        """own with the entries for keys that it has no value of; the first entry of a key counts."""
        open_ = lambda e: e["value"].isNotNull() & (F.coalesce(F.element_at(own, e["key"]), F.lit("")) == "")
        put = lambda new: F.map_concat(F.map_filter(own, lambda k, v: ~F.array_contains(new["key"], k)), F.map_from_entries(F.filter(new, lambda e, i: F.array_position(new["key"], e["key"]) == i + 1)))
        return let(F.filter(entries, open_), put)

    has_short = F.arrays_overlap(F.map_keys(styles), F.array(*map(F.lit, C.SHORTHANDS)))
    return F.when(has_short, let(F.struct(F.concat(*found).alias("f"), kept.alias("k")), lambda x: filled(x["f"], x["k"]))).otherwise(styles)


def normalize_styles(styles: Column) -> Column:
    return F.transform_values(expand_shorthands(styles), normalize_value)


def parse_rgba(value: Column) -> Column:
    """(r, g, b, a) of the first rgb() or rgba() with whole channels, null without one; a is null where it isn't written."""
    form = r"rgba?\s*\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*(?:,\s*([0-9.]+))?\s*\)"
    part = lambda i: F.regexp_extract(value, form, i).try_cast("double")
    return F.when(F.contains(value, F.lit("rgb")) & value.rlike(form), F.struct(part(1).alias("r"), part(2).alias("g"), part(3).alias("b"), part(4).alias("a")))


def parse_px(value: Column) -> Column:
    return F.when(F.contains(value, F.lit("px")), F.regexp_extract(value, r"^([0-9.]+)px$", 1).try_cast("double"))


def luminance(rgba: Column) -> Column:
    """WCAG relative luminance."""
    linear = lambda v: F.when(v / 255 <= 0.03928, v / 255 / 12.92).otherwise(F.pow((v / 255 + 0.055) / 1.055, 2.4))
    return 0.2126 * linear(rgba["r"]) + 0.7152 * linear(rgba["g"]) + 0.0722 * linear(rgba["b"])
