"""Property differences of matched elements, in long format: one row per pair and property.

matches: pair_id, ord, hpid and any keys, with base and other: structs of styles, attributes and textContent.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import css
from ..functions.text import trimmed

KEYS = ("pair_id", "ord", "hpid")


def category(name: Column) -> Column:
    return reduce(lambda acc, x: acc.when(css.one_of(name, x[1]), x[0]), list(C.PROPERTY_CATEGORIES.items())[1:], F.when(css.one_of(name, C.PROPERTY_CATEGORIES["layout"]), "layout")).otherwise("other")


def _is_color(name: Column) -> Column:
    return css.one_of(name, C.PROPERTY_CATEGORIES["visual"]) | F.contains(name, F.lit("color"))


def _is_size(name: Column) -> Column:
    listed = [p for k in ("layout", "spacing", "position") for p in C.PROPERTY_CATEGORIES[k]]
    return css.one_of(name, listed) | name.rlike("width|height|size")


def parsed(base: Column, other: Column) -> list[Column]:
    """Colours and pixels of both values, as tolerances and severities read them."""
    return [css.parse_rgba(base).alias("b_rgba"), css.parse_rgba(other).alias("c_rgba"), css.parse_px(base).alias("b_px"), css.parse_px(other).alias("c_px")]


def within_tolerance(name: Column, base: Column, other: Column, tolerances: C.Tolerances) -> Column:
    """Colours by channel and alpha 0.01, sizes in px; a value that can't be read must be equal. An unwritten alpha is never near. Reads the columns of parsed()."""
    a, b, x, y = map(F.col, ("b_rgba", "c_rgba", "b_px", "c_px"))
    near = reduce(lambda x, c: x & (F.abs(a[c] - b[c]) <= tolerances.color), ("g", "b"), F.abs(a["r"] - b["r"]) <= tolerances.color) & (F.abs(a["a"] - b["a"]) <= 0.01)
    color = F.when(a.isNull() | b.isNull(), base == other).otherwise(F.coalesce(near, F.lit(False)))
    size = F.when(x.isNull() | y.isNull(), base == other).otherwise(F.abs(x - y) <= tolerances.size)
    return F.when(base.isNull() | other.isNull(), False).when(_is_color(name), color).when(_is_size(name), size).otherwise(False)


def bound(rows: DataFrame, keep: list[str], *columns: Column) -> DataFrame:
    """rows with columns computed once a row: what reads them later, filters too, does not repeat their expressions."""
    return rows.select(*keep, F.inline(F.array(F.struct(*columns))))


def _change(name: Column, base: Column, other: Column) -> Column:
    return F.when(base.isNull(), "added").when(other.isNull(), "removed").otherwise("modified")


def _raw_changes(base: Column, other: Column, mode: C.Mode) -> Column:
    """What differs as written, as an array of (kind, property, base_value, compare_value): styles, then text, then attributes.

    Equal texts of a property stay equal when they are normalised, so nothing else needs to be.
    """
    entry = lambda kind, name, b, c: F.struct(F.lit(kind).alias("kind"), name.alias("property"), b.alias("base_value"), c.alias("compare_value"))
    held = lambda m: F.coalesce(m, F.create_map().cast("map<string,string>"))

    def of_maps(kind: str, both: Column, names: Column) -> Column:
        b, c = both["b"], both["c"]
        changed = F.filter(names, lambda k: ~F.element_at(b, k).eqNullSafe(F.element_at(c, k)))
        return F.transform(changed, lambda k: entry(kind, k, F.element_at(b, k), F.element_at(c, k)))

    def of_styles(both: Column) -> Column:
        names = F.array_union(F.map_keys(both["b"]), F.map_keys(both["c"]))
        return of_maps("style", both, F.array_intersect(F.array(*map(F.lit, mode.properties)), names) if mode.properties else names)  # in the mode's order

    def of_attributes(both: Column) -> Column:
        names = F.array_union(F.map_keys(both["b"]), F.map_keys(both["c"]))
        return of_maps("attribute", both, F.filter(names, lambda k: css.one_of(k, mode.attributes)) if mode.attributes else names)

    pair = lambda x: F.struct(x["b"].alias("b"), x["c"].alias("c"))
    none = F.array().cast("array<struct<kind:string,property:string,base_value:string,compare_value:string>>")
    sides = lambda name: {"b": held(base[name]), "c": held(other[name])}
    same = lambda x: F.map_entries(x["b"]) == F.map_entries(x["c"])  # noqa: E731 - most elements end here
    styles, attributes = sides("styles"), sides("attributes")
    parts = [F.when(same(styles), none).otherwise(css.let(pair({k: css.expand_shorthands(v) for k, v in styles.items()}), of_styles))]
    if mode.text:
        b, c = trimmed(base["textContent"]), trimmed(other["textContent"])
        parts.append(F.when(~base["textContent"].eqNullSafe(other["textContent"]) & (b != c), F.array(entry("text", F.lit("textContent"), b, c))).otherwise(none))
    parts.append(F.when(same(attributes), none).otherwise(css.let(pair(attributes), of_attributes)))
    return F.concat(*parts)


def severity(name: Column, kind: Column) -> Column:
    """Severity of one difference by its property, then by the size of the change. Reads the columns of parsed()."""
    a, b, x, y = map(F.col, ("b_rgba", "c_rgba", "b_px", "c_px"))
    breaks = name.isin("width", "height") & (x != 0) & (y != 0) & (F.abs((y - x) / F.nullif(x, F.lit(0.0))) * 100 > 50)
    apart = css.let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.abs(css.luminance(x["a"]) - css.luminance(x["b"])))
    loud = F.contains(name, F.lit("color")) & (apart > 0.4)
    listed = lambda level: css.one_of(name, C.SEVERITY_PROPERTIES[level])
    return F.when(listed("critical") | F.coalesce(breaks, F.lit(False)), "critical").when(listed("high") | F.coalesce(loud, F.lit(False)), "high").when(listed("medium") | (kind == "layout"), "medium").otherwise("low")


def rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, C.SEVERITIES)), level).cast("int")


#: Expressions over columns of fixed names, built once for a JVM: building them takes seconds, for they are sent to it node by node.
_BUILT: dict[tuple, Column | list[Column]] = {}


def _once(name: tuple, build: Callable[[], Column | list[Column]]) -> Column | list[Column]:
    key = (SparkContext._gateway, *name)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def diff(matches: DataFrame, mode: C.Mode = C.STATIC) -> DataFrame:
    """KEYS, n, property, base_value, compare_value, type, category, severity: one row per difference, in the order n.

    Entries that differ as written become rows within their task; only those are normalised and held against the tolerances.
    """
    keys = [k for k in matches.columns if k not in ("base", "other")]
    changes = _once(("changes", mode), lambda: _raw_changes(F.col("base"), F.col("other"), mode))
    sides = bound(matches, keys, F.col("base"), F.col("other"))  # else what makes a caller's styles would be worked out at every place that reads them
    raw = sides.select(*keys, changes.alias("raw"))
    own = F.get(F.filter("raw", lambda d: (d["kind"] == "style") & (d["property"] == "color")), F.lit(0))
    rows = raw.select(*keys, own.alias("own"), F.posexplode_outer("raw").alias("n", "d")).filter("d is not null")  # outer, as the filter that Spark infers for an inner one would work the changes out once more
    name, style, border = F.col("d.property"), F.col("d.kind") == "style", css.one_of(F.col("d.property"), C.BORDER_COLORS)
    value = lambda side: _once(("value", side), lambda: F.when(style, css.normalize_value(name, F.col(f"d.{side}"))).otherwise(F.col(f"d.{side}")).alias(side))
    color = lambda side: _once(("color", side), lambda: F.when(border, css.normalize_value(F.lit("color"), F.col(f"own.{side}"))).alias(f"own_{side}"))
    rows = bound(rows, [*keys, "n"], F.col("d.kind").alias("kind"), name.alias("property"), F.col("own").isNotNull().alias("colored"), value("base_value"), value("compare_value"), color("base_value"), color("compare_value"))
    name, style, b, c = F.col("property"), F.col("kind") == "style", F.col("base_value"), F.col("compare_value")
    follows = css.one_of(name, C.BORDER_COLORS) & F.col("colored") & b.eqNullSafe(F.col("own_base_value")) & c.eqNullSafe(F.col("own_compare_value"))  # a border's colour that only changed as the element's own did
    rows = bound(rows.filter(~(style & (b.eqNullSafe(c) | follows))), [*keys, "n", "kind", "property", "base_value", "compare_value"], *_once(("parsed",), lambda: parsed(b, c)))
    kind = _once(("kind",), lambda: F.when(style, category(name)).when(F.col("kind") == "text", "content").otherwise("attribute"))
    shown = F.when(F.col("kind") == "attribute", F.concat(F.lit("attr:"), name)).otherwise(name)
    rows = rows.filter(_once(("far", mode.tolerances), lambda: ~(style & within_tolerance(name, b, c, mode.tolerances))))
    changed = _once(("type",), lambda: F.when(style, _change(name, b, c)).otherwise("modified").alias("type"))
    long = rows.select(*keys, "n", shown.alias("property"), "base_value", "compare_value", changed, kind.alias("category"), "b_rgba", "c_rgba", "b_px", "c_px")
    return long.withColumn("severity", _once(("severity",), lambda: severity(F.col("property"), F.col("category")))).drop("b_rgba", "c_rgba", "b_px", "c_px")


def by_match(diffs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Counts by severity and the worst one of each matched pair."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in C.SEVERITIES]
    found = diffs.groupBy(*keys).agg(F.count("*").alias("total"), *counts)  # counts only: texts would have the rows sorted on both sides of the shuffle
    worst = F.coalesce(*[F.when(F.col(s) > 0, s) for s in C.SEVERITIES])
    return found.withColumn("worst", worst)


def summary(matches: DataFrame, per_match: DataFrame, ambiguous: DataFrame | None = None, owner: list[str] | None = None) -> DataFrame:
    """Matched, unchanged and modified pairs, all differences, ambiguous elements, pairs by worst severity: one row, or one for each owner."""
    keys = owner or []
    tagged = [matches.select(*keys, F.lit("total").alias("what"), F.lit(None).cast("string").alias("worst"), F.lit(0).cast("long").alias("n"))]
    tagged.append(per_match.select(*keys, F.lit("modified").alias("what"), "worst", F.col("total").alias("n")))
    if ambiguous is not None:
        tagged.append(ambiguous.select(*keys, F.lit("ambiguous").alias("what"), F.lit(None).cast("string").alias("worst"), F.lit(0).cast("long").alias("n")))
    of = lambda what: F.count_if(F.col("what") == what)
    worst = [F.count_if((F.col("what") == "modified") & (F.col("worst") == s)).alias(s) for s in C.SEVERITIES]
    counts = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(of("total").alias("total"), of("modified").alias("modified"), F.coalesce(F.sum("n"), F.lit(0)).alias("differences"), of("ambiguous").alias("ambiguous"), *worst)
    return counts.select(*keys, "total", (F.col("total") - F.col("modified")).alias("unchanged"), "modified", "differences", "ambiguous", *C.SEVERITIES)
