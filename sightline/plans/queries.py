"""Registered queries of the snapshot comparison: each takes (spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import compare
from .. import config as C
from ..functions import css, sql, text, url
from ..functions import hpid as H
from ..operators import diffing, hierarchy, matching, report, selectors, storage, visual
from ..shared import shared_dir, written
from ..sinks import reports as report_files
from ..sources import html
from ..sources.reports import read_reports
from ..streaming import gates
from .snapshots import base, edited, lines, matched, named_once, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _diffs(spark: SparkSession, sf_dir: str, mode: C.Mode = C.STATIC) -> DataFrame:
    return diffing.diff(matched(spark, sf_dir).drop("tagName", "elementId", "className"), mode)


def _per_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffing.by_match(_diffs(spark, sf_dir))


def _residual(spark: SparkSession, sf_dir: str, mode: C.Mode = C.STATIC) -> DataFrame:
    return hierarchy.cascades(_diffs(spark, sf_dir, mode)).filter(~F.col("inherited")).drop("inherited")


def _summary(spark: SparkSession, sf_dir: str, mode: C.Mode) -> DataFrame:
    """Over what cascades leave."""
    return diffing.summary(matched(spark, sf_dir).select("pair_id"), diffing.by_match(_residual(spark, sf_dir, mode)))


@query
def compare_static_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, C.STATIC)


@query
def compare_dynamic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, C.DYNAMIC)


# matching


def _keyed(spark: SparkSession, sf_dir: str, key, name: str, confidence: float) -> DataFrame:
    return matching.keyed(base(spark, sf_dir), edited(spark, sf_dir), key, name, confidence)


@query
def match_test_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, matching.anchor_key(), "test-attribute", 1.0).select("pair_id", "b_idx", "c_idx", "outcome")


@query
def match_id_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, matching.text_key("elementId"), "id", 0.90).filter("outcome = 'match'").select("pair_id", "b_idx", "c_idx")


@query
def match_id_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _keyed(spark, sf_dir, matching.text_key("elementId"), "id", 0.90).filter("outcome = 'ambiguous'")
    return found.select("pair_id", "b_idx", "n_candidates")


@query
def match_absolute_hpid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, matching.text_key("hpid"), "absolute-hpid", 0.95).groupBy("pair_id", "outcome").agg(F.count("*").alias("n"))


@query
def match_suffix_realign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.suffix_pass(base(spark, sf_dir), edited(spark, sf_dir)).select("pair_id", "b_idx", "c_idx")


@query
def match_identity_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.identity(base(spark, sf_dir), edited(spark, sf_dir)).groupBy("pair_id", "outcome").agg(F.count("*").alias("n"))


def _outcome(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return matching.identity(base(spark, sf_dir), edited(spark, sf_dir)).filter(F.col("outcome") == kind)


@query
def match_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcome(spark, sf_dir, "replaced").select("pair_id", "hpid", "b_tag", "c_tag")


@query
def unmatched_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcome(spark, sf_dir, "added").select("pair_id", "c_idx", "hpid")


@query
def unmatched_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcome(spark, sf_dir, "removed").select("pair_id", "b_idx", "hpid")


@query
def match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    counts = matching.identity(base(spark, sf_dir), edited(spark, sf_dir)).groupBy("pair_id").agg(of("pair").alias("matched"), of("removed", "replaced").alias("removed"), of("added", "replaced").alias("added"))
    return counts.withColumn("rate", matching.match_rate(F.col("matched"), F.col("removed"), F.col("added")))


@query
def match_sequence_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.align(base(spark, sf_dir), edited(spark, sf_dir))


@query
def match_position_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by place from a confidence of 0.2 on; the default threshold of 0.5 lets none through."""
    return matching.near(base(spark, sf_dir), edited(spark, sf_dir), C.MatchOptions(confidence_threshold=0.2))


@query
def match_all_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match(base(spark, sf_dir), edited(spark, sf_dir))["matches"]


@query
def compare_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each comparison through all passes (keys only, so that what has no partner is added or removed), with what it finds and how much it matched."""
    done = compare.compare(base(spark, sf_dir), edited(spark, sf_dir), options=C.MatchOptions(alignment=False))
    return done.summary().drop("ambiguous").join(done.matching().drop("ambiguous"), "pair_id")


# normalisation


@query
def normalize_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 256
    code = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(n)), 2, "0"), F.lit("10"), F.lpad(F.hex(255 - n), 2, "0"))
    return table(spark, sf_dir, "part").select("p_partkey", css.normalize_color(code).alias("color"))


@query
def normalize_named_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.initcap(F.substring_index("p_name", " ", 1))
    return table(spark, sf_dir, "part").select("p_partkey", css.normalize_color(word).alias("color"))


@query
def normalize_hsl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole shades only: greys by lightness, and the six pure hues."""
    n = F.col("p_partkey")
    hsl = F.when(n % 2 == 0, F.format_string("hsl(%d, 0%%, %d%%)", n % 360, (n % 5) * 20)).otherwise(F.format_string("hsl(%d, 100%%, 50%%)", n % 6 * 60))
    return table(spark, sf_dir, "part").select("p_partkey", css.normalize_color(hsl).alias("color"))


@query
def normalize_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = F.array(*[F.lit(u) for u in ("px", "em", "rem", "in", "pc", "%", "")])
    value = F.concat((F.col("p_size") + F.col("p_partkey") % 8 / 8.0).cast("string"), F.get(units, (F.col("p_partkey") % 7).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", css.normalize_unit(value).alias("size"))


@query
def normalize_font(spark: SparkSession, sf_dir: str) -> DataFrame:
    fonts = F.concat(F.lit("'"), F.col("p_name"), F.lit("', SERIF"))
    return table(spark, sf_dir, "part").select("p_partkey", css.normalize_font(fonts).alias("font"))


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts dealt over all cores: a few megabytes are otherwise one or two tasks, however much is made of each row."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")


@query
def expand_margin_shorthand(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = lambda n: F.concat((F.col("p_partkey") % n).cast("string"), F.lit("px"))
    parts = F.array(px(3), px(5), px(7), px(11))
    styles = F.create_map(F.lit("margin"), F.array_join(F.slice(parts, 1, (F.col("p_partkey") % 4 + 1).cast("int")), " "), F.lit("margin-left"), F.when(F.col("p_size") % 2 == 0, "9px").otherwise(""))
    out = _dealt(spark, sf_dir).select("p_partkey", css.expand_shorthands(styles).alias("m"))
    return out.select("p_partkey", *[F.col("m").getItem(f"margin-{s}").alias(s) for s in ("top", "right", "bottom", "left")], F.map_contains_key("m", F.lit("margin")).alias("kept"))


@query
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session's SQL functions over parts: colours, severities, addresses, and the paths above one of three steps."""
    sql.register(spark)
    return spark.sql(
        """
        SELECT p_partkey, css_normalize(initcap(substring_index(p_name, ' ', 1))) AS color, css_severity('width', p_size || '.00px', (p_size + p_partkey % 3 * 10) || '.00px') AS severity,
               url_compat('http://a/x?p=1', 'http://b/x?p=' || p_partkey % 3) AS compatibility, depth, ancestor
        FROM {part}, LATERAL hpid_ancestors('1.' || p_size || '.' || p_partkey)
        """,
        part=table(spark, sf_dir, "part"),
    )


# differences


@query
def style_diff_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffs(spark, sf_dir).select("pair_id", "hpid", "property", "base_value", "compare_value", "type", "category")


@query
def severity_per_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffs(spark, sf_dir).groupBy("property", "severity").agg(F.count("*").alias("n"))


@query
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_match(spark, sf_dir).select("pair_id", "hpid", "total", *C.SEVERITIES, "worst")


@query
def text_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.text_changes(matched(spark, sf_dir))
    return found.select("pair_id", "hpid", F.floor(F.col("divergence") * 1000 + 0.5).alias("permille"))


@query
def attr_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffs(spark, sf_dir).filter("category = 'attribute'").select("pair_id", "hpid", "property", "base_value", "compare_value", "type", "severity")


@query
def text_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffs(spark, sf_dir).filter("category = 'content'").select("pair_id", "hpid", "base_value", "compare_value", "severity")


@query
def severity_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_match(spark, sf_dir).groupBy("pair_id", "worst").agg(F.count("*").alias("elements"))


@query
def luminance_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative luminance of red shades, in thousandths."""
    red = F.struct((F.col("p_partkey") % 256).cast("double").alias("r"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b"))
    return table(spark, sf_dir, "part").select("p_partkey", F.floor(css.luminance(red) * 1000 + 0.5).alias("permille"))


def _matched_with(spark: SparkSession, sf_dir: str, base_styles: Column, other_styles: Column) -> DataFrame:
    """Parts as matched elements with the given styles."""
    side = lambda styles, name: F.struct(styles.alias("styles"), F.create_map().cast("map<string,string>").alias("attributes"), F.lit("").alias("textContent")).alias(name)
    return _dealt(spark, sf_dir).select((F.col("p_partkey") % 10).alias("pair_id"), F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("hpid"), side(base_styles, "base"), side(other_styles, "other"))


@query
def tolerance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights that move by 0 to 6 pixels and colours by 0 to 10 steps: what static tolerances let through."""
    k = F.col("p_partkey")
    px = lambda n: F.concat(n.cast("string"), F.lit("px"))
    shade = lambda n: F.concat(F.lit("rgb("), n.cast("string"), F.lit(", 0, 0)"))
    styles = lambda h, c: F.create_map(F.lit("height"), px(h), F.lit("color"), shade(c))
    met = _matched_with(spark, sf_dir, styles(F.col("p_size"), k % 200), styles(F.col("p_size") + k % 7, k % 200 + k % 11))
    return diffing.diff(met).groupBy("hpid").agg(F.count_if(F.col("property") == "height").alias("heights"), F.count_if(F.col("property") == "color").alias("colors"))


@query
def dedupe_current_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Border colours that change along with the element's own colour, and every third that changes otherwise."""
    k = F.col("p_partkey")
    shade = lambda n: F.concat(F.lit("rgb("), n.cast("string"), F.lit(", 0, 0)"))
    styles = lambda c, b: F.create_map(F.lit("color"), shade(c), F.lit("border-top-color"), shade(b))
    met = _matched_with(spark, sf_dir, styles(k % 100, k % 100), styles(k % 100 + 50, F.when(k % 3 == 0, k % 100 + 90).otherwise(k % 100 + 50)))
    return diffing.diff(met).groupBy("property").agg(F.count("*").alias("n"))


@query
def drop_shorthands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paddings and borders written short on one side and at length on the other."""
    k = F.col("p_partkey")
    px = lambda n: F.concat((k % n + 1).cast("string"), F.lit("px"))
    short = F.create_map(F.lit("padding"), F.concat_ws(" ", px(5), px(3)), F.lit("border"), F.concat(px(4), F.lit(" solid red")))
    long = F.create_map(F.lit("padding-top"), px(5), F.lit("padding-right"), px(3), F.lit("padding-bottom"), px(5), F.lit("padding-left"), F.concat((k % 3 + 11).cast("string"), F.lit("px")), F.lit("border-top-width"), px(4))
    found = diffing.diff(_matched_with(spark, sf_dir, short, long))
    return found.groupBy("property", "type").agg(F.count("*").alias("n"))


# hierarchy


@query
def cascade_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hierarchy.cascades(_diffs(spark, sf_dir)).filter("inherited")
    return found.select("pair_id", "hpid", "property", "base_value", "compare_value")


@query
def cascade_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.cascades(_diffs(spark, sf_dir)).groupBy("pair_id", "property", "inherited").agg(F.count("*").alias("n"))


@query
def severity_breakdown_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.breakdown(_per_match(spark, sf_dir))


@query
def nearest_diff_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.nearest_changed_ancestor(_per_match(spark, sf_dir))


@query
def descendant_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendant_counts(_per_match(spark, sf_dir))


@query
def tree_structural_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lone = matching.identity(base(spark, sf_dir), edited(spark, sf_dir)).filter(F.col("outcome").isin("added", "removed"))
    return hierarchy.tree_nodes(_per_match(spark, sf_dir), lone)


def _deeper(hpid: Column) -> Column:
    """The snapshot's paths put two levels further down: 1.o.line becomes 1.a.b.o.line."""
    order = H.segments(hpid)[1].cast("long")
    return F.when(H.depth(hpid) == 1, hpid).otherwise(F.concat_ws(".", F.lit("1"), (order % 7 + 1).cast("string"), (order % 3 + 1).cast("string"), F.substring(hpid, 3, 1000)))


def _lone(other: DataFrame, rows: DataFrame, label: Column) -> DataFrame:
    """pair_id, hpid, label and group of the elements whose path the other snapshot lacks: added (in other only) and removed ones."""
    side = lambda d, name: d.select("pair_id", "hpid", label.alias(name)).filter("pair_id is not null")
    met = side(rows, "old").join(side(other, "new").hint("merge"), ["pair_id", "hpid"], "full_outer").filter("old is null or new is null")
    return met.select("pair_id", "hpid", F.coalesce("old", "new").alias("label"), F.when(F.col("old").isNull(), "added").otherwise("removed").alias("group"))


@query
def report_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's tree, five levels deep: changed, added and removed elements and all above them; apexes are those whose change others only follow."""
    label = F.concat_ws(".", "tagName", "className").alias("label")
    named = named_once(spark, sf_dir)
    met = matched(spark, sf_dir, named)
    diffs = written(diffing.diff(met.withColumn("label", label).drop("tagName", "elementId", "className")), "changes")
    took = hierarchy.cascades(diffs.drop("label")).filter("inherited").select("pair_id", H.parent(F.col("hpid")).alias("hpid")).distinct().withColumn("is_apex", F.lit(True))
    items = report.recurrences(report.items(diffs)).withColumn("group_before", F.col("severity"))
    causes = report.placed(items).join(took.hint("merge"), ["pair_id", "hpid"], "left").withColumnRenamed("severity", "group")
    unchanged = met.select("pair_id", "hpid", label, F.lit("unchanged").alias("group")).join(diffs.select("pair_id", "hpid").distinct().hint("merge"), ["pair_id", "hpid"], "left_anti")
    every = causes.select("pair_id", "hpid", "label", "group", "place", "is_apex", "recurrence_hpids")
    for rows in (_lone(edited(spark, sf_dir, named), base(spark, sf_dir, named), label), unchanged):
        every = every.unionByName(rows, allowMissingColumns=True)
    deep = every.withColumns({"hpid": _deeper(F.col("hpid")), "recurrence_hpids": F.transform("recurrence_hpids", _deeper)})
    return hierarchy.report_tree(written(report.item_map(deep), "map")).withColumn("instance", F.col("instance").cast("int"))


@query
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = base(spark, sf_dir).select("pair_id", "hpid", text.element_label(F.col("tagName"), F.col("elementId"), F.col("className")).alias("label"))
    return hierarchy.breadcrumbs(_per_match(spark, sf_dir).select("pair_id", F.col("hpid").alias("node")), labels)


@query
def apex_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.apexes(_diffs(spark, sf_dir))


# report


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = matched(spark, sf_dir).withColumn("label", F.concat_ws(".", "tagName", "className")).drop("tagName", "elementId", "className")
    return report.items(diffing.diff(labelled))


@query
def diffs_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = report.by_category(_diffs(spark, sf_dir))
    return grouped.select("pair_id", "hpid", "category", F.array_join(F.transform("diffs", lambda d: d["property"]), ",").alias("properties"))


@query
def dedupe_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.recurrences(_items(spark, sf_dir)).select("pair_id", "severity", "label", "hpid", "total", "recurrence")


@query
def impact_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.impact(report.recurrences(_items(spark, sf_dir)))


@query
def change_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.distribution(report.recurrences(_items(spark, sf_dir)), unmatched_added(spark, sf_dir), unmatched_removed(spark, sf_dir))


@query
def narrative_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = report.recurrences(_items(spark, sf_dir)).withColumn("badge", report.badge(F.col("properties"), F.lit(False)))
    return named.groupBy("pair_id", "badge").agg(F.count("*").alias("items"))


@query
def top_root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_causes(report.recurrences(_items(spark, sf_dir))).select("pair_id", "place", "hpid", "total")


@query
def content_intelligence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width and height differences of recurring items whose texts changed too, with the decision on each."""
    met = matched(spark, sf_dir)
    once = report.recurrences(_items(spark, sf_dir)).select(*diffing.KEYS, "recurrence")
    sized = _diffs(spark, sf_dir).filter(F.col("property").isin("width", "height")).join(report.text_changes(met), list(diffing.KEYS)).join(once, list(diffing.KEYS))
    error = report.geometry_error(css.parse_px(F.col("base_value")), css.parse_px(F.col("compare_value")), F.col("b_len"), F.col("c_len"))
    decided = sized.withColumn("decision", report.content_decision(F.col("divergence"), error, F.col("recurrence"), F.col("severity")))
    return decided.select("pair_id", "hpid", "property", F.col("severity").alias("before"), "recurrence", "decision.action", "decision.severity", "decision.label")


# addresses of pages


@query
def url_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page against the next of its host, in order of ids."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", url.part(F.col("url"), "HOST").alias("host"))
    following = F.lead(F.struct("page_id", "url")).over(Window.partitionBy("host").orderBy("page_id"))
    return pages.withColumn("next", following).filter("next is not null").select("page_id", F.col("next.page_id").alias("other_id"), url.compatibility(F.col("url"), F.col("next.url")).alias("compatibility"))


@query
def query_param_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's address against itself with a parameter more, and p changed on every second page."""
    other = F.concat(F.when(F.col("page_id") % 2 == 0, F.lit("http://h/x?p=1&q=2&utm_source=z")).otherwise("http://h/x?p=7&q=2"), F.lit("&n="), F.col("page_id").cast("string"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(url.query_delta(F.lit("https://k/y?p=1&q=2"), other)).alias("d"))
    return rows.select("page_id", "d.key", "d.baseline", "d.compare")


@query
def strip_tracking_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(url.params(F.col("url")), "&").alias("params"))


@query
def env_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth host is a preview, a qa host, and no address at all."""
    kind = F.col("page_id") % 4
    at = F.when(kind == 0, F.replace("url", F.lit("://"), F.lit("://preview."))).when(kind == 1, F.replace("url", F.lit("://"), F.lit("://qa-"))).when(kind == 2, "").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", url.environment(at).alias("env"))


@query
def last_path_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some addresses are cut to their root, some can't be read."""
    kind = F.col("page_id") % 5
    at = F.when(kind == 0, F.concat(F.regexp_extract("url", "^[^:]*://[^/?#]*", 0), F.lit("/"))).when(kind == 1, "no address").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", url.last_segment(at).alias("segment"))


# extraction


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.elements(table(spark, sf_dir, "pages"))


@query
def extract_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir).withColumn("tier", html.tier(F.col("tagName"), F.col("role"))).withColumn("attributes", html.without_framework_attributes(F.col("attributes")))


@query
def section_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.sections(_elements(spark, sf_dir)).select("page_id", "idx", "hpid", "tagName", "section")


@query
def selector_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSS selector for every element of every page."""
    return selectors.generate(html.elements(table(spark, sf_dir, "pages"), trees=True), "css")


@query
def selector_xpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path expression for every element of every page."""
    return selectors.generate(html.elements(table(spark, sf_dir, "pages"), texts=True), "xpath")


@query
def element_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.neighbours(_elements(spark, sf_dir))


@query
def class_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of the derived snapshot that carry the same classes within a comparison."""
    return html.with_class_occurrence(base(spark, sf_dir), "pair_id").select("idx", "classOccurrenceCount")


@query
def child_tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.child_tags(_elements(spark, sf_dir))


@query
def filter_top_level_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and large elements without those beneath a list, in the derived snapshot."""
    wanted = ((F.col("tagName") == "ul") & (F.col("idx") % 3 == 0)) | F.col("elementId").endswith("7")
    return html.top_level(base(spark, sf_dir).withColumnRenamed("pair_id", "page_id"), wanted).select("page_id", "hpid")


@query
def tier_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(spark, sf_dir)
    return rows.groupBy(html.tier(F.col("tagName"), F.element_at("attributes", F.lit("role"))).alias("tier")).agg(F.count("*").alias("n"))


# storage


def _reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each comparison's edited side as a report, and the elements; later comparisons are newer."""
    rows = edited(spark, sf_dir).withColumn("report_id", F.concat(F.lit("r"), F.col("pair_id").cast("string")))
    elements = rows.select("report_id", "idx", "hpid", "tagName", "elementId", "className", "textContent", "styles", "attributes")
    when = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("pair_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    reports = rows.groupBy("report_id", "pair_id").agg(F.count("*").alias("totalElements"))
    return reports.select(F.col("report_id").alias("id"), F.lit("3.1").alias("version"), F.concat(F.lit("http://a/"), "report_id").alias("url"), F.lit("T").alias("title"), when.alias("timestamp"), "totalElements", F.lit(5.0).alias("duration"), "pair_id"), elements


@query
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written as packed JSON files, one each, and imported again."""
    reports, elements = _reports(spark, sf_dir)
    path = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    report_files.export_reports(reports.drop("pair_id"), elements, "json", path, packed=True)
    style = lambda n: F.element_at("styles", F.lit(n)).alias(n)
    return read_reports(spark, path, fmt="json").elements.select("report_id", "idx", "hpid", "tagName", "elementId", "className", "textContent", style("width"), style("color"), F.element_at("attributes", F.lit("role")).alias("role"))


@query
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports saved to a store, half of them twice; the newest 50 and their elements as they are read back."""
    reports, elements = _reports(spark, sf_dir)
    store = storage.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    half = lambda c: F.crc32(F.col(c).cast("binary")) % 2 == 0
    store.save_reports(reports.filter(half("id")), elements.filter(half("report_id")))
    store.save_reports(reports, elements)
    held = store.table("elements").groupBy("report_id").agg(F.count("*").alias("elements"), F.sum("idx").alias("places"))
    return held.join(store.table("reports").select(F.col("id").alias("report_id"), "pair_id"), "report_id")


@query
def report_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest orders of each customer, as reports of an owner."""
    return storage.newest(table(spark, sf_dir, "orders"), "o_orderdate", 50, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


@query
def comparison_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    new = orders.filter("o_orderkey % 10 = 0").select((F.col("o_orderkey") + 5).alias("o_orderkey"), F.lit("NEW").alias("o_orderstatus"))
    return storage.upsert(orders, new, ["o_orderkey"])


@query
def report_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("title"), "url")
    return storage.search(pages, "EN/1").select("id")


@query
def storage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return storage.stats(table(spark, sf_dir, "part"), "p_size")


@query
def report_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports, some without an address, a readable time or as many elements as they say."""
    k = F.col("o_orderkey")
    held = F.array_repeat(F.lit(0), (k % 3).cast("int"))
    wrong = storage.errors_of({
        "id": k.cast("string"), "version": F.lit("3.0"), "url": F.when(k % 5 == 0, "").otherwise("http://a/"), "timestamp": F.when(k % 7 == 0, "soon").otherwise("2024-01-01T00:00:00Z"),
        "totalElements": F.when(k % 11 == 0, F.lit(9)).otherwise(k % 3), "elements": held,
    })
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(wrong, "; ").alias("errors")).filter("errors <> ''")


@query
def csv_header_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    cells = F.array(F.when(k % 2 == 0, " HPID ").otherwise("Title"), F.when(k % 3 == 0, "Tag Name").otherwise("URL"), F.when(k % 5 == 0, "xpath").otherwise("x"))
    return table(spark, sf_dir, "part").select("p_partkey", text.header_like(cells).alias("header"))


@query
def rect_clipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as rectangles measured in a viewport of 600 pixels."""
    y, height = (F.col("ln") * 100 - 250).cast("double"), (F.col("qty") * 20).cast("double")
    cut = visual.clipped(y, height, F.lit(600.0))
    return lines(spark, sf_dir).select("o", "ln", cut.alias("c")).select("o", "ln", F.col("c.y").cast("long").alias("y"), F.col("c.height").cast("long").alias("height"), "c.is_clipped", "c.is_below")


@query
def csv_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(F.when(F.col("p_size") % 3 == 0, "=").when(F.col("p_size") % 3 == 1, "").otherwise('"'), F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, ", x").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", text.escape_csv(cell).alias("cell"))


@query
def pivot_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widest and lowest line of each order, by return flag as the tab's role."""
    return lines(spark, sf_dir).groupBy("o").pivot("flag", ["A", "N", "R"]).agg(F.max("qty")).select("o", *[F.col(k).alias(k.lower()) for k in "ANR"])


@query
def keyframe_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of the elements beneath each order's element."""
    rows = base(spark, sf_dir).filter("y is not null").select("pair_id", "idx", F.substring("hpid", 3, 1000).alias("hpid"), F.col("y").alias("document_y"), F.lit(0.0).alias("height"))
    return visual.clusters(rows).select("pair_id", F.concat(F.lit("1."), "root").alias("root"), "top", "bottom", "n")


# state over events


def _written(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


@query
def readiness_session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of a user's events, which ten hours of quiet end."""
    visual = table(spark, sf_dir, "events").filter(gates.visual(F.col("event_type"), ("signup",)))
    found = gates.quiet_periods(visual, "user_id", "ts", "10 hours")
    return found.select("user_id", _written("started"), _written("ready"), "n")


@query
def error_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return gates.error_counts(errors, F.lit("E"), F.get_json_object("props", "$.k"), "ts").select("key", "n", _written("first_seen"), _written("last_seen"))


@query
def perf_percentiles_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.performance(table(spark, sf_dir, "events"), "event_type", "value", "event_id").select("event_type", "n", "least", "most", "p50", "p95", "p99")


@query
def rolling_100_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum in hundredths over each user's last 100 values."""
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    window = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-99, 0)
    return table(spark, sf_dir, "events").select("event_id", F.sum(cents).over(window).alias("cents"))
