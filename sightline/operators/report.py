"""The grouped report: items by severity, recurrences, content intelligence, impact score, distribution, root causes.

diffs is the long form of operators.diffing with any label column: one row per difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import css
from ..functions.text import divergence, trimmed
from .diffing import KEYS, rank

# Property names by badge.
_LAYOUT = "position|display|flex|grid|float|overflow|visibility|z-index"
_SIZE = "^width$|^height$|max-width|min-width|^margin|^padding"
_PLACE = "^top$|^left$|^right$|^bottom$|transform"


def by_category(diffs: DataFrame) -> DataFrame:
    """Each element's differences by category, as an array ordered by severity, then by place."""
    entry = F.struct(rank(F.col("severity")).alias("rank"), "n", "property", "base_value", "compare_value")
    return diffs.groupBy(*KEYS, "category").agg(F.array_sort(F.collect_list(entry)).alias("diffs"))  # as many as an element has properties


def badge(names: Column, content: Column) -> Column:
    """The narrative badge of an item from its property names."""
    has = lambda pattern: F.exists(names, lambda p: p.rlike(pattern))
    return F.when(content, "CONTENT DIVERGENCE").when(has(_LAYOUT) | has(_SIZE), "LAYOUT SHIFT").when(has(_PLACE), "POSITION DRIFT").otherwise("STYLE REGRESSION")


def items(diffs: DataFrame) -> DataFrame:
    """One row per changed element: worst severity, number of differences, sorted signature, property names, and the label that diffs carry."""
    sign = F.concat_ws("\x02", "property", F.coalesce("base_value", F.lit("")), F.coalesce("compare_value", F.lit("")))
    return diffs.groupBy(*KEYS).agg(
        F.first("label").alias("label"), F.min_by("severity", rank(F.col("severity"))).alias("severity"), F.count("*").alias("total"),
        F.array_join(F.array_sort(F.collect_list(sign)), "\x01").alias("signature"), F.array_sort(F.collect_set("property")).alias("properties"),
    )


def recurrences(rows: DataFrame) -> DataFrame:
    """Items of one comparison and severity with equal labels and signatures become the first of them, with their number and paths in order."""
    extra = [c for c in ("is_apex", "suppressed") if c in rows.columns]
    first = F.min_by(F.struct("ord", "hpid", "total", "properties", *extra), "ord").alias("first")
    paths = F.transform(F.array_sort(F.collect_list(F.struct("ord", "hpid"))), lambda x: x["hpid"])  # as many as a comparison has elements
    grouped = rows.groupBy("pair_id", "severity", "label", F.sha2("signature", 256).alias("__signature")).agg(first, F.count("*").alias("recurrence"), paths.alias("recurrence_hpids"))
    return grouped.select("pair_id", "severity", "label", "first.*", "recurrence", "recurrence_hpids")


def impact(rows: DataFrame) -> DataFrame:
    """Impact score, penalty, root causes by severity, and those whose change is their content's, of each comparison."""
    of = lambda s: F.count_if(F.col("severity") == s)
    demoted = F.count_if(F.col("demoted")) if "demoted" in rows.columns else F.lit(0).cast("long")
    counts = rows.groupBy("pair_id").agg(*[of(s).alias(s) for s in C.SEVERITIES], F.count("*").alias("root_causes"), demoted.alias("content_demoted"))
    penalty = sum((F.col(s) * int(10 * w) for s, w in C.SEVERITY_WEIGHTS.items()), F.lit(0))  # in tenths
    score = F.greatest(F.lit(0), F.floor((1000 - penalty) / 10 + 0.5)).cast("int")
    return counts.withColumn("raw_penalty", penalty / 10).withColumn("impact_score", score)


def distribution(rows: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Items of each comparison by layout, style and content, and its added and removed elements (dom)."""
    named = rows.select("pair_id", badge(F.col("properties"), F.col("demoted") if "demoted" in rows.columns else F.lit(False)).alias("badge"))
    for dom in (added, removed):
        if dom is not None:
            named = named.unionByName(dom.select("pair_id", F.lit("DOM").alias("badge")))
    of = lambda *b: F.count_if(F.col("badge").isin(*b))
    return named.groupBy("pair_id").agg(of("LAYOUT SHIFT").alias("layout"), of("STYLE REGRESSION", "POSITION DRIFT").alias("style"), of("CONTENT DIVERGENCE").alias("content"), of("DOM").alias("dom"))


def top_causes(rows: DataFrame, n: int = 3) -> DataFrame:
    """The n apexes of each comparison that absorbed the most differences; where there is no apex, the items with the most differences. Earlier ones first among equals."""
    if "is_apex" in rows.columns:
        any_apex = F.max(F.col("is_apex").cast("int")).over(Window.partitionBy("pair_id")) == 1
        rows = rows.withColumn("__weight", F.when(any_apex, F.col("suppressed")).otherwise(F.col("total"))).filter(~any_apex | F.col("is_apex"))
    else:
        rows = rows.withColumn("__weight", F.col("total"))
    ranked = F.array_position(F.array(*map(F.lit, C.SEVERITIES)), F.col("severity"))
    ties = ["ord"] if "is_apex" not in rows.columns else [ranked, F.desc("total"), "ord"]
    place = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("__weight"), *ties))
    return rows.withColumn("place", place).filter(F.col("place") <= n).drop("__weight")


def geometry_error(base_px: Column, other_px: Column, base_len: Column, other_len: Column) -> Column:
    """0 to 1: how far a size and its text's length changed apart; null where either can't be told."""
    text, size = F.least(other_len / base_len, F.lit(C.TEXT_RATIO_CAP)), other_px / base_px
    error = F.least(F.abs(text - size) / F.greatest(text, F.abs(size), F.lit(1.0)), F.lit(1.0))
    apart = (other_len >= base_len) != (other_px >= base_px)
    return F.when((base_px != 0) & (base_len != 0), F.when(apart, F.least(error + 0.35, F.lit(1.0))).otherwise(error))


def content_decision(text_score: Column, geometry: Column, recurrence: Column, severity: Column) -> Column:
    """(action, severity, label, confidence) of a width or height difference whose element's text changed too.

    geometry is geometry_error. Recurring changes speak for the layout, single ones for the content.
    """
    few, alone = recurrence.between(2, 3), recurrence == 1
    content = text_score * 0.50 + F.coalesce(1 - geometry, F.lit(0.5)) * 0.30 + F.when(alone, 0.20).when(few, 0.05).otherwise(0.0)
    layout = (1 - text_score) * 0.40 + F.coalesce(geometry, F.lit(0.5)) * 0.35 + F.when(alone, 0.0).when(few, 0.05).otherwise(0.20)
    kind = F.when(content >= 0.65, "DEMOTE").when((content >= 0.45) & (content > layout), "SOFT_DEMOTE").when(layout >= 0.65, "RETAIN").otherwise("SOFT_DEMOTE")
    wanted = lambda k: F.when(k == "DEMOTE", "low").when(k == "SOFT_DEMOTE", "medium").otherwise(severity)
    raised = lambda k: rank(wanted(k)) < rank(severity)

    def made(k: Column) -> Column:
        return F.struct(
            F.when(raised(k), "RETAIN").otherwise(k).alias("action"), F.when(raised(k), severity).otherwise(wanted(k)).alias("severity"),
            F.when(k != "RETAIN", "CONTENT DIVERGENCE").alias("label"), F.greatest(content, layout).alias("confidence"),
        )

    return css.let(kind, made)


def text_changes(matches: DataFrame) -> DataFrame:
    """KEYS, the divergence of the texts of pairs that both have one, where they differ, and both lengths."""
    b, c = trimmed(F.col("base.textContent")), trimmed(F.col("other.textContent"))
    return matches.filter((b != "") & (c != "") & (b != c)).select(*KEYS, divergence(b, c).alias("divergence"), F.length(b).alias("b_len"), F.length(c).alias("c_len"))


def settled_items(settled: DataFrame) -> DataFrame:
    """Items of what apex suppression (hierarchy.apexes, on diffs with a label) leaves, with is_apex, is_partial and suppressed differences."""
    left = items(settled.filter("apex is null").drop("apex", "fully"))
    took = settled.filter("apex is not null").groupBy("pair_id", F.col("apex").alias("hpid")).agg(F.count("*").alias("taken"))
    lost = settled.filter("apex is not null and not fully").groupBy(*KEYS).agg(F.count("*").alias("lost"))
    met = left.join(took, ["pair_id", "hpid"], "left").join(lost, list(KEYS), "left")
    apex, partial = F.col("taken").isNotNull(), F.col("lost").isNotNull()
    return met.withColumns({"is_apex": apex, "is_partial": partial, "suppressed": F.coalesce("taken", "lost", F.lit(0).cast("long"))}).drop("taken", "lost")


def with_content(once: DataFrame, settled: DataFrame, texts: DataFrame) -> DataFrame:
    """once (recurrences) after content intelligence: severity may fall, demoted tells whose change is their content's, group_before the severity that came in.

    texts: KEYS, divergence, b_len and c_len of pairs whose texts differ. Width and height differences of an item are decided
    on with its recurrence; the item's severity falls if that of its worst difference does.
    """
    left = settled.filter("apex is null").select(*KEYS, "property", "base_value", "compare_value", F.col("severity").alias("before"))
    met = left.join(texts, list(KEYS)).join(once.select("pair_id", "ord", "hpid", "recurrence"), list(KEYS))
    sized = F.col("property").isin("width", "height")
    error = geometry_error(css.leading_number(F.col("base_value")), css.leading_number(F.col("compare_value")), F.col("b_len"), F.col("c_len"))
    decided = met.withColumn("d", F.when(sized, content_decision(F.col("divergence"), error, F.col("recurrence"), F.col("before"))))
    after = F.coalesce("d.severity", "before")
    fallen = decided.groupBy(*KEYS).agg(
        F.coalesce(F.bool_or(F.col("d.action") != "RETAIN"), F.lit(False)).alias("changed"), F.min_by(after, rank(after)).alias("after"),
        F.coalesce(F.bool_and(F.when(sized, F.col("d.label").isNotNull())), F.lit(True)).alias("labelled"),
    )
    out = once.join(fallen, list(KEYS), "left")
    falls = F.coalesce(F.col("changed") & (rank(F.col("after")) > rank(F.col("severity"))), F.lit(False))
    return out.withColumns({"group_before": F.col("severity"), "demoted": falls & F.col("labelled"), "severity": F.when(falls, F.col("after")).otherwise(F.col("severity"))}).drop("changed", "after", "labelled")


def placed(rows: DataFrame) -> DataFrame:
    """rows with place: the order within a severity group, the most differences first; items that came from another group stand behind equals."""
    came = F.when(F.col("severity") == F.col("group_before"), 0).otherwise(rank(F.col("group_before")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("pair_id", "severity").orderBy(F.desc("total"), came, "ord")))


def instances(rows: DataFrame) -> DataFrame:
    """One row per path of each recurring item: which instance of how many it is."""
    return rows.select("pair_id", "label", "severity", F.col("recurrence").alias("of"), F.posexplode("recurrence_hpids").alias("at", "hpid")).select("pair_id", "hpid", "label", "severity", (F.col("at") + 1).alias("instance"), "of")


#: Groups of a report in the order in which its items are looked at.
GROUPS = (*C.SEVERITIES, "added", "removed", "unchanged")


def item_map(rows: DataFrame) -> DataFrame:
    """Which item and which label each path of a report goes by: pair_id, node, group, is_apex, label, instance and of.

    rows: items with pair_id, hpid, label, group (of GROUPS), place, and is_apex and recurrence_hpids where they are changed. A
    path's own item comes first, of several the one looked at last; else it is that of the first recurrence that counts the path.
    For labels unchanged items are looked at before all others, for items after them.
    """
    at = lambda names: F.array_position(F.array(*map(F.lit, names)), F.col("group"))
    far = F.coalesce("place", F.lit(0))
    item = F.struct(F.col("group"), F.coalesce("is_apex", F.lit(False)).alias("is_apex"), F.coalesce(F.size("recurrence_hpids"), F.lit(1)).alias("of"))
    held = rows.select("pair_id", "hpid", "label", item.alias("item"), at(GROUPS).alias("g"), at(("unchanged", *GROUPS[:-1])).alias("l"), far.alias("place"), F.coalesce("recurrence_hpids", F.array("hpid")).alias("paths"))
    each = held.select("pair_id", "hpid", "label", "item", "g", "l", "place", F.posexplode("paths").alias("i", "node"))
    own = F.col("node") == F.col("hpid")
    order = lambda c: F.struct((~own).alias("a"), F.when(own, -F.col(c)).otherwise(F.col(c)).alias("b"), F.when(own, -F.col("place")).otherwise(F.col("place")).alias("c"), "i")
    found = each.groupBy("pair_id", "node").agg(F.min_by(F.struct("item", (F.col("i") + 1).alias("instance")), order("g")).alias("x"), F.min_by("label", order("l")).alias("label"))
    return found.select("pair_id", "node", "x.item.group", "x.item.is_apex", "label", "x.instance", "x.item.of")


def finalised(matches: DataFrame, residual: DataFrame, root_causes: DataFrame, settled: DataFrame, added: DataFrame, removed: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """The report's summary, a row for each comparison, with `consistent`: severities sum up to the root causes, and these, the suppressed and the unchanged to all matched pairs."""
    zero = F.lit(0).cast("long")
    per_match = residual.groupBy(*KEYS).agg(F.count("*").alias("n"))
    counts = [
        matches.groupBy("pair_id").agg(F.count("*").alias("matched_pairs")),
        per_match.groupBy("pair_id").agg(F.count("*").alias("modified_before"), F.sum("n").alias("differences")),
        added.groupBy("pair_id").agg(F.count("*").alias("added")), removed.groupBy("pair_id").agg(F.count("*").alias("removed")),
        ambiguous.groupBy("pair_id").agg(F.count("*").alias("ambiguous")),
        impact(root_causes), distribution(root_causes, added, removed),
        root_causes.groupBy("pair_id").agg(F.sum("total").alias("property_diffs")),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(c, "pair_id", "full_outer")
    out = out.na.fill(0).withColumn("impact_score", F.when(F.col("root_causes") == 0, 100).otherwise(F.col("impact_score")).cast("int"))
    out = out.withColumns({"unchanged": F.col("matched_pairs") - F.col("modified_before"), "suppressed_children": F.col("modified_before") - F.col("root_causes"), "modified": F.col("root_causes") + zero})
    sums = sum((F.col(s) for s in C.SEVERITIES), zero)
    return out.withColumn("consistent", (sums == F.col("modified")) & (F.col("modified") + F.col("suppressed_children") + F.col("unchanged") == F.col("matched_pairs")))
