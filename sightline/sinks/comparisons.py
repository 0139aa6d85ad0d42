"""Comparisons as JSON, CSV, workbooks and HTML pages: one file for each pair. meta: pair_id, mode, duration and structs baseline and compare (id, url, title, timestamp, totalElements)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..compare import Comparison, grouped_report
from ..functions import css
from ..functions.text import escape_html
from ..operators.diffing import KEYS, rank
from ..shared import written
from .tables import fixed, line, lines, plain, text, workbooks, write_files

_IDENTITY = {"HPID": "hpid", "Absolute HPID": "absoluteHpid", "Tag Name": "tagName", "Element ID": "elementId", "Class Name": "className", "Text Content": "textContent", "Tier": "tier", "Depth": "depth", "CSS Selector": "cssSelector", "XPath": "xpath"}
_DIFF = {"Property": "property", "Category": "category", "Baseline Value": "base_value", "Compare Value": "compare_value", "Severity": "severity", "Diff Type": "type"}
_MATCHED = ["HPID", "Tag Name", "Element ID Attr", "Class Name", "Match Strategy", "Match Confidence", "CSS Property Changes", "Overall Severity"]


def _held(rows: DataFrame, name: str) -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast("string")


def _tables(result: Comparison) -> dict[str, DataFrame]:
    """differences, matched and unmatched rows with the columns that exports show."""
    elements = result.matches.withColumn("textContent", F.col("base.textContent"))
    shown = [c for c in _IDENTITY.values() if c in elements.columns]
    differences = result.diffs.join(elements.select("pair_id", "ord", *shown), ["pair_id", "ord"]).select("pair_id", "ord", "n", *[elements_col for elements_col in shown if elements_col != "hpid"], result.diffs["hpid"], *_DIFF.values())
    matched = elements.select(*KEYS, "tagName", "elementId", "className", "strategy", "confidence").join(result.per_match().select(*KEYS, "total", "worst"), list(KEYS), "left")
    lone = lambda rows, status: rows.select("pair_id", "idx", F.lit(status).alias("status"), *[_held(rows, c).cast("string").alias(c) for c in _IDENTITY.values()])
    unmatched = lone(result.removed, "Only in Baseline (removed)").unionByName(lone(result.added, "Only in Compare (added)"))
    return {k: written(v, k) for k, v in (("differences", differences), ("matched", matched), ("unmatched", unmatched))}


def _facts(result: Comparison, meta: DataFrame) -> DataFrame:
    """One row a pair: what the summaries show."""
    _, grouped = grouped_report(result)
    counts = result.matching().drop("ambiguous").join(result.summary(), "pair_id", "left").join(grouped.select("pair_id", "root_causes", "property_diffs"), "pair_id", "left")
    return written(meta.join(counts, "pair_id", "left").na.fill(0), "facts")


def comparison_json(result: Comparison, meta: DataFrame, exported_at: Column) -> DataFrame:
    """owner (pair_id) and value: both reports, mode, matching, summary, results with their differences, and unmatched elements."""
    tables = _tables(result)
    of = lambda rows, *order: rows.groupBy("pair_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*[c for c in rows.columns if c != "pair_id"]).alias("__row")))), lambda x: x["__row"]).alias("rows"))  # noqa: E731 a pair's elements are bounded
    diffs = tables["differences"].groupBy("pair_id", "ord").agg(F.array_sort(F.collect_list(F.struct("n", *_DIFF.values()))).alias("differences"))
    results = of(tables["matched"].join(diffs, ["pair_id", "ord"], "left"), "ord").withColumnRenamed("rows", "results")
    lone = of(tables["unmatched"], "status", "idx").withColumnRenamed("rows", "unmatched")
    facts = _facts(result, meta).join(results, "pair_id", "left").join(lone, "pair_id", "left")
    matching = F.struct(F.col("matched").alias("totalMatched"), F.col("unmatched_baseline").alias("unmatchedBaseline"), F.col("unmatched_compare").alias("unmatchedCompare"), F.col("match_rate").alias("matchRate"))
    summary = F.struct(F.col("total").alias("totalElements"), F.col("unchanged").alias("unchangedElements"), F.col("modified").alias("modifiedElements"), F.col("differences").alias("totalDifferences"), F.struct(*C.SEVERITIES).alias("severityCounts"))
    payload = F.struct(F.lit("1.0").alias("exportVersion"), F.date_format(exported_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("exportedAt"), "baseline", "compare", "mode", "duration", matching.alias("matching"), F.struct(summary.alias("summary"), F.coalesce("results", F.array()).alias("results")).alias("comparison"), F.col("unmatched").alias("unmatchedElements"))
    return facts.select(F.col("pair_id").alias("owner"), F.to_json(payload, {"pretty": "true"}).alias("value"))


def _summary_rows(rate: Column) -> list[tuple[str, Column, bool]]:
    """Names and values of the summary, and whether they are texts."""
    side = lambda n, s: [(f"{n} ID", F.col(f"{s}.id"), True), (f"{n} URL", F.col(f"{s}.url"), True), (f"{n} Title", F.col(f"{s}.title"), True), (f"{n} Timestamp", F.col(f"{s}.timestamp"), True), (f"{n} Elements", F.col(f"{s}.totalElements"), False)]
    return [*side("Baseline", "baseline"), *side("Compare", "compare"), ("Mode", F.col("mode"), True), ("Duration (ms)", F.col("duration"), False), ("Match Rate", rate, True), ("Total Matched", F.col("matched"), False), ("Unmatched Baseline", F.col("unmatched_baseline"), False), ("Unmatched Compare", F.col("unmatched_compare"), False)]


_COUNTS = {"Critical": "critical", "High": "high", "Medium": "medium", "Low": "low", "CSS Property Changes (propertyDiffCount)": "property_diffs", "Modified Elements (apex only)": "root_causes", "Modified Elements (pre-filter)": "modified", "Unchanged Elements": "unchanged", "Total Elements": "total"}


def comparison_lines(result: Comparison, meta: DataFrame) -> DataFrame:
    """owner, section, n and line of each pair's CSV: summary, severities, differences, matched and unmatched elements, and differences by severity."""
    tables, facts = _tables(result), _facts(result, meta).withColumn("owner", F.col("pair_id"))
    owned = lambda rows: rows.withColumn("owner", F.col("pair_id"))
    rate = F.concat(F.col("match_rate").cast("string"), F.lit("%"))
    cell = lambda c, is_text: text(c) if is_text else plain(c)
    parts = [fixed(facts, 0, "COMPARISON SUMMARY", *[line(n, cell(c, t)) for n, c, t in _summary_rows(rate)], "")]
    parts.append(fixed(facts, 1, "SEVERITY BREAKDOWN — counts elements by worst severity (1 element = 1 count)", *[line(n, plain(F.col(c))) for n, c in _COUNTS.items()], ""))
    parts.append(fixed(facts, 2, "DIFFERENCES", ",".join([*_IDENTITY, *_DIFF])))
    d = owned(tables["differences"])
    parts.append(lines(d, 3, "ord", "n", line=line(*[plain(_held(d, c)) if c == "depth" else text(_held(d, c)) for c in [*_IDENTITY.values(), *_DIFF.values()]])))
    parts.append(fixed(facts, 4, "", "MATCHED ELEMENTS", ",".join(_MATCHED)))
    m = owned(tables["matched"])
    parts.append(lines(m, 5, "ord", line=line(text(F.col("hpid")), text(F.col("tagName")), text(F.col("elementId")), text(F.col("className")), text(F.col("strategy")), css.two_decimals(F.col("confidence")), plain(F.coalesce("total", F.lit(0))), F.coalesce("worst", F.lit("none")))))
    parts.append(fixed(facts, 6, "", "UNMATCHED ELEMENTS", ",".join(["Status", *_IDENTITY])))
    u = owned(tables["unmatched"]).withColumn("side", (~F.col("status").contains("Baseline")).cast("int"))
    parts.append(lines(u, 7, "side", "idx", line=line(text(F.col("status")), *[plain(F.col(c)) if c == "depth" else text(F.col(c)) for c in _IDENTITY.values()])))
    parts.append(fixed(facts, 8, "", "BY SEVERITY"))
    for k, level in enumerate(C.SEVERITIES):
        own = d.filter(F.col("severity") == level)
        n = own.groupBy("owner").agg(F.count("*").alias("changes"))
        head = facts.select("owner").join(n, "owner", "left").withColumn("changes", F.coalesce("changes", F.lit(0)))
        title = F.concat(F.lit(f"{level.upper()} — "), F.col("changes").cast("string"), F.when(F.col("changes") == 1, " property change").otherwise(" property changes"))
        parts.append(fixed(head, 9 + 4 * k, title))
        parts.append(fixed(head.filter("changes > 0"), 10 + 4 * k, "Element ID,Tag,Property,Baseline Value,Compare Value"))
        parts.append(lines(own, 11 + 4 * k, "ord", "n", line=line(*[text(_held(d, c)) for c in ("elementId", "tagName", "property", "base_value", "compare_value")])))
        parts.append(fixed(head, 12 + 4 * k, ""))
    return reduce(DataFrame.unionByName, parts)


def comparison_workbooks(result: Comparison, meta: DataFrame) -> DataFrame:
    """owner and content: a workbook of each pair with the sheets Summary, Differences, Matched Elements, Unmatched Elements and By Severity."""
    tables, facts = _tables(result), _facts(result, meta)
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    row = lambda *cells: F.array(*[F.lit(c) if isinstance(c, str) else shown(c) for c in cells])
    out: list[DataFrame] = []

    def sheet(k: int, name: str, head: list[str], rows: DataFrame, cells: Column, *order: Column) -> None:
        from pyspark.sql import Window

        n = F.row_number().over(Window.partitionBy("pair_id").orderBy(*order)) if order else F.lit(1)
        own = lambda frame, n, cells: frame.select(F.col("pair_id").alias("owner"), F.lit(k).alias("sheet"), F.lit(name).alias("sheet_name"), n.cast("int").alias("n"), cells.alias("cells"))
        out.append(own(facts, F.lit(0), row(*head)))
        out.append(own(rows, n, cells))

    rate = F.concat(F.col("match_rate").cast("string"), F.lit("%"))
    pairs = [*[(n, c) for n, c, _ in _summary_rows(rate)], *[(n, F.col(c)) for n, c in _COUNTS.items()]]
    flat = facts.select("pair_id", F.posexplode(F.array(*[row(n, c) for n, c in pairs])).alias("at", "cells"))
    sheet(0, "Summary", ["Field", "Value"], flat, F.col("cells"), F.col("at"))
    d = tables["differences"]
    sheet(1, "Differences", [*_IDENTITY, *_DIFF], d, row(*[_held(d, c) for c in [*_IDENTITY.values(), *_DIFF.values()]]), F.col("ord"), F.col("n"))
    m = tables["matched"]
    sheet(2, "Matched Elements", _MATCHED, m, row(*[F.col(c) for c in ("hpid", "tagName", "elementId", "className", "strategy")], css.two_decimals(F.col("confidence")), F.coalesce("total", F.lit(0)), F.coalesce("worst", F.lit("none"))), F.col("ord"))
    u = tables["unmatched"]
    sheet(3, "Unmatched Elements", ["Status", *_IDENTITY], u, row(F.col("status"), *[F.col(c) for c in _IDENTITY.values()]), F.desc("status"), F.col("idx"))
    sheet(4, "By Severity", ["Severity", "Element ID", "Tag", "Property", "Baseline Value", "Compare Value"], d, row(F.col("severity"), *[_held(d, c) for c in ("elementId", "tagName", "property", "base_value", "compare_value")]), rank(F.col("severity")), F.col("ord"), F.col("n"))
    return workbooks(reduce(DataFrame.unionByName, out))


def filter_items(items: DataFrame, severity: str | None = None, category: str | None = None, label: str | None = None) -> DataFrame:
    """Items of a grouped report that fit all of the filters given; category by the properties' kinds, label by a part of the text in any case."""
    kept = items
    if severity:
        kept = kept.filter(F.col("group") == severity)
    if category:
        kept = kept.filter(F.arrays_overlap("properties", F.array(*map(F.lit, C.PROPERTY_CATEGORIES.get(category, [category])))))
    if label:
        kept = kept.filter(F.contains(F.lower("label"), F.lit(label.lower())))
    return kept


def is_url_noise(attribute: Column) -> Column:
    """Attributes whose changes a report hides by default, as they only name addresses."""
    return F.regexp_replace(attribute, "^attr:", "").isin(C.URL_NOISE_ATTRIBUTES)


def comparison_html(result: Comparison, meta: DataFrame) -> DataFrame:
    """owner and value: a page of each pair with the summary and the grouped report's items."""
    items, summary = grouped_report(result)
    cell = lambda c: F.concat(F.lit("<td>"), escape_html(c.cast("string")), F.lit("</td>"))
    shown = items.filter(F.col("group").isin(*C.SEVERITIES, "added", "removed", "ambiguous"))
    row = F.concat(F.lit('<tr class="'), "group", F.lit('">'), *[cell(F.col(c)) for c in ("group", "label", "hpid", "narrative", "total", "recurrence", "suppression_summary")], cell(F.array_join("properties", ", ")), F.lit("</tr>"))
    order = F.struct(F.array_position(F.array(*map(F.lit, [*C.SEVERITIES, "added", "removed", "ambiguous"])), F.col("group")).alias("g"), F.coalesce("place", F.lit(0)).alias("p"), F.col("hpid").alias("h"), row.alias("row"))
    body = shown.groupBy("pair_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["row"]), "\n").alias("body"))  # a pair's elements are bounded
    facts = meta.join(summary, "pair_id", "left").join(body, "pair_id", "left")
    title = F.concat(escape_html(F.col("baseline.url")), F.lit(" / "), escape_html(F.col("compare.url")))
    numbers = F.concat(*[F.concat(F.lit(f"<dt>{n}</dt><dd>"), F.coalesce(F.col(c).cast("string"), F.lit("0")), F.lit("</dd>")) for n, c in (("Impact score", "impact_score"), ("Root causes", "root_causes"), ("Suppressed", "suppressed_children"), ("Unchanged", "unchanged"), ("Added", "added"), ("Removed", "removed"), ("Layout", "layout"), ("Style", "style"), ("Content", "content"), ("DOM", "dom"))])
    head = "".join(f"<th>{h}</th>" for h in ("Severity", "Element", "HPID", "Kind", "Differences", "Recurrences", "Suppressed", "Properties"))
    page = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), title, F.lit("</title><style>body{font-family:sans-serif}td,th{padding:2px 8px;text-align:left}dt{float:left;clear:left;width:10em}.critical{background:#fdd}.high{background:#fed}.medium{background:#ffd}</style></head><body><h1>"), title, F.lit("</h1><dl>"), numbers, F.lit(f"</dl><table><thead><tr>{head}</tr></thead><tbody>"), F.coalesce("body", F.lit("")), F.lit("</tbody></table></body></html>"))
    return facts.select(F.col("pair_id").alias("owner"), page.alias("value"))


def export_comparison(result: Comparison, meta: DataFrame, fmt: str, path: str, exported_at: Column | None = None) -> None:
    """Writes each pair's comparison as json, csv, html or excel (a table of workbooks); ValueError for other formats."""
    if fmt == "csv":
        write_files(comparison_lines(result, meta), path)
    elif fmt == "json":
        comparison_json(result, meta, F.current_timestamp() if exported_at is None else exported_at).write.partitionBy("owner").text(path)
    elif fmt == "html":
        comparison_html(result, meta).write.partitionBy("owner").text(path)
    elif fmt == "excel":
        comparison_workbooks(result, meta).write.parquet(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")
