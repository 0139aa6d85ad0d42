"""Screens and rectangles: what can be computed from measurements. Rows carry pair_id (or a session) and the element's path."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import css
from ..functions import hpid as H

#: Pixels above an element that a screen cut out of a tall cluster begins at.
OVERFLOW_PAD = 40
KEYFRAMES = "pair_id long, root string, cut int, scroll_y long, element_ids array<string>"


def clamp_scroll(raw: Column, viewport: Column, document: Column) -> Column:
    """A place that a page can be scrolled to; 0 where it fits."""
    return F.when(document <= viewport, 0).otherwise(F.floor(F.greatest(F.lit(0), F.least(raw, document - viewport)))).cast("long")


def rounded_rect(rect: Column, scroll_x: Column, scroll_y: Column) -> Column:
    """x, y, width, height, top and left in whole pixels of the document, half going up; null without a rectangle."""
    at = lambda name, shift: css.js_round(rect[name] + shift).cast("int").alias(name)
    zero = F.lit(0)
    return F.when(rect.isNotNull(), F.struct(at("x", scroll_x), at("y", scroll_y), at("width", zero), at("height", zero), at("top", scroll_y), at("left", scroll_x)))


def clusters(elements: DataFrame) -> DataFrame:
    """Extents of the elements under each root: pair_id, root, top, bottom and their number, the topmost first (place)."""
    rows = elements.withColumn("root", H.root(F.col("hpid")))
    out = rows.groupBy("pair_id", "root").agg(F.min("document_y").alias("top"), F.max(F.col("document_y") + F.col("height")).alias("bottom"), F.count("*").alias("n"), F.min("idx").alias("first"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("pair_id").orderBy("top", "first")))


def keyframes(elements: DataFrame, viewport_height: int, document_height: int, viewport_width: int = 1024) -> DataFrame:
    """Screens that show all elements (pair_id, idx, hpid, document_y, height): keyframe_id, scroll_y and the paths on each.

    A cluster that fits the viewport is one screen around its middle; a taller one is cut from the top on, each screen beginning
    a little above the first element that the one before didn't reach. Clusters are cut each on its own.
    """
    viewport, document = F.lit(viewport_height), F.lit(document_height)
    extents = clusters(elements)
    rows = elements.withColumn("root", H.root(F.col("hpid"))).join(extents.select("pair_id", "root", "top", "bottom", "place"), ["pair_id", "root"])
    fits = F.col("bottom") - F.col("top") <= viewport
    middle = clamp_scroll((F.col("top") + F.col("bottom")) / 2 - viewport / 2, viewport, document)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hpid"))), lambda x: x["hpid"])  # an element's siblings of one report
    whole = rows.filter(fits).groupBy("pair_id", "root").agg(F.lit(0).alias("cut"), F.first(middle).alias("scroll_y"), ids.alias("element_ids"))

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["document_y", "idx"], kind="stable")
        y, paths, out, i = group["document_y"].to_numpy(), group["hpid"].tolist(), [], 0
        while i < len(y):
            scroll = 0 if document_height <= viewport_height else int(max(0, min(y[i] - OVERFLOW_PAD, document_height - viewport_height)) // 1)
            end = i
            while end < len(y) and y[end] < scroll + viewport_height:
                end += 1
            end = max(end, i + 1)
            out.append((group["pair_id"].iloc[0], group["root"].iloc[0], len(out), scroll, paths[i:end]))
            i = end
        return pd.DataFrame(out, columns=["pair_id", "root", "cut", "scroll_y", "element_ids"])

    tall = rows.filter(~fits).select("pair_id", "root", "idx", "hpid", "document_y").groupBy("pair_id", "root").applyInPandas(cut, KEYFRAMES)
    found = whole.unionByName(tall).join(extents.select("pair_id", "root", "place"), ["pair_id", "root"])
    number = F.row_number().over(Window.partitionBy("pair_id").orderBy("place", "cut")) - 1
    return found.select("pair_id", F.concat(F.lit("kf_"), number.cast("string")).alias("keyframe_id"), "scroll_y", F.lit(viewport_width).alias("viewport_width"), F.lit(viewport_height).alias("viewport_height"), "element_ids")


def clipped(y: Column, height: Column, viewport: Column) -> Column:
    """A measured rectangle within the viewport: y, height, is_clipped, and is_below where nothing of it is to be seen."""
    top, bottom = F.greatest(F.lit(0.0), y), F.least(y + height, viewport)
    shown = F.greatest(F.lit(1.0), bottom - top)
    return F.struct(top.alias("y"), shown.alias("height"), (shown < height).alias("is_clipped"), (bottom <= 0).alias("is_below"))


def manifest(frames: DataFrame, measured: DataFrame, viewport_height: float) -> DataFrame:
    """Each path on a screen with its clipped and raw rectangle, and whether and why it is misaligned.

    frames: keyframes(); measured: pair_id, keyframe_id, hpid, found, viewport_x, viewport_y, width, height, in_viewport, misalign_reason.
    """
    asked = frames.select("pair_id", "keyframe_id", "scroll_y", F.explode("element_ids").alias("hpid"))
    met = asked.join(measured, ["pair_id", "keyframe_id", "hpid"], "left")
    found = F.coalesce("found", F.lit(False))
    cut = clipped(F.col("viewport_y"), F.col("height"), F.lit(float(viewport_height)))
    rows = met.withColumn("cut", F.when(found, cut))
    shown = found & ~F.col("cut.is_below")
    reason = F.when(~found, F.coalesce("misalign_reason", F.lit("element-not-found"))).when(F.col("cut.is_below"), "clipped-below-fold").when(~F.col("in_viewport"), F.col("misalign_reason"))
    rect = lambda y, h: F.when(shown, F.struct(F.col("viewport_x").alias("x"), y.alias("y"), F.col("width").alias("width"), h.alias("height")))
    return rows.select(
        "pair_id", "keyframe_id", "hpid", "scroll_y", rect(F.col("cut.y"), F.col("cut.height")).alias("rect"), rect(F.col("viewport_y"), F.col("height")).alias("raw_rect"),
        (~shown | ~F.coalesce("in_viewport", F.lit(False))).alias("misaligned"), reason.alias("misalign_reason"), F.coalesce("cut.is_clipped", F.lit(False)).alias("rect_clipped"),
    )


def with_pseudo(entries: DataFrame, pseudo: DataFrame) -> DataFrame:
    """entries with the styles of ::before and ::after (pseudo: pair_id, hpid, before, after)."""
    return entries.join(pseudo.select("pair_id", "hpid", F.col("before").alias("pseudo_before"), F.col("after").alias("pseudo_after")), ["pair_id", "hpid"], "left")


def diff_map(changed: DataFrame, baseline: DataFrame, compare: DataFrame) -> DataFrame:
    """Changed elements that either side's manifest knows, flattened: every field of the baseline's and of the compare's entry, and whether their screens differ."""
    sides = []
    for name, entries in (("baseline", baseline), ("compare", compare)):
        sides.append(entries.select("pair_id", "hpid", *[F.col(c).alias(f"{name}_{c}") for c in entries.columns if c not in ("pair_id", "hpid")], F.lit(True).alias(f"in_{name}")))
    met = changed.select("pair_id", "hpid").distinct().join(sides[0], ["pair_id", "hpid"], "left").join(sides[1], ["pair_id", "hpid"], "left")
    met = met.filter(F.col("in_baseline") | F.col("in_compare"))
    flags = {f"{side}_{c}": F.coalesce(f"{side}_{c}", F.lit(False)) for side in ("baseline", "compare") for c in ("misaligned", "rect_clipped")}
    return met.withColumns(flags).withColumn("keyframes_differ", keyframes_differ(F.col("baseline_keyframe_id"), F.col("compare_keyframe_id"))).drop("in_baseline", "in_compare")


def keyframes_differ(a: Column, b: Column) -> Column:
    """Whether the numbers at the end of two keyframe ids differ; a missing one never does."""
    number = lambda k: F.nullif(F.regexp_extract(k, r"kf_(\d+)$", 1), F.lit(""))
    return F.coalesce(number(a) != number(b), F.lit(False))


def map_position(top: Column, document: Column) -> Column:
    """Percent of the page's height, 0 to 100."""
    return F.when(document > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), top / document * 100))).otherwise(0.0)
