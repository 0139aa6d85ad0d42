"""SQL functions of a session, made from the same expressions as the DataFrame functions: no Python runs in their rows.

css_normalize(value) for colours, css_normalize_unit, css_normalize_font, css_rgba, css_px, css_category(property),
css_severity(property, base, compare) of two normalised values, url_compat(a, b), hpid_parent(path), hpid_depth(path), and
hpid_ancestors(path), a table function for LATERAL: depth and ancestor, from the root down.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..operators import diffing
from . import css, hpid, url

#: String literals (kept as they are), casts and structs (parts of the grammar), names or signs that are called, and numbers with a point.
_PARTS = re.compile(r"'(?:\\.|[^'\\])*'|\b(?:CAST|TRY_CAST|DECIMAL|struct)\(|([A-Za-z_]\w*|[=<>!+\-*/%&|^]+)\(|(?<![\w.])(\d+\.\d+(?:E-?\d+)?)(?![\w.])", re.S)


def text_of(column: Column) -> str:
    """A column expression as SQL text; functions are named in back quotes, as operators are called like functions, and fractions are doubles."""
    return _PARTS.sub(lambda m: f"`{m[1]}`(" if m[1] else f"{m[2]}D" if m[2] else m[0], column._jc.node().sql())


def functions(spark: SparkSession) -> dict[str, tuple[str, str, str]]:
    """Arguments, type and SQL text of each scalar function; later ones may call earlier ones."""
    c = F.col
    kind = lambda column: spark.range(1).select(F.lit("").alias("value")).select(column).schema[0].dataType.simpleString()
    rgba, px = css.parse_rgba(c("value")), css.parse_px(c("value"))
    parsed = f"property STRING, kind STRING, b_rgba {kind(rgba)}, c_rgba {kind(rgba)}, b_px {kind(px)}, c_px {kind(px)}"
    made = {
        "css_normalize": ("value STRING", "STRING", css.normalize_color(c("value"))),
        "css_normalize_unit": ("value STRING", "STRING", css.normalize_unit(c("value"))),
        "css_normalize_font": ("value STRING", "STRING", css.normalize_font(c("value"))),
        "css_rgba": ("value STRING", kind(rgba), rgba),
        "css_px": ("value STRING", kind(px), px),
        "css_category": ("property STRING", "STRING", diffing.category(c("property"))),
        "css_severity_parsed": (parsed, "STRING", diffing.severity(c("property"), c("kind"))),
        "url_compat": ("a STRING, b STRING", "STRING", url.compatibility(c("a"), c("b"))),
        "hpid_parent": ("path STRING", "STRING", hpid.parent(c("path"))),
        "hpid_depth": ("path STRING", "INT", hpid.depth(c("path"))),
    }
    texts = {name: (arguments, returns, text_of(column)) for name, (arguments, returns, column) in made.items()}
    texts["css_severity"] = ("property STRING, base STRING, compare STRING", "STRING", "css_severity_parsed(property, css_category(property), css_rgba(base), css_rgba(compare), css_px(base), css_px(compare))")
    return texts


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session (again, if they are there); their names."""
    made = functions(spark)
    for name, (arguments, kind, text) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {text}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION hpid_ancestors(path STRING) RETURNS TABLE (depth INT, ancestor STRING) RETURN SELECT pos + 1, col FROM (SELECT posexplode({text_of(hpid.ancestors(F.col('path')))}))")
    return [*made, "hpid_ancestors"]
