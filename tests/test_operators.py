from pyspark.sql import functions as F

from sightline.functions import css, text, url
from sightline.operators import diffing, hierarchy, matching, report, storage
from sightline.sources import html
from sightline.streaming import gates

NODE = "pair_id long, idx long, hpid string, tagName string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_colours(spark):
    cases = {"#fff": "rgba(255, 255, 255, 1)", "White": "rgba(255, 255, 255, 1)", "hsl(0, 0%, 100%)": "rgba(255, 255, 255, 1)", "rgb(1, 2, 3)": "rgba(1, 2, 3, 1)", "transparent": "rgba(0, 0, 0, 0)", "#zz": "#zz"}
    for given, want in cases.items():
        assert one(spark, css.normalize_color(F.lit(given))) == want


def test_units(spark):
    for given, want in {"1em": "16.00px", "0": "0px", "50%": "50.00%", "12pt": "16.00px", "auto": "auto", "x": "x"}.items():
        assert one(spark, css.normalize_unit(F.lit(given))) == want


def test_shorthand_leaves_given_longhands(spark):
    styles = F.create_map(*map(F.lit, ("margin", "1px 2px", "margin-left", "9px", "border", "1px solid red")))
    got = one(spark, css.expand_shorthands(styles))
    assert got["margin-left"] == "9px" and got["margin-right"] == "2px" and "margin" not in got
    assert got["border-top-style"] == "solid" and got["border-top-width"] == "1px" and got["border-top-color"] == "red"


def nodes(spark, *rows):
    return spark.createDataFrame([(1, i, h, t) for i, (h, t) in enumerate(rows)], NODE)


def test_alignment_of_insertions(spark):
    b = nodes(spark, ("1", "div"), ("1.1", "p"), ("1.2", "p"))
    c = nodes(spark, ("1", "div"), ("1.1", "p"), ("1.1.1", "b"), ("1.2", "p"))
    got = {(r.b_idx, r.c_idx, r.outcome, r.strategy) for r in matching.align(b, c).collect()}
    assert got == {(0, 0, "match", "sequence-hpid"), (1, 1, "match", "sequence-hpid"), (None, 2, "added", None), (2, 3, "match", "sequence-resync-add")}


def test_alignment_of_replaced_tags(spark):
    got = sorted(r.outcome for r in matching.align(nodes(spark, ("1", "div")), nodes(spark, ("1", "p"))).collect())
    assert got == ["added", "removed"]


def test_tolerances(spark):
    schema = "pair_id long, ord long, hpid string, base struct<styles:map<string,string>,attributes:map<string,string>,textContent:string>, other struct<styles:map<string,string>,attributes:map<string,string>,textContent:string>"
    made = lambda **s: ({k.replace("_", "-"): v for k, v in s.items()}, {}, None)
    rows = [(1, 0, "1", made(width="10px", color="#000000", opacity="1"), made(width="13px", color="#050505", opacity="0.99")), (1, 1, "1.1", made(width="10px"), made(width="14px"))]
    got = {(r.hpid, r.property, r.severity) for r in diffing.diff(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("1", "opacity", "high"), ("1.1", "width", "high")}


def test_inherited_colour_is_a_cascade(spark):
    rows = [(1, 0, "1", 0, "color", "a", "b", "visual", "high"), (1, 1, "1.1", 0, "color", "a", "b", "visual", "high"), (1, 2, "1.2", 0, "color", "a", "c", "visual", "high")]
    diffs = spark.createDataFrame(rows, "pair_id long, ord long, hpid string, n int, property string, base_value string, compare_value string, category string, severity string")
    assert {r.hpid: r.inherited for r in hierarchy.cascades(diffs).collect()} == {"1": False, "1.1": True, "1.2": False}
    assert {r.hpid: r.apex for r in hierarchy.apexes(diffs).collect()} == {"1": None, "1.1": "1", "1.2": None}


def test_content_decision(spark):
    got = one(spark, report.content_decision(F.lit(1.0), F.lit(0.0), F.lit(1), F.lit("high")))
    assert (got.action, got.severity, got.label) == ("DEMOTE", "low", "CONTENT DIVERGENCE")
    got = one(spark, report.content_decision(F.lit(0.0), F.lit(1.0), F.lit(5), F.lit("high")))
    assert (got.action, got.severity, got.label) == ("RETAIN", "high", None)


def test_report_validity(spark):
    f = {"id": "a", "version": "3.0", "url": None, "timestamp": "2024-01-01T00:00:00Z", "totalElements": 2}
    report_ = {k: F.lit(v) for k, v in f.items()} | {"elements": F.array(F.lit(1)), "url": F.lit(None).cast("string")}
    assert one(spark, storage.errors_of(report_)) == ["Missing or invalid URL", "Element count mismatch: expected 2, got 1"]
    assert one(spark, storage.version_supported(F.lit("3.10"))) and not one(spark, storage.version_supported(F.lit("2.9")))


def test_urls(spark):
    pairs = {("https://a/x/", "http://b/X?utm_source=1"): "COMPATIBLE", ("https://a/x?p=1", "https://a/x?p=2"): "CAUTION", ("https://a/x#top", "https://a/x"): "CAUTION", ("https://a/x", "https://a/y"): "INCOMPATIBLE", ("not a url", "https://a/"): "INCOMPATIBLE"}
    for (a, b), want in pairs.items():
        assert one(spark, url.compatibility(F.lit(a), F.lit(b))) == want


def test_csv_cells(spark):
    assert one(spark, text.escape_csv(F.lit("-5px"))) == "'-5px"
    assert one(spark, text.escape_csv(F.lit('a "b", c'))) == '"a ""b"", c"'


def test_page_elements(spark):
    pages = spark.createDataFrame([(1, "<html><head><title>t</title></head><body><nav id=n><a href=x>l</a></nav><p>one<p>two<script>x</script></body></html>"), (2, None)], "page_id long, html string")
    rows = html.elements(pages)
    got = {(r.hpid, r.tagName, r.section) for r in html.sections(rows).collect()}
    assert got == {("1.1", "body", "unknown"), ("1.1.1", "nav", "header"), ("1.1.1.1", "a", "header"), ("1.1.2", "p", "unknown"), ("1.1.3", "p", "unknown")} | {("1", "html", "unknown")}


def test_nearest_rank(spark):
    xs = F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0]))
    assert [one(spark, gates.nearest_rank(xs, p)) for p in (0.5, 0.95)] == [2.0, 4.0]


def test_arrivals_stream(spark, tmp_path):
    spark.range(3).selectExpr("id AS report_id", "cast('x' AS string) AS url").write.parquet(str(tmp_path / "in"))
    seen = []
    arrivals = spark.readStream.schema("report_id long, url string").parquet(str(tmp_path / "in"))
    gates.compare_arrivals(arrivals, lambda df, _: seen.append(df.count()), str(tmp_path / "check")).awaitTermination(60)
    assert sum(seen) == 3
