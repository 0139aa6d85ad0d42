"""SQL functions give what the DataFrame functions give."""

from pyspark.sql import functions as F

from sightline.functions import css, hpid, sql, url
from sightline.operators import diffing


def test_equal_to_the_dataframe_form(spark):
    assert {"css_normalize", "css_severity", "url_compat", "hpid_ancestors"} <= set(sql.register(spark)) == set(sql.register(spark))
    values = ["#fff", "#12345680", "White", "rgb(1, 2, 3)", "hsl(120, 100%, 50%)", "transparent", "inherit", "it's", "", None, "0.125px", "1em", "50%", "-1.005px", "'Arial', SERIF", "a\\b"]
    rows = [(p, a, b) for p in ("width", "color", "display", "margin-top", "attr:x", "it's") for a in values for b in values]
    spark.createDataFrame(rows, "p string, a string, b string").createOrReplaceTempView("sql_cases")
    df = spark.table("sql_cases")
    got = spark.sql("SELECT p, a, b, css_normalize(a) c, css_normalize_unit(a) u, css_normalize_font(a) f, css_severity(p, css_normalize(a), css_normalize(b)) s, hpid_depth(a) d, hpid_parent(a) h FROM sql_cases")
    c, n = F.col, lambda x: css.normalize_color(F.col(x))
    parsed = df.select("p", "a", "b", *diffing.parsed(n("a"), n("b")))
    want = parsed.select("p", "a", "b", n("a").alias("c"), css.normalize_unit(c("a")).alias("u"), css.normalize_font(c("a")).alias("f"), diffing.severity(c("p"), diffing.category(c("p"))).alias("s"), hpid.depth(c("a")).alias("d"), hpid.parent(c("a")).alias("h"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_addresses_and_lateral_paths(spark):
    sql.register(spark)
    urls = ["http://a/x?p=1", "http://b/X/?p=1&utm_a=1", "http://a/y", "no address", None, "http://a/x#h"]
    df = spark.createDataFrame([(i, a, b) for i, a in enumerate(urls) for b in urls], "i long, a string, b string")
    got = spark.sql("SELECT i, b, url_compat(a, b) c FROM {df}", df=df)
    assert sorted(map(str, got.collect())) == sorted(map(str, df.select("i", "b", url.compatibility(F.col("a"), F.col("b")).alias("c")).collect()))
    found = spark.sql("SELECT h, depth, ancestor FROM VALUES ('1.4.2'), ('7'), ('') v(h), LATERAL hpid_ancestors(h)").collect()
    assert sorted(map(tuple, found)) == [("1.4.2", 1, "1"), ("1.4.2", 2, "1.4")]


def test_no_python_runs(spark):
    sql.register(spark)
    plan = spark.sql("SELECT css_normalize_unit(CAST(id AS STRING)) FROM range(5)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
