"""What the diff step works out once, and what it spreads."""

from pyspark.sql import functions as F

from sightline.functions import css
from sightline.operators import diffing
from sightline.plans.queries import QUERIES
from sightline.plans.snapshots import matched
from sightline.sources.reports import read_reports


def test_whole_values_take_the_short_way_to_the_same_text(spark):
    values = ["12px", "012px", "0px", "7px\n", "1000000000px", "rgb(1, 20, 255)", "rgb(01, 2, 3)", "rgb(1,2,3)", "rgb(1, 2, 3)\n", "RGB(1, 2, 3)", " 5px", "auto", "red", "", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    for name, plain in (("color", css.normalize_color), ("width", css.normalize_unit)):
        found = rows.select("v", css.normalize_value(F.lit(name), F.col("v")).alias("got"), F.when(F.col("v") == "", "").otherwise(plain(F.col("v"))).alias("want")).collect()
        assert [(r.v, r.got) for r in found] == [(r.v, r.want) for r in found]


def test_a_callers_styles_are_bound_before_they_are_compared(spark):
    side = lambda n: F.struct(F.create_map(F.lit("padding"), F.concat(F.col("id").cast("string"), F.lit(n))).alias("styles"), F.create_map().cast("map<string,string>").alias("attributes"), F.lit("").alias("textContent"))
    made = spark.range(3).select(F.col("id").alias("pair_id"), F.col("id").alias("ord"), F.col("id").cast("string").alias("hpid"), side("1px").alias("base"), side("9px").alias("other"))
    plan = diffing.diff(made)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("1px") == 1


def test_parts_are_dealt_over_all_cores(spark, sf_dir):
    for name in ("drop_shorthands", "expand_margin_shorthand"):
        assert "REPARTITION_BY_NUM" in QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_lines_are_read_once_for_both_sides(spark, sf_dir):
    plan = matched(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_partkey") and sum("Relation" in line and "l_partkey" in line for line in plan.splitlines()) == 1


def test_changes_are_worked_out_once_and_counted_without_sorting(spark, sf_dir):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = diffing.by_match(diffing.diff(matched(spark, sf_dir).drop("tagName", "elementId", "className")))._jdf.queryExecution()
        assert plan.optimizedPlan().toString().count("array_union") == 2  # styles and attributes, once each
        assert plan.executedPlan().toString().count("SortAggregate") == 2  # of the lines
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_orders_are_not_joined_and_each_of_equal_ones_meets_each(spark, tmp_path):
    spark.createDataFrame([(7,), (7,), (8,), (None,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_extendedprice double"
    spark.createDataFrame([], lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    met = matched(spark, str(tmp_path))
    assert sorted(r.hpid for r in met.select("hpid").collect()) == ["1.8"] * 4 + ["1.9"]
    assert met._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # of lines and parts


def test_json_reports_are_parsed_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "a", "version": "3.0", "url": "http://a/", "timestamp": "2024-01-01T00:00:00Z", "totalElements": 1, "elements": [{"hpid": "1", "tagName": "p"}]}')
    found = read_reports(spark, str(tmp_path), fmt="json")
    assert "binaryFile" not in found.elements._jdf.queryExecution().optimizedPlan().toString() + found.elements._jdf.queryExecution().executedPlan().toString()
    assert [(r.report_id, r.hpid) for r in found.elements.collect()] == [("a", "1")]
