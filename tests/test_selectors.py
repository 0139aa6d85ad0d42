"""Selectors of elements, filters, neighbours and screens on small tables."""

import pytest
from pyspark.sql import functions as F

from sightline.functions import css, url
from sightline.functions import text as T
from sightline.operators import selectors, visual
from sightline.sources import html

PAGE = """<html><body><div id=menu class="bar wide"><a href="/a">A</a><a href="/b" data-testid=go>B</a><p>one<p>one</div>
<div class="bar"><input type=text name=q disabled><span>Only text here</span><p>three</p><ul id="12"><li>x<li>x</ul></div></body></html>"""


@pytest.fixture(scope="module")
def rows(spark):
    return html.elements(spark.createDataFrame([("p", PAGE)], "page_id string, html string"), texts=True).persist()


def test_css_selectors(rows):
    by = {r.idx: r.hpid for r in rows.collect()}
    got = {by[r.idx]: (r.selector, r.tier, r.scoped) for r in selectors.generate(rows, "css").collect()}
    assert len({s for s, _, _ in got.values()}) == len(by)  # each fits one element
    assert got["1.1.1"] == ("div#menu", 1, False)
    assert got["1.1.1.2"] == ('a[data-testid="go"]', 2, False)
    assert got["1.1.1.1"] == ('a[href="\\/a"]', 10, False)
    assert got["1.1.2.1"] == ('input[type="text"][name="q"]', 4, False)
    assert got["1.1.2.2"] == ("span:nth-child(2)", 11, False)
    assert got["1.1.1.3"] == ("#menu p:nth-child(3)", 11, True)
    assert got["1.1.2.4.2"][0] == "li:nth-child(2)"


def test_xpath_selectors(rows):
    by = {r.idx: r.hpid for r in rows.collect()}
    got = {by[r.idx]: r.selector for r in selectors.generate(rows, "xpath").collect()}
    assert len(set(got.values())) == len(by)
    assert got["1.1.2.2"] == "//span[text()='Only text here']" and got["1.1.1.2"] == "//a[@data-testid='go']"
    assert got["1.1.2.4.2"] == "(//div[@class='bar']//li)[2]" and got["1.1.1.3"] == "(//div[@id='menu']//p[text()='one'])[1]"


def test_filters_number_their_roots_anew(rows):
    got = {(r.hpid, r.absoluteHpid, r.tagName) for r in html.filtered(rows, {"class": "bar wide", "tag": "ul"}).collect()}
    assert ("1", "1", "div") in got and ("1.3", "1.3", "p") in got and ("2", "2.4", "ul") in got and ("2.2", "2.4.2", "li") in got and len(got) == 8


def test_neighbours_and_ordinals(rows):
    near = {r.hpid: r for r in html.neighbours(rows).collect()}
    assert near["1.1.1"].childrenTypes == ["a(2)", "p(2)"] and near["1.1.2.2"].previousSibling == "input" and near["1.1.1.1"].parent == "div#menu.bar.wide"
    place = {r.hpid: (r.nth, r.nth_of_type, r.of_type) for r in html.sibling_ordinals(rows).collect()}
    assert place["1.1.1.4"] == (4, 2, 2)
    up = {r.hpid: r for r in html.class_hierarchy(rows).collect()}
    assert [c.classes for c in up["1.1.2.4.1"].parentClasses] == [["bar"]]


def test_screens(spark):
    elements = spark.createDataFrame([(1, 0, "1.1", 10.0, 50.0), (1, 1, "1.2", 100.0, 50.0), (1, 2, "2.1", 300.0, 900.0), (1, 3, "2.2", 1300.0, 50.0)], "pair_id long, idx int, hpid string, document_y double, height double")
    assert [(r.keyframe_id, r.scroll_y, r.element_ids) for r in visual.keyframes(elements, 600, 2000).orderBy("keyframe_id").collect()] == [("kf_0", 0, ["1.1", "1.2"]), ("kf_1", 260, ["2.1"]), ("kf_2", 1260, ["2.2"])]


def test_small_functions(spark):
    df = spark.createDataFrame([("1a", "0.125px", "http://a/x?p=1&p=1&q=2#h", "http://b/X/?p=1&z=9&utm_a=1")], "s string, v string, a string, b string")
    row = df.select(T.css_identifier(F.col("s")).alias("i"), css.normalize_unit(F.col("v")).alias("v"), css.normalize_unit(F.lit("1.015px")).alias("w"), css.normalize_unit(F.lit("-1.005px")).alias("n"), url.assess(F.col("a"), F.col("b")).alias("u"), url.same_origin(F.lit("http://a/"), F.lit("http://A:80/x")).alias("o")).first()
    assert (row.i, row.v, row.w, row.n, row.o) == ("\\31 a", "0.13px", "1.01px", "-1.00px", True)
    assert row.u.classification == "CAUTION" and [tuple(q) for q in row.u.query] == [("p", "1", None), ("q", "2", None), ("z", None, "9")] and row.u.hash.baseline == "#h"
