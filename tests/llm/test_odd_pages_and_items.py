"""Markup that is broken or large, and items with ids of other types."""

import time

import pytest

from sightline.llm import decontam, html_extract
from sightline.llm.html_tree import parse


@pytest.mark.parametrize("page", ["<script>" + "</script " * 110_000, "<title>" * 140_000, "<p " * 330_000, "<!--" * 250_000, "<style>" + "</style\n" * 120_000, "<a href='" * 110_000, "</" * 500_000, "<svg>" * 200_000])
def test_a_megabyte_of_bad_markup_is_parsed_in_no_time(page):
    began = time.perf_counter()
    parse(page)
    assert time.perf_counter() - began < 5


def test_unclosed_title_and_script_end_at_the_next_tag(spark):
    body = "<p>Some long prose of the article, told at length so that it counts. It goes on.</p><{}>unclosed<p>More prose after it, of a fair length as well, to be kept whole.</p>"
    pages = [(i, f"<html><body><article><h1>A title</h1>{body.format(t)}</article></body></html>") for i, t in enumerate(("title", "script", "style"))]
    for r in html_extract.extract_text(spark.createDataFrame(pages, "page_id long, html string")).collect():
        assert r.main_text.endswith("It goes on.\n\nMore prose after it, of a fair length as well, to be kept whole.")


def test_items_with_ids_of_any_type(spark):
    docs = spark.createDataFrame([("d", "here stands a passage of the test that must be found, more or less as it is")], "doc_id string, text string")
    items = spark.createDataFrame([("q-1", "a passage of the test that must be found"), (None, "a pasage of the test that must be fond"), ("q-2", "something else altogether, not in there")], "item_id string, text string")
    assert {(r.item_id, r.edits) for r in decontam.find_items(docs, items).collect()} == {("q-1", 0), (None, 2)}
