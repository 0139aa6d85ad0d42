"""Pages are parsed once, and handed on in batches."""

from sightline.plans.queries import QUERIES
from sightline.sources import html

PAGES = [(3, "<div id=a class='x y'><p>one<p>two</div>"), (None, "<b title='é'>b</b>"), (5, None), (6, ""), (7, "no tag"), (8, "<div><template shadowrootmode=open><i>s</i></template></div>")]


def test_neighbours_do_not_parse_pages_again(spark, sf_dir):
    assert "MapIn" not in QUERIES["element_neighbours"](spark, sf_dir)._jdf.queryExecution().toString()


def test_batches_of_pages_do_not_change_elements(spark, monkeypatch):
    pages = spark.createDataFrame(PAGES, "page_id long, html string").coalesce(1)
    whole = {trees: html.elements(pages, trees=trees).collect() for trees in (False, True)}
    monkeypatch.setattr(html, "BATCH_CHARS", 1)
    assert all(html.elements(pages, trees=trees).collect() == rows for trees, rows in whole.items())
    assert [(r.page_id, r.hpid, r.tagName, r.tree, r.last) for r in whole[True]] == [(3, "1", "div", "", 2), (3, "1.1", "p", "", 1), (3, "1.2", "p", "", 2), (None, "1", "b", "", 0), (8, "1", "div", "", 1), (8, "1.0.1", "i", "1.0", 1)]
    assert whole[False][0].attributes == {"id": "a", "class": "x y"} and whole[False][3].attributes == {"title": "é"}
    texts = html.elements(pages, texts=True).collect()
    assert [r[: len(whole[True][0])] for r in texts] == [tuple(r) for r in whole[True]] and texts[1].words[0].owners[0].hpid == "1.1"


def test_css_selectors_ask_for_no_texts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr("sightline.operators.selectors.generate", lambda rows, kind: rows)
    assert {"texts", "subtree", "words"}.isdisjoint(QUERIES["selector_unique"](spark, sf_dir).columns)
    assert {"texts", "subtree", "words"} <= set(QUERIES["selector_xpath"](spark, sf_dir).columns)


def test_neighbours_are_not_gathered_at_the_driver(spark, sf_dir):
    found = QUERIES["element_neighbours"](spark, sf_dir)
    found.collect()  # adaptive plans count too
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 2
