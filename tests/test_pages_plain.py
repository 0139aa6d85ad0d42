"""Queries over page trees against plain walks of the same trees."""

import duckdb
import plain_selectors as plain
import pytest

from sightline.plans.queries import QUERIES


@pytest.fixture(scope="module")
def pages(sf_dir):
    return {i: plain.Page(h) for i, h in duckdb.sql(f"SELECT page_id, html FROM '{sf_dir}/pages.parquet'").fetchall()}


def label(r):
    named = f"#{r['attributes']['id']}" if r["attributes"].get("id") else ""
    classes = r["attributes"].get("class", "").split()[:3]
    return r["tagName"] + named + "".join(f".{c}" for c in classes)


def test_neighbours_and_child_tags(spark, sf_dir, pages):
    got = {(r.page_id, r.idx): r for r in QUERIES["element_neighbours"](spark, sf_dir).collect()}
    for i, page in pages.items():
        for r in page.rows:
            own = got.pop((i, r["idx"]))
            beside = r["up"]["kids"] if r["up"] else [x for x in page.rows if x["up"] is None and x["tree"] == r["tree"]]
            k = beside.index(r)
            want = [label(r["up"]) if r["up"] else None, label(beside[k - 1]) if k else None, label(beside[k + 1]) if k + 1 < len(beside) else None]
            assert [own.parent, own.previousSibling, own.nextSibling] == want
            tags = list(dict.fromkeys(x["tagName"] for x in r["kids"]))
            counted = [t + (f"({n})" if (n := sum(x["tagName"] == t for x in r["kids"])) > 1 else "") for t in tags[:10]]
            assert own.childrenCount == len(r["kids"]) and (own.childrenTypes or []) == counted
    assert not got


def test_sections(spark, sf_dir, pages):
    import re

    def own(r):
        tag, role, named = r["tagName"], r["attributes"].get("role", ""), f"{r['attributes'].get('class', '')} {r['attributes'].get('id', '')}"
        said = lambda words: re.search(rf"(?i)(^|[^a-z])({words})([^a-z]|$)", named)
        if tag in ("html", "body"):
            return None
        for section, t, a in (("header", "header", "banner"), ("main", "main", "main"), ("footer", "footer", "contentinfo"), ("header", "nav", "navigation"), ("main", "aside", "complementary")):
            if tag == t or role == a:
                return section
        return "header" if said("header|top|navbar|masthead") else "footer" if said("footer|bottom|copyright") else None

    got = {(r.page_id, r.idx): r.section for r in QUERIES["section_detection"](spark, sf_dir).collect()}
    for i, page in pages.items():
        for r in page.rows:
            assert got.pop((i, r["idx"])) == next((s for x in [r, *page.above(r)] if (s := own(x))), "unknown")
    assert not got
