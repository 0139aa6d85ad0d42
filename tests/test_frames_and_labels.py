"""Frames of a page, and the labels of stored reports."""

from pyspark.sql import functions as F

from sightline.operators import storage
from sightline.sources import html


def test_frames_of_the_same_origin_come_behind(spark):
    pages = spark.createDataFrame([(1, "https://a.x/p", "<div><p>own</p></div>"), (2, "http://b/", "<i>1</i>"), (3, "http://c/", None)], "page_id long, url string, html string")
    frames = spark.createDataFrame([(1, 0, "https://a.x/p", "<b>itself</b>"), (1, 7, "https://A.x:443/q", "<u>7</u><s>8</s>"), (1, 3, "https://a.x/r?z", "<em>3</em>"), (1, 4, "http://a.x/r", "<q>other scheme</q>"), (2, 1, "about:blank", "<q>no</q>"), (3, 1, "http://c/f", "<a>only</a>")], "page_id long, frame_id long, frame_url string, html string")
    got = sorted((r.page_id, r.idx, r.tagName, r.frameId, r.frameUrl) for r in html.with_frames(pages, frames).collect())
    assert got == [
        (1, 0, "div", None, None), (1, 1, "p", None, None), (1, 2, "em", 3, "https://a.x/r?z"), (1, 3, "u", 7, "https://A.x:443/q"), (1, 4, "s", 7, "https://A.x:443/q"),
        (2, 0, "i", None, None), (3, 0, "a", 1, "http://c/f"),
    ]
    assert html.with_frames(pages, frames.filter("false")).count() == 3


def test_labels_of_reports(spark):
    rows = [
        ("n", "https://www.shop.example/cart/items/", "2024-01-03T11:00:00Z", 12, '{"class": "", "id": "top"}', "imported"), ("m", "https://stage.shop.example/", "2024-01-03T09:00:00Z", 3, None, "captured"),
        ("o", "https://shop.example/x", "2024-01-01T12:00:00Z", 5, "{}", None),
    ]
    reports = spark.createDataFrame(rows, "id string, url string, timestamp string, totalElements long, filters string, source string")
    now = F.lit("2024-01-03T12:00:00Z").cast("timestamp")
    got = {r.id: (r.label, r.tooltip) for r in storage.selector_labels(reports, now).collect()}
    assert got == {
        "n": ("[↑] R3 · PROD · shop.example/items", "R3 · https://www.shop.example/cart/items/ · 12 el · top · 1h ago"),
        "m": ("R2 · STAGE · stage.shop.example/", "R2 · https://stage.shop.example/ · 3 el · 3h ago"),
        "o": ("R1 · PROD · shop.example/x", "R1 · https://shop.example/x · 5 el · 2d ago"),
    }
    assert {r.label for r in storage.selector_labels(reports.filter("id = 'o'"), now).collect()} == {"R1 · shop.example/x"}
