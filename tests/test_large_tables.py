"""What larger tables would fill: the driver's memory by broadcasts, disks by files that nobody reads any more."""

import gzip
import os
import time

from pyspark.sql import functions as F

from sightline import compare
from sightline import config as C
from sightline.operators import selectors
from sightline.plans.queries import QUERIES
from sightline.plans.snapshots import base, edited
from sightline.shared import CLEANUP, passing, shared_dir, written
from sightline.sinks.reports import export_reports
from sightline.sources import html
from sightline.sources.reports import read_reports


def executed(frame):
    frame.collect()  # adaptive plans count too
    return frame._jdf.queryExecution().executedPlan().toString()


def shuffle_files(spark):
    blocks = spark._jsc.sc().env().blockManager().diskBlockManager()
    return {n for d in blocks.localDirs() for _, _, names in os.walk(d.getPath()) for n in names if n.startswith("shuffle_")}


def test_tree_broadcasts_no_table_and_works_changes_out_once(spark, sf_dir):
    plan = executed(QUERIES["report_tree"](spark, sf_dir))
    assert "Broadcast" not in plan and "lineitem" not in plan and "part.parquet" not in plan


def test_written_tables_leave_no_shuffle_files(spark):
    before, rows = shuffle_files(spark), spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    found = written(rows, "counts")
    assert sorted(r.n for r in found.collect()) == [142] + [143] * 6
    end = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < end:  # executors are told, not asked
        time.sleep(0.1)
    assert not left and spark.conf.get(CLEANUP, None) is None


def tables(spark):
    at = shared_dir(spark).removeprefix("file:")
    return set(os.listdir(at)) if os.path.isdir(at) else set()


def test_a_steps_tables_go_with_it_but_for_kept_ones(spark):
    before = tables(spark)
    with passing():
        with passing():
            first, second = written(spark.range(3), "first"), written(spark.range(4), "second", kept=True)
            assert (first.count(), second.count()) == (3, 4)
        assert {n.partition("-")[0] for n in tables(spark) - before} == {"second"} and second.count() == 4
        third = written(second, "third", kept=True)
    assert {n.partition("-")[0] for n in tables(spark) - before} == {"third"} and third.count() == 4


def test_a_comparison_leaves_only_what_it_returns(spark, sf_dir):
    before = tables(spark)
    done = compare.compare(base(spark, sf_dir).filter("pair_id < 2"), edited(spark, sf_dir).filter("pair_id < 2"), options=C.MatchOptions(alignment=False))
    assert sorted(n.partition("-")[0] for n in tables(spark) - before) == ["alone"] * 3 + ["diffs", "pairs"]
    assert done.matches.count() and done.summary().count() == done.matching().count() == 2


def test_packed_reports_are_read_like_plain_ones(spark, tmp_path, monkeypatch):
    names = [f"r {k}" for k in range(3)]
    told = spark.createDataFrame([(n, "3.0", "http://a/", "2024-01-01T00:00:00Z", 1) for n in names], "id string, version string, url string, timestamp string, totalElements long")
    elements = spark.createDataFrame([(n, 0, "1", "p", "é\n" * 900) for n in names], "report_id string, idx long, hpid string, tagName string, textContent string")
    for packed in (False, True):
        export_reports(told, elements, "json", f"{tmp_path}/{packed}", packed=packed)
    held = {p: [f for f in (tmp_path / str(p)).rglob("part-*")] for p in (False, True)}
    assert sum(f.stat().st_size for f in held[True]) * 3 < sum(f.stat().st_size for f in held[False])
    rows = {p: sorted(map(tuple, read_reports(spark, f"{tmp_path}/{p}", fmt="json").elements.select("report_id", "idx", "hpid", "tagName", "textContent").collect())) for p in (False, True)}
    assert rows[True] == rows[False] == [(n, 0, "1", "p", "é\n" * 900) for n in names]
    mixed = [tmp_path / name for name in ("a.json", "b.json.gz", "c.csv.gz", "d.json.gz", "e.json.gz")]
    content = '{"id": "%s", "version": "3.0", "url": "http://a/", "timestamp": "2024-01-01T00:00:00Z", "totalElements": 0, "title": "%s", "elements": []}'
    for path, data in zip(mixed, ((content % ("a", "")).encode(), gzip.compress((content % ("b", "")).encode()), gzip.compress(b"x"), gzip.compress(b"none"), gzip.compress((content % ("e", "x" * 9000)).encode())), strict=True):
        path.write_bytes(data)
    monkeypatch.setattr("sightline.sources.reports.MAX_BYTES", 5000)
    found = read_reports(spark, [str(p) for p in mixed])
    assert sorted(r.id for r in found.reports.collect()) == ["a", "b"]
    assert {r.path.rsplit("/", 1)[1]: r.error for r in found.refused.collect()} == {"c.csv.gz": "Unsupported format: use JSON, CSV, or Excel", "d.json.gz": "File could not be parsed", "e.json.gz": "File too large: 50 MB at most"}


def test_path_expressions_leave_two_tables_and_shuffle_owners_of_hits_only(spark, sf_dir, monkeypatch):
    before, made = tables(spark), {}
    monkeypatch.setattr(selectors, "written", lambda df, name, kept=False: made.setdefault(name, written(df, name, kept)))
    pages = spark.createDataFrame([(1, "<div><p>one two three</p><p>one <b>two th</b>ree</p><p>four one two three five</p></div>")], "page_id long, html string")
    found = selectors.generate(html.elements(pages, texts=True), "xpath")
    assert {n.partition("-")[0] for n in tables(spark) - before} == {"prepared", "best"} and found.count() == 5
    assert {"hits", "ups"} <= set(made) and set(made["hits"].columns) == {"page_id", "tree", "tag", "key", "pos", "last", "begins", "ends"}
