"""Registered queries against their SQL in DuckDB."""

import duckdb
import pytest

from sightline.plans.oracles import ORACLE_SQL
from sightline.plans.queries import QUERIES

TABLES = "part orders lineitem events pages".split()
#: Rows-only queries: order-dependent walks, and trees of pages. test_selectors_plain.py holds selectors of all pages against a plain evaluator,
#: test_pages_plain.py the others against plain walks of the trees.
NO_SQL = {"selector_unique", "selector_xpath", "element_neighbours", "match_sequence_align", "match_position_grid", "match_all_passes", "apex_suppression", "content_intelligence", "extract_elements", "section_detection", "child_tag_histogram"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLE_SQL) == NO_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want
