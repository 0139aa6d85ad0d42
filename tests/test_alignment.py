"""Sequence alignment in blocks against a plain two-cursor walk over whole lists."""

import random

import pytest

from sightline import config as C
from sightline.operators import matching
from sightline.sources import html

ROW = "pair_id long, idx long, hpid string, tagName string"


def plain(base, other, look=5, confidence=0.99):
    """base, other: (idx, path, tag). The walk as it is described, element by element."""
    num = lambda h: tuple(int(s) if s.isdigit() else s for s in h.split(".")) if h else ()
    left, right = ([(num(h), t, i) for i, h, t in sorted(d)] for d in (base, other))
    out, b, c = [], 0, 0

    def ahead(rows, at, x):
        return next((k for k in range(at + 1, min(at + look, len(rows) - 1) + 1) if rows[k][:2] == x[:2]), None)

    while b < len(left) and c < len(right):
        x, y = left[b], right[c]
        if x[0] == y[0]:
            out += [(x[2], y[2], "match", "sequence-hpid", confidence)] if x[1] == y[1] else [(x[2], None, "removed", None, None), (None, y[2], "added", None, None)]
            b, c = b + 1, c + 1
        elif (k := ahead(right, c, x)) is not None:
            out += [(None, r[2], "added", None, None) for r in right[c:k]] + [(x[2], right[k][2], "match", "sequence-resync-add", confidence - 0.05)]
            b, c = b + 1, k + 1
        elif (k := ahead(left, b, y)) is not None:
            out += [(r[2], None, "removed", None, None) for r in left[b:k]] + [(left[k][2], y[2], "match", "sequence-resync-remove", confidence - 0.05)]
            b, c = k + 1, c + 1
        else:
            out.append((x[2], y[2], "orphan", None, None))
            b, c = b + 1, c + 1
    return out + [(r[2], None, "removed", None, None) for r in left[b:]] + [(None, r[2], "added", None, None) for r in right[c:]]


def edited(r, rows, rate):
    out = []
    for h, t in rows:
        x = r.random()
        if x < rate:
            continue
        if x < 2 * rate:
            out += [(f"9.{r.randrange(10**6)}", "b") for _ in range(r.randint(1, 8))]
        out.append((h, "i" if x > 1 - rate else t))
    return out


def number(rows):
    return [(i * 3, h, t) for i, (h, t) in enumerate(rows)]


def check(spark, pairs):
    sides = [[(p, *row) for p, pair in pairs.items() for row in pair[side]] for side in (0, 1)]
    got = matching.align(*[spark.createDataFrame(s, ROW) for s in sides]).toPandas()
    for p, (b, c) in pairs.items():
        own = got[got.pair_id == p]
        found = own[["b_idx", "c_idx", "outcome", "strategy", "confidence"]].astype(object)
        found = found.where(found.notna(), None).itertuples(index=False, name=None)
        rows = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (*map(lambda i: None if i is None else int(i), row[:2]), *row[2:])) for row in found), key=str)
        assert rows == sorted(((*row[:4], None if row[4] is None else round(row[4], 6)) for row in plain(b, c)), key=str), p


@pytest.mark.parametrize("block", [7, 20_000])
def test_random_sequences(spark, monkeypatch, block):
    monkeypatch.setattr(matching, "BLOCK", block)
    r, pairs = random.Random(block), {}
    for p in range(40):
        rows = [(f"1.{r.randint(0, 1) * '0'}{i}", r.choice("ab")) for i in range(r.randint(0, 60))]
        pairs[p] = number(rows), number(edited(r, [(h.replace(".0", ".") if h != "1.0" else h, t) for h, t in rows], r.choice((0, 0.05, 0.3))))
    pairs[100] = number([("1", "a")] * 9 + [("", "a"), (None, None)]), number([("1", "a")] * 4 + [("", "a")])
    pairs[101] = [], number([("1", "a")])
    check(spark, {p: (b, c) for p, (b, c) in pairs.items() if all(x[1] is not None for x in [*b, *c])})


def test_a_hundred_thousand_elements(spark):
    r = random.Random(1)
    rows = [(f"1.{i}", r.choice("abc")) for i in range(100_000)]
    check(spark, {1: (number(rows), number(edited(r, rows, 0.01))), 2: (number(rows), number([("7.7", "x")] * 30 + rows))})


def test_no_element_is_cut_off(spark):
    """12,000 elements of which the last one differs; what extraction leaves out is told."""
    rows = [(1, i, f"1.{i}", "p") for i in range(12_000)]
    other = [*rows[:-1], (1, 11_999, "1.99999", "b")]
    as_elements = lambda d: spark.createDataFrame(d, ROW).selectExpr("*", "cast(null as string) elementId", "cast(null as string) className", "cast(map() as map<string,string>) styles", "cast(map() as map<string,string>) attributes", "cast(null as string) textContent")
    found = matching.match(as_elements(rows), as_elements(other), C.MatchOptions(orphan_recovery=True))
    assert found["matches"].count() == 11_999 and [x.idx for x in found["removed"].collect()] == [11_999] == [x.idx for x in found["added"].collect()]
    kept, over = html.limited(spark.createDataFrame(rows, "page_id long, idx long, hpid string, tagName string"), 10_000)
    assert kept.count() == 10_000 and [tuple(x) for x in over.collect()] == [(1, 12_000, 2_000)]
