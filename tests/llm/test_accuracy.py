"""What trained and rule-based judgements are worth: held-out folds of given labels, and generated texts by kind."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import pii, quality, queries

LARGE, MIDDLE = "/root/testdata/sf0.1", "/root/testdata/sf0.01"


def test_toxicity_on_the_held_out_fold(spark):
    """At least: AUC 0.95, recall 0.8 and precision 0.9 at 0.5 (measured: see README)."""
    labels = dict(duckdb.sql(f"SELECT doc_id, max(toxic) FROM '{LARGE}/labels.parquet' WHERE toxic IS NOT NULL GROUP BY doc_id").fetchall())
    rows = [(r.score, r.predicted, labels[r.doc_id]) for r in queries.QUERIES["op3_toxicity"](spark, LARGE).filter("held_out").select("doc_id", "score", "predicted").collect() if r.doc_id in labels]
    score, predicted, toxic = (np.array(x) for x in zip(*rows, strict=True))
    good, bad = score[toxic == 0], score[toxic == 1]
    auc = ((bad[:, None] > good[None, :]).mean() + (bad[:, None] == good[None, :]).mean() / 2).item()
    recall, precision = (predicted[toxic == 1] == 1).mean(), (toxic[predicted == 1] == 1).mean()
    print(f"held-out rows {len(rows)}, toxic {len(bad)}, AUC {auc:.3f}, recall {recall:.3f}, precision {precision:.3f}")
    assert len(bad) > 50 and auc >= 0.95 and recall >= 0.8 and precision >= 0.9


def test_quality_keeps_good_and_drops_poor_held_out_rows(spark):
    """Trusted are the good rows of even ids; the others are judged."""
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    trusted = labels.filter("quality = 1 and doc_id % 2 = 0").select("doc_id")
    judged = quality.judge_quality(docs, trusted).join(labels.filter("quality = 0 or doc_id % 2 = 1").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id")
    kept = {r.quality: (r.kept, r.n) for r in judged.groupBy("quality").agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")).collect()}
    print(kept)
    assert kept[1][0] >= 0.97 * kept[1][1] and kept[0][0] <= 0.1 * kept[0][1]


def digits(r, n):
    return "".join(str(r.randint(0, 9)) for _ in range(n))


def luhn(r):
    body = digits(r, 15)
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(body)))
    return body + str(-total % 10)


def iban(r):
    bban = digits(r, 18)
    check = 98 - int(bban + "131400") % 97  # DE00 as digits
    return f"DE{check:02d}{bban}"


MADE = {
    "email": lambda r: ("write to {}", f"user{r.randint(1, 999)}.x@mail-{r.randint(1, 99)}.example.org"),
    "ip": lambda r: ("the host at {} answered", ".".join(str(r.randint(0, 255)) for _ in range(4))),
    "card": lambda r: ("paid by card {} today", luhn(r)),
    "phone": lambda r: ("call {} now", f"+{r.randint(1, 99)} {digits(r, 3)} {digits(r, 7)}"),
    "iban": lambda r: ("to the account {} please", iban(r)),
    "ssn": lambda r: ("social security number {} on file", f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"),
    "secret": lambda r: ("the api token {} must stay secret", "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") + r.choice("abcdefghjkmnpqrstuvwxyz") + r.choice("23456789") for _ in range(9))),
}
WORDS = "the a of report year people water market small green talk about when never often table 12 345 1999 3.5 10-20 +5 12:30".split()


@pytest.fixture(scope="module")
def found(spark):
    r, rows, planted = random.Random(9), [], {}
    filler = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    for i in range(350):
        kind = [*MADE][i % len(MADE)]
        frame, value = MADE[kind](r)
        begin = f"{filler(r.randint(0, 30))} é "
        rows.append((i, f"{begin}{frame.format(value)} {filler(r.randint(8, 30))}"))
        at = len(begin) + frame.index("{}")
        planted[i] = (kind, at, at + len(value))
    plain = [w for w in WORDS if w.isalpha()]  # numbers in a row may well be a card's or a telephone's
    rows += [(1000 + i, " ".join(f"{r.choice(plain)} {r.choice(WORDS)} {r.choice(plain)}" for _ in range(20))) for i in range(100)]
    return planted, {x.doc_id: x.spans for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("kind", MADE)
def test_recall_of_personal_data(found, kind):
    planted, spans = found
    own = {i: p for i, p in planted.items() if p[0] == kind}
    assert sum(p in [(s.kind, s.start, s.end) for s in spans[i]] for i, p in own.items()) >= 0.95 * len(own)
    assert all(0 < s.score <= 1 for i in own for s in spans[i])


def test_clean_texts_have_none(found):
    assert sum(bool(found[1][i]) for i in range(1000, 1100)) == 0
