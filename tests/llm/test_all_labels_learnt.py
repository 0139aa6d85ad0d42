"""The toxicity classifier learns from every labelled row, over several parts."""

import numpy as np

from sightline.llm import toxicity


def tables(spark, n):
    docs = spark.range(n).selectExpr("id as doc_id", "concat('text ', id, if(id % 10 = 0, ' vile slur', ' kind word')) as text", "'en' as lang")
    return docs, spark.range(n).selectExpr("id as doc_id", "cast(id % 10 = 0 as int) as toxic")


def test_every_labelled_row_is_hashed_whatever_its_length(spark):
    docs, labels = tables(spark, 14_000)
    docs = docs.selectExpr("doc_id", "if(doc_id = 1, repeat('a b ', 60000), text) as text", "lang")
    rows = toxicity.hashed_rows(docs, labels, "doc_id", "text", "lang", "toxic", part_words=10_000)
    wanted = labels.filter(toxicity.fold("doc_id") != 0)
    assert rows.count() == wanted.count() > 10_000
    assert rows.selectExpr("max(length(ids))").first()[0] == 4 * (120_000 + max(toxicity.WIDTHS) - 1)


def test_parts_learn_one_model_and_their_order_does_not_matter(spark):
    docs, labels = tables(spark, 3_000)
    rows = toxicity.hashed_rows(docs, labels, "doc_id", "text", "lang", "toxic", part_words=1_500)
    assert rows.select("part").distinct().count() > 3
    network, thresholds = toxicity.fitted(rows)
    again, _ = toxicity.fitted(rows)
    assert all(np.array_equal(network.p[k], again.p[k]) for k in network.p)
    hasher = toxicity.Hasher()
    vile, kind = network.scores([hasher("text 5 vile slur"), hasher("text 5 kind word")])
    assert vile > 0.5 > kind and set(thresholds) == {"en"}


def test_peaks_of_slabs_are_those_of_the_whole_text(monkeypatch):
    network, ids = toxicity.Network(), np.random.default_rng(3).integers(0, toxicity.BUCKETS, (1000, 2)).astype(np.int32)
    whole = network._peaks(ids)
    monkeypatch.setattr(toxicity, "SLAB", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, network._peaks(ids), strict=True))
