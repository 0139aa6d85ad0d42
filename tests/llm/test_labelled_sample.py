"""The sample that the toxicity classifier is fitted on."""

import pytest

from sightline.llm import toxicity


def test_labelled_sample_keeps_the_share_of_classes(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang")
    labels = spark.range(6000).selectExpr("id as doc_id", "cast(id % 10 = 0 as int) as toxic")
    got = toxicity.labelled_rows(docs, labels, "doc_id", "text", "lang", "toxic", rows=1000)
    assert len(got) == 1000
    assert got["toxic"].mean() == pytest.approx(0.1, abs=0.03)
