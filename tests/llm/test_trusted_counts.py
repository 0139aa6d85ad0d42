"""What the trusted multinomial is counted from."""

import numpy as np

from sightline.llm import quality


def test_all_trusted_rows_are_counted(spark):
    docs = spark.range(20_500).selectExpr("id as doc_id", "concat('word', id % 97, ' and word', id % 89) as text")
    assert np.abs(quality.log_ratios(docs, docs.select("doc_id"))).max() < 1e-12
