"""What keeps the toxicity classifier cheap: runs of words looked up whole, changes fetched as columns."""

import numpy as np

from sightline.llm import toxicity

ODD = [None, "", " \t\n", "Same same, SAME.", "a-b_c  d e f\x1cg\x85h", "ΟΔΟΣ ΣΑΣ İstanbul", "..., !?", "x" * 5000, "ä," * 300, "\ud800 lone", "汉字、汉字"]


def test_runs_between_white_space_have_the_buckets_of_their_words():
    hasher, pad = toxicity.Hasher(), [(0, 0)] * (max(toxicity.WIDTHS) - 1)
    for text in [*ODD, *ODD]:
        words = toxicity._WORD.findall((text or "").lower())
        plain = [(toxicity._bucket(w), toxicity._bucket(w[: toxicity.PREFIX] + "~")) for w in words]
        assert hasher(text).tolist() == [list(x) for x in plain + pad]
    assert "same," in hasher.known and max(map(len, hasher.known)) <= toxicity.RUN


def test_a_step_of_adam_is_the_plain_one_and_in_place():
    rng = np.random.default_rng(1)
    x, g, first, second = (rng.normal(0, 1, (9000, 8)).astype(np.float32) for _ in range(4))
    second **= 2
    a, b = first + 0.1 * (g - first), second + 0.01 * (g * g - second)
    plain = x - 0.002 * (a / (1 - 0.9**3)) / (np.sqrt(b / (1 - 0.99**3)) + 1e-6)
    toxicity._adam(x, g, first, second, 3, 0.002)
    assert np.array_equal(x, plain) and np.array_equal(first, a) and np.array_equal(second, b)


def test_changes_come_to_the_driver_as_columns(spark, monkeypatch):
    docs = spark.range(200).selectExpr("id as doc_id", "if(id % 4 = 0, 'vile slur', 'kind word') as text", "'en' as lang")
    labels = spark.range(200).selectExpr("id as doc_id", "cast(id % 4 = 0 as int) as toxic")
    rows = toxicity.hashed_rows(docs, labels, "doc_id", "text", "lang", "toxic")
    monkeypatch.setattr(type(rows), "toPandas", None)  # a Python object for each value: beyond the driver's memory on check_h
    network, _ = toxicity.fitted(rows)
    vile, kind = network.scores([toxicity.Hasher()("vile slur"), toxicity.Hasher()("kind word")])
    assert vile > kind
