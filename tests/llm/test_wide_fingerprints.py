"""The near-duplicate stage finds its pairs by SimHash and pivot distances; shingle sets only confirm them."""

import numpy as np

from sightline.llm import simhash


def sets_at(similarity, n, rng, size=600):
    """Pairs of sets of hashes of this Jaccard similarity."""
    shared = round(2 * size * similarity / (1 + similarity))
    for _ in range(n):
        drawn = rng.integers(0, 1 << 64, 2 * size - shared, dtype=np.uint64)
        yield drawn[:size], np.concatenate([drawn[:shared], drawn[size:]])


def test_sets_of_similarity_08_meet_and_stay(spark):
    rng = np.random.default_rng(4)
    fps = np.array([simhash.wide_fingerprint(x) for pair in sets_at(0.8, 400, rng) for x in pair])
    rows = [(i, fp.tobytes(), d.tobytes()) for i, (fp, d) in enumerate(zip(fps, simhash.wide_distances(fps), strict=True))]
    found = {(r.u, r.v) for r in simhash.wide_links(spark.createDataFrame(rows, "node long, fp binary, distances binary"), len(rows)).collect()}
    pairs = {frozenset(p) for p in found}
    assert sum(frozenset((2 * i, 2 * i + 1)) in pairs for i in range(400)) >= 396
    assert all(min(p) // 2 == max(p) // 2 for p in pairs)


def test_nothing_is_compared_that_fingerprints_do_not_link(spark, monkeypatch):
    text = " ".join(f"word{i}" for i in range(300))
    docs = spark.createDataFrame([(1, text), (2, text + " more")], "doc_id long, text string")
    assert simhash.drop_near_duplicates(docs).count() == 1
    monkeypatch.setattr(simhash, "wide_links", lambda nodes, n, block_rows: spark.createDataFrame([], "u long, v long"))
    assert simhash.drop_near_duplicates(docs).count() == 2
