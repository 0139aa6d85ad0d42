"""The near-duplicate stage: what it drops and what it keeps."""

import random

import numpy as np

from sightline.llm import simhash


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(n))


def test_unlike_texts_of_one_id_or_of_none_stay(spark):
    r = random.Random(1)
    texts = [prose(r, 60) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[4]), (2, texts[5]), (3, texts[5]), (2, texts[5])]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, texts[0]), (1, texts[1]), (0, texts[2]), (0, texts[3]), (0, texts[4]), (2, texts[5])])


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similarity(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def edited_pairs(r, n, edits):
    """Pairs of a text and its copy with so many words changed at random places."""
    out = []
    for _ in range(n):
        words = prose(r, 240).split()
        copy = list(words)
        for at in r.sample(range(240), edits):
            copy[at] = "changed" + str(r.random())
        out.append((" ".join(words), " ".join(copy)))
    return out


def test_near_copies_from_similarity_08_on_go_and_others_stay(spark):
    r = random.Random(2)
    pairs = [p for edits in range(1, 13) for p in edited_pairs(r, 40, edits)]
    rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    kept = {row.doc_id for row in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert all(2 * i in kept for i in range(len(pairs)))
    bands = {low: [2 * i + 1 not in kept for i, p in enumerate(pairs) if low <= similarity(*p) < high] for low, high in ((0.5, 0.8), (0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1))}
    print({low: (sum(gone), len(gone)) for low, gone in bands.items()})
    assert all(len(gone) >= 30 for gone in bands.values())
    assert not any(bands.pop(0.5))
    assert all(np.mean(gone) >= 0.97 for gone in bands.values())
