"""Context words around lists of matches."""

from sightline.llm import pii

LISTS = [
    ("ssn", "SSN: 123-45-6789, 223-45-6789, 323-45-6789", 3),
    ("ssn", "123-45-6789, 223-45-6789 (social security numbers)", 2),
    ("ssn", "SSN 000-45-6789, 223-45-6789", 1),
    ("ssn", "SSN " + "x" * 41 + " 123-45-6789, 223-45-6789", 0),
    ("secret", "tokens: A1b2C3d4E5f6G7h8I9j0K1l2, B1b2C3d4E5f6G7h8I9j0K1l2", 2),
]


def test_context_reaches_past_neighbouring_matches(spark):
    rows = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(LISTS)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find_pii(rows).collect()}
    assert [sum(s.kind == kind for s in spans[i]) for i, (kind, _, _) in enumerate(LISTS)] == [n for _, _, n in LISTS]
    texts = {r.doc_id: r.text for r in pii.redact_pii(rows).collect()}
    assert [texts[i].count(f"[{kind.upper()}]") for i, (kind, _, _) in enumerate(LISTS)] == [n for _, _, n in LISTS]
