"""Each query against a brute-force version of its contract, on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import pytest
import xxhash

from sightline.llm import queries
from sightline.llm.sentencepiece_scan import decode, encode

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(sf_dir):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()


def rows(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).collect()


def test_url_filter(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    got = sorted(tuple(r) for r in rows(spark, sf_dir, "op5_url_filter"))
    assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in sorted(con.execute(queries.ORACLE_SQL["op5_url_filter"]).fetchall())]


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, sf_dir, documents):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in rows(spark, sf_dir, "op6_quality")}
    assert len(got) == len(documents)
    for i, text in documents:
        want = quality(text)
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert got[i][:5] == want and got[i][5] == failed and not (failed and got[i][6])


def fingerprint(text):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = WORD.findall((text or "").translate(table))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, sf_dir, documents):
    fps = {i: fingerprint(t) for i, t in documents}
    ids, root = sorted(fps), {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, sf_dir, "op8_simhash")}
    assert got == {i: (f"{fps[i]:016x}", find(i)) for i in ids}


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def pii(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m[0])]


def test_pii_base(spark, sf_dir, documents):
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op9_pii")}
    for i, text in documents:
        want = pii(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(x[0] == k for x in want) for k in BASE]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(got[i].spans.split(","))


def test_sharding(spark, sf_dir, documents):
    got = rows(spark, sf_dir, "op10_sharding")
    texts = {i: (t or "").encode() for i, t in documents}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    load, slots = Counter(), {}
    for r in got:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= max(len(t) for t in texts.values()) + 1


def test_sentencepiece_equals_the_library(spark, sf_dir, documents):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    docs = spark.createDataFrame(documents, "doc_id long, text string")
    found = {}
    for r in encode(docs, chunk=512).collect():
        found.setdefault(r.doc_id, []).append((r.chunk, r.ids))
    for i, text in documents:
        ids = [x for _, part in sorted(found[i]) for x in part]
        assert ids == (model.encode(text.replace("▁", " ")) if text else []), i


def test_sentencepiece_round_trip(spark, sf_dir, documents):
    got = {}
    for r in decode(encode(spark.createDataFrame(documents, "doc_id long, text string"), chunk=777)).collect():
        got.setdefault(r.doc_id, []).append((r.chunk, r.decoded))
    assert {i: "".join(t for _, t in sorted(parts)) for i, parts in got.items()} == {i: (t or "").replace("▁", " ") for i, t in documents}


def test_toxicity_columns(spark, sf_dir, documents):
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op3_toxicity")}
    assert sorted(got) == sorted(i for i, _ in documents)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
