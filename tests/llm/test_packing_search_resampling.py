"""Packing, ranked search and resampling: against brute force or SQL on the smallest tables, and on odd input."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sightline.llm import lexical, packing, queries, resampling

ODD = [(1, None), (2, ""), (3, "  \n "), (4, "same words twice, same words"), (4, "same words twice, same words"), (5, "a <|endoftext|> b é😀 ÉÀ Straße"), (None, "Same WORDS of a row without id"), (6, "long text " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.withColumns({c: F.lit(1) for c in ("id", "row", "term", "score", "rank", "length", "block", "bucket", "pos", "query", "start")})


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op12_lexical_search", "op13_resampling"])
def test_equal_to_sql(name, spark, sf_dir, duck):
    df = queries.QUERIES[name](spark, sf_dir)
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda rows: sorted(rows, key=str)
    assert key(tuple(r) for r in df.select(*columns).collect()) == key(found.fetchall())


def check_packing(rows, texts):
    """texts: (id, text) of every row of the input. Returns the share of padding."""
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in texts:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for start in range(0, len(ids), packing.SIZE):
            cut = ids[start : start + packing.SIZE]
            want[i, start, len(cut), zlib.crc32(cut.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    return 1 - sum(r.length for r in rows) / (packing.SIZE * len(held))


def test_packing(spark, sf_dir, duck):
    texts = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    assert check_packing(packing.pack(docs).collect(), texts) < 0.05
    assert check_packing(queries.QUERIES["op11_packing"](spark, sf_dir).collect(), texts) < 0.05


def test_packing_of_odd_input(spark, odd):
    check_packing(packing.pack(odd).collect(), ODD)
    assert packing.pack(odd.filter("false")).count() == 0


def test_patterns_do_not_grow_with_the_counts():
    r = random.Random(2)
    few = {n: r.randint(0, 9) for n in range(1, 1025)}
    for times in (1, 10**9):
        patterns = packing.shortest_pack_first({n: c * times for n, c in few.items()})
        assert len(patterns) <= 2 * 1024 and all(sum(p) <= 1024 for p, _ in patterns)
        placed = Counter()
        for p, packs in patterns:
            for n in p:
                placed[n] += packs
        assert placed == Counter({n: c * times for n, c in few.items() if c})


def brute_search(docs, items, k):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tf = [(i, Counter(word.findall((t or "").translate(low)))) for i, t in docs]
    tf = [(i, c, sum(c.values())) for i, c in tf if c]
    n_docs, n_words = len(tf), sum(n for _, _, n in tf)
    df = Counter(t for _, c, _ in tf for t in c)
    out = []
    for item, text in items:
        asked = set(word.findall((text or "").translate(low)))
        scores = []
        for i, c, n in tf:
            m = 50 + 50 * n * n_docs // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"max_terms": 7, "max_pairs": 5}])
def test_search_of_odd_input(spark, odd, limits):
    """With the smallest limits the terms take several passes and the queries several blocks."""
    items = [("x", "Same words, and others of a text"), ("y", None), ("z", ""), ("é", "É straße twice b 😀"), (None, "long row without same")]
    got = lexical.search(odd, spark.createDataFrame(items, "item_id string, text string"), 3, **limits)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(ODD, items, 3)
    assert lexical.search(odd.filter("false"), spark.createDataFrame(items, "item_id string, text string")).count() == 0
    assert lexical.search(odd, spark.createDataFrame([], "item_id string, text string")).count() == 0


def test_search_with_ties_and_dropped_partial_scores(spark, monkeypatch):
    """Many equal scores, and tasks that drop partial scores as they go."""
    r = random.Random(4)
    monkeypatch.setattr(lexical, "GATHERED", 50)
    docs = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))) for i in range(600)]
    items = [(j, " ".join(r.choice("abcdefghz") for _ in range(3))) for j in range(12)]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 20)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_search(docs, items, 20)


def brute_weights(docs, target, orders, n_buckets):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return [zlib.crc32(" ".join(words[i : i + n]).encode()) % n_buckets for n in range(1, orders + 1) for i in range(len(words) - n + 1)], len(words)

    s, t = (Counter(b for _, text in rows for b in features(text)[0]) for rows in (docs, target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + n_buckets) / ((s[b] + 1) * (t.total() + n_buckets))))
    out = []
    for i, text in docs:
        own, n = features(text)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(own), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    return sorted(out, key=str)


@pytest.mark.parametrize("orders", [1, 3])
def test_resampling_of_odd_input(spark, odd, orders):
    target = [("x", "same words of a target"), ("y", None), ("z", "")]
    items = spark.createDataFrame(target, "item_id string, text string")
    rows = resampling.resample(odd, items, percent=50, min_words=2, max_order=orders, n_buckets=97).collect()
    want = brute_weights(ODD, target, orders, 97)
    assert sorted(((r.doc_id, r.n_features, r.n_words, r.weight, r.score) for r in rows), key=str) == want
    able = sorted((-s, i is not None, i or 0) for i, _, n, _, s in want if n >= 2)
    drawn = sorted((r.rank, -r.score, r.doc_id is not None, r.doc_id or 0) for r in rows if r.rank)
    assert drawn == [(k, *x) for k, x in enumerate(able[: len(able) // 2], 1)]
    assert resampling.resample(odd.filter("false"), items).count() == 0
    assert resampling.resample(odd, items.filter("false")).count() == len(ODD)
