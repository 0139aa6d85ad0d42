"""Methods on small fixtures, and the defined results of odd input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sightline.llm import chat, decontam, html_extract, pii, quality, sentencepiece_scan, sharding, simhash, toxicity, url_filter

LONG = "word other things here " * 4000
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "same text of a few words that occurs twice"), (4, "same text of a few words that occurs twice"), (5, LONG), (None, "a row without id, still whole"), (6, "é😀 ünïcode ▁ mark")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, repeated and very long texts, and columns whose names clash with the operators' own."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.withColumns({"lang": F.lit(None).cast("string"), "id": F.lit("x"), "fp": F.lit(1), "spans": F.lit(2), "score": F.lit(3), "n": F.lit(4), "bucket": F.lit(5), "marked": F.lit(6), "count": F.lit(7), "size": F.lit(8)})


def empty(df):
    return df.filter("false")


OPERATORS = {
    "decontam": lambda s, d: decontam.find_items(d, s.createDataFrame([(1, "same text of a few words that occurs twice"), (2, None), (3, "")], "item_id long, text string")),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, s.createDataFrame([(4, 1), (5, 0), (1, None)], "doc_id long, toxic int")),
    "sentencepiece": lambda s, d: sentencepiece_scan.encode(d),
    "quality": lambda s, d: quality.judge_quality(d, s.createDataFrame([(4,)], "doc_id long")),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "pii": lambda s, d: pii.find_pii(d),
    "redact": lambda s, d: pii.redact_pii(d),
    "sharding": lambda s, d: sharding.shard_by_slots(d, 4, n_slots=64),
    "html": lambda s, d: html_extract.extract_text(d, html_col="text"),
    "urls": lambda s, d: url_filter.judge_urls(d, s.createDataFrame(url_filter.RULES, "host string, path string, action string"), "doc_id", "text"),
    "chat": lambda s, d: chat.link_quotations(d.withColumns({"conv_id": F.col("doc_id"), "turn": F.lit(1), "role": F.lit("user")})),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_input(name, spark, odd):
    assert OPERATORS[name](spark, odd).count() == (2 if name == "decontam" else len(ODD) + (5 if name == "sentencepiece" else 0))
    assert OPERATORS[name](spark, empty(odd)).count() == 0


def edits(item, text):
    """Fewest edits between item and any part of text, by the plain table."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_pigeonhole_finds_what_the_plain_table_finds():
    r = random.Random(3)
    letters = "abcdefgh "
    items = [(i, decontam.normal("".join(r.choice(letters) for _ in range(60)))) for i in range(20)]
    texts = []
    for i in range(60):
        item = list(items[i % 20][1])
        for _ in range(r.randint(0, 7)):
            at = r.randrange(len(item))
            item[at : at + r.randint(0, 1)] = r.choice(letters[:8])
        texts.append("".join(r.choice(letters) for _ in range(50)) + "".join(item) + "".join(r.choice(letters) for _ in range(50)))
    matcher = decontam.Matcher(items)
    for text in texts:
        plain = {(i, e) for i, item in items if (e := edits(item, decontam.normal(text))) <= decontam.budget(item)}
        assert {(i, e) for i, e, _, _ in matcher.find(text)} == plain


def test_simhash_of_skewed_buckets(spark):
    """A bucket beyond the block size is dealt out and loses no link."""
    r = random.Random(5)
    fps = sorted({r.getrandbits(30) | 7 << 40 for _ in range(400)} | {sum(1 << b for b in r.sample(range(6), 2)) for _ in range(50)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long").withColumn("distances", simhash.pivot_distances(F.col("fp")))
    found = {(r.u, r.v) for r in simhash.links(df, 4, 6, block_rows=64).collect()}
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in found:
        assert (u ^ v).bit_count() >= 1
        x, y = sorted((find(u), find(v)))
        root[y] = x
    for n, a in enumerate(fps):
        for b in fps[n + 1 :]:
            if (a ^ b).bit_count() <= 4:
                assert find(a) == find(b)


def test_pii_of_added_kinds(spark):
    text = "IBAN GB82 WEST 1234 5698 7654 32, wrong GB83 WEST 1234 5698 7654 32; ssn 123-45-6789"
    got = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert {(s.kind, text[s.start : s.end]) for s in got if s.kind in ("iban", "ssn")} == {("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789")}


def test_chat_links_quotes(spark):
    rows = [(1, 1, "a", "First point stands here."), (1, 2, "b", "Another remark."), (1, 3, "c", "a wrote:\n> First point stands here.\nI agree."), (1, 4, "d", "> > First point stands here.\n> I agree.\nSo do I.")]
    got = {r.turn: r for r in chat.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[3].reply_to, got[3].text, got[4].reply_to, got[4].root_turn, got[4].quote_depth) == (1, "I agree.", 3, 1, 2)
    assert got[2].reply_to is None and got[4].text == "So do I."


def test_html_main_text(spark):
    page = "<html><body><nav><a href=1>Home</a><a href=2>News</a></nav><article><h1>A title of it</h1><p>Some long   prose &amp; more of it, told at length. It goes on.</p><p>Second paragraph here, of a fair length as well.</p></article><div class=comments><p>I liked it very much.</p></div><footer>Copyright</footer></body></html>"
    got = html_extract.extract_text(spark.createDataFrame([(1, page)], "page_id long, html string")).first().main_text
    assert got == "A title of it\n\nSome long prose & more of it, told at length. It goes on.\n\nSecond paragraph here, of a fair length as well."


def test_url_longest_rule_wins(spark):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, action string")
    urls = ["http://a.EXAMPLE.net/en/1?x", "http://example.net/de/", "http://example.com/de", "x.org/fr/", None, "http://my.org/fr/#a", "http://notexample.net"]
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules)
    joined = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, trie_max_chars=0)
    want = {0: ("example.net/en/", "allow"), 1: ("net/", "block"), 2: (None, "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: ("org/fr/", "allow"), 6: (None, "allow")}
    assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == want == {r.page_id: (r.rule, r.verdict) for r in joined.collect()}


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, at = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf_dir)
        assert at.columns == docs.columns, name
        assert 0 < at.count() <= n
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in at.select("doc_id").collect()}


def test_pipeline_on_empty_tables(spark, sf_dir):
    at = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf_dir)
    assert at.count() == 0
