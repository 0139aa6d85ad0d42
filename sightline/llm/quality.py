"""Quality rules: Gopher-like counts, and a hashed n-gram log-likelihood ratio between trusted and raw text.

DataFrame functions only. Tokens are runs of letters and digits and runs of other marks; unigrams and bigrams of
them are hashed into buckets. Two multinomials are counted over all n-grams: of the trusted rows, and of the whole
corpus. A document's score is the mean over its n-grams of log p_trusted - log p_corpus; it passes at `threshold`
or above, which holds for every document alike.

Defined results
* null, empty and blank texts: no words, all counts 0, score 0 (no n-gram), base_failed;
* no trusted rows: both multinomials are the corpus's, every score is 0 and passes a threshold of 0 or less;
* repeated rows count as often as they occur and are judged alike; ids with several labels count as trusted if one is;
* an empty table gives an empty result; no other column is looked at.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, words

#: Buckets of the hashed n-grams.
N_BUCKETS = 10_000
#: Places that the rows of one id are dealt to.
SALTS = 16
#: Added to each bucket's share, as a share of an even spread.
SMOOTHING = 0.05
#: Lowest mean log-likelihood ratio that passes.
THRESHOLD = -0.25


def repeated_words(tokens: Column) -> Column:
    """Words that lie in a window of five words found twice or more, from an array of hashes of the words.

    Windows are told apart by 64-bit hashes. A text without a repeated hash is done then; in the others the hashes
    are sorted with their places, which costs n log n.
    """
    zero = F.lit(0).cast("long")

    def places(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, i, x: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        again = let(ordered, lambda s: F.filter(s, lambda x, i: same(s, i - 1, x) | same(s, i + 1, x)))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n"), p.alias("last"))
    covered = lambda windows: F.aggregate(places(windows), F.struct(F.lit(0).alias("n"), F.lit(-5).alias("last")), step, lambda acc: acc["n"].cast("long"))
    windows = lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - 5), lambda i: F.xxhash64(*[F.get(t, i + k) for k in range(5)]))
    counted = lambda t: let(windows(t), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(zero))
    return let(tokens, lambda t: F.when(F.size(t) >= 5, counted(t)).otherwise(zero))


def base_counts(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text without nulls."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    doubles = F.when(F.contains(text, F.lit("\n")), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0)
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    return let(
        hashes,
        lambda h: F.struct(
            F.size(h).cast("long").alias("n_words"),
            F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            doubles.cast("long").alias("n_dup_lines"),
            repeated_words(h).alias("n_repeat_words"),
        ),
    )


def ngram_buckets(text: Column, n_buckets: int = N_BUCKETS) -> Column:
    """The buckets of a text's unigrams and bigrams; the text has no nulls."""
    tokens = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"), F.lit(0)), lambda t: F.xxhash64(t))
    bucket = lambda *xs: F.pmod(F.xxhash64(*xs), F.lit(n_buckets)).cast("int")
    pairs = lambda t: F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: bucket(a, b))
    return let(tokens, lambda t: F.when(F.size(t) > 1, F.concat(F.transform(t, lambda x: bucket(x)), pairs(t))).otherwise(F.transform(t, lambda x: bucket(x))))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = N_BUCKETS) -> list[float]:
    """log p_trusted - log p_corpus of each bucket. trusted holds the ids of trusted rows; the counts cover all n-grams
    of all trusted rows, and of all rows.
    """
    # One way at every size: ids, which grow with the input, are shuffled and never broadcast; rows of one id are dealt to SALTS places by their text.
    salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("__salt")
    ids = trusted.select(F.col(id_col)).distinct().select(id_col, salts, F.lit(1).alias("__trusted")).hint("merge")
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("__text")).withColumn("__salt", F.pmod(F.xxhash64("__text"), F.lit(SALTS)).cast("int"))
    marked = rows.join(ids, [id_col, "__salt"], "left")
    counts = marked.select("__trusted", F.explode(ngram_buckets(F.col("__text"), n_buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("__trusted").alias("good"))
    raw, good = np.zeros(n_buckets), np.zeros(n_buckets)
    for r in counts.collect():  # n_buckets rows at most
        raw[r.bucket], good[r.bucket] = r.raw, r.good
    if not good.sum():
        return [0.0] * n_buckets
    share = lambda n: np.log(n / n.sum() + SMOOTHING / n_buckets)
    return (share(good) - share(raw)).tolist()


def judge_quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n_buckets: int = N_BUCKETS) -> DataFrame:
    """Base counts, base_failed, score (mean log-likelihood ratio) and kept for each row."""
    weights = F.from_json(F.lit(json.dumps(log_ratios(docs, trusted, id_col, text_col, n_buckets))), "array<double>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    mean = lambda b: F.when(F.size(b) > 0, F.aggregate(b, F.lit(0.0), lambda acc, x: acc + F.get(weights, x)) / F.size(b)).otherwise(0.0)
    counts = docs.select(F.col(id_col), base_counts(text).alias("__counts"), let(ngram_buckets(text, n_buckets), mean).alias("score")).select(id_col, "__counts.*", "score")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    judged = judge_quality(docs, trusted)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
