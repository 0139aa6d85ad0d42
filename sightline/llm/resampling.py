"""Importance resampling towards a target distribution, with n-grams read off a table of positions.

Words are laid out with their positions (posexplode). For runs of more than one word, window lead() per document puts the
following words beside each one, and every order concatenates as many of them; runs of one word need no neighbour and so
no window. Each run is hashed into a bucket; two multinomials are counted over all rows of the corpus and of the target;
a bucket's gain is their log ratio in thousandths. A document's weight is the mean gain of its runs; Gumbel noise from its
id makes the highest scores a draw without replacement.

Rows are counted by id, text and position, so equal rows never have to be told apart by an id that a retry might change:
how often position 0 occurs is how many copies there are.

Defined results
* null, empty and wordless texts: no features, weight 0, never drawn as min_words is above 0;
* repeated rows are scored alike and drawn each; among equal scores smaller ids go first, a null id before all others
  (its noise is that of the empty id);
* an empty target or corpus has no counts, which the added ones of the gain cover; an empty table gives an empty result;
* other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash

N_BUCKETS = 10_000
#: What stands between words: every ASCII character but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the numbers that the noise is made of.
HASHES = 4294967296
#: Ranges of scores that ranks are counted in.
BANDS = 256


def ascii_lower(word: Column) -> Column:
    """word with A-Z alone lower-cased; pure ASCII words take the fast way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h (a hash of the text) and pos and word of each word; a row without words has one row of nulls."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.filter(F.split(text, BETWEEN, -1), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.posexplode_outer(found).alias("pos", "raw"))
    return rows.select("id", "h", "pos", ascii_lower(F.col("raw")).alias("word"))


def runs(words: DataFrame, max_order: int = 1) -> DataFrame:
    """id, h, pos, order, run and copies (how many equal rows of the input a row stands for) of each run of 1 to max_order words."""
    if max_order == 1:
        return words.select("id", "h", "pos", F.lit(1).alias("order"), F.col("word").alias("run"), F.lit(1).cast("long").alias("copies"))
    # Copies of a document would stand between its words: they are counted first, within each task before anything is shuffled.
    single = words.groupBy("id", "h", "pos").agg(F.first("word").alias("word"), F.count("*").alias("copies"))
    beside = Window.partitionBy("id", "h").orderBy("pos")
    table = single.withColumns({f"w{k}": F.lead("word", k).over(beside) for k in range(1, max_order)})
    follow = lambda n: [F.col(f"w{k}") for k in range(1, n)]
    orders = [F.struct(F.lit(n).alias("order"), F.when(F.col(f"w{n - 1}").isNotNull(), F.concat_ws(" ", "word", *follow(n))).alias("run")) for n in range(2, max_order + 1)]
    first = F.struct(F.lit(1).alias("order"), F.col("word").alias("run"))
    every = table.select("id", "h", "pos", "copies", F.explode(F.array(first, *orders)).alias("r")).select("id", "h", "pos", "r.order", "r.run", "copies")
    return every.filter("order = 1 or run is not null")


def bucket(run: Column, n_buckets: int) -> Column:
    return (F.crc32(run.cast("binary")) % n_buckets).cast("int")


def bucket_counts(docs: DataFrame, id_col: str, text_col: str, max_order: int, n_buckets: int) -> DataFrame:
    """bucket and n; n_buckets rows at most."""
    found = runs(positions(docs, id_col, text_col), max_order).filter("run is not null")
    return found.groupBy(bucket(F.col("run"), n_buckets).alias("bucket")).agg(F.sum("copies").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """bucket and gain of every bucket, from the counts of both."""
    spark = corpus.sparkSession
    s, t = ({r.bucket: r.n for r in counts.collect()} for counts in (corpus, target))  # n_buckets rows at most
    rows = [(b, s.get(b, 0), t.get(b, 0)) for b in range(n_buckets)]
    all_s, all_t = F.lit(float(sum(s.values()) + n_buckets)), F.lit(float(sum(t.values()) + n_buckets))
    ratio = ((F.col("t") + 1).cast("double") * all_s) / ((F.col("s") + 1).cast("double") * all_t)
    return spark.createDataFrame(rows, "bucket int, s long, t long").select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, gain: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_order: int = 1, n_buckets: int = N_BUCKETS) -> DataFrame:
    """id, n_features, n_words and weight, one row for each row of docs."""
    found = runs(positions(docs, id_col, text_col), max_order).withColumn("bucket", bucket(F.col("run"), n_buckets))
    met = found.join(F.broadcast(gain), "bucket", "left")  # n_buckets rows
    copies = F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, F.when(F.col("order") == 1, F.col("copies"))))
    of = lambda what: F.coalesce(F.sum(F.when(F.col("run").isNotNull(), what)), F.lit(0))
    each = met.groupBy("id", "h").agg(copies.alias("copies"), of(F.col("copies")).alias("n"), of(F.col("gain") * F.col("copies")).alias("gain"), of(F.when(F.col("order") == 1, F.col("copies"))).alias("words"))
    counted = each.select("id", "copies", (F.expr("n div copies")).alias("n_features"), F.expr("words div copies").alias("n_words"), F.when(F.col("n") == 0, 0).otherwise(_floor_div(F.col("gain"), F.col("n"))).cast("long").alias("weight"))
    one = counted.filter("copies = 1")
    block = 10_000
    blocks = counted.filter("copies > 1").withColumn("from", F.explode(F.expr(f"sequence(0L, copies - 1, {block}L)"))).repartition("id", "n_features", "weight", "from")
    many = blocks.withColumn("k", F.explode(F.expr(f"sequence(from + 1, least(from + {block}, copies))")))
    columns = [F.col("id").alias(id_col), "n_features", "n_words", "weight"]
    return one.select(*columns).unionByName(many.select(*columns))


def _floor_div(a: Column, b: Column) -> Column:
    """a / b rounded down, in whole numbers; b is above 0."""
    return (a - F.pmod(a, b)) / b


def noise(id_: Column, seed: int) -> Column:
    """Gumbel noise of an id, in thousandths."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(float(HASHES)))))


def ranked(rows: DataFrame, score: str, id_col: str) -> DataFrame:
    """rows with rank (1, 2, ...) by falling score, then id. Rows are dealt to ranges of that order and numbered within each
    task; a range begins where the ones before end. Rows of one id are spread by a number of their own.
    """
    spread = rows.withColumn("__row", F.monotonically_increasing_id())
    order = [F.col(score).desc(), F.col(id_col).asc_nulls_first(), F.col("__row")]
    dealt = spread.repartitionByRange(BANDS, *order).sortWithinPartitions(*order)
    # Within a task ids increase by one from the task's first, which is its number times 2^33.
    told = stash(dealt.withColumn("__at", F.monotonically_increasing_id()).drop("__row"), "ranked")
    band, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = told.groupBy(band.alias("__band")).agg(F.count("*").alias("n"))  # BANDS rows
    before = F.coalesce(F.sum("n").over(Window.orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.select("__band", before.alias("__begin"))
    return told.withColumn("__band", band).withColumn("__within", within).join(F.broadcast(begins), "__band").withColumn("rank", F.col("__begin") + F.col("__within") + 1).drop("__at", "__band", "__begin", "__within")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, max_order: int = 1, n_buckets: int = N_BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """id, n_features, n_words, weight, score and rank of each row; of the N rows with min_words words or more the highest
    percent * N / 100 scores have a rank, the others null.
    """
    corpus, wanted = bucket_counts(docs, id_col, text_col, max_order, n_buckets), bucket_counts(target, target_id, target_text, max_order, n_buckets)
    weighed = weights(docs, gains(corpus, wanted, n_buckets), id_col, text_col, max_order, n_buckets)
    scored = stash(weighed.withColumn("score", F.col("weight") + noise(F.col(id_col), seed)), "scored")
    able = scored.filter(F.col("n_words") >= min_words)
    tally = able.groupBy("score").agg(F.count("*").alias("n")).orderBy(F.col("score").desc()).collect()  # a row for each score that occurs: gains and noise are bounded, so below 200,000
    quota = sum(r.n for r in tally) * percent // 100
    least, met = None, 0
    for r in tally:
        if met < quota:
            least, met = r.score, met + r.n
    high = (F.col("n_words") >= min_words) & (F.col("score") >= F.lit(least).cast("long")) if least is not None else F.lit(False)
    drawn = ranked(scored.filter(high), "score", id_col).withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")).cast("long"))
    return drawn.unionByName(scored.filter(~F.coalesce(high, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


# Words have their CRC-32 reckoned once each, byte by byte and bit by bit.
OP13_SQL = r"""
WITH words AS (
  SELECT 0 AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 1, NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), counted AS (SELECT side, id, w, count(*) AS n FROM words GROUP BY ALL),
vocabulary AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM counted)),
bits AS (SELECT w, list_transform(range(1, strlen(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT) AS bytes FROM vocabulary),
hashed AS (
  SELECT w, xor(list_reduce(bytes, lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END), 4294967295), 4294967295) % 10000 AS bucket
  FROM bits
), buckets AS (SELECT side, bucket, sum(n) AS n FROM counted JOIN hashed USING (w) GROUP BY side, bucket),
totals AS (SELECT coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM buckets),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(any_value(n) FILTER (side = 1), 0) + 1)::DOUBLE * (any_value(totals.s) + 10000)::DOUBLE / ((coalesce(any_value(n) FILTER (side = 0), 0) + 1)::DOUBLE * (any_value(totals.t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM buckets, totals GROUP BY bucket
), weighed AS (
  SELECT id AS doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight
  FROM counted JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 0 GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weighed USING (doc_id)
), ordered AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ordered USING (doc_id)
"""
