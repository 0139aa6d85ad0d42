"""Ranked lexical search by TPUT (three-phase uniform threshold) over term-partitioned postings.

Postings of the queries' terms are read off whole texts, one task a share of the documents, and then laid out by term: each
term's list lies together, highest impact first, long lists dealt to several places. Then, for all queries at once,

1. heads: the k highest postings of each list give partial scores; a query's k-th highest, t1, is a lower bound;
2. uniform threshold: every list gives its postings worth t1 / (number of lists) or more, and they meet by document. A document
   below that in every list is below t1. Tasks that sum the partial scores drop what can't reach the k-th highest partial score
   among their own documents; the k-th highest of all, t2, is a better bound. Documents whose partial score and what their
   missing lists could add reach t2 are candidates;
3. look-up: the candidates' exact scores from all lists of their query; the k highest are the result.

A document is a row of the input, so rows of equal ids are ranked each.

Defined results
* null, empty and wordless texts are in no list and in neither N nor L; such queries find nothing;
* equal scores: smaller doc_id first (a null id last), equal ids in the order of the input; scores of 0 are not returned;
* equal query rows: each id is answered once, by all terms that rows of that id hold; a null query id is a query;
* empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash

#: Results of a query.
K = 50
#: Distinct terms of the queries that tasks hold as a dictionary; with more, the documents are read once for each so many.
MAX_TERMS = 500_000
#: Pairs of query and term that tasks hold at once; more are answered in blocks of queries.
MAX_PAIRS = 1_000_000
#: Places that the postings of one term are dealt to.
SALTS = 32
#: Partial scores that a task gathers before it drops what can't be among the k best.
GATHERED = 400_000

#: ASCII letters and digits and all bytes of other characters make terms, A-Z as a-z; the rest stands between.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERM_BYTES).split()


def postings(docs: DataFrame, codes: Mapping[bytes, int], with_docs: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, term (its code), tf and n of each document's distinct terms among those of codes; with_docs adds a row with a
    null term for each document that has terms. row numbers the input's rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, known = TaskContext.get().partitionId() << 33, shared.value
        for batch in batches:
            at, rows, found, tf, n = [], [], [], [], []
            for i in range(batch.num_rows):
                words = terms(batch.column(1)[i].as_py())
                if words:
                    counted = Counter(words)
                    kept = counted.keys() & known.keys()
                    new = len(kept) + with_docs
                    at += [i] * new
                    rows += [row] * new
                    n += [len(words)] * new
                    found += [*([None] * with_docs), *[known[w] for w in kept]]
                    tf += [*([0] * with_docs), *[counted[w] for w in kept]]
                row += 1
                if at and (len(at) > 50_000 or i == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.int32()), pa.array(tf, pa.int64()), pa.array(n, pa.int64())], names=["row", "doc_id", "term", "tf", "n"])
                    at, rows, found, tf, n = [], [], [], [], []

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"row long, doc_id {kind}, term int, tf long, n long")


def query_terms(queries: DataFrame, query_col: str, text_col: str) -> DataFrame:
    """query and word, each pair once."""
    kind = queries.schema[query_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t) for i in range(batch.num_rows) for t in sorted(set(terms(batch.column(1)[i].as_py())))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in rows], pa.int64())), pa.array([t for _, t in rows], pa.binary())], names=["query", "word"])

    return queries.select(F.col(query_col).alias("query"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"query {kind}, word binary").distinct()


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """query and least: each query's k-th highest score, 0 with fewer rows."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc()))
    high = scores.select("query", "score", place.alias("place")).filter(F.col("place") <= k)
    return high.groupBy("query").agg(F.coalesce(F.min(F.when(F.col("place") == k, F.col("score"))), F.lit(0)).alias("least"))


def search(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text: str = "text", max_terms: int = MAX_TERMS, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """query_col, rank, id_col and score of each query's k best documents."""
    spark = docs.sparkSession
    asked = stash(query_terms(queries, query_col, query_text), "queries")
    distinct = stash(asked.select("word").distinct(), "words")
    n_passes, held, coded, begin = distinct.count() // max_terms + 1, [], [], 0
    for p in range(n_passes):
        own = [r.word for r in distinct.filter(F.pmod(F.xxhash64("word"), F.lit(n_passes)) == p).collect()]  # about max_terms rows
        codes = {word: begin + i for i, word in enumerate(own)}
        begin += len(own)
        held.append(stash(postings(docs, codes, p == 0, id_col, text_col), "postings"))
        coded.append(spark.createDataFrame([*codes.items()], "word binary, term int"))
    met = reduce(DataFrame.unionByName, held)
    size = met.filter("term is null").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    lists = by_term(met, size.docs, size.words)
    n_blocks = asked.count() // max_pairs + 1
    terms_of = asked.join(reduce(DataFrame.unionByName, coded), "word").select("query", "term", F.pmod(F.xxhash64("query"), F.lit(n_blocks)).alias("block"))
    found = weighed(lists, terms_of, size.docs)
    answers = [best(lists, found.filter(F.col("block") == b).drop("block"), k) for b in range(n_blocks)]
    return reduce(DataFrame.unionByName, answers).select(F.col("query").alias(query_col), "rank", F.col("doc_id").alias(id_col), "score")


def by_term(met: DataFrame, n_docs: int, n_words: int) -> DataFrame:
    """The lists: term, impact, row and doc_id, sorted by term and falling impact; a term's rows are dealt to SALTS places."""
    m = F.expr(f"50 + ((50L * n * {n_docs}L) div {max(n_words, 1)}L)")
    impact = met.filter("term is not null").withColumn("m", m).select("term", F.expr("(1000000000L * tf) div (1000L * tf + 20L * m)").cast("int").alias("impact"), "row", "doc_id")
    dealt = impact.repartition("term", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    return stash(dealt.sortWithinPartitions("term", F.col("impact").desc()), "lists")


def weighed(lists: DataFrame, asked: DataFrame, n_docs: int) -> DataFrame:
    """asked with the term's weight and its highest and lowest impact; terms that no document holds are left out."""
    df = lists.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("top"), F.min("impact").alias("bottom"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double")))
    return stash(asked.join(df, "term").select("block", "query", "term", weight.alias("weight"), "top", "bottom"), "weighed")


class _Thresholds:
    """A block's queries by term: from which impact on a posting is read, and what an unread one could add."""

    def __init__(self, rows: list, bounds: dict, k: int) -> None:
        self.queries = list(dict.fromkeys(r.query for r in rows))
        number = {q: i for i, q in enumerate(self.queries)}
        rows = sorted(rows, key=lambda r: r.term)
        self.k, self.term = k, np.array([r.term for r in rows], dtype=np.int64)
        self.query, self.weight, top, bottom = (np.array(x, dtype=np.int64) for x in ([number[r.query] for r in rows], [r.weight for r in rows], [r.top for r in rows], [r.bottom for r in rows]))
        n = len(self.queries)
        self.t1 = np.array([bounds.get(q, 0) for q in self.queries], dtype=np.int64)
        lists = np.bincount(self.query, minlength=n)
        each, t1 = (self.weight * lists[self.query]), self.t1[self.query]
        # A posting is read if impact * weight * lists >= t1.
        self.least = np.where(each > 0, -(-t1 // np.maximum(each, 1)), np.where(t1 > 0, np.iinfo(np.int64).max, 0))
        # A list that is read to its end holds nothing more; another's unread postings lie below the threshold and its top.
        self.unread = np.where(bottom >= self.least, 0, np.minimum(np.maximum((t1 - 1) // lists[self.query], 0), self.weight * top))
        self.all_unread = np.zeros(n, dtype=np.int64)
        np.add.at(self.all_unread, self.query, self.unread)
        self.terms, self.begin = np.unique(self.term, return_index=True)
        self.end = np.searchsorted(self.term, self.terms, side="right")

    def partial(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, doc: pa.Array) -> pa.Table:
        """query, row, doc, score and most (the exact score can be), over the postings of whole documents."""
        at = np.searchsorted(self.terms, term)
        n = self.end[at] - self.begin[at]
        which = np.repeat(np.arange(len(term)), n)
        pair = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + self.begin[at][which]
        read = impact[which] >= self.least[pair]
        which, pair = which[read], pair[read]
        rows, first, inverse = np.unique(row, return_index=True, return_inverse=True)
        key, inverse = np.unique(inverse[which] * len(self.queries) + self.query[pair], return_inverse=True)
        score, seen = np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=np.int64)
        np.add.at(score, inverse, self.weight[pair] * impact[which])
        np.add.at(seen, inverse, self.unread[pair])
        query, own = key % len(self.queries), key // len(self.queries)
        most = score + self.all_unread[query] - seen
        good = most >= self.t1[query]
        query, own, score, most = query[good], own[good], score[good], most[good]
        return pa.table({"q": query, "row": rows[own], "doc": doc.take(pa.array(first[own])), "score": score, "most": most})

    def kept(self, found: list[pa.Table]) -> pa.Table:
        """found without the rows that can't be among a query's k best: those below its k-th highest score in found, and those
        that are sure to tie with it and stand behind k others.
        """
        table = pa.concat_tables(found).combine_chunks()
        order = pc.sort_indices(table, sort_keys=[("q", "ascending"), ("score", "descending"), ("doc", "ascending"), ("row", "ascending")], null_placement="at_end")
        table = table.take(order)
        query, score, most = (table.column(c).to_numpy() for c in ("q", "score", "most"))
        first = np.searchsorted(query, np.arange(len(self.queries)))
        kth = np.minimum(first + self.k - 1, max(len(query) - 1, 0))
        full = (first + self.k <= len(query)) & (query[kth] == np.arange(len(self.queries))) if len(query) else np.zeros(len(self.queries), dtype=bool)
        self.t1[full] = np.maximum(self.t1[full], score[kth[full]])
        behind = (np.arange(len(query)) - first[query] >= self.k) & (score == most)  # k others are as good at least, and go first among equals
        return table.filter(pa.array((most >= self.t1[query]) & ~behind))


def _sum_up(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: _Thresholds = shared.value
        plan.t1 = plan.t1.copy()  # grows in this task alone
        found, n, rest, floor = [], 0, None, 0

        def add(part: pa.Table) -> None:
            nonlocal found, n, floor
            row, term, impact = (part.column(c).to_numpy() for c in ("row", "term", "impact"))
            found.append(plan.partial(row, term, impact, part.column("doc_id").combine_chunks()))
            n += found[-1].num_rows
            if n > GATHERED + 2 * floor:
                found = [plan.kept(found)]
                n = floor = found[0].num_rows

        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = part if rest is None else pa.concat_tables([rest, part])
            row = part.column("row").to_numpy()
            whole = int(np.searchsorted(row, row[-1])) if len(row) else 0  # rows are sorted; the last may go on
            rest = part.slice(whole)
            if whole:
                add(part.slice(0, whole))
        if rest is not None and rest.num_rows:
            add(rest)
        if found:
            yield from plan.kept(found).drop_columns(["doc"]).combine_chunks().to_batches()

    return run


def best(lists: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query, rank, doc_id and score: the three phases over lists (by_term) and a block of asked (weighed)."""
    spark = lists.sparkSession
    worth = F.col("weight") * F.col("impact")

    # 1. The heads of all lists.
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.col("impact").desc(), "row"))
    heads = lists.select("term", "impact", "row", place.alias("place")).filter(F.col("place") <= k)
    first = heads.join(F.broadcast(asked), "term").groupBy("query", "row").agg(F.sum(worth).alias("score"))  # asked: MAX_PAIRS rows at most
    bounds = {r.query: r.least for r in _kth(first, k).collect()}

    # 2. What every list holds above the uniform threshold, by document.
    plan = _Thresholds(asked.collect(), bounds, k)
    lows = [(int(t), int(plan.least[b:e].min())) for t, b, e in zip(plan.terms, plan.begin, plan.end, strict=True)]
    read = lists.join(F.broadcast(spark.createDataFrame(lows, "t int, low long")), (F.col("term") == F.col("t")) & (F.col("impact") >= F.col("low")))
    by_row = read.select("row", F.col("term").cast("long"), F.col("impact").cast("long"), "doc_id").repartition("row").sortWithinPartitions("row")
    names = spark.createDataFrame([(i, q) for i, q in enumerate(plan.queries)], f"q long, query {asked.schema['query'].dataType.simpleString()}")
    partial = stash(by_row.mapInArrow(_sum_up(spark.sparkContext.broadcast(plan)), "q long, row long, score long, most long").join(F.broadcast(names), "q"), "partial")
    second = _kth(partial.select(F.col("q").alias("query"), "score"), k).select(F.col("query").alias("q"), F.col("least").alias("t2"))
    candidates = stash(partial.join(F.broadcast(second), "q").filter("most >= t2").select("q", "query", "row"), "candidates")

    # 3. Exact scores of the candidates; each is asked for in the lists of its query's terms.
    few = candidates.count() <= MAX_PAIRS
    rows = candidates.select("row").distinct()
    rows, pairs = (F.broadcast(rows), F.broadcast(candidates)) if few else (rows, candidates)
    held = lists.join(rows, "row", "left_semi")
    of = asked.select(F.col("query").alias("asker"), F.col("term").alias("t"), "weight")
    exact = held.join(pairs, "row").join(F.broadcast(of), (F.col("term") == F.col("t")) & F.col("query").eqNullSafe(F.col("asker")))
    score = exact.groupBy("query", "row").agg(F.sum(worth).alias("score"), F.first("doc_id").alias("doc_id")).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row"))
    return score.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return search(docs, items)


OP12_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM doc_words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, totals GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id
), ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""
