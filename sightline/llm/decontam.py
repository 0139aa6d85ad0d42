"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a text with up to `rate` times its length edits (k). It is cut into k + 1 pieces: one of them
at least then occurs unchanged. An automaton over all pieces finds exact hits in whole texts; around each hit,
Myers' bit-parallel distance is computed against the item, and an occurrence within k edits is reported.

Texts and items are compared lower-cased with each run of white space as one space.

Defined results
* null, empty and blank texts have no hits; null, empty and blank items are never found;
* an item so short that its budget is no edit (below 1 / rate characters) is found as it is, between word boundaries;
* ids of items may be of any type, null too; equal items are each reported; a text that holds an item several times gets one row with the best occurrence (fewest
  edits, then the first);
* repeated documents are each reported; empty tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edits allowed, as a share of the item's length.
RATE = 0.08
#: Characters of items that one automaton, which is broadcast, takes; more items are handled in several passes.
PASS_CHARS = 8_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float = RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """The item in k + 1 pieces of near equal length, with their places."""
    ends = [round(i * len(item) / (k + 1)) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


def best_end(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Fewest edits between an item of m characters and any part of text, and where the first such part ends (Myers 1999)."""
    high, full = 1 << (m - 1), (1 << m) - 1
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full  # the text may begin anywhere: no cost comes in below
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Items, their pieces' automaton and their bit masks."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE) -> None:
        self.items = [(i, t, budget(t, rate)) for i, t in ((i, normal(t)) for i, t in items) if t]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text, k) in enumerate(self.items):
            for at, piece in pieces(text, k):
                where[piece].append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()
        self.peq = [masks(text) for _, text, _ in self.items]

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, edits, budget, end in the normalised text) of each item that the text holds within its budget."""
        text = normal(text)
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if len(self.automaton):
            for end, (length, places) in self.automaton.iter(text):
                for n, at in places:
                    _, item, k = self.items[n]
                    begin = end + 1 - length - at
                    low, high = max(0, begin - k), min(len(text), begin + len(item) + k)
                    spans = windows[n]
                    if k and spans and low <= spans[-1][1]:  # hits of one item come nearly in order: join windows that meet
                        spans[-1] = (min(low, spans[-1][0]), max(high, spans[-1][1]))
                    else:
                        spans.append((low, high))
        out = []
        for n, spans in sorted(windows.items()):
            i, item, k = self.items[n]
            best: tuple[int, int] | None = None
            for low, high in spans:
                if not k:
                    found = (0, high) if text[low:high] == item and _bounded(text, low, high) else None
                else:
                    edits, end = best_end(self.peq[n], len(item), text[low:high])
                    found = (edits, low + end) if edits <= k else None
                if found and (best is None or found < best):
                    best = found
            if best:
                out.append((i, best[0], k, best[1]))
        return out


def _bounded(text: str, low: int, high: int) -> bool:
    return (low == 0 or not text[low - 1].isalnum()) and (high == len(text) or not text[high].isalnum())


def _passes(items: DataFrame, item_col: str, item_text_col: str, pass_chars: int) -> Iterator[Broadcast]:
    """The items, broadcast in groups of about pass_chars characters: one group but for very large test sets."""
    test = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("item_text"))
    n = test.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0] // pass_chars + 1
    for p in range(n):
        own = test.filter(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(n)) == p)
        yield items.sparkSession.sparkContext.broadcast([(r.item_id, r.item_text) for r in own.collect()])


def _search(shared: Broadcast, rate: float):
    columns = ["id", "item_id", "edits", "budget", "end"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(shared.value, rate)
        for batch in batches:
            yield pd.DataFrame([(d, *hit) for d, text in zip(batch["id"], batch["text"], strict=True) for hit in matcher.find(text)], columns=columns, dtype=object)

    return run


def _clean(shared: Broadcast, rate: float):
    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(shared.value, rate)
        for texts in batches:
            yield pd.Series([not matcher.find(t) for t in texts], dtype=bool)

    return run


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, pass_chars: int = PASS_CHARS) -> DataFrame:
    """One row per document row and item that it holds: id, item_id, edits, budget and the end of the best occurrence."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    found = [rows.mapInPandas(_search(shared, rate), f"id string, item_id {items.schema[item_col].dataType.simpleString()}, edits int, budget int, end int") for shared in _passes(items, item_col, item_text_col, pass_chars)]
    return reduce(DataFrame.unionByName, found).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, pass_chars: int = PASS_CHARS) -> DataFrame:
    """docs without the rows whose text holds any item. Each row is judged where it lies, so repeated or null ids don't matter."""
    for shared in _passes(items, item_col, item_text_col, pass_chars):
        docs = docs.filter(_clean(shared, rate)(F.col(text_col)))
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
