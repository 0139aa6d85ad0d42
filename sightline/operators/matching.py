"""Matching the elements of two snapshots. Inputs: pair_id, idx (document order) and the columns that a pass keys on."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import hpid as H
from ..shared import written

FOUND = "pair_id long, b_idx long, c_idx long, outcome string, strategy string, confidence double"


def anchor_key() -> Column:
    """attribute::value of the first anchor attribute that isn't empty."""
    tries = [F.when(F.coalesce(F.element_at("attributes", F.lit(a)), F.lit("")) != "", F.concat(F.lit(f"{a}::"), F.element_at("attributes", F.lit(a)))) for a in C.ANCHOR_ATTRIBUTES]
    return F.coalesce(*tries)


def text_key(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def suffix_key(n: int = 5) -> Column:
    return F.when(H.depth(F.col("hpid")) >= max(2, n // 2), F.concat(H.suffix(F.col("hpid"), n), F.lit("::"), F.coalesce("tagName", F.lit(""))))


def keyed(base: DataFrame, other: DataFrame, key: Column, strategy: str, confidence: float, options: C.MatchOptions = C.MatchOptions()) -> DataFrame:
    """One pass: pair_id, b_idx, c_idx, n_candidates and outcome (match, ambiguous or orphan) of each base row.

    A key that one compare row holds goes to the lowest base row; with several, all its base rows are ambiguous and
    claim nothing. Counts by key are aggregated before the join, so a frequent key costs no pairs; its candidates are
    listed once a key by candidates().
    """
    b = base.select("pair_id", F.col("idx").alias("b_idx"), key.alias("key"))
    held = other.select("pair_id", "idx", key.alias("key")).filter("key is not null").groupBy("pair_id", "key").agg(F.count("*").alias("n_candidates"), F.min("idx").alias("c_idx"))
    first = b.filter("key is not null").groupBy("pair_id", "key").agg(F.min("b_idx").alias("first"))
    met = b.join(held.join(first, ["pair_id", "key"]), ["pair_id", "key"], "left")
    good = confidence >= options.min_match
    outcome = F.when(F.lit(good) & (F.col("n_candidates") == 1) & (F.col("b_idx") == F.col("first")), "match").when(F.lit(good) & (F.col("n_candidates") > 1), "ambiguous").otherwise("orphan")
    return met.select("pair_id", "key", "b_idx", F.when(outcome == "match", F.col("c_idx")).alias("c_idx"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), outcome.alias("outcome"), F.lit(strategy).alias("strategy"), F.lit(confidence).alias("confidence"))


def candidates(other: DataFrame, key: Column, unclear: DataFrame) -> DataFrame:
    """The compare rows (pair_id, c_idx, key) that the ambiguous rows of a pass could have meant."""
    rows = other.select("pair_id", F.col("idx").alias("c_idx"), key.alias("key")).filter("key is not null")
    return rows.join(unclear.select("pair_id", "key").distinct(), ["pair_id", "key"], "left_semi")


def suffix_pass(base: DataFrame, other: DataFrame, options: C.MatchOptions = C.MatchOptions()) -> DataFrame:
    """Pairs by the last steps of the path and the tag. With n compare rows left, the (n)th-to-last base row on takes the one that remains:
    a base row matches only while exactly one candidate is left, so only keys with a single candidate match, once.
    """
    return keyed(base, other, suffix_key(options.suffix_depth), "suffix-realign", options.suffix, options).filter("outcome = 'match'")


def identity(base: DataFrame, other: DataFrame) -> DataFrame:
    """Full outer join on path and tag: pair_id, hpid, both tags and indexes, and outcome (pair, replaced, added or removed)."""
    b = base.select("pair_id", F.col("hpid"), F.col("idx").alias("b_idx"), F.col("tagName").alias("b_tag"))
    c = other.select("pair_id", F.col("hpid"), F.col("idx").alias("c_idx"), F.col("tagName").alias("c_tag"))
    met = b.join(c, ["pair_id", "hpid"], "full_outer")
    return met.withColumn("outcome", F.when(F.col("c_idx").isNull(), "removed").when(F.col("b_idx").isNull(), "added").when(F.col("b_tag") == F.col("c_tag"), "pair").otherwise("replaced"))


#: Elements of a side that a task takes in at once; the walk goes on from block to block.
BLOCK = 20_000
#: Rows of the alignment that are handed on at once.
HANDED_ON = 50_000


class _Walk:
    """Two cursors over the elements of both sides, which look a few elements ahead where they disagree.

    Blocks of (idx, path code, path-and-tag code) are fed side by side; what is behind both cursors is let go. Stretches where
    both sides agree, at whatever distance the cursors are, are compared at once.
    """

    def __init__(self, look: int, confidence: float) -> None:
        self.look, self.confidence = look, confidence
        self.held = [np.empty((3, 0), dtype=np.int64), np.empty((3, 0), dtype=np.int64)]
        self.rows: list[tuple] = []

    def feed(self, side: int, block: np.ndarray) -> None:
        self.held[side] = np.concatenate([self.held[side], block], axis=1)

    def _note(self, b: np.ndarray, c: np.ndarray, outcome: str, strategy: str | None = None, confidence: float | None = None) -> None:
        """b and c: index columns of equal length; -1 stands for none."""
        self.rows.append((b, c, outcome, strategy, confidence))

    def _lone(self, idx: np.ndarray, side: int) -> None:
        none = np.full(len(idx), -1)
        self._note(*((idx, none) if side == 0 else (none, idx)), "removed" if side == 0 else "added")

    def _ahead(self, side: int, at: int, code: int) -> int | None:
        found = np.flatnonzero(self.held[side][2, at + 1 : at + 1 + self.look] == code)
        return at + 1 + int(found[0]) if len(found) else None

    def run(self, last: bool) -> None:
        """Walks on: to the end with last, else as long as all elements ahead that a step may look at are there."""
        (left, right), look = self.held, self.look
        b = c = 0
        keep = 0 if last else look
        while (n := min(left.shape[1] - b, right.shape[1] - c) - keep) > 0:
            size = 1
            while n > 0:
                equal = left[2, b : b + min(size, n)] == right[2, c : c + min(size, n)]
                met = len(equal) if equal.all() else int(equal.argmin())
                if met:
                    self._note(left[0, b : b + met], right[0, c : c + met], "match", "sequence-hpid", self.confidence)
                    b, c, n = b + met, c + met, n - met
                if met < len(equal):
                    break
                size = min(size * 4, 4096)
            if n <= 0:
                continue
            if left[1, b] == right[1, c]:  # replaced
                self._lone(left[0, b : b + 1], 0)
                self._lone(right[0, c : c + 1], 1)
                b, c = b + 1, c + 1
            elif (k := self._ahead(1, c, left[2, b])) is not None:
                self._lone(right[0, c:k], 1)
                self._note(left[0, b : b + 1], right[0, k : k + 1], "match", "sequence-resync-add", self.confidence - 0.05)
                b, c = b + 1, k + 1
            elif (k := self._ahead(0, b, right[2, c])) is not None:
                self._lone(left[0, b:k], 0)
                self._note(left[0, k : k + 1], right[0, c : c + 1], "match", "sequence-resync-remove", self.confidence - 0.05)
                b, c = k + 1, c + 1
            else:
                self._note(left[0, b : b + 1], right[0, c : c + 1], "orphan")
                b, c = b + 1, c + 1
        self.held = [left[:, b:], right[:, c:]]
        if last:
            self._lone(self.held[0][0], 0)
            self._lone(self.held[1][0], 1)
            self.held = [x[:, :0] for x in self.held]

    def take(self, pair: int) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        sizes = [len(r[0]) for r in rows]
        spread = lambda k, kind: np.repeat(np.array([r[k] for r in rows], dtype=kind), sizes)
        idx = [pd.array(np.concatenate([r[k] for r in rows]) if rows else np.empty(0, dtype=np.int64), dtype="Int64") for k in (0, 1)]
        for x in idx:
            x[x == -1] = pd.NA
        return pd.DataFrame({"pair_id": np.full(sum(sizes), pair), "b_idx": idx[0], "c_idx": idx[1], "outcome": spread(2, object), "strategy": spread(3, object), "confidence": spread(4, float)})


def align(base: DataFrame, other: DataFrame, options: C.MatchOptions = C.MatchOptions()) -> DataFrame:
    """Sequence alignment in document order: FOUND rows with outcome match, added, removed or orphan. idx is 0 or more.

    Paths and tags become numbers that are equal where they are; the elements of each side are put in blocks by their order, and
    a task walks a comparison's blocks one after the other, with the cursors handed on. It holds a block of each side and as many
    elements as one cursor is ahead of the other, so a comparison may be of any size.
    """
    number = lambda s: F.when(s.rlike("^[0-9]+$"), F.regexp_replace(s, "^0+(?=.)", "")).otherwise(s)
    path = F.array_join(F.transform(H.segments(F.coalesce("hpid", F.lit(""))), number), ".")
    rows = reduce(DataFrame.unionByName, [d.select("pair_id", F.lit(side).alias("side"), F.col("idx").cast("long").alias("idx"), path.alias("path"), "tagName") for side, d in enumerate((base, other))])
    code = lambda *by: F.min(F.col("idx") * 2 + F.col("side")).over(Window.partitionBy("pair_id", *by))
    coded = rows.withColumn("p", code("path")).withColumn("k", code("path", "tagName"))
    place = F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("idx"))
    blocks = coded.select("pair_id", "side", "idx", "p", "k", F.floor((place - 1) / BLOCK).alias("block")).groupBy("pair_id", "block", "side").agg(F.array_sort(F.collect_list(F.struct("idx", "p", "k"))).alias("rows"))  # BLOCK rows at most
    columns = blocks.select("pair_id", "block", "side", *[F.col(f"rows.{f}").alias(f) for f in ("idx", "p", "k")])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, done, at = None, None, None
        for batch in batches:
            for pair, block, side, *parts in batch.itertuples(index=False):
                if now is not None and pair != at:
                    now.run(True)
                    yield now.take(at)
                    now = None
                if now is None:
                    now, at, done = _Walk(options.look_ahead, options.in_sequence), pair, block
                if block != done:  # both sides of the blocks before are in
                    now.run(False)
                    done = block
                    if sum(len(r[0]) for r in now.rows) > HANDED_ON:
                        yield now.take(at)
                now.feed(side, np.array(parts, dtype=np.int64))
        if now is not None:
            now.run(True)
            yield now.take(at)

    return columns.repartition("pair_id").sortWithinPartitions("pair_id", "block", "side").mapInPandas(walk, FOUND)


def near(base: DataFrame, other: DataFrame, options: C.MatchOptions = C.MatchOptions()) -> DataFrame:
    """Pairs by place: x and y within the tolerance, of the same tag, the nearest free one of at least the confidence threshold.

    Base rows claim in document order; of equally near ones the first counts, cell by cell of the tolerance's size. A position
    alone is worth 0.30 at most, so nothing is found above that threshold (the default). Claims interact, so they are settled for
    one comparison at a time; no pairs are formed but a row's nine cells.
    """
    size, worth = options.position_tolerance, options.strategies.get("position", 0.30)
    if worth < options.confidence_threshold:
        return base.sparkSession.createDataFrame([], FOUND)

    def claim(key: tuple, b: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        cells: dict[tuple, list[int]] = {}
        c = c.sort_values("idx")
        x, y, idx = c["x"].to_numpy(float), c["y"].to_numpy(float), c["idx"].to_numpy()
        for k, cell in enumerate(zip(np.floor(x / size), np.floor(y / size), c["tagName"], strict=True)):
            cells.setdefault(cell, []).append(k)
        free, rows = np.ones(len(c), dtype=bool), []
        for r in b.sort_values("idx").itertuples(index=False):
            cx, cy = np.floor(r.x / size), np.floor(r.y / size)
            around = np.array([k for dx in (-1, 0, 1) for dy in (-1, 0, 1) for k in cells.get((cx + dx, cy + dy, r.tagName), ())], dtype=np.int64)
            around = around[free[around]]
            far = np.hypot(x[around] - r.x, y[around] - r.y)
            if len(far) and far.min() < size:
                best = around[int(far.argmin())]
                confidence = max(0.1, 1 - float(far.min()) / size) * worth
                if confidence >= options.confidence_threshold:
                    free[best] = False
                    rows.append((key[0], r.idx, idx[best], "match", "position", confidence))
        return pd.DataFrame(rows, columns=["pair_id", "b_idx", "c_idx", "outcome", "strategy", "confidence"])

    cut = lambda d: d.filter("x is not null and y is not null").select("pair_id", "idx", "tagName", "x", "y").groupBy("pair_id")
    return cut(base).cogroup(cut(other)).applyInPandas(claim, FOUND)


def _without(rows: DataFrame, used: DataFrame, column: str) -> DataFrame:
    return rows.join(used.select("pair_id", F.col(column).alias("idx")).filter("idx is not null").distinct(), ["pair_id", "idx"], "left_anti")


#: Columns that the keyed strategies read; absolute paths are the paths where none were taken.
_KEY_COLUMNS = {"absolute-hpid": ("absoluteHpid", "hpid"), "id": ("elementId",), "css-selector": ("cssSelector",), "xpath": ("xpath",)}


def match(base: DataFrame, other: DataFrame, options: C.MatchOptions = C.MatchOptions()) -> dict[str, DataFrame]:
    """matches, ambiguous, reserved, added and removed.

    Anchors claim first, then the sequence alignment. Its orphans are in no list, as by default the later passes don't see
    them; orphan_recovery passes them on to suffix, key and place. Without alignment the key passes see all that is left.
    Compare rows that an ambiguous row could mean are not added rows of the later passes.

    Elements are read once a side, for a narrow table of keys; that and what each pass finds are written to the shared folder,
    so no pass does the work of those before it again.
    """
    usable = {n: next((k for k in names if k in base.columns and k in other.columns), None) for n, names in _KEY_COLUMNS.items()}
    keys = {"anchor": anchor_key(), "suffix": suffix_key(options.suffix_depth)} | {n: text_key(c) for n, c in usable.items() if c and n in options.strategies}
    places = [c for c in ("x", "y") if c in base.columns and c in other.columns]
    all_b, all_c = (written(d.select("pair_id", "idx", "hpid", "tagName", *places, *[k.alias(f"key {n}") for n, k in keys.items()]), "keys") for d in (base, other))
    matches, ambiguous, reserved = [], [], []

    def claim(b: DataFrame, c: DataFrame, found: DataFrame, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """Notes what a pass found and returns the rows that are left."""
        found = written(found.filter("outcome <> 'orphan'"), "pass")
        matches.append(found.filter("outcome = 'match'"))
        if key is not None:
            ambiguous.append(found.filter("outcome = 'ambiguous'"))
            reserved.append(candidates(c, key, ambiguous[-1]))
        return _without(b, found, "b_idx"), _without(c, matches[-1], "c_idx")

    anchor = F.col("key anchor")
    anchors = keyed(all_b, all_c, anchor, "test-attribute", 1.0, options)
    _, c = claim(all_b, all_c, anchors, anchor)
    b = _without(all_b, matches[0], "b_idx")
    added = removed = None
    if options.alignment:
        walked = written(align(b, c, options), "walked")
        matches.append(walked.filter("outcome = 'match'"))
        added, removed = walked.filter("outcome = 'added'").select("pair_id", F.col("c_idx").alias("idx")), walked.filter("outcome = 'removed'").select("pair_id", F.col("b_idx").alias("idx"))
        lost = walked.filter("outcome = 'orphan'")
        b, c = (d.join(lost.select("pair_id", F.col(k).alias("idx")), ["pair_id", "idx"], "left_semi") for d, k in ((b, "b_idx"), (c, "c_idx")))
    if options.orphan_recovery or not options.alignment:
        if options.alignment:
            found = keyed(b, c, F.col("key suffix"), "suffix-realign", options.suffix, options).filter("outcome = 'match'")
            b, c = claim(b, c, found)
        for name, confidence in sorted(options.strategies.items(), key=lambda x: -x[1]):
            if name == "position" and len(places) == 2:
                b, c = claim(b, c, near(b, c, options))
            elif name in keys:
                key = F.col(f"key {name}")
                b, c = claim(b, c, keyed(b, c, key, name, confidence, options), key)
        rest_c, rest_b = _without(c, reduce(DataFrame.unionByName, reserved), "c_idx").select("pair_id", "idx"), b.select("pair_id", "idx")
        added = rest_c if added is None else added.unionByName(rest_c)
        removed = rest_b if removed is None else removed.unionByName(rest_b)
    columns = ["pair_id", "b_idx", "c_idx", "strategy", "confidence"]
    joined = reduce(DataFrame.unionByName, [m.select(*columns) for m in matches])
    unclear = reduce(DataFrame.unionByName, [a.select("pair_id", "key", "b_idx", "n_candidates", "strategy", "confidence") for a in ambiguous])
    return {"matches": joined, "ambiguous": unclear, "reserved": reduce(DataFrame.unionByName, reserved), "added": added.distinct(), "removed": removed.distinct()}


def match_rate(matched: Column, removed: Column, added: Column) -> Column:
    """Whole percent of matched elements; ambiguous ones don't count; 0 without elements."""
    total = matched + removed + added
    return F.when(total == 0, 0).otherwise(F.floor(100 * matched / total + 0.5)).cast("int")
