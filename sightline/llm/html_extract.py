"""HTML extraction by a tree-structured graphical model.

Each block element is a node with one of three states: outside, content, boilerplate. Features give a node's own
potentials; an edge's kind gives the potentials of parent and child. Sum-product messages go up and then down the tree,
for all pages of a batch at once, level by level; the text blocks of nodes whose content marginal is at least 0.5 are
the page's text. The weights are fitted by likelihood on labelled pages (html_pages), in numpy on the driver: their number
is fixed, whatever the input.

Defined results
* null, empty and blank pages, and pages without content: empty text, 0 characters;
* unclosed and stray tags are tolerated; a page cut short gives what it holds;
* repeated pages and repeated or null ids each give their own row; an empty table gives an empty result; other columns are
  not looked at, and one that has the name of the new column stays with `_input` behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import making_room
from .html_pages import labelled_pages
from .html_tree import EDGE_KINDS, N_EDGES, N_FEATURES, Tree, features, parse

STATES = "OCB"
CONTENT = STATES.index("C")
#: Labelled pages to fit on, steps of the fit, its step size and its weight decay.
TRAIN_PAGES, STEPS, STEP, DECAY = 900, 150, 0.1, 2e-5
#: Characters of pages that are decided together.
BATCH_CHARS = 3_000_000


class Forest:
    """Several trees as arrays, their nodes numbered through."""

    def __init__(self, trees: list[Tree]) -> None:
        counts = [len(t.tags) for t in trees]
        self.begins = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.n = int(self.begins[-1])
        self.parents = np.concatenate([[np.array(t.parents, np.int64) + (np.array(t.parents) >= 0) * b for t, b in zip(trees, self.begins, strict=False)] or [np.zeros(0, np.int64)]][0]) if trees else np.zeros(0, np.int64)
        depths = np.array([d for t in trees for d in t.depths], np.int64)
        self.kinds = np.array([EDGE_KINDS.get(tag, 0) for t in trees for tag in t.tags], np.int64)
        order = np.argsort(depths, kind="stable")
        self.levels = np.split(order, np.searchsorted(depths[order], np.arange(1, depths.max() + 1))) if self.n else []
        active = [f for t in trees for f in features(t)]
        self.active = np.array([x for f in active for x in f], np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(f) for f in active])])[:-1].astype(np.int64)
        self.owner = np.repeat(np.arange(self.n), [len(f) for f in active])

    def unary(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.active], self.starts, axis=0) if self.n else np.zeros((0, 3))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def sum_product(forest: Forest, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the nodes' states, and of the pairs of states of parent and child (for each child)."""
    up = forest.unary(weights)
    sent = np.zeros_like(up)
    for level in forest.levels[:0:-1]:
        sent[level] = _lse(edges[forest.kinds[level]] + up[level][:, None, :], 2)
        np.add.at(up, forest.parents[level], sent[level])
    down, pairs = np.zeros_like(up), np.zeros((forest.n, 3, 3))
    for level in forest.levels[1:]:
        p = forest.parents[level]
        joint = (up[p] + down[p] - sent[level])[:, :, None] + edges[forest.kinds[level]]
        down[level] = _lse(joint, 1)
        joint += up[level][:, None, :]
        pairs[level] = np.exp(joint - _lse(joint.reshape(-1, 9), 1)[:, None, None])
    both = up + down
    return np.exp(both - _lse(both, 1)[:, None]) if forest.n else both, pairs


def fit(pages: list[str], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features and of edges of the greatest likelihood (Adam on observed less expected counts)."""
    trees = [parse(p) for p in pages]
    forest = Forest(trees)
    state = np.array([STATES.index(x or "B") for t in trees for x in t.labels])
    seen = np.eye(3)[state]
    child = forest.parents >= 0
    seen_pairs = np.zeros((forest.n, 3, 3))
    seen_pairs[child] = seen[forest.parents[child]][:, :, None] * seen[child][:, None, :]
    at = [np.zeros((N_FEATURES, 3)), np.zeros((N_EDGES, 3, 3))]
    first, second = [np.zeros_like(x) for x in at], [np.zeros_like(x) for x in at]
    for step in range(1, steps + 1):
        nodes, pairs = sum_product(forest, *at)
        gap = (seen - nodes)[forest.owner]
        flat = np.stack([np.bincount(forest.active, gap[:, s], N_FEATURES) for s in range(3)], axis=1)
        edge = np.zeros_like(at[1])
        np.add.at(edge, forest.kinds[child], (seen_pairs - pairs)[child])
        for k, g in enumerate((flat, edge)):
            g = g / len(pages) - DECAY * at[k] * 100
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            at[k] += STEP * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return at[0], at[1]


@lru_cache(maxsize=2)
def trained(n_pages: int = TRAIN_PAGES, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    return fit(labelled_pages(n_pages), steps)


def main_texts(pages: list[str | None], weights: np.ndarray, edges: np.ndarray) -> list[str]:
    """The content blocks of each page, joined by an empty line."""
    trees = [parse(p) for p in pages]
    forest = Forest(trees)
    content = sum_product(forest, weights, edges)[0][:, CONTENT] >= 0.5 if forest.n else []
    return ["\n\n".join(run for node, run in t.runs if content[b + node]) for t, b in zip(trees, forest.begins, strict=False)]


def extract_text(pages: DataFrame, html_col: str = "html", into: str = "main_text", train_pages: int = TRAIN_PAGES) -> DataFrame:
    """pages with the main text of each."""
    shared = pages.sparkSession.sparkContext.broadcast(trained(train_pages))

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out, group, size = [], [], 0
            for page in batch:
                group.append(page)
                size += len(page or "")
                if size > BATCH_CHARS:
                    out += main_texts(group, *shared.value)
                    group, size = [], 0
            out += main_texts(group, *shared.value)
            yield pd.Series(out, dtype=object)

    found = text(F.col(html_col))
    if html_col.lower() == into.lower():
        return pages.withColumn(into, found)
    return making_room(pages, into).withColumn(into, found)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
