"""Toxicity: a convolutional text classifier trained in Spark tasks (numpy), with thresholds calibrated by language.

Words are hashed into an embedding table; filters of several widths slide over whole texts, are max-pooled, and feed a
logistic unit. Labels are learnt only from rows whose crc32(id as text) mod 5 is not 0: remainders 1 to 3 train, 4
picks the training epoch and calibrates a threshold for each language. A score depends on the text alone; the language picks a threshold.

Every labelled row outside the held-out fold is learnt from, with its whole text. Rows are hashed once, joined with their
labels and dealt to parts of about PART_WORDS words. In each epoch every part takes one pass from the common parameters; what
the parts changed is summed by key and averaged (an embedding over the parts that changed it). Sums are of whole numbers, so
that their order does not matter. The driver holds the parameters only.

Defined results
* null, empty and wordless texts get the score of padding alone;
* without labelled rows of both classes every score is the smoothed share of toxic labels;
* several labels of one id count as toxic if one is; null labels are not learnt from;
* null ids are held out; null or rare languages have the threshold 0.5;
* repeated rows get the same score; an empty table gives an empty result; other columns are not looked at, and an input's own
  column toxicity, toxicity_threshold or toxicity_reject stays with `_input` behind its name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import making_room, stash

#: Words of the labelled rows that one part is expected to hold.
PART_WORDS = 1_000_000
#: Rows, characters of each and of all that labelled_rows brings to the driver at most.
TRAIN_ROWS = 10_000
TRAIN_CHARS = 200_000
TRAIN_TOTAL = 40_000_000
BUCKETS, EMBED, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, EMBED_RATE = 12, 64, 0.01, 0.002
#: Training rows that a bucket needs; the words of rarer ones count as unknown, like padding.
MIN_SEEN = 3
#: Share of words that training hides at random.
HIDDEN = 0.3
#: Letters of a word whose bucket is added to the word's own.
PREFIX = 6
#: Calibration rows that a language needs for a threshold of its own, and the range of thresholds.
LANG_ROWS, THRESHOLDS = 30, (0.3, 0.7)
#: Tokens convolved at once.
SLAB = 40_000
#: Runs of words remembered by a worker, and the characters of the longest.
CACHE, RUN = 500_000, 40
#: Rows of the table that a step of Adam takes at once.
ROWS = 4096

_WORD = re.compile(r"\w+")
_PAD = max(WIDTHS) - 1


class Hasher:
    """Words to two buckets each, of the word and of its first PREFIX letters; bucket 0 is padding.

    Texts are cut at white space, which no word holds; what lies between is looked up with all of its words.
    """

    def __init__(self) -> None:
        self.known = _Known()

    def __call__(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u2").reshape(-1, 2)

    def packed(self, text: str | None) -> bytes:
        """The buckets as bytes, two for each."""
        if len(self.known) > CACHE:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, (text or "").lower().split())) + bytes(4 * _PAD)


class _Known(dict):
    """The buckets of the words of a text without white space; only short ones are remembered."""

    def __missing__(self, run: str) -> bytes:
        out = b"".join((_bucket(w) | _bucket(w[:PREFIX] + "~") << 16).to_bytes(4, "little") for w in _WORD.findall(run))
        if len(run) <= RUN:
            self[run] = out
        return out


def _bucket(key: str) -> int:
    return 1 + zlib.crc32(key.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)


class Network:
    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.p = {"emb": rng.normal(0, 0.1, (BUCKETS, EMBED)).astype(np.float32), "v": rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), "c": np.zeros(1, np.float32)}
        self.p["emb"][0] = 0
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 0.3, (w, EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        z = np.array([self._peaks(t)[0] for t in texts]) @ self.p["v"] + self.p["c"] if texts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def begin(self, seen: np.ndarray, bad: np.ndarray, share: float) -> np.ndarray:
        """Parameters before the first epoch, from the training rows that hold each bucket and the toxic ones of them; the buckets that are known.

        A bucket's embedding begins with its log-odds in the training rows, in a dimension picked by its number, and
        each filter of width 1 reads one dimension: several toxic words then raise several maxima.
        """
        p, known = self.p, (seen >= MIN_SEEN)[:, None].astype(np.float32)
        odds = np.log((bad + 5 * share) / (seen + 5) / share)
        p["emb"][np.arange(BUCKETS), np.arange(BUCKETS) % EMBED] = odds
        known[0] = 0
        p["emb"] *= known
        p["w1"][0] = np.eye(EMBED, FILTERS)
        p["b1"][:] = 0.5 * np.log(share)
        p["v"][:FILTERS], p["c"][0] = 2.0, -2.0
        return known

    def learn(self, texts: list[np.ndarray], toxic: np.ndarray, known: np.ndarray, rng: np.random.Generator) -> None:
        """One pass of Adam on the log loss."""
        p = self.p
        first, second = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
        order = rng.permutation(len(texts))
        for step, at in enumerate(range(0, len(order), BATCH), 1):
            own = order[at : at + BATCH]
            grad = self._gradient([np.where(rng.random((len(texts[i]), 1)) < HIDDEN, 0, texts[i]) for i in own], toxic[own])
            grad["emb"] *= known
            for k, g in grad.items():
                for begin in range(0, len(g), ROWS):
                    own = slice(begin, begin + ROWS)
                    _adam(p[k][own], g[own], first[k][own], second[k][own], step, EMBED_RATE if k == "emb" else RATE)

    def _peaks(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima over one text and their places, a slab at a time; a maximum is rectified, not each output."""
        if len(ids) <= _PAD:
            ids = np.zeros((_PAD + 1, 2), np.int32)
        p, top, place, last = self.p, None, None, len(ids) - _PAD
        filters = np.concatenate([p[f"w{w}"].transpose(0, 2, 1).reshape(-1, EMBED) for w in WIDTHS])
        for begin in range(0, last, SLAB):
            own = ids[begin : begin + SLAB + _PAD]
            n = min(SLAB, last - begin)
            parts, row, best, at = filters @ (p["emb"].take(own[:, 0], axis=0) + p["emb"].take(own[:, 1], axis=0)).T, 0, [], []
            for w in WIDTHS:
                c = parts[row : row + FILTERS, :n]
                for o in range(1, w):
                    c += parts[row + o * FILTERS : row + (o + 1) * FILTERS, o : o + n]
                at.append(c.argmax(axis=1))
                best.append(c[np.arange(FILTERS), at[-1]] + p[f"b{w}"])
                row += w * FILTERS
            at, best = np.concatenate(at) + begin, np.maximum(np.concatenate(best), 0)
            if top is None:
                top, place = best, at
            else:
                top, place = np.maximum(top, best), np.where(best > top, at, place)
        return top, place

    def _gradient(self, texts: list[np.ndarray], toxic: np.ndarray) -> dict[str, np.ndarray]:
        p, pools, places = self.p, [], []
        for t in texts:
            top, place = self._peaks(t)
            pools.append(top)
            places.append(place)
        pool, place = np.array(pools), np.array(places)
        out = 1 / (1 + np.exp(-(pool @ p["v"] + p["c"])))
        d = ((out - toxic) / len(toxic)).astype(np.float32)
        grad = {"v": d @ pool + 1e-4 * p["v"], "c": d.sum(keepdims=True), "emb": np.zeros_like(p["emb"])}
        dpool = d[:, None] * p["v"] * (pool > 0)
        starts = np.cumsum([0, *[len(t) for t in texts[:-1]]])
        ids = np.concatenate([*texts, np.zeros((_PAD, 2), np.int32)])
        for j, w in enumerate(WIDTHS):
            own = slice(j * FILTERS, (j + 1) * FILTERS)
            g, where = dpool[:, own], starts[:, None] + place[:, own]
            grad[f"b{w}"], grad[f"w{w}"] = g.sum(axis=0), np.zeros_like(p[f"w{w}"])
            for o in range(w):
                at = ids[where + o]
                grad[f"w{w}"][o] = np.einsum("df,dfe->ef", g, p["emb"][at[..., 0]] + p["emb"][at[..., 1]])
                for k in (0, 1):
                    np.add.at(grad["emb"], at[..., k].ravel(), (g[..., None] * p[f"w{w}"][o].T).reshape(-1, EMBED))
        return grad


def _adam(x: np.ndarray, g: np.ndarray, first: np.ndarray, second: np.ndarray, step: int, rate: float) -> None:
    """Moves x, first and second in place; g is used up."""
    t = g - first
    t *= 0.1
    first += t
    np.multiply(g, g, out=t)
    t -= second
    t *= 0.01
    second += t
    np.divide(second, 1 - 0.99**step, out=t)
    np.sqrt(t, out=t)
    t += 1e-6
    np.divide(first, 1 - 0.9**step, out=g)
    g *= rate
    g /= t
    x -= g


def fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str, rows: int = TRAIN_ROWS, chars: int = TRAIN_TOTAL) -> pd.DataFrame:
    """At most `rows` labelled rows outside the held-out fold, `chars` characters in all, whole texts, in a fixed order: to look at; nothing is fitted on them."""
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & (fold(id_col) != 0)).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.filter(F.length(text_col) <= TRAIN_CHARS).select(F.col(id_col), F.col(text_col).alias("text"), lang.alias("lang"))
    met = texts.join(F.broadcast(picked), id_col).withColumn("place", F.xxhash64(id_col, "text"))  # `rows` ids at most
    sizes = met.select("place", F.length("text").alias("n")).orderBy("place").limit(rows)
    last = sizes.select("place", F.sum("n").over(Window.orderBy("place")).alias("n")).filter(F.col("n") <= chars).agg(F.max("place")).first()[0]  # a running sum over `rows` lengths
    return met.filter(F.col("place") <= F.lit(last).cast("long")).select(id_col, "text", "lang", "toxic", fold(id_col).alias("fold"), "place").orderBy("place").limit(rows).drop("place").toPandas()


def hashed_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str, part_words: int = PART_WORDS) -> DataFrame:
    """All labelled rows outside the held-out fold: part, place in it, held (for calibration), toxic, lang, and the whole text's buckets as bytes."""

    @F.pandas_udf("binary")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher()
        for texts in batches:
            yield pd.Series([hasher.packed(t) for t in texts], dtype=object)

    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & (fold("__id") != 0)).groupBy("__id").agg(F.max("toxic").alias("toxic"))
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), lang.alias("lang")).filter(fold("__id") != 0)
    met = texts.join(known.hint("merge"), "__id")  # one way at every size
    rows = stash(met.select(F.xxhash64("__id", "text").alias("place"), (fold("__id") == 4).alias("held"), "toxic", "lang", ids_of("text").alias("ids")), "labelled")
    n_parts = max(1, round((rows.agg(F.sum(F.length("ids"))).first()[0] or 0) / 4 / part_words))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "place"), F.lit(n_parts)).cast("int"))
    return stash(dealt.repartition(n_parts, "part").sortWithinPartitions("part", "place", "ids"), "labelled-parts")


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    """The rows of each part, which lie behind one another, with their buckets as arrays."""
    part, held = None, []
    for batch in batches:
        for number, rows in batch.groupby("part", sort=True):
            if number != part and held:
                yield part, pd.concat(held)
                held = []
            part = number
            held.append(rows.assign(ids=[np.frombuffer(x, "<u2").reshape(-1, 2) for x in rows["ids"]]))
    if held:
        yield part, pd.concat(held)


#: Changes are summed as whole multiples of this.
UNIT = 2.0**-32
#: Values of a row that tasks hand in, and the keys of the loss and of the first parameters that are not embeddings.
_VALUES, _LOSS, _DENSE = [f"d{i}" for i in range(EMBED)], -1, -2
_CHANGES = "key int, n long, " + ", ".join(f"{v} long" for v in _VALUES)


def _dense(p: dict[str, np.ndarray]) -> np.ndarray:
    """All parameters but the embeddings, in rows of EMBED."""
    flat = np.concatenate([p[k].ravel() for k in sorted(p) if k != "emb"]).astype(np.float64)
    return np.append(flat, np.zeros(-len(flat) % EMBED)).reshape(-1, EMBED)


def _add_dense(p: dict[str, np.ndarray], rows: np.ndarray) -> None:
    flat, at = rows.ravel(), 0
    for k in sorted(p):
        if k != "emb":
            p[k] = (p[k] + flat[at : at + p[k].size].reshape(p[k].shape)).astype(np.float32)
            at += p[k].size


def _changes(keys: np.ndarray, n: int, values: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame(n * np.rint(values / UNIT).astype(np.int64), columns=_VALUES)
    out.insert(0, "n", n)
    out.insert(0, "key", keys.astype(np.int32))
    return out


def _loss(network: Network, rows: pd.DataFrame) -> pd.DataFrame:
    """The summed log loss of the rows held for calibration."""
    q, y = np.clip(network.scores(list(rows["ids"])), 1e-6, 1 - 1e-6), rows["toxic"].to_numpy()
    out = np.zeros((1, EMBED))
    out[0, 0] = -np.where(y == 1, np.log(q), np.log(1 - q)).mean()
    return _changes(np.array([_LOSS]), len(rows), out)


def _pass(shared, epoch: int, learning: bool, seed: int = 5):
    """The loss of the common parameters, and what a pass over each part changes in them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given, known = shared.value
        for part, rows in _parts(batches):
            network = Network()
            network.p = {k: x.copy() for k, x in given.items()}
            held, own = rows[rows["held"]], rows[~rows["held"]]
            if len(held):
                yield _loss(network, held)
            if learning and len(own):
                used = np.unique(np.concatenate([np.zeros(1, np.uint16), *[x.ravel() for x in own["ids"]]]))  # a part's own rows of the table are enough
                at = np.zeros(BUCKETS, np.int32)
                at[used] = np.arange(len(used))
                network.p["emb"] = given["emb"][used]
                network.learn([at[x] for x in own["ids"]], own["toxic"].to_numpy(np.float32), known[used], np.random.default_rng([seed, epoch, part]))
                moved = np.flatnonzero((network.p["emb"] != given["emb"][used]).any(axis=1))
                yield _changes(used[moved], len(own), network.p["emb"][moved].astype(np.float64) - given["emb"][used[moved]])
                dense = _dense(network.p) - _dense(given)
                yield _changes(_DENSE - np.arange(len(dense)), len(own), dense)

    return run


def _seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each bucket the training rows that hold it, and the toxic ones of them."""
    seen, bad = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for ids, y in zip(batch["ids"], batch["toxic"], strict=True):
            own = np.unique(np.frombuffer(ids, "<u2"))
            seen[own] += 1
            bad[own] += int(y == 1)
    at = np.flatnonzero(seen)
    yield pd.DataFrame({"bucket": at.astype(np.int32), "seen": seen[at], "bad": bad[at]})


def best_threshold(hits: np.ndarray, right: np.ndarray, toxic: int) -> float:
    """The threshold of the best F1, nearest to 0.5, within THRESHOLDS, from the rows that reach each and the toxic ones of them."""
    best, at = -1.0, 0.5
    grid = np.linspace(*THRESHOLDS, len(hits))
    for i in sorted(range(len(grid)), key=lambda i: abs(grid[i] - 0.5)):
        f1 = 2 * right[i] / max(1, hits[i] + toxic)
        if f1 > best + 1e-9:
            best, at = f1, float(grid[i])
    return at


def calibrated(rows: DataFrame, network: Network) -> dict[str, float]:
    """Thresholds by language, from all rows held for calibration."""
    shared = rows.sparkSession.sparkContext.broadcast(network.p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Network()
        own.p = shared.value
        for batch in batches:
            yield pd.DataFrame({"lang": batch["lang"], "toxic": batch["toxic"], "score": own.scores([np.frombuffer(x, "<u2").reshape(-1, 2) for x in batch["ids"]])})

    scored = rows.filter("held and lang is not null").select("lang", "toxic", "ids").mapInPandas(run, "lang string, toxic int, score double")
    grid = [float(t) for t in np.linspace(*THRESHOLDS, 41)]
    bad = F.col("toxic") == 1
    counts = [F.array(*[F.count_if(also & (F.col("score") >= t)) for t in grid]).alias(name) for name, also in (("hits", F.lit(True)), ("right", bad))]
    by_lang = scored.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), *counts).filter((F.col("n") >= LANG_ROWS) & (F.col("bad") > 0) & (F.col("bad") < F.col("n")))
    return {r.lang: best_threshold(np.array(r.hits), np.array(r.right), r.bad) for r in by_lang.collect()}


def fitted(rows: DataFrame) -> tuple[Network, dict[str, float]]:
    """The network and the thresholds by language, from all of hashed_rows; the epoch with the least loss on the rows held for calibration stays."""
    network, context = Network(), rows.sparkSession.sparkContext
    learn = ~F.col("held")
    n, bad, n_learn, bad_learn = rows.agg(F.count("*"), F.count_if(F.col("toxic") == 1), F.count_if(learn), F.count_if(learn & (F.col("toxic") == 1))).first()
    if not 0 < bad_learn < n_learn:
        network.p["v"][:] = 0
        share = (bad + 0.1) / (n + 1)
        network.p["c"][0] = np.log(share / (1 - share)) if n else -2.0
        return network, {}
    counts = rows.filter(learn).select("toxic", "ids").mapInPandas(_seen, "bucket int, seen long, bad long").groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad")).toArrow()  # columns: as rows, they would take many times the memory
    seen, of_bad, at = np.zeros(BUCKETS), np.zeros(BUCKETS), counts["bucket"].to_numpy()
    seen[at], of_bad[at] = counts["seen"].to_numpy(), counts["bad"].to_numpy()
    known = network.begin(seen, of_bad, bad_learn / n_learn)
    least, best = np.inf, network.p
    for epoch in range(EPOCHS + 1):
        shared = context.broadcast((network.p, known))
        found = rows.mapInPandas(_pass(shared, epoch, epoch < EPOCHS), _CHANGES).groupBy("key").agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in _VALUES]).toArrow()
        shared.destroy()
        keys, n_rows = found["key"].to_numpy(), found["n"].to_numpy()
        mean = np.stack([found[v].to_numpy() / n_rows for v in _VALUES], axis=1) * UNIT
        loss = float(mean[keys == _LOSS, 0][0]) if (keys == _LOSS).any() else -float(epoch)
        if epoch and loss < least:
            least, best = loss, network.p
        if epoch < EPOCHS:
            network.p = {k: x.copy() for k, x in network.p.items()}
            network.p["emb"][keys[keys >= 0]] += mean[keys >= 0].astype(np.float32)
            dense = keys <= _DENSE
            _add_dense(network.p, mean[dense][np.argsort(-keys[dense])])
    network.p = best
    return network, calibrated(rows, network)


def _scorer(docs: DataFrame, network: Network):
    shared = docs.sparkSession.sparkContext.broadcast(network.p)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, hasher = Network(), Hasher()
        own.p = shared.value
        for texts in batches:
            parts, group, chars = [], [], 0
            for t in texts:
                group.append(hasher(t))
                chars += len(group[-1])
                if chars > 4 * SLAB:
                    parts.append(own.scores(group))
                    group, chars = [], 0
            yield pd.Series(np.concatenate([*parts, own.scores(group)]))

    return score


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_col: str) -> tuple[Column, Column]:
    """The score, and the threshold of a row's language."""
    network, thresholds = fitted(hashed_rows(docs, labels, id_col, text_col, lang_col, label_col))
    threshold = F.lit(0.5)
    for lang, t in thresholds.items():
        threshold = F.when(F.col(lang_col) == lang, t).otherwise(threshold)
    return _scorer(docs, network)(F.col(text_col)), threshold


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> DataFrame:
    """docs with toxicity (the score), toxicity_threshold (its language's) and toxicity_reject."""
    score, threshold = _judged(docs, labels, id_col, text_col, lang_col, label_col)
    kept = making_room(docs, "toxicity", "toxicity_threshold", "toxicity_reject")
    return kept.withColumn("toxicity", score).withColumn("toxicity_threshold", threshold).withColumn("toxicity_reject", F.col("toxicity") >= F.col("toxicity_threshold"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> DataFrame:
    """docs, column by column as they are, without the rows whose score reaches their language's threshold."""
    score, threshold = _judged(docs, labels, id_col, text_col, lang_col, label_col)
    return docs.filter(score < threshold)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "toxicity_threshold", "toxicity_reject")
