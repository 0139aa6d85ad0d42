"""SimHash near-duplicates with pivot distance tables.

Each text gets a 64-bit fingerprint. For each distinct fingerprint, its Hamming distances to many reference fingerprints
(the pivots) are computed once and stored beside it. Fingerprints that agree on enough blocks of bits meet (every pair
within the radius does, by the pigeonhole principle). Where they meet, they are sorted by their distance to the first pivot,
so that only pairs near in that coordinate are taken up; those of them that differ by more than the radius in any other
coordinate go (triangle inequality), and XOR with a bit count verifies the survivors. Links become components.

Defined results
* null, empty or blank texts: fingerprint zero, linked like any other;
* fewer words than a shingle has: the whole sequence is the one shingle;
* equal texts share a fingerprint and are linked through it; repeated ids are fine, the component's id is the smallest id;
* null ids: they take part, and a component of null ids only has a null id;
* an empty table gives an empty result; other columns are not looked at.

The stage that drops near-duplicates asks for a Jaccard similarity of the shingle sets. At 0.8 fingerprints of 64 bits differ
by about 10 and at times by 20, which no choice of blocks covers at a bearable number of keys. It goes the same way with
fingerprints of WIDE bits, of which a pair at 0.8 differs in 15 % (unlike sets in half): those meet that agree on all bits of one
of many drawn choices (as many as let a pair at 0.8 meet with probability 0.998 or more), the pivot tables and the XOR of their
first NEAR bits discard pairs at more than WIDE_RADIUS (4 standard deviations above the mean at 0.8), and what is left makes
components. Within each of them the shingle sets are compared, and only a similarity of the threshold or more is a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, stash

#: Number of reference fingerprints in the pivot tables.
N_PIVOTS = 16
#: Fingerprints that one comparison takes from a bucket; larger buckets are dealt out to pairs of blocks.
BLOCK_ROWS = 4096
#: Fingerprints that a bucket is expected to hold at most; more of them are cut into more blocks of bits.
BUCKET_ROWS = 1024
#: Edges of a node from which on it is a hub, and hubs at most (the least number of edges rises with all edges).
HUB_EDGES, HUBS = 200, 10_000
#: Shingles whose bits are counted at once.
SLAB = 1 << 16
#: Bits of a wide fingerprint, those of them that are carried to where pairs meet, and differing ones of these up to which a pair stays.
WIDE, NEAR, WIDE_RADIUS = 512, 128, 37
#: Bits of a drawn choice at least, wide fingerprints that a bucket is expected to hold at most, and share of bits on which sets of similarity 0.8 agree.
CHOICE, CHOICE_ROWS, AGREE = 12, 256, 0.848
#: Expected number of choices under which a pair at 0.8 meets.
MEETINGS = 7.8
#: Shingles whose bits are counted at once in wide fingerprints, and shingles that one comparison takes from a component.
WIDE_SLAB, BLOCK_SHINGLES = 1 << 12, 1 << 21
_TURN, _FACTOR = np.random.default_rng(11).integers(0, 1 << 64, (2, WIDE // 64), dtype=np.uint64) | np.uint64(1)


def tokens_of(text: str | None) -> list[bytes]:
    """Words, A-Z lower-cased, split at the white space that bytes.split knows (0x20, 0x09-0x0D)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower changes A-Z only


def hashes(tokens: list[bytes], shingle: int, seed: int = 42) -> Iterator[np.ndarray]:
    """The XXH64 of all shingles, repeats included, a slab at a time."""
    n, digest = max(1, len(tokens) - shingle + 1) if tokens else 0, xxhash.xxh64_intdigest
    for begin in range(0, n, SLAB):
        yield np.array([digest(b" ".join(tokens[i : i + shingle]), seed) for i in range(begin, min(n, begin + SLAB))], dtype="<u8")


def majority(slabs: list[np.ndarray]) -> int:
    """The bits that more than half of the hashes have set."""
    n, total = sum(map(len, slabs)), np.zeros(64, dtype=np.int64)
    for h in slabs:
        total += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all shingles; 0 without words."""
    return majority(list(hashes(tokens_of(text), shingle, seed)))


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Id, fingerprint (long), and a hash of the text that tells rows of one id apart."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.select(F.col(id_col), F.xxhash64(text_col).alias("text_hash"), of(F.col(text_col)).alias("fp"))


def pivots(n: int = N_PIVOTS) -> list[int]:
    """Reference fingerprints, as longs: hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), 7) for i in range(n)], dtype=np.uint64).view(np.int64).tolist()


def pivot_distances(fp: Column) -> Column:
    """The fingerprint's row of the pivot table, a byte for each coordinate."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.bit_count(fp.bitwiseXOR(F.lit(p)))), 2, "0") for p in pivots()]))


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of all choices of blocks - radius blocks: two fingerprints within the radius agree under one of them at least."""
    ends = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_pairs(a: np.ndarray, b: np.ndarray, fps: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of rows within the radius: those that a coordinate of the pivot table parts go first."""
    for column in table.T:
        if not len(a):
            break
        keep = np.abs(column[a] - column[b]) <= radius
        a, b = a[keep], b[keep]
    apart = np.bitwise_count(fps[a] ^ fps[b])
    keep = (apart.sum(axis=1) if apart.ndim > 1 else apart) <= radius  # wide fingerprints have several words
    return a[keep], b[keep]


def linked_in_buckets(keys: np.ndarray, fps: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """keys sorted, and within a key the first coordinate of table; for each row the number of the first row of its own bucket that links reach."""
    n, first = len(keys), table[:, 0]
    label, rows = np.arange(n), np.arange(n)
    meets = lambda left, step: left[(keys[left] == keys[left + step]) & (first[left + step] - first[left] <= radius)]
    left, step = meets(rows[:-1], 1), 1
    while len(left):
        a, b = left, left + step
        unlike = label[a] != label[b]
        a, b = near_pairs(a[unlike], b[unlike], fps, table, radius)
        while len(a):
            x, y = label[a], label[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            open_ = low != high
            if not open_.any():
                break
            a, b = a[open_], b[open_]
            np.minimum.at(label, high[open_], low[open_])
            while not np.array_equal(shorter := label[label], label):
                label = shorter
        step += 1
        left = meets(left[left + step < n], step)  # further on in the sorted bucket the first coordinates only move apart
    return label


def _table(distances: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(distances), dtype=np.uint8).reshape(-1, N_PIVOTS).astype(np.int16)


def _links(radius: int, wide: bool = False):
    """Links within buckets as edges from each fingerprint (wide ones: node) to its first; rows come sorted by bucket and distances."""

    def bits(batch: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(batch["fp"]), "<u8").reshape(-1, NEAR // 64) if wide else batch["fp"].to_numpy(np.int64).view(np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, nodes, table = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, N_PIVOTS), np.int16)
        fps = np.zeros((0, NEAR // 64) if wide else 0, np.uint64)

        def edges(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray, table: np.ndarray) -> pd.DataFrame:
            label = linked_in_buckets(keys, fps, table, radius)
            moved = label != np.arange(len(label))
            return pd.DataFrame({"u": nodes[moved], "v": nodes[label[moved]]}).drop_duplicates()

        for batch in batches:
            keys = np.concatenate([keys, batch["bucket"].to_numpy(np.int64)])
            nodes = np.concatenate([nodes, batch["node" if wide else "fp"].to_numpy(np.int64)])
            fps = np.concatenate([fps, bits(batch)])
            table = np.concatenate([table, _table(batch["distances"])])
            other = np.flatnonzero(keys != keys[-1]) if len(keys) else []
            whole = int(other[-1]) + 1 if len(other) else 0  # the last bucket may go on in the next batch
            if whole:
                yield edges(keys[:whole], nodes[:whole], fps[:whole], table[:whole])
                keys, nodes, fps, table = keys[whole:], nodes[whole:], fps[whole:], table[whole:]
        yield edges(keys, nodes, fps, table)

    return run


def blocks_for(n: int, radius: int) -> int:
    """Blocks of bits so that a bucket of n fingerprints' keys is expected to hold BUCKET_ROWS at most; two more than the radius at least."""
    return next((b for b in range(radius + 2, radius + 6) if n / 2 ** (64 * (b - radius) / b) <= BUCKET_ROWS), radius + 6)


def links(distinct: DataFrame, radius: int, blocks: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (columns fp and distances) that join all pairs within the radius, no more than one per row and bucket.

    A bucket of more than block_rows fingerprints is dealt out to all pairs of its blocks, so that no task holds it whole.
    """
    masks = block_masks(radius, blocks)
    spread = distinct.select("fp", "distances", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks]))).select("fp", "distances", F.xxhash64("pos", "col").alias("bucket"))
    return _dealt(spread, "fp", block_rows).mapInPandas(_links(radius), "u long, v long")


def _dealt(spread: DataFrame, by: str, block_rows: int) -> DataFrame:
    """spread (bucket, distances and more) lying by bucket and distances, with buckets of more than block_rows dealt to pairs of blocks."""
    others = [c for c in spread.columns if c != "bucket"]
    heavy = stash(spread.groupBy("bucket").count().filter(F.col("count") > block_rows).select("bucket", F.ceil(F.col("count") / (block_rows // 2)).cast("int").alias("n")), "heavy-buckets")
    own = F.pmod(F.xxhash64(F.lit(1), by), F.col("n")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda other: F.xxhash64("bucket", F.least(own, other), F.greatest(own, other)))
    dealt = spread.join(heavy, "bucket", "left").select(*others, F.explode(F.when(F.col("n").isNull(), F.array("bucket")).otherwise(pairs)).alias("bucket"))
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "distances")


def _with_least(edges: DataFrame, n_edges: int) -> DataFrame:
    """edges (u, v) with m, the least v of each u.

    A hub's edges stay where they lie and get m by broadcast: there are HUBS hubs at most, as each has more than one HUBS-th of all edges.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hub = F.col("n") > max(HUB_EDGES, n_edges // HUBS)
    hubs, others = least.filter(hub).select("u", F.col("m").alias("hub_m")), least.filter(~hub).select("u", "m")
    marked = edges.join(F.broadcast(hubs), "u", "left")
    of_hubs = marked.filter("hub_m is not null").select("u", "v", F.col("hub_m").alias("m"))
    return marked.filter("hub_m is null").select("u", "v").join(others, "u").select("u", "v", "m").unionByName(of_hubs)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v) by alternating large and small stars: node, root (the component's smallest node)."""
    now = stash(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * mark[0]).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _with_least(large, mark[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = stash(small.filter("u <> v").distinct(), "edges")
        before, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """One row per input row: id, text_hash, fp (long), root (the component's own fingerprint) and component_id, the smallest id that links reach."""
    rows = stash(with_fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stash(rows.groupBy("fp").agg(F.min(id_col).alias("__least")).withColumn("distances", pivot_distances(F.col("fp"))), "distinct-fingerprints")
    found = components(links(distinct.select("fp", "distances"), radius, blocks or blocks_for(distinct.count(), radius)))
    rooted = distinct.select("fp", "__least").join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("__least").alias("component_id"))
    of_fp = stash(rooted.join(least, "root").select("fp", "root", "component_id"), "fingerprint-components")
    return rows.join(of_fp, "fp").select(id_col, "text_hash", "fp", "root", "component_id")


def shingle_set(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """The distinct XXH64 of all shingles, ascending."""
    slabs = list(hashes(tokens_of(text), shingle, seed))
    return np.unique(np.concatenate(slabs)) if slabs else np.zeros(0, dtype=np.uint64)


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """WIDE majority bits, as words of 64, of hashes made from the XXH64 of a set's shingles; 0 of the empty set."""
    total = np.zeros(WIDE, dtype=np.int64)
    for begin in range(0, len(shingles), WIDE_SLAB):
        h = (shingles[begin : begin + WIDE_SLAB, None] ^ _TURN) * _FACTOR
        h = (h ^ (h >> np.uint64(32))) * _FACTOR
        h ^= h >> np.uint64(29)
        total += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * total > len(shingles), bitorder="little").view("<u8")


def wide_distances(fps: np.ndarray) -> np.ndarray:
    """Rows of the pivot table, of the first NEAR bits."""
    refs = np.array(pivots(N_PIVOTS * NEAR // 64), dtype=np.int64).view(np.uint64).reshape(N_PIVOTS, -1)
    return np.bitwise_count(fps[:, None, : NEAR // 64] ^ refs).sum(axis=2).astype(np.uint8)


def with_wide(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Id, text_hash, node (a hash of the shingle set, 0 of the empty one), n (its size), and the wide fingerprint with its distances."""

    @F.pandas_udf("node long, n int, fp binary, distances binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_set(t, shingle) for t in texts]
            fps = np.array([wide_fingerprint(own) for own in sets], dtype=np.uint64).reshape(-1, WIDE // 64)
            nodes = np.array([xxhash.xxh64_intdigest(own.tobytes(), 3) if len(own) else 0 for own in sets], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"node": nodes, "n": np.array([len(own) for own in sets], dtype=np.int32), "fp": [x.tobytes() for x in fps], "distances": [x.tobytes() for x in wide_distances(fps)]})

    return docs.select(F.col(id_col), F.xxhash64(text_col).alias("text_hash"), of(F.col(text_col)).alias("s")).select(id_col, "text_hash", "s.*")


def choices_for(n: int) -> np.ndarray:
    """Drawn choices of bits, one a row: more bits, and so more choices, for more fingerprints."""
    bits = next(b for b in range(CHOICE, WIDE) if n / 2**b <= CHOICE_ROWS)
    rng = np.random.default_rng(17)
    return np.array([rng.choice(WIDE, bits, replace=False) for _ in range(int(np.ceil(MEETINGS / AGREE**bits)))])


def wide_links(nodes: DataFrame, n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges (u, v) between nodes (node, fp, distances; n rows) that join all pairs that meet under a choice of bits within WIDE_RADIUS."""
    choices = choices_for(n)
    value = 1 << np.arange(choices.shape[1], dtype=np.int64)

    @F.pandas_udf("array<long>")
    def buckets_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for fps in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(fps), np.uint8).reshape(-1, WIDE // 8), axis=1, bitorder="little")
            keys = np.stack([bits[:, c] @ value for c in choices], axis=1) + (np.arange(len(choices), dtype=np.int64) << 48)
            yield pd.Series(list(keys), dtype=object)

    spread = nodes.select("node", F.substring("fp", 1, NEAR // 8).alias("fp"), "distances", F.explode(buckets_of("fp")).alias("bucket"))
    return _dealt(spread, "node", block_rows).mapInPandas(_links(WIDE_RADIUS, wide=True), "u long, v long")


def similar_in_bucket(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """For each shingle set the number of the first one that links of the threshold or more reach.

    Every pair that is not linked yet is compared.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets])
    ends, label = np.cumsum(sizes), np.arange(n)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner, begins = np.repeat(label, sizes)[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
    for i in range(n - 1):
        after = np.arange(i + 1, n)
        close = after[label[after] != label[i]]
        if not len(close):
            continue
        shared = [owner[begins[c] : begins[c + 1]] for c in code[ends[i] - sizes[i] : ends[i]]]
        both = np.bincount(np.concatenate(shared), minlength=n)[close]
        near = close[both / (sizes[i] + sizes[close] - both) >= threshold]
        if len(near):
            own = np.unique(label[np.append(near, i)])
            label[np.isin(label, own)] = own[0]
    return label


def _similar(threshold: float):
    """Links within buckets as edges from each node to its first; rows come sorted by bucket."""

    def edges(nodes: list[int], sets: list[np.ndarray]) -> pd.DataFrame:
        if len(nodes) < 2:
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        label = similar_in_bucket(sets, threshold)
        moved, own = label != np.arange(len(nodes)), np.array(nodes, dtype=np.int64)
        return pd.DataFrame({"u": own[moved], "v": own[label[moved]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, done = None, ([], []), []
        for batch in batches:
            for bucket, node, own in zip(batch["bucket"], batch["node"], batch["shingles"], strict=True):
                if bucket != key:
                    done.append(edges(*held))
                    key, held = bucket, ([], [])
                for column, value in zip(held, (node, np.array(own, dtype=np.int64)), strict=True):
                    column.append(value)
            if done:
                yield pd.concat(done)
                done = []
        yield edges(*held)

    return run


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per input row: id, text_hash and root, the component's own node; links are pairs of the threshold or more.

    Components of near wide fingerprints come first; within one all pairs are compared by their shingle sets. One of many
    documents or shingles is dealt out to all pairs of its blocks, so that no task holds it whole.
    """

    @F.pandas_udf("array<long>")
    def set_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t, shingle).view(np.int64) for t in texts], dtype=object)

    rows = stash(with_wide(docs, id_col, text_col, shingle), "wide-fingerprints")
    nodes = stash(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("distances").alias("distances"), F.min("text_hash").alias("text_hash")), "distinct-sets")
    near = components(wide_links(nodes.filter("n > 0").select("node", "fp", "distances"), nodes.count(), block_rows)).withColumnRenamed("root", "bucket")
    near = stash(near.unionByName(near.select(F.col("bucket").alias("node"), "bucket").distinct()).join(nodes.select("node", "n", "text_hash"), "node"), "near-sets")
    buckets = near.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n").alias("size"))
    met = near.join(buckets, "bucket").select("bucket", "node", "members", "size")
    texts = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).join(near.select("node", "text_hash"), "text_hash")
    sets = stash(texts.groupBy("node").agg(F.first("text").alias("text")).select("node", set_of("text").alias("shingles")), "candidate-sets")

    n_blocks = F.least("members", F.ceil(F.greatest(2 * F.col("members") / block_rows, 2 * F.col("size") / BLOCK_SHINGLES))).cast("int")
    own = F.pmod(F.xxhash64(F.lit(1), "node"), n_blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda other: F.xxhash64("bucket", F.least(own, other), F.greatest(own, other)))
    whole = (F.col("members") <= block_rows) & (F.col("size") <= BLOCK_SHINGLES)
    dealt = met.select("node", F.explode(F.when(whole, F.array("bucket")).otherwise(pairs)).alias("bucket")).join(sets, "node")
    links = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_similar(threshold), "u long, v long")
    return rows.join(components(links), "node", "left").select(id_col, "text_hash", F.coalesce(F.col("root"), F.col("node")).alias("root"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each component of documents that are similar by threshold or more: that of the smallest id (of several such rows, one)."""
    return keep_one_a_root(docs, similar_components(docs, id_col, text_col, shingle, threshold), id_col, text_col)


def keep_one_a_root(docs: DataFrame, rooted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each root of rooted (id, text_hash, root): the smallest by id, nulls last, then by text_hash; of equal rows one."""
    alike = rooted.groupBy("root", F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).agg(F.count("*").alias("n"))
    least = alike.groupBy("root").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "__hash", "n")).alias("least"))
    kept = stash(least.select("least.__id", "least.__hash", "least.n"), "kept-documents")
    own = free_name(docs, "__row_hash")
    rows = docs.withColumn(own, F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col(own) == F.col("__hash"))
    out = rows.join(kept.filter("n = 1").drop("n"), same, "left_semi")
    tied = kept.filter("n > 1").drop("n")
    if not tied.isEmpty():  # repeated rows: one of each
        out = out.unionByName(rows.join(tied, same, "left_semi").dropDuplicates([id_col, own]))
    return out.drop(own)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs, shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
