"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into a fixed number of slots, the bytes of each slot are summed, and a map from slot to shard is stored
as a table of versions. Each run takes the last version that is stored, edits it where the shards' bytes are no longer near
equal or their number changed, and appends what it made as the next version; earlier versions are never written again.
With more shards, slots move to the new ones alone. Only the map, whose size is the number of slots and never that of the
data, is handled on the driver.

Defined results
* a null or empty text has size 1; a null id is hashed like any other value;
* repeated rows of one id are told apart by their text and a copy number, so that an id with a third of all rows
  spreads over all slots;
* an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, stash

#: Fixed number of virtual slots.
N_SLOTS = 4096
#: Copies of a row that one task deals out at once.
COPIES = 10_000
#: Shards' bytes are near equal while the largest and the smallest differ by this share of the mean at most; the map then stays.
SLACK = 0.02
_MAP = "version int, vslot int, shard int, bytes long"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, size (UTF-8 bytes plus 1), CRC-32 of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))


def slotted(rows: DataFrame, id_col: str = "doc_id", n_slots: int = N_SLOTS) -> DataFrame:
    """Adds the virtual slot (vslot) of each row. Equal rows are counted first and then dealt out by copy number, very many of them in blocks."""
    key = [id_col, "size", "text_crc32"]
    counted = rows.groupBy(*key).count()
    few = counted.filter(F.col("count") <= COPIES).select(*key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("__copy"))
    blocks = counted.filter(F.col("count") > COPIES).select(*key, "count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(COPIES).cast("long"))).alias("__from"))
    many = blocks.repartition(*key, "__from").select(*key, F.explode(F.sequence(F.col("__from") + 1, F.least(F.col("__from") + COPIES, F.col("count")))).alias("__copy"))
    return few.unionByName(many).withColumn("vslot", F.pmod(F.xxhash64(id_col, "text_crc32", "__copy"), F.lit(n_slots)).cast("int"))


def first_map(n_shards: int, n_slots: int = N_SLOTS) -> list[int]:
    """Version 1: slots dealt out in turn."""
    return [slot % n_shards for slot in range(n_slots)]


def resized(slot_map: list[int], slot_bytes: dict[int, int], n_shards: int) -> list[int]:
    """The map for another number of shards. New shards take slots from the fullest ones until they hold the mean; the slots of
    shards that go are dealt to the emptiest. No other slot moves.
    """
    out, size = list(slot_map), lambda slot: slot_bytes.get(slot, 0)
    load, held = [0] * max(n_shards, max(out) + 1), [[] for _ in range(max(n_shards, max(out) + 1))]
    for slot, shard in enumerate(out):
        load[shard] += size(slot)
        held[shard].append(slot)

    def move(slot: int, shard: int) -> None:
        load[out[slot]] -= size(slot)
        held[out[slot]].remove(slot)
        load[shard] += size(slot)
        held[shard].append(slot)
        out[slot] = shard

    old = max(slot_map) + 1
    for slot in sorted((s for shard in held[n_shards:] for s in shard), key=lambda s: (-size(s), s)):
        move(slot, min(range(n_shards), key=lambda k: (load[k], k)))
    mean, share = sum(load) / n_shards, len(out) / n_shards
    for shard in range(old, n_shards):
        while len(held[shard]) < share or load[shard] < mean:
            fullest = max(range(old), key=lambda k: (load[k], len(held[k]), -k))
            fits = [s for s in held[fullest] if load[shard] + size(s) <= mean]
            if not fits:
                break
            move(max(fits, key=lambda s: (size(s), -s)) if load[shard] < mean else min(fits, key=lambda s: (size(s), s)), shard)
    return out


def levelled(slot_map: list[int], slot_bytes: dict[int, int], n_shards: int) -> bool:
    load = [0] * n_shards
    for slot, shard in enumerate(slot_map):
        load[shard] += slot_bytes.get(slot, 0)
    return max(load) - min(load) <= SLACK * sum(load) / n_shards


def rebalanced(slot_map: list[int], slot_bytes: dict[int, int], n_shards: int) -> list[int]:
    """The map with slots moved from the heaviest shard to the lightest, while that narrows their gap."""
    out, load = list(slot_map), [0] * n_shards
    for slot, shard in enumerate(out):
        load[shard] += slot_bytes.get(slot, 0)
    moved = True
    while moved:
        moved = False
        high, low = max(range(n_shards), key=lambda s: (load[s], -s)), min(range(n_shards), key=lambda s: (load[s], s))
        gap = load[high] - load[low]
        best = None
        for slot, shard in enumerate(out):
            b = slot_bytes.get(slot, 0)
            if shard == high and 0 < b < gap and (best is None or abs(gap - 2 * b) < best[0]):
                best = (abs(gap - 2 * b), slot, b)
        if best:
            out[best[1]] = low
            load[high] -= best[2]
            load[low] += best[2]
            moved = True
        else:  # no single move helps: swap a slot of the heaviest with a smaller one of the lightest
            ups = sorted((slot_bytes.get(s, 0), s) for s, x in enumerate(out) if x == high)
            downs = sorted((slot_bytes.get(s, 0), s) for s, x in enumerate(out) if x == low)
            j, pick = 0, None
            for b, s in ups:
                while j + 1 < len(downs) and b - downs[j + 1][0] >= gap / 2:
                    j += 1
                for c, t in downs[j : j + 2]:
                    if 0 < b - c < gap and (pick is None or abs(gap - 2 * (b - c)) < pick[0]):
                        pick = (abs(gap - 2 * (b - c)), s, t, b - c)
            if pick:
                _, s, t, b = pick
                out[s], out[t] = low, high
                load[high] -= b
                load[low] += b
                moved = True
    return out


def read_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    """A stored version of the map (the last one by default) and its number; (0, []) where none is stored."""
    try:
        stored = spark.read.schema(_MAP).parquet(path)
    except AnalysisException:  # no such folder yet
        return 0, []
    last = stored.agg(F.max("version")).first()[0] if version is None else version
    rows = stored.filter(F.col("version") == last).orderBy("vslot").collect()  # n_slots rows
    return (last, [r.shard for r in rows]) if rows else (0, [])


def append_map(spark: SparkSession, path: str, version: int, slot_map: list[int], slot_bytes: dict[int, int]) -> None:
    """Stores a version beside the earlier ones, with the slots' bytes that it was made from; it must not be there already."""
    rows = [(slot, shard, slot_bytes.get(slot, 0)) for slot, shard in enumerate(slot_map)]
    spark.createDataFrame(rows, "vslot int, shard int, bytes long").coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def edited_map(spark: SparkSession, path: str, slot_bytes: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> list[int]:
    """The map to place rows by: the last stored version, edited and appended as the next one where it must change."""
    version, now = read_map(spark, path)
    if not version:
        version, now = 1, first_map(n_shards, n_slots)
        append_map(spark, path, version, now, slot_bytes)
    if len(now) != n_slots:
        raise ValueError(f"the map stored at {path} has {len(now)} slots, not {n_slots}")
    new = now
    if max(now) + 1 != n_shards:
        new = resized(now, slot_bytes, n_shards)
    elif not levelled(now, slot_bytes, n_shards):
        new = rebalanced(now, slot_bytes, n_shards)
    if new != now:
        append_map(spark, path, version + 1, new, slot_bytes)
    return new


def shard_by_slots(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Id, size, text_crc32, vslot, shard and the row's place within its shard (slot, gapless from 0).

    The versions of the map lie under map_path; without one, a map of its own begins with slots in turn.
    """
    spark = docs.sparkSession
    rows = stash(slotted(sized(docs, id_col, text_col), id_col, n_slots), "slotted")
    stats = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()  # n_slots rows at most
    slot_bytes, slot_rows = {r.vslot: r.bytes for r in stats}, {r.vslot: r.rows for r in stats}
    edited = edited_map(spark, map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}", slot_bytes, n_shards, n_slots)
    begins, next_of = [], [0] * n_shards
    for slot, shard in enumerate(edited):
        begins.append((slot, shard, next_of[shard]))
        next_of[shard] += slot_rows.get(slot, 0)
    placed = spark.createDataFrame(begins, "vslot int, shard int, __begin long")
    within = F.row_number().over(Window.partitionBy("vslot").orderBy(id_col, "text_crc32", "size", "__copy"))
    return (
        rows.join(F.broadcast(placed), "vslot")  # n_slots rows, whatever the input
        .withColumn("slot", F.col("__begin") + within - 1)
        .select(id_col, "size", "text_crc32", "shard", "slot", "vslot")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = shard_by_slots(docs, 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
