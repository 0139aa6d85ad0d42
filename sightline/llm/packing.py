"""Packing token sequences: shortest pack first over the histogram of lengths.

A document is its ids and a closing id 0. It is cut at multiples of the sequence's size, so only its last piece is shorter;
pieces are written with their lengths. The histogram of lengths, which has `size` entries at most, is packed on the driver:
lengths are placed longest first, all pieces of one length at a time, each onto the packs with the fewest ids so far, and
what is counted is how many packs follow a pattern of lengths. A pattern's places of one length take a range of that
length's ranks, and documents find their sequence by rank: a piece's rank within its length is its number within the task
that wrote it plus those of the tasks before, so no length's pieces ever meet in one task.

Defined results
* a null or empty text is the closing id alone; special tokens written out in a text are ids like others;
* repeated rows and equal ids are each packed; a null id is kept; other columns are not looked at;
* an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash

#: Ids of a sequence.
SIZE = 1024
#: The id that closes each document.
END_ID = 0
#: Byte-level BPE as ranks: the vocabulary of byte_bpe_50k.json, whose ids are the same (tests hold them against each other).
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPECIAL = {"<|endoftext|>": 50256}
#: Pieces that are handed on in one Arrow batch.
BATCH = 20_000


def tokenizer(path: str = RANKS) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def shortest_pack_first(histogram: Mapping[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(pattern of lengths, number of packs that follow it). At most two patterns arise for each length, whatever the counts."""
    by_space: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s, held in by_space.items() if held), default=0)
            if space < length:
                by_space[size - length].append(((length,), left))
                break
            pattern, packs = by_space[space].pop()
            taken = min(left, packs)
            if taken < packs:
                by_space[space].append((pattern, packs - taken))
            by_space[space - length].append(((*pattern, length), taken))
            left -= taken
    return [held for space in sorted(by_space) for held in by_space[space]]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length an array of (first rank, first sequence, offset), in order of ranks: where the pieces of that length go."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    next_rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, packs in patterns:
        offset = 0
        for length in pattern:
            out[length].append((next_rank[length], sequence, offset))
            next_rank[length] += packs
            offset += length
        sequence += packs
    return {length: np.array(rows, dtype=np.int64) for length, rows in out.items()}


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, ranks: str = RANKS) -> DataFrame:
    """Id, start, length, ids_crc32 and doc_tokens of each piece, and its number (nth) among those of its length in its task (block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, block, seen, last = tokenizer(ranks).encode_to_numpy, TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64), (None, None)
        kind = None
        for batch in batches:
            kind, rows = batch.schema.field(0).type, []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                if text != last[0]:  # copies often follow each other
                    last = text, np.append(encode(text, allowed_special="all"), END_ID).astype("<u4")
                ids = last[1]
                for start in range(0, len(ids), size):
                    cut = ids[start : start + size]
                    rows.append((i, start, len(cut), zlib.crc32(cut.tobytes()), len(ids), seen[len(cut)]))
                    seen[len(cut)] += 1
                if len(rows) >= BATCH or i == batch.num_rows - 1:
                    at, *columns = np.array(rows, dtype=np.int64).T
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *[pa.array(c) for c in columns], pa.array(np.full(len(at), block))], names=["id", "start", "length", "ids_crc32", "doc_tokens", "nth", "block"])
                    rows = []

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, nth long, block long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, ranks: str = RANKS) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    spark = docs.sparkSession
    cut = stash(pieces(docs, id_col, text_col, size, ranks), "pieces")
    counts = cut.groupBy("block", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `size` rows at most
    shared = spark.sparkContext.broadcast(places(shortest_pack_first(histogram, size)))  # two patterns a length at most, of `size` pieces each at most
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))  # a row per task and length

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1)) if len(order) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                at = order[a:b]
                held = shared.value[int(length[at[0]])]
                row = held[np.searchsorted(held[:, 0], rank[at], side="right") - 1]
                sequence[at], offset[at] = row[:, 1] + rank[at] - row[:, 0], row[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    ranked = cut.join(begins, ["block", "length"]).select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("begin") + F.col("nth")).alias("rank"))
    placed = ranked.mapInArrow(find, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
