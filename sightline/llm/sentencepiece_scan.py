"""SentencePiece BPE encoding and decoding by a max-plus parallel scan.

A list of pieces is the BPE encoding of a text exactly if every two neighbours t, u are: if encoding the string t + u gives
(t, u) again. Encoding thus is the best path (weight 0; every other one weighs minus infinity) through a lattice of pieces.
Giant texts are split into chunks. A chunk's transfer matrix tells, for each piece that may lie over its left cut and each
that may lie over its right cut, the weight of the best path from one to the other; the matrices of a text are combined
associatively in a tree, which fixes the piece over each cut, and each chunk is then traced back on its own.

Where no piece of the vocabulary holds white space behind another character, a cut before such a space is certain: a matrix
then needs only the lattice before the chunk's first and after its last certain cut, and the encodings of the stretches
between certain cuts are remembered by their text.

The model file is a parameter; its pieces and scores are read on the driver and broadcast (a vocabulary's size). A model
that isn't BPE, or that changes characters before it encodes them, is refused.

Defined results
* null and empty texts: one row with no ids;
* U+2581 in a text is encoded like a space, and decoded as one, so that such a text is not its own round trip;
* repeated rows and repeated or null ids each give their own rows; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk; longer texts are split.
CHUNK = 16_384
#: Stretches (and, for matrices, steps) remembered by a worker, in two generations of this size.
CACHE = 80_000
#: Characters whose ids are handed back at once.
FRAME_CHARS = 120_000
MARK = "▁"
#: Table of 2 ** PAIR_BITS steps that a worker has met.
PAIR_BITS = 20


@lru_cache(maxsize=4)
def read_vocabulary(path: str = MODEL) -> dict:
    """Pieces with id and score, and the ids of the 256 bytes, of a SentencePiece BPE model; ValueError for other models."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces, bytes_ = {}, [model.unk_id()] * 256
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            bytes_[int(model.id_to_piece(i)[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = (i, model.get_score(i))
    vocabulary = {"pieces": pieces, "bytes": bytes_}
    encoder, names = Encoder(vocabulary), list(pieces)
    step = max(1, len(names) // 400)
    probes = ["  two  spaces ", "\ttab\nline ", "ﬁ ﬀ ² Ａ é e\u0301", *("".join(names[i : i + 5]).replace(MARK, " ") for i in range(0, len(names), step))]
    if any(model.encode(p) != encoder.encode(MARK + p.replace(" ", MARK)).tolist() for p in probes):
        raise ValueError(f"{path} is no BPE model that takes texts as they are")
    return vocabulary


class Remembered:
    """The latest entries: a full generation becomes the older one, whose entries come back when they are asked for."""

    def __init__(self, size: int = CACHE) -> None:
        self.size, self.newer, self.older = size, {}, {}

    def find(self, key):
        """The value, or None."""
        found = self.newer.get(key)
        if found is None:
            found = self.older.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.newer) >= self.size:
            self.newer, self.older = {}, self.newer
        self.newer[key] = value


class Encoder:
    """Pieces, and characters that only occur within pieces, have numbers; other characters share the number 0."""

    def __init__(self, vocabulary: dict) -> None:
        self.pieces: dict[str, tuple[int, float]] = vocabulary["pieces"]
        self.bytes: list[int] = vocabulary["bytes"]
        self.longest = max(map(len, self.pieces), default=1)
        self.touching = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        alphabet = set("".join(self.pieces))
        alone = "".join(re.escape(chr(i)) for i in range(256) if chr(i) not in alphabet)  # characters that no piece holds: cuts around them are certain
        self.stretches = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+|[{alone}]").findall if alone else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.number = {p: n for n, p in enumerate([*self.pieces, *sorted(alphabet - self.pieces.keys())], 1)}
        self.name = ["", *self.number]
        self.between = next(chr(i) for i in range(len(alphabet) + 1) if chr(i) not in alphabet)
        self.traces: list[tuple | None] = [None] * len(self.name)
        self.met, self.known = Remembered(), Remembered()
        self._index(sorted(alphabet))

    def _index(self, alphabet: list[str]) -> None:
        """Arrays that scanned() reads: characters as small numbers, a tree of the pieces' beginnings, and weights of steps met."""
        self.size = np.array([1, *map(len, self.number)], dtype=np.int32)
        self.id_of = np.array([-1, *(self.pieces[p][0] if p in self.pieces else -1 for p in self.number)], dtype=np.int32)
        self.classes = np.zeros(max(map(ord, alphabet), default=0) + 2, dtype=np.int64)
        self.classes[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.width = len(alphabet) + 1
        node_of = {p[:k]: 0 for p in self.number for k in range(1, len(p) + 1)}
        node_of = {start: i for i, start in enumerate(sorted(node_of), 1)}
        self.ends = np.zeros(len(node_of) + 1, dtype=np.int32)  # the piece that a node ends, or 0
        self.first = np.zeros(self.width, dtype=np.int64)
        keys, nodes = [], []
        for start, i in node_of.items():
            self.ends[i] = self.number.get(start, 0)
            c = int(self.classes[ord(start[-1])])
            if len(start) == 1:
                self.first[c] = i
            else:
                keys.append(node_of[start[:-1]] * self.width + c)
                nodes.append(i)
        order = np.argsort(keys)
        self.moves, self.targets = np.append(np.array(keys, dtype=np.int64)[order], np.iinfo(np.int64).max), np.append(np.array(nodes, dtype=np.int64)[order], 0)
        self.pair_keys, self.pair_fits = np.full(1 << PAIR_BITS, -1, dtype=np.int64), np.zeros(1 << PAIR_BITS, dtype=bool)

    def spelt(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]

    def trace(self, n: int) -> tuple:
        """Merges of a piece on its own, the best score first and of equal ones the leftmost: their scores, the first and the
        last part after each (before them, the first and last character), and whether the piece is what they end in.
        """
        known = self.traces[n]
        if known is None:
            parts = list(self.name[n])
            scores, firsts, lasts = [], [parts[0]], [parts[-1]]
            while len(parts) > 1:
                best, at = -np.inf, -1
                for i in range(len(parts) - 1):
                    found = self.pieces.get(parts[i] + parts[i + 1])
                    if found and found[1] > best:
                        best, at = found[1], i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                scores.append(best)
                firsts.append(parts[0])
                lasts.append(parts[-1])
            known = self.traces[n] = ([*scores, -np.inf], firsts, lasts, len(parts) == 1)
        return known

    def pair_stays(self, before: int, n: int) -> bool:
        """Whether the merges of two pieces side by side go as on their own: none over the border comes first."""
        a, b = self.trace(before), self.trace(n)
        i = j = 0
        while True:
            own, other = a[0][i], b[0][j]
            over = self.pieces.get(a[2][i] + b[1][j])
            if over and over[1] > own and over[1] >= other:
                return False
            if own == other == -np.inf:
                return True
            if own >= other:
                i += 1
            else:
                j += 1

    def steps(self, before: int, n: int) -> bool:
        """Weight of a step in the lattice: True for 0, False for minus infinity. before is 0 at a text's begin and behind a character of no piece."""
        if not n:
            return True
        if not self.trace(n)[3] or not before:
            return self.trace(n)[3]
        return self.name[before][-1] + self.name[n][0] not in self.touching or self.pair_stays(before, n)

    def fits(self, before: str, piece: str) -> bool:
        """steps() of texts, remembered."""
        a, b = self.number.get(before, 0), self.number.get(piece, 0)
        known = self.met.find(a << 24 | b)
        if known is None:
            known = self.steps(a, b)
            self.met.put(a << 24 | b, known)
        return known

    def ending(self, text: str, end: int, low: int) -> Iterator[tuple[int, str]]:
        """Pieces of the vocabulary (and single characters) that end at a place and begin at low or later."""
        for begin in range(end - 1, max(low, end - self.longest) - 1, -1):
            piece = text[begin:end]
            if begin == end - 1 or piece in self.pieces:
                yield begin, piece

    def fitting_all(self, before: np.ndarray, n: np.ndarray) -> np.ndarray:
        """steps() of arrays; those met are kept in a table where a later step may take the place of an earlier one."""
        keys = before.astype(np.int64) << 24 | n
        slots = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        out, new = self.pair_fits[slots], self.pair_keys[slots] != keys
        if new.any():
            fresh, back = np.unique(keys[new], return_inverse=True)
            weights = np.array([self.steps(k >> 24, k & 0xFFFFFF) for k in fresh.tolist()], dtype=bool)
            out[new] = weights[back]
            self.pair_keys[slots[new]], self.pair_fits[slots[new]] = keys[new], out[new]
        return out

    def lattice(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every piece in a text that ends with a character of no piece: its begin, number and length."""
        at = np.arange(len(codes))
        nodes, size, found = self.first[codes], 1, []
        while True:
            on = nodes > 0
            at, nodes = at[on], nodes[on]
            if not len(at):
                break
            n = self.ends[nodes]
            own = n > 0
            found.append((at[own], n[own], np.full(int(own.sum()), size, dtype=np.int32)))
            keys = nodes * self.width + codes[at + size]
            places = np.searchsorted(self.moves, keys)
            nodes = np.where(self.moves[places] == keys, self.targets[places], 0)
            size += 1
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (at, nodes, at)

    def scanned(self, texts: list[str]) -> list[bytes]:
        """Ids along the lattice's only path of weight 0 over each text, as 32-bit numbers.

        One scan from left to right over all of them at once: the encoding of every prefix is the encoding of a shorter one and
        a last piece, so one piece is alive at each place; behind a character of no piece, as at a text's begin, none is (0).
        """
        if not texts:
            return []
        joined = self.between.join([*texts, ""])
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        begins = np.cumsum(sizes + 1) - sizes - 1
        place = np.arange(len(chars)) - np.repeat(begins, sizes + 1)
        begin, n, size = self.lattice(self.classes[np.minimum(chars, len(self.classes) - 1)])
        level = place[begin] + size
        order = np.argsort(level.astype(np.uint16) if len(level) and level.max() < 1 << 16 else level, kind="stable")
        begin, n, end = begin[order], n[order], (begin + size)[order]
        stops = np.searchsorted(level[order], np.arange(1, sizes.max(initial=0) + 2))
        alive = np.zeros(len(chars) + 1, dtype=np.int32)
        for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            fits = self.fitting_all(alive[begin[a:b]], n[a:b])
            alive[end[a:b][fits]] = n[a:b][fits]

        last = np.zeros(len(chars) + 1, dtype=bool)  # ends of pieces on the path
        at, low = begins + sizes, begins
        while len(at):
            on = at > low
            at, low = at[on], low[on]
            last[at] = True
            at = at - self.size[alive[at]]
        at = np.flatnonzero(last)
        ids = self.id_of[alive[at]]
        counts = np.ones(len(at), dtype=np.int64)
        spelt = {i: self.spelt(joined[at[i] - 1]) for i in np.flatnonzero(ids < 0).tolist()}
        for i, own in spelt.items():
            counts[i] = len(own)
        stops = np.append(0, np.cumsum(counts))
        ids = np.repeat(ids, counts)
        for i, own in spelt.items():
            ids[stops[i] : stops[i + 1]] = own
        packed = ids.tobytes()
        edges = (4 * stops[np.searchsorted(at, np.append(begins, len(chars)), side="right")]).tolist()
        return [packed[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def parts(self, text: str) -> list[str]:
        """A marked text cut where no piece can lie over the cut."""
        if not self.cuts:
            return [text]
        if MARK + MARK in text or self.between in text:
            return self.stretches(text)
        return text.replace(MARK, self.between + MARK).split(self.between)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of marked texts (spaces already MARK) that begin and end between pieces."""
        parts, known = list(map(self.parts, texts)), self.known
        ids = {part: known.find(part) for part in set().union(*parts)}
        new = [part for part, found in ids.items() if found is None]
        for part, found in zip(new, self.scanned(new), strict=True):
            ids[part] = found
            if len(part) <= 64:
                known.put(part, found)
        get = ids.__getitem__
        return [np.frombuffer(b"".join(map(get, own)), dtype=np.int32) for own in parts]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def over(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Pieces that may lie over a cut, as characters before it (1 or more) and behind it (0 or more)."""
        return [(back, behind) for back in range(1, min(cut, self.longest) + 1) for behind in range(min(len(text) - cut, self.longest - back) + 1) if back + behind == 1 or text[cut - back : cut + behind] in self.pieces]

    def transfer(self, text: str, left: int, right: int) -> tuple[list, list, np.ndarray]:
        """States over both cuts of the chunk text[left:right], which text goes on around, and the max-plus matrix between them.

        left 0 is the text's begin and right len(text) its end: there the only state is (0, 0), or a piece that ends there.
        """
        ins = self.over(text, left) if left else [(0, 0)]
        outs = self.over(text, right) if right < len(text) else [(b, 0) for b, behind in self.over(text, right) if not behind]
        certain = [i for i in range(left + self.longest, right - self.longest) if text[i] == MARK and text[i - 1] != MARK] if self.cuts else []
        if certain:
            head = self._reach(text[: certain[0]], ins, left, [(b, 0) for b in range(1, self.longest + 1)], certain[0])
            begin = certain[-1]
            tail = self._reach(text[begin:], [(0, 0)], 0, outs, right - begin)
            return ins, outs, head.max(axis=1)[:, None] + tail.max(axis=0)[None, :]
        return ins, outs, self._reach(text, ins, left, outs, right)

    def _reach(self, text: str, ins: list, left: int, outs: list, right: int) -> np.ndarray:
        """Paths from each in-state to each out-state; those of all in-states are followed together, as bits."""
        alive: list[dict[str, int]] = [{} for _ in range(len(text) + 1)]
        floor = left
        for k, (back, behind) in enumerate(ins):
            piece, at = text[left - back : left + behind], left + behind
            alive[at][piece] = alive[at].get(piece, 0) | 1 << k
        direct = {(left - b, left + e): 1 << k for k, (b, e) in enumerate(ins)}
        ends: dict[tuple[int, int], int] = {}
        wanted = {(right - b, right + e) for b, e in outs}
        for end in range(floor + 1, min(len(text), right + self.longest) + 1):
            for begin, piece in self.ending(text, end, floor):
                if begin >= right:
                    continue
                bits = 0
                for before, mask in alive[begin].items():
                    if self.fits(before, piece):
                        bits |= mask
                if bits:
                    alive[end][piece] = alive[end].get(piece, 0) | bits
                    if (begin, end) in wanted:
                        ends[begin, end] = ends.get((begin, end), 0) | bits
        out = np.full((len(ins), len(outs)), -np.inf)
        for j, (b, e) in enumerate(outs):
            bits = ends.get((right - b, right + e), 0) | (direct.get((right - b, right + e), 0))
            for k in range(len(ins)):
                if bits >> k & 1:
                    out[k, j] = 0.0
        return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None]).max(axis=1)


def states_at_cuts(matrices: list[np.ndarray]) -> list[int]:
    """The state at each of the cuts (both ends included) on the best path: products up a tree, then midpoints down."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([product(low[i], low[i + 1]) if i + 1 < len(low) else low[i] for i in range(0, len(low), 2)])
    whole = levels[-1][0]
    first, last = np.unravel_index(int(whole.argmax()), whole.shape)
    states = [int(first), int(last)]
    for low in levels[-2::-1]:
        finer = [states[0]]
        for i in range(0, len(low), 2):
            s, e = states[i // 2], states[i // 2 + 1]
            if i + 1 < len(low):
                finer.append(int((low[i][s] + low[i + 1][:, e]).argmax()))
            finer.append(e)
        states = finer
    return states


def decoding_table(vocabulary: dict) -> list[str]:
    """Text of each id. Bytes below 128 are characters; others are kept as lone surrogates until a text is whole."""
    table = {i: p.replace(MARK, " ") for p, (i, _) in vocabulary["pieces"].items()}
    table |= {i: chr(b) if b < 128 else chr(0xDC00 + b) for b, i in enumerate(vocabulary["bytes"])}
    return [table.get(i, "") for i in range(max(table) + 1)]


def decode_ids(ids: list[int], table: list[str], first: bool = True) -> str:
    """The text of ids; the mark before a text's first word goes if the ids are those of its first chunk."""
    text = "".join(map(table.__getitem__, ids))
    try:
        text.encode()
    except UnicodeEncodeError:
        text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return text[1:] if first and text[:1] == " " else text


def _encoded(shared, check: bool):
    """Rows (id, text, chunk, n_chunks, begin, end) to rows (id, chunk, n_chunks, ids), with round_trip if check is set.

    text[begin:end] is a chunk's own part; what lies around it only served its matrix. The first chunk's text has the
    space in front that the model puts there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = Encoder(shared.value), decoding_table(shared.value)
        for batch in batches:
            texts, chunks, begins, ends = (batch.column(c) for c in ("text", "chunk", "begin", "end"))
            at = 0
            while at < batch.num_rows:
                group, size, first = [], 0, at
                while at < batch.num_rows and size <= FRAME_CHARS:
                    own = texts[at].as_py()[begins[at].as_py() : ends[at].as_py()]
                    group.append(own)
                    size += len(own)
                    at += 1
                found = encoder.encode_all([t.replace(" ", MARK) for t in group])
                stops = np.cumsum([0, *map(len, found)], dtype=np.int32)
                columns = [batch.column(c).slice(first, at - first) for c in ("id", "chunk", "n_chunks")]
                columns.append(pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate(found))))
                if check:
                    firsts = [not c for c in chunks.slice(first, at - first).to_pylist()]
                    columns.append(pa.array([decode_ids(ids.tolist(), table, head) == (t[1:] if head else t) for ids, t, head in zip(found, group, firsts, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "chunk", "n_chunks", "ids", *["round_trip"] * check])

    return run


def _transferred(shared):
    """A chunk's states over both cuts and the matrix between them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                ins, outs, matrix = encoder.transfer(r.text.replace(" ", MARK), r.left, r.right)
                out.append((r.key, r.chunk, [b for b, _ in ins], [e for _, e in ins], [b for b, _ in outs], [e for _, e in outs], (matrix == 0).ravel().tolist()))
            yield pd.DataFrame(out, columns=["key", "chunk", "in_back", "in_over", "out_back", "out_over", "open"])

    return run


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The piece over each cut; rows come sorted by key and chunk.

    A text's matrices are held together, a few hundred bytes for each chunk: a text of 2 GB, the most a cell holds, has 131,072.
    """

    def settled(key: int, rows: list) -> pd.DataFrame:
        m = [np.where(np.array(r.open, dtype=bool).reshape(len(r.in_back), len(r.out_back)), 0.0, -np.inf) for r in rows]
        at = states_at_cuts(m)
        return pd.DataFrame({"key": key, "chunk": [r.chunk for r in rows], "in_at": [int(r.in_over[k]) for r, k in zip(rows, at[:-1], strict=True)], "out_at": [int(r.out_over[k]) for r, k in zip(rows, at[1:], strict=True)]})

    held: list = []
    for batch in batches:
        done = []
        for key, rows in groupby(batch.itertuples(index=False), key=lambda r: r.key):
            if held and held[0].key != key:
                done.append(settled(held[0].key, held))
                held = []
            held += rows
        if done:
            yield pd.concat(done)
    if held:
        yield settled(held[0].key, held)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK, check: bool = False) -> DataFrame:
    """One row per chunk of each input row: id, chunk (from 0), n_chunks, ids (array of int), and with check round_trip:
    whether the ids decode to the very text that they cover.

    Texts of up to `chunk` characters are one chunk and never shuffled. The matrices of longer ones are told apart by
    their text (equal texts have equal matrices), so ids may be repeated or null.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    shared = spark.sparkContext.broadcast(read_vocabulary(model))
    schema = f"id {kind}, chunk int, n_chunks int, ids array<int>" + (", round_trip boolean" if check else "")
    spaced = F.when(F.length(text_col) > 0, F.concat(F.lit(" "), F.col(text_col))).otherwise("")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(spaced, F.lit("")).alias("text"))
    margin = max(map(len, shared.value["pieces"]))
    parts_wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given outright: Spark would join small ones by bytes, not by work

    short = rows.filter(F.length("text") <= chunk).select("id", "text", F.lit(0).alias("chunk"), F.lit(1).alias("n_chunks"), F.lit(0).alias("begin"), F.length("text").alias("end"))
    whole = short.mapInArrow(_encoded(shared, check), schema)

    edge = lambda parts, i, f: F.coalesce(f(F.get(parts, i), F.lit(margin)), F.lit(""))
    part = lambda parts, x, i: F.struct(i.alias("chunk"), F.size(parts).alias("n_chunks"), edge(parts, i - 1, F.right).alias("before"), x.alias("own"), edge(parts, i + 1, F.left).alias("after"))
    parts = let(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)), lambda p: F.transform(p, lambda x, i: part(p, x, i)))
    cut = (
        rows.filter(F.length("text") > chunk)
        .select("id", F.xxhash64("text").alias("key"), F.inline(parts))
        .select("id", "key", "n_chunks", "chunk", F.concat("before", "own", "after").alias("text"), F.length("before").alias("left"), F.length(F.concat("before", "own")).alias("right"))
        .repartition(parts_wanted, "key", "chunk", "id")
    )
    fields = "key long, chunk int, in_back array<int>, in_over array<int>, out_back array<int>, out_over array<int>, open array<boolean>"
    matrices = cut.mapInPandas(_transferred(shared), fields).dropDuplicates(["key", "chunk"])
    states = matrices.repartition(parts_wanted, "key").sortWithinPartitions("key", "chunk").mapInPandas(_combined, "key long, chunk int, in_at int, out_at int")
    placed = cut.join(states, ["key", "chunk"]).select("id", "text", "chunk", "n_chunks", (F.col("left") + F.col("in_at")).alias("begin"), (F.col("right") + F.col("out_at")).alias("end"))
    return whole.unionByName(placed.mapInArrow(_encoded(shared, check), schema)).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str = MODEL, ids_col: str = "ids", chunk_col: str = "chunk", into: str = "decoded") -> DataFrame:
    """encoded with the text of each row's ids; a text is its chunks' texts joined in order. Null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(decoding_table(read_vocabulary(model)))

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ids, chunks in batches:
            yield pd.Series([None if i is None else decode_ids(i.tolist(), shared.value, c == 0) for i, c in zip(ids, chunks, strict=True)], dtype=object)

    return encoded.withColumn(into, text(F.col(ids_col), F.col(chunk_col)))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every chunk; each is decoded where it was encoded and held against its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, check=True).select("doc_id", "chunk", "n_chunks", F.size("ids").alias("n_tokens"), "ids", "round_trip")
