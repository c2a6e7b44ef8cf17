"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from a passage by a budget of k edits. It is split into k + 1 disjoint
pieces of equal length, one of which any passage within the budget must hold unchanged. Exact
piece hits are found with a rolling hash over every position of every whole text; hits on nearby
diagonals are verified together with Myers' bit-parallel edit distance, in which the item may
start and end anywhere in the text.

Texts are compared in lower case with runs of other characters than letters and digits as one
space (bytes beyond ASCII are kept). The budget of an item of m bytes is the lesser of
max_error * m and m // MIN_PIECE - 1, so that pieces never get shorter than MIN_PIECE bytes. An item
of fewer than MIN_ITEM bytes is a piece of its own: it is met where it stands unchanged, between
the edges of words, and its matches are marked `short`, since a few common letters prove little.

Documents are only scanned, never shuffled. The benchmark is sent to tasks in blocks of at most
BLOCK_BYTES (or one item), each block with a scan of its own, so its size is not limited.

Defined cases: null and blank texts hold nothing; items that are null or without letters and digits
can't stand in a text; repeated items are reported each; rows of a repeated or null doc_id are
reported each; several hits of an item in a text give one row with the least distance, the first of
those, and of hits at one distance the first; `start` and `end` are bytes of the normalised text; a text of any length is searched whole; an empty table, of either kind, gives no matches;
other columns play no part in `leaks` and are all kept by `without_leaks`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textpack import BLOCK, BYTE, MIX, buffer_of, powers, slices

MAX_ERROR = 0.06
MIN_PIECE = 15
MIN_ITEM = 24
KEPT_MASKS = 2_000
BLOCK_BYTES = 16 << 20
BITS = np.uint64(64 - 20)

KEPT = np.zeros(256, dtype=bool)
KEPT[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of the texts as they are compared."""
    data, offsets = buffer_of(pc.utf8_lower(column.cast(pa.large_string()).fill_null("")))
    if not len(data):
        return data, offsets
    letters = KEPT[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = letters[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False  # a space that leads a text goes
    keep = letters | before
    moved = np.concatenate(([0], np.cumsum(keep)))
    out = np.where(letters, data, np.uint8(32))[keep]
    return out, moved[offsets]


class Pieces:
    """The items of one block with their pieces, as tasks use them."""

    def __init__(self, items: list[tuple], max_error: float):
        texts, offsets = normalised(pa.array([t for _, t in items], pa.large_string()))
        self.items = []  # (item id, bytes, budget, length of a piece)
        self.masks: dict[int, dict[int, int]] = {}
        made: dict[int, list[tuple]] = {}  # by the number of bytes that are hashed
        up, _ = powers()
        for (item, _), a, b in zip(items, offsets[:-1], offsets[1:], strict=True):
            body = texts[a:b].tobytes().rstrip(b" ")
            m = len(body)
            if not m:
                continue
            budget = 0 if m < MIN_ITEM else max(0, min(int(max_error * m), m // MIN_PIECE - 1))
            length = m // (budget + 1)
            head = min(length, MIN_PIECE)
            raw = np.frombuffer(body, np.uint8)
            for j in range(budget + 1):
                part = raw[j * length : j * length + head]
                made.setdefault(head, []).append(((BYTE[part] * up[:head]).sum(dtype=np.uint64), len(self.items), j * length))
            self.items.append((item, body, budget, length))
        self.heads = {head: Heads(head, rows) for head, rows in made.items()}

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, low diagonal, high diagonal) of verified piece hits, merged when near."""
        raw = data.tobytes()
        rows = []
        for heads in self.heads.values():
            for p, o, s in heads.found(data):
                _, body, _, length = self.items[o]
                if raw[p : p + length] != body[s : s + length]:
                    continue
                d = int(np.searchsorted(offsets, p, "right")) - 1
                begin, end = int(offsets[d]), int(offsets[d + 1])
                if p + length > end or (len(body) < MIN_ITEM and not ((p == begin or raw[p - 1] == 32) and (p + length == end or raw[p + length] == 32))):
                    continue
                rows.append((d, o, p - s))
        rows.sort()
        i = 0
        while i < len(rows):
            d, o, low = rows[i]
            high, j = low, i + 1
            while j < len(rows) and rows[j][:2] == (d, o) and rows[j][2] - high <= self.items[o][2]:
                high = rows[j][2]
                j += 1
            yield d, o, low, high
            i = j

    def masks_of(self, o: int) -> dict[int, int]:
        """Where each byte stands in an item; made for items that come to be verified."""
        if o not in self.masks:
            if len(self.masks) >= KEPT_MASKS:
                self.masks.clear()
            masks: dict[int, int] = {}
            for i, c in enumerate(self.items[o][1]):
                masks[c] = masks.get(c, 0) | 1 << i
            self.masks[o] = masks
        return self.masks[o]

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, object, int, int, int, bool]]:
        """(document, item id, distance, start, end, short) of the best match of each item in each text."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, o, low, high in self.hits(data, offsets):
            _, body, budget, _ = self.items[o]
            begin, end = int(offsets[d]), int(offsets[d + 1])
            m = len(body)
            if low >= begin and data[low : low + m].tobytes() == body and low + m <= end:
                distance, stop = 0, low + m
            else:
                a, b = max(begin, low - budget), min(end, high + m + budget)
                distance, stop = myers(self.masks_of(o), m, data[a:b].tobytes())
                stop += a
            if distance <= budget and ((d, o) not in best or (distance, stop - begin) < (best[d, o][0], best[d, o][2])):
                best[d, o] = (distance, max(begin, stop - m) - begin, stop - begin) if distance else (0, stop - m - begin, stop - begin)
        for (d, o), (distance, start, stop) in sorted(best.items()):
            yield d, self.items[o][0], distance, start, stop, len(self.items[o][1]) < MIN_ITEM


class Heads:
    """Rolling hashes of the first bytes of pieces, all of one length."""

    def __init__(self, length: int, rows: list[tuple]):
        self.length = length
        keys = np.array([r[0] for r in rows], dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.owner, self.starts = (np.array([r[k] for r in rows], dtype=np.int64)[order] for k in (1, 2))
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[((self.keys * MIX[2]) >> BITS).astype(np.int64)] = True

    def found(self, data: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(position, item, start of the piece in it) wherever the hash of some piece's head stands."""
        up, down = powers()
        step = BLOCK - self.length
        for base in range(0, max(0, len(data) - self.length + 1), step):
            part = data[base : base + BLOCK]
            n = min(step, len(part) - self.length + 1)
            if n <= 0:
                break
            total = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(BYTE[part] * up[: len(part)], out=total[1:])
            key = (total[self.length : self.length + n] - total[:n]) * down[:n]
            at = np.flatnonzero(self.filter[((key * MIX[2]) >> BITS).astype(np.int64)])
            a, b = np.searchsorted(self.keys, key[at], "left"), np.searchsorted(self.keys, key[at], "right")
            for p, low, high in zip((at + base).tolist(), a.tolist(), b.tolist(), strict=True):
                for e in range(low, high):
                    yield p, int(self.owner[e]), int(self.starts[e])


def myers(masks: dict[int, int], m: int, text: bytes) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and where the first such part ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    for i, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, at = score, i
    return best, at


def blocks_of(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """The items in blocks of about `most` bytes."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // most))
    for k in range(n):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, max_error: float = MAX_ERROR) -> DataFrame:
    """(doc_id, item_id, distance, start, end, short): each item that a document holds within its budget."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, distance long, start long, end long, short boolean"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for items in blocks_of(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            pieces = Pieces(sent.value, max_error)
            for batch in slices(batches, "text"):
                ids = batch.column("doc_id").to_pylist()
                found = [(ids[d], *rest) for d, *rest in pieces.matches(*normalised(batch.column("text")))]
                columns = list(zip(*found, strict=True)) or [()] * 6
                kinds = [*[pa.int64()] * 5, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "distance", "start", "end", "short"])

        out = out.union(texts.mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, max_error: float = MAX_ERROR) -> DataFrame:
    """The documents that hold no test item, all columns kept, in one scan for each block of items."""
    spark = docs.sparkSession
    for items in blocks_of(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def run(batches, sent=sent):
            pieces = Pieces(sent.value, max_error)
            for batch in slices(batches, "text"):
                bad = {m[0] for m in pieces.matches(*normalised(batch.column("text")))}
                yield batch.filter(pa.array([d not in bad for d in range(batch.num_rows)], pa.bool_())) if bad else batch

        docs = docs.mapInArrow(run, docs.schema)
    return docs
