"""Stupid-backoff scores from n-gram counts.

The model is the corpus itself, each document scored by the counts of the others: a count c is that
of the whole corpus less the document's own. For a word w after a context u of up to order - 1 words,

    S(w | u) = c(u w) / c(u)              if c(u w) > 0
             = backoff * S(w | u')        otherwise, u' being u without its first word
    S(w)     = c(w) / N                   and 1 / (N + 1) for words of no other document

1. Texts are put together to chunks, a row each, in a table that is bucketed by chunk, so that later joins by chunk don't
   shuffle it. Equal texts of one chunk are one, with the ids of all.
2. Each chunk sends its distinct n-grams, sorted, with how often they stand there: a row for each bucket of hashes. One task a
   bucket sums them and answers each chunk with how often the others hold its n-grams.
3. Words and pairs go first. Longer n-grams go level by level, and only those of which both parts one word shorter stand
   in other documents: where a part stands nowhere else, the n-gram doesn't either, so its count is 0 without asking.
4. Each chunk, joined to its answers, scores its documents.

An n-gram's key is a hash of 62 bits, so two different ones share a key, and their counts, with a
chance of about n / 4.6e18 each among n. Nothing is capped or sampled, and nothing passes
through the driver but the number of words. A bucket's rows are one a chunk, however frequent an n-gram is, and buckets
follow the number of words, so that one stays of one size.

Defined cases: null and empty texts have 0 words, score 0 and a null perplexity; the first words of a
text have the shorter contexts that stand before them; rows repeated whole, or of one doc_id, are
documents of their own, and copies lend each other their counts; null ids stay; a text of any
length is scored whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, partitions, release_memory, task_place
from .textpack import LOWER, MIX, buffer_of, finish, slices, span_hashes, word_counts, word_spans

BACKOFF = 0.4
ORDER = 3
WORDS_PER_CHUNK, WORDS_PER_BUCKET = 1_000_000, 1_000_000
#: Bits of a key; a chunk's million keys then lie less than 48 bits apart.
BITS = 62
CHUNKS = "chunk long, n_words long, ids array<array<long>>, texts array<string>"
#: The n-grams of a level that a chunk has in a bucket of hashes: how many, and packed their keys and how often each stands there.
SENT = "bucket int, level int, chunk long, n int, keys binary, times binary"
#: How often other chunks hold them.
ANSWERS = "chunk long, level int, bucket int, n int, elsewhere binary"


def _pack(values: np.ndarray) -> bytes:
    """Numbers in as few whole bytes as the largest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(data) // n] = np.frombuffer(data, np.uint8).reshape(n, -1)
    return out.view("<u8").reshape(n)


def chunks(texts: DataFrame, most: int) -> DataFrame:
    """CHUNKS rows of doc_id and text: texts in lower case, each once a chunk, with the ids of its copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = task_place()
        known, ids, held, total = {}, [], [], 0

        def out() -> pa.RecordBatch:
            partition, number = next(place)
            columns = [pa.array([partition << 32 | number]), pa.array([total]), pa.array([ids], pa.list_(pa.list_(pa.int64()))), pa.array([held], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "n_words", "ids", "texts"])

        for batch in slices(batches, "text"):
            data, offsets = buffer_of(batch.column("text"))
            data = LOWER[data]
            counts = word_counts(word_spans(data, offsets)[0], offsets).tolist()
            for d, doc in enumerate(batch.column("doc_id").to_pylist()):
                text = data[offsets[d] : offsets[d + 1]].tobytes()
                total += counts[d]
                name = hashlib.blake2b(text, digest_size=16).digest()
                if name in known:
                    ids[known[name]].append(doc)
                    continue
                known[name] = len(ids)
                ids.append([doc])
                held.append(text.decode())
                if total >= most or len(ids) >= 50_000:
                    yield out()
                    known, ids, held, total = {}, [], [], 0
        if ids:
            yield out()

    return texts.mapInArrow(run, CHUNKS)


class _Chunk:
    """The words of a chunk's row, and its n-grams level by level."""

    def __init__(self, ids: list[list], texts: pa.Array, buckets: int):
        data, offsets = buffer_of(texts)
        starts, ends = word_spans(data, offsets)
        self.ids, self.buckets = ids, buckets
        self.counts, self.words = word_counts(starts, offsets), span_hashes(data, starts, ends)
        self.copies = np.array([len(x) for x in ids], np.int64)
        self.owner, self.ends = np.repeat(np.arange(len(self.counts)), self.counts), np.repeat(np.cumsum(self.counts), self.counts)

    def grams(self, level: int, before: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """(places where the level's n-grams begin, their keys, their texts), by key and then as they stand.

        before: how often other documents hold the n-gram of one word less that begins at each place.
        """
        m = max(len(self.words) - level + 1, 0)
        keys = np.zeros(m, np.uint64)
        for k in range(level):
            keys = finish(keys * MIX[7] + self.words[k : k + m] + MIX[31 + k])
        fits = np.arange(m) + level <= self.ends[:m]
        if before is not None:
            fits &= (before[:m] > 0) & (before[1 : m + 1] > 0)
        at = np.flatnonzero(fits)
        keys = keys[at] >> np.uint64(64 - BITS)
        order = np.argsort(keys, kind="stable")
        at = at[order]
        return at, keys[order], self.owner[at]

    def _numbers(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        return new, np.cumsum(new) - 1

    def sent(self, chunk: int, level: int, before: np.ndarray | None) -> Iterator[tuple]:
        """SENT rows of a level."""
        _, keys, owner = self.grams(level, before)
        new, number = self._numbers(keys)
        times, distinct = np.bincount(number, self.copies[owner]).astype(np.int64), keys[new]
        step = -(-(1 << BITS) // self.buckets)
        edges = np.searchsorted(distinct, np.arange(self.buckets + 1, dtype=np.uint64) * np.uint64(step))
        for b in np.flatnonzero(np.diff(edges)):
            part = distinct[edges[b] : edges[b + 1]]
            gaps = np.diff(part, prepend=np.uint64(int(b) * step))
            yield int(b), level, chunk, len(part), _pack(gaps), _pack(times[edges[b] : edges[b + 1]])

    def others(self, level: int, before: np.ndarray | None, elsewhere: np.ndarray) -> np.ndarray:
        """For each place, how often other documents hold the n-gram that begins there; elsewhere: how often other chunks hold each distinct one."""
        at, keys, owner = self.grams(level, before)
        new, number = self._numbers(keys)
        fresh = new.copy()
        fresh[1:] |= owner[1:] != owner[:-1]
        own = np.bincount(np.cumsum(fresh) - 1)  # by n-gram and text
        totals = np.bincount(number, self.copies[owner]).astype(np.int64) + elsewhere.astype(np.int64)
        out = np.zeros(len(self.words) + 1, np.int64)
        out[at] = totals[number] - np.repeat(own, own)
        return out


def _answered(table: pa.Table) -> dict[int, np.ndarray]:
    """By level, how often other chunks hold a chunk's n-grams in the order of their keys."""
    rows = sorted(zip(*[table.column(c).to_pylist() for c in ("level", "bucket", "n", "elsewhere")], strict=True), key=lambda r: r[:2])
    out: dict[int, list[np.ndarray]] = {}
    for level, _, n, data in rows:
        out.setdefault(level, []).append(_unpack(pa.decompress(data[4:], int.from_bytes(data[:4], "little"), "zstd", asbytes=True), n))
    return {level: np.concatenate(parts) for level, parts in out.items()}


def _sums(table: pa.Table) -> pa.Table:
    """ANSWERS rows to the SENT rows of one bucket."""
    rows = [table.column(c).to_pylist() for c in ("level", "chunk", "n", "keys", "times")]
    # a bucket's keys begin at its floor, which is the same for all of its rows
    keys = np.concatenate([np.cumsum(_unpack(k, n)) for n, k in zip(rows[2], rows[3], strict=True)])
    times = np.concatenate([_unpack(t, n) for n, t in zip(rows[2], rows[4], strict=True)]).astype(np.int64)
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    begin = np.flatnonzero(new)
    totals = np.repeat(np.add.reduceat(times[order], begin), np.diff(np.append(begin, len(keys))))
    elsewhere = np.empty(len(keys), np.int64)
    elsewhere[order] = totals
    elsewhere -= times
    packed, at = [], 0
    for n in rows[2]:
        data = _pack(elsewhere[at : at + n])
        packed.append(len(data).to_bytes(4, "little") + pa.compress(data, "zstd", asbytes=True))
        at += n
    out = pa.table([pa.array(rows[1], pa.int64()), pa.array(rows[0], pa.int32()), table.column("bucket").cast(pa.int32()), pa.array(rows[2], pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "level", "bucket", "n", "elsewhere"])
    release_memory()
    return out


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema.types), schema.types, strict=True)], schema=schema)


_SENT = pa.schema([("bucket", pa.int32()), ("level", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("times", pa.binary())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("score", pa.float64())])


def _chunk_of(table: pa.Table, buckets: int) -> _Chunk:
    texts = table.column("texts").combine_chunks()
    return _Chunk(table.column("ids")[0].as_py(), (texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts).flatten(), buckets)


def _first(buckets: int, order: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """SENT rows of words and pairs of CHUNKS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                chunk, name = _chunk_of(row, buckets), row.column("chunk")[0].as_py()
                for level in range(1, min(order, 2) + 1):
                    yield from _rows(list(chunk.sent(name, level, None)), _SENT).to_batches()
                release_memory()

    return run


def _next(buckets: int, level: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """SENT rows of a level, given the answers to those before."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, answers, before = _chunk_of(left, buckets), _answered(right), None
        for k in range(2, level):
            before = chunk.others(k, before, answers.get(k, np.zeros(0, np.int64)))
        out = _rows(list(chunk.sent(left.column("chunk")[0].as_py(), level, before)), _SENT)
        release_memory()
        return out

    return run


def _scores(buckets: int, order: int, backoff: float, corpus: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """doc_id, n_words, score of a chunk's documents, given the answers of all levels."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, answers = _chunk_of(left, buckets), _answered(right)
        n = len(chunk.words)
        rest = np.maximum(corpus - chunk.counts, 0)[chunk.owner].astype(np.float64)  # words of the other documents, for each place
        below = chunk.others(1, None, answers.get(1, np.zeros(0, np.int64)))
        logs = np.where(below[:n] > 0, np.log(np.maximum(below[:n], 1)) - np.log(np.maximum(rest, 1)), -np.log(rest + 1))
        place = np.arange(n) - (chunk.ends - chunk.counts[chunk.owner])
        for level in range(2, order + 1):
            others = chunk.others(level, below if level > 2 else None, answers.get(level, np.zeros(0, np.int64)))
            m = max(n - level + 1, 0)
            # the n-gram that ends at a word begins level - 1 places before it, as its context does
            found = np.log(np.maximum(others[:m], 1)) - np.log(np.maximum(below[:m], 1))
            last = n - m
            logs[last:] = np.where(others[:m] > 0, found, logs[last:] + np.where(place[last:] >= level - 1, np.log(backoff), 0.0))
            below = others
        sums = np.bincount(chunk.owner, logs, minlength=len(chunk.counts))
        known = [(i, int(chunk.counts[d]), float(sums[d])) for d, held in enumerate(chunk.ids) for i in held]
        release_memory()
        return _rows(known, _SCORES)

    return run


def backoff_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, stash: Stash | None = None) -> DataFrame:
    """doc_id, n_words, score (sum of natural logs), mean_log, perplexity of each row."""
    spark = docs.sparkSession
    stash = stash or Stash(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = stash.put_bucketed(chunks(texts, WORDS_PER_CHUNK), "chunk", partitions(spark))
    corpus = held.agg(F.sum("n_words")).first()[0] or 0
    buckets = int(max(min(partitions(spark), 1 + corpus // 100_000), -(-corpus // WORDS_PER_BUCKET)))

    def answered(sent: DataFrame) -> DataFrame:
        return stash.put(sent.groupBy("bucket").applyInArrow(_sums, ANSWERS), "zstd")

    def joined(answers: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        return held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)

    answers = answered(held.mapInArrow(_first(buckets, order), SENT))
    for level in range(3, order + 1):
        # the places of a level are told by the counts of the pairs and of the levels between
        answers = answers.union(answered(joined(answers.filter("level > 1"), _next(buckets, level), SENT)))
    scored = joined(answers, _scores(buckets, order, backoff, corpus), "doc_id long, n_words long, score double")
    mean = F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words"))
    return scored.select("doc_id", "n_words", "score", mean.alias("mean_log"), F.exp(-mean).alias("perplexity"))
