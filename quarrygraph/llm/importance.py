"""Importance resampling towards a target: hashed n-grams weigh documents, Gumbel noise draws them.

Features are runs of one to `order` words, each hashed to a bucket by the CRC-32 of its words joined by
a blank. The checksum of each word is computed once. That of a longer run follows by the algebra of CRCs:
crc(A + B) = shift(crc(A), len(B)) ^ crc(B), where a shift by a length is a product of GF(2) matrices
for powers of two bytes. No n-gram is ever written out as a string.

Counts are summed in each task, so a task sends one row a bucket. A bucket's gain compares its share in
the target with that in the corpus; a document's weight is the floored mean of its gains, and its
score adds noise that its id alone tells. The highest scores are drawn, ranked by a range partitioned sort,
so neither the ranking nor the draw passes through one task.

Defined cases: null and empty texts have no features, weight 0, and are drawn only if `min_words` is 0; texts
of any length are read whole; repeated rows are rows of their own and tie; null ids take the noise of an empty id
and come last in ties; an empty corpus gives no rows; an empty target gives every bucket the target's smoothing
alone; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, numbered, release_memory
from .textpack import buffer_of, slices, word_counts, word_spans

#: The most buckets: their gains are sent to every task, 8 bytes each.
MAX_BUCKETS = 1 << 20
POLYNOMIAL = 0xEDB88320
SHORT = 32
#: Letters lower-cased; bytes outside of words become blanks.
CLASS = np.full(256, 0x20, dtype=np.uint8)
CLASS[0x30:0x3A] = np.arange(0x30, 0x3A)
CLASS[0x41:0x5B] = CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
CLASS[0x80:] = np.arange(0x80, 0x100)


def _steps() -> np.ndarray:
    """The checksum register after each byte from an empty register."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), c >> np.uint32(1))
    return c


STEP = _steps()


class Shift:
    """Registers moved over zero bytes: matrices for 1, 2, 4, ... bytes, as tables by byte of the register."""

    def __init__(self):
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        self.columns = [STEP[bits & np.uint32(255)] ^ (bits >> np.uint32(8))]
        self.tables = [self._table(self.columns[0])]

    @staticmethod
    def _table(columns: np.ndarray) -> np.ndarray:
        """table[k][b]: the image of byte b at place k of the register."""
        byte = np.arange(256, dtype=np.uint32)
        table = np.zeros((4, 256), dtype=np.uint32)
        for k in range(4):
            for bit in range(8):
                table[k] ^= np.where(byte >> np.uint32(bit) & np.uint32(1), columns[8 * k + bit], np.uint32(0))
        return table

    @staticmethod
    def _apply(table: np.ndarray, c: np.ndarray) -> np.ndarray:
        byte = np.uint32(255)
        return table[0][c & byte] ^ table[1][c >> np.uint32(8) & byte] ^ table[2][c >> np.uint32(16) & byte] ^ table[3][c >> np.uint32(24)]

    def __call__(self, crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        out = crcs.copy()
        for k in range(int(lengths.max(initial=0)).bit_length()):
            if k == len(self.tables):  # the matrix of twice the bytes is the square
                self.columns.append(self._apply(self.tables[-1], self.columns[-1]))
                self.tables.append(self._table(self.columns[-1]))
            at = np.flatnonzero(lengths >> k & 1)
            out[at] = self._apply(self.tables[k], out[at])
        return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word, byte by byte for all words at once; long words one by one."""
    lengths = ends - starts
    out = np.zeros(len(starts), dtype=np.uint32)
    order = np.argsort(-np.minimum(lengths, SHORT + 1), kind="stable")
    some = lengths[order]
    long = int(np.searchsorted(-some, -SHORT, "left"))
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    order, some = order[long:], some[long:]
    at, c = starts[order], np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(int(some[0]) if len(some) else 0):
        n = int(np.searchsorted(-some, -k, "left"))
        head = c[:n]
        c[:n] = STEP[(head ^ data[at[:n] + k]) & np.uint32(255)] ^ (head >> np.uint32(8))
    out[order] = ~c
    return out


def features(texts: pa.Array, order: int, shift: Shift) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of a run up to `order`, the checksums of all runs and the text of each."""
    data, offsets = buffer_of(texts)
    data = CLASS[data]
    starts, ends = word_spans(data, offsets)
    counts = word_counts(starts, offsets)
    words, lengths = word_crcs(data, starts, ends), ends - starts
    text = np.repeat(np.arange(len(counts)), counts)
    yield words, text
    if order > 1 and len(words):
        blank = np.full(len(words), zlib.crc32(b" "), dtype=np.uint32)
        behind = shift(blank, lengths) ^ words  # of a blank and the word
        runs = words
        for n in range(2, order + 1):
            if len(words) < n:
                return
            runs = shift(runs[:-1], lengths[n - 1 :] + 1) ^ behind[n - 1 :]
            whole = text[: len(runs)] == text[n - 1 :]
            yield runs[whole], text[: len(runs)][whole]


def bucket_counts(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, n): the features of all rows of a text column by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, total = Shift(), np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches, "text"):
            for crcs, _ in features(batch.column("text"), order, shift):
                total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
            release_memory()
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) of every bucket: 1000 times the logarithm of its smoothed share in the target over that in docs, floored."""
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"between 1 and {MAX_BUCKETS} buckets")
    own, aim = bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets)
    both = own.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).union(aim.select("bucket", F.lit(0), "n"))
    zero = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("s"), F.lit(0).alias("t"))
    by = both.union(zero).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    whole = by.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return by.crossJoin(F.broadcast(whole)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # one row of totals


def weigh(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row."""
    table = np.zeros(buckets, dtype=np.int64)
    for row in gains(docs, target, order, buckets).collect():  # a row a bucket, at most MAX_BUCKETS
        table[row["bucket"]] = row["gain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = Shift()
        for batch in slices(batches, "text"):
            n, words, total = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for k, (crcs, text) in enumerate(features(batch.column("text"), order, shift)):
                met = np.bincount(text, minlength=batch.num_rows)
                n += met
                words += met if k == 0 else 0
                bounds = np.concatenate(([0], np.cumsum(met)))
                sums = np.concatenate(([0], np.cumsum(table[crcs % np.uint32(buckets)])))
                total += sums[bounds[1:]] - sums[bounds[:-1]]
            weight = np.floor_divide(total, np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])
            release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return rows.select("*", (F.col("weight") + noise).alias("score"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, stash: Stash | None = None, **options) -> DataFrame:
    """weigh()'s columns and rank: 1, 2, 3, ... of the drawn rows, percent of those of enough words; null elsewhere."""
    stash = stash or Stash(docs.sparkSession)
    rows = stash.put(weigh(docs, target, **options).withColumn("down", -F.col("score")))
    fit = F.col("n_words") >= min_words
    ranked = numbered(rows.filter(fit), ["down", "doc_id"], "nth", stash)
    take = rows.filter(fit).count() * percent // 100
    rank = F.when(F.col("nth") < take, F.col("nth") + 1).cast("long")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    return ranked.select(*columns, rank.alias("rank")).union(rows.filter(~fit).select(*columns, F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that resample() draws; rows of one id stay together if one of them is drawn."""
    ids = resample(docs, target, **options).filter("rank is not null and doc_id is not null").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long") == ids["drawn_id"], "left_semi")
