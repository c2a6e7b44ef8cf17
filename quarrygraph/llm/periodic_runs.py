"""Periodic runs of words: maximal stretches that repeat with a smallest period.

Every run has a Lyndon root that is the longest Lyndon word at its own first place, in one of two
opposite orders of the words. So a text is scanned from right to left under both orders: a stack
keeps, for each place, where its longest Lyndon word ends; suffixes are compared by the length
that they share, which a binary search over rolling hashes finds, and a root whose first word
stands again a period later is extended to both sides in the same way. What an extension finds is
held against the words themselves. No suffix array is built.

A run of at least `min_exponent` periods and `min_words` words holds each of its groups of three
words several times. Hashed groups that a text holds often enough therefore mark the only
stretches that can hold a run, and the stacks are kept over these alone; with an exponent
under 3 over all words.

Rows are worked on one by one where they are read, without a shuffle. Defined cases: null, empty
and blank texts have no words, no runs and an empty collapsed text; texts of any length are
scanned whole; repeated rows and null ids give a row each; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory
from .textpack import MIX, buffer_of, finish, slices, span_hashes, word_counts, word_spans

MIN_WORDS, MIN_EXPONENT = 6, 4
WORD = r"[^\x20\x09-\x0D]+"
PRIME, BASE = 2**61 - 1, 0x1B873593CC9E2D51
GROUP = 3
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Shared:
    """How far two places of a word sequence go on alike, to the right and to the left."""

    def __init__(self, words: list[int]):
        self.words = words
        self.sums, self.powers = [0], [1]
        total, power = 0, 1
        for w in words:
            total = (total * BASE + w + 1) % PRIME
            power = power * BASE % PRIME
            self.sums.append(total)
            self.powers.append(power)

    def same(self, i: int, j: int, n: int) -> bool:
        power, sums = self.powers[n], self.sums
        return (sums[i + n] - sums[i] * power - sums[j + n] + sums[j] * power) % PRIME == 0

    def right(self, i: int, j: int) -> int:
        """Words that stand alike from i and from j on, i < j."""
        words, most = self.words, len(self.words) - j
        for n in range(min(4, most)):
            if words[i + n] != words[j + n]:
                return n
        return self._search(min(4, most), most, lambda n: self.same(i, j, n))

    def left(self, i: int, j: int) -> int:
        """Words that stand alike before i and before j, i < j."""
        words = self.words
        for n in range(min(4, i)):
            if words[i - n - 1] != words[j - n - 1]:
                return n
        return self._search(min(4, i), i, lambda n: self.same(i - n, j - n, n))

    @staticmethod
    def _search(low: int, most: int, holds) -> int:
        """The largest n up to most for which holds(n), given that low does."""
        step = 8
        while low < most and holds(min(low + step, most)):
            low = min(low + step, most)
            step *= 2
        high = min(low + step, most + 1)
        while high - low > 1:
            middle = (low + high) // 2
            if holds(middle):
                low = middle
            else:
                high = middle
        return low


def runs_of(words: list[int], min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """Sorted (start, length, period) of the runs of a sequence of word numbers."""
    n, shared, found = len(words), Shared(words), set()
    seen: dict[int, tuple[int, int]] = {}  # the last stretch met of each period: what it holds needs no search
    for sign in (1, -1):
        after = [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            j = i + 1
            while j < n:
                x, y = words[i], words[j]
                if x == y:
                    start, end = seen.get(j - i, (n, n))
                    both = end - j if start <= i and j < end else shared.right(i, j)
                    if j + both == n:
                        break  # the later suffix begins the earlier one, so it is the smaller
                    x, y = words[i + both], words[j + both]
                if sign * x > sign * y:
                    break
                j = after[j]
            after[i] = j
            if j < n and words[i] == words[j]:
                period = j - i
                start, end = seen.get(period, (n, n))
                if start <= i and j < end:
                    continue
                start, end = i - shared.left(i, j), j + shared.right(i, j)
                if words[start : end - period] != words[start + period : end]:
                    raise ArithmeticError("two stretches of different words have one rolling hash")
                seen[period] = start, end
                if end - start >= max(min_words, min_exponent * period):
                    found.add((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(hashes: np.ndarray, counts: np.ndarray, min_words: int, min_exponent: int) -> list[tuple[int, int]]:
    """Word ranges that hold all runs: those where each group of three words stands often enough in its text.

    A run of e periods holds e - 1 of each of its groups, or min_words - 2 if its period is one word.
    """
    often = min(min_exponent - 1, min_words - GROUP + 1)
    ends = np.cumsum(counts)
    if often < 2:
        return [(int(e - c), int(e)) for e, c in zip(ends, counts, strict=True) if c >= min_words]
    n = len(hashes)
    if n < min_words:
        return []
    text = np.repeat(np.arange(1, len(counts) + 1, dtype=np.uint64), counts)
    grams = text * MIX[20]
    for k in range(GROUP):
        grams[: n - k] += hashes[k:] * MIX[21 + k]
    whole = np.arange(n) + GROUP <= np.repeat(ends, counts)
    at = np.flatnonzero(whole)
    keys = finish(grams[at])
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    size = np.diff(np.append(first, len(ordered)))
    live = np.zeros(n + 2, dtype=bool)
    live[at[order[np.repeat(size >= often, size)]] + 1] = True
    turn = np.flatnonzero(live[1:] != live[:-1])
    return [(int(a), int(b) + GROUP - 1) for a, b in zip(turn[::2], turn[1::2], strict=True) if b - a >= min_words - GROUP + 1]


def _batch(texts: pa.Array, min_words: int, min_exponent: int) -> tuple[np.ndarray, list[list[tuple[int, int, int]]], pa.Array]:
    """Number of words, runs and collapsed text of each text."""
    data, offsets = buffer_of(texts)
    starts, ends = word_spans(data, offsets)
    counts = word_counts(starts, offsets)
    base = np.concatenate(([0], np.cumsum(counts)))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    keep = np.ones(len(starts), dtype=bool)
    for a, b in stretches(span_hashes(data, starts, ends), counts, min_words, min_exponent):
        known: dict[bytes, int] = {}
        part = data[starts[a] : ends[b - 1]].tobytes()
        spans = zip((starts[a:b] - starts[a]).tolist(), (ends[a:b] - starts[a]).tolist(), strict=True)
        words = [known.setdefault(part[s:e], len(known)) for s, e in spans]
        text = int(np.searchsorted(base, a, "right")) - 1
        for start, length, period in runs_of(words, min_words, min_exponent):
            keep[a + start + period : a + start + length] = False
            runs[text].append((a + start - int(base[text]), length, period))
    kept = np.flatnonzero(keep)
    owner = np.repeat(np.arange(len(texts)), counts)[kept]
    last = np.append(owner[1:] != owner[:-1], True) if len(kept) else np.zeros(0, dtype=bool)
    edge = np.zeros(len(data) + 1, dtype=np.int8)  # a kept word and the blank behind it, but for a text's last word
    edge[starts[kept]] += 1
    stop = ends[kept] + ~last
    edge[stop] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    joined = data.copy()
    joined[ends[kept[~last]]] = 0x20
    sizes = np.bincount(owner, weights=stop - starts[kept], minlength=len(texts)).astype(np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    collapsed = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(joined[mask].tobytes())])
    return counts, runs, collapsed


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period) and collapsed of each row.

    `collapsed` is the text's words joined by a blank, without those that any run holds after its first period.
    """
    if min_words < 2 * GROUP or min_exponent < 2:
        raise ValueError("a run has two periods and six words at least")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, runs, collapsed = _batch(batch.column("text"), min_words, min_exponent)
            lists = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), lists, collapsed.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
            release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def collapse(docs: DataFrame, **options) -> DataFrame:
    """doc_id and text, with each run cut back to its first period."""
    return find_runs(docs, **options).select("doc_id", F.col("collapsed").alias("text"))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts made periodic from a place on that the id's checksum tells."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))

        def repeat(place: Column) -> Column:
            return F.transform(words, lambda w, i: F.when(i < place["a"], w).otherwise(F.get(words, (place["a"] + (i - place["a"]) % place["p"]).cast("int"))))

        return F.when(n > 0, F.array_join(_let(F.struct(a.alias("a"), p.alias("p")), repeat), " "))

    text = F.col("text").cast("string")
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(h % 10 == 0, F.coalesce(_let(words, periodic), text)).otherwise(text).alias("text"))


def digest(rows: DataFrame) -> DataFrame:
    """One row of plain columns for each row of find_runs: the longest run, and hashes of all runs and of the text."""
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    longest = rows.select("*", first.alias("first"))
    return longest.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("first.back")).alias("start"), F.col("first.length").alias("length"), (-F.col("first.short")).alias("period"),
        F.expr("first.length * 1000 div -first.short").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
