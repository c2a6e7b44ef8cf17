"""Vectorised text primitives for use inside tasks: word spans, word and shingle hashes.

A batch of texts is one UTF-8 buffer with document offsets. A word is a maximal run of
bytes other than space and 0x09-0x0D, which equals the regular expression
[^\\x20\\x09-\\x0D]+ because no multi-byte UTF-8 character holds those bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_rng = np.random.Generator(np.random.PCG64(20240917))
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
STEP = np.uint64(int(_rng.integers(0, 2**64, dtype=np.uint64)) | 5)
MIX = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers() -> tuple[np.ndarray, np.ndarray]:
    """STEP**i and its inverse modulo 2**64 for i up to BLOCK."""
    if not _powers:
        inverse = np.uint64(pow(int(STEP), -1, 2**64))
        for name, base in (("up", STEP), ("down", inverse)):
            steps = np.full(BLOCK + 1, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def finish(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n + 1 document offsets; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about `most` bytes of text, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffer_of(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; a document's edge ends a word."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = ~SEPARATOR[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for spans in ascending order that do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    up, down = powers()
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + BLOCK, "right"))
        if j <= i:  # one span longer than a block
            digest = hashlib.blake2b(data[base : ends[i]].tobytes(), digest_size=8).digest()
            out[i] = np.frombuffer(digest, dtype=np.uint64)[0]
            i += 1
            continue
        part = data[base : ends[j - 1]]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(BYTE[part] * up[: len(part)], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = finish((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * MIX[0])
        i = j
    return out


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's runs of `width` words, and how many each document has.

    A document of fewer words gives its whole sequence as one; one without words gives none.
    """
    n = len(hashes)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    per = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, n)):
        mixed[: n - k] += hashes[k:] * MIX[1 + k]
    with np.errstate(over="ignore"):
        for d in np.flatnonzero((counts > 0) & (counts < width)):
            at = first[d]
            mixed[at] = MIX[40] * np.uint64(counts[d]) + (hashes[at : at + counts[d]] * MIX[1 : 1 + counts[d]]).sum(dtype=np.uint64)
    within = np.arange(n) - np.repeat(first, counts)
    keep = within < np.repeat(per, counts)
    return finish(mixed[keep]), per


def word_counts(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(starts, offsets, "left"))


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes, A-Z lower-cased."""
    data, offsets = buffer_of(column)
    data = LOWER[data]
    starts, ends = word_spans(data, offsets)
    tokens, per = shingles(span_hashes(data, starts, ends), word_counts(starts, offsets), width)
    at = 0
    for n in per:
        yield np.unique(tokens[at : at + n])
        at += n
