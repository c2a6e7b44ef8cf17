"""Token counts from pre-token frequencies, without ids of any text.

A byte-level BPE text is first cut into pre-tokens, and merges never cross them, so a text's
token count is the sum over its pre-tokens of their piece counts. Each chunk of documents gives
its distinct pre-tokens and, document by document, how often each stands there. Pre-tokens meet
by hash bucket, where each distinct one is encoded once and its number of pieces is sent back to
all chunks that hold it; there counts and frequencies are multiplied and summed.

The chunk tables are written to the shared folder first, so both readers see the same chunks
and a lost executor costs no more than a reread.

Special tokens of the vocabulary that stand in a text count one each and cut it, which is the
library's default. Texts with characters beyond U+024F are cut by the library's own
pre-tokeniser, others by the same pattern.

Defined cases: null and empty texts have 0 bytes and 0 tokens; a pre-token of any length is
encoded whole, and so is a text; repeated rows and null ids are counted row by row; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, partitions

BYTES_PER_BUCKET = 16 << 20
TOKENS_PER_CHUNK = 4_000_000
#: fixed value: the public pattern of byte-level BPE pre-tokens
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FAR = regex.compile("[^\u0000-ɏ]")


class Cutter:
    """Cuts texts into pre-tokens as the tokenizer at a path does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(PATTERN)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def cut(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens and the number of special tokens."""
        if self.special is None or not self.special.search(text):
            return self._plain(text), 0
        parts = self.special.split(text)
        return [t for part in parts for t in self._plain(part)], len(parts) - 1

    def _plain(self, text: str) -> list[str]:
        if FAR.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def pieces(self, tokens: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(tokens, add_special_tokens=False)]


def _planes(values: np.ndarray) -> bytes:
    """32-bit values with equal bytes next to one another, which compress well."""
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)


CHUNK = "chunk string, bucket int, tokens array<string>, docs array<long>, sizes array<long>, special array<long>, spans binary, steps binary, times binary"


def _chunks(docs: DataFrame, path: str, buckets: int) -> DataFrame:
    """Rows of bucket >= 0: a chunk's distinct pre-tokens in a bucket. Of bucket -1: its documents."""
    names = ["chunk", "bucket", "tokens", "docs", "sizes", "special", "spans", "steps", "times"]
    kinds = [pa.string(), pa.int32(), pa.list_(pa.string()), *[pa.list_(pa.int64())] * 3, *[pa.binary()] * 3]

    def rows_of(known: dict[str, int], held: list[tuple]) -> Iterator[tuple]:
        chunk = os.urandom(16).hex()
        tokens = list(known)
        bucket = np.fromiter((zlib.crc32(t.encode()) % buckets for t in tokens), np.int64, len(tokens))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(tokens), dtype=np.int64)
        place[order] = np.arange(len(tokens))
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1)) if buckets <= len(tokens) else None
        for b in range(buckets) if bounds is not None else np.unique(bucket):
            at = order[bounds[b] : bounds[b + 1]] if bounds is not None else np.flatnonzero(bucket == b)
            if len(at):
                yield (chunk, int(b), [tokens[i] for i in at], None, None, None, None, None, None)
        spans, steps, times = [], [], []
        for _, _, _, index, n in held:
            at = place[index]
            by = np.argsort(at)
            spans.append(len(at))
            steps.append(np.diff(at[by], prepend=0))
            times.append(n[by])
        join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        yield (chunk, -1, None, [h[0] for h in held], [h[1] for h in held], [h[2] for h in held], _planes(np.array(spans)), _planes(join(steps)), _planes(join(times)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(path)
        known: dict[str, int] = {}
        held: list[tuple] = []
        total = 0

        def out() -> Iterator[pa.RecordBatch]:
            for row in rows_of(known, held):
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                tokens, special = cutter.cut(text)
                put = known.setdefault
                index, n = np.unique(np.fromiter((put(t, len(known)) for t in tokens), np.int64, len(tokens)), return_counts=True)
                held.append((doc, len(text.encode()), special, index, n))
                total += len(tokens) + 16
                if total >= TOKENS_PER_CHUNK:
                    yield from out()
                    known, held, total = {}, [], 0
        if held:
            yield from out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, CHUNK)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, stash: Stash | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row."""
    spark = docs.sparkSession
    stash = stash or Stash(spark)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    buckets = max(min(partitions(spark), 1 + size // 100_000), -(-size // BYTES_PER_BUCKET))
    chunks = stash.put(_chunks(docs, path, int(buckets)), "zstd")

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cutter = Cutter(path)
        known = {t: 0 for tokens in pdf.tokens for t in tokens}
        names = list(known)
        for start in range(0, len(names), 20_000):
            part = names[start : start + 20_000]
            known.update(zip(part, cutter.pieces(part), strict=True))
        counts = [_planes(np.fromiter((known[t] for t in tokens), np.int64, len(tokens))) for tokens in pdf.tokens]
        return pd.DataFrame({"chunk": pdf.chunk, "bucket": pdf.bucket, "pieces": counts})

    pieces = chunks.filter("bucket >= 0").select("chunk", "bucket", "tokens").groupBy("bucket").applyInPandas(encode, "chunk string, bucket int, pieces binary")

    def total(key: tuple, held: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        each = np.concatenate([np.zeros(0, np.uint32), *map(_values, sent.sort_values("bucket").pieces)]).astype(np.int64)
        rows = []
        for r in held.itertuples():
            spans, steps, times = _values(r.spans).astype(np.int64), _values(r.steps).astype(np.int64), _values(r.times)
            ends = np.cumsum(spans)
            run = np.cumsum(steps)
            before = np.concatenate(([0], run))[ends - spans]  # steps start anew with each document
            n = np.concatenate(([0], np.cumsum(each[run - np.repeat(before, spans)] * times)))
            rows.append(pd.DataFrame({"doc_id": pd.Series(list(r.docs), dtype="Int64"), "n_bytes": r.sizes, "n_tokens": n[ends] - n[ends - spans] + np.asarray(r.special)}))
        return pd.concat(rows) if rows else pd.DataFrame({"doc_id": [], "n_bytes": [], "n_tokens": []})

    held = chunks.filter("bucket = -1").select("chunk", "docs", "sizes", "special", "spans", "steps", "times")
    counted = held.groupBy("chunk").cogroup(pieces.groupBy("chunk")).applyInPandas(total, "doc_id long, n_bytes long, n_tokens long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
