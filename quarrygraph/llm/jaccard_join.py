"""N-gram Jaccard join by prefix filtering under several global token orders.

Two documents link when percent/100 * |A or B| <= |A and B| over their sets of word shingles.

How the work is laid out:

1. Documents with equal sets form one class; only classes are compared.
2. Shingle hashes are shuffled once, as packed arrays dealt by hash bucket, to find how many
   documents hold each shingle (copies within a chunk count once). The number of buckets follows
   the number of shingles, so a bucket stays small at any size. A shingle held once can match
   nothing, so every order puts those first; a set whose prefix ends within them has no partner
   and leaves here.
3. What is left of each remaining class is its profile: the shared shingles, and its prefix under
   each of three orders (rarest first with two different tie-breaks, and one that ignores
   frequency). A pair must share a prefix token under every order before it is verified.
4. Each prefix token names a pivot, the class with the fewest unshared shingles. Classes with a
   common pivot are compared in blocks of bounded size, each block also against its pivot.
   Blocks return a spanning forest of their links, never all pairs. Once components are known,
   only pairs of blocks that still hold different components are compared.

Shingles that are frequent within one chunk of documents are marked hot: their bucket learns of
them once a chunk and never lists their documents. Orders by frequency put them last.

Defined cases: null or blank text has an empty set, n_shingles 0 and links with nothing; fewer
words than the width give the whole sequence as one shingle; repeated rows (and rows that share a
doc_id) are copies of each other; a null doc_id is given back in a row of its own with a null
component and takes no part; texts of any length are cut whole; an empty table gives no rows.
Further columns are ignored.

Shingles are told apart by the hash of their words: 40 bits beside the number of the bucket, 64 bits
for those that are hot; equal sets are known by 64 bits. Two different shingles of one pair of sets
look alike with a chance of about 1e-12 or less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, connected_components, partitions, release_memory, task_place
from .textpack import finish, shingle_sets, slices

TOKENS_PER_BUCKET = 2_000_000
TOKENS_PER_CHUNK = 750_000
HOT_IN_CHUNK = 64
GROUP = 1024
HOT_CLASS = 255
ORDERS = 3
LOW = 0xFFFFFFFFFF  # 40 bits of a hash are kept beside its bucket
SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _sets(batches: Iterator[pa.RecordBatch], width: int):
    for batch in slices(batches, "text"):
        ids = batch.column("doc_id").to_pylist()
        yield from zip(ids, shingle_sets(batch.column("text"), width), strict=True)


def _digest(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def set_keys(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_key) of each document."""

    def run(batches):
        ids, sizes, keys = [], [], []
        for doc, tokens in _sets(batches, width):
            ids.append(doc)
            sizes.append(len(tokens))
            keys.append(_digest(tokens))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())], ["doc_id", "n_shingles", "set_key"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key long")


def _pack(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def _postings(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Packed rows of one chunk of documents, its copies left out.

    kind 0: the tokens of one bucket and how many each of the chunk's documents has of them.
    kind 1: the tokens of a bucket that are hot in the chunk. kind 2: the chunk's hot tokens,
    counted by document. kind 3: the chunk's documents.
    """
    schema = "kind int, bucket int, chunk long, counts binary, low binary, high binary"

    def emit(rows, place):
        unique: dict[int, tuple[int, np.ndarray]] = {}
        for doc, tokens in rows:
            key = _digest(tokens)
            if key not in unique or doc < unique[key][0]:
                unique[key] = (doc, tokens)
        ids = np.array([v[0] for v in unique.values()], dtype=np.int64)
        keys, sizes = np.array(list(unique), dtype=np.int64), np.array([len(v[1]) for v in unique.values()], dtype=np.int64)
        chunk = _digest(np.concatenate([ids, keys, next(place)]))
        home = int(chunk % buckets)
        yield (3, home, chunk, _pack(ids), _pack(keys), _pack(sizes))
        tokens = np.concatenate([v[1] for v in unique.values()])
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        n = np.diff(np.concatenate((start, [len(tokens)])))
        hot = np.repeat(n >= HOT_IN_CHUNK, n)
        for b, part, own in _dealt((tokens[~hot] % np.uint64(buckets)).astype(np.int32), owner[~hot], tokens[~hot]):
            yield (0, b, chunk, _counts(own, len(ids)), *_split(_rest(part, buckets)))
        if not hot.any():
            return
        distinct = np.unique(tokens[hot])
        for b, part, _ in _dealt((distinct % np.uint64(buckets)).astype(np.int32), np.zeros(len(distinct), np.int32), distinct):
            yield (1, b, chunk, b"", *_split(_rest(part, buckets)))
        order = np.argsort(owner[hot], kind="stable")
        part = tokens[hot][order]
        yield (2, home, chunk, _counts(owner[hot], len(ids)), _pack(_rest(part, buckets) * np.uint64(buckets) + part % np.uint64(buckets)), b"")

    def run(batches):
        place = task_place()

        def chunks():
            rows, total = [], 0
            for doc, tokens in _sets(batches, width):
                if doc is None or not len(tokens):
                    continue
                rows.append((doc, tokens))
                total += len(tokens)
                if total >= TOKENS_PER_CHUNK or len(rows) >= 50_000:
                    yield rows
                    rows, total = [], 0
            if rows:
                yield rows

        names = ["kind", "bucket", "chunk", "counts", "low", "high"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3]
        for rows in chunks():
            for row in emit(rows, place):
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)
            release_memory()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _dealt(target: np.ndarray, owner: np.ndarray, tokens: np.ndarray):
    """(target, tokens, owner) for each target, in the order of owners."""
    order = np.lexsort((owner, target))
    target, owner, tokens = target[order], owner[order], tokens[order]
    if not len(target):
        return
    start = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
    for a, b in zip(start, [*start[1:], len(target)], strict=True):
        yield int(target[a]), tokens[a:b], owner[a:b]


def _counts(owner: np.ndarray, n: int) -> bytes:
    return _pack(np.bincount(owner, minlength=n).astype(np.uint32).view(np.uint8).reshape(-1, 4).T)


def _owners(counts: bytes) -> np.ndarray:
    n = np.ascontiguousarray(np.frombuffer(counts, np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1)
    return np.repeat(np.arange(len(n), dtype=np.int32), n)


def _rest(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """What is kept of a token beside its bucket."""
    return (tokens // np.uint64(buckets)) & np.uint64(LOW)


def _split(rest: np.ndarray) -> tuple[bytes, bytes]:
    return _pack(rest.astype(np.uint32)), _pack((rest >> np.uint64(32)).astype(np.uint8))


def _joined(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, np.uint32).astype(np.uint64) | (np.frombuffer(high, np.uint8).astype(np.uint64) << np.uint64(32))


def _shared(postings: DataFrame, buckets: int) -> DataFrame:
    """Per bucket, the tokens that several documents hold, sent back to their chunks with a rank by frequency."""
    schema = "kind int, bucket int, chunk long, counts binary, low binary, high binary, ranks binary"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(r.kind, r.bucket, r.chunk, r.counts, r.low, r.high, b"") for r in pdf[pdf.kind >= 2].itertuples()]
        hot = [_joined(r.low, r.high) for r in pdf[pdf.kind == 1].itertuples()]
        hot = np.unique(np.concatenate(hot)) if hot else np.zeros(0, np.uint64)
        rows = list(pdf[pdf.kind == 0].itertuples())
        if rows:
            parts = [_joined(r.low, r.high) for r in rows]
            distinct, back, df = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            rank = np.minimum(HOT_CLASS - 1, np.floor(4 * np.log2(df))).astype(np.uint8)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, distinct), len(hot) - 1)
                rank[hot[at] == distinct] = HOT_CLASS
            several, ranks = ((df > 1) | (rank == HOT_CLASS))[back], rank[back]
            at = 0
            for r, part in zip(rows, parts, strict=True):
                keep = several[at : at + len(part)]
                if keep.any():
                    owner = _owners(r.counts)
                    out.append((0, r.bucket, r.chunk, _counts(owner[keep], len(r.counts) // 4), *_split(part[keep]), _pack(ranks[at : at + len(part)][keep])))
                at += len(part)
        release_memory()
        return pd.DataFrame(out, columns=["kind", "bucket", "chunk", "counts", "low", "high", "ranks"])

    return postings.groupBy("bucket").applyInPandas(run, schema)


def _profiles(shared: DataFrame, percent: int, buckets: int) -> DataFrame:
    """One row for each set of a chunk that can have a partner: its shared tokens and their ranks."""
    schema = "doc_id long, set_key long, n int, unshared int, tokens binary, ranks binary"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.kind == 3].iloc[0]
        ids, keys, sizes = (np.frombuffer(x, np.int64) for x in (own.counts, own.low, own.high))
        owner, tokens, ranks = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for r in pdf[pdf.kind != 3].itertuples():
            owner.append(_owners(r.counts))
            if r.kind == 2:
                tokens.append(np.frombuffer(r.low, np.uint64))
                ranks.append(np.full(len(tokens[-1]), HOT_CLASS, np.uint8))
            else:
                tokens.append(_joined(r.low, r.high) * np.uint64(buckets) + np.uint64(r.bucket))
                ranks.append(np.frombuffer(r.ranks, np.uint8))
        owner, tokens, ranks = np.concatenate(owner), np.concatenate(tokens), np.concatenate(ranks)
        order = np.lexsort((tokens, owner))
        tokens, ranks = tokens[order], ranks[order]
        n = np.bincount(owner, minlength=len(ids))
        ends = np.cumsum(n)
        out = []
        for d in np.flatnonzero(n):
            if _room(int(sizes[d]), int(n[d]), percent) > 0:
                out.append((int(ids[d]), int(keys[d]), int(sizes[d]), int(sizes[d] - n[d]), _pack(tokens[ends[d] - n[d] : ends[d]]), _pack(ranks[ends[d] - n[d] : ends[d]])))
        release_memory()
        return pd.DataFrame(out, columns=["doc_id", "set_key", "n", "unshared", "tokens", "ranks"])

    return shared.groupBy("chunk").applyInPandas(run, schema)


def _room(size: int, shared: int, percent: int) -> int:
    """How many shared tokens the prefix of a set holds, after the unshared ones."""
    return size - (percent * size + 99) // 100 + 1 - (size - shared)


def _prefix(tokens: np.ndarray, ranks: np.ndarray, size: int, percent: int, order: int) -> np.ndarray:
    """The shared part of a set's prefix: rarest first with either tie-break, or by hash alone."""
    room = _room(size, len(tokens), percent)
    salted = finish(tokens ^ np.uint64(SALTS[order % 2]))
    return tokens[(np.lexsort((salted, ranks)) if order < 2 else np.argsort(salted))[:room]]


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each left array shares with each right one."""
    out = np.zeros((len(left), len(right)), dtype=np.int32)
    sizes = np.array([len(x) for x in right])
    if not sizes.sum():
        return out
    tokens, owner = np.concatenate(right), np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    for i, mine in enumerate(left):
        a, b = np.searchsorted(tokens, mine, "left"), np.searchsorted(tokens, mine, "right")
        n = b - a
        if total := n.sum():
            at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
            out[i] = np.bincount(owner[at], minlength=len(right))
    return out


def _links(left: pd.DataFrame, right: pd.DataFrame, percent: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks, or within one; pairs known to be connected are left out."""
    n_left, n_right = left.n.to_numpy(np.int64)[:, None], right.n.to_numpy(np.int64)[None, :]
    sides = [[(np.frombuffer(r.tokens, np.uint64), np.frombuffer(r.ranks, np.uint8), int(r.n)) for r in x.itertuples()] for x in (left, right)]
    small, large = np.minimum(n_left, n_right), np.maximum(n_left, n_right)
    candidate = 100 * small >= percent * large
    if same:
        candidate &= np.arange(len(left))[:, None] > np.arange(len(right))[None, :]
    if "component" in left:
        candidate &= left.component.to_numpy()[:, None] != right.component.to_numpy()[None, :]
    for order in range(ORDERS):
        if not candidate.any():
            return []
        candidate &= _overlaps(*([_prefix(*x, percent, order) for x in side] for side in sides)) > 0
    rows = np.flatnonzero(candidate.any(axis=1))
    if not len(rows):
        return []
    common = _overlaps([sides[0][i][0] for i in rows], [x[0] for x in sides[1]]).astype(np.int64)
    linked = candidate[rows] & (100 * common >= percent * (n_left[rows] + n_right - common))
    ids_left, ids_right = left.doc_id.to_numpy(), right.doc_id.to_numpy()
    parent: dict[int, int] = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for i, j in np.argwhere(linked):
        a, b = int(ids_left[rows[i]]), int(ids_right[j])
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b))
    return out


def _frame(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(pairs, columns=["src", "dst"], dtype="int64")


def similar_classes(docs: DataFrame, width: int, percent: int, buckets: int, stash: Stash) -> DataFrame:
    """(node, component) of the classes, named by their smallest doc_id, that link with another class."""
    spark = docs.sparkSession
    profiles = stash.put(_profiles(_shared(_postings(docs, width, buckets), buckets), percent, buckets))
    # a set that stands in several chunks goes on under its smallest id
    standing = profiles.groupBy("set_key", "n").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()

    def prefixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [_prefix(np.frombuffer(r.tokens, np.uint64), np.frombuffer(r.ranks, np.uint8), int(r.n), percent, 0).view(np.int64) for r in pdf.itertuples()]
            n = [len(x) for x in found]
            yield pd.DataFrame({"token": np.concatenate([np.zeros(0, np.int64), *found]), "doc_id": np.repeat(pdf.doc_id.to_numpy(), n), "unshared": np.repeat(pdf.unshared.to_numpy(), n)})

    tokens = stash.put(profiles.mapInPandas(prefixes, "token long, doc_id long, unshared int").join(standing, "doc_id", "left_semi"))
    pivots = tokens.groupBy("token").agg(F.min_by("doc_id", F.struct("unshared", "doc_id")).alias("pivot"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    members = stash.put(tokens.join(pivots, "token").select("pivot", "doc_id").distinct())
    stash.drop(tokens)
    sizes = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    cut = members.join(sizes, "pivot").withColumn("blocks", F.ceil(F.col("m") / GROUP).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    # the pivot joins every block of its group
    own = sizes.select("pivot", F.col("pivot").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / GROUP).cast("int") - 1)).alias("block"))
    blocks = cut.select("pivot", "doc_id", "block").union(own).distinct()

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        return _frame(_links(pdf, pdf, percent, True))

    first = stash.put(blocks.join(profiles, "doc_id").groupBy("pivot", "block").applyInPandas(inside, "src long, dst long"))
    found = connected_components(first, stash)
    # groups of one block are whole; of the others, blocks that hold several components are left
    known = cut.filter("blocks > 1").join(found, F.col("doc_id") == F.col("node"), "left").select("pivot", "doc_id", F.coalesce("component", "doc_id").alias("component"), "m")
    mixed = known.groupBy("pivot").agg(F.countDistinct("component").alias("c")).filter("c > 1").select("pivot")
    known = stash.put(known.join(mixed, "pivot"))
    if known.isEmpty():
        return found
    second = stash.put(_across(known, profiles, percent))
    if second.isEmpty():
        return found
    stars = found.filter("node <> component").select(F.col("node").alias("src"), F.col("component").alias("dst"))
    return connected_components(stars.union(second), stash)


def _across(known: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Links between different blocks of one large group, blocks cut by component.

    A component with at least a block's worth of members is cut into blocks of its own, which are
    never compared with one another; the small components fill blocks together.
    """
    per = known.groupBy("pivot", "component").agg(F.count(F.lit(1)).alias("k"), F.first("m").alias("m"))
    rest = per.groupBy("pivot").agg(F.sum(F.when(F.col("k") < GROUP, F.col("k")).otherwise(0)).alias("small"))
    per = per.join(rest, "pivot")
    placed = known.drop("m").join(per.select("pivot", "component", "k", "small"), ["pivot", "component"])
    large = F.col("k") >= GROUP
    placed = placed.select(
        "pivot", "doc_id", "component",
        F.when(large, F.col("component")).otherwise(-1).alias("family"),
        F.when(large, F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("k") / GROUP))).otherwise(F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.ceil(F.col("small") / GROUP)))).cast("int").alias("part"),
    )
    parts = placed.select("pivot", "family", "part").distinct()
    a, b = parts.alias("a"), parts.alias("b")
    pairs = a.join(b, F.expr("a.pivot = b.pivot and (a.family, a.part) <= (b.family, b.part) and (a.family <> b.family or a.family = -1)"))
    pairs = pairs.select(F.expr("a.pivot as pivot"), F.expr("a.family as fa"), F.expr("a.part as pa"), F.expr("b.family as fb"), F.expr("b.part as pb"))
    left = pairs.join(placed, (F.col("fa") == F.col("family")) & (F.col("pa") == F.col("part")) & (pairs["pivot"] == placed["pivot"]))
    left = left.select(pairs["pivot"], "fa", "pa", "fb", "pb", F.lit(0).alias("side"), "doc_id", "component")
    right = pairs.filter("fa <> fb or pa <> pb").join(placed, (F.col("fb") == F.col("family")) & (F.col("pb") == F.col("part")) & (pairs["pivot"] == placed["pivot"]))
    right = right.select(pairs["pivot"], "fa", "pa", "fb", "pb", F.lit(1).alias("side"), "doc_id", "component")

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf[pdf.side == 0], pdf[pdf.side == 1]
        return _frame(_links(one, one, percent, True) if two.empty else _links(one, two, percent, False))

    return left.union(right).join(profiles, "doc_id").groupBy("pivot", "fa", "pa", "fb", "pb").applyInPandas(between, "src long, dst long")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, stash: Stash | None = None, tokens_per_bucket: int = TOKENS_PER_BUCKET) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id (smallest doc_id with the same set)."""
    spark: SparkSession = docs.sparkSession
    stash = stash or Stash(spark)
    keyed = stash.put(set_keys(docs, width))
    total = keyed.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(1, -(-total // tokens_per_bucket))
    if total:
        buckets = max(buckets, min(partitions(spark), -(-total // 100_000)))
    nodes = similar_classes(docs, width, percent, int(buckets), stash)
    classes = keyed.filter("n_shingles > 0 and doc_id is not null").groupBy("set_key", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(nodes, F.col("class_id") == F.col("node"), "left").select("set_key", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component"))
    classes = classes.withColumnsRenamed({"set_key": "k", "n_shingles": "s"})
    out = keyed.join(classes, (F.col("set_key") == F.col("k")) & (F.col("n_shingles") == F.col("s")), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
