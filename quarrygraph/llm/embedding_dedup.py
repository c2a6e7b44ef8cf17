"""Embedding near-dedup by sorted projection passes.

Each pass signs the vectors by random hyperplanes of its own, orders each label's vectors
lexicographically by the concatenated sign bits, and compares every vector with the `window`
vectors before it in that order, by cosine in double precision. Links of all passes are united.
Rows are ranked by a range-partitioned sort and cut into blocks of ranks, each with the window
that reaches back over its edge, so no label and no group is ever held by one task.

Equal vectors of a label form one class, which takes part once and counts as often as it has members.

Windows alone would lose links of crowds, of which more vectors stand together than a window spans. The
first bits of a code, about as many as leave WINDOW / 4 vectors a prefix where codes spread evenly, tell the
density at a place of the order; where more than a window share them, there is a crowd. Its bucket, of all
vectors with the same first bits, about as many as leave CROWD vectors a prefix, is compared whole, block by
block, so every pair that shares the bucket of a crowd in some pass is compared, however many vectors are near
and whether they link. Where there is no crowd, whatever the size of a label, windows alone do the work. A
pair is counted in the first such pass only, and those whose first pass is sure to be an earlier
one are not brought together again where a block can tell. Only counts per vector and a spanning
forest leave a block, so a large group of near copies never turns into all of its pairs. A label
of no more vectors than a window is compared whole by its windows.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components, and a
vector whose label is null, links with nothing and is kept; vectors of different lengths do not
link; repeated rows of one vec_id are one vector with one row each in the result, the first by
content standing for them; null ids give rows of their own with null component; an empty table gives
no rows; columns other than vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, connected_components, partitions

THRESHOLD = 0.98
PASSES = 14
BITS = 48
WINDOW = 48
BLOCK = 1024
GROUP = 512
CROWD = 1024


def planes(dim: int, number: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, number, dim]).standard_normal((dim, BITS))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v and its 128-bit digest (h, g) of the vectors that can link, one row an id; floats stay floats."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding").cast(kind if kind == "array<float>" else "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter((F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).filter(F.exists("v", lambda x: x != 0.0))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", F.col("s.label").cast("string").alias("label"), "s.v")
    return rows.select("vec_id", "label", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))


def _unit(v: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(x, dtype=np.float64) for x in v])
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _coded(rows: DataFrame, passes: int, window: int) -> DataFrame:
    """A row for each pass with the vector's code in it, and the code's first bits: few as bucket, more as near."""
    sizes = rows.groupBy("label", F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    depth = lambda most: F.least(F.greatest(F.ceil(F.log2(F.col("n") / most)), F.lit(0)), F.lit(BITS)).cast("int")
    sized = rows.withColumn("dim", F.size("v")).join(sizes.select("label", "dim", depth(CROWD).alias("depth"), depth(window / 4).alias("deep")), ["label", "dim"]).select("vec_id", "label", "v", "depth", "deep")

    def run(frames):
        for pdf in frames:
            for dim, part in pdf.groupby(pdf.v.map(len)):
                unit = _unit(part.v)
                for p in range(passes):
                    bits = unit @ planes(int(dim), p) > 0
                    code = (bits.astype(np.int64) << np.arange(BITS - 1, -1, -1)).sum(axis=1)
                    yield pd.DataFrame({"pass": p, "label": part.label, "dim": int(dim), "code": code, "vec_id": part.vec_id, "bucket": code >> (BITS - part.depth.to_numpy(np.int64)), "near": code >> (BITS - part.deep.to_numpy(np.int64))})

    return sized.mapInPandas(run, "pass int, label string, dim int, code long, vec_id long, bucket long, near long")


def _placed(coded: DataFrame, stash: Stash) -> DataFrame:
    """The codes in the order of their passes, with partition and place in it."""
    n = partitions(coded.sparkSession)
    order = ["pass", "label", "dim", "code", "vec_id"]
    placed = coded.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*order, "bucket", "near", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    return stash.put(placed)


def _ranked(placed: DataFrame) -> DataFrame:
    """vec_id, pass, family (of label and length) and rank in the order of the pass, without a global window."""
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))  # a row a partition
    sizes = sizes.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(sizes), "part").select("pass", "label", "dim", "vec_id", (F.col("before") + F.col("at") - F.col("first")).alias("rank"))


IN = ["pass", "label", "dim", "bucket"]


def _crowds(placed: DataFrame, rows: DataFrame, passes: int, window: int, stash: Stash) -> tuple[DataFrame, DataFrame]:
    """(members of the buckets that hold a crowd, vec_id, v and m with `crowds`, its bucket in each pass or -1)."""
    crowded = placed.groupBy(*IN, "near").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > window).select(*IN).distinct()
    members = stash.put(placed.join(crowded, IN).select(*IN, "vec_id"))
    of_pass = [F.coalesce(F.max(F.when(F.col("pass") == p, F.col("bucket"))), F.lit(-1).cast("long")) for p in range(passes)]
    crowds = members.groupBy("vec_id").agg(F.array(*of_pass).alias("crowds"))
    nowhere = F.array_repeat(F.lit(-1).cast("long"), passes)
    return members, stash.put(rows.select("vec_id", "v", "m").join(crowds, "vec_id", "left").withColumn("crowds", F.coalesce("crowds", nowhere)))


def _shared(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The first pass in which the vectors of each pair are in one crowd, or the number of passes."""
    same = (one == two) & (one >= 0)
    return np.where(same.any(axis=1), same.argmax(axis=1), same.shape[1])


def window_pairs(placed: DataFrame, rows: DataFrame, threshold: float, window: int) -> DataFrame:
    """(src, dst, m_src, m_dst) of the links that windows show, but for those within crowds."""
    ranked = _ranked(placed)
    block = F.floor(F.col("rank") / BLOCK)
    tail = ranked.filter(F.col("rank") % BLOCK >= BLOCK - window)
    cut = ranked.select("*", block.alias("block")).union(tail.select("*", (block + 1).alias("block")))
    joined = cut.join(rows, "vec_id")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        ids, rank, m = pdf.vec_id.to_numpy(), pdf["rank"].to_numpy(), pdf.m.to_numpy()
        crowds = np.stack(pdf.crowds)
        own = rank // BLOCK == key[0]
        found = []
        for _, at in pd.Series(np.arange(len(pdf))).groupby([pdf[c].to_numpy() for c in ("pass", "label", "dim")], sort=False):
            at = at.to_numpy()
            unit = _unit(pdf.v.iloc[at])
            for start in range(0, len(at), 256):
                stop = min(len(at), start + 256)
                low = max(0, start - window)
                cosine = unit[start:stop] @ unit[low:stop].T
                i, j = np.nonzero(cosine >= threshold)
                i, j = i + start, j + low
                near = (j < i) & (i - j <= window) & own[at[i]]
                i, j = at[i[near]], at[j[near]]
                apart = _shared(crowds[i], crowds[j]) == crowds.shape[1]
                i, j = i[apart], j[apart]
                i, j = np.where(ids[i] > ids[j], i, j), np.where(ids[i] > ids[j], j, i)
                found.append(pd.DataFrame({"src": ids[i], "dst": ids[j], "m_src": m[i], "m_dst": m[j]}))
        return pd.concat(found) if found else pd.DataFrame({"src": [], "dst": [], "m_src": [], "m_dst": []})

    return joined.groupBy("block").applyInPandas(compare, "src long, dst long, m_src long, m_dst long").distinct()


def _forest(linked: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of ids that connect what the links between two blocks, or within one, connect."""
    out = []
    left, right = linked.any(axis=1), linked.any(axis=0)  # not reached yet
    for first in np.flatnonzero(left):
        if not left[first]:
            continue
        left[first] = False
        front = np.array([first])
        while len(front):
            over = np.flatnonzero(linked[front].any(axis=0) & right)
            right[over] = False
            front = np.flatnonzero(linked[:, over].any(axis=1) & left)
            left[front] = False
            out += [(int(one[first]), int(x)) for x in [*two[over], *one[front]] if x != one[first]]
    return out


def crowd_links(members: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, n) of what crowds link: the number of vectors that src links with where dst is null, and pairs that connect its groups."""
    crowds = members.join(rows.select("vec_id", F.col("crowds")[0].alias("before")), "vec_id").withColumn("cell", F.when(F.col("pass") > 0, F.col("before")).otherwise(F.lit(-1).cast("long"))).drop("before")
    # vectors of one crowd of the first pass, a cell, have met there; small cells are mixed
    cells = crowds.groupBy(*IN, "cell").agg(F.count(F.lit(1)).alias("m")).withColumn("own", F.when(F.col("m") >= GROUP, F.col("cell")).otherwise(F.lit(-1).cast("long")))
    by = Window.partitionBy(*IN)
    owns = cells.groupBy(*IN, "own").agg(F.ceil(F.sum("m") / GROUP).cast("int").alias("parts"))
    owns = owns.select(*IN, "own", "parts", (F.sum("parts").over(by.orderBy("own")) - F.col("parts")).cast("int").alias("first"), F.sum("parts").over(by).cast("int").alias("blocks"))
    dealt = crowds.join(cells.drop("m").join(owns, [*IN, "own"]), [*IN, "cell"])
    dealt = dealt.withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
    new = lambda x: (F.col("own") < 0) | (x < F.col("first")) | (x >= F.col("first") + F.col("parts"))
    # block i meets block j once, for i <= j
    left = dealt.select("*", F.explode(F.filter(F.sequence("block", F.col("blocks") - 1), new)).alias("j")).select(*IN, F.col("block").alias("i"), "j", F.lit(0).alias("side"), "vec_id")
    right = dealt.select("*", F.explode(F.filter(F.sequence(F.lit(0), F.col("block")), lambda x: (x < F.col("block")) & new(x))).alias("i")).select(*IN, "i", F.col("block").alias("j"), F.lit(1).alias("side"), "vec_id")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf[pdf.side == 0]
        two = one if key[4] == key[5] else pdf[pdf.side == 1]
        if one.empty or two.empty:
            return pd.DataFrame({"src": [], "dst": [], "n": []})
        linked = _unit(one.v) @ _unit(two.v).T >= threshold
        if two is one:
            np.fill_diagonal(linked, False)
        i, j = np.nonzero(linked)
        of_one, of_two = np.stack(one.crowds), np.stack(two.crowds)
        for start in range(0, len(i), 1 << 16):
            a, b = i[start : start + (1 << 16)], j[start : start + (1 << 16)]
            linked[a, b] = _shared(of_one[a], of_two[b]) == key[0]
        ids, others = one.vec_id.to_numpy(), two.vec_id.to_numpy()
        counts = [(ids, linked @ two.m.to_numpy())] + ([] if two is one else [(others, one.m.to_numpy() @ linked)])
        found = pd.DataFrame({"src": np.concatenate([c[0] for c in counts]), "dst": None, "n": np.concatenate([c[1] for c in counts])})
        pairs = _forest(linked, ids, others)
        found = pd.concat([found[found.n > 0].astype({"dst": "Int64"}), pd.DataFrame({"src": [x for x, _ in pairs], "dst": pd.array([y for _, y in pairs], dtype="Int64"), "n": 0})])
        return found.astype({"src": "int64", "n": "int64"})

    return left.union(right).join(rows, "vec_id").groupBy(*IN, "i", "j").applyInPandas(compare, "src long, dst long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW, stash: Stash | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    spark = vectors.sparkSession
    stash = stash or Stash(spark)
    every = stash.put(usable(vectors))
    same = ["label", "h", "g"]
    classes = stash.put(every.groupBy(*same).agg(F.min("vec_id").alias("class"), F.count(F.lit(1)).alias("m")))
    rows = stash.put(every.select("vec_id", "label", "v").join(classes.select("class", "m"), F.col("vec_id") == F.col("class")).drop("class"))
    placed = _placed(_coded(rows, passes, window), stash)
    members, rows = _crowds(placed, rows, passes, window, stash)
    pairs = stash.put(window_pairs(placed, rows, threshold, window))
    crowded = stash.put(crowd_links(members, rows, threshold))
    component = connected_components(pairs.select("src", "dst").union(crowded.filter("dst is not null").select("src", "dst")), stash)
    ends = pairs.select(F.col("src").alias("id"), F.col("m_dst").alias("n")).union(pairs.select("dst", "m_src")).union(crowded.filter("dst is null").select("src", "n"))
    counts = ends.groupBy("id").agg(F.sum("n").alias("n"))
    linked = stash.put(component.join(counts, F.col("node") == F.col("id"), "left").select("node", "component", "n"))
    # both joins have plain exchanges, of which adaptive execution splits the members of a large class
    of_class = every.select("vec_id", *same).join(classes, same).join(linked, F.col("class") == F.col("node"), "left")
    n = F.coalesce("n", F.lit(0)) + F.col("m") - 1
    found = of_class.select(F.col("vec_id").alias("id"), n.alias("n"), F.coalesce("component", "class").alias("component"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(found, F.col("vec_id") == F.col("id"), "left")
    root = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(root == F.col("vec_id"), F.lit(True)).alias("kept"))
