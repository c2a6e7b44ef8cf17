"""Mixing sources to target weights by exact quotas and a hypergeometric splitting tree.

A document's size is its number of words. A source's target is its share, by weight, of
`share` times all sizes; no target exceeds `cap` times its source's size, and what a capped source
leaves is shared again by weight. Each source is permuted by a hash and cut into blocks of about
`words_per_block` words. Full passes take all blocks; the last pass takes blocks in order until the
target is met. The place where it is met is found by radix selection on the hash, a level of 1024
digits at a time, from sums that are pre-aggregated, so no source is ever sorted or gathered whole.
What then lacks is filled with the largest documents that still fit, a few at most, and with one
that goes over if that comes nearer; these belong to the last block.

The blocks drawn are dealt to output shards by a splitting tree: at each node the vector of block
quotas by source is divided between both halves of the shards by a multivariate hypergeometric
draw, which keeps all quotas exact. The tree is drawn for groups of sources first, and then within
each group, in tasks, for its sources. A source's permuted blocks go to the shards in that order, so
shards are disjoint, and rows are put in random order within a shard. A document is taken as often
as the blocks dealt hold it.

Sizes, targets, cuts, quotas and blocks are tables with rows by source; the driver reads sums and
one row a group of GROUP sources. All draws depend on the data and `seed` alone.

Defined cases: null or blank text has size 0 and is taken once with each pass over its block; a
null source is a source of its own, the last; rows that are alike in doc_id, source and text are
documents of their own, told apart by a running number; an empty table gives no rows; a source of
size 0 has target 0 and is passed over once; texts of any length are counted whole. Columns of the
input are kept by `mix`; those called copy, shard or shuffle_key give way.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, numbered, offer

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
BITS, LEVELS = 10, 6
KEY = BITS * LEVELS
SETTLED = 10_000
FILLS = 5
GROUP = 1_000
BLOCK_BITS = 24
WORDS_PER_SHARD, WORDS_PER_BLOCK, LEAST_SHARDS = 20_000_000, 200_000, 16


def splitting_tree(quotas: np.ndarray, totals: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """(source, shard) block counts whose rows sum to the quotas and whose columns sum to the totals of the shards."""
    out = np.zeros((len(quotas), len(totals)), dtype=np.int64)
    upto = np.concatenate(([0], np.cumsum(totals)))

    def split(vector: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            out[:, first] = vector
            return
        left = n // 2
        half = rng.multivariate_hypergeometric(vector, int(upto[first + left] - upto[first]), method="marginals")
        split(half, first, left)
        split(vector - half, first + left, n - left)

    split(np.asarray(quotas, dtype=np.int64), 0, len(totals))
    return out


def keyed(docs: DataFrame, seed: int, stash: Stash) -> DataFrame:
    """The rows, as `row`, with source s and a key of 60 bits that permutes the source and differs between equal rows."""
    same = ["d", "s", "rid"]
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("d"), F.col("source").cast("string").alias("s"), F.xxhash64(F.col("text").cast("string")).alias("rid"))
    several = stash.put(rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*[F.col(c).alias(f"m_{c}") for c in same]))
    nth = F.lit(0).cast("long")
    if not several.isEmpty():
        alike = F.col("d").eqNullSafe(F.col("m_d")) & F.col("s").eqNullSafe(F.col("m_s")) & (F.col("rid") == F.col("m_rid"))
        # numbered by partition first, so that a row that is very often repeated isn't gathered in one task
        repeated = rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).join(offer(several), alike, "left_semi")
        within = repeated.withColumn("nth", F.row_number().over(Window.partitionBy(*same, "part").orderBy("at")).cast("long"))
        ahead = within.groupBy(*same, "part").agg(F.max("nth").alias("n"))
        ahead = ahead.withColumn("before", F.sum("n").over(Window.partitionBy(*same).orderBy("part")) - F.col("n")).select(*[F.col(c).alias(f"a_{c}") for c in [*same, "part"]], "before")
        here = F.col("d").eqNullSafe(F.col("a_d")) & F.col("s").eqNullSafe(F.col("a_s")) & (F.col("rid") == F.col("a_rid")) & (F.col("part") == F.col("a_part"))
        counted = within.join(ahead, here).select("row", *same, (F.col("before") + F.col("nth") - 1).alias("nth"))
        rows = rows.join(offer(several), alike, "left_anti").withColumn("nth", nth).union(counted)
    else:
        rows = rows.withColumn("nth", nth)
    return rows.select("row", "s", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "d", "rid", "nth"), 64 - KEY).alias("key"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, stash: Stash | None = None) -> DataFrame:
    """(s, source_size, target) from (s, size), one row a source. Sources by code point, null last, take the weights in turn.

    Targets fill up like water: the level rises as sources reach their caps, until none is above.
    """
    stash = stash or Stash(sizes.sparkSession)
    order = numbered(sizes.withColumn("none", F.col("s").isNull()), ["none", "s"], "at", stash)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    by = stash.put(order.select("s", "size", weight.alias("weight")))
    total, weight = by.agg(F.sum("size"), F.sum("weight")).first()
    left, over = share * (total or 0), F.lit(False)
    while weight:
        full = F.col("weight") * left / weight > cap * F.col("size")
        held, full_weight, full_size = by.filter(~over).agg(F.count_if(full), F.sum(F.when(full, F.col("weight"))), F.sum(F.when(full, F.col("size")))).first()
        if not held:
            break
        left, over, weight = left - cap * full_size, over | full, weight - full_weight
    return by.select("s", F.col("size").alias("source_size"), F.when(over, cap * F.col("size")).otherwise(F.col("weight") * left / (weight or 1.0)).alias("target"))


def _cuts(light: DataFrame, plan: DataFrame, stash: Stash) -> DataFrame:
    """(s, k, filled): the largest key that the last pass takes of a source, and keys it takes beyond."""
    state = plan.filter("rest > 0").select(F.col("s").alias("a"), F.lit(0).cast("long").alias("head"), F.col("rest").alias("need"))
    shift = KEY
    while shift:
        inside = light.join(offer(state), F.col("s").eqNullSafe(F.col("a"))).filter(F.shiftright("key", shift) == F.col("head"))
        shift -= BITS
        sums = inside.groupBy("s", "need", F.shiftright("key", shift).alias("head")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        upto = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("s").orderBy("head")))
        state = stash.put(upto.filter("upto > need and upto - words <= need").select(F.col("s").alias("a"), "head", (F.col("need") - F.col("upto") + F.col("words")).alias("need"), "n"))
        if (state.agg(F.max("n")).first()[0] or 0) <= SETTLED:
            break
    low = F.shiftleft("head", shift)
    near = light.join(offer(state), F.col("s").eqNullSafe(F.col("a"))).filter(F.shiftright("key", shift) == F.col("head"))
    fits = near.withColumn("upto", F.sum("size").over(Window.partitionBy("s").orderBy("key"))).filter("upto <= need").groupBy("s").agg(F.max("key").alias("key"), F.max("upto").alias("upto"))
    fits = fits.select(F.col("s").alias("f"), "key", "upto")
    bound = state.join(fits, F.col("a").eqNullSafe(F.col("f")), "left").select("a", F.coalesce("key", low - 1).alias("k"), (F.col("need") - F.coalesce("upto", F.lit(0))).alias("gap"), F.expr("cast(array() as array<long>)").alias("filled"))
    bound = stash.put(bound)
    turn = 0
    while turn <= FILLS:
        left = light.join(offer(bound.filter("gap >= 1")), F.col("s").eqNullSafe(F.col("a"))).filter("key > k and size > 0 and not array_contains(filled, key)")
        best = left.filter("size <= gap").groupBy("s").agg(F.max(F.struct("size", "key")).alias("b"))
        if turn == FILLS:  # a document that goes over, if that comes nearer
            best = left.filter("size < 2 * gap").groupBy("s").agg(F.min(F.struct("size", "key")).alias("b"))
        best = stash.put(best.select(F.col("s").alias("f"), "b"))
        turn = max(turn + 1, FILLS if best.isEmpty() else 0)
        filled = bound.join(offer(best), F.col("a").eqNullSafe(F.col("f")), "left")
        bound = stash.put(filled.select("a", "k", (F.col("gap") - F.coalesce("b.size", F.lit(0))).alias("gap"), F.when(F.col("b").isNull(), F.col("filled")).otherwise(F.array_append("filled", F.col("b.key"))).alias("filled")))
    return bound.select("a", "k", "filled")


def _block(blocks: str = "blocks"):
    """The block of a key among a source's, which divide the keys evenly."""
    return F.shiftright(F.shiftright("key", KEY - 31) * F.col(blocks), 31)


def draw(light: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS, seed: int = 17, words_per_shard: int | None = None, words_per_block: int | None = None, stash: Stash | None = None) -> tuple[DataFrame, DataFrame]:
    """(plan by source, blocks dealt), given rows of s, size and key.

    The plan has a, source_size, target, passes, blocks, k, filled and last, the number of blocks of
    the last pass; the blocks have b_s, pass, block, shard. Shards hold WORDS_PER_SHARD words, or a
    LEAST_SHARDS-th of a smaller mixture, so that every mixture is drawn to several shards.
    """
    spark = light.sparkSession
    stash = stash or Stash(spark)
    sized = stash.put(targets(light.groupBy("s").agg(F.sum("size").alias("size")), weights, share, cap, stash))
    words_per_shard = words_per_shard or min(WORDS_PER_SHARD, max(1, math.ceil((sized.agg(F.sum("target")).first()[0] or 0) / LEAST_SHARDS)))
    wide = words_per_block or min(WORDS_PER_BLOCK, max(1, words_per_shard // 32))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1).cast("int")
    blocks = F.least(F.greatest(F.ceil(F.col("source_size") / wide), F.lit(1)), F.lit(1 << BLOCK_BITS)).cast("long")
    plan = stash.put(sized.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("blocks", blocks))
    cuts = _cuts(light, plan, stash)
    joined = plan.join(offer(cuts), F.col("s").eqNullSafe(F.col("a")), "left")
    taken = (F.col("k") >= 0) | (F.size("filled") > 0)
    # a rest that no cut was found for is met by all of a source
    last = F.when(F.col("k").isNull() & (F.col("rest") > 0), F.col("blocks")).when(taken, _block().cast("long") + 1).otherwise(0)
    whole = F.when((F.col("rest") > 0) & F.col("k").isNull(), F.lit((1 << KEY) - 1)).otherwise(F.coalesce("k", F.lit(-1)))
    joined = joined.withColumn("key", F.greatest(F.coalesce("k", F.lit(-1)), F.lit(0)))
    plan = joined.select(F.col("s").alias("a"), "source_size", "target", "passes", "blocks", whole.cast("long").alias("k"), F.coalesce("filled", F.expr("cast(array() as array<long>)")).alias("filled"), F.coalesce(last, F.lit(0)).cast("long").alias("last"))
    plan = stash.put(plan.withColumn("quota", F.col("passes") * F.col("blocks") + F.col("last")))

    n, quota, words = plan.agg(F.count(F.lit(1)), F.sum("quota"), F.sum("target")).first()
    groups = max(1, -(-n // GROUP))
    shards = max(1, min(math.ceil((words or 0) / words_per_shard), (quota or 0) // 8, 10_000_000 // groups))
    grouped = plan.select("a", "passes", "blocks", "quota", F.pmod(F.xxhash64("a"), F.lit(groups)).cast("int").alias("g"))
    sums = sorted((r["g"], r["q"]) for r in grouped.groupBy("g").agg(F.sum("quota").alias("q")).collect())
    even = np.diff(np.arange(shards + 1) * (quota or 0) // shards)
    dealt = splitting_tree(np.array([q for _, q in sums], dtype=np.int64), even, np.random.default_rng(seed))
    of_group = spark.createDataFrame([(g, row.tolist()) for (g, _), row in zip(sums, dealt, strict=True)], "h int, totals array<long>")

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("a", na_position="last")
        rng = np.random.default_rng([seed, int(pdf.g.iloc[0])])
        by = splitting_tree(pdf.quota.to_numpy(), np.asarray(pdf.totals.iloc[0]), rng)
        frames = []
        for (a, full), row in zip(zip(pdf.a, pdf.blocks.astype(int), strict=True), by, strict=True):
            permuted = rng.permutation(int(row.sum()))
            frames.append(pd.DataFrame({"b_s": a, "pass": (permuted // full).astype("int32"), "block": permuted % full, "shard": np.repeat(np.arange(len(row)), row).astype("int32")}))
        return pd.concat(frames)

    schema = "b_s string, pass int, block long, shard int"
    blocks = grouped.join(F.broadcast(of_group), F.col("g") == F.col("h")).groupBy("g").applyInPandas(deal, schema)
    return plan, stash.put(blocks)


def _copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their plan, `own`, the block in full passes, and `late`, that in the last pass, null if it isn't taken then."""
    more = (F.col("key") <= F.col("k")) | F.array_contains("filled", F.col("key"))
    planned = rows.join(offer(plan), F.col("s").eqNullSafe(F.col("a"))).withColumn("own", _block())
    return planned.withColumn("late", F.when(more, F.least("own", F.col("last") - 1)))


def sized(docs: DataFrame, seed: int, stash: Stash) -> DataFrame:
    """doc_id, s, size and key of each row."""
    rows = keyed(docs.select("doc_id", "source", "text"), seed, stash)
    size = F.coalesce(F.regexp_count(F.col("row.text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return stash.put(rows.select(F.col("row.doc_id").alias("doc_id"), "s", size.alias("size"), "key"))


def mixture(docs: DataFrame, seed: int = 17, stash: Stash | None = None, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted), copies and their shards, one row a document.

    Copies are those that the dealt blocks hold, so they are the rows of `mix`; shards has one for each copy.
    """
    stash = stash or Stash(docs.sparkSession)
    light = sized(docs, seed, stash)
    plan, blocks = draw(light, seed=seed, stash=stash, **options)
    numbered_blocks = plan.select(F.col("a").alias("p_s"), "passes").join(offer(blocks), F.col("p_s").eqNullSafe(F.col("b_s")))
    full = numbered_blocks.filter(F.col("pass") < F.col("passes")).groupBy("b_s", F.col("block").alias("f_block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("f_shards")).withColumnRenamed("b_s", "f_s")
    last = numbered_blocks.filter(F.col("pass") == F.col("passes")).select(F.col("b_s").alias("l_s"), F.col("block").alias("l_block"), F.col("shard").alias("l_shard"))
    rows = _copies(light, plan)
    rows = rows.join(offer(stash.put(full)), F.col("s").eqNullSafe(F.col("f_s")) & (F.col("own") == F.col("f_block")), "left").join(offer(last), F.col("s").eqNullSafe(F.col("l_s")) & (F.col("late") == F.col("l_block")), "left")
    shards = F.concat(F.coalesce("f_shards", F.expr("cast(array() as array<int>)")), F.when(F.col("l_shard").isNotNull(), F.array("l_shard")).otherwise(F.expr("cast(array() as array<int>)")))
    out = rows.withColumn("shards", shards).withColumn("copies", F.size("shards"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("s").alias("source"), "copies", "shards")


def mix(docs: DataFrame, seed: int = 17, stash: Stash | None = None, **options) -> DataFrame:
    """The mixture itself: a row for each copy taken, with its shard, in random order within the shard."""
    stash = stash or Stash(docs.sparkSession)
    plan, blocks = draw(sized(docs, seed, stash), seed=seed, stash=stash, **options)
    columns = [c for c in docs.columns if c not in ("copy", "shard", "shuffle_key")]
    rows = _copies(keyed(docs, seed, stash), plan)
    times = F.col("passes") + F.col("late").isNotNull().cast("int")
    taken = rows.withColumn("times", times).filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    taken = taken.withColumn("in_block", F.when(F.col("copy") < F.col("passes"), F.col("own")).otherwise(F.col("late")))
    dealt = taken.join(offer(blocks), F.col("s").eqNullSafe(F.col("b_s")) & (F.col("copy") == F.col("pass")) & (F.col("in_block") == F.col("block")))
    out = dealt.select(*[F.col("row")[c].alias(c) for c in columns], "copy", "shard", F.xxhash64(F.lit(seed), "shard", "copy", "key").alias("shuffle_key"))
    return out.repartition("shard", F.pmod("shuffle_key", F.lit(16))).sortWithinPartitions("shard", "shuffle_key")
