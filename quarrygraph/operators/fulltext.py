"""Word search with positions: an inverted index of stemmed words, and cover-density ranks over it.

The index holds (term, id, positions): one row for each term of a document, stop words left out but
counted in positions. Written by hash of the term (`store`), a question reads the files of its own terms alone.

A cover is a smallest window of a document that answers the question: any one of its words, or all
of them. Each cover adds 0.1 / (1 + the words in it that the question doesn't name), so
words that stand close together rank a document higher, and every further cover adds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X

#: fixed value: the weight of a word outside of titles
WEIGHT = 0.1
BUCKETS = 256


def words(text: Column | str) -> Column:
    """The words of a text in order: runs of letters, digits and underscores, lower case."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda w: w != "")


def inverted(docs: DataFrame, id_column: str, column: str = "text", asked: Sequence[str] | None = None) -> DataFrame:
    """(term, id, positions ascending) of every document; texts without words have no rows.

    For a question alone, words that don't begin as one of its words does are left out before they are stemmed:
    a stem keeps its word's first two letters.
    """
    every = docs.select(F.col(id_column).alias("id"), F.posexplode(words(column)).alias("position", "word"))
    if asked is not None:
        every = every.filter(F.substring("word", 1, 2).isin(sorted({t.lower()[:2] for t in asked})))
    kept = every.filter((F.length("word") > 1) & ~F.col("word").isin(X.STOP_WORDS))
    return kept.groupBy(X.stem("word").alias("term"), "id").agg(F.array_sort(F.collect_list("position")).alias("positions"))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def store(index: DataFrame, path: str) -> None:
    """Writes an index so that the documents of a term stand in one folder, sorted by term."""
    placed = index.withColumn("bucket", _bucket(F.col("term")))
    placed.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def load(spark: SparkSession, path: str, terms: Sequence[str]) -> DataFrame:
    """The rows of a stored index for the words of a question: only their folders are read."""
    stems = _stems(spark, terms)
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in stems], "term string").select(_bucket(F.col("term"))).distinct().collect()]
    return spark.read.parquet(path).filter(F.col("bucket").isin(buckets) & F.col("term").isin(stems)).drop("bucket")


def _stems(spark: SparkSession, terms: Sequence[str]) -> list[str]:
    """The distinct stems of a question's words, stop words left out."""
    kept = [(t.lower(),) for t in terms if t.lower() not in X.STOP_WORDS and len(t) > 1]
    return sorted(r[0] for r in spark.createDataFrame(kept, "t string").select(X.stem("t")).distinct().collect())


def covers(index: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(id, start, end, met): the smallest windows that hold all of the terms, and how many of their words stand in each.

    Going over a document's merged positions, the window that ends at a word begins at the least of the terms' last places;
    of windows with one beginning the first to end is the smallest.
    """
    stems = _stems(index.sparkSession, terms)
    merged = index.filter(F.col("term").isin(stems)).select("id", "term", F.explode("positions").alias("position"))
    order = Window.partitionBy("id").orderBy("position")
    merged = merged.withColumn("nth", F.row_number().over(order))
    last = [F.last(F.when(F.col("term") == t, F.struct("position", "nth")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)) for t in stems]
    if not last:
        return merged.select("id", F.col("position").alias("start"), F.col("position").alias("end"), F.col("nth").alias("met")).limit(0)
    every = reduce(lambda a, b: a & b, [c.isNotNull() for c in last])
    windows = merged.select("id", F.col("position").alias("end"), "nth", F.when(every, F.least(*last) if len(last) > 1 else last[0]).alias("first")).filter("first is not null")
    return windows.groupBy("id", F.col("first.position").alias("start")).agg(F.min("end").alias("end"), (F.min("nth") - F.first("first.nth") + 1).alias("met"))


def cover_ranks(index: DataFrame, terms: Sequence[str], every: bool = False) -> DataFrame:
    """(id, score) of the documents that hold any of the terms, or all of them, by cover density.

    A single word is a cover by itself, so a question for any of its words counts its places.
    """
    stems = _stems(index.sparkSession, terms)
    if not every:
        return index.filter(F.col("term").isin(stems)).groupBy("id").agg((WEIGHT * F.sum(F.size("positions"))).alias("score"))
    found = covers(index, terms)
    noise = F.col("end") - F.col("start") + 1 - F.col("met")
    return found.groupBy("id").agg(F.sum(WEIGHT / (1 + noise)).alias("score"))


def top(index: DataFrame, terms: Sequence[str], k: int, every: bool = False) -> DataFrame:
    """The k best documents (id, score, rank) by cover density, ties by id."""
    best = cover_ranks(index, terms, every).orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
