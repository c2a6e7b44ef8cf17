"""Pairs of names whose trigram sets are alike, by prefix filters: common trigrams bring no pairs.

Two sets of a and b trigrams with similarity t share at least t / (1 + t) * (a + b) of them. Sorted by rarity over
all names, each set need only offer its first a - ceil(t * a) + 1 trigrams: two similar sets meet in one of these.
A meeting counts only if the sizes allow the similarity and if enough trigrams are left behind the meeting place
on both sides. What remains is verified once for each pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X


def _ranked(names: DataFrame, column: str, rarity: DataFrame) -> DataFrame:
    """(name, grams): each distinct name's trigrams, the rarest first."""
    grams = names.select(F.col(column).alias("name")).filter("name is not null").distinct().select("name", F.explode(X.trigrams("name")).alias("gram"))
    # one row a trigram of [a-z0-9 ]: at most 37 * 37 * 37 rows however many names there are
    return grams.join(F.broadcast(rarity), "gram").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("grams"))


def rarity(*names: tuple[DataFrame, str]) -> DataFrame:
    """(gram, n): how many distinct names of the tables hold a trigram."""
    every = None
    for df, column in names:
        part = df.select(F.col(column).alias("name")).filter("name is not null").distinct()
        every = part if every is None else every.union(part)
    return every.select(F.explode(X.trigrams("name")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def candidates(left: DataFrame, left_column: str, right: DataFrame, right_column: str, floor: float) -> DataFrame:
    """Distinct (a, b) of names that may be similar enough."""
    if not 0 < floor <= 1:
        raise ValueError("the least similarity is above 0 and at most 1")
    order = rarity((left, left_column), (right, right_column))

    def prefix(df: DataFrame, column: str, name: str) -> DataFrame:
        sets = _ranked(df, column, order).withColumn("size", F.size("grams"))
        offered = F.slice("grams", F.lit(1), (F.col("size") - F.ceil(F.col("size") * floor - 1e-9) + 1).cast("int"))
        return sets.select(F.col("name").alias(name), F.col("size").alias(f"{name}_size"), F.posexplode(F.transform(offered, lambda g: g["gram"])).alias(f"{name}_at", "gram"))

    met = prefix(left, left_column, "a").join(prefix(right, right_column, "b"), "gram")
    met = met.filter((F.col("b_size") >= F.col("a_size") * floor - 1e-9) & (F.col("a_size") >= F.col("b_size") * floor - 1e-9))
    # pairs that meet more than once count their meetings; behind the last one, no more than the rest can be shared
    per = met.groupBy("a", "b", "a_size", "b_size").agg(F.count(F.lit(1)).alias("both"), F.max("a_at").alias("a_at"), F.max("b_at").alias("b_at"))
    rest = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at")) - 1
    return per.filter(F.col("both") + rest >= (F.col("a_size") + F.col("b_size")) * (floor / (1 + floor)) - 1e-9).select("a", "b")


def similar_names(left: DataFrame, left_column: str, right: DataFrame, right_column: str, floor: float) -> DataFrame:
    """(a, b, score) of all distinct names of two tables whose trigram similarity is at least the floor; names without trigrams resemble nothing."""
    pairs = candidates(left, left_column, right, right_column, floor)
    return pairs.select("a", "b", X.trigram_similarity("a", "b").alias("score")).filter(F.col("score") >= floor)
