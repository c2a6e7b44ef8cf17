"""Helpers shared by the corpus operators: tables, cut lineage, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stash:
    """Tables written to the shared folder to cut lineage.

    `drop` removes one that is no longer read. The rest back results that may still be read, so
    they go with the application: their folder is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
        self.count = 0

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def put(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        self.count += 1
        name = f"{self.base}/{self.count}"
        df.write.option("compression", compression).parquet(name)
        if self.count == 1:
            path, fs = self._path(self.base)
            fs.deleteOnExit(path)
        out = self.spark.read.schema(df.schema).parquet(name)
        out._stash_path = name
        return out

    def put_bucketed(self, df: DataFrame, by: str, buckets: int) -> DataFrame:
        """The frame as a table that is bucketed by a column, so that joins by it don't shuffle it."""
        self.count += 1
        name, table = f"{self.base}/{self.count}", f"stash_{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("path", name).bucketBy(buckets, by).saveAsTable(table)
        if self.count == 1:
            path, fs = self._path(self.base)
            fs.deleteOnExit(path)
        out = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")  # its name alone: the files are the stash's own
        out._stash_path = name
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path, fs = self._path(df._stash_path)
            with contextlib.suppress(Exception):  # a file that stays costs disk, not results
                fs.delete(path, True)


def release_memory() -> None:
    """Gives memory that a task's arrays have left free back to the machine, which several workers share."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library of other systems has no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def task_place() -> Iterator[tuple[int, int]]:
    """Within a task, names for its chunks that no other task gives: (partition, running number)."""
    context = TaskContext.get()
    partition = context.partitionId() if context else 0
    return ((partition, k) for k in itertools.count())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, stash: Stash) -> DataFrame:
    """(src, dst) long pairs to (node, component), component the smallest reachable id.

    Alternates large-star and small-star rounds, which shrink any component to a star in a
    logarithmic number of rounds. A node's neighbours are only ever reduced with min, so a
    node with very many neighbours is pre-aggregated and never gathered in one task. The minima are
    written before edges are joined to them: both sides of the join are then plain exchanges, of
    which adaptive execution splits the centre of a large star over many tasks.
    Nodes without edges do not appear; an empty input gives an empty result.
    """
    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

    current = stash.put(ordered(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))))
    size, digest = _state(current)
    while size:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stash.put(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")))
        large = stash.put(ordered(both.filter("b > a").join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                                  .union(low.select(F.col("k").alias("a"), F.col("m").alias("b")))))
        least = stash.put(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k"))
        following = stash.put(ordered(large.join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                                      .union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))))
        new_size, new_digest = _state(following)
        stash.drop(current, low, large, least)
        current = following
        if (new_size, new_digest) == (size, digest):
            break
        size, digest = new_size, new_digest
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


#: The most rows of a table that `offer` sends to every task.
OFFERED = 100_000


def offer(df: DataFrame) -> DataFrame:
    """The frame marked for a broadcast if it has few rows; a larger one is joined by a shuffle.

    Meant for narrow tables with a row a source, a block or a token set: 100,000 rows are some MB.
    """
    return F.broadcast(df) if df.limit(OFFERED + 1).count() <= OFFERED else df


def numbered(df: DataFrame, order: list[str], name: str, stash: Stash) -> DataFrame:
    """The rows with their place, from 0, in a total order, without bringing them all into one task.

    Rows are range-partitioned and sorted; a partition's places begin after the rows of those before.
    """
    sort = [F.col(c).asc_nulls_last() for c in order]
    placed = stash.put(df.repartitionByRange(partitions(df.sparkSession), *sort).sortWithinPartitions(*sort).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))  # a row a partition
    sizes = sizes.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(sizes), "part").withColumn(name, F.col("before") + F.col("place") - F.col("first")).drop("part", "first", "before", "place")
