"""Session helpers of the library: tables, the shared folder, and cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Without that setting a temporary folder serves a local session, as in tests. A cluster's
    machines don't see each other's temporary folders, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        folder = getattr(shared_dir, "local", None) or tempfile.mkdtemp(prefix="quarrygraph-")
        shared_dir.local = folder
    return folder


def spread(df: DataFrame, by: str, rows: int, each: int = 500_000) -> DataFrame:
    """The frame dealt by a column to so many tasks that each has about `each` of its rows, however many there are."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // each)), by)


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
