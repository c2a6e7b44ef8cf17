"""Queries that run streams over the given tables: a polled mirror, one whose schema changes, and runs started by pushes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, shared_dir
from ..streaming import polled, pushes, sync
from .catalog import SQL, query

__all__ = ["SQL"]


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one, which goes when the driver ends."""
    name = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return name


def _thirds(events: DataFrame) -> list[DataFrame]:
    """The events by time in three parts."""
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) / 3, first + (last - first) * 2 / 3]
    return [events.filter(F.col("ts") < cuts[0]), events.filter((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])), events.filter(F.col("ts") >= cuts[1])]


@query("polled_mirror", "SELECT event_id, user_id, event_type, value FROM events")
def _(spark, folder) -> DataFrame:
    events, place = read_table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value"), _folder(spark)
    spark.dataSource.register(polled.PolledTable)
    for part in _thirds(events):
        part.write.mode("append").parquet(f"{place}/source")
        rows = spark.readStream.format("polled_table").options(path=f"{place}/source", cursor="ts", key="event_id").load()
        sync.mirror(rows, f"{place}/mirror", f"{place}/offsets", "event_id", "ts").awaitTermination()
    return sync.current(spark, f"{place}/mirror").select("event_id", "user_id", "event_type", "value")


@query("mirror_new_column", "SELECT event_id, user_id, event_type FROM events")
def _(spark, folder) -> DataFrame:
    events, place = read_table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type"), _folder(spark)
    spark.dataSource.register(polled.PolledTable)
    events.write.parquet(f"{place}/source")
    for allowed in ("event_id,ts,user_id", "event_id,ts,user_id,event_type"):
        rows = spark.readStream.format("polled_table").options(path=f"{place}/source", cursor="ts", key="event_id", columns=allowed).load()
        sync.pulled(rows, f"{place}/mirror", f"{place}/state", "event_id", "ts").awaitTermination()
    return sync.current(spark, f"{place}/mirror").select("event_id", "user_id", "event_type")


@query("push_runs", """WITH RECURSIVE e AS (SELECT user_id AS ref, event_id, event_type = 'purchase' AS push, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type = 'purchase', event_id) AS n FROM events WHERE event_type IN ('purchase', 'click')),
r(ref, run, pushed, started) AS (SELECT ref, 1, min(n), min(n) FROM e WHERE push GROUP BY ref
UNION ALL SELECT * FROM (SELECT ref, run + 1 AS run, coalesce(waiting, (SELECT min(n) FROM e WHERE e.ref = d.ref AND push AND n > done)) AS pushed, CASE WHEN waiting IS NULL THEN (SELECT min(n) FROM e WHERE e.ref = d.ref AND push AND n > done) ELSE done END AS started
  FROM (SELECT ref, run, done, (SELECT max(n) FROM e WHERE e.ref = c.ref AND push AND n > started AND n < done) AS waiting FROM (SELECT ref, run, started, (SELECT min(n) FROM e WHERE e.ref = r.ref AND NOT push AND n > started) AS done FROM r) c WHERE done IS NOT NULL) d) s WHERE pushed IS NOT NULL)
SELECT CAST(r.ref AS VARCHAR) AS ref, run::INT AS run, event_id FROM r JOIN e ON e.ref = r.ref AND n = pushed""")
def _(spark, folder) -> DataFrame:
    events, place = read_table(spark, folder, "events").filter("event_type in ('purchase', 'click')"), _folder(spark)
    kind = F.when(F.col("event_type") == "purchase", "push").otherwise("done")
    log = lambda df: df.select(F.col("user_id").cast("string").alias("ref"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("sha"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"))
    before = spark.conf.get(pushes.PROVIDER[0], None)
    spark.conf.set(*pushes.PROVIDER)
    try:
        for part in _thirds(events):  # each part comes in any order, and some of it twice
            log(part.union(part.filter("event_id % 5 = 0"))).repartition(3, "sha").write.mode("append").parquet(f"{place}/log")
            rows = pushes.index_starts(sync.stream(spark, f"{place}/log", "ref string, sha string, at timestamp, kind string"))
            rows.writeStream.format("parquet").option("path", f"{place}/runs").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(pushes.PROVIDER[0]) if before is None else spark.conf.set(pushes.PROVIDER[0], before)
    return spark.read.parquet(f"{place}/runs").select("ref", "run", F.col("sha").cast("long").alias("event_id"))
