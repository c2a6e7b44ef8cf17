"""The mirror: incremental pulls by cursor with overlap, upserts by key, delete reconciliation, retention."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

OVERLAP = "2 minutes"


def latest(rows: DataFrame, key: str, cursor: str) -> DataFrame:
    """One row for each key: the newest by cursor, ties to the greatest row."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max(F.struct(cursor, *[c for c in rest if c != cursor])).alias("r"))
    return best.select(key, *[F.col("r")[c].alias(c) for c in rest])


def due(source: DataFrame, cursor: str, last, overlap: str = OVERLAP) -> DataFrame:
    """Source rows past the last cursor, less an overlap for rows that commit late; all of them at first."""
    return source if last is None else source.filter(F.col(cursor).cast("timestamp") > F.lit(last).cast("timestamp") - F.expr(f"interval {overlap}"))


def apply_changes(mirror: DataFrame, incoming: DataFrame, key: str, cursor: str) -> DataFrame:
    """The mirror after an upsert by key; applying the same rows again changes nothing."""
    return latest(mirror.unionByName(incoming), key, cursor)


def reconcile(mirror: DataFrame, source_keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, keys that are gone from the source)."""
    return mirror.join(source_keys.select(key), key, "left_semi"), mirror.select(key).join(source_keys.select(key), key, "left_anti")


def allowlisted(source: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """The allowed columns that the source has; others never leave it."""
    return source.select([c for c in allowed if c in source.columns])


def stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def deduplicated(rows: DataFrame, key: str, cursor: str, overlap: str = OVERLAP) -> DataFrame:
    """A stream without the rows that an overlapping pull repeats: state lasts as long as the overlap."""
    return rows.withColumn(cursor, F.col(cursor).cast("timestamp")).withWatermark(cursor, overlap).dropDuplicatesWithinWatermark([key])


def windowed_counts(rows: DataFrame, cursor: str, by: str, length: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Counts by tumbling window and group, an extension beside the mirror."""
    timed = rows.withColumn(cursor, F.col(cursor).cast("timestamp")).withWatermark(cursor, lateness)
    return timed.groupBy(F.window(cursor, length).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


BUCKETS = 64


def current(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The mirror's rows: of each bucket its latest generation, or the latest before a number."""
    every = spark.read.option("mergeSchema", "true").parquet(target)
    if before is not None:
        every = every.filter(F.col("generation") < before)
    last = every.groupBy(F.col("bucket").alias("b")).agg(F.max("generation").alias("g"))  # a row a bucket
    return every.join(F.broadcast(last), (F.col("bucket") == F.col("b")) & (F.col("generation") == F.col("g")), "left_semi")


def evolved(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Rows with the columns of both frames; those that a side lacks are null in it until it is pulled anew."""
    return rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in like.dtypes if c not in rows.columns])


def mirror(rows: DataFrame, target: str, checkpoint: str, key: str, cursor: str, then: Callable[[DataFrame, int], None] | None = None, buckets: int = BUCKETS, base: int = 0) -> StreamingQuery:
    """Runs all that is available into a table laid out by buckets of the key, and stops.

    A batch writes a new generation of the buckets it touches and leaves the others as they are, and removes
    the generations of these buckets that no retry can need. Run again, it reads what stood before it and writes
    the same once more, so a restart neither loses nor doubles rows. Of rows of one key and cursor the incoming one
    stands, since the source may have more columns than it had. Generations are numbered from `base` on.
    """

    def batch(frame: DataFrame, number: int) -> None:
        spark, number = frame.sparkSession, base + number
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        incoming = latest(frame, key, cursor).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = sorted(r["bucket"] for r in incoming.select("bucket").distinct().collect())  # at most so many buckets
        held = [int(f.getPath().getName().partition("=")[2]) for f in fs.listStatus(path) if f.getPath().getName().startswith("generation=")] if fs.exists(path) else []
        merged = incoming
        if any(g < number for g in held):
            old = current(spark, target, number).filter(F.col("bucket").isin(touched)).drop("generation")
            sides = [evolved(x, y).withColumn("turn", F.struct(cursor, F.lit(i).alias("side"))) for i, (x, y) in enumerate(((old, incoming), (incoming, old)))]
            merged = latest(sides[0].unionByName(sides[1]), key, "turn").drop("turn")
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/generation={number}")
        for b in touched:  # of what stood before, the newest generation serves a retry of this batch
            stale = [g for g in held if g < number and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/generation={g}/bucket={b}"))]
            for g in sorted(stale)[:-1]:
                fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/generation={g}/bucket={b}"), True)
        if then:
            then(frame, number)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fingerprint(schema: StructType) -> str:
    """Names and types of a schema, whatever their order."""
    return hashlib.sha256("\n".join(sorted(f"{f.name} {f.dataType.simpleString()}" for f in schema)).encode()).hexdigest()


def pulled(rows: DataFrame, target: str, state: str, key: str, cursor: str, buckets: int = BUCKETS) -> StreamingQuery:
    """The mirror of a source whose columns may change: new ones make it pull every row once more.

    Beside the offsets of a pull stands the schema that it was made with. Rows of another schema begin a new pull,
    from the first offset on and with generations after all that stand, so each row is written again with the columns it
    has now. The note of the new pull is written before it starts; stopped midway, it goes on where it was.
    """
    spark = rows.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    notes, now = f"{state}/schemas", fingerprint(rows.schema)
    fs = path(notes).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    pulls = spark.read.schema("pull int, schema string, base int").json(notes).orderBy("pull").collect() if fs.exists(path(notes)) else []  # a row a change of schema
    if not pulls or pulls[-1]["schema"] != now:
        held = [int(f.getPath().getName().partition("=")[2]) for f in fs.listStatus(path(target)) if f.getPath().getName().startswith("generation=")] if fs.exists(path(target)) else []
        pulls.append({"pull": len(pulls), "schema": now, "base": max(held, default=-1) + 1})
        spark.createDataFrame([pulls[-1]], "pull int, schema string, base int").coalesce(1).write.mode("append").json(notes)
    last = pulls[-1]
    return mirror(rows, target, f"{state}/pull-{last['pull']}", key, cursor, buckets=buckets, base=last["base"])


def mirror_all(tables: Mapping[str, Callable[[], StreamingQuery]]) -> dict[str, str | None]:
    """Runs the mirror of each table by itself: name to None, or to the error that stopped it. No failure stops another table."""
    out: dict[str, str | None] = {}
    for name, start in tables.items():
        try:
            start().awaitTermination()
            out[name] = None
        except Exception as e:  # reported to the caller, table by table
            out[name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return out
