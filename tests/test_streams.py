"""The polled source, mirrors whose schema changes, and runs started by pushes."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarrygraph.streaming import polled, pushes, sync

START = datetime(2024, 1, 1)


@pytest.fixture
def pull(spark, tmp_path):
    """pull(columns) runs the mirror of the source once; rows are appended to the source by `add`."""
    spark.dataSource.register(polled.PolledTable)

    def run(**options):
        rows = spark.readStream.format("polled_table").options(path=f"{tmp_path}/in", cursor="ts", key="id", **options).load()
        sync.pulled(rows, f"{tmp_path}/out", f"{tmp_path}/state", "id", "ts", buckets=4).awaitTermination()
        return {r["id"]: r for r in sync.current(spark, f"{tmp_path}/out").collect()}

    def add(rows, schema="id long, ts timestamp, v string, w string"):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    return run, add


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_pulls_take_what_is_new_and_what_was_late(pull):
    run, add = pull
    add([(k, at(k), "a", None) for k in range(100)] + [(500, None, "no cursor", None)])
    first = run()
    assert len(first) == 101 and first[500]["v"] == "no cursor"
    add([(3, at(200), "b", None), (200, at(98), "late, within the overlap", None), (201, at(50), "late beyond it", None), (501, None, "no cursor", None)])
    second = run()
    assert second[3]["v"] == "b" and 200 in second and 201 not in second and 501 not in second and len(second) == 102
    assert run() == second  # nothing new


def test_offsets_and_slices(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([(k, at(k // 2)) for k in range(1000)], "id long, ts timestamp_ntz").repartitionByRange(5, "id").write.parquet(folder)
    reader = polled.PolledReader({"path": folder, "cursor": "ts", "key": "id", "slices": "3"}, polled.PolledTable({"path": folder}).schema())
    end = reader.latestOffset()
    assert end["key"] == 999 and reader.partitions(end, end) == [] and len(reader.partitions(reader.initialOffset(), end)) == 3
    read = lambda a, b: sorted(x for p in reader.partitions(a, b) for batch in reader.read(p) for x in batch.column(0).to_pylist())
    assert read(reader.initialOffset(), end) == list(range(1000))
    minute = 60_000_000
    middle = {"cursor": end["cursor"] - 99 * minute, "key": 800}  # of two rows of one cursor the first
    assert read(reader.initialOffset(), middle) == list(range(801))
    assert read(middle, end) == [k for k in range(1000) if k // 2 > 400 - 2]
    assert len(reader.partitions(middle, end)) < 3  # files of earlier cursors aren't opened
    with pytest.raises(ValueError, match="not on source"):
        polled.PolledTable({"path": folder, "columns": "id,gone"}).schema()


def test_an_empty_source_has_no_offset(spark, tmp_path):
    spark.createDataFrame([], "id long, ts timestamp").write.parquet(str(tmp_path / "in"))
    reader = polled.PolledReader({"path": str(tmp_path / "in"), "cursor": "ts", "key": "id"}, polled.PolledTable({"path": str(tmp_path / "in")}).schema())
    assert reader.latestOffset() == reader.initialOffset() and reader.partitions(reader.initialOffset(), reader.latestOffset()) == []


def test_a_new_column_is_filled_for_old_rows(pull):
    run, add = pull
    add([(k, at(k), "a", f"w{k}") for k in range(50)])
    assert "w" not in run(columns="id,ts,v")[7].asDict()
    add([(60, at(60), "b", "w60")])
    got = run(columns="id,ts,v,w")
    assert len(got) == 51 and all(got[k]["w"] == f"w{k}" for k in [*range(50), 60])
    add([(61, at(61), "c", "w61")])
    again = run(columns="id,ts,v,w")
    assert len(again) == 52 and again[7]["generation"] == got[7]["generation"] or again[7]["w"] == "w7"
    assert sync.fingerprint(spark_schema("a int, b string")) == sync.fingerprint(spark_schema("b string, a int")) != sync.fingerprint(spark_schema("a long, b string"))


def spark_schema(text):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(text)


def brute_runs(log):
    """Runs of each ref when its events come one by one."""
    out, state = [], {}
    for when, kind, sha, ref in sorted(set(log)):
        s = state.setdefault(ref, {"work": None, "waiting": None, "newest": None, "n": 0})
        begin = None
        if kind == "push":
            if s["newest"] and (when, sha) <= s["newest"]:
                continue
            s["newest"] = (when, sha)
            if s["work"]:
                s["waiting"] = sha
            else:
                begin = sha
        elif s["work"]:
            begin, s["work"], s["waiting"] = s["waiting"], None, None
        if begin:
            s["work"], s["n"] = begin, s["n"] + 1
            out.append((ref, s["n"], begin))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3])
def test_pushes_start_one_run_at_a_time(spark, tmp_path, monkeypatch, batches):
    rng = random.Random(batches)
    log = [(at(t), rng.choice(["push", "push", "done"]), f"sha{t:04d}", f"ref{rng.randrange(6)}") for t in range(240)]
    before = spark.conf.get(pushes.PROVIDER[0], None)
    spark.conf.set(*pushes.PROVIDER)
    try:
        for k in range(batches):
            part = log[k * 240 // batches : (k + 1) * 240 // batches]
            part = part + rng.sample(part, 20)
            rng.shuffle(part)
            spark.createDataFrame([(r, s, t, kind) for t, kind, s, r in part], "ref string, sha string, at timestamp, kind string").repartition(2).write.mode("append").parquet(f"{tmp_path}/log")
            rows = pushes.index_starts(sync.stream(spark, f"{tmp_path}/log", "ref string, sha string, at timestamp, kind string"))
            rows.writeStream.format("parquet").option("path", f"{tmp_path}/runs").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(pushes.PROVIDER[0]) if before is None else spark.conf.set(pushes.PROVIDER[0], before)
    runs = spark.read.parquet(f"{tmp_path}/runs")
    got = sorted(tuple(r) for r in runs.select("ref", "run", "sha").collect())
    assert got == brute_runs(log) and len(got) > 40
    assert runs.filter(F.col("started") < F.col("pushed")).count() == 0
