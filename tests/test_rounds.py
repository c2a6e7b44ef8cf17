"""Edge cases of index runs, facts within a budget, commands in replies, and JSON laid over JSON."""

from pyspark.sql import functions as F

from quarrygraph.functions import expressions as X
from quarrygraph.operators import runs, texts
from quarrygraph.plans import graph


def asked(spark, *replies):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string").select("i", runs.command("reply").alias("c")).orderBy("i").collect()
    return [r["c"] for r in rows]


def test_commands_in_prose_and_fences(spark):
    c = asked(
        spark, "Let me see.\n```\nREAD: front app/a.js 3\n```", "ANSWER", "answer soon\nSQL: select 1", "with x as (select 1)\nselect * from x\nGREP: a b", "GREP front `bid id`", "", None, "READ: front app/a.js",
    )
    assert [x["cmd"] for x in c] == ["READ", "ANSWER", "SQL", "GREP", "GREP", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert (c[0]["repo"], c[0]["path"], c[0]["start"], c[0]["end"]) == ("front", "app/a.js", 3, 122)
    assert c[2]["sql"] == "select 1" and c[4]["pattern"] == "bid id" and c[1]["sql"] is None


def test_sql_ends_at_the_next_command(spark):
    assert asked(spark, "SQL: select a\nfrom b\nANSWER")[0]["sql"] == "select a\nfrom b"


def test_facts_stay_whole_within_the_budget_and_lose_all_steps_beyond(spark):
    rows = [("a", "lists", p, 10) for p in range(1, 21)] + [("b", "source", p, 100) for p in range(1, 4)] + [("b", "other", 1, 500), (None, "lists", 1, 5)]
    df = spark.createDataFrame(rows, "question string, list string, position int, size int")
    out = {(r["question"], r["list"]): (r["n"], r["steps"]) for r in runs.within_budget(df, budget=200).groupBy("question", "list").agg(F.count("*").alias("n"), F.max("steps").alias("steps")).collect()}
    assert out == {("a", "lists"): (20, 0), ("b", "other"): (1, len(runs.FACT_STEPS)), (None, "lists"): (1, 0)}
    cut = {r["question"]: r["steps"] for r in runs.within_budget(df, budget=150).select("question", "steps").distinct().collect()}
    assert cut["a"] == 2 and runs.within_budget(df.limit(0)).count() == 0


def test_changed_paths_know_null_blobs(spark):
    old = spark.createDataFrame([("a", "1"), ("b", None), ("c", None), ("d", "4")], "path string, blob string")
    new = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3"), ("e", "5")], "path string, blob string")
    assert {tuple(r) for r in runs.changed_paths(old, new).collect()} == {("c", "modified"), ("d", "deleted"), ("e", "added")}


def test_runs_count_a_commit_of_two_refs_for_each(spark):
    refs = spark.createDataFrame([("main", "c1"), ("dev", "c1"), ("old", "c0")], "ref string, commit string")
    tree = spark.createDataFrame([("c1", "a", "x"), ("c1", "b", "x"), ("c1", "c", "y")], "commit string, path string, blob string")
    out = {r["ref"]: (r["files"], r["blobs"], r["cached"], r["hit_percent"]) for r in runs.index_runs(refs, tree, spark.createDataFrame([("x",), ("x",)], "blob string")).collect()}
    assert out == {"main": (3, 2, 1, 50), "dev": (3, 2, 1, 50)}


def test_ranges_are_cut_and_secrets_not_read(spark):
    tree = spark.createDataFrame([("c", "a.rb", "x"), ("c", "conf/.env", "x")], "commit string, path string, blob string")
    stored = spark.createDataFrame([("x", "\n".join(map(str, range(1, 301))))], "blob string, text string")
    wanted = spark.createDataFrame([("c", "a.rb", 11, 290), ("c", "conf/.env", 1, 2), ("c", "none", 1, 2)], "commit string, path string, start int, end int")
    rows = runs.read_at(tree, stored, wanted).orderBy("line").collect()
    assert len(rows) == texts.LONGEST_READ and rows[0]["content"] == "11" and {r["path"] for r in rows} == {"a.rb"}


def test_a_folder_holds_no_folder_of_a_longer_name(spark):
    files = spark.createDataFrame([("app/a", "t"), ("app2/a", "t"), ("app/.env", "t")], "path string, text string")
    assert [r["path"] for r in texts.below(files, "app/").collect()] == ["app/a"]
    assert texts.below(files).count() == 2


def test_json_members_are_replaced_whole(spark):
    rows = [('{"a": 1, "b": {"x": 1}}', '{"b": {"y": [2]}, "c": null}'), ("{}", '{"a": 1}'), ("[1]", "{}"), (None, "{}")]
    out = [r[0] for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(X.json_merge("a", "b")).collect()]
    assert out[0].replace(" ", "") == '{"a":1,"b":{"y":[2]},"c":null}' and out[1].replace(" ", "") == '{"a":1}' and out[2:] == [None, None]


def test_the_stored_graph_is_written_once_and_equal(spark, sf):
    stored, made = graph.stored_graph(spark, sf), graph.star_graph(spark, sf)
    assert graph.stored_graph(spark, sf) is stored
    for name in ("entities", "edges", "refs"):
        a, b = getattr(stored, name), getattr(made, name)
        assert a.columns == b.columns and a.count() == b.count() and a.exceptAll(b).isEmpty()
