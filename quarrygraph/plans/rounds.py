"""Queries with their SQL for index runs, facts within a budget, commands, confidence, flows, layouts and tables shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import assistant, layouts, runs, texts
from ..session import read_table
from ..sources import content
from .catalog import SQL, query

__all__ = ["SQL"]

# --- index runs ---


@query("changed_paths", """WITH f AS (SELECT year(o_orderdate) AS y, 'app/' || o_custkey AS path, max(o_orderpriority) AS blob FROM orders GROUP BY 1, 2), a AS (SELECT * FROM f WHERE y = 1997), b AS (SELECT * FROM f WHERE y = 1998)
SELECT path, CASE WHEN a.y IS NULL THEN 'added' WHEN b.y IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM a FULL JOIN b USING (path) WHERE a.blob IS DISTINCT FROM b.blob""")
def _(spark, folder) -> DataFrame:
    o = read_table(spark, folder, "orders")
    files = o.groupBy(F.year("o_orderdate").alias("y"), F.concat(F.lit("app/"), F.col("o_custkey")).alias("path")).agg(F.max("o_orderpriority").alias("blob"))
    return runs.changed_paths(files.filter("y = 1997"), files.filter("y = 1998"))


@query("index_runs", """WITH s AS (SELECT DISTINCT sha1(text) AS blob FROM documents WHERE source = 'src1'), t AS (SELECT source, sha1(text) AS blob, sha1(text) IN (SELECT blob FROM s) AS hit FROM documents)
SELECT 'origin/' || source AS ref, source AS "commit", count(*) AS files, count(DISTINCT blob) AS blobs, count(DISTINCT blob) FILTER (hit) AS cached, round(100 * count(DISTINCT blob) FILTER (hit) / count(DISTINCT blob))::INT AS hit_percent FROM t WHERE source IS NOT NULL GROUP BY source""")
def _(spark, folder) -> DataFrame:
    tree = content.document_tree(read_table(spark, folder, "documents"))
    refs = tree.select("commit").distinct().select(F.concat(F.lit("origin/"), F.col("commit")).alias("ref"), "commit")
    return runs.index_runs(refs, tree, tree.filter("commit = 'src1'"))


@query("read_at_commit", """SELECT source AS "commit", doc_id || '/notes.md' AS path, i::INT AS line, l[i] AS content FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l, unnest(range(1 + doc_id % 3, 6)) AS i FROM documents WHERE source IS NOT NULL AND doc_id % 4 <> 0) WHERE i <= len(l)""")
def _(spark, folder) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    named = F.concat(F.col("doc_id"), F.when(F.col("doc_id") % 4 == 0, "/.env").otherwise("/notes.md"))
    tree = docs.select(F.col("source").alias("commit"), named.alias("path"), F.sha1("text").alias("blob"))
    asked = docs.select(F.col("source").alias("commit"), named.alias("path"), (F.col("doc_id") % 3 + 1).cast("int").alias("start"), F.lit(5).alias("end"))
    return runs.read_at(tree, content.blob_texts(docs), asked)


@query("grep_below", """WITH f AS (SELECT source || '/' || doc_id AS path, text FROM documents WHERE source = 'src1' AND contains(text, 'License') ORDER BY path LIMIT 200)
SELECT path, line::INT AS line, left(trim(content), 200) AS content FROM (SELECT path, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM f) WHERE contains(content, 'License') ORDER BY path, line LIMIT 40""")
def _(spark, folder) -> DataFrame:
    files = read_table(spark, folder, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("path"), "text")
    return texts.grep(texts.below(files, "src1"), "License", key="path").select("path", "line", "content")


@query("git_log_touches", """SELECT 'c' || o_custkey || '@x.y' AS person, CAST(o_orderdate::TIMESTAMP AS VARCHAR) AS at, unnest([o_orderpriority, 'app/' || o_orderstatus]) AS path FROM orders""")
def _(spark, folder) -> DataFrame:
    o = read_table(spark, folder, "orders")
    entry = F.concat(F.lit("\x01C"), F.col("o_custkey"), F.lit("@x.y\x02"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00\n\n"), F.col("o_orderpriority"), F.lit("\napp/"), F.col("o_orderstatus"))
    return content.git_log(spark, o.select(entry.alias("entry"))).withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


# --- facts and commands ---

LISTS = {"view": "lists", "click": "live", "purchase": "documents", "signup": "source", "error": "downstream"}


@query("facts_within_budget", """WITH f AS (SELECT user_id AS question, CASE event_type WHEN 'view' THEN 'lists' WHEN 'click' THEN 'live' WHEN 'purchase' THEN 'documents' WHEN 'signup' THEN 'source' ELSE 'downstream' END AS list, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS position, length(props) AS size, event_id FROM events),
m AS (SELECT *, CASE WHEN list = 'lists' AND position > 15 THEN 2 WHEN list = 'lists' AND position > 6 THEN 9 WHEN list = 'live' AND position > 12 THEN 5 WHEN list = 'documents' AND position > 3 THEN 6
  WHEN list = 'source' AND position > 2 THEN 7 WHEN list = 'source' THEN 11 WHEN list = 'downstream' AND position > 12 THEN 3 WHEN list = 'downstream' AND position > 6 THEN 10 ELSE 12 END AS gone FROM f),
z AS (SELECT question, k, sum(size) FILTER (gone > k) AS s FROM m, (SELECT unnest(range(0, 12)) AS k) GROUP BY 1, 2),
c AS (SELECT question, coalesce(min(k) FILTER (coalesce(s, 0) <= 380), 11)::INT AS steps FROM z GROUP BY 1)
SELECT event_id, list, position::INT AS position, steps FROM m JOIN c USING (question) WHERE gone > steps""")
def _(spark, folder) -> DataFrame:
    from pyspark.sql import Window

    e = read_table(spark, folder, "events")
    place = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    name = F.create_map(*[F.lit(x) for kv in LISTS.items() for x in kv])[F.col("event_type")]
    facts = e.select(F.col("user_id").alias("question"), name.alias("list"), place.alias("position"), F.length("props").alias("size"), "event_id")
    return runs.within_budget(facts, budget=380).select("event_id", "list", "position", "steps")


@query("commands", """SELECT n_nationkey, ['ANSWER', 'READ', 'GREP', 'SQL', 'UNKNOWN'][n_nationkey % 5 + 1] AS cmd, CASE WHEN n_nationkey % 5 IN (1, 2) THEN 'sales' END AS repo, CASE WHEN n_nationkey % 5 = 1 THEN 'app/' || n_name || '.rb' END AS path,
CASE WHEN n_nationkey % 5 = 1 THEN n_regionkey + 10 END::INT AS start, CASE WHEN n_nationkey % 5 = 1 THEN CASE WHEN n_nationkey % 2 = 0 THEN 40 ELSE n_regionkey + 129 END END::INT AS "end",
CASE WHEN n_nationkey % 5 = 2 THEN n_name || ' x' END AS pattern, CASE WHEN n_nationkey % 5 = 3 THEN 'SELECT ' || n_regionkey || chr(10) || 'FROM t' END AS sql FROM nation""")
def _(spark, folder) -> DataFrame:
    n = read_table(spark, folder, "nation").withColumn("k", F.col("n_nationkey") % 5).withColumn("name", F.replace("n_name", F.lit(" "), F.lit("_")))
    n = n.withColumn("reply", F.when(F.col("k") == 0, "I know enough.\nanswer")
        .when(F.col("k") == 1, F.concat(F.lit("First the file:\nREAD: sales app/"), "name", F.lit(".rb "), F.col("n_regionkey") + 10, F.when(F.col("n_nationkey") % 2 == 0, " 40").otherwise("")))
        .when(F.col("k") == 2, F.concat(F.lit("grep: sales \""), "name", F.lit(" x\"")))
        .when(F.col("k") == 3, F.concat(F.lit("```sql\nSQL: SELECT "), "n_regionkey", F.lit("\nFROM t\n```\nANSWER")))
        .otherwise("no idea"))
    return n.select("n_nationkey", runs.command("reply").alias("c")).select("n_nationkey", "c.*")


SQL["commands"] = SQL["commands"].replace("n_name", "replace(n_name, ' ', '_')")

# --- confidence, flows, layouts, tables ---

SIGNALS = """c_custkey % 3 AS exact, c_custkey % 2 AS approximate, c_custkey % 4 AS misses, c_custkey % 4 + c_custkey % 3 AS lookups, 0.5 + (c_custkey % 30) / 100.0e0 AS sem_top, (c_custkey % 7) / 100.0e0 AS sem_margin,
c_nationkey % 2 AS strong_docs, c_nationkey % 3 AS screens_named, c_custkey % 11 = 0 AS journey_ordered, CASE WHEN c_custkey % 13 = 0 THEN 2 ELSE 0 END AS live_rows, c_custkey % 17 = 0 AS complete_list, c_custkey % 5 = 0 AS source_read, c_custkey % 6 AS unresolved, c_custkey % 19 = 0 AS truncated"""


@query("confidence_levels", f"""WITH s AS (SELECT c_custkey, {SIGNALS} FROM customer),
t AS (SELECT *, sem_top >= 0.72 AND sem_margin >= 0.04 AS sem, live_rows > 0 AS state, (exact > 0 OR source_read OR complete_list)::INT + (strong_docs > 0)::INT + (journey_ordered OR screens_named > 0)::INT + (live_rows > 0)::INT AS n FROM s),
u AS (SELECT *, exact > 0 OR journey_ordered OR sem OR state OR complete_list AS strong, journey_ordered OR strong_docs > 0 OR state AS supported FROM t),
v AS (SELECT *, CASE WHEN strong AND (n >= 2 OR state OR complete_list OR journey_ordered OR (exact > 0 AND unresolved = 0 AND NOT truncated)) THEN CASE WHEN (truncated OR unresolved > 2) AND NOT journey_ordered AND NOT state THEN 'medium' ELSE 'high' END
  WHEN (NOT strong AND NOT supported AND sem_top < 0.62 AND approximate = 0) OR (misses = lookups AND NOT supported) OR (exact = 0 AND approximate > 0 AND n <= 1 AND NOT journey_ordered) THEN 'low' ELSE 'medium' END AS level FROM u)
SELECT c_custkey, level, CASE WHEN journey_ordered THEN 'screens_in_order' WHEN exact > 0 THEN 'exact_name' WHEN state THEN 'live_rows' WHEN complete_list THEN 'complete_set' WHEN sem THEN 'meaning' WHEN approximate > 0 THEN 'similar_name' WHEN strong_docs > 0 THEN 'documents' ELSE 'nothing' END AS reason,
CASE WHEN level = 'high' THEN NULL WHEN exact > 0 AND (unresolved > 0 OR truncated) THEN 'rest_of_path' WHEN strong_docs = 0 AND NOT state THEN 'document' WHEN exact = 0 AND NOT source_read AND NOT state THEN 'code' WHEN unresolved > 0 OR truncated THEN 'rest_of_path' ELSE 'second_source' END AS missing FROM v""")
def _(spark, folder) -> DataFrame:
    s = read_table(spark, folder, "customer").selectExpr("c_custkey", *SIGNALS.replace("\n", " ").split(", ")).withColumn("level", assistant.confidence_level())
    return s.select("c_custkey", "level", runs.confidence_reason().alias("reason"), runs.confidence_missing(F.col("level")).alias("missing"))


@query("flow_links", """WITH s AS (SELECT o_custkey AS flow, o_orderkey AS step, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM orders),
g AS (SELECT flow, step AS src, next AS dst FROM s WHERE step % 3 = 0 AND next IS NOT NULL AND flow % 2 = 0)
SELECT * FROM g UNION ALL SELECT flow, step, next FROM s WHERE next IS NOT NULL AND flow NOT IN (SELECT flow FROM g)""")
def _(spark, folder) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = read_table(spark, folder, "orders").select(F.col("o_custkey").alias("flow"), F.col("o_orderkey").alias("step"), F.col("o_orderkey").alias("position"), F.lead("o_orderkey").over(w).alias("next"))
    good = o.filter("step % 3 = 0 and flow % 2 = 0").select("flow", F.col("step").alias("src"), F.col("next").alias("dst"))
    unknown = o.select("flow", F.col("step").alias("src"), (-F.col("step") - 1).alias("dst"))
    return assistant.valid_flow(o.select("flow", "step", "position"), good.union(good).union(unknown))


@query("template_layouts", """SELECT p_partkey AS id, ['sheet', 'form', 'fields', 'empty'][p_partkey % 4 + 1] AS layout, CASE p_partkey % 4 WHEN 0 THEN 'inline_components,extra' WHEN 1 THEN 'First,Page 1' WHEN 2 THEN 'fields' ELSE '' END AS groups,
CASE p_partkey % 4 WHEN 0 THEN concat_ws(',', p_brand, p_name, p_type) WHEN 1 THEN concat_ws(',', p_type, p_name) WHEN 2 THEN concat_ws(',', p_name, 'unit price') ELSE '' END AS widgets FROM part""")
def _(spark, folder) -> DataFrame:
    p = read_table(spark, folder, "part")
    sheet = '{"extra": [{"name": "%s"}], "inline_components": [{"name": "%s", "priority": 2}, {"name": "%s", "priority": 1}], "none": []}'
    form = '[{"page_headers": [{"name": "%s"}], "order": 2}, {"name": "First", "page_response_headers": [{"name": "%s"}], "order": 1}]'
    fields = '{"unit_price": {"input_type": "x", "priority": 9}, "n": {"name": "%s", "configuration": {}, "priority": 3}, "title": "t"}'
    doc = F.when(F.col("p_partkey") % 4 == 0, F.format_string(sheet, "p_type", "p_name", "p_brand")).when(F.col("p_partkey") % 4 == 1, F.format_string(form, "p_name", "p_type")).when(F.col("p_partkey") % 4 == 2, F.format_string(fields, "p_name")).otherwise("{]")
    found = layouts.template_layouts(p.select(F.col("p_partkey").alias("id"), doc.alias("widgets")))
    return found.withColumn("groups", F.array_join("groups", ",")).withColumn("widgets", F.array_join("widgets", ","))


@query("asked_columns", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, folder) -> DataFrame:
    wording = {"c_acctbal": r"\b(balance|account)", "c_phone": r"\bphone", "c_mktsegment": r"\bsegment"}
    c = read_table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'")
    known = {name: wording.get(name, "") for name in c.columns}
    return c.select(assistant.columns_for("What is the balance of all in the segment?", known, ["c_mktsegment"], ["c_custkey", "c_name"]))


@query("shown_table", "SELECT p_partkey, p_name, p_brand FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40")
def _(spark, folder) -> DataFrame:
    p = read_table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey")
    return assistant.shown(p, [F.desc("p_retailprice"), F.col("p_partkey")], model_columns=3)[1]


@query("json_merge", """SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, event_type AS t, CASE WHEN event_id % 2 = 0 THEN 7 ELSE 1 END AS x FROM events""")
def _(spark, folder) -> DataFrame:
    e = read_table(spark, folder, "events")
    over = F.concat(F.lit('{"t": "'), "event_type", F.lit('"'), F.when(F.col("event_id") % 2 == 0, ', "x": {"y": 7}').otherwise(""), F.lit("}"))
    merged = X.json_merge(F.regexp_replace("props", r"\}$", ', "x": {"y": 1, "z": 2}}'), over)
    e = e.select("event_id", merged.alias("m"))
    return e.select("event_id", *[F.get_json_object("m", path).cast(kind).alias(name) for name, path, kind in (("k", "$.k", "int"), ("t", "$.t", "string"), ("x", "$.x.y", "int"))])
