"""More queries with their SQL: guarded SQL, anchors, lookups, screens, sinks, events, JSON, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import anchor, assistant, guard, relations, screens, search, texts, trace, versions
from ..session import cut as cut_lineage
from ..session import read_table
from ..sources import content
from .catalog import BACK, FORWARD, ROOT, SQL, _root, _year, graph_query, query, walk_sql
from .graph import Graph

# --- guarded SQL ---

ASKED = "WITH k AS (SELECT kind, count(*) AS n FROM edges GROUP BY kind) SELECT kind, n FROM k WHERE n > 10 AND kind IN (SELECT kind FROM edges WHERE confidence >= 0.9) ORDER BY n DESC"


@graph_query("run_sql", " SELECT kind, count(*) AS n FROM edges GROUP BY kind HAVING count(*) > 10 AND max(confidence) >= 0.9")
def _(g: Graph, spark, folder) -> DataFrame:
    return guard.run_sql(spark, ASKED, {"edges": g.edges, "entities": g.entities, "refs": g.refs})


@graph_query("run_sql_capped", " SELECT least(count(*), 200)::BIGINT AS row_count, count(*) > 200 AS capped FROM entities WHERE kind = 'HTTP_CALL_SITE'")
def _(g: Graph, spark, folder) -> DataFrame:
    return guard.capped(guard.run_sql(spark, "SELECT id FROM entities WHERE kind = 'HTTP_CALL_SITE'", {"entities": g.entities}))


@graph_query("run_sql_evidence", " SELECT id, kind, repo, path FROM entities WHERE id IN (SELECT id FROM entities WHERE kind = 'SERVER_ROUTE' AND id LIKE '%1' ORDER BY id LIMIT 80)")
def _(g: Graph, spark, folder) -> DataFrame:
    return guard.cited(guard.run_sql(spark, "SELECT id, name FROM entities WHERE kind = 'SERVER_ROUTE' AND id LIKE '%1'", {"entities": g.entities}), g.entities)


# --- anchors ---


@graph_query("anchor", " SELECT c_custkey AS item_id, 'customer:' || c_custkey AS id, 'exact' AS match FROM customer")
def _(g: Graph, spark, folder) -> DataFrame:
    asked = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("item_id"), F.concat(F.lit("What does "), F.lower("c_name"), F.lit(" call, and who owns it?")).alias("text"))
    return anchor.anchor(g.entities, asked).select("item_id", "id", "match")


TRIGRAM = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("similar_names", f"""WITH t AS (SELECT DISTINCT p_type AS token, {TRIGRAM.format('p_type')} AS g FROM part), n AS (SELECT DISTINCT p_name AS name, {TRIGRAM.format('p_name')} AS g FROM part)
SELECT token, name, round(len(list_intersect(t.g, n.g))::DOUBLE / len(list_distinct(list_concat(t.g, n.g))), 6) AS score FROM t, n WHERE len(list_intersect(t.g, n.g)) > 0 AND len(list_intersect(t.g, n.g))::DOUBLE / len(list_distinct(list_concat(t.g, n.g))) >= 0.3""")
def _(spark, folder) -> DataFrame:
    p = read_table(spark, folder, "part")
    names = p.select(F.col("p_name").alias("name")).distinct().select(F.col("name").alias("id"), F.lit("PART").alias("kind"), "name", F.lit("").alias("path"))
    return anchor.similar_hits(p.select(F.col("p_type").alias("token")).distinct(), names).select("token", "name", F.round("score", 6).alias("score"))


def _side(side: str, reverse: bool, depth: int, most: int) -> str:
    along, against = (BACK, FORWARD) if reverse else (FORWARD, BACK)
    cte = walk_sql(along, against, 0.7, depth, 100, ROOT, "").replace("hops", f"hops_{side}").replace("hub ", f"hub_{side} ").replace("hub AS", f"hub_{side} AS").replace("w(depth", f"w_{side}(depth").replace("FROM w JOIN", f"FROM w_{side} w JOIN")
    return cte + f", n_{side} AS (SELECT '{side}' AS side, dst AS id, max(depth) AS depth, count(*) AS paths FROM (SELECT * FROM w_{side} ORDER BY depth, kind, src, dst, edge_id, path LIMIT {most + 1}) GROUP BY dst)"


@graph_query("lookup_one", _side("downstream", False, 4, 60) + _side("upstream", True, 2, 30) + " SELECT side, id, depth, paths, kind, name FROM (SELECT * FROM n_downstream UNION ALL SELECT * FROM n_upstream) JOIN entities USING (id)", recursive=True)
def _(g: Graph, spark, folder) -> DataFrame:
    return anchor.around(g.entities, g.edges, _year(g, 1997), _root(spark, folder)).select("side", "id", "depth", "paths", "kind", "name")


@graph_query("ambiguous_siblings", """, r AS (SELECT min(id) AS id FROM entities WHERE kind = 'HTTP_CALL_SITE'), s AS (SELECT src AS id, min(line) AS line FROM edges WHERE resolution = 'AMBIGUOUS' GROUP BY 1)
SELECT id, line FROM entities JOIN s USING (id) WHERE path = (SELECT any_value(path) FROM entities WHERE id = (SELECT id FROM r)) AND id <> (SELECT id FROM r) ORDER BY line, id LIMIT 12""")
def _(g: Graph, spark, folder) -> DataFrame:
    root = g.entities.filter("kind = 'HTTP_CALL_SITE'").agg(F.min("id")).first()[0]
    return anchor.siblings(g.entities, g.edges, root).select("id", "line")


# --- hybrid search ---


def _vector(spark, text: str) -> list[float]:
    return spark.range(1).select(X.hashed_vector(F.lit(text))).first()[0]


@query("search_passages")
def _(spark, folder) -> DataFrame:
    question = read_table(spark, folder, "benchmark").orderBy("item_id").first()["text"]
    cut = texts.passages(read_table(spark, folder, "documents"))
    cut = cut.select(F.concat_ws("#", "doc_id", "ordinal").alias("passage"), "doc_id", "heading_path", "text", X.hashed_vector("text").alias("vector"))
    # vectors are made once, not again with each of the lists that rank by them
    return search.search_passages(cut_lineage(cut), question, _vector(spark, question))


@query("search_switches")
def _(spark, folder) -> DataFrame:
    parts = read_table(spark, folder, "part").select(F.lower("p_name").alias("text")).distinct()
    # names are told apart and vectors made once, not again for the first key and each list
    switches = cut_lineage(parts.repartition("text").select(F.replace("text", F.lit(" "), F.lit("_")).alias("config_key"), "text", X.hashed_vector("text").alias("vector")))
    first = switches.agg(F.min("config_key")).first()[0]
    events = read_table(spark, folder, "events").select(F.col("event_type").alias("t"), F.col("user_id").alias("owner"), (F.col("value") > 50).alias("active"))
    overrides = events.select(F.lit(first).alias("config_key"), "owner", "active")
    question = f"What does the switch {first} do, and which parts are steel?"
    return search.search_switches(switches, overrides, question, _vector(spark, question))


@query("search_names")
def _(spark, folder) -> DataFrame:
    names = read_table(spark, folder, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey")).alias("ref"), F.col("s_name").alias("text"), X.hashed_vector("s_name").alias("vector"), F.col("s_nationkey").alias("owner"))
    owners = read_table(spark, folder, "nation").select(F.col("n_nationkey").alias("owner"), F.col("n_name").alias("company"))
    question = names.agg(F.min("text")).first()[0]
    return search.search_names(names, owners, question, _vector(spark, question))


@query("list_page", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 50 OFFSET 100")
def _(spark, folder) -> DataFrame:
    return search.page(read_table(spark, folder, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"], 100, 50)


@query("list_by_subkind", "SELECT p_brand AS subkind, count(*) AS n FROM (SELECT * FROM part WHERE p_size <= 20 ORDER BY p_name, p_partkey LIMIT 200) GROUP BY 1")
def _(spark, folder) -> DataFrame:
    p = read_table(spark, folder, "part").filter("p_size <= 20").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("subkind"))
    return search.by_subkind(search.list_entities(p))


# --- screens ---


@query("longest_prefix", """WITH f AS (SELECT DISTINCT p_brand || '/' || replace(p_type, ' ', '/') || '/' || p_partkey || '.rb' AS path FROM part),
d AS (SELECT DISTINCT p_brand AS folder FROM part WHERE p_size > 3 UNION SELECT DISTINCT p_brand || '/' || string_split(p_type, ' ')[1] FROM part WHERE p_size > 45)
SELECT path, arg_max(folder, length(folder)) AS owner FROM f JOIN d ON path = folder OR starts_with(path, folder || '/') OR starts_with(path, folder || '.') GROUP BY path""")
def _(spark, folder) -> DataFrame:
    p = read_table(spark, folder, "part")
    files = p.select(F.concat("p_brand", F.lit("/"), F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"), F.col("p_partkey"), F.lit(".rb")).alias("path")).distinct()
    folders = p.filter("p_size > 3").select(F.col("p_brand").alias("folder")).union(p.filter("p_size > 45").select(F.concat("p_brand", F.lit("/"), F.split("p_type", " ")[0]))).distinct()
    return screens.by_longest_prefix(files, folders.select("folder", F.col("folder").alias("owner")))


@query("nearest_above", """WITH m AS (SELECT user_id AS file, event_id AS line, event_id AS mark FROM events WHERE event_type = 'click'), t AS (SELECT user_id AS file, event_id AS line FROM events WHERE event_type = 'purchase')
SELECT t.file, t.line, (SELECT max(mark) FROM m WHERE m.file = t.file AND m.line <= t.line AND t.line - m.line <= 800) AS mark FROM t""")
def _(spark, folder) -> DataFrame:
    e = read_table(spark, folder, "events")
    marks = e.filter("event_type = 'click'").select(F.col("user_id").alias("file"), F.col("event_id").alias("line"), F.col("event_id").alias("mark"))
    targets = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("file"), F.col("event_id").alias("line"), F.lit("t").alias("target"))
    return screens.nearest_above(targets, marks, "file", "line", 800).select("file", "line", "mark")


@query("leads_to", """WITH a AS (SELECT 'u' || user_id AS screen, 'a' || event_id AS action, event_type AS name, event_id, user_id FROM events WHERE event_type IN ('click', 'view')),
n AS (SELECT action AS src, 'u' || (event_id % 7) AS dst FROM a UNION ALL SELECT screen, 'u' || (event_id % 7) FROM a WHERE event_id % 3 = 0),
v AS (SELECT screen, dst, string_agg(DISTINCT name, ' / ' ORDER BY name) AS via FROM n JOIN a ON a.action = n.src GROUP BY 1, 2)
SELECT DISTINCT src AS screen, n.dst AS "to", via FROM n LEFT JOIN v ON v.screen = src AND v.dst = n.dst WHERE src IN (SELECT screen FROM a)""")
def _(spark, folder) -> DataFrame:
    e = read_table(spark, folder, "events").filter("event_type in ('click', 'view')")
    a = e.select(F.concat(F.lit("u"), F.col("user_id")).alias("screen"), F.concat(F.lit("a"), F.col("event_id")).alias("action"), F.col("event_type").alias("name"), "event_id", F.concat(F.lit("u"), F.col("event_id") % 7).alias("dst"))
    navigations = a.select(F.col("action").alias("src"), "dst").union(a.filter("event_id % 3 = 0").select("screen", "dst"))
    return relations.leads_to(navigations, a.select("screen", "action"), a.select("action", "name"))


@graph_query("backend_apis", """, x AS (SELECT DISTINCT kind, src, dst FROM edges WHERE "commit" = 1997)
SELECT DISTINCT i.src AS screen, i.dst AS site, t.dst AS contract, h.dst AS handler FROM x i JOIN x t ON t.src = i.dst AND t.kind = 'TARGETS' LEFT JOIN x s ON s.dst = t.dst AND s.kind = 'SERVES' LEFT JOIN x h ON h.src = s.src AND h.kind = 'HANDLED_BY'
WHERE i.kind = 'ISSUES_HTTP' AND i.src IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_acctbal > 9000)""")
def _(g: Graph, spark, folder) -> DataFrame:
    rich = read_table(spark, folder, "customer").filter("c_acctbal > 9000").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("screen"))
    return relations.backend_apis(g.edges.filter("commit = 1997"), rich)


NAV_LINKS = """WITH RECURSIVE nav AS (SELECT DISTINCT lpad(s_nationkey::VARCHAR, 2, '0') AS src, lpad(c_nationkey::VARCHAR, 2, '0') AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
  WHERE c_nationkey = (s_nationkey * 3 + 1) % 25 OR c_nationkey = (s_nationkey + 5) % 25),
r(start, node, hops, path) AS (SELECT DISTINCT src, src, 0, [src] FROM nav UNION SELECT r.start, nav.dst, r.hops + 1, list_append(r.path, nav.dst) FROM r JOIN nav ON nav.src = r.node WHERE r.hops < 6 AND NOT list_contains(r.path, nav.dst))"""
NAV = NAV_LINKS + """,
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY hops, path) = 1),
c AS (SELECT unnest(['00', '05', '01', '10', '16', '21']) AS node)
SELECT start, node, hops, array_to_string(path, '>') AS path, len(list_filter(path, lambda x: x IN ('00', '05', '01', '10', '16', '21'))) AS covered FROM best WHERE hops > 0 AND start IN (SELECT node FROM c) AND node IN (SELECT node FROM c)
ORDER BY covered DESC, hops DESC, best.path LIMIT 1"""


def nav_links(spark, folder) -> DataFrame:
    """(src, dst) from nations of suppliers to some nations of the customers that they serve."""
    t = {n: read_table(spark, folder, n) for n in ("orders", "lineitem", "customer", "supplier")}
    rows = t["orders"].join(t["lineitem"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("c_custkey") == F.col("o_custkey")).join(t["supplier"], F.col("s_suppkey") == F.col("l_suppkey"))
    rows = rows.filter((F.col("c_nationkey") == (F.col("s_nationkey") * 3 + 1) % 25) | (F.col("c_nationkey") == (F.col("s_nationkey") + 5) % 25))
    name = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    return rows.select(name("s_nationkey").alias("src"), name("c_nationkey").alias("dst")).distinct()


@query("screen_journey", NAV)
def _(spark, folder) -> DataFrame:
    links = nav_links(spark, folder)
    wanted = spark.createDataFrame([(n,) for n in ("00", "05", "01", "10", "16", "21")], "node string")
    found = trace.shortest_paths(links, wanted.join(links, wanted["node"] == links["src"], "left_semi"))
    return trace.best_chain(found, wanted).withColumn("path", F.array_join("path", ">"))


@graph_query("depth_columns", walk_sql(FORWARD, BACK, 0.7, 3, 100, ROOT, """ SELECT id, depth, row_number() OVER (PARTITION BY depth ORDER BY id) AS place, parent FROM
(SELECT dst AS id, min(depth) AS depth, CASE WHEN count(DISTINCT src) = 1 THEN min(src) END AS parent FROM w GROUP BY dst)"""), recursive=True)
def _(g: Graph, spark, folder) -> DataFrame:
    return trace.depth_columns(trace.trace(g.edges, _year(g, 1997), _root(spark, folder), depth=3, max_rows=None))


# --- sinks ---


@graph_query("edge_sink", """, old AS (SELECT kind, src, dst, line AS site FROM edges WHERE "commit" = 1997 AND kind IN ('TARGETS', 'HANDLED_BY')),
new AS (SELECT kind, src, CASE WHEN line = 2 THEN dst || 'x' ELSE dst END AS dst, line AS site, confidence FROM edges WHERE "commit" IN (1997, 1998) AND kind IN ('TARGETS', 'HANDLED_BY', 'DECLARES'))
SELECT kind, src, dst, site, min(confidence) AS confidence FROM new WHERE src IN (SELECT id FROM entities) AND dst IN (SELECT id FROM entities) AND (kind, src, dst, site) NOT IN (SELECT (kind, src, dst, site) FROM old) GROUP BY 1, 2, 3, 4""")
def _(g: Graph, spark, folder) -> DataFrame:
    rows = g.edges.select("kind", "src", "dst", F.col("line").alias("site"), "confidence", "commit")
    old = rows.filter("commit = 1997 and kind in ('TARGETS', 'HANDLED_BY')")
    new = rows.filter("commit in (1997, 1998) and kind in ('TARGETS', 'HANDLED_BY', 'DECLARES')").withColumn("dst", F.when(F.col("site") == 2, F.concat("dst", F.lit("x"))).otherwise(F.col("dst"))).drop("commit")
    return content.insert_edges(old, new, g.entities)


@query("tree_sink", "SELECT DISTINCT source AS \"commit\", doc_id::VARCHAR AS path FROM documents WHERE doc_id % 3 <> 0")
def _(spark, folder) -> DataFrame:
    tree = content.document_tree(read_table(spark, folder, "documents")).select("commit", "path")
    return content.insert_new(tree.filter("cast(path as long) % 3 = 0"), tree.union(tree), ["commit", "path"])


@graph_query("describes", " SELECT DISTINCT 'DESCRIBES' AS kind, 'doc:' || o_orderstatus AS src, e.id AS dst FROM orders JOIN entities e ON e.\"commit\" = year(o_orderdate) AND e.path = 'app/orders/' || o_orderpriority WHERE o_orderkey % 500 = 1")
def _(g: Graph, spark, folder) -> DataFrame:
    o = read_table(spark, folder, "orders").filter("o_orderkey % 500 = 1").select(F.concat(F.lit("doc:"), F.col("o_orderstatus")).alias("doc"), F.year("o_orderdate").alias("commit"), F.concat(F.lit("app/orders/"), F.col("o_orderpriority")).alias("path"))
    return _described(o, g.entities)


def _described(o: DataFrame, entities: DataFrame) -> DataFrame:
    """Documents here are told apart by commit and file, so each is paired with the files of its own orders."""
    keyed = o.select(F.concat_ws("|", "doc", "commit", "path").alias("key"), "doc", "commit", "path").distinct()
    sites = entities.filter("commit is not null").select("id", "path", "commit")
    named = relations.describes(keyed.select(F.col("key").alias("doc"), F.col("key").alias("commit")), keyed.select(F.col("key").alias("commit"), "path"), sites.join(keyed.select("commit", "path", "key"), ["commit", "path"]).select("id", "path", F.col("key").alias("commit")))
    return named.select("kind", F.split("src", "[|]")[0].alias("src"), "dst").distinct()


@query("through_features", """WITH i AS (SELECT 'customer:' || c_custkey AS src, 'feature:' || c_mktsegment AS dst FROM customer WHERE c_custkey <= 3), s AS (SELECT DISTINCT 'feature:' || c_mktsegment AS subject FROM customer UNION ALL SELECT 'customer:' || c_custkey FROM customer WHERE c_custkey % 2 = 0)
SELECT subject FROM s WHERE subject IN (SELECT dst FROM i UNION SELECT src FROM i)""")
def _(spark, folder) -> DataFrame:
    c = read_table(spark, folder, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey")).alias("id"), F.concat(F.lit("feature:"), F.col("c_mktsegment")).alias("feature"), "c_custkey")
    edges = c.select(F.lit("IMPLEMENTS").alias("kind"), F.col("id").alias("src"), F.col("feature").alias("dst"))
    summaries = c.select(F.col("feature").alias("subject")).distinct().union(c.filter("c_custkey % 2 = 0").select("id"))
    return relations.through_features(summaries, edges, c.filter("c_custkey <= 3").select("id"))


@graph_query("unembedded_by_kind", " SELECT kind, count(*) AS n, count_if(length(name) % 2 = 0) AS unembedded FROM entities GROUP BY kind")
def _(g: Graph, *_a) -> DataFrame:
    cards = g.entities.select("id", "kind", F.sha2("id", 256).alias("card_hash"), (F.length("name") % 2 == 0).alias("missing"))
    stale = texts.stale_cards(cards, cards.filter("not missing"))
    return cards.join(stale.select(F.col("id").alias("s")), F.col("id") == F.col("s"), "left").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("s").alias("unembedded"))


@query("mention_links", """WITH m AS (SELECT p_partkey AS doc_id, unnest(string_split(p_name, ' ')) AS name FROM part WHERE p_partkey <= 50) SELECT doc_id, p_partkey AS id, count(*) AS n FROM m JOIN part ON string_split(p_name, ' ')[1] = name GROUP BY 1, 2""")
def _(spark, folder) -> DataFrame:
    p = read_table(spark, folder, "part")
    named = p.filter("p_partkey <= 50").select(F.col("p_partkey").alias("doc_id"), F.explode(F.split("p_name", " ")).alias("name")).groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"))
    return texts.link_mentions(named.withColumn("name", F.concat(F.lit("snake:"), F.col("name"))), p.select(F.col("p_partkey").alias("id"), F.split("p_name", " ")[0].alias("name")))


@query("unknown_paths", r"""WITH n AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{3,12}') AS w FROM documents), k AS (SELECT DISTINCT 'src/app/' || w[1] || '/' || w[2] || '.rb' AS known FROM n WHERE len(w) >= 3 AND doc_id % 2 = 0)
SELECT doc_id, 'app/' || w[1] || '/' || w[2] || '.rb' AS path FROM n WHERE len(w) >= 3 AND NOT EXISTS (SELECT 1 FROM k WHERE known = 'src/app/' || w[1] || '/' || w[2] || '.rb') UNION ALL SELECT doc_id, 'lib/' || w[3] || '.js' FROM n WHERE len(w) >= 3""")
def _(spark, folder) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,12})")).alias("w")).filter("size(w) >= 3")
    said = docs.select("doc_id", F.format_string("see app/%s/%s.rb, and lib/%s.js as well.", F.get("w", F.lit(0)), F.get("w", F.lit(1)), F.get("w", F.lit(2))).alias("text"))
    known = docs.filter("doc_id % 2 = 0").select(F.format_string("src/app/%s/%s.rb", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("path"))
    return texts.known_paths_only(said, known)


# --- events, JSON, evaluation ---


@query("filter_events", "SELECT event_id, event_type AS kind, NULL::VARCHAR AS path, 'see ' || CASE WHEN event_id % 2 = 0 THEN 'a file.' ELSE 'it' END AS text FROM events WHERE event_type <> 'view' AND event_type <> 'error'")
def _(spark, folder) -> DataFrame:
    e = read_table(spark, folder, "events")
    kind = F.when(F.col("event_type") == "error", "SYMBOL").otherwise("DOCUMENT")
    rows = e.select("event_id", F.when(F.col("event_type") == "view", "context_paths").otherwise("evidence").alias("type"), kind.alias("kind"), F.lit("app/a.rb").alias("path"), F.when(F.col("event_id") % 2 == 0, "see `app/models/bid.rb:40`.").otherwise("see it").alias("text"), F.col("event_type").alias("e"))
    return assistant.filter_events(rows, "cs").select("event_id", F.col("e").alias("kind"), "path", "text")


@graph_query("code_names", " SELECT DISTINCT name, CASE WHEN kind IN ('HTTP_CALL_SITE', 'HTTP_ENDPOINT', 'SERVER_ROUTE') THEN 'the API' ELSE 'the system' END AS stands_for FROM entities WHERE kind <> 'UI_ROUTE' AND length(name) >= 3")
def _(g: Graph, *_a) -> DataFrame:
    return assistant.code_names(g.entities, "cs")


@query("json_unnest", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def _(spark, folder) -> DataFrame:
    listed = read_table(spark, folder, "events").select(F.concat(F.lit('{"items": ['), F.col("props"), F.lit("]}")).alias("doc"))
    items = listed.select(F.explode(F.from_json("doc", "items array<struct<k: long>>")["items"]).alias("x"))
    return items.groupBy(F.col("x.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("json_contains", """SELECT count_if(CAST(json_extract(props, '$.k') AS INT) IN (1, 2)) AS holds, count(*) AS n FROM events""")
def _(spark, folder) -> DataFrame:
    doc = F.concat(F.lit('{"tags": [{"n": 1, "set": '), F.col("props"), F.lit('}, "x"], "k": null}'))
    holds = X.json_contains(doc, {"tags": [{"set": {"k": 1}}, "x"], "k": None}) | X.json_contains(doc, {"tags": [{"n": 1, "set": {"k": 2}}]})
    return read_table(spark, folder, "events").agg(F.count_if(holds).alias("holds"), F.count(F.lit(1)).alias("n"))


@query("failing_checks", "SELECT x AS \"check\", count(*) AS runs FROM (SELECT unnest(list_filter([CASE WHEN value > 50 THEN 'slow' END, CASE WHEN event_type = 'error' THEN 'error' END], lambda x: x IS NOT NULL)) AS x FROM events) GROUP BY 1")
def _(spark, folder) -> DataFrame:
    failed = F.filter(F.array(F.when(F.col("value") > 50, "slow"), F.when(F.col("event_type") == "error", "error")), lambda x: x.isNotNull())
    return assistant.failing_checks(read_table(spark, folder, "events").select(failed.alias("failed")))


@query("run_delta", """WITH a AS (SELECT event_id AS id, value > 40 AS p FROM events WHERE event_id % 5 <> 0), b AS (SELECT event_id AS id, value > 60 OR event_id % 7 = 0 AS p FROM events WHERE event_id % 4 <> 0)
SELECT id, CASE WHEN a.p IS NULL THEN 'added' WHEN b.p IS NULL THEN 'gone' WHEN b.p AND NOT a.p THEN 'fixed' ELSE 'broken' END AS change FROM a FULL JOIN b USING (id) WHERE a.p IS DISTINCT FROM b.p""")
def _(spark, folder) -> DataFrame:
    e = read_table(spark, folder, "events")
    old = e.filter("event_id % 5 <> 0").select(F.col("event_id").alias("id"), (F.col("value") > 40).alias("passed"))
    new = e.filter("event_id % 4 <> 0").select(F.col("event_id").alias("id"), ((F.col("value") > 60) | (F.col("event_id") % 7 == 0)).alias("passed"))
    return assistant.run_delta(old, new)


@graph_query("index_audit", " SELECT repo, kind, count(*) AS entities, count(DISTINCT path) AS files, count(DISTINCT blob) AS blobs FROM entities GROUP BY 1, 2")
def _(g: Graph, *_a) -> DataFrame:
    return versions.audit(g.entities)


@query("feature_summaries", "SELECT p_brand AS subject, count(*) AS touches, count(DISTINCT p_type) AS files, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank FROM part GROUP BY 1 ORDER BY rank LIMIT 10")
def _(spark, folder) -> DataFrame:
    return versions.top_subjects(read_table(spark, folder, "part").select(F.col("p_brand").alias("subject"), F.col("p_type").alias("path")), 10)


SQL["needs_context"] = r"""WITH q AS (SELECT conv_id, turn, trim(text, ' ') AS q, lower(trim(text, ' ')) AS l FROM conversations WHERE role = 'user'),
s AS (SELECT *, len(regexp_split_to_array(q, '\s+')) AS n, ' ' || regexp_replace(l, '[^a-z0-9_]+', ' ', 'g') || ' ' AS p FROM q),
t AS (SELECT *, len(list_filter(['and', 'also', 'what about', 'how about', 'then', 'so', 'but', 'now', 'ok', 'okay', 'next', 'same for', 'again'], lambda x: starts_with(l, x) AND NOT regexp_matches(substr(l, length(x) + 1, 1), '[a-z0-9_]'))) > 0 AS leads,
  len(list_filter(string_split('that,this,it,its,those,these,them,same,also,too,again,above,previous,earlier,last one,the other,instead,as well,and for,what about,how about,more detail,elaborate,expand,drill,deeper,which one,the second,the first', ','), lambda x: contains(p, ' ' || x || ' '))) > 0 AS leans FROM s)
SELECT conv_id, turn, q <> '' AND (leads OR n <= 6 OR (n <= 22 AND leans)) AS needs_context, contains(p, ' flow ') OR contains(p, ' journey ') OR contains(p, ' step ') OR contains(p, ' steps ') OR contains(p, ' walk me through ') OR contains(p, ' end to end ') OR regexp_matches(l, 'how (do|does|can) .* (get|go|move)') AS flow FROM t"""
SQL["html_to_text"] = r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS t FROM pages),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(t, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM t)
SELECT page_id, trim(regexp_replace(t, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS text FROM e"""
SQL["company_mentions"] = r"""WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[^A-Za-z0-9]+'), lambda x: x <> '') AS w, regexp_split_to_array(text, '[^A-Za-z0-9]+') AS n FROM benchmark),
g AS (SELECT DISTINCT item_id, lower(array_to_string(w[i:i + k - 1], ' ')) AS phrase FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item_id, w, unnest([1, 2, 3, 4]) AS k FROM w)) WHERE regexp_matches(w[i], '^[A-Z]')),
s AS (SELECT DISTINCT item_id AS owner, lower(array_to_string(n[1:k], ' ')) AS phrase FROM (SELECT item_id, n, unnest([1, 2, 3, 4]) AS k FROM w))
SELECT item_id, owner FROM (SELECT DISTINCT item_id, owner FROM g JOIN s USING (phrase)) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY owner) <= 6"""
