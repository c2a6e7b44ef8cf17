"""Queries over the driver's tables, one for each operator, each with SQL that says what it must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import assistant, configs, live, relations, scope, search, texts, trace, versions
from ..session import read_table
from ..sources import content
from ..streaming import sync
from .graph import GRAPH_SQL, Graph, stored_graph

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}
EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, folder) under a name with its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def graph_query(name: str, sql: str | None = None, recursive: bool = False):
    """Registers a function of (graph, spark, folder); its SQL follows the graph's views."""

    def add(f):
        head = "WITH RECURSIVE " if recursive else "WITH "
        query(name, None if sql is None else head + GRAPH_SQL + sql)(lambda spark, folder: f(stored_graph(spark, folder), spark, folder))
        return f

    return add


# --- scope ---

MAIN = """, scope AS (SELECT arg_max("commit", last_seen) AS "commit" FROM refs WHERE ref = 'main')"""


@graph_query("resolve_scope", """ SELECT repo, ref, arg_max("commit", last_seen) AS "commit" FROM refs WHERE ref IN ('main', 'release-1997') GROUP BY repo, ref""")
def _(g: Graph, *_a) -> DataFrame:
    return scope.resolve_scope(g.refs, ["main", "release-1997"])


@graph_query("v_refs", """ SELECT repo, ref, "commit", CAST(last_seen AS VARCHAR) AS last_seen FROM refs QUALIFY row_number() OVER (PARTITION BY repo, ref ORDER BY last_seen DESC) = 1""")
def _(g: Graph, *_a) -> DataFrame:
    return scope.v_refs(g.refs).withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


@graph_query("v_nodes", """, now AS (SELECT ref, "commit" AS c FROM refs QUALIFY row_number() OVER (PARTITION BY repo, ref ORDER BY last_seen DESC) = 1)
SELECT kind, ref, "commit" IS NULL AS is_contract, count(*) AS n FROM entities LEFT JOIN now ON c = "commit" GROUP BY ALL""")
def _(g: Graph, *_a) -> DataFrame:
    return scope.v_nodes(g.entities, g.refs).groupBy("kind", "ref", "is_contract").agg(F.count(F.lit(1)).alias("n"))


@graph_query("v_edges", """ SELECT e.kind, a.kind AS src_kind, b.kind AS dst_kind, count(*) AS n, count(DISTINCT a.name) AS src_names FROM edges e JOIN entities a ON a.id = src JOIN entities b ON b.id = dst GROUP BY ALL""")
def _(g: Graph, *_a) -> DataFrame:
    return scope.v_edges(g.edges, g.entities).groupBy("kind", "src_kind", "dst_kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src_name").alias("src_names"))


# --- traversal ---

def walk_sql(along: str, against: str, floor: float, depth: int, hub: int, root: str, tail: str, commit: str = "1997") -> str:
    return f""", hub AS (SELECT dst AS id FROM edges GROUP BY 1 HAVING count(*) > {hub}),
hops AS (SELECT edge_id, kind, confidence, "commit", resolution, CASE WHEN kind IN ({along}) THEN src ELSE dst END AS f, CASE WHEN kind IN ({along}) THEN dst ELSE src END AS t
  FROM edges WHERE kind IN ({along}, {against}) AND confidence >= {floor} AND "commit" = {commit}),
w(depth, kind, src, dst, edge_id, confidence, resolution, path) AS (
  SELECT 1, kind, f, t, edge_id, confidence, resolution, [f, t] FROM hops WHERE f = {root}
  UNION ALL SELECT w.depth + 1, h.kind, h.f, h.t, h.edge_id, h.confidence, h.resolution, list_append(w.path, h.t)
  FROM w JOIN hops h ON h.f = w.dst WHERE w.depth < {depth} AND NOT list_contains(w.path, h.t) AND NOT EXISTS (SELECT 1 FROM hub x WHERE x.id = w.dst))
{tail}"""


ROOT = "(SELECT 'customer:' || min(o_custkey) FROM o WHERE \"commit\" = 1997)"
FORWARD, BACK = "'ISSUES_HTTP', 'TARGETS', 'HANDLED_BY', 'DECLARES'", "'SERVES'"
ROWS = """ SELECT depth, kind, src, dst, edge_id, confidence, resolution, array_to_string(path, '>') AS path FROM w"""


def _root(spark: SparkSession, folder: str) -> str:
    orders = read_table(spark, folder, "orders")
    return "customer:" + str(orders.filter(F.year("o_orderdate") == 1997).agg(F.min("o_custkey")).first()[0])


def _year(g: Graph, year: int) -> DataFrame:
    return scope.resolve_scope(g.refs, [f"release-{year}"])


def _paths(rows: DataFrame) -> DataFrame:
    return rows.select("depth", "kind", "src", "dst", "edge_id", "confidence", "resolution", F.array_join("path", ">").alias("path"))


@graph_query("trace_forward", walk_sql(FORWARD, BACK, 0.7, 6, 100, ROOT, ROWS), recursive=True)
def _(g: Graph, spark, folder) -> DataFrame:
    return _paths(trace.trace(g.edges, _year(g, 1997), _root(spark, folder), max_rows=None))


@graph_query("trace_top", walk_sql(FORWARD, BACK, 0.7, 6, 100, ROOT, ROWS.replace("array_to_string(path, '>') AS path", "array_to_string(path, '>') AS path, path AS p").replace(" SELECT depth", " SELECT * EXCLUDE (p) FROM (SELECT depth") + " ORDER BY depth, kind, src, dst, edge_id, p LIMIT 41)"), recursive=True)
def _(g: Graph, spark, folder) -> DataFrame:
    return _paths(trace.trace(g.edges, _year(g, 1997), _root(spark, folder), max_rows=40))


@graph_query("trace_hub_guard", walk_sql(FORWARD, BACK, 0.7, 6, 50, ROOT, " SELECT depth, kind, count(*) AS n, count(DISTINCT dst) AS nodes, count_if(dst IN (SELECT id FROM hub)) AS hub_rows FROM w GROUP BY ALL"), recursive=True)
def _(g: Graph, spark, folder) -> DataFrame:
    rows = trace.trace(g.edges, _year(g, 1997), _root(spark, folder), max_rows=None, hub_above=50)
    return rows.groupBy("depth", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dst").alias("nodes"), F.count_if("dst_is_hub").alias("hub_rows"))


@graph_query("trace_reverse", walk_sql(BACK, FORWARD, 0.9, 3, 100, "(SELECT 'part:' || min(p_partkey) FROM part)", ROWS), recursive=True)
def _(g: Graph, spark, folder) -> DataFrame:
    root = "part:" + str(read_table(spark, folder, "part").agg(F.min("p_partkey")).first()[0])
    return _paths(trace.trace(g.edges, _year(g, 1997), root, direction="reverse", depth=3, confidence="high", max_rows=None))


@graph_query("trace_nodes", walk_sql(FORWARD, BACK, 0.7, 4, 100, ROOT, " SELECT dst AS id, max(depth) AS depth, count(*) AS paths, any_value(e.kind) AS kind, any_value(e.name) AS name FROM w JOIN entities e ON e.id = dst GROUP BY dst"), recursive=True)
def _(g: Graph, spark, folder) -> DataFrame:
    rows = trace.trace(g.edges, _year(g, 1997), _root(spark, folder), depth=4, max_rows=None)
    return trace.trace_nodes(rows, g.entities).select("id", "depth", "paths", "kind", "name")


@graph_query("hub_nodes", """ SELECT dst AS id, count(*) AS in_degree FROM edges GROUP BY 1 HAVING count(*) > 50""")
def _(g: Graph, *_a) -> DataFrame:
    return trace.hubs(g.edges, 50)


@graph_query("screen_paths", """, nav AS (SELECT DISTINCT 'n' || s_nationkey AS src, 'n' || c_nationkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
  WHERE c_nationkey = (s_nationkey * 3 + 1) % 25 OR c_nationkey = (s_nationkey + 5) % 25),
r(start, node, hops) AS (SELECT DISTINCT src, src, 0 FROM nav UNION SELECT r.start, nav.dst, r.hops + 1 FROM r JOIN nav ON nav.src = r.node WHERE r.hops < 6)
SELECT start, node, min(hops) AS hops FROM r GROUP BY 1, 2""", recursive=True)
def _(g: Graph, spark, folder) -> DataFrame:
    t = {n: read_table(spark, folder, n) for n in ("orders", "lineitem", "customer", "supplier")}
    rows = t["orders"].join(t["lineitem"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("c_custkey") == F.col("o_custkey")).join(t["supplier"], F.col("s_suppkey") == F.col("l_suppkey"))
    links = rows.filter((F.col("c_nationkey") == (F.col("s_nationkey") * 3 + 1) % 25) | (F.col("c_nationkey") == (F.col("s_nationkey") + 5) % 25))
    links = links.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst")).distinct()
    return trace.shortest_paths(links, links.select(F.col("src").alias("node")).distinct()).select("start", "node", "hops")


# --- relations ---

@graph_query("evidence", """, names AS (SELECT "commit", string_agg(DISTINCT ref, ', ' ORDER BY ref) AS refs FROM refs GROUP BY 1)
SELECT id, kind, name, path, repo, "commit", blob, refs FROM entities LEFT JOIN names USING ("commit") WHERE kind IN ('HTTP_CALL_SITE', 'HANDLER')""")
def _(g: Graph, *_a) -> DataFrame:
    return relations.evidence(g.entities, g.refs, g.entities.filter("kind in ('HTTP_CALL_SITE', 'HANDLER')").select("id"))


@graph_query("evidence_missing", """ SELECT DISTINCT src AS id FROM (SELECT 'customer:' || event_id AS src FROM events) WHERE src NOT IN (SELECT id FROM entities)""")
def _(g: Graph, spark, folder) -> DataFrame:
    asked = read_table(spark, folder, "events").select(F.concat(F.lit("customer:"), F.col("event_id").cast("string")).alias("id")).distinct()
    return relations.missing(g.entities, asked)


STATUS = """, cov AS (SELECT id, coalesce(count_if(e.kind = 'TARGETS' AND e."commit" = 1997), 0) AS fe, coalesce(count_if(e.kind = 'SERVES' AND e."commit" = 1998), 0) AS be
  FROM entities LEFT JOIN edges e ON e.dst = id WHERE entities.kind = 'HTTP_ENDPOINT' GROUP BY id),
st AS (SELECT *, CASE WHEN fe > 0 AND be > 0 THEN 'joined' WHEN fe > 0 THEN 'called_not_served' WHEN be > 0 THEN 'served_not_called' ELSE 'unseen' END AS status FROM cov)"""


@graph_query("endpoint_status", STATUS + " SELECT * FROM st")
def _(g: Graph, *_a) -> DataFrame:
    return relations.coverage(g.entities, g.edges, _year(g, 1997), _year(g, 1998))


@graph_query("endpoint_coverage", STATUS + " SELECT count_if(status = 'joined') AS joined, count_if(status = 'called_not_served') AS called_but_not_served, count_if(status = 'served_not_called') AS served_but_not_called FROM st")
def _(g: Graph, *_a) -> DataFrame:
    return relations.coverage_totals(relations.coverage(g.entities, g.edges, _year(g, 1997), _year(g, 1998)))


@graph_query("endpoint_family", """, here AS (SELECT * FROM edges WHERE "commit" = 1997),
c AS (SELECT dst AS id, string_agg(DISTINCT src, ' ' ORDER BY src) AS callers FROM here WHERE kind = 'TARGETS' GROUP BY 1),
s AS (SELECT v.dst AS id, string_agg(DISTINCT concat_ws(' > ', v.src, h.dst), ' ' ORDER BY concat_ws(' > ', v.src, h.dst)) AS served_by FROM here v LEFT JOIN here h ON h.src = v.src AND h.kind = 'HANDLED_BY' WHERE v.kind = 'SERVES' GROUP BY 1)
SELECT id, name, path, coalesce(callers, '') AS callers, coalesce(served_by, '') AS served_by,
  CASE WHEN callers IS NOT NULL AND served_by IS NOT NULL THEN 'joined' WHEN callers IS NOT NULL THEN 'called_not_served' ELSE 'served_not_called' END AS status
FROM entities LEFT JOIN c USING (id) LEFT JOIN s USING (id) WHERE kind = 'HTTP_ENDPOINT' AND starts_with(path, '/parts/Brand#1') ORDER BY path, id LIMIT 60""")
def _(g: Graph, *_a) -> DataFrame:
    out = relations.family(g.entities, g.edges, _year(g, 1997), "/parts/Brand#1")
    return out.withColumn("callers", F.array_join("callers", " ")).withColumn("served_by", F.array_join("served_by", " "))


@graph_query("unresolved_callers", """ SELECT src AS id, min(line) AS line, count(*) AS calls FROM edges WHERE "commit" = 1997 AND kind = 'TARGETS' AND resolution = 'AMBIGUOUS'
AND dst IN (SELECT id FROM entities WHERE kind = 'HTTP_ENDPOINT' AND starts_with(path, '/parts/Brand#1')) GROUP BY 1""")
def _(g: Graph, *_a) -> DataFrame:
    return relations.unresolved_callers(g.entities, g.edges, _year(g, 1997), "/parts/Brand#1")


@query("owners_of", """SELECT 'customer:' || o_custkey AS person, count(*) AS commits, CAST(max(o_orderdate) AS VARCHAR) AS last_commit, count(DISTINCT o_orderpriority) AS nodes
FROM orders GROUP BY 1 ORDER BY commits DESC, person LIMIT 10""")
def _(spark, folder) -> DataFrame:
    o = read_table(spark, folder, "orders")
    touches = o.select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("person"), F.col("o_orderpriority").alias("node"), F.col("o_orderpriority").alias("path"), F.lit(1).alias("commits"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("last_commit"))
    return relations.owners(touches)


@query("summaries", """SELECT n_name AS headline, CASE n_regionkey WHEN 0 THEN 'system' WHEN 1 THEN 'feature' WHEN 2 THEN 'module' ELSE 'file' END AS altitude, CASE WHEN n_nationkey % 2 = 0 THEN 'all' ELSE 'cs' END AS audience FROM nation
WHERE n_nationkey % 2 = 0 ORDER BY CASE n_regionkey WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END, n_name LIMIT 8""")
def _(spark, folder) -> DataFrame:
    n = read_table(spark, folder, "nation")
    altitude = F.when(F.col("n_regionkey") == 0, "system").when(F.col("n_regionkey") == 1, "feature").when(F.col("n_regionkey") == 2, "module").otherwise("file")
    return relations.summaries(n.select(F.col("n_name").alias("headline"), altitude.alias("altitude"), F.when(F.col("n_nationkey") % 2 == 0, "all").otherwise("cs").alias("audience")), "engineer", limit=8)


@query("screen_actions", """WITH a AS (SELECT user_id AS screen, event_type AS name, CASE event_type WHEN 'view' THEN 'step' WHEN 'click' THEN 'button' WHEN 'purchase' THEN 'tab' ELSE 'menu' END AS role, min(event_id) AS line FROM events GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY screen ORDER BY CASE role WHEN 'step' THEN 0 WHEN 'tab' THEN 1 WHEN 'button' THEN 2 WHEN 'menu' THEN 3 ELSE 4 END, line, name) AS n FROM a""")
def _(spark, folder) -> DataFrame:
    e = read_table(spark, folder, "events")
    role = F.when(F.col("event_type") == "view", "step").when(F.col("event_type") == "click", "button").when(F.col("event_type") == "purchase", "tab").otherwise("menu")
    return relations.screen_actions(e.select(F.col("user_id").alias("screen"), F.col("event_type").alias("name"), role.alias("role"), F.col("event_id").alias("line")))


@query("screens_named", r"""WITH q AS (SELECT item_id, ' ' || trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) || ' ' AS q FROM benchmark),
n AS (SELECT DISTINCT lower(regexp_extract(text, '[A-Za-z]+ [a-z]+')) AS name, item_id AS screen FROM benchmark WHERE regexp_matches(text, '^[A-Za-z]+ [a-z]+'))
SELECT q.item_id, n.screen, min(strpos(q, ' ' || name || ' ')) AS position FROM q JOIN n ON strpos(q, ' ' || name || ' ') > 0 GROUP BY 1, 2""")
def _(spark, folder) -> DataFrame:
    b = read_table(spark, folder, "benchmark")
    names = b.filter(F.col("text").rlike("^[A-Za-z]+ [a-z]+")).select(F.col("item_id").alias("screen"), F.lower(F.regexp_extract("text", "[A-Za-z]+ [a-z]+", 0)).alias("name")).distinct()
    return relations.named_in(names, b)


# --- search ---

TRI = """list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""
SIM = f"len(list_intersect({TRI.format('name')}, {TRI.format("'{q}'")}))::DOUBLE / len(list_distinct(list_concat({TRI.format('name')}, {TRI.format("'{q}'")})))"


@graph_query("find_entity", """, u AS (SELECT *, 'exact_fqn' AS match_reason, 1.0::DOUBLE AS score FROM entities WHERE id = 'nation'
  UNION ALL SELECT *, 'name_trigram', """ + SIM.replace("{q}", "nation_1") + """ FROM entities WHERE kind = 'HANDLER' AND """ + SIM.replace("{q}", "nation_1") + """ >= 0.3
  UNION ALL SELECT *, 'path_substring', 0.3 FROM entities WHERE kind = 'HANDLER' AND contains(lower(path), 'nation_1'))
SELECT id, kind, name, path, "commit", match_reason, round(score, 6) AS score, true AS weak FROM u ORDER BY score DESC, kind, id LIMIT 20""")
def _(g: Graph, *_a) -> DataFrame:
    return search.find_entity(g.entities, "nation_1", kind="HANDLER").withColumn("score", F.round("score", 6))


@graph_query("find_by_path", """ SELECT id, kind, name, path, "commit", 'path_substring' AS match_reason, 0.9::DOUBLE AS score, true AS weak FROM entities WHERE contains(lower(path), 'lib/nations') ORDER BY kind, id LIMIT 20""")
def _(g: Graph, *_a) -> DataFrame:
    return search.find_entity(g.entities, "lib/nations").filter("match_reason = 'path_substring'")


@query("name_similarity", "SELECT p_partkey, round(" + SIM.replace("{q}", "blue steel").replace("name", "p_name") + ", 6) AS score FROM part WHERE " + SIM.replace("{q}", "blue steel").replace("name", "p_name") + " >= 0.3")
def _(spark, folder) -> DataFrame:
    return read_table(spark, folder, "part").select("p_partkey", F.round(X.trigram_similarity("p_name", F.lit("blue steel")), 6).alias("score")).filter("score >= 0.3")


@graph_query("list_entities", """ SELECT id, kind, name, path FROM entities WHERE kind = 'UI_ROUTE' AND path LIKE 'app/B%' ORDER BY name, id LIMIT 200""")
def _(g: Graph, *_a) -> DataFrame:
    return search.list_entities(g.entities, kind="UI_ROUTE", path_prefix="app/B").select("id", "kind", "name", "path")


@graph_query("list_total", """ SELECT count(*) AS total, least(count(*), 200) AS returned, count(*) <= 200 AS complete FROM entities WHERE kind = 'UI_ROUTE' AND path LIKE 'app/B%'""")
def _(g: Graph, *_a) -> DataFrame:
    return search.list_total(g.entities, kind="UI_ROUTE", path_prefix="app/B")


@query("nearest_vectors", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS c FROM embeddings, q)
SELECT vec_id, label, round(c, 6) AS score, row_number() OVER (ORDER BY c DESC, vec_id) AS rank FROM s ORDER BY rank LIMIT 10""")
def _(spark, folder) -> DataFrame:
    v = read_table(spark, folder, "embeddings")
    seed = v.filter("vec_id = 7").first()["embedding"]
    return search.nearest(v, seed).select("vec_id", "label", F.round("score", 6).alias("score"), "rank")


@query("fuse_ranks", """WITH a AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 200), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS rank FROM part QUALIFY rank <= 200)
SELECT p_partkey, round(sum(1.0 / (60 + rank)), 5) AS fused FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def _(spark, folder) -> DataFrame:
    from pyspark.sql import Window

    p = read_table(spark, folder, "part")
    lists = [p.orderBy(F.desc(c), "p_partkey").limit(200).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(c), "p_partkey"))) for c in ("p_retailprice", "p_size")]
    return search.fuse(lists, "p_partkey")


@query("clear_top", """WITH s AS (SELECT p_brand, p_partkey, p_retailprice / (SELECT max(p_retailprice) FROM part) AS score FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS n FROM s WHERE score >= 0.5),
p AS (SELECT p_brand, max(score) FILTER (n = 1) AS s1, max(score) FILTER (n = 2) AS s2, max(score) FILTER (n = 3) AS s3 FROM r GROUP BY 1),
k AS (SELECT p_brand, CASE WHEN s2 IS NOT NULL AND s1 - s2 <= 0.05 AND (s3 IS NULL OR s2 - s3 >= 0.003) THEN 2 WHEN s2 IS NULL OR s1 - s2 >= 0.003 THEN 1 ELSE 0 END AS keep FROM p)
SELECT p_brand, p_partkey, round(score, 6) AS score, n AS rank FROM r JOIN k USING (p_brand) WHERE n <= keep""")
def _(spark, folder) -> DataFrame:
    p = read_table(spark, folder, "part")
    top = p.agg(F.max("p_retailprice").alias("m"))
    rows = p.crossJoin(F.broadcast(top)).select("p_brand", "p_partkey", (F.col("p_retailprice") / F.col("m")).alias("score"))
    return search.clear_top(rows, "p_brand", "p_partkey", "score", margin=0.003).withColumn("score", F.round("score", 6))


@query("search_documents")
def _(spark, folder) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    item = read_table(spark, folder, "benchmark").orderBy("item_id").first()["text"].lower().split()
    vectors = read_table(spark, folder, "embeddings").withColumnRenamed("vec_id", "doc_id")
    seed = vectors.orderBy("doc_id").first()["embedding"]
    meaning = search.nearest(vectors, seed, k=18, id_column="doc_id").select("doc_id", "score", "rank")
    words = search.by_words(docs, [w for w in item if w.isalpha()], 12, "doc_id").select("doc_id", "rank")
    return search.hybrid(meaning, words, "doc_id", 6, 0.2)


@query("lexical_query", r"""SELECT item_id, array_to_string(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]{3,}'), lambda x: NOT list_contains([%s], x))).list_sort(), ' ') AS words FROM benchmark""" % ", ".join(f"'{w}'" for w in X.STOP_WORDS))
def _(spark, folder) -> DataFrame:
    return read_table(spark, folder, "benchmark").select("item_id", F.array_join(F.array_sort(X.content_words("text")), " ").alias("words"))


@query("normalise_endpoint", r"""WITH p AS (SELECT page_id, regexp_replace('/' || regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '/+', '/', 'g') AS p FROM pages)
SELECT page_id, CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/$', '') END AS path FROM p""")
def _(spark, folder) -> DataFrame:
    return read_table(spark, folder, "pages").select("page_id", X.endpoint_path("url").alias("path"))


# --- versions ---

SNAP = """, a AS (SELECT * FROM entities WHERE kind = 'HTTP_CALL_SITE' AND "commit" = 1997), b AS (SELECT * FROM entities WHERE kind = 'HTTP_CALL_SITE' AND "commit" = 1998)"""
DIFF = """WITH a AS (SELECT DISTINCT o_custkey::VARCHAR AS id, max(o_orderpriority) AS path FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1), b AS (SELECT DISTINCT o_custkey::VARCHAR AS id, max(o_orderpriority) AS path FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1)
SELECT id, 'added' AS change FROM b ANTI JOIN a USING (id) UNION ALL SELECT id, 'removed' FROM a ANTI JOIN b USING (id) UNION ALL SELECT a.id, 'moved' FROM a JOIN b USING (id) WHERE a.path <> b.path"""


def _customers_of(spark, folder, year: int) -> DataFrame:
    o = read_table(spark, folder, "orders").filter(F.year("o_orderdate") == year)
    return o.groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.max("o_orderpriority").alias("path"))


@query("entity_diff", DIFF)
def _(spark, folder) -> DataFrame:
    return versions.entity_diff(_customers_of(spark, folder, 1997), _customers_of(spark, folder, 1998), key=["id"])


@graph_query("gc_survivors", """ SELECT DISTINCT repo, "commit" FROM (SELECT *, row_number() OVER (PARTITION BY repo, ref ORDER BY last_seen DESC) AS n FROM refs WHERE ref = 'main') WHERE n <= 3""")
def _(g: Graph, *_a) -> DataFrame:
    return versions.survivors(g.refs.filter("ref = 'main'"), 3)


@graph_query("gc_dead_edges", """, s AS (SELECT "commit" FROM (SELECT *, row_number() OVER (PARTITION BY repo, ref ORDER BY last_seen DESC) AS n FROM refs WHERE ref = 'main') WHERE n <= 3)
SELECT "commit", count(*) AS n FROM edges WHERE "commit" NOT IN (SELECT "commit" FROM s) GROUP BY 1""")
def _(g: Graph, *_a) -> DataFrame:
    return versions.collectable(g.edges, versions.survivors(g.refs.filter("ref = 'main'"), 3))


@graph_query("quality_delta", """, a AS (SELECT kind, count(*) AS n FROM edges WHERE "commit" = 1997 GROUP BY 1), b AS (SELECT kind, count(*) AS n FROM edges WHERE "commit" = 2001 AND kind <> 'DECLARES' GROUP BY 1)
SELECT kind, coalesce(a.n, 0) AS "before", coalesce(b.n, 0) AS "after", coalesce(b.n, 0) - coalesce(a.n, 0) AS delta,
CASE WHEN coalesce(a.n, 0) > 0 AND coalesce(b.n, 0) = 0 THEN 'vanished' WHEN coalesce(b.n, 0) < coalesce(a.n, 0) * 0.98 THEN 'dropped' ELSE 'ok' END AS warning FROM a FULL JOIN b USING (kind)""")
def _(g: Graph, *_a) -> DataFrame:
    return versions.quality_delta(g.edges.filter("commit = 1997"), g.edges.filter("commit = 2001 and kind <> 'DECLARES'"))


@graph_query("carry_forward", """ SELECT kind, resolution, count(*) AS n FROM edges WHERE "commit" = 1997 AND resolution = 'RUNTIME' AND kind = 'SERVES' AND src IN (SELECT id FROM entities WHERE kind = 'SERVER_ROUTE') AND dst IN (SELECT id FROM entities WHERE name NOT LIKE 'b%') GROUP BY ALL""")
def _(g: Graph, *_a) -> DataFrame:
    old = g.entities.filter("kind in ('SERVER_ROUTE', 'HTTP_ENDPOINT')")
    new = old.withColumn("blob", F.when(F.col("name").startswith("b"), F.lit("changed")).otherwise(F.col("blob")))
    kept = versions.carry_forward(g.edges.filter("commit = 1997 and resolution = 'RUNTIME' and kind = 'SERVES'"), old, new)
    return kept.groupBy("kind", "resolution").agg(F.count(F.lit(1)).alias("n"))


@query("cache_misses", """SELECT DISTINCT sha1(text) AS blob FROM documents WHERE source <> 'src1' AND sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE source = 'src1')""")
def _(spark, folder) -> DataFrame:
    tree = content.document_tree(read_table(spark, folder, "documents"))
    facts = tree.filter("commit = 'src1'").select("blob", F.lit("docs").alias("extractor"), F.lit("1.0").alias("version"))
    return versions.cache_misses(tree.filter("commit <> 'src1'"), facts, "docs", "1.0")


@query("dedup_ratio", "SELECT count(*) AS files, count(DISTINCT sha1(text)) AS blobs, round(1 - count(DISTINCT sha1(text)) / count(*), 6) AS shared FROM documents")
def _(spark, folder) -> DataFrame:
    return versions.dedup_ratio(content.document_tree(read_table(spark, folder, "documents")))


@query("snapshot_resolve", r"""SELECT DISTINCT 'c' || page_id % 3 AS "commit", page_id::VARCHAR AS path, unnest(list_distinct(regexp_extract_all(lower(url || ' ' || html), 'https?://([a-z0-9.-]+\.[a-z]{2,})', 1))) AS fact FROM pages""")
def _(spark, folder) -> DataFrame:
    pages = read_table(spark, folder, "pages")
    docs = pages.select(F.col("page_id").alias("doc_id"), F.concat_ws(" ", "url", "html").alias("text"), F.concat(F.lit("c"), F.col("page_id") % 3).alias("source"))
    tree = content.document_tree(docs)
    none = tree.limit(0).select("blob", F.lit("").alias("extractor"), F.lit("").alias("version"))
    facts = content.new_facts(tree, content.blob_texts(docs), none, "hosts", "1.0", content.external_hosts)
    return content.resolve(tree, facts)


@query("entity_upsert", """SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_name || '!' END, c_name) AS name, coalesce(CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 END, c_acctbal) AS balance FROM customer""")
def _(spark, folder) -> DataFrame:
    c = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    new = c.select("id", F.when(F.col("id") % 3 == 0, F.concat("name", F.lit("!"))).alias("name"), F.when(F.col("id") % 5 == 0, F.col("balance") + 1).alias("balance"))
    return versions.upsert(c, new.filter("id % 3 = 0 or id % 5 = 0"), ["id"])


@query("path_activity", """SELECT o_orderpriority AS path, count(DISTINCT o_custkey) FILTER (o_orderdate >= TIMESTAMP '2000-06-30') AS people, count_if(o_orderdate >= TIMESTAMP '2000-06-30') AS touches, CAST(max(o_orderdate) AS VARCHAR) AS last_commit FROM orders GROUP BY 1""")
def _(spark, folder) -> DataFrame:
    o = read_table(spark, folder, "orders").select(F.col("o_custkey").alias("person"), F.col("o_orderpriority").alias("path"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return versions.activity(o, "2001-06-30").withColumn("last_commit", F.date_format("last_commit", "yyyy-MM-dd HH:mm:ss"))


# --- configurations ---

EFFECTIVE = """WITH d(config_key, value) AS (VALUES ('view', 'off'), ('click', 'on'), ('error', 'off')),
m AS (SELECT c_mktsegment AS grp, 'click' AS config_key, 'off' AS value FROM customer WHERE c_mktsegment LIKE '%U%' GROUP BY 1),
ov AS (SELECT user_id AS owner, event_type AS config_key, CASE WHEN value > 50 THEN 'on' ELSE 'off' END AS value, ts FROM events WHERE event_type IN ('view', 'click', 'error') AND event_id % 4 <> 0),
last AS (SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY owner, config_key ORDER BY ts DESC, value DESC) = 1),
eff AS (SELECT c_custkey AS owner, c_mktsegment AS grp, d.config_key, CASE WHEN l.owner IS NOT NULL THEN l.value WHEN m.grp IS NOT NULL THEN m.value ELSE d.value END AS value,
  CASE WHEN l.owner IS NOT NULL THEN 'override' WHEN m.grp IS NOT NULL THEN 'master' ELSE 'default' END AS source
  FROM customer CROSS JOIN d LEFT JOIN m ON m.grp = c_mktsegment AND m.config_key = d.config_key LEFT JOIN last l ON l.owner = c_custkey AND l.config_key = d.config_key)
"""


def _effective(spark, folder) -> DataFrame:
    customer, events = read_table(spark, folder, "customer"), read_table(spark, folder, "events")
    defaults = spark.createDataFrame([("view", "off"), ("click", "on"), ("error", "off")], "config_key string, value string")
    owners = customer.select(F.col("c_custkey").alias("owner"), F.col("c_mktsegment").alias("grp"))
    masters = owners.filter(F.col("grp").contains("U")).select("grp", F.lit("click").alias("config_key"), F.lit("off").alias("value")).distinct()
    overrides = events.filter(F.col("event_type").isin("view", "click", "error")).select(F.col("user_id").alias("owner"), F.col("event_type").alias("config_key"), F.when(F.col("value") > 50, "on").otherwise("off").alias("value"), (F.col("event_id") % 4 != 0).alias("active"), F.col("ts").alias("at"))
    return configs.effective(owners, defaults, masters, overrides)


@query("effective_config", EFFECTIVE + "SELECT * FROM eff")
def _(spark, folder) -> DataFrame:
    return _effective(spark, folder)


@query("config_agree_differ", EFFECTIVE + """, six AS (SELECT * FROM eff WHERE owner <= 6)
SELECT config_key, count(*) AS owners, count(DISTINCT value) AS distinct_values, count(DISTINCT value) = 1 AND count(*) = (SELECT count(DISTINCT owner) FROM six) AS agrees FROM six GROUP BY 1""")
def _(spark, folder) -> DataFrame:
    return configs.agree_differ(_effective(spark, folder).filter("owner <= 6"))


@query("companies_with", EFFECTIVE + "SELECT count(*) AS owners, count_if(value = 'on') AS matching, count_if(value = 'on' AND source = 'override') AS by_override, count_if(value = 'on' AND source = 'master') AS by_master FROM eff WHERE config_key = 'click'")
def _(spark, folder) -> DataFrame:
    return configs.owners_with(_effective(spark, folder), "click", "on")


@query("companies_sample", EFFECTIVE + "SELECT owner, source FROM eff WHERE config_key = 'click' AND value = 'on' ORDER BY owner LIMIT 60")
def _(spark, folder) -> DataFrame:
    return configs.sample_owners(_effective(spark, folder), "click", "on")


@query("resolve_company", """SELECT c_custkey AS owner, c_name AS name, coalesce(n, 0) AS overrides FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = c_custkey WHERE c_acctbal > 0 AND contains(lower(c_name), '00001') ORDER BY overrides DESC, owner LIMIT 12""")
def _(spark, folder) -> DataFrame:
    c = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("active"))
    counts = read_table(spark, folder, "events").groupBy(F.col("user_id").alias("owner")).agg(F.count(F.lit(1)).alias("overrides"))
    return configs.resolve_owner(c, counts, "00001")


@query("company_mentions")
def _(spark, folder) -> DataFrame:
    owners = read_table(spark, folder, "benchmark").select(F.col("item_id").alias("owner"), F.col("text").alias("name"))
    return configs.mentions(owners, read_table(spark, folder, "benchmark"))


# --- live tables ---

@query("query_live", """SELECT event_id, CAST(ts AS VARCHAR) AS ts, event_type FROM events WHERE event_type IN ('click', 'error') AND contains(lower(props), '"k"') ORDER BY ts DESC, event_id LIMIT 50""")
def _(spark, folder) -> DataFrame:
    e = read_table(spark, folder, "events")
    return live.query_live(e, EVENT_COLUMNS, ["event_id", "ts", "event_type"], key="event_id", where={"event_type": ["click", "error"]}, like={"props": '"K"'}).withColumn("ts", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.regexp_replace(F.date_format("ts", ".SSSSSS"), r"\.?0+$", "")))


@query("live_total", """SELECT count(*) AS total FROM events WHERE user_id = 5""")
def _(spark, folder) -> DataFrame:
    return live.live_total(read_table(spark, folder, "events"), EVENT_COLUMNS, where={"user_id": 5})


@query("live_any_column", """SELECT count(*) AS total FROM events WHERE (contains(lower(event_type), 'er') OR contains(lower(props), 'er')) AND value IS NOT NULL""")
def _(spark, folder) -> DataFrame:
    return live.live_total(read_table(spark, folder, "events"), EVENT_COLUMNS, like={"any": {"columns": ["event_type", "props"], "value": "er"}}, not_null=["value"])


@query("json_filter", """SELECT count(*) AS total FROM events WHERE json_extract_string(props, '$.k') = '3'""")
def _(spark, folder) -> DataFrame:
    return live.live_total(read_table(spark, folder, "events"), EVENT_COLUMNS, contains={"props": {"k": 3}})


@query("live_freshness", "SELECT event_type, count(*) AS rows_total, max(epoch_us(ts)) AS last_run FROM events GROUP BY 1")
def _(spark, folder) -> DataFrame:
    return live.freshness(read_table(spark, folder, "events"), "event_type", "ts").withColumn("last_run", F.unix_micros(F.col("last_run").cast("timestamp")))


@query("live_dependent", "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, folder) -> DataFrame:
    return live.dependent(read_table(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'"), read_table(spark, folder, "events"), ("c_custkey", "user_id")).select("event_id", "user_id")


@query("any_cell", "SELECT n_nationkey FROM nation WHERE contains(lower(concat_ws(chr(1), n_nationkey, n_name, n_regionkey)), 'ion_1')")
def _(spark, folder) -> DataFrame:
    return live.any_cell(read_table(spark, folder, "nation"), "ion_1").select("n_nationkey")


# --- mirror ---

@query("sync_latest", "SELECT user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events GROUP BY 1")
def _(spark, folder) -> DataFrame:
    return sync.latest(read_table(spark, folder, "events").select("user_id", "ts", "event_id"), "user_id", "ts").select("user_id", "event_id")


@query("sync_due", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 2 MINUTE")
def _(spark, folder) -> DataFrame:
    return sync.due(read_table(spark, folder, "events"), "ts", "2024-01-20 00:00:00").select("event_id")


@query("sync_deletes", "SELECT event_id FROM events WHERE event_id % 7 = 0")
def _(spark, folder) -> DataFrame:
    e = read_table(spark, folder, "events").select("event_id", "value")
    return sync.reconcile(e, e.filter("event_id % 7 <> 0"), "event_id")[1]


@query("sync_upsert", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN value + 1 ELSE value END AS value FROM events")
def _(spark, folder) -> DataFrame:
    e = read_table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    new = e.filter("event_id % 7 = 0").select("event_id", (F.col("ts") + F.expr("interval 1 second")).alias("ts"), (F.col("value") + 1).alias("value"))
    return sync.apply_changes(e, new, "event_id", "ts").select("event_id", "value")


@query("allowlist", "SELECT event_id, event_type FROM events")
def _(spark, folder) -> DataFrame:
    return sync.allowlisted(read_table(spark, folder, "events"), ["event_id", "event_type", "secret"])


# --- texts ---

LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, len(string_split(text, chr(10))) AS total_lines FROM documents) "


@query("read_lines", LINES + "SELECT doc_id, line, content, total_lines, false AS truncated FROM l WHERE line BETWEEN 2 AND 4")
def _(spark, folder) -> DataFrame:
    return texts.read_lines(read_table(spark, folder, "documents"), 2, 4)


@query("line_counts", LINES + "SELECT doc_id, max(line) AS lines, sum(length(content)) AS chars FROM l GROUP BY 1")
def _(spark, folder) -> DataFrame:
    return texts.lines(read_table(spark, folder, "documents")).groupBy("doc_id").agg(F.max("line").alias("lines"), F.sum(F.length("content")).alias("chars"))


@query("grep_hits", LINES + "SELECT l.doc_id, line, left(trim(content), 200) AS content FROM l JOIN (SELECT doc_id FROM documents WHERE contains(text, 'License') ORDER BY doc_id LIMIT 200) USING (doc_id) WHERE contains(content, 'License') ORDER BY doc_id, line LIMIT 40")
def _(spark, folder) -> DataFrame:
    return texts.grep(read_table(spark, folder, "documents"), "License").select("doc_id", "line", "content")


@query("passages")
def _(spark, folder) -> DataFrame:
    return texts.passages(read_table(spark, folder, "documents"))


@graph_query("cards_hash", """, b AS (SELECT src AS id, array_to_string(list_sort(list(DISTINCT dst))[1:12], ', ') AS beside FROM edges WHERE kind = 'HANDLED_BY' GROUP BY 1)
SELECT id, sha256(concat_ws('. ', lower(kind) || ' ' || name, trim(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[_./#:>-]+', ' ', 'g'))), path, beside)) AS card_hash FROM entities LEFT JOIN b USING (id) WHERE kind = 'SERVER_ROUTE'""")
def _(g: Graph, *_a) -> DataFrame:
    return texts.cards(g.entities.filter("kind = 'SERVER_ROUTE'"), g.edges_of("HANDLED_BY").select(F.col("src").alias("id"), F.col("dst").alias("other"))).select("id", "card_hash")


@query("secret_gate", r"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_+/=-]{32,}'), lambda t: length(regexp_replace(t, '[^0-9]', '', 'g')) >= 3 AND regexp_matches(t, '[A-Za-z]'))) AS secrets FROM documents WHERE secrets > 0""")
def _(spark, folder) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", F.size(X.secret_tokens("text")).alias("secrets")).filter("secrets > 0")


@query("mask_pii", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '\+?[0-9][0-9 ()-]{7,}[0-9]', '[phone]', 'g')) AS masked FROM documents""")
def _(spark, folder) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", F.md5(X.mask_personal("text").cast("binary")).alias("masked"))


@query("html_to_text")
def _(spark, folder) -> DataFrame:
    return read_table(spark, folder, "pages").select("page_id", X.html_text("html").alias("text"))


# --- questions ---

@query("needs_context")
def _(spark, folder) -> DataFrame:
    return read_table(spark, folder, "conversations").filter("role = 'user'").select("conv_id", "turn", assistant.needs_context("text").alias("needs_context"), assistant.wants_flow("text").alias("flow"))


@query("ticket_fields")
def _(spark, folder) -> DataFrame:
    return read_table(spark, folder, "conversations").filter("role = 'user'").select("conv_id", "turn", assistant.looks_like_ticket("text").alias("ticket"), assistant.parse_ticket("text").alias("fields"))


@graph_query("role_filter", """ SELECT id, kind, NULL::VARCHAR AS path FROM entities WHERE kind = 'UI_ROUTE'""")
def _(g: Graph, *_a) -> DataFrame:
    return assistant.visible(g.entities, "cs").select("id", "kind", "path")


@query("cache_key", r"""SELECT item_id, sha1('1|' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || '|simple|cs|1996,1997') AS key FROM benchmark""")
def _(spark, folder) -> DataFrame:
    b = read_table(spark, folder, "benchmark").withColumn("style", F.lit("simple")).withColumn("policy", F.lit("cs")).withColumn("commits", F.array(F.lit("1997"), F.lit("1996")))
    return b.select("item_id", assistant.cache_key("text", "style", "policy", "commits").alias("key"))


@query("fresh_answers", "SELECT event_id FROM events WHERE event_type <> 'view' OR ts >= TIMESTAMP '2024-01-29 11:00:00'")
def _(spark, folder) -> DataFrame:
    e = read_table(spark, folder, "events").select("event_id", F.col("ts").alias("stored_at"), (F.col("event_type") == "view").alias("has_live"))
    return assistant.fresh_answers(e, "2024-01-29 12:00:00").select("event_id")


@query("chat_history", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def _(spark, folder) -> DataFrame:
    return assistant.history(read_table(spark, folder, "conversations")).select("conv_id", "turn", "role")


@query("append_turns", """WITH l AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY 1)
SELECT conv_id, c.turn AS at, coalesce(last, 0) + row_number() OVER (PARTITION BY conv_id ORDER BY c.turn, text) AS seq FROM conversations c LEFT JOIN l USING (conv_id) WHERE c.role = 'user'""")
def _(spark, folder) -> DataFrame:
    c = read_table(spark, folder, "conversations")
    new = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("at"), "text")
    return assistant.append_turns(c.withColumnRenamed("turn", "seq"), new).select("conv_id", "at", F.col("seq").cast("long").alias("seq"))


@query("retention", "SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-20 00:00:00' THEN props END AS props FROM events")
def _(spark, folder) -> DataFrame:
    return assistant.retain(read_table(spark, folder, "events"), "2024-01-30 00:00:00", 10, "ts", "props").select("event_id", "props")


@query("feature_votes", """WITH v AS (SELECT user_id AS item, props AS feature, CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 0.7 WHEN 'purchase' THEN 0.9 WHEN 'signup' THEN 1.2 ELSE 1.0 END * value AS w FROM events),
p AS (SELECT item, feature, round(sum(w), 6) AS weight FROM v GROUP BY 1, 2)
SELECT item, feature, weight, round(weight / sum(weight) OVER (PARTITION BY item), 6) AS share, row_number() OVER (PARTITION BY item ORDER BY weight DESC, feature) AS rank FROM p""")
def _(spark, folder) -> DataFrame:
    source = F.when(F.col("event_type") == "view", "code").when(F.col("event_type") == "click", "meaning").when(F.col("event_type") == "purchase", "word").when(F.col("event_type") == "signup", "screen").otherwise("error")
    return assistant.feature_votes(read_table(spark, folder, "events").select(F.col("user_id").alias("item"), F.col("props").alias("feature"), source.alias("source"), F.col("value").alias("score")))


FACTS = "n_nationkey % 2 AS guides, n_nationkey % 3 AS screens, n_regionkey % 2 AS set_switches, CAST(n_nationkey % 5 = 0 AS INT) AS error_hits, 0 AS defects, n_nationkey % 4 AS code_anchors"


@query("allowed_verdicts", f"""WITH f AS (SELECT n_nationkey, {FACTS} FROM nation)
SELECT n_nationkey, concat_ws(',', 'more_info', CASE WHEN guides > 0 OR screens > 0 THEN 'knowledge' END, CASE WHEN set_switches > 0 THEN 'config' END, CASE WHEN error_hits > 0 OR defects > 0 OR (code_anchors > 0 AND (guides > 0 OR NOT (guides > 0 OR screens > 0))) THEN 'engineering' END) AS verdicts FROM f""")
def _(spark, folder) -> DataFrame:
    return read_table(spark, folder, "nation").selectExpr("n_nationkey", *[x.strip() for x in FACTS.split(", ")]).select("n_nationkey", F.array_join(assistant.allowed_verdicts(), ",").alias("verdicts"))


@query("hit_at_k", """WITH r AS (SELECT p.page_id, min(CASE WHEN l.quality = 1 THEN p.page_id % 13 + 1 END) AS rank FROM pages p LEFT JOIN labels l ON l.doc_id = p.page_id GROUP BY 1)
SELECT count(*) AS questions, count_if(rank <= 1) AS hit_at_1, count_if(rank <= 5) AS hit_at_5, count_if(rank <= 10) AS hit_at_10 FROM r""")
def _(spark, folder) -> DataFrame:
    p, l = read_table(spark, folder, "pages"), read_table(spark, folder, "labels")
    ranks = p.join(l, F.col("doc_id") == F.col("page_id"), "left").groupBy("page_id").agg(F.min(F.when(F.col("quality") == 1, F.col("page_id") % 13 + 1)).alias("rank"))
    return assistant.hits_at(ranks)


@query("run_summary", "SELECT event_type AS kind, count(*) AS n, count_if(value > 20) AS passes, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1")
def _(spark, folder) -> DataFrame:
    return assistant.run_summary(read_table(spark, folder, "events").select(F.col("event_type").alias("kind"), (F.col("value") > 20).alias("passed"), F.col("value").alias("seconds")), "kind")


@graph_query("cross_snapshot_parity", """, a AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'SERVES' AND "commit" = 1997), b AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'SERVES' AND "commit" = 1998)
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both_sides, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_old, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_new""")
def _(g: Graph, spark, folder) -> DataFrame:
    a, b = (g.edges.filter(f"kind = 'SERVES' and commit = {y}").select("src", "dst").distinct() for y in (1997, 1998))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(a.intersect(b), "both_sides").crossJoin(one(a.exceptAll(b), "only_old")).crossJoin(one(b.exceptAll(a), "only_new"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Everything reachable downstream of the first customer of 1997."""
    return QUERIES["trace_forward"](spark, folder)
