"""Queries with their SQL for mentions, concepts, route dumps, chosen configurations, whole sets, intents and guided lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import anchor, assistant, concepts, configs, live, relations, texts
from ..session import read_table
from ..sources import settings
from . import catalog
from .answers import _root, _side, _year
from .catalog import EFFECTIVE, SQL, graph_query, query
from .graph import Graph

__all__ = ["SQL"]

#: names by the patterns of texts.mentions: of what follows a namespace's mark nothing is a name, so such matches are taken with it and left out
MENTIONED = r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z]{3,12}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN text || chr(10) || a || b || ' is no ' || a || '::' || b || ', see ' || a || '::' || b || '#' || w[3] || ' and (' || a || b || '.' || w[4] || '!) or ' || w[3] || '_' || w[4] || '_2, ' || w[3] || '.' ELSE text END AS text
  FROM (SELECT *, upper(w[1][1]) || w[1][2:] AS a, upper(w[2][1]) || w[2][2:] AS b FROM w)),
f AS (SELECT doc_id, list_filter(regexp_extract_all(text, ':?\b(?:[A-Z]\w*(?:::[A-Z]\w*)+|(?:[A-Z][a-z0-9]+){2,})\b(?:[#.][a-z_]\w*[?!]?)?'), lambda x: x[1] <> ':') AS names, regexp_extract_all(text, '\b[a-z]+(?:_[a-z0-9]+)+\b') AS snakes FROM s),
m AS (SELECT doc_id, unnest(list_concat(list_transform(names, lambda x: 'const:' || regexp_extract(x, '^[^#.]+')), list_transform(list_filter(names, lambda x: regexp_matches(x, '[#.]')), lambda x: 'method:' || x), list_transform(snakes, lambda x: 'snake:' || x))) AS name FROM f)
SELECT doc_id, name, count(*) AS n FROM m GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, name) <= 80"""


@query("mentions_top", MENTIONED)
def _(spark, folder) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,12})")).alias("w"))

    def said(w):
        a, b, c, d = F.initcap(F.get(w, F.lit(0))), F.initcap(F.get(w, F.lit(1))), F.get(w, F.lit(2)), F.get(w, F.lit(3))
        named = F.format_string("%s%s is no %s::%s, see %s::%s#%s and (%s%s.%s!) or %s_%s_2, %s.", a, b, a, b, a, b, c, a, b, d, c, d, c)
        return F.when(F.size(w) >= 4, F.concat_ws("\n", "text", named)).otherwise(F.col("text"))

    # whole texts, each followed by a sentence that names things by its first words; the words are found once
    return texts.mentions(docs.select("doc_id", F.element_at(F.transform(F.array("w"), said), 1).alias("text")))


# --- concepts ---

CODE = "code AS (SELECT 'n' || c_custkey AS id, 'app/' || lower(c_mktsegment) || '/s' || c_nationkey || '/f' || c_custkey % 50 || '.rb' AS path, CASE WHEN c_custkey % 7 = 0 THEN 'DB_TABLE' WHEN c_custkey % 2 = 0 THEN 'SYMBOL' ELSE 'FILE' END AS kind FROM customer)"


def _code(spark, folder) -> DataFrame:
    c = read_table(spark, folder, "customer")
    path = F.format_string("app/%s/s%d/f%d.rb", F.lower("c_mktsegment"), F.col("c_nationkey"), F.col("c_custkey") % 50)
    kind = F.when(F.col("c_custkey") % 7 == 0, "DB_TABLE").when(F.col("c_custkey") % 2 == 0, "SYMBOL").otherwise("FILE")
    return c.select(F.concat(F.lit("n"), "c_custkey").alias("id"), path.alias("path"), kind.alias("kind"))


FEATURES = """f AS (SELECT n_nationkey AS feature, CASE WHEN n_nationkey % 5 = 0 THEN ['app/building'] ELSE ['app/machinery/s' || n_nationkey, 'app/household/s' || n_nationkey] END AS dirs FROM nation),
impl AS (SELECT DISTINCT feature AS src, id AS dst, path FROM (SELECT feature, unnest(dirs) AS dir FROM f) JOIN code ON starts_with(path, dir || '/') AND kind <> 'DB_TABLE')"""


def _features(spark, folder) -> DataFrame:
    n = read_table(spark, folder, "nation")
    own = lambda top: F.concat(F.lit(f"app/{top}/s"), "n_nationkey")
    dirs = F.when(F.col("n_nationkey") % 5 == 0, F.array(F.lit("app/building"))).otherwise(F.array(own("machinery"), own("household")))
    return n.select(F.col("n_nationkey").alias("feature"), dirs.alias("dirs"), F.array(F.lit("Nobody")).alias("models"))


@query("feature_implements", f"WITH {CODE}, {FEATURES} SELECT CAST(src AS VARCHAR) AS src, dst FROM impl")
def _(spark, folder) -> DataFrame:
    return concepts.implements(_features(spark, folder), _code(spark, folder)).select(F.col("src").cast("string").alias("src"), "dst")


TOUCHES = "t AS (SELECT 'p' || o_orderstatus || o_orderkey % 20 AS person, 'app/' || lower(c_mktsegment) || '/s' || c_nationkey || '/f' || c_custkey % 50 || '.rb' AS path, o_orderdate FROM orders JOIN customer ON c_custkey = o_custkey)"


def _touches(spark, folder) -> DataFrame:
    o, c = read_table(spark, folder, "orders"), read_table(spark, folder, "customer")
    rows = o.join(c, F.col("c_custkey") == F.col("o_custkey"))
    return rows.select(F.concat(F.lit("p"), "o_orderstatus", F.col("o_orderkey") % 20).alias("person"), F.format_string("app/%s/s%d/f%d.rb", F.lower("c_mktsegment"), F.col("c_nationkey"), F.col("c_custkey") % 50).alias("path"), "o_orderdate")


@query("person_owns", f"""WITH {CODE}, {TOUCHES}, p AS (SELECT person, path, count(*) AS commits FROM t GROUP BY person, path QUALIFY row_number() OVER (PARTITION BY person ORDER BY commits DESC, path) <= 60)
SELECT 'person:' || person AS src, id AS dst, commits, round(least(0.95, 0.5 + commits / 20), 6) AS confidence FROM p JOIN code USING (path) WHERE kind <> 'DB_TABLE'""")
def _(spark, folder) -> DataFrame:
    return concepts.owns(_touches(spark, folder), _code(spark, folder)).withColumn("confidence", F.round("confidence", 6))


@query("feature_activity", f"""WITH {CODE}, {FEATURES}, {TOUCHES}, a AS (SELECT path, count(*) AS commits, max(o_orderdate)::DATE AS last_commit FROM t WHERE year(o_orderdate) = 1997 GROUP BY 1)
SELECT CAST(src AS VARCHAR) AS feature, coalesce(sum(commits), 0)::BIGINT AS touches, CAST(max(last_commit) AS VARCHAR) AS last_commit, count(DISTINCT dst) AS nodes, count(DISTINCT CASE WHEN commits IS NOT NULL THEN dst END) AS active_nodes FROM impl LEFT JOIN a USING (path) GROUP BY src""")
def _(spark, folder) -> DataFrame:
    code = _code(spark, folder)
    recent = _touches(spark, folder).filter("year(o_orderdate) = 1997").groupBy("path").agg(F.count(F.lit(1)).alias("commits"), F.max(F.to_date("o_orderdate")).alias("last_commit"))
    rows = concepts.feature_activity(concepts.implements(_features(spark, folder), code), code, recent)
    return rows.select(F.col("feature").cast("string").alias("feature"), F.col("touches").cast("long").alias("touches"), F.col("last_commit").cast("string").alias("last_commit"), "nodes", "active_nodes")


@query("route_edges", """WITH r AS (SELECT CASE p_size % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS verb, CASE WHEN p_size % 3 = 0 THEN '/api' ELSE '' END || '/' || lower(p_type) || '/:id/' || p_size AS path, CASE WHEN p_size % 11 <> 0 THEN lower(p_type) END AS controller, 'a' || p_size AS action, p_brand AS con FROM part),
k AS (SELECT *, verb || ' ' || path AS route, verb || ' ' || replace(regexp_replace(path, '^/api/', '/'), ':id', '*') AS endpoint FROM r WHERE controller IS NOT NULL)
SELECT 'SERVES' AS kind, 'be:' || route AS src, endpoint AS dst, 1.0e0 AS confidence, array_to_string(list_sort(list(DISTINCT con)), ',') AS constraints FROM k GROUP BY route, endpoint UNION ALL SELECT DISTINCT 'HANDLED_BY', 'be:' || route, 'be:' || controller || '#' || action, 0.95e0, '' FROM k""")
def _(spark, folder) -> DataFrame:
    p = read_table(spark, folder, "part")
    path = F.concat(F.when(F.col("p_size") % 3 == 0, "/api").otherwise(""), F.lit("/"), F.lower("p_type"), F.lit("/:id/"), "p_size")
    routes = p.select(F.when(F.col("p_size") % 2 == 0, "GET").otherwise("POST").alias("verb"), path.alias("path"), F.when(F.col("p_size") % 11 != 0, F.lower("p_type")).alias("controller"), F.concat(F.lit("a"), "p_size").alias("action"), F.col("p_brand").alias("constraint"))
    return concepts.route_graph(routes, X.endpoint_path)[1].withColumn("constraints", F.array_join("constraints", ","))


@query("possible_callers", """WITH s AS (SELECT 'app/' || o_custkey % 40 || '.js' AS path, o_orderkey AS line, CASE WHEN o_orderkey % 9 = 0 THEN 'base + "/Awards/" + id' ELSE 'url' END AS raw FROM orders WHERE o_orderkey % 4 <> 0),
a AS (SELECT path, line, raw, 'names_path' AS why FROM s WHERE raw <> 'url' ORDER BY path, line LIMIT 30), b AS (SELECT path, line, raw, 'same_file' AS why FROM s WHERE path IN ('app/1.js', 'app/7.js') ORDER BY path, line LIMIT 30)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.path = b.path AND a.line = b.line)""")
def _(spark, folder) -> DataFrame:
    o = read_table(spark, folder, "orders")
    sites = o.select(F.concat(F.lit("app/"), F.col("o_custkey") % 40, F.lit(".js")).alias("path"), F.col("o_orderkey").alias("line"), F.when(F.col("o_orderkey") % 9 == 0, 'base + "/Awards/" + id').otherwise("url").alias("raw"), F.when(F.col("o_orderkey") % 4 == 0, "EXACT").otherwise("AMBIGUOUS").alias("resolution"))
    return relations.possible_callers(sites, spark.createDataFrame([("app/1.js",), ("app/7.js",)], "path string"), "/sales/awards/")


# --- configurations, sets, intents ---


@query("configs_chosen", EFFECTIVE + "SELECT owner, config_key, value, source FROM eff WHERE (contains(config_key, 'c') OR contains('about ' || upper(config_key), 'C')) AND value = 'on'")
def _(spark, folder) -> DataFrame:
    values = catalog._effective(spark, folder)
    about = read_table(spark, folder, "events").select(F.col("event_type").alias("config_key")).distinct().select("config_key", F.upper("config_key").alias("name"), F.lit(None).cast("string").alias("description"))
    return configs.chosen(values, about, keys_like="C", only="on").select("owner", "config_key", "value", "source")


@query("whole_set", "SELECT event_id FROM events WHERE user_id = 7")
def _(spark, folder) -> DataFrame:
    e = read_table(spark, folder, "events")
    return live.completed("List every event of this user", e, ["event_id", "user_id", "ts"], limit=5, where={"user_id": 7}, key="event_id").select("event_id")


@query("intents", r"""WITH q AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id, turn, regexp_matches(t, '(?i)\b(how does|how do|what is|what are|what can|explain|overview|walk me through|in simple|for a (pm|cs|non|beginner)|as a user|business|feature|workflow|process|end to end|high level|non-technical)\b') AS plain,
  regexp_matches(t, '[/#.:]|[a-z][A-Z]|_[A-Za-z0-9_]') AS named, regexp_matches(t, '(?i)\b(trace|call|calls|caller|callers|called|method|function|endpoint|route|controller|handler|table|column|schema|query|sql|migration|defect|bug|stack|guard|param|serializer|worker|job|class|module|which file|file:line|line number|implementation|code)\b') AS code FROM q)
SELECT conv_id, turn, CASE WHEN plain AND NOT named THEN 'simple' WHEN code OR (named AND NOT plain) THEN 'code' ELSE 'simple' END AS intent FROM s""")
def _(spark, folder) -> DataFrame:
    return read_table(spark, folder, "conversations").filter("role = 'user'").select("conv_id", "turn", assistant.intent("text").alias("intent"))


# --- screens of one name, guided lookups ---


@query("one_of_each_name", """WITH r AS (SELECT p_partkey AS screen, p_name AS name, '/' || p_brand || CASE WHEN p_partkey % 3 = 0 THEN '/:id' ELSE '' END AS route, p_size AS item_id FROM part)
SELECT item_id, screen, name, screen % 10 AS position FROM r QUALIFY row_number() OVER (PARTITION BY item_id, name ORDER BY contains(route, ':'), length(route), screen) = 1""")
def _(spark, folder) -> DataFrame:
    p = read_table(spark, folder, "part")
    screens = p.select(F.col("p_partkey").alias("screen"), F.col("p_name").alias("name"), F.concat(F.lit("/"), "p_brand", F.when(F.col("p_partkey") % 3 == 0, "/:id").otherwise("")).alias("route"))
    found = p.select(F.col("p_size").alias("item_id"), F.col("p_partkey").alias("screen"), (F.col("p_partkey") % 10).alias("position"))
    return relations.one_of_each_name(found, screens)


@graph_query("guided_run", _side("downstream", False, 6, 60) + _side("upstream", True, 3, 30) + """, c AS (SELECT DISTINCT id FROM (SELECT id FROM n_downstream UNION ALL SELECT id FROM n_upstream) JOIN entities USING (id)), rt AS (SELECT (SELECT any_value(path) FROM entities WHERE id = (SELECT 'customer:' || min(o_custkey) FROM orders WHERE year(o_orderdate) = 1997)) AS p),
g AS (SELECT id FROM c ORDER BY id LIMIT 35), z AS (SELECT src AS id, min(line) AS line FROM edges WHERE resolution = 'AMBIGUOUS' GROUP BY 1)
SELECT 'claims' AS part, id FROM c UNION ALL SELECT 'evidence', id FROM g JOIN entities USING (id) UNION ALL SELECT * FROM (SELECT 'siblings', entities.id FROM entities JOIN z USING (id), rt WHERE path = p ORDER BY line, id LIMIT 12)""", recursive=True)
def _(g: Graph, spark, folder) -> DataFrame:
    frames = anchor.guided(g.entities, g.edges, g.refs, _year(g, 1997), _root(spark, folder))
    out = None
    for part, df in frames.items():
        rows = df.select(F.lit(part).alias("part"), "id").distinct()
        out = rows if out is None else out.union(rows)
    return out


# --- settings, events, reports ---


@query("tenant_companies", """WITH t(word, pattern) AS (VALUES ('acme', 'customer#00000000%'), ('big one', 'customer#0000001%'), ('big one', '%77')),
n AS (SELECT n_nationkey AS item_id, CASE n_nationkey % 4 WHEN 0 THEN 'ACME' WHEN 1 THEN '00012' || n_nationkey % 10 WHEN 2 THEN 'the big one here' ELSE 'no' END AS name FROM nation),
o AS (SELECT c_custkey AS owner, lower(c_name) AS company, coalesce(k, 0) AS overrides FROM customer LEFT JOIN (SELECT user_id, count(*) AS k FROM events GROUP BY 1) ON user_id = c_custkey WHERE c_acctbal > 0),
h AS (SELECT DISTINCT item_id, owner, overrides FROM n JOIN o ON (n.name = 'ACME' AND company LIKE 'customer#00000000%') OR (starts_with(n.name, '00012') AND contains(company, n.name)) OR (n.name = 'the big one here' AND (company LIKE 'customer#0000001%' OR company LIKE '%77')))
SELECT item_id, owner, overrides FROM h QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY overrides DESC, owner) <= 12""")
def _(spark, folder) -> DataFrame:
    words = spark.createDataFrame([("acme", "Customer#00000000%"), ("big one", "customer#0000001%"), ("big one", "%77")], "word string, pattern string")
    k = F.col("n_nationkey")
    names = read_table(spark, folder, "nation").select(k.alias("item_id"), F.when(k % 4 == 0, "ACME").when(k % 4 == 1, F.concat(F.lit("00012"), k % 10)).when(k % 4 == 2, "the big one here").otherwise("no").alias("name"))
    counts = read_table(spark, folder, "events").groupBy(F.col("user_id").alias("owner")).agg(F.count(F.lit(1)).alias("k"))
    owners = read_table(spark, folder, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("active")).join(counts, "owner", "left").select("owner", "name", "active", F.coalesce("k", F.lit(0)).alias("overrides"))
    return settings.companies(owners, words, names)


@query("event_frames", """SELECT user_id AS run, event_id AS seq, 'event: ' || event_type || chr(10) || 'data: {"type":"' || event_type || '","text":"see a file now"}' || chr(10) || chr(10) AS frame FROM events WHERE event_type <> 'view'""")
def _(spark, folder) -> DataFrame:
    e = read_table(spark, folder, "events")
    events = e.select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "context_paths").otherwise(F.col("event_type")).alias("type"), F.lit(None).cast("string").alias("kind"), F.lit("app/x.rb").alias("path"), F.lit("see app/models/bid.rb now").alias("text"))
    return settings.sent(events, "product")


@query("report_lines", """WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS grp, o_orderstatus <> 'F' AS passed, o_totalprice / 1000 AS seconds FROM orders)
SELECT '0' AS at, '# Run: ' || count(*) FILTER (passed) || ' of ' || count(*) || ' passed, median ' || CAST(round(median(seconds), 1) AS VARCHAR) || ' s' AS line FROM r UNION ALL SELECT '1 ' || grp, '| ' || grp || ' | ' || count(*) FILTER (passed) || ' | ' || count(*) || ' |' FROM r GROUP BY grp
UNION ALL SELECT '2 ' || lpad(id::VARCHAR, 12, '0'), '- ' || id || ': links, ' || grp FROM r WHERE NOT passed""")
def _(spark, folder) -> DataFrame:
    o = read_table(spark, folder, "orders")
    results = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("grp"), (F.col("o_orderstatus") != "F").alias("passed"), (F.col("o_totalprice") / 1000).alias("seconds"), F.array(F.lit("links"), "o_orderpriority").alias("failed"))
    return settings.report_lines(results, "Run")


@query("backfilled_texts", """SELECT DISTINCT sha1(text) AS blob, length(text) AS size FROM documents WHERE text IS NOT NULL AND sha1(text) NOT IN (SELECT sha1(text) FROM documents WHERE text IS NOT NULL AND source = 'src1')""")
def _(spark, folder) -> DataFrame:
    docs = read_table(spark, folder, "documents").filter("text is not null").select("source", "text", F.sha1("text").alias("blob"))
    every = docs.groupBy("blob").agg(F.first("text").alias("text"))
    found = settings.backfill(docs.select("blob"), docs.filter("source = 'src1'").select("blob"), lambda tree: every.join(tree, "blob", "left_semi"))
    return found.select("blob", F.length("text").cast("long").alias("size"))
