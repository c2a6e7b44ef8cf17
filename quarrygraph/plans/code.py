"""Queries with their SQL for facts of code, template layouts, journeys, imports and what roles may see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import journeys, layouts, redaction
from ..session import cut, read_table, spread
from ..sources import code, contract, knowledge
from .answers import NAV_LINKS, nav_links
from .catalog import SQL, query

__all__ = ["SQL"]

WORDS = "SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{3,12}') AS w FROM documents"


def _put_together(spark, folder, *parts: str) -> DataFrame:
    """(blob, text): code put together from the first six words of each document; {0} is a word, {T0} its name as a class."""
    docs = read_table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("blob"), F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,12})")).alias("w"))
    docs = cut(docs.select("blob", F.slice("w", 1, 6).alias("w"))).filter("size(w) >= 6")
    text = F.lit("\n".join(parts))
    for i in range(6):
        text = F.replace(F.replace(text, F.lit(f"{{T{i}}}"), F.initcap(F.get("w", F.lit(i)))), F.lit(f"{{{i}}}"), F.get("w", F.lit(i)))
    return cut(docs.select("blob", text.alias("text")))  # made once, whatever reads it


NAMES = ", ".join(f"upper(w[{i + 1}][1]) || w[{i + 1}][2:] AS t{i}, w[{i + 1}] AS w{i}" for i in range(6))


@query("declarations", f"""WITH n AS (SELECT CAST(doc_id AS VARCHAR) AS blob, {NAMES} FROM ({WORDS}) WHERE len(w) >= 6),
f AS (SELECT blob, unnest([{{'line': 1, 'kind': 'module', 'name': t0, 'owner': NULL, 'superclass': NULL}}, {{'line': 3, 'kind': 'class', 'name': t0 || '::' || t1, 'owner': NULL, 'superclass': t2}},
  {{'line': 4, 'kind': 'method', 'name': t0 || '::' || t1 || '#' || w3, 'owner': t0 || '::' || t1, 'superclass': NULL}}, {{'line': 6, 'kind': 'class_method', 'name': t0 || '::' || t1 || '.' || w4, 'owner': t0 || '::' || t1, 'superclass': NULL}},
  {{'line': 10, 'kind': 'class', 'name': t0 || '::' || t2, 'owner': NULL, 'superclass': t1}}, {{'line': 11, 'kind': 'class_method', 'name': t0 || '.' || w5, 'owner': t0, 'superclass': NULL}}]) AS x FROM n)
SELECT blob, x.line::INT AS line, x.kind AS kind, x.name AS name, x.owner AS owner, x.superclass AS superclass FROM f""")
def _(spark, folder) -> DataFrame:
    # a class within a module, one of a single line, and a method of the module; what stands outside has no owner
    texts = _put_together(spark, folder, "module {T0}", "  # class Commented", "  class {T1} < {T2}", "    def {3}; end", "    class << self", "      def {4}(x)", "      end", "    end", "  end", "  class {T2} < {T1}; end", "  private def self.{5}", "  end", "end", "def {0}; end")
    return code.declarations(texts)


@query("call_site_shapes", f"""WITH n AS (SELECT CAST(doc_id AS VARCHAR) AS blob, {NAMES} FROM ({WORDS}) WHERE len(w) >= 6),
f AS (SELECT blob, unnest([{{'line': 1, 'col': 0, 'method': 'POST', 'shape': 'TEMPLATE', 'path_template': '/' || w0 || '/*/' || w2}}, {{'line': 2, 'col': 8, 'method': 'GET', 'shape': 'IDENTIFIER', 'path_template': NULL}},
  {{'line': 2, 'col': 33 + length(w3), 'method': NULL, 'shape': 'LITERAL', 'path_template': '/' || w4}}, {{'line': 3, 'col': 0, 'method': 'PUT', 'shape': 'OTHER', 'path_template': NULL}}]) AS x FROM n)
SELECT blob, x.line::INT AS line, x.col::INT AS col, x.method AS method, x.shape AS shape, x.path_template AS path_template, CASE WHEN x.path_template IS NULL THEN 0.4e0 ELSE 0.95e0 END AS confidence, CASE WHEN x.path_template IS NULL THEN 'AMBIGUOUS' ELSE 'EXACT' END AS resolution FROM f""")
def _(spark, folder) -> DataFrame:
    texts = _put_together(spark, folder, "promisifiedXHR(`/{0}/${{1}(\"a)\")}/{2}`, 'POST')", "let r = promisifiedXHR({3}, \"get\"); promisifiedXHR('/{4}')", "promisifiedXHR({0} ? [{1}, 2] : {a: {2}(1)}, 'PUT')", "promisifiedXHR('/{5}'")
    return code.call_sites(texts).drop("raw")


def _licences(path: str, text: str, facts: list) -> list[tuple]:
    return [("line", None, i + 1, line.strip()[:80]) for i, line in enumerate(text.split("\n")) if "License" in line]


def _counted(path: str, text: str, facts: list) -> list[tuple]:
    return [("count", name, None, str(sum(f[0] == name for f in facts))) for name in ("licences",)]


@query("extracted_facts", """WITH b AS (SELECT sha1(text) AS blob, any_value(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL GROUP BY 1),
f AS (SELECT blob, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM b), x AS (SELECT blob, n FROM f WHERE contains(line, 'License'))
SELECT blob, 'licences' AS extractor, 'line' AS kind, n::INT AS line, NULL AS value FROM x UNION ALL SELECT b.blob, 'counted', 'count', NULL, CAST(count(n) AS VARCHAR) FROM b LEFT JOIN x ON x.blob = b.blob GROUP BY b.blob""")
def _(spark, folder) -> DataFrame:
    docs = read_table(spark, folder, "documents").filter("text is not null")
    tree = docs.select(F.concat(F.col("doc_id"), F.lit(".txt")).alias("path"), F.sha1("text").alias("blob"))
    texts = docs.groupBy(F.sha1("text").alias("blob")).agg(F.first("text").alias("text"))
    held = spark.createDataFrame([], contract.FACTS)
    found = contract.extract(tree, texts, held, [contract.Extractor("counted", "1", _counted, needs=("licences",)), contract.Extractor("licences", "2", _licences, path=r"\.txt$")])
    return found.filter(F.col("kind") != contract.STATUS).select("blob", "extractor", "kind", "line", F.when(F.col("kind") == "count", F.col("value")).alias("value"))


# --- layouts ---


@query("template_widgets", """WITH m AS (SELECT l_partkey AS id, l_suppkey AS s FROM lineitem GROUP BY ALL),
w AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'sheet' WHEN 1 THEN 'form' WHEN 2 THEN 'fields' END AS layout, unnest(CASE p_partkey % 4
  WHEN 0 THEN [{'grp': 0, 'nth': 0, 'name': p_type, 'side': 'participant', 'required': true}, {'grp': 0, 'nth': 1, 'name': p_name, 'side': 'creator', 'required': false}, {'grp': 1, 'nth': 0, 'name': p_brand, 'side': 'formula', 'required': false}]
  WHEN 1 THEN [{'grp': 0, 'nth': 0, 'name': p_brand, 'side': 'participant', 'required': false}, {'grp': 1, 'nth': 0, 'name': p_name, 'side': 'creator', 'required': true}]
  WHEN 2 THEN [{'grp': 0, 'nth': 0, 'name': 'unit price', 'side': 'creator', 'required': false}, {'grp': 0, 'nth': 1, 'name': p_name, 'side': 'creator', 'required': false}] END) AS x FROM part WHERE p_partkey % 4 < 3)
SELECT id, 'widgets_json' AS source, layout, x.grp::INT AS grp, x.nth::INT AS nth, x.name AS name, x.side AS side, x.required AS required FROM w
UNION ALL SELECT id, 'widget_mappings', 'sheet', 0, (row_number() OVER (PARTITION BY id ORDER BY s % 3, s) - 1)::INT, 'Supplier ' || s, 'creator', s % 2 = 0 FROM m WHERE id % 4 = 3""")
def _(spark, folder) -> DataFrame:
    p = read_table(spark, folder, "part")
    sheet = '{"extra": [{"name": "%s", "config": {"field_type": "formula"}}], "inline_components": [{"label": "%s", "configuration": {"priority": 2}}, {"name": "%s", "configuration": {"priority": 1, "is_required": true, "field_type": "participant"}}, 7], "none": []}'
    form = '[{"page_headers": [{"name": "%s", "configuration": {"is_required": true}}], "order": 2}, {"name": "First", "page_response_headers": [{"name": "%s"}], "order": 1}, null]'
    fields = '{"n": {"name": "%s", "configuration": {"priority": 3}}, "unit_price": {"input_type": "x", "configuration": {"priority": 0}}, "title": "t"}'
    doc = F.when(F.col("p_partkey") % 4 == 0, F.format_string(sheet, "p_brand", "p_name", "p_type")).when(F.col("p_partkey") % 4 == 1, F.format_string(form, "p_name", "p_brand")).when(F.col("p_partkey") % 4 == 2, F.format_string(fields, "p_name"))
    lines = read_table(spark, folder, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("s")).distinct()
    config = F.format_string('{"priority": %d, "is_required": %s}', F.col("s") % 3, F.when(F.col("s") % 2 == 0, "true").otherwise("false"))
    none = F.lit(None).cast("string")
    mapped = lines.select("id", F.col("s").alias("position"), F.concat(F.lit("Supplier "), "s").alias("name"), none.alias("key_attribute"), none.alias("input_type"), F.lit(False).alias("custom"), config.alias("config"))
    found = layouts.with_mappings(layouts.layouts(p.select(F.col("p_partkey").alias("id"), doc.alias("widgets"))), mapped)
    return layouts.widget_rows(found).select("id", "source", "layout", "grp", "nth", "name", "side", "required")


# --- journeys ---


@query("journey_routes", NAV_LINKS + """, best AS (SELECT * FROM r WHERE hops > 0 QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY hops, path) = 1),
q AS (SELECT n_nationkey AS item_id, lpad(n_nationkey::VARCHAR, 2, '0') AS a, lpad(((n_nationkey + 10) % 25)::VARCHAR, 2, '0') AS m1, lpad(((n_nationkey + 16) % 25)::VARCHAR, 2, '0') AS m2, lpad(((n_nationkey + 21) % 25)::VARCHAR, 2, '0') AS z FROM nation),
s1 AS (SELECT q.*, CASE WHEN b.path IS NULL THEN [a] ELSE b.path END AS route, CASE WHEN b.path IS NULL THEN a ELSE m1 END AS pos FROM q LEFT JOIN best b ON b.start = a AND b.node = m1 AND b.hops <= 3 AND EXISTS (SELECT 1 FROM best e WHERE e.start = m1 AND e.node = z)),
s2 AS (SELECT s1.* EXCLUDE (route, pos), CASE WHEN b.path IS NULL THEN route ELSE list_concat(route, b.path[2:]) END AS route, CASE WHEN b.path IS NULL THEN pos ELSE m2 END AS pos FROM s1 LEFT JOIN best b ON b.start = pos AND b.node = m2 AND b.hops <= 3 AND NOT list_contains(route, m2) AND EXISTS (SELECT 1 FROM best e WHERE e.start = m2 AND e.node = z)),
t AS (SELECT item_id, a, m1, m2, z, list_concat(route, b.path[2:]) AS path FROM s2 JOIN best b ON b.start = pos AND b.node = z)
SELECT item_id, array_to_string(path, '>') AS path, len(list_filter(path, lambda x: x IN (a, m1, m2, z))) AS covered FROM t""")
def _(spark, folder) -> DataFrame:
    n = read_table(spark, folder, "nation")
    name = lambda shift: F.lpad(((F.col("n_nationkey") + shift) % 25).cast("string"), 2, "0")
    asked = n.select(F.col("n_nationkey").alias("item_id"), F.posexplode(F.array(*[name(s) for s in (0, 10, 16, 21)])).alias("position", "node"))
    return journeys.routes(nav_links(spark, folder), asked).withColumn("path", F.array_join("path", ">"))


# --- imports ---


@query("imported_edges", """WITH e AS (SELECT p_partkey, 'C' || p_size AS c, 'be:sym:C' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '#' ELSE '.' END || 'm' || p_partkey AS id FROM part),
d AS (SELECT s_suppkey, 'be:defect:' || CASE WHEN s_suppkey % 4 = 1 THEN 'odd ' || s_suppkey ELSE replace(id, 'be:sym:', '') || ': late' END AS id, id AS method, s_suppkey % 4 <> 1 AS named FROM supplier JOIN e ON p_partkey = s_suppkey),
t AS (SELECT DISTINCT e.id AS src, d.id AS dst FROM lineitem JOIN d ON s_suppkey = l_suppkey JOIN e ON e.p_partkey = l_partkey WHERE l_suppkey % 3 = 0),
c AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber = 1 AND y.l_linenumber = 2 JOIN e a ON a.p_partkey = x.l_partkey JOIN e b ON b.p_partkey = y.l_partkey)
SELECT 'CALLS' AS kind, src, dst, 0.95e0 AS confidence, 'RUNTIME' AS resolution FROM c UNION ALL SELECT 'TRIGGERS_DEFECT', src, dst, 1.0, 'RUNTIME' FROM t
UNION ALL SELECT 'DECLARES', 'be:sym:' || c, id, 1.0, 'EXACT' FROM e WHERE c[2:]::INT % 2 = 0 UNION ALL SELECT 'TRIGGERS_DEFECT', method, id, 0.8, 'HEURISTIC' FROM d WHERE named AND id NOT IN (SELECT dst FROM t)""")
def _(spark, folder) -> DataFrame:
    t = {n: read_table(spark, folder, n) for n in ("part", "supplier", "lineitem")}
    name = F.concat(F.lit("C"), F.col("p_size"), F.when(F.col("p_partkey") % 2 == 0, "#").otherwise("."), F.lit("m"), F.col("p_partkey"))
    none = [F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line_start")]
    methods = t["part"].select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "method").otherwise("class_method").alias("kind"), name.alias("name"), *none)
    classes = t["part"].filter("p_size % 2 = 0").select(F.concat(F.lit("c"), "p_size").alias("id"), F.lit("class").alias("kind"), F.concat(F.lit("C"), "p_size").alias("name"), *none).distinct()
    title = F.when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("odd "), "s_suppkey")).otherwise(F.concat(name, F.lit(": late")))
    defects = t["supplier"].join(t["part"], F.col("p_partkey") == F.col("s_suppkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("observed_defect").alias("kind"), title.alias("name"), *none)
    routes = t["part"].select(F.concat(F.lit("r"), "p_partkey").alias("id"), F.lit("route").alias("kind"), F.lit("not taken over").alias("name"), *none)
    line, late = t["lineitem"], F.col("l_orderkey") % 2 == 0
    code_end, defect_end = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
    found = line.filter("l_suppkey % 3 = 0").select(F.when(late, defect_end).otherwise(code_end).alias("from_id"), F.when(late, code_end).otherwise(defect_end).alias("to_id"), F.when(late, "found_in").otherwise("contains_defect").alias("rel_type"))
    x, y = (line.filter(F.col("l_linenumber") == n).select("l_orderkey", F.concat(F.lit("p"), "l_partkey").alias(c)) for n, c in ((1, "from_id"), (2, "to_id")))
    calls = x.join(y, "l_orderkey").select("from_id", "to_id", F.lit("calls").alias("rel_type"))
    handlers = spark.createDataFrame([], "id string, controller string, action string")
    return knowledge.import_edges(methods.union(classes).union(defects).union(routes), found.union(calls), handlers)[1]


# --- what roles may see ---


@query("redacted_facts", """SELECT o_orderkey AS id, 'see a file in ' || o_orderpriority AS note, list_transform(list_filter(l, lambda x: x.n % 3 <> 0), lambda x: 'line ' || x.n) AS shown FROM
(SELECT o_orderkey, any_value(o_orderpriority) AS o_orderpriority, list({'n': l_linenumber} ORDER BY l_linenumber) AS l FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""")
def _(spark, folder) -> DataFrame:
    o, line = read_table(spark, folder, "orders"), read_table(spark, folder, "lineitem")
    def fact(n):
        kind = F.when(n % 3 == 0, "HANDLER").when(n % 3 == 1, "FEATURE").otherwise("COMPANY")
        more = F.create_map(F.lit("file"), F.lit("a/b.rb"), F.lit("say"), F.lit("in app/models/y.rb"))
        return F.struct(kind.alias("kind"), F.concat(F.lit("line "), n).alias("name"), F.lit("app/x.rb").alias("path"), more.alias("more"))

    # a list is collected where its rows are dealt to, in tasks that don't grow with the table
    held = spread(line.select("l_orderkey", "l_linenumber"), "l_orderkey", line.count()).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("l_linenumber")), fact).alias("lines"))
    note = F.concat(F.lit("see app/models/order_item.rb in "), "o_orderpriority")
    facts = o.join(held, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("id"), F.struct(note.alias("note"), F.struct("lines").alias("deep")).alias("f"))
    seen = redaction.redact(facts, "product")
    return seen.select("id", "f.note", F.transform("f.deep.lines", lambda x: x["name"]).alias("shown"))

