"""Where a question starts: its identifiers anchored to entities, and what lies around the anchor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import relations, similar, trace
from .search import TRIGRAM_FLOOR

#: fixed values: which kind of entity a question is taken to mean first, and how many rows each side of a lookup shows
PREFERRED = ("HTTP_CALL_SITE", "HANDLER", "HTTP_ENDPOINT", "DB_TABLE", "SYMBOL", "OBSERVED_DEFECT")
FORWARD_DEPTH, FORWARD_ROWS, REVERSE_DEPTH, REVERSE_ROWS = 4, 60, 2, 30
GUIDED_FORWARD, GUIDED_REVERSE, GUIDED_EVIDENCE, GUIDED_SIBLINGS = 6, 3, 35, 12


#: fixed values: words of questions about code that name nothing in it, and what each sign of an identifier is worth
PLAIN = (
    "what does the when which how is are a an of to in into and or that this do did it its for with from on by "
    "happens happen serves serve served called call calls code path paths lead leads table contain contains route routes file "
    "function method class where who why can should would about show me tell explain describe list all any"
).split()
MEMBER, ROUTE, CAMEL, SNAKE_OR_FILE, LENGTH_CAP = 5, 4, 3, 3, 30


def identifiers(questions: DataFrame) -> DataFrame:
    """(item_id, token, weight): words of a question that can name something in code, weighed by the signs of an identifier they bear.

    A member of a class, a route, mixed case, and an underscore or a file's ending each count once; length tells apart what is level.
    """
    names = F.transform(F.regexp_extract_all("text", F.lit(r"[/A-Za-z_][\w/:#.$*-]*"), F.lit(0)), lambda n: F.rtrim(n, F.lit(".:")))
    kept = F.array_distinct(F.filter(names, lambda n: (F.length(n) >= 3) & ~F.lower(n).isin(PLAIN)))
    found = questions.select("item_id", F.explode(kept).alias("token"))
    has = lambda pattern: F.col("token").rlike(pattern)
    signs = found.withColumn("signs", F.filter(F.array(
        F.when(has("[A-Z]") & has("[.#]"), MEMBER), F.when(has("^/"), ROUTE), F.when(has(r"\p{Lower}\p{Upper}"), CAMEL), F.when(has("_") | has(r"[.]\w+$"), SNAKE_OR_FILE)), lambda x: x.isNotNull()))
    worth = F.aggregate("signs", F.lit(0), lambda total, x: total + x)
    return signs.select("item_id", "token", (worth + F.least(F.length("token"), F.lit(LENGTH_CAP)) / LENGTH_CAP).alias("weight"))


def _kind_rank():
    return F.coalesce(F.create_map(*[F.lit(x) for kv in zip(PREFERRED, range(len(PREFERRED)), strict=True) for x in kv])[F.col("kind")], F.lit(len(PREFERRED)))


def exact_hits(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """Tokens with the entities they name: by id, by name in any case, or by the end of a path."""
    e = entities.select("id", "kind", "name", "path")
    by_id = tokens.join(e, tokens["token"] == e["id"])
    by_name = tokens.join(e, F.lower("token") == F.lower("name"))
    end = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    paths = tokens.filter(F.col("token").rlike("[/.]")).withColumn("end", end("token"))
    by_path = paths.join(e.withColumn("end", end("path")), "end").filter(F.lower("path").endswith(F.lower("token"))).drop("end")
    return by_id.union(by_name).union(by_path.select(by_id.columns)).distinct()


def similar_hits(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """Tokens with entities of similar names, and the trigram similarity; distinct names meet by their rarer trigrams only."""
    near = similar.similar_names(tokens, "token", entities, "name", TRIGRAM_FLOOR).select(F.col("a").alias("token"), F.col("b").alias("name"), "score")
    return tokens.join(near, "token").join(entities.select("id", "kind", "name", "path"), "name")


def anchor(entities: DataFrame, questions: DataFrame) -> DataFrame:
    """(item_id, id, kind, name, path, token, match) of each question that can be anchored.

    The most specific token that names an entity exactly decides; without one, the most specific that a name
    resembles, and at last the question as a whole. Of several entities the preferred kind is taken.
    """
    tokens = identifiers(questions)
    columns = ["item_id", "id", "kind", "name", "path", "token", "match"]
    first = lambda order: F.row_number().over(Window.partitionBy("item_id").orderBy(*order))
    exact = exact_hits(tokens, entities).withColumn("match", F.lit("exact"))
    exact = exact.withColumn("n", first([F.desc("weight"), "token", _kind_rank(), "id"])).filter("n = 1").select(columns)
    whole = questions.select("item_id", F.col("text").alias("token"), F.lit(-1.0).alias("weight"))
    left = tokens.unionByName(whole).join(exact.select("item_id"), "item_id", "left_anti")
    near = similar_hits(left, entities).withColumn("match", F.lit("approximate"))
    near = near.withColumn("n", first([F.desc("weight"), "token", _kind_rank(), F.desc("score"), "id"])).filter("n = 1").select(columns)
    return exact.union(near)


def around(entities: DataFrame, edges: DataFrame, scope: DataFrame, root: str, forward: tuple[int, int] = (FORWARD_DEPTH, FORWARD_ROWS), reverse: tuple[int, int] = (REVERSE_DEPTH, REVERSE_ROWS)) -> DataFrame:
    """(side, id, depth, paths, is_hub, kind, name, path) of what lies downstream and upstream of an entity."""
    sides = []
    for side, direction, (depth, most) in (("downstream", "forward", forward), ("upstream", "reverse", reverse)):
        rows = trace.trace(edges, scope, root, direction=direction, depth=depth, max_rows=most)
        sides.append(trace.trace_nodes(rows, entities).select(F.lit(side).alias("side"), "id", "depth", "paths", "is_hub", "kind", "name", "path"))
    return sides[0].unionByName(sides[1])


def siblings(entities: DataFrame, edges: DataFrame, root: str, most: int = GUIDED_SIBLINGS) -> DataFrame:
    """Other entities in the root's file with a call that could not be resolved, first by line."""
    file = entities.filter(F.col("id") == root).select("path").distinct()
    unclear = edges.filter("resolution = 'AMBIGUOUS'").groupBy(F.col("src").alias("id")).agg(F.min("line").alias("line"))
    return entities.join(file, "path", "left_semi").filter(F.col("id") != root).join(unclear, "id").select("id", "kind", "name", "path", "line").orderBy("line", "id").limit(most)


def guided(entities: DataFrame, edges: DataFrame, refs: DataFrame, scope: DataFrame, root: str) -> dict[str, DataFrame]:
    """The frames of a guided answer: claims both ways, the evidence they cite, and unresolved siblings."""
    claims = around(entities, edges, scope, root, (GUIDED_FORWARD, FORWARD_ROWS), (GUIDED_REVERSE, REVERSE_ROWS))
    cited = claims.orderBy("depth", "side", "id").select("id").distinct().orderBy("id").limit(GUIDED_EVIDENCE)
    return {"claims": claims, "evidence": relations.evidence(entities, refs, cited), "siblings": siblings(entities, edges, root)}
