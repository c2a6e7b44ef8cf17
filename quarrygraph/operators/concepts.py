"""Features and people over code: what implements a feature by its folders, who owns code by the log, what is being built now, and route dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: kinds of code that a feature can be made of, the files of a person that count, and how sure ownership is
CODE_KINDS = ("SYMBOL", "FILE", "HANDLER", "HTTP_CALL_SITE", "UI_COMPONENT", "UI_ROUTE", "STATE_ACTION", "SERVER_ROUTE")
MOST_FILES, LEAST_SURE, MOST_SURE, COMMITS_A_POINT = 60, 0.5, 0.95, 20


def above(path: Column | str) -> Column:
    """A path and all folders above it."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def implements(features: DataFrame, code: DataFrame) -> DataFrame:
    """(src, dst) from features (feature, dirs, models) to the code (id, kind, path) in their folders, and to the symbols of their models.

    A path meets its own folders by equality, so no path is compared with any folder that isn't above it.
    """
    placed = code.filter(F.col("kind").isin(*CODE_KINDS) & F.col("path").isNotNull()).select(F.col("id").alias("dst"), F.explode(above("path")).alias("dir"))
    folders = features.select(F.col("feature").alias("src"), F.explode("dirs").alias("dir")).distinct()
    models = features.select(F.col("feature").alias("src"), F.explode("models").alias("model")).select("src", F.concat(F.lit("be:sym:"), "model").alias("dst"))
    named = models.join(code.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    return folders.join(placed, "dir").select("src", "dst").union(named).distinct()


def owns(touches: DataFrame, code: DataFrame) -> DataFrame:
    """(src, dst, commits, confidence) from people to the code in the files that they changed most; touches: person, path, one row a commit."""
    per = touches.groupBy("person", "path").agg(F.count(F.lit(1)).alias("commits"))
    first = per.withColumn("n", F.row_number().over(Window.partitionBy("person").orderBy(F.desc("commits"), "path"))).filter(F.col("n") <= MOST_FILES)
    at = code.filter(F.col("kind").isin(*CODE_KINDS)).select(F.col("id").alias("dst"), "path")
    sure = F.least(F.lit(MOST_SURE), LEAST_SURE + F.col("commits") / COMMITS_A_POINT)
    return first.join(at, "path").select(F.concat(F.lit("person:"), "person").alias("src"), "dst", "commits", sure.alias("confidence"))


def feature_activity(edges: DataFrame, code: DataFrame, activity: DataFrame) -> DataFrame:
    """(feature, touches, last_commit, nodes, active_nodes) over the code that implements each feature; activity: path, commits, last_commit.

    Touches are added up file by file, so a commit over many files of a feature counts for each.
    """
    rows = edges.join(code.select(F.col("id").alias("dst"), "path"), "dst").join(activity, "path", "left")
    return rows.groupBy(F.col("src").alias("feature")).agg(F.coalesce(F.sum("commits"), F.lit(0)).alias("touches"), F.max("last_commit").alias("last_commit"), F.countDistinct("dst").alias("nodes"), F.countDistinct(F.when(F.col("commits").isNotNull(), F.col("dst"))).alias("active_nodes"))


def route_graph(routes: DataFrame, normal) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) of a dump of routes (verb, path, controller, action, constraint); rows without an action are passed over.

    An action is one handler, by however many constraints it can be reached; they stand on the edge to the endpoint.
    Endpoints leave a leading /api out, as callers do; `normal` makes a path a path family.
    """
    rows = routes.filter(F.col("controller").isNotNull() & F.col("action").isNotNull())
    family = normal(F.regexp_replace("path", "^/api(?=/|$)", ""))
    handler = F.concat_ws("#", "controller", "action")
    rows = rows.select("*", F.concat(F.lit("be:"), handler).alias("handler"), F.concat(F.lit("be:"), F.concat_ws(" ", "verb", "path")).alias("route"), F.concat_ws(" ", F.col("verb"), family).alias("endpoint"), handler.alias("h_name"), family.alias("family"))
    entity = lambda kind, id_, name, path, sure: rows.select(F.col(id_).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), path.alias("path"), F.lit(sure).alias("confidence"))
    files = F.concat(F.lit("app/controllers/"), "controller", F.lit("_controller.rb"))
    entities = entity("HANDLER", "handler", F.col("h_name"), files, 0.95).union(entity("SERVER_ROUTE", "route", F.col("path"), F.lit("config/routes.rb"), 1.0)).union(entity("HTTP_ENDPOINT", "endpoint", F.col("family"), F.lit(None).cast("string"), 1.0)).distinct()
    serves = rows.groupBy("route", "endpoint").agg(F.array_sort(F.collect_set("constraint")).alias("constraints")).select(F.lit("SERVES").alias("kind"), F.col("route").alias("src"), F.col("endpoint").alias("dst"), F.lit(1.0).alias("confidence"), "constraints")
    handled = rows.select(F.lit("HANDLED_BY").alias("kind"), F.col("route").alias("src"), F.col("handler").alias("dst"), F.lit(0.95).alias("confidence"), F.array().cast("array<string>").alias("constraints")).distinct()
    return entities, serves.union(handled)
