"""Relationship lists over a graph: evidence, coverage, families, owners, screens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evidence(entities: DataFrame, refs: DataFrame, ids: DataFrame) -> DataFrame:
    """Where each id stands: repo, path, commit, and the names of refs that point at its commit."""
    names = refs.groupBy("commit").agg(F.array_join(F.array_sort(F.collect_set("ref")), ", ").alias("refs"))
    return entities.join(ids.select("id"), "id", "left_semi").join(names, "commit", "left").select("id", "kind", "name", "path", "repo", "commit", "blob", "refs")


def missing(entities: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("id").join(entities, "id", "left_anti")


def coverage(entities: DataFrame, edges: DataFrame, callers: DataFrame, servers: DataFrame) -> DataFrame:
    """(id, fe, be, status) of each contract node; callers and servers are the scopes of either side."""
    fe = edges.filter("kind = 'TARGETS'").join(callers.select("commit").distinct(), "commit", "left_semi").select(F.col("dst").alias("id"), F.lit(1).alias("f"), F.lit(0).alias("b"))
    be = edges.filter("kind = 'SERVES'").join(servers.select("commit").distinct(), "commit", "left_semi").select(F.col("dst").alias("id"), F.lit(0).alias("f"), F.lit(1).alias("b"))
    per = fe.union(be).groupBy("id").agg(F.sum("f").alias("fe"), F.sum("b").alias("be"))
    status = F.when((F.col("fe") > 0) & (F.col("be") > 0), "joined").when(F.col("fe") > 0, "called_not_served").when(F.col("be") > 0, "served_not_called").otherwise("unseen")
    return entities.filter("kind = 'HTTP_ENDPOINT'").select("id").join(per, "id", "left").select("id", F.coalesce("fe", F.lit(0)).alias("fe"), F.coalesce("be", F.lit(0)).alias("be")).withColumn("status", status)


def coverage_totals(status: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return status.agg(n("joined").alias("joined"), n("called_not_served").alias("called_but_not_served"), n("served_not_called").alias("served_but_not_called"))


def family(entities: DataFrame, edges: DataFrame, scope: DataFrame, prefix: str, limit: int = 60, method: str | None = None) -> DataFrame:
    """Contract nodes under a path with their callers, and their servers with handlers, as sorted lists.

    Lists are aggregated before they are joined; handlers are taken in scope. With a method, nodes of that method alone.
    """
    entities = entities if method is None else entities.filter(F.col("method") == method)
    here = edges.join(scope.select("commit").distinct(), "commit", "left_semi")
    ends = entities.filter((F.col("kind") == "HTTP_ENDPOINT") & F.col("path").startswith(prefix)).select("id", "name", "path")
    calls = here.filter("kind = 'TARGETS'").groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("callers"))
    handled = here.filter("kind = 'HANDLED_BY'").select(F.col("src").alias("route"), F.col("dst").alias("handler"))
    serves = here.filter("kind = 'SERVES'").select(F.col("dst").alias("id"), F.col("src").alias("route")).distinct().join(handled, "route", "left")
    served = serves.groupBy("id").agg(F.array_sort(F.collect_set(F.concat_ws(" > ", "route", "handler"))).alias("served_by"))
    out = ends.join(calls, "id", "left").join(served, "id", "left")
    empty = F.expr("cast(array() as array<string>)")
    out = out.select("id", "name", "path", F.coalesce("callers", empty).alias("callers"), F.coalesce("served_by", empty).alias("served_by"))
    status = F.when((F.size("callers") > 0) & (F.size("served_by") > 0), "joined").when(F.size("callers") > 0, "called_not_served").otherwise("served_not_called")
    return out.withColumn("status", status).orderBy("path", "id").limit(limit)


def unresolved_callers(entities: DataFrame, edges: DataFrame, scope: DataFrame, prefix: str) -> DataFrame:
    """Call sites whose target is not certain (resolution AMBIGUOUS) below a path, one row each."""
    here = edges.join(scope.select("commit").distinct(), "commit", "left_semi").filter("kind = 'TARGETS' and resolution = 'AMBIGUOUS'")
    ends = entities.filter((F.col("kind") == "HTTP_ENDPOINT") & F.col("path").startswith(prefix)).select(F.col("id").alias("dst"))
    return here.join(ends, "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("calls"))


def possible_callers(sites: DataFrame, callers: DataFrame, prefix: str, most: int = 30) -> DataFrame:
    """(path, line, raw, why): call sites that could not be resolved and may call a path family all the same.

    sites: path, line, raw, resolution; callers: path, of the family's known callers. First come sites whose source holds the
    family's last segment, then sites beside known callers, `most` of each by place, and each once.
    """
    open_ = sites.filter("resolution = 'AMBIGUOUS'").select("path", "line", "raw")
    last = [p for p in prefix.split("/") if p][-1:] or [prefix]
    named = open_.filter(F.lower("raw").contains(last[0].lower())).orderBy("path", "line").limit(most).withColumn("why", F.lit("names_path"))
    beside = open_.join(callers.select("path").distinct(), "path", "left_semi").orderBy("path", "line").limit(most).withColumn("why", F.lit("same_file"))
    return named.union(beside.join(named.select("path", "line"), ["path", "line"], "left_anti").select(named.columns)).orderBy(F.col("why") != "names_path", "path", "line")


def owners(touches: DataFrame, nodes: Sequence[str] | None = None, path_prefix: str | None = None, limit: int = 10) -> DataFrame:
    """People by the commits in which they touched code: touches has person, node, path, commits, last_commit."""
    rows = touches
    if nodes:
        rows = rows.filter(F.col("node").isin(list(nodes)))
    if path_prefix is not None:
        rows = rows.filter(F.col("path").startswith(path_prefix))
    per = rows.groupBy("person").agg(F.sum("commits").alias("commits"), F.max("last_commit").alias("last_commit"), F.countDistinct("node").alias("nodes"))
    return per.orderBy(F.desc("commits"), "person").limit(limit)


def summaries(rows: DataFrame, audience: str = "all", altitude: str | None = None, limit: int = 40, subject_key: str | None = None) -> DataFrame:
    """Cached prose for an audience, from the whole system down."""
    out = rows.filter(F.col("audience").isin(audience, "all"))
    if altitude is not None:
        out = out.filter(F.col("altitude") == altitude)
    if subject_key is not None:
        out = out.filter(F.col("subject_key") == subject_key)
    rank = F.when(F.col("altitude") == "system", 0).when(F.col("altitude") == "feature", 1).when(F.col("altitude") == "module", 2).otherwise(3)
    return out.orderBy(rank, "headline").limit(limit)


#: fixed values: the order in which a screen's actions are shown
ROLE_RANK = {"step": 0, "tab": 1, "button": 2, "menu": 3}


def screen_actions(actions: DataFrame, limit: int = 40) -> DataFrame:
    """Of actions (screen, name, role, line), the first of each name and role on each screen, in reading order."""
    first = actions.groupBy("screen", F.lower("name").alias("key"), "role").agg(F.min(F.struct("line", "name")).alias("f"))
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in ROLE_RANK.items() for x in kv])[F.col("role")], F.lit(4))
    from pyspark.sql import Window

    w = Window.partitionBy("screen").orderBy(rank, "f.line", "f.name")
    return first.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).select("screen", F.col("f.name").alias("name"), "role", F.col("f.line").alias("line"), "n")


def named_in(names: DataFrame, questions: DataFrame) -> DataFrame:
    """(item_id, screen, position): screens a question names, at the place of the first mention.

    names has screen and name, one row for each name, keyword or alias; questions has item_id and
    text. Names are joined by their first word, so only questions that hold it are compared.
    """
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]+", " "), " +", " ")), F.lit(" "))
    q = questions.select("item_id", plain.alias("q"))
    n = names.select("screen", F.lower("name").alias("name")).distinct()
    # a name is found by the rarest of its words, so that a word like "the" brings no questions together
    of_name = n.select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("w")).distinct()
    rare = of_name.groupBy("w").agg(F.count(F.lit(1)).alias("held"))
    by = of_name.join(rare, "w").groupBy("name").agg(F.min_by("w", F.struct("held", "w")).alias("rarest"))
    words = q.select("item_id", "q", F.explode(F.array_distinct(F.split(F.trim("q"), " "))).alias("rarest"))
    found = words.join(n.join(by, "name"), "rarest").withColumn("at", F.expr("locate(concat(' ', name, ' '), q)")).filter("at > 0")
    return found.groupBy("item_id", "screen").agg(F.min("at").alias("position"))


def one_of_each_name(found: DataFrame, screens: DataFrame) -> DataFrame:
    """Of screens that share a name, the one without a parameter in its route, then the shortest route; (item_id, screen, name, position)."""
    rows = found.join(screens.select("screen", "name", "route"), "screen")
    best = F.min_by(F.struct("screen", "position"), F.struct(F.col("route").contains(":"), F.length("route"), "screen"))
    return rows.groupBy("item_id", "name").agg(best.alias("b")).select("item_id", "b.screen", "name", "b.position")


def leads_to(navigations: DataFrame, declares: DataFrame, actions: DataFrame) -> DataFrame:
    """(screen, to, via): where a screen leads, and the names of its own actions that go there, joined by ' / '.

    navigations: src, dst, from screens and from actions alike; declares: screen, action; actions: action, name.
    """
    own = declares.join(actions, "action").select(F.col("action").alias("src"), "screen", "name")
    clicks = navigations.join(own, "src").groupBy("screen", F.col("dst").alias("to")).agg(F.array_join(F.array_sort(F.collect_set("name")), " / ").alias("via"))
    screens = declares.select("screen").distinct()
    direct = navigations.join(screens, navigations["src"] == screens["screen"]).select("screen", F.col("dst").alias("to")).distinct()
    return direct.join(clicks, ["screen", "to"], "left")


def backend_apis(edges: DataFrame, screens: DataFrame) -> DataFrame:
    """(screen, site, contract, handler): what a screen's calls target, and who handles it, through the routes that serve it."""
    of = lambda kind: edges.filter(F.col("kind") == kind).select("src", "dst").distinct()
    calls = of("ISSUES_HTTP").join(screens.select(F.col("screen").alias("src")), "src", "left_semi").select(F.col("src").alias("screen"), F.col("dst").alias("site"))
    targets = of("TARGETS").select(F.col("src").alias("site"), F.col("dst").alias("contract"))
    serves = of("SERVES").select(F.col("dst").alias("contract"), F.col("src").alias("route"))
    handled = of("HANDLED_BY").select(F.col("src").alias("route"), F.col("dst").alias("handler"))
    contracts = serves.join(handled, "route").select("contract", "handler").distinct()
    return calls.join(targets, "site").join(contracts, "contract", "left").select("screen", "site", "contract", "handler")


def through_features(summaries: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Summaries whose subject is one of the ids or a feature that one of them implements, each once."""
    features = edges.filter("kind = 'IMPLEMENTS'").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("subject"))
    return summaries.join(features.union(ids.select("id")).distinct(), "subject", "left_semi")


def describes(documents: DataFrame, changed: DataFrame, entities: DataFrame) -> DataFrame:
    """DESCRIBES edges (kind, src, dst) from a document to every entity in the files that its commit changed.

    documents: doc, commit; changed: commit, path; entities: id, path, commit.
    """
    files = documents.join(changed, "commit").select("doc", "commit", "path").distinct()
    return files.join(entities.select("id", "path", "commit"), ["commit", "path"]).select(F.lit("DESCRIBES").alias("kind"), F.col("doc").alias("src"), F.col("id").alias("dst")).distinct()
