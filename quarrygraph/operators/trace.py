"""Bounded traversal: paths with a commit scope, an edge allowlist, a depth limit, cycle and hub guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import CONFIDENCE, HUB_IN_DEGREE, NARRATIVE
from ..session import cut

#: Edge kinds that point towards the contract from its server side; execution runs against them.
OPPOSED = frozenset({"SERVES"})

#: paths of a level that are sent to every task: some hundred bytes each
FRONTIER = 10_000


def hubs(edges: DataFrame, above: int = HUB_IN_DEGREE) -> DataFrame:
    """(id, in_degree) of nodes with more incoming edges than `above`, over all commits and kinds."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree")).filter(F.col("in_degree") > above)


def oriented(edges: DataFrame, kinds: Sequence[str], reverse: bool) -> DataFrame:
    """Edges as hops (from, to) in the direction of the walk; kinds that oppose it are turned round."""
    along = [k for k in kinds if (k in OPPOSED) == reverse]
    turn = ~F.col("kind").isin(along)
    hops = edges.filter(F.col("kind").isin(list(kinds)))
    return hops.select("edge_id", "kind", "confidence", "commit", "resolution", F.when(turn, F.col("dst")).otherwise(F.col("src")).alias("from"), F.when(turn, F.col("src")).otherwise(F.col("dst")).alias("to"))


def trace(
    edges: DataFrame, scope: DataFrame, root: str, direction: str = "forward", depth: int = 6, kinds: Sequence[str] = NARRATIVE,
    confidence: str = "medium", max_rows: int | None = 200, hub_above: int = HUB_IN_DEGREE, expand_hubs: bool = False,
) -> DataFrame:
    """One row for each path found: depth, kind, src, dst, edge_id, commit, confidence, resolution, path, dst_is_hub.

    Rows come in order of (depth, kind, src, dst, edge_id, path); one more than max_rows may be returned,
    which tells the caller that the walk was truncated. None sets no limit. Every level is one join of the
    frontier with the hops in scope; its lineage is cut so that no level is computed twice.
    """
    depth = min(max(1, depth), 6)
    commits = scope.select(F.col("commit").alias("c")).distinct()
    wanted = edges.filter((F.col("confidence") >= CONFIDENCE[confidence]) & F.col("kind").isin(list(kinds)))
    hops = oriented(wanted.join(commits, wanted["commit"] == commits["c"], "left_semi"), kinds, direction == "reverse")
    hops = hops.persist()
    every = None  # the hubs of all nodes, counted only for a walk with a large frontier

    def told(level: DataFrame, small: bool) -> DataFrame:
        """A level with hub: the ends of a small one are sent to the edges, so that only edges to them are counted."""
        nonlocal every
        if small:
            ends = level.select(F.col("to").alias("end")).distinct()
            return level.join(F.broadcast(cut(hubs(edges.join(F.broadcast(ends), edges["dst"] == ends["end"], "left_semi"), hub_above).select(F.col("id").alias("hub")))), F.col("to") == F.col("hub"), "left")
        every = every or cut(hubs(edges, hub_above).select(F.col("id").alias("hub")))
        return level.join(every, F.col("to") == F.col("hub"), "left")

    level = cut(hops.filter(F.col("from") == root).select(F.lit(1).alias("depth"), *hops.columns, F.array("from", "to").alias("path")))
    small = level.limit(FRONTIER + 1).count() <= FRONTIER
    levels, rows = [told(level, small)], 0
    for d in range(2, depth + 1):
        if max_rows is not None:  # rows go out by depth first: once the limit is full, deeper levels can't show
            rows += level.count()
            if rows > max_rows:
                break
        ahead = levels[-1] if expand_hubs else levels[-1].filter("hub is null")
        ahead = ahead.select("path", F.col("to").alias("at"))
        if small:  # a small frontier goes to the hops; a large one is shuffled with them
            ahead = F.broadcast(ahead)
        level = hops.join(ahead, hops["from"] == ahead["at"]).filter(~F.array_contains("path", F.col("to")))
        level = cut(level.select(F.lit(d).alias("depth"), *hops.columns, F.array_append("path", F.col("to")).alias("path")))
        if level.isEmpty():
            break
        small = level.limit(FRONTIER + 1).count() <= FRONTIER
        levels.append(told(level, small))
    hops.unpersist()
    flagged = levels[0]
    for more in levels[1:]:
        flagged = flagged.union(more)
    out = flagged.select("depth", "kind", F.col("from").alias("src"), F.col("to").alias("dst"), "edge_id", "commit", "confidence", "resolution", "path", F.col("hub").isNotNull().alias("dst_is_hub"))
    return out if max_rows is None else out.orderBy("depth", "kind", "src", "dst", "edge_id", "path").limit(max_rows + 1)


def trace_nodes(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Each node once, at its deepest kept depth, with its name and how many paths end there."""
    nodes = rows.groupBy(F.col("dst").alias("id")).agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("paths"), F.max("dst_is_hub").alias("is_hub"))
    return nodes.join(entities.select("id", "kind", "name", "path"), "id")


def shortest_paths(links: DataFrame, starts: DataFrame, most: int = 6) -> DataFrame:
    """(start, node, hops, path): breadth-first from each start over (src, dst) links, at most `most` hops.

    Of several shortest paths the one that is least as an array is kept. Nodes reached before are
    left out with an anti join, so a level holds new pairs only.
    """
    links = cut(links.select("src", "dst").distinct())
    level = cut(starts.select(F.col("node").alias("start"), F.col("node"), F.lit(0).alias("hops"), F.array("node").alias("path")).distinct())
    seen = level
    for h in range(1, most + 1):
        step = level.join(links, level["node"] == links["src"]).select("start", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"))
        step = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").groupBy("start", "node").agg(F.min("path").alias("path"))
        level = cut(step.select("start", "node", F.lit(h).alias("hops"), "path"))
        if level.isEmpty():
            break
        seen = seen.union(level)
    return seen


def best_chain(paths: DataFrame, candidates: DataFrame) -> DataFrame:
    """(start, node, hops, path, covered): of the shortest paths between candidates the one that meets most of them, then the longest."""
    c = candidates.select("node").distinct()
    ends = paths.filter("hops > 0").join(c.withColumnRenamed("node", "start"), "start", "left_semi").join(c, "node", "left_semi")
    met = ends.select("start", "node", F.explode("path").alias("at")).join(c.withColumnRenamed("node", "at"), "at", "left_semi").groupBy("start", "node").agg(F.count(F.lit(1)).alias("covered"))
    return ends.join(met, ["start", "node"]).orderBy(F.desc("covered"), F.desc("hops"), "path").limit(1).select("start", "node", "hops", "path", "covered")


def depth_columns(rows: DataFrame) -> DataFrame:
    """(id, depth, place, parent): nodes by column of their least depth; a node that just one other leads to has it as parent."""
    from pyspark.sql import Window

    nodes = rows.groupBy(F.col("dst").alias("id")).agg(F.min("depth").alias("depth"), F.countDistinct("src").alias("sources"), F.min("src").alias("source"))
    place = F.row_number().over(Window.partitionBy("depth").orderBy("id"))
    return nodes.select("id", "depth", place.alias("place"), F.when(F.col("sources") == 1, F.col("source")).alias("parent"))
