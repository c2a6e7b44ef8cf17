"""Scope: which commits a question reads, and the three public views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolve_scope(refs: DataFrame, names: Sequence[str] = ("main",)) -> DataFrame:
    """(repo, ref, commit): for each repo and named ref the commit last seen there."""
    chosen = refs.filter(F.col("ref").isin(list(names)))
    return chosen.groupBy("repo", "ref").agg(F.max_by("commit", F.struct("last_seen", "commit")).alias("commit"))


def in_scope(df: DataFrame, scope: DataFrame, keep_contracts: bool = True) -> DataFrame:
    """Rows of the scope's commits; contract rows, which have no commit, pass unless told otherwise."""
    commits = scope.select(F.col("commit").alias("scope_commit")).distinct()
    inside = df.join(commits, df["commit"] == commits["scope_commit"], "left_semi")
    return inside.unionByName(df.filter(F.col("commit").isNull())) if keep_contracts else inside


def v_refs(refs: DataFrame) -> DataFrame:
    """Every ref at its current commit."""
    w = Window.partitionBy("repo", "ref").orderBy(F.desc("last_seen"), F.desc("commit"))
    return refs.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def v_nodes(entities: DataFrame, refs: DataFrame) -> DataFrame:
    """Entities with the refs whose current commit is theirs; is_contract tells contract nodes from superseded ones."""
    now = v_refs(refs).select(F.col("ref"), F.col("commit").alias("c"))
    out = entities.join(now, entities["commit"] == now["c"], "left").drop("c")
    return out.withColumn("is_contract", F.col("commit").isNull())


def v_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with both ends named."""
    a = entities.select(F.col("id").alias("src"), F.col("kind").alias("src_kind"), F.col("name").alias("src_name"))
    b = entities.select(F.col("id").alias("dst"), F.col("kind").alias("dst_kind"), F.col("name").alias("dst_name"))
    return edges.join(a, "src").join(b, "dst")
