"""Snapshots: differences, retention, carry-forward, extraction cache, and quality between two of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entity_diff(old: DataFrame, new: DataFrame, key: Sequence[str] = ("kind", "id")) -> DataFrame:
    """(key, change): added, removed, or moved to another path; a null path equals an empty one."""
    key = list(key)
    a = old.select(*key, F.coalesce("path", F.lit("")).alias("old_path"))
    b = new.select(*key, F.coalesce("path", F.lit("")).alias("new_path"))
    added = b.join(a, key, "left_anti").select(*key, F.lit("added").alias("change"))
    removed = a.join(b, key, "left_anti").select(*key, F.lit("removed").alias("change"))
    moved = a.join(b, key).filter("old_path <> new_path").select(*key, F.lit("moved").alias("change"))
    return added.union(removed).union(moved)


def survivors(refs: DataFrame, keep: int = 5) -> DataFrame:
    """Commits among the newest `keep` of some (repo, ref); keep below 2 is refused."""
    if keep < 2:
        raise ValueError("keep at least 2 snapshots, or nothing is left to compare with")
    w = Window.partitionBy("repo", "ref").orderBy(F.desc("last_seen"), F.desc("commit"))
    return refs.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= keep).select("repo", "commit").distinct()


def collectable(rows: DataFrame, alive: DataFrame) -> DataFrame:
    """(commit, n): what a collection would delete, by commit."""
    return rows.filter(F.col("commit").isNotNull()).join(alive.select("commit").distinct(), "commit", "left_anti").groupBy("commit").agg(F.count(F.lit(1)).alias("n"))


def carry_forward(edges: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Observed edges of the old snapshot whose two ends stand unchanged in the new one.

    Ends match on kind, id and content, nulls equal to nulls.
    """
    a, b = old.alias("a"), new.alias("b")
    same = a.join(b, F.expr("a.kind <=> b.kind and a.id = b.id and a.blob <=> b.blob")).select(F.expr("a.id").alias("id"))
    return edges.join(same.withColumnRenamed("id", "src"), "src", "left_semi").join(same.withColumnRenamed("id", "dst"), "dst", "left_semi")


def cache_misses(tree: DataFrame, facts: DataFrame, extractor: str, version: str) -> DataFrame:
    """Distinct blobs of a tree that the extractor's version has not seen: all that is left to parse."""
    done = facts.filter((F.col("extractor") == extractor) & (F.col("version") == version)).select("blob")
    return tree.select("blob").distinct().join(done, "blob", "left_anti")


def dedup_ratio(tree: DataFrame) -> DataFrame:
    """Files, distinct blobs, and the share of files that need no parse of their own."""
    return tree.agg(F.count(F.lit(1)).alias("files"), F.countDistinct("blob").alias("blobs")).withColumn("shared", F.round(1 - F.col("blobs") / F.col("files"), 6))


def upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows by key, the incoming ones filling in over the existing where they have a value.

    Of several incoming rows of a key the greatest value of each column counts, whatever their order.
    """
    key = list(key)
    rest = [c for c in existing.columns if c not in key]
    a, b = existing.alias("a"), incoming.groupBy(*key).agg(*[F.max(c).alias(c) for c in rest]).alias("b")
    joined = a.join(b, key, "full")
    return joined.select(*key, *[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in rest])


def quality_delta(old: DataFrame, new: DataFrame, by: str = "kind", drop: float = 0.02) -> DataFrame:
    """Counts by kind of two snapshots, the change, and a warning for kinds that vanish or shrink by more than `drop`."""
    a = old.groupBy(by).agg(F.count(F.lit(1)).alias("before"))
    b = new.groupBy(by).agg(F.count(F.lit(1)).alias("after"))
    out = a.join(b, by, "full").select(by, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    warning = F.when((F.col("before") > 0) & (F.col("after") == 0), "vanished").when(F.col("after") < F.col("before") * (1 - drop), "dropped").otherwise("ok")
    return out.withColumn("delta", F.col("after") - F.col("before")).withColumn("warning", warning)


def activity(touches: DataFrame, now: str, months: int = 12) -> DataFrame:
    """(path, people, commits_12mo, last_commit) from touches (person, path, at)."""
    recent = F.col("at") >= F.add_months(F.lit(now).cast("timestamp"), -months)
    return touches.groupBy("path").agg(F.countDistinct(F.when(recent, F.col("person"))).alias("people"), F.count_if(recent).alias("touches"), F.max("at").alias("last_commit"))


def audit(entities: DataFrame) -> DataFrame:
    """(repo, kind, entities, files, blobs): what an index holds."""
    return entities.groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("entities"), F.countDistinct("path").alias("files"), F.countDistinct("blob").alias("blobs"))


def top_subjects(touches: DataFrame, n: int) -> DataFrame:
    """(subject, touches, files, rank): the subjects with most touches, which are worth a summary."""
    per = touches.groupBy("subject").agg(F.count(F.lit(1)).alias("touches"), F.countDistinct("path").alias("files"))
    order = [F.desc("touches"), "subject"]
    return per.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def store_summaries(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Summaries by (repo, commit, altitude, subject_key, audience), the incoming ones in place of those before."""
    key = ["repo", "commit", "altitude", "subject_key", "audience"]
    return existing.join(incoming.select(*key).distinct(), key, "left_anti").select(incoming.columns).unionByName(incoming)


def merge_features(sources: DataFrame) -> DataFrame:
    """(slug, name, origins, paths): features named by documents and folders as one, by slug; sources: name, origin, path."""
    from ..functions.expressions import slug

    rows = sources.withColumn("slug", slug("name")).filter("slug <> ''")
    return rows.groupBy("slug").agg(F.min("name").alias("name"), F.array_sort(F.collect_set("origin")).alias("origins"), F.array_sort(F.collect_set("path")).alias("paths"))
