"""Index runs and answering rounds as data: changed paths, cache metrics, facts within a budget, commands in replies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import LONGEST_READ, readable

# --- index runs ---


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two trees (path, blob): added, deleted, or modified."""
    a, b = old.select("path", F.col("blob").alias("a"), F.lit(True).alias("in_a")), new.select("path", F.col("blob").alias("b"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return a.join(b, "path", "full").select("path", change.alias("change")).filter("change is not null")


def index_runs(refs: DataFrame, trees: DataFrame, facts: DataFrame) -> DataFrame:
    """(ref, commit, files, blobs, cached, hit_percent) of a pass over all refs at once.

    refs: ref, commit; trees: commit, path, blob; facts: blob, for all that the extractor's version has seen.
    A commit that several refs name is counted once and joined to each of them; blobs are joined to the cache
    after they are distinct by commit, so a blob of many files meets it once.
    """
    per = trees.groupBy("commit", "blob").agg(F.count(F.lit(1)).alias("n"))
    seen = facts.select("blob", F.lit(1).alias("hit")).distinct()
    of = per.join(seen, "blob", "left").groupBy("commit").agg(F.sum("n").alias("files"), F.count("blob").alias("blobs"), F.count("hit").alias("cached"))
    percent = F.when(F.col("blobs") > 0, F.round(100 * F.col("cached") / F.col("blobs"))).otherwise(0).cast("int")
    return refs.select("ref", "commit").join(of, "commit").select("ref", "commit", "files", "blobs", "cached", percent.alias("hit_percent"))


def read_at(tree: DataFrame, texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(path, line, content) of asked (commit, path, start, end) ranges: tree joined to the stored texts of its blobs.

    Ranges are cut at LONGEST_READ lines; paths that may hold secrets are never read.
    """
    ranges = readable(asked.select("commit", "path", "start", F.least("end", F.col("start") + LONGEST_READ - 1).alias("end")))
    files = ranges.join(tree.select("commit", "path", "blob"), ["commit", "path"])
    parts = F.split("text", "\n", -1)
    of = files.join(texts.select("blob", "text"), "blob").select("commit", "path", "start", F.slice(parts, F.col("start"), F.greatest(F.col("end") - F.col("start") + 1, F.lit(0))).alias("found"))
    return of.select("commit", "path", "start", F.posexplode("found").alias("p", "content")).select("commit", "path", (F.col("start") + F.col("p")).cast("int").alias("line"), "content")


# --- facts of an answer ---

#: fixed values: the steps in which facts are cut, least important first, as how many items of a list stay
FACT_STEPS: tuple[dict[str, int], ...] = (
    {"greps": 6, "grep_hits": 4}, {"lists": 15}, {"downstream": 12, "upstream": 6}, {"families": 12, "callers": 6}, {"live": 12},
    {"documents": 3}, {"source": 2}, {"greps": 0, "grep_hits": 0}, {"lists": 6}, {"downstream": 6, "upstream": 0}, {"source": 0},
)
FACT_BUDGET = 30_000


def within_budget(facts: DataFrame, steps: Sequence[Mapping[str, int]] = FACT_STEPS, budget: int = FACT_BUDGET) -> DataFrame:
    """The facts (question, list, position, size, ...) that stay, with the number of steps their question needed.

    A question takes as few steps as bring its facts within the budget, all of them if none does. The step that drops
    a fact follows from its list and its position (from 1), so one aggregate by question tells the sizes after
    each step; nothing is sorted.
    """
    drops = [(k, name, keep) for k, step in enumerate(steps, 1) for name, keep in step.items()]
    at = F.lit(len(steps) + 1)
    for k, name, keep in reversed(drops):
        at = F.when((F.col("list") == name) & (F.col("position") > keep), k).otherwise(at)
    marked = facts.withColumn("_at", at)
    sizes = F.array(*[F.coalesce(F.sum(F.when(F.col("_at") > k, F.col("size"))), F.lit(0)) for k in range(len(steps) + 1)])
    needed = F.array_position(F.transform("_sizes", lambda s: s <= budget), True)
    per = marked.groupBy("question").agg(sizes.alias("_sizes")).select(F.col("question").alias("_q"), F.when(needed > 0, needed - 1).otherwise(len(steps)).cast("int").alias("steps"))
    return marked.join(per, F.col("question").eqNullSafe(F.col("_q"))).filter(F.col("_at") > F.col("steps")).drop("_at", "_q")


# --- commands in replies ---


def command(reply: Column | str) -> Column:
    """A struct (cmd, repo, path, start, end, pattern, sql) of what a reply asks for.

    A reply's lines outside fences are looked at; a command is the line's first word, with or without a colon.
    READ comes before GREP, and both before SQL, which runs from its line to the end or to a line of
    another command; ANSWER counts only where no other command is named, and what fits nothing is UNKNOWN.
    """
    text = F.col(reply) if isinstance(reply, str) else reply
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~F.ltrim(x).startswith("```"))
    first = lambda x: F.lower(F.regexp_extract(x, r"^\s*([A-Za-z]+)", 1))
    words = lambda x: F.split(F.trim(x), r":?\s+")
    a_read = lambda x: (first(x) == "read") & x.rlike(r"^\s*\w+:?\s+\S+\s+\S+\s+\d+")
    a_grep = lambda x: (first(x) == "grep") & x.rlike(r"^\s*\w+:?\s+\S+\s+\S")
    a_query = lambda x: first(x).isin("sql", "select", "with")
    of = lambda test: F.try_element_at(F.filter(lines, test), F.lit(1))
    read, grep = of(a_read), of(a_grep)
    from_query = F.slice(lines, F.greatest(F.array_position(F.transform(lines, a_query), True), F.lit(1)).cast("int"), F.greatest(F.size(lines), F.lit(0)))
    other = F.array_position(F.transform(from_query, lambda x: first(x).isin("read", "grep", "answer")), True)
    body = F.when(other > 1, F.slice(from_query, F.lit(1), other.cast("int") - 1)).otherwise(from_query)
    sql = F.when(F.exists(lines, a_query), F.trim(F.regexp_replace(F.array_join(body, "\n"), r"^(?i)\s*sql:?\s*", "")))
    asked = F.exists(lines, lambda x: first(x).isin("sql", "read", "grep") & x.contains(":"))
    answer = F.exists(lines, lambda x: first(x) == "answer") & ~asked
    cmd = F.when(answer, "ANSWER").when(read.isNotNull(), "READ").when(grep.isNotNull(), "GREP").when(F.length(sql) > 0, "SQL").otherwise("UNKNOWN")
    word = lambda line, n: F.try_element_at(words(line), F.lit(n))
    pattern = F.regexp_replace(F.trim(F.regexp_extract(grep, r"^\s*\w+:?\s+\S+\s+(.*)$", 1)), "^[\"'`]|[\"'`]$", "")
    start = word(read, 4).try_cast("int")
    return F.struct(
        cmd.alias("cmd"), F.when(cmd == "READ", word(read, 2)).when(cmd == "GREP", word(grep, 2)).alias("repo"), F.when(cmd == "READ", word(read, 3)).alias("path"),
        F.when(cmd == "READ", start).alias("start"), F.when(cmd == "READ", F.coalesce(word(read, 5).try_cast("int"), start + LONGEST_READ - 1)).alias("end"),
        F.when(cmd == "GREP", pattern).alias("pattern"), F.when(cmd == "SQL", sql).alias("sql"),
    )


# --- confidence ---


def confidence_reason() -> Column:
    """The strongest signal behind a confidence level, by the signals of `confidence_level`."""
    order = [
        ("screens_in_order", F.col("journey_ordered")), ("exact_name", F.col("exact") > 0), ("live_rows", F.col("live_rows") > 0), ("complete_set", F.col("complete_list")),
        ("meaning", (F.col("sem_top") >= 0.72) & (F.col("sem_margin") >= 0.04)), ("similar_name", F.col("approximate") > 0), ("documents", F.col("strong_docs") > 0),
    ]
    return F.coalesce(*[F.when(test, name) for name, test in order], F.lit("nothing"))


def confidence_missing(level: Column) -> Column:
    """What would raise a level that isn't high: code not followed to its end, no document, no code read, or a second source."""
    unfollowed = (F.col("unresolved") > 0) | F.col("truncated")
    unread = (F.col("exact") == 0) & ~F.col("source_read") & (F.col("live_rows") == 0)
    gap = (
        F.when((F.col("exact") > 0) & unfollowed, "rest_of_path").when((F.col("strong_docs") == 0) & (F.col("live_rows") == 0), "document")
        .when(unread, "code").when(unfollowed, "rest_of_path").otherwise("second_source")
    )
    return F.when(level != "high", gap)
