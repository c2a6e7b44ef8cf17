"""Search: exact, fuzzy, path and vector lookups, rank fusion, and set listings with exact totals."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import fulltext

#: fixed values: the least name similarity, and the constant of reciprocal rank fusion
TRIGRAM_FLOOR = 0.3
FUSION_K = 60


def find_entity(entities: DataFrame, query: str, kind: str | None = None, repo: str | None = None, limit: int = 20, scope: DataFrame | None = None) -> DataFrame:
    """Entities whose id is the query, whose name resembles it, or whose path holds it, best first.

    A path-shaped query scores 0.9 on paths, any other 0.3. An entity may come once for each
    reason. `weak` tells that even the best match is not exact.
    """
    rows = entities if kind is None else entities.filter(F.col("kind") == kind)
    rows = rows if repo is None else rows.filter(F.col("repo") == repo)
    if scope is not None:
        from .scope import in_scope

        rows = in_scope(rows, scope)
    q = F.lit(query)
    exact = rows.filter(F.col("id") == q).withColumn("match_reason", F.lit("exact_fqn")).withColumn("score", F.lit(1.0))
    named = rows.filter(F.col("name").isNotNull()).withColumn("match_reason", F.lit("name_trigram")).withColumn("score", X.trigram_similarity("name", q)).filter(F.col("score") >= TRIGRAM_FLOOR)
    placed = rows.filter(F.lower("path").contains(query.lower())).withColumn("match_reason", F.lit("path_substring")).withColumn("score", F.lit(0.9 if re.search(r"[/.]", query) else 0.3))
    found = exact.unionByName(named).unionByName(placed).select("id", "kind", "name", "path", "commit", "match_reason", "score")
    top = found.orderBy(F.desc("score"), "kind", "id", "match_reason").limit(limit)
    return top.withColumn("weak", ~F.max(F.col("match_reason") == "exact_fqn").over(Window.partitionBy()))


def list_filter(kind=None, path_prefix=None, name_prefix=None, name_contains=None, repo=None, subkind=None) -> Column:
    """The condition of a listing; only what is asked for takes part."""
    parts = [F.lit(True)]
    if kind is not None:
        parts.append(F.col("kind") == kind)
    if path_prefix is not None:
        parts.append(F.col("path").startswith(path_prefix))
    if name_prefix is not None:
        parts.append(F.lower("name").startswith(name_prefix.lower()))
    if name_contains is not None:
        parts.append(F.lower("name").contains(name_contains.lower()))
    if subkind is not None:
        parts.append(F.col("subkind") == subkind)
    if repo is not None:
        parts.append(F.col("repo") == repo)
    return reduce(lambda a, b: a & b, parts)


def list_entities(entities: DataFrame, order: Sequence[str] = ("name", "id"), limit: int = 200, **wanted) -> DataFrame:
    """Every entity of a shape, up to the limit (500 at most)."""
    return entities.filter(list_filter(**wanted)).orderBy(*order).limit(min(limit, 500))


def by_subkind(listed: DataFrame) -> DataFrame:
    """(subkind, n) of the rows a listing returned."""
    return listed.groupBy("subkind").agg(F.count(F.lit(1)).alias("n"))


def list_total(entities: DataFrame, limit: int = 200, **wanted) -> DataFrame:
    """One row: the exact total, how many a listing returns, and whether that is all."""
    n = entities.filter(list_filter(**wanted)).agg(F.count(F.lit(1)).alias("total"))
    returned = F.least(F.col("total"), F.lit(min(limit, 500)).cast("long"))
    return n.select("total", returned.alias("returned"), (F.col("total") <= returned).alias("complete"))


def nearest(vectors: DataFrame, query, k: int = 10, where: Column | None = None, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k rows of highest cosine with a query vector, exactly, with score and rank."""
    rows = vectors if where is None else vectors.filter(where)
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.withColumn("score", X.cosine(column, literal)).filter(F.col("score").isNotNull())
    top = scored.orderBy(F.desc("score"), id_column).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_column)))


def by_words(docs: DataFrame, question_tokens: Sequence[str], k: int, id_column: str, column: str = "text", every: bool = False) -> DataFrame:
    """The k rows that answer the question's words best by cover density, with hits (their score) and rank; rows without any (or, on request, all) are no hits."""
    best = fulltext.top(fulltext.inverted(docs, id_column, column, question_tokens), question_tokens, k, every)
    found = best.select(F.col("id").alias("found_id"), F.col("score").alias("hits"), "rank")  # k rows
    return docs.join(F.broadcast(found), docs[id_column] == found["found_id"]).drop("found_id")


def fuse(lists: Sequence[DataFrame], id_column: str, k: int = FUSION_K) -> DataFrame:
    """(id, fused) by reciprocal rank over ranked lists, fused rounded to five places."""
    union = reduce(DataFrame.unionByName, [x.select(id_column, "rank") for x in lists])
    return union.groupBy(id_column).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 5).alias("fused"))


def hybrid(meaning: DataFrame, words: DataFrame, id_column: str, k: int, floor: float) -> DataFrame:
    """Fused hits of a vector list and a word list: the floor holds for what meaning found, words-only hits stay."""
    fused = fuse([meaning, words], id_column)
    out = fused.join(meaning.select(id_column, "score"), id_column, "left").withColumn("via", F.when(F.col("score").isNotNull(), "meaning").otherwise("words"))
    return out.filter(F.col("score").isNull() | (F.col("score") >= floor)).orderBy(F.desc("fused"), id_column).limit(k)


def clear_top(items: DataFrame, group: str, key: str, score: str, floor: float = 0.5, close: float = 0.05, margin: float = 0.03) -> DataFrame:
    """The best one or two items of each group if they stand clear of the rest.

    The second stays with the first if it is within `close` of it; what is kept must be at least
    `margin` above the next item and at least `floor`.
    """
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    rows = items.filter(F.col(score) >= floor).withColumn("n", F.row_number().over(w))
    per = rows.filter("n <= 3").groupBy(group).agg(*[F.max(F.when(F.col("n") == i, F.col(score))).alias(f"s{i}") for i in (1, 2, 3)])

    def clear(a: str, b: str) -> Column:
        return F.col(b).isNull() | (F.col(a) - F.col(b) >= margin)

    pair = (F.col("s1") - F.col("s2") <= close) & clear("s2", "s3")
    kept = per.withColumn("keep", F.when(pair, 2).when(clear("s1", "s2"), 1).otherwise(0)).select(group, "keep")
    return rows.join(kept, group).filter("n <= keep").select(group, key, score, F.col("n").alias("rank"))


#: fixed values: what the two best word hits score at least, and the floors of passages, switches and names
WORD_LIFT, PASSAGE_FLOOR, SWITCH_FLOOR, NAME_FLOOR = 0.62, 0.45, 0.4, 0.5


def ranked_lists(table: DataFrame, question: str, id_column: str, text: str, vector: str, query_vector, k: int) -> tuple[DataFrame, DataFrame]:
    """(meaning, words): the 2k nearest rows and the 2k with most of the question's words, each with score and rank."""
    words = by_words(table, [w for w in re.findall(r"[a-z0-9_]+", question.lower()) if w not in X.STOP_WORDS], 2 * k, id_column, text)
    scored = words.withColumn("score", F.coalesce(X.cosine(vector, F.array(*[F.lit(float(x)) for x in query_vector])), F.lit(0.0)))
    return nearest(table, query_vector, 2 * k, None, id_column, vector).select(id_column, "score", "rank"), scored.select(id_column, "score", "rank")


def _lifted(lists: dict[str, DataFrame], id_column: str, k: int, floor: float) -> DataFrame:
    """(id, via, score, rank): lists fused by rank; a typed key leads and is certain, the two best word hits are lifted, and what stays below the floor goes."""
    fused = fuse(list(lists.values()), id_column)
    every = reduce(DataFrame.unionByName, [x.select(id_column, "score", "rank", F.lit(i).alias("list"), F.lit(name).alias("via")) for i, (name, x) in enumerate(lists.items())])
    per = every.groupBy(id_column).agg(F.min_by(F.struct("via", "score"), F.struct("list", "rank")).alias("first"), F.max((F.col("via") == "words") & (F.col("rank") <= 2)).alias("top"))
    rows = fused.join(per, id_column).withColumn("via", F.col("first.via"))
    order = [F.desc(F.col("via") == "key"), F.desc("fused"), F.col(id_column)]
    best = rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    score = F.when(F.col("via") == "key", F.lit(1.0)).when(F.col("top"), F.greatest("first.score", F.lit(WORD_LIFT))).otherwise(F.col("first.score"))
    return best.select(id_column, "via", F.round(score, 2).alias("score"), "rank").filter(F.col("score") >= floor)


def search_switches(switches: DataFrame, overrides: DataFrame, question: str, query_vector, k: int = 6, floor: float = SWITCH_FLOOR) -> DataFrame:
    """Configuration switches (config_key, text, vector) for a question, by typed key, words and meaning, with how they are overridden.

    overrides: config_key, owner, active. The three counts are aggregated once and joined.
    """
    keys = sorted(set(re.findall(r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b", question.lower())))
    typed = switches.filter(F.col("config_key").isin(keys)).select("config_key", F.lit(1.0).alias("score"), F.row_number().over(Window.orderBy("config_key")).alias("rank"))
    meaning, words = ranked_lists(switches, question, "config_key", "text", "vector", query_vector, k)
    found = _lifted({"key": typed, "words": words, "meaning": meaning}, "config_key", k, floor)
    counts = overrides.groupBy("config_key").agg(F.count(F.lit(1)).alias("overrides"), F.count_if("active").alias("overrides_active"), F.countDistinct(F.when(F.col("active"), F.col("owner"))).alias("companies_active"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("overrides", "overrides_active", "companies_active")]
    return found.join(counts, "config_key", "left").select("config_key", "via", "score", "rank", *zero)


def search_names(names: DataFrame, owners: DataFrame, question: str, query_vector, k: int = 6, floor: float = NAME_FLOOR) -> DataFrame:
    """Mirrored names (ref, text, vector, owner) for a question by meaning and words, with the owner's name; owners: owner, company."""
    meaning, words = ranked_lists(names, question, "ref", "text", "vector", query_vector, k)
    found = _lifted({"meaning": meaning, "words": words}, "ref", k, floor)
    return found.join(names.select("ref", "text", "owner"), "ref").join(owners, "owner", "left").select("ref", "text", "company", "via", "score", "rank")


def search_passages(passages: DataFrame, question: str, query_vector, k: int = 6, floor: float = PASSAGE_FLOOR) -> DataFrame:
    """Passages (passage, doc_id, heading_path, text, vector) for a question: by meaning and words, one a heading of a document.

    The floor holds for what meaning found; without a reranker, hits go out by their fused rank.
    """
    words = by_words(passages, [w for w in re.findall(r"[a-z0-9_]+", question.lower()) if w not in X.STOP_WORDS], 2 * k, "passage")
    meaning = nearest(passages, query_vector, 3 * k, None, "passage", "vector").select("passage", "score", "rank")
    fused = fuse([meaning, words.select("passage", "rank")], "passage").join(meaning.select("passage", "score"), "passage", "left")
    kept = fused.filter(F.col("score").isNull() | (F.col("score") >= floor)).join(passages.select("passage", "doc_id", "heading_path", "text"), "passage")
    one = kept.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "heading_path").orderBy(F.desc("fused"), "passage"))).filter("n = 1")
    via = F.when(F.col("score").isNull(), "words").otherwise("meaning")
    return one.orderBy(F.desc("fused"), "passage").limit(2 * k).select("passage", "doc_id", "heading_path", "text", "fused", "score", via.alias("via")).limit(k)


def page(rows: DataFrame, order: Sequence[str], offset: int, size: int) -> DataFrame:
    """Rows offset + 1 to offset + size in a total order."""
    return rows.orderBy(*order).offset(offset).limit(size)
