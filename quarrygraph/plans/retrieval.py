"""Queries with their SQL for word search by position and for names alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fulltext, search
from ..session import read_table
from .catalog import SQL, query

__all__ = ["SQL"]

STOP = ", ".join(f"'{w}'" for w in search.X.STOP_WORDS)


def _stem(word: str) -> str:
    """The light stem in SQL: an ending goes, then one of two equal consonants, unless fewer than three letters stay."""
    cut = f"regexp_replace({word}, '(ing|edly|ed|ies|es|s|ly)$', '')"
    single = f"CASE WHEN length({cut}) > 1 AND right({cut}, 1) = left(right({cut}, 2), 1) AND contains('bdgklmnprt', right({cut}, 1)) THEN left({cut}, length({cut}) - 1) ELSE {cut} END"
    return f"CASE WHEN length({cut}) >= 3 THEN {single} ELSE {word} END"


def _terms(table: str, id_column: str) -> str:
    """CTEs w (words of a table by position) and p (id, term, position)."""
    return f"""w AS (SELECT {id_column} AS id, unnest(l) AS word, unnest(range(len(l))) AS position FROM (SELECT {id_column}, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda x: x <> '') AS l FROM {table})),
p AS (SELECT id, {_stem('word')} AS term, position FROM w WHERE length(word) > 1 AND word NOT IN ({STOP}))"""


@query("word_ranks", f"""WITH {_terms('documents', 'doc_id')}, q AS (SELECT unnest(list_distinct(list_transform(list_filter(regexp_extract_all(lower((SELECT text FROM benchmark ORDER BY item_id LIMIT 1)), '[a-z0-9_]+'), lambda x: length(x) > 1 AND x NOT IN ({STOP})), lambda x: {_stem('x')}))) AS term),
s AS (SELECT id, 0.1e0 * count(*) AS score FROM p SEMI JOIN q USING (term) GROUP BY id)
SELECT id AS doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s ORDER BY rank LIMIT 20""")
def _(spark, folder) -> DataFrame:
    asked = read_table(spark, folder, "benchmark").orderBy("item_id").select(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)")).alias("w")).first()["w"]
    found = search.by_words(read_table(spark, folder, "documents").select("doc_id", "text"), asked, 20, "doc_id")
    return found.select("doc_id", F.round("hits", 6).alias("score"), "rank")


@query("word_covers", f"""WITH {_terms('documents', 'doc_id')}, t(term) AS (VALUES ('public'), ('license'), ('version')), m AS (SELECT * FROM p SEMI JOIN t USING (term)),
l AS (SELECT id, position, least(max(position) FILTER (term = 'public') OVER o, max(position) FILTER (term = 'license') OVER o, max(position) FILTER (term = 'version') OVER o) AS b,
  count(DISTINCT term) OVER o AS have FROM m WINDOW o AS (PARTITION BY id ORDER BY position ROWS UNBOUNDED PRECEDING)),
c AS (SELECT id, b, min(position) AS e FROM l WHERE have = 3 GROUP BY 1, 2), n AS (SELECT c.id, b, e, count(*) AS met FROM c JOIN m ON m.id = c.id AND m.position BETWEEN b AND e GROUP BY ALL)
SELECT id AS doc_id, b::INT AS start, e::INT AS "end", met::INT AS met, round(sum(0.1e0 / (1 + e - b + 1 - met)) OVER (PARTITION BY id), 6) AS score FROM n""")
def _(spark, folder) -> DataFrame:
    asked = ["public", "license", "version"]
    index = fulltext.inverted(read_table(spark, folder, "documents"), "doc_id", asked=asked)
    ranks = fulltext.cover_ranks(index, asked, every=True)
    return fulltext.covers(index, asked).join(ranks, "id").select(F.col("id").alias("doc_id"), "start", "end", "met", F.round("score", 6).alias("score"))
