"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_dedup, importance, jaccard_join, line_dedup, lm_scoring, mixing, periodic_runs, personal_data, quality, token_counts, toxicity, url_filter
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "text", "n_passages", "n_removed", F.array_join(F.transform("removed", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), " ").alias("removed")
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lm_scoring.backoff_scores(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", F.round("score", 4).alias("score"), F.round("mean_log", 6).alias("mean_log"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find_runs(periodic_runs.planted(table(spark, sf_dir, "documents"))))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.find(table(spark, sf_dir, "documents")))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85).select("doc_id", "n_shingles", "component_id")


OP3_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS t FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
"""


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x), c AS (SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id, vec_id <= coalesce(c, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id
"""

#: Rules are found by counting every set of tokens of every labelled page; of explicit rules the longest that fits is the last.
OP10_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
k AS (SELECT *, list_sort(list_distinct(list_concat(list_concat(CASE WHEN host <> '' THEN ['host=' || host] ELSE [] END, list_transform(regexp_extract_all(host, '[a-z]+'), lambda w: 'word=' || w)),
  list_transform(list_filter(string_split(lower(path), '/'), lambda x: x <> '' AND NOT regexp_matches(x, '[0-9]')), lambda x: 'path=' || x)))) AS t FROM h),
b AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
m AS (SELECT page_id, bad, t FROM k JOIN b ON doc_id = page_id WHERE len(t) > 0),
n AS (SELECT count(*) AS n, sum(bad) AS bad FROM m),
subsets AS (SELECT page_id, bad, array_to_string(list_filter(t, lambda x, i: (mask >> (i - 1)) & 1 = 1), ' ') AS s FROM (SELECT page_id, bad, t, unnest(range(1, 1 << len(t))) AS mask FROM m)),
good AS (SELECT s FROM subsets CROSS JOIN n GROUP BY s, n.n, n.bad HAVING sum(subsets.bad) >= ceil(greatest(0.002, 5.0 / n.n) * n.n) AND sum(subsets.bad) / count(*) >= 0.6 AND sum(subsets.bad) / count(*) / (n.bad / n.n) >= 2.0),
all_sets AS (SELECT page_id, array_to_string(list_filter(t, lambda x, i: (mask >> (i - 1)) & 1 = 1), ' ') AS s FROM (SELECT page_id, t, unnest(range(1, 1 << len(t))) AS mask FROM k)),
hit AS (SELECT DISTINCT page_id FROM all_sets SEMI JOIN good USING (s)),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN page_id IN (SELECT page_id FROM hit) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

_GRAMS = "".join(
    f""", g{n} AS (SELECT r, i, array_to_string(w[i - {n - 1}:i], ' ') AS g, array_to_string(w[i - {n - 1}:i - 1], ' ') AS u FROM p WHERE i >= {n}),
o{n} AS (SELECT r, g, count(*) AS n FROM g{n} GROUP BY ALL), x{n} AS (SELECT r, g, sum(n) OVER (PARTITION BY g) - n AS c FROM o{n})"""
    for n in (1, 2, 3)
)
OP8_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w){_GRAMS},
t AS (SELECT sum(len(w)) AS t FROM w),
s AS (SELECT g1.r, sum(CASE WHEN x3.c > 0 THEN ln(x3.c / u3.c) ELSE CASE WHEN g1.i >= 3 THEN ln(0.4) ELSE 0 END + CASE WHEN x2.c > 0 THEN ln(x2.c / u2.c)
    ELSE CASE WHEN g1.i >= 2 THEN ln(0.4) ELSE 0 END + CASE WHEN x1.c > 0 THEN ln(x1.c / (t - len(w.w))) ELSE -ln(t - len(w.w) + 1) END END END) AS s
  FROM g1 CROSS JOIN t JOIN w ON w.r = g1.r JOIN x1 ON x1.r = g1.r AND x1.g = g1.g
  LEFT JOIN g2 ON g2.r = g1.r AND g2.i = g1.i LEFT JOIN x2 ON x2.r = g2.r AND x2.g = g2.g LEFT JOIN x1 u2 ON u2.r = g2.r AND u2.g = g2.u
  LEFT JOIN g3 ON g3.r = g1.r AND g3.i = g1.i LEFT JOIN x3 ON x3.r = g3.r AND x3.g = g3.g LEFT JOIN x2 u3 ON u3.r = g3.r AND u3.g = g3.u GROUP BY g1.r)
SELECT doc_id, len(w) AS n_words, round(coalesce(s, 0), 4) AS score, CASE WHEN len(w) > 0 THEN round(s / len(w), 6) END AS mean_log FROM w LEFT JOIN s USING (r)
"""


#: Sources reach their caps in the order of size by weight; the level is that of the first prefix at which the next stays below its cap.
TARGETS_SQL = f"""
WITH s AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '{WORD}'))) AS size FROM documents GROUP BY 1),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY size / weight, source) AS k, 1.5 * sum(size::DOUBLE) OVER () AS total FROM w),
p AS (SELECT *, (total - 2 * coalesce(sum(size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
l AS (SELECT arg_min(level, k) AS level FROM p WHERE level * weight <= 2 * size)
SELECT source, size::BIGINT AS source_size, round(least(2.0 * size, weight * coalesce(l.level, 1e300))::DOUBLE, 6) AS target FROM p LEFT JOIN l ON true
"""


#: Checksums byte by byte from a table of 256, once for each distinct word; bytes are read from a word's hexadecimal form.
OP12_SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
x AS (SELECT r, unnest(w) AS w FROM d),
h AS (SELECT w, hex(w) AS h FROM (SELECT w FROM x UNION SELECT w FROM b)),
k AS (SELECT w, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: (16 * (strpos('0123456789ABCDEF', h[i]) - 1) + strpos('0123456789ABCDEF', h[i + 1]) - 1)::BIGINT), lambda c, y: xor(t[xor(c & 255, y) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS k FROM h, crc),
s AS (SELECT k, count(*) AS s FROM x JOIN k USING (w) GROUP BY k), t AS (SELECT k, count(*) AS t FROM b JOIN k USING (w) GROUP BY k),
g AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000) / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (k)),
v AS (SELECT r, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM x JOIN k USING (w) JOIN g USING (k) GROUP BY r),
f AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5e0) / 4294967296.0e0)))::BIGINT AS score FROM d LEFT JOIN v USING (r)),
o AS (SELECT doc_id, n, row_number() OVER (ORDER BY score DESC, doc_id) AS o, count(*) OVER () AS all_n FROM f WHERE n >= 20)
SELECT f.doc_id, f.n AS n_features, weight, score, CASE WHEN o <= all_n * 10 // 100 THEN o END AS rank FROM f LEFT JOIN o ON o.doc_id = f.doc_id
"""


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes and targets by source that op4 draws to."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    sizes = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("s")).agg(F.sum(words).alias("size"))
    return mixing.targets(sizes).select(F.col("s").alias("source"), "source_size", F.round("target", 6).alias("target"))


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_line_dedup": op2_line_dedup,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_mixing": op4_mixing,
        "op5_token_counts": op5_token_counts,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_quality": op7_quality,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_toxicity": op9_toxicity,
        "op10_url_filter": op10_url_filter,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_importance": op12_importance,
        "op13_personal_data": op13_personal_data,
        "mixing_targets": mixing_targets,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_jaccard_join": OP3_SQL,
        "op6_embedding_dedup": OP6_SQL,
        "op8_lm_scoring": OP8_SQL,
        "op10_url_filter": OP10_SQL,
        "op12_importance": OP12_SQL,
        "mixing_targets": TARGETS_SQL,
    }
