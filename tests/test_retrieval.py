"""Word search by position, names alike by prefix filters, and the guard that walks a query's tree."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarrygraph.functions import expressions as X
from quarrygraph.operators import anchor, fulltext, guard, search, similar


def brute_covers(words, terms):
    """All windows from a term to a term that hold every term and within which none smaller does."""
    places = [i for i, w in enumerate(words) if w in terms]
    full = [(a, b) for a in places for b in places if a <= b and set(terms) <= set(words[a : b + 1])]
    return {(a, b, sum(a <= i <= b for i in places)) for a, b in full if not any((c, d) != (a, b) and a <= c and d <= b for c, d in full)}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    docs = [(d, [rng.choice(["red", "blue", "green", "xx", "yy", "zz", "the"]) for _ in range(rng.randrange(30))]) for d in range(80)]
    return docs, spark.createDataFrame([(d, ", ".join(w).upper()) for d, w in docs] + [(100, None), (101, ""), (102, "the and of")], "d int, text string").repartition(3)


@pytest.mark.parametrize("terms", [["red"], ["red", "blue"], ["green", "red", "blue", "the"]])
def test_covers_equal_brute_force(corpus, terms):
    docs, frame = corpus
    index = fulltext.inverted(frame, "d")
    got = {(r["id"], r["start"], r["end"], r["met"]) for r in fulltext.covers(index, terms).collect()}
    asked = [t for t in terms if t != "the"]
    want = {(d, *c) for d, w in docs for c in brute_covers(w, asked)}
    assert got == want and len(want) > 50
    scores = {r["id"]: r["score"] for r in fulltext.cover_ranks(index, terms, every=True).collect()}
    for d, w in docs:
        total = sum(0.1 / (1 + b - a + 1 - met) for a, b, met in brute_covers(w, asked))
        assert scores.get(d, 0) == pytest.approx(total)


def test_any_word_counts_its_places_and_ties_go_by_id(corpus):
    docs, frame = corpus
    best = search.by_words(frame, ["reds", "the", "blue"], 7, "d").orderBy("rank").collect()
    want = sorted(((d, 0.1 * sum(x in ("red", "blue") for x in w)) for d, w in docs), key=lambda r: (-r[1], r[0]))[:7]
    assert [(r["d"], r["rank"]) for r in best] == [(d, i + 1) for i, (d, _) in enumerate(want)] and [r["hits"] for r in best] == pytest.approx([s for _, s in want])
    assert search.by_words(frame, ["the", "nowhere"], 7, "d").count() == 0 and search.by_words(frame, [], 7, "d").count() == 0


def test_words_that_stand_together_rank_higher(spark):
    docs = spark.createDataFrame([(1, "purchase x x x x order"), (2, "the purchase order"), (3, "purchase only"), (4, "orders of a purchase")], "d int, text string")
    ranked = fulltext.top(fulltext.inverted(docs, "d"), ["purchase", "order"], 5, every=True).orderBy("rank").collect()
    assert [r["id"] for r in ranked] == [2, 4, 1] and ranked[0]["score"] == pytest.approx(0.1)


def test_a_stored_index_reads_the_terms_of_the_question(spark, corpus, tmp_path):
    docs, frame = corpus
    index = fulltext.inverted(frame, "d")
    fulltext.store(index, str(tmp_path / "index"))
    held = fulltext.load(spark, str(tmp_path / "index"), ["reds", "blue"])
    assert {r["term"] for r in held.select("term").distinct().collect()} == {"red", "blue"}
    of = lambda i: dict(map(tuple, fulltext.cover_ranks(i, ["red", "blue"], every=True).collect()))
    assert of(held) == pytest.approx(of(index))
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


# --- names alike ---


def grams(name):
    return {g for w in re.findall("[a-z0-9]+", name.lower()) for p in [f"  {w} "] for g in (p[i : i + 3] for i in range(len(p) - 2))}


def brute_similar(left, right, floor):
    out = set()
    for a in set(left) - {None}:
        for b in set(right) - {None}:
            x, y = grams(a), grams(b)
            if x and y and len(x & y) / len(x | y) >= floor:
                out.add((a, b))
    return out


@pytest.mark.parametrize("floor", [0.2, 0.3, 0.6, 1.0])
def test_similar_names_equal_brute_force(spark, floor):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6)))
    left = [" ".join(word() for _ in range(rng.randrange(4))) for _ in range(120)] + [None, "", "!", "same", "same"]
    right = [" ".join(word() for _ in range(rng.randrange(4))) for _ in range(120)] + [None, "Same", "é"]
    got = similar.similar_names(spark.createDataFrame([(x,) for x in left], "l string"), "l", spark.createDataFrame([(x,) for x in right], "r string"), "r", floor).collect()
    assert {(r["a"], r["b"]) for r in got} == brute_similar(left, right, floor) and len(got) == len({(r["a"], r["b"]) for r in got})
    with pytest.raises(ValueError, match="similarity"):
        similar.candidates(spark.range(1).selectExpr("'a' as l"), "l", spark.range(1).selectExpr("'a' as r"), "r", 0)


def test_a_trigram_in_all_names_brings_no_pairs(spark):
    left = spark.range(400).select(F.concat(F.lit("part "), F.substring(F.md5(F.concat(F.lit("l"), "id")), 1, 12)).alias("l"))
    right = spark.range(400).select(F.concat(F.lit("part "), F.substring(F.md5(F.concat(F.lit("r"), "id")), 1, 12)).alias("r"))
    met = similar.candidates(left, "l", right.union(left.limit(50).select(F.col("l").alias("r"))), "r", 0.5)
    assert 50 <= met.count() < 2000  # of 180,000 pairs that share "par"


def test_tokens_meet_names_through_the_anchor(spark):
    entities = spark.createDataFrame([("a", "SYMBOL", "trade_bids", None), ("b", "SYMBOL", "orders", None)], "id string, kind string, name string, path string")
    tokens = spark.createDataFrame([(1, "trade_bid", 3.0), (2, "moon", 1.0)], "item_id int, token string, weight double")
    got = anchor.similar_hits(tokens, entities).select("item_id", "id", "score").collect()
    assert [(r["item_id"], r["id"]) for r in got] == [(1, "a")]
    asked = spark.createDataFrame([(1, "What does this method call?"), (2, "Show me the /bids route of Trade#create")], "item_id int, text string")
    assert [(r["item_id"], r["token"]) for r in anchor.identifiers(asked).orderBy(F.desc("weight")).collect()] == [(2, "Trade#create"), (2, "/bids")]
    assert X.trigrams("x") is not None


# --- guarded SQL ---

FORTY = ", ".join(map(str, range(40)))


@pytest.mark.parametrize(
    "text",
    [
        f"SELECT {FORTY}, java_method('java.lang.System', 'currentTimeMillis') FROM edges", f"SELECT {FORTY}, (SELECT max(reflect('a', 'b')) FROM edges) FROM edges", "SELECT * FROM edges WHERE n IN (SELECT n FROM secret)",
        "SELECT * FROM edges WHERE EXISTS (SELECT 1 FROM edges LATERAL VIEW explode(array(1)) x AS y WHERE y = Java_Method('a', 'b'))", "SELECT * FROM parquet.`/etc/x`", "SELECT * FROM range(10)", "SELECT * FROM read_files('x')",
        "WITH a AS (SELECT * FROM hidden) SELECT 1 FROM edges", "SELECT transform(n) USING 'cat' AS (x) FROM edges", "SELECT * FROM identifier('sec' || 'ret')", "SELECT identifier('n') FROM edges", "TABLE secret", "VALUES (java_method('a', 'b'))",
        "SELECT * FROM edges, LATERAL (SELECT * FROM zed)", "SELECT n FROM edges ORDER BY try_reflect('a', 'b')", "SELECT sum(n) OVER (PARTITION BY java_method('a', 'b')) FROM edges", "SELECT count(*) FILTER (WHERE java_method('a', 'b') = 'x') FROM edges",
        "SELECT n FROM edges GROUP BY n HAVING max(java_method('a', 'b')) = 'x'", "FROM edges |> WHERE n IN (SELECT x FROM secret)", "SELECT 1 UNION ALL SELECT n FROM db.edges",
    ],
)
def test_the_guard_refuses_wherever_it_stands(spark, text):
    with pytest.raises(ValueError, match="refused"):
        guard.read_only(spark, text, {"edges": spark.range(1)})


def test_the_guard_takes_harmless_queries(spark):
    t = spark.range(500).withColumnRenamed("id", "n")
    run = lambda text: guard.run_sql(spark, text, {"edges": t})
    assert run("SELECT n FROM EDGES WHERE n = 3").first()["n"] == 3
    assert run("SELECT 'reflect' = 'x' AS same, `n` FROM Edges ORDER BY n DESC").first().asDict() == {"same": False, "n": 499}
    many = ", ".join(f"c{i} AS (SELECT {i} AS v)" for i in range(40))
    assert [r["v"] for r in run(f"WITH {many} SELECT * FROM c0 UNION ALL SELECT * FROM C39").collect()] == [0, 39]
    assert run("-- first\nSELECT max(n) AS m /* java_method('a') */ FROM edges;").first()["m"] == 499
    assert run("SELECT count(*) AS c FROM edges WHERE n BETWEEN 1 AND 5 AND n NOT IN (2) AND extract(year FROM current_date) > 2000").first()["c"] == 4
    assert len(run(f"SELECT {FORTY} FROM edges").columns) == 40


def test_a_callers_views_stay(spark):
    spark.range(3).createOrReplaceTempView("edges")
    assert guard.run_sql(spark, "SELECT count(*) AS n FROM edges", {"edges": spark.range(7)}).first()["n"] == 7
    assert spark.table("edges").count() == 3
    spark.catalog.dropTempView("edges")
    assert not any(t.name.startswith("asked_") for t in spark.catalog.listTables())
