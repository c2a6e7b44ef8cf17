"""Cases of the corpus operators that a review of the third round found."""

import random

from pyspark.sql import functions as F

from quarrygraph.llm import lm_scoring, personal_data
from quarrygraph.llm.common import Stash


def test_scores_send_few_bytes_an_n_gram_and_none_that_stand_in_one_document(spark, monkeypatch):
    rng = random.Random(1)
    own = [(d, " ".join(f"w{rng.randrange(30_000)}" for _ in range(1_500))) for d in range(40)]  # hardly a pair stands in two of them
    docs = spark.createDataFrame([*own, (100, "a b c d"), (101, "x a b c")], "doc_id long, text string").repartition(2)
    stored = []
    put = Stash.put
    monkeypatch.setattr(Stash, "put", lambda self, df, *a: stored.append(put(self, df, *a)) or stored[-1])
    scores = lm_scoring.backoff_scores(docs, 3)
    assert scores.count() == 42
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the answers; texts stay where they are
    asked = {r["level"]: r["n"] for r in stored[0].union(stored[1]).groupBy("level").agg(F.sum("n").alias("n")).collect()}
    assert asked[2] > 50_000 and 1 <= asked[3] < 2_000
    held = Stash(spark).put_bucketed(lm_scoring.chunks(docs, 1_000_000), "chunk", 2)
    sent = held.mapInArrow(lm_scoring._first(2, 3), lm_scoring.SENT)
    size = sent.agg(F.sum(F.length("keys") + F.length("times")), F.sum("n")).first()
    assert size[0] <= 9 * size[1]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stash_")]


def test_all_labelled_candidates_train_and_calibrate(spark, monkeypatch):
    docs = [(d, f"call +1 (212) 555-{d % 9000 + 1000} or {300 + d % 600}.400.{d % 7}.2 now") for d in range(9_000)]
    fitted, graded = [], []

    class Watched(personal_data.GBTClassifier):
        def fit(self, df):
            fitted.append({(r["kind"], r["label"]): r["n"] for r in df.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n")).collect()})
            return super().fit(df)

    floors = personal_data._floors
    monkeypatch.setattr(personal_data, "GBTClassifier", Watched)
    monkeypatch.setattr(personal_data, "_floors", lambda df, *a: graded.append(df.groupBy("kind", "label").count().collect()) or floors(df, *a))
    assert personal_data.find(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).count() == len(docs)
    calibrated = {(r["kind"], r["label"]): r["count"] for r in graded[0]}
    for kind in ((3, 1), (1, 0)):  # more than a sample of 2,500 held, and each in one of both parts
        assert fitted[0][kind] > 2_500 and fitted[0][kind] + calibrated[kind] == len(docs)


def test_floors_equal_plain_sums(spark):
    rng = random.Random(5)
    rows = [(k, round(rng.random(), 2), int(rng.random() < 0.7)) for k in (0, 2, 3) for _ in range(3_000)] + [(2, 0.995, 1)] * 900 + [(3, 1.0, 0)]
    want = {}
    for k in (0, 2, 3):
        own = [(p, y) for kind, p, y in rows if kind == k]
        for floor in sorted({p for p, _ in own if p >= 0.5}):
            above = [y for p, y in own if p >= floor]
            if sum(above) >= 0.71 * len(above):
                want[k] = floor
                break
    frame = spark.createDataFrame(rows, "kind int, probability double, label int").repartition(4)
    assert dict(personal_data._floors(frame, 0.71, Stash(spark)).collect()) == want and want
