import re


import corpus_pipeline
from pyspark.sql import functions as F
from quarrygraph.llm import toxicity

from .test_hygiene import WORD, brute_targets, components, edit_distance


def test_stages_act_on_all_their_predecessor_kept(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], sf).write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
        if name != "mixing":
            assert frames[-1].columns == columns
    ids = [{r["doc_id"]: r["text"] for r in f.select("doc_id", "text").collect()} for f in frames]
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(ids[1]) == {r["doc_id"] for r in toxicity.score(docs, model).filter("predicted = 0").collect()}
    groups = components(sorted(ids[1].items()), 5, 80)
    assert set(ids[2]) == {d for d, (n, c) in groups.items() if c == d}
    long_lines = [line.lower().split() for t in ids[3].values() for line in (t or "").split("\n")]
    long_lines = [tuple(line) for line in long_lines if len(line) >= 25]
    assert len(long_lines) == len(set(long_lines))
    norm = lambda t: re.sub("[^a-z0-9à-ÿß]+", " ", (t or "").lower()).strip()
    bench = [norm(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(ids[4]) <= set(ids[3]) and not any(b in norm(t) for b in bench for t in ids[4].values())
    gone = set(ids[3]) - set(ids[4])
    assert all(any(b in norm(ids[3][d]) or edit_distance(b, norm(ids[3][d])) <= 0.06 * len(b) + 2 for b in bench) for d in list(gone)[:3])
    sizes, largest = {}, {}
    for r in frames[4].collect():
        n = len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        largest[r["source"]] = max(n, largest.get(r["source"], 0))
    taken = {}
    for r in frames[5].collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    for s, t in brute_targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= largest[s] / 2 + 1
    key = lambda f: sorted((r["doc_id"], r["copy"], r["shard"], r["text"]) for r in f.select("doc_id", "copy", "shard", "text").collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(frames[5])


def test_stages_take_awkward_rows(spark, sf):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "a b c", None, None, 5), (2, "a b c", None, None, 5), (3, "a b c", "en", "a", 5)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    for frame in (docs, docs.limit(0)):
        kept = frame
        for _, stage in corpus_pipeline.STAGES[:4]:
            kept = stage(spark, kept, sf)
        ids = sorted((r["doc_id"] or 0) for r in kept.collect())
        assert ids == ([0, 1, 2, 2] if frame is docs else [])
        mixed = corpus_pipeline.mix_sources(spark, frame, sf).collect()
        assert {(r["doc_id"], r["text"]) for r in mixed} <= {(r[0], r[1]) for r in rows} and len(mixed) == len({(r["doc_id"], r["copy"], r["shuffle_key"]) for r in mixed})


def test_stages_keep_columns_of_their_own_names_and_long_texts(spark, sf):
    long = " ".join(f"w{i % 991}x{i}" for i in range(60_000))
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(1, long, "a", "kept", 7, 1.5), (2, f"{passage}\nown words", "a", "kept", 8, 2.5), (3, f"start {passage} of another text altogether, which has words of its own: " + " ".join(f"own{i}" for i in range(90)), "b", "kept", 9, 3.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, removed string, n_removed int, score double")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, sf)
        assert kept.dtypes == docs.dtypes
    got = {r["doc_id"]: r for r in kept.collect()}
    assert got[1]["text"] == long and got[2]["text"] == rows[1][1] and passage not in got[3]["text"] and {(r["removed"], r["n_removed"], r["score"]) for r in got.values()} == {r[3:] for r in rows}
    mixed = corpus_pipeline.mix_sources(spark, kept.withColumn("shard", F.lit("x")), sf)
    assert {"removed", "n_removed", "score", "copy", "shard", "shuffle_key"} <= set(mixed.columns) and mixed.count() > 0


def test_pipeline_is_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and len(corpus_pipeline.STAGES) == 5
    assert [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
