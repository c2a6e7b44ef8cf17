"""Operators on a small table of awkward rows, and against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrygraph.llm import decontaminate, embedding_dedup, jaccard_join, line_dedup, lm_scoring, mixing, quality, queries, token_counts, toxicity, url_filter

from ..oracle import check, connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
AWKWARD = [
    (1, "one two three four five six", "a"), (2, "one two three four five six", None), (3, None, "a"), (4, "", "b"), (5, " \n\t ", "b"), (6, "one", "c"), (7, "ONE", "c"),
    (8, LONG, "a"), (None, "one two three four five six", "a"), (9, "repeated row", "b"), (9, "repeated row", "b"), (10, "\x00 odd é \U0001f600 \x85 word", "c"),
]
SCHEMA = "doc_id long, text string, source string, component long, removed string, shard int, score string, token string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, 0, "x", 1, "y", "z") for r in AWKWARD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(name, spark, sf):
    check(spark, connect(sf), queries.queries()[name], queries.oracle_sql()[name], sf)


# --- similarity join ---


def shingle_set(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(docs, width, percent):
    sets = {d: shingle_set(t, width) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def family(n, size, edits, seed):
    """Variants of one text with so many words replaced."""
    rng = random.Random(seed)
    base = [f"v{seed}w{i}" for i in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(size), rng.randint(0, edits)):
            words[at] = f"e{rng.random()}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, width, percent, monkeypatch):
    texts = [t for k in range(4) for t in family(40, 60, 6, k)] + family(5, 3, 1, 77) + ["same"] * 3 + [None, "", "a b", "A b"]
    shared = " ".join(f"shared{i}" for i in range(30))
    texts += [shared + " " + " ".join(f"own{k}x{i}" for i in range(40)) for k in range(120)]
    docs = list(enumerate(texts))
    monkeypatch.setattr(jaccard_join, "GROUP", 16)
    monkeypatch.setattr(jaccard_join, "HOT_IN_CHUNK", 20)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, width, percent, tokens_per_bucket=3000).collect()}
    assert got == components(docs, width, percent)


def test_jaccard_join_on_awkward_rows(awkward, none):
    rows = jaccard_join.jaccard_components(awkward).collect()
    assert len(rows) == len(AWKWARD)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got[1] == (2, 1) and got[2] == (2, 1) and got[3] == (0, 3) and got[5] == (0, 5) and got[6] == (1, 6) and got[7] == (1, 6) and got[9] == (1, 9)
    assert got[None] == (2, None) and got[8][1] == 8
    assert jaccard_join.jaccard_components(none).count() == 0


# --- line dedup ---


def brute_lines(docs):
    """(start, end, first doc) of the lines that go, by one pass over all lines in rank order."""
    first, out = {}, {}
    for d, text in sorted(docs):
        gone, base = [], 0
        for line in text.split("\n"):
            words = WORD.findall(line)
            if words:
                earlier = first.setdefault(tuple(w.lower() for w in words), (d, base))
                start = base + line.index(words[0])
                if earlier != (d, base):
                    gone.append((start, base + line.rindex(words[-1]) + len(words[-1]), earlier[0]))
            base += len(line) + 1
        out[d] = gone
    return out


def test_line_dedup_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = line_dedup.dedup_lines(spark.read.parquet(f"{sf}/documents.parquet").repartition(3), spans=False).collect()
    want = brute_lines(docs)
    assert {r["doc_id"]: [(x["start"], x["end"], x["first_doc"]) for x in r["removed"]] for r in out} == want
    text = dict(docs)
    assert sum(map(len, want.values())) > 50
    for r in out:
        assert r["n_removed"] == len(r["removed"])
        whole, gone = text[r["doc_id"]], [(x["start"], x["end"]) for x in r["removed"]]
        if not gone:
            assert r["text"] == whole
        else:  # what stays is every other line, unchanged
            kept, base = [], 0
            for line in whole.split("\n"):
                if not any(base <= a and b <= base + len(line) for a, b in gone):
                    kept.append(line)
                base += len(line) + 1
            assert r["text"] == "\n".join(kept)


def test_short_lines_go_from_all_documents_but_the_first(spark):
    licence = "Licensed under terms that all of these documents repeat, word for word."
    docs = [(k, f"own words {k}\n  {licence.upper() if k % 2 else licence}\t\r\nmore of {k}") for k in range(50)]
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert rows[0]["text"] == docs[0][1] and rows[0]["n_removed"] == 0
    for k in range(1, 50):
        assert rows[k]["text"] == f"own words {k}\nmore of {k}"
        assert [(docs[k][1][x["start"] : x["end"]].lower(), x["first_doc"]) for x in rows[k]["removed"]] == [(licence.lower(), 0)]


def test_line_dedup_keeps_the_first_and_offsets(spark, awkward, none):
    passage = " ".join(f"p{i}" for i in range(60))
    split = "\n".join(" ".join(f"s{k}x{i}" for i in range(10)) for k in range(6))
    docs = [(3, f"x\n{passage.upper()}\n\nshort"), (1, f"{passage}\nshort"), (2, f"head\n\n{split}\ntail"), (4, split), (5, f"new  {passage}"), (6, passage), (6, passage), (7, "twice\nonce\n twice")]
    for spans in (False, True):
        rows = {}
        for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), spans=spans).collect():
            rows.setdefault(r["doc_id"], []).append(r)
        assert rows[1][0]["text"] == docs[1][1] and rows[3][0]["text"] == ("x" if spans else "x\n")
        assert [(x["start"], x["end"], x["first_doc"]) for x in rows[3][0]["removed"]] == ([(2, 9 + len(passage), 1)] if spans else [(2, 2 + len(passage), 1), (4 + len(passage), 9 + len(passage), 1)])
        assert rows[2][0]["n_removed"] == 0 and rows[4][0]["text"] == "" and rows[4][0]["n_removed"] == 6
        assert rows[5][0]["text"] == ("new" if spans else docs[4][1]) and [r["text"] for r in rows[6]] == ["", ""]
        assert rows[7][0]["text"] == "twice\nonce"
    out = line_dedup.dedup_lines(awkward, removed="gone", n_removed="n_gone")
    assert line_dedup.without_repeats(awkward).dtypes == awkward.dtypes and {r["n_passages"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).filter("doc_id in (3, 4, 5)").collect()} == {1}
    assert out.count() == len(AWKWARD) and out.columns == [*awkward.columns, "gone", "n_gone", "n_passages"] and {r["removed"] for r in out.collect()} == {"x"}
    assert out.filter("text is null").count() == 1 and line_dedup.dedup_lines(none).count() == 0
    assert dict(line_dedup.dedup_lines(awkward).dtypes)["removed"].startswith("array")


def test_spans_are_found_whatever_surrounds_them(spark):
    rng = random.Random(6)
    words = lambda n: [f"é{rng.randrange(10**6)}" + rng.choice(["", "", ".", ","]) for _ in range(n)]
    passages = [words(55) for _ in range(30)]
    docs = [(k, " ".join([*words(20 + k), *p, *words(9)])) for k, p in enumerate(passages)]
    for k, p in enumerate(passages):
        docs.append((100 + k, " ".join(words(7)) + "\n" + " ".join([*words(30 - k), *p[:20]]).upper() + "\n" + " ".join([*p[20:], *words(11)])))
    docs += [(None, docs[0][1]), (200, " ".join(["so"] * 49)), (201, " ".join(["so"] * 49)), (202, None), (203, "la " * 200)]
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    text = dict(docs)
    for k, p in enumerate(passages):
        r, before = rows[100 + k], text[100 + k].split()
        assert rows[k]["text"] == text[k] and [x["first_doc"] for x in r["removed"]] == [k]
        assert text[100 + k][r["removed"][0]["start"] : r["removed"][0]["end"]].lower().split() == p
        assert r["text"].split() == before[: 7 + 30 - k] + before[-11:]
    assert len(rows) == len(docs) and rows[None]["text"] == "" and rows[202]["text"] is None and rows[200]["text"] == text[200]


# --- decontamination ---


def edit_distance(pattern, text):
    """Least distance of the pattern to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        previous, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(previous[j] + 1, row[j - 1] + 1, previous[j - 1] + (p != t)))
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(3)
    for _ in range(200):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 70)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 90)))
        masks = {}
        for i, c in enumerate(p):
            masks[c] = masks.get(c, 0) | 1 << i
        assert decontaminate.myers(masks, len(p), t)[0] == edit_distance(p, t)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("th", "on", "er", "in", "at") for b in ("ea", "st", "nd", "ly", "ou")]
    items = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(12)] + [(97, "What is two plus two?"), (98, "short"), (99, None), (100, "?!")]
    docs = []
    for d in range(60):
        text = [rng.choice(words) for _ in range(40)]
        if d % 3 == 0:
            body = list(items[d % 12][1])
            for _ in range(d % 13):
                body[rng.randrange(len(body))] = rng.choice("abcxyz")
            text.insert(rng.randrange(40), "".join(body).upper() if d % 2 else "".join(body) + ".")
        docs.append((d, " ".join(text)))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, "Q: what is TWO plus two. A: four"), (103, "somewhat is two plus twofold, shorter")]
    norm = lambda t: re.sub("[^a-z0-9]+", " ", (t or "").lower()).strip()
    want = set()
    for d, t in docs:
        for i, s in items:
            p = norm(s)
            if 0 < len(p) < decontaminate.MIN_ITEM:
                if f" {p} " in f" {norm(t)} ":
                    want.add((d, i, 0))
            elif p:
                budget = max(0, min(int(decontaminate.MAX_ERROR * len(p)), len(p) // decontaminate.MIN_PIECE - 1))
                dist = edit_distance(p, norm(t))
                if dist <= budget:
                    want.add((d, i, dist))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.leaks(df, bench).collect()}
    assert got == want and len(want) > 10 and (102, 97, 0) in want and not any(d == 103 for d, _, _ in want)
    long = spark.createDataFrame([(104, "x" * 70_000 + " short " + "y" * 600_000)], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df.union(long), bench).filter("short").collect()} >= {(102, 97), (104, 98)}
    left = {r["doc_id"] for r in decontaminate.without_leaks(df, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _, _ in want}


def test_leaks_on_awkward_rows(spark, awkward, none):
    bench = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six")], "item_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in decontaminate.leaks(awkward, bench).collect()) == [0, 0, 1, 1, 2, 2]
    assert decontaminate.without_leaks(awkward, bench).columns == awkward.columns
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.without_leaks(awkward, bench.limit(0)).count() == len(AWKWARD)


# --- mixing ---


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """By bisection of the level up to which targets fill."""
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 10.0 * (1 + sum(sizes.values()))
    for _ in range(200):
        level = (low + high) / 2
        full = sum(min(cap * sizes[s], level * weight[s]) for s in order)
        low, high = (level, high) if full < share * sum(sizes.values()) else (low, level)
    return {s: min(cap * sizes[s], high * weight[s]) for s in order}


def test_targets_equal_brute_force(spark):
    rng = random.Random(4)
    for sizes in ({"a": 100, "b": 1000, "c": 10, None: 500}, {}, {"a": 0}, {f"s{i:04d}": int(10 ** rng.uniform(0, 5)) for i in range(700)}):
        df = spark.createDataFrame(list(sizes.items()), "s string, size long")
        got = {r["s"]: r["target"] for r in mixing.targets(df).collect()}
        assert got == pytest.approx(brute_targets(sizes), rel=1e-9)


def test_splitting_tree_keeps_quotas():
    quotas = np.array([1000, 7, 0, 333])
    totals = np.array([191, 191, 191, 191, 192, 192, 192])
    dealt = mixing.splitting_tree(quotas, totals, np.random.default_rng(1))
    assert (dealt.sum(axis=1) == quotas).all() and (dealt.sum(axis=0) == totals).all()


def check_mixture(rows, documents):
    sizes, taken, target, largest = collections.Counter(), collections.Counter(), {}, collections.Counter()
    for s, text in documents:
        n = len(WORD.findall(text or ""))
        sizes[s] += n
        largest[s] = max(largest[s], n)
    for r in rows:
        assert 0 <= r["taken"] == r["size"] * r["copies"] <= 2 * max(1, r["size"]) and len(r["shards"]) == r["copies"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert target == pytest.approx(brute_targets(sizes))
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in target)


def test_mixture_meets_its_targets(spark, sf, awkward, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mixture(docs, words_per_shard=5000).collect()
    check_mixture(rows, [(r["source"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixture(docs.repartition(5), words_per_shard=5000).collect()))
    want = sorted((r["doc_id"], k, shard) for r in rows for k, shard in enumerate(r["shards"]))
    assert sorted((r["doc_id"], r["copy"], r["shard"]) for r in mixing.mix(docs, words_per_shard=5000).select("doc_id", "copy", "shard").collect()) == want
    assert mixing.mixture(awkward).count() == len(AWKWARD) and mixing.mixture(none).count() == 0 and mixing.mix(none).count() == 0
    assert mixing.mix(awkward).columns == [*[c for c in awkward.columns if c != "shard"], "copy", "shard", "shuffle_key"]


def test_mixture_takes_repeated_rows_one_by_one(spark):
    same = [(7, "one two three four five six seven eight nine ten", "a")] * 100
    for docs in (same, same + [(k, "w " * (k + 1), "b") for k in range(40)] + [(None, "x y", None)] * 9):
        df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
        rows = mixing.mixture(df).collect()
        assert len(rows) == len(docs)
        check_mixture(rows, [(s, t) for _, t, s in docs])
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mixture(df.repartition(2)).collect()))
        assert mixing.mix(df).count() == sum(r["copies"] for r in rows)


def test_shards_are_even_and_sources_many(spark):
    rng = random.Random(5)
    docs = [(k, "w " * rng.randint(1, 60), f"s{k % 700}" if k % 3 else "hot") for k in range(12_000)]
    rows = mixing.mixture(spark.createDataFrame(docs, "doc_id long, text string, source string"), words_per_shard=20_000).collect()
    check_mixture(rows, [(s, t) for _, t, s in docs])
    words = collections.Counter()
    for r in rows:
        for shard in r["shards"]:
            words[shard] += r["size"]
    assert len(words) > 20 and max(words.values()) < 1.35 * min(words.values())


# --- token counts ---


def test_token_counts_equal_the_library(spark, sf, awkward, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(1)
    odd = ["<|endoftext|>", "a <|endoftext|>  b", "  x  ", "'s 'll don't", "日本語 テスト  ١٢٣ ½", "\u2003\u00a0 x\u0085y", "a" * 5000]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), rng.randrange(0x3000)])) for _ in range(40)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").union(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id") + 10_000, "text")).union(awkward.select("doc_id", "text"))
    held = collections.Counter((r["doc_id"], len((r["text"] or "").encode()), len(tok.encode(r["text"] or "", add_special_tokens=False))) for r in docs.collect())
    rows = token_counts.count_tokens(docs, path).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == held
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)
    assert token_counts.count_tokens(none, path).count() == 0


# --- embeddings ---


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, threshold=0.98):
    first = {}
    for i, v, l in rows:
        if l is not None and v and None not in v and np.isfinite(v).all() and any(v):
            first.setdefault(i, (l, np.array(v, dtype=np.float32).astype(float)))
    n, root = collections.Counter(), {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    ids = sorted(first)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            (la, x), (lb, y) = first[a], first[b]
            if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                n[a] += 1
                n[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (n[i], find(i)) for i, _, _ in rows}


def test_embedding_dedup_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for label in range(3):
        for _ in range(12):
            centre = rng.standard_normal(16)
            for _ in range(int(rng.integers(1, 9))):
                rows.append((i, (centre + 0.05 * rng.standard_normal(16)).tolist(), label))
                i += 1
    centre = rng.standard_normal(16)
    rows += [(i + k, (centre + 0.03 * rng.standard_normal(16)).tolist(), 1) for k in range(90)]  # more than a window holds
    monkeypatch.setattr(embedding_dedup, "GROUP", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(vectors(spark, rows), window=10, passes=20).collect()}
    assert got == brute(rows)


def test_embedding_dedup_counts_all_links_of_a_borderline_crowd(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(64)
    centre *= 8 / np.linalg.norm(centre)
    points = (centre + 0.16 * rng.standard_normal((2500, 64))).astype(np.float32)
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & ~np.eye(len(unit), dtype=bool)
    assert 0.05 < linked.mean() < 0.3 and len(points) > 2 * embedding_dedup.WINDOW * embedding_dedup.PASSES
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(points)])).collect()}
    assert [got[i] for i in range(len(points))] == linked.sum(axis=1).tolist()


def test_embedding_dedup_on_awkward_rows(spark):
    v = [1.0, 2.0]
    rows = [(1, v, 0), (2, v, 0), (3, v, 1), (4, None, 0), (5, [], 0), (6, [0.0, 0.0], 0), (7, [1.0, None], 0), (8, [float("nan"), 1.0], 0), (9, [float("inf"), 1.0], 0), (10, v, None), (11, [1.0, 2.0, 3.0], 0), (12, v, 0), (12, v, 0), (13, [1e-30, 2e-30], 0)]
    out = embedding_dedup.near_duplicates(vectors(spark, rows))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[12][:2] == (3, 1) and got[13][:2] == (3, 1)
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0


# --- language model ---


def brute_scores(docs, order):
    """Word by word, from counts of tuples."""
    texts = [[w for w in WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] for _, t in docs]
    grams = lambda w: collections.Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    all_counts = collections.Counter()
    for w in texts:
        all_counts.update(grams(w))
    total, out = sum(map(len, texts)), []
    for (d, _), w in zip(docs, texts, strict=True):
        own, s = grams(w), 0.0
        for i in range(len(w)):
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                c = all_counts[g] - own[g]
                if n == 1:
                    s += math.log(c / (total - len(w))) if c else -math.log(total - len(w) + 1)
                elif c:
                    s += math.log(c / (all_counts[g[:-1]] - own[g[:-1]]))
                    break
                else:
                    s += math.log(0.4)
        out.append((d, len(w), s))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_scores_equal_brute_force(spark, order, awkward, none, monkeypatch):
    monkeypatch.setattr(lm_scoring, "WORDS_PER_CHUNK", 2_000)
    rng = random.Random(order)
    texts = [" ".join(rng.choice("the a cat dog sat ran on mat and then".split()) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    docs = [*enumerate(texts), (7, texts[7]), (None, texts[8]), (None, None), *[(1000 + k, texts[9].upper()) for k in range(40)], (1 << 60, texts[9]), *[(r[0], r[1]) for r in AWKWARD if r[0] != 8], (8, " ".join(f"w{i % 97}" for i in range(5_000)))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2], 5))
    got = sorted(((r["doc_id"], r["n_words"], r["score"]) for r in lm_scoring.backoff_scores(df, order).collect()), key=key)
    for a, b in zip(got, sorted(brute_scores(docs, order), key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9, abs=1e-7)
    if order == 2:
        assert lm_scoring.backoff_scores(none).count() == 0 and lm_scoring.backoff_scores(awkward).count() == len(AWKWARD)
        assert lm_scoring.backoff_scores(spark.createDataFrame([(1, "a b c")] * 2, "doc_id long, text string")).count() == 2


# --- toxicity ---


def test_automaton_equals_edit_distance():
    rng = random.Random(9)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randint(3, 9))): rng.randint(0, 2) for _ in range(12)}
    machine = toxicity.Automaton(terms)

    for _ in range(2000):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 10)))
        best = min(((distance(word, t), t) for t, e in terms.items() if distance(word, t) <= e), default=None)
        assert machine.match(word) == (best and best[::-1])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(previous[j] + 1, row[j - 1] + 1, previous[j - 1] + (x != y)))
    return row[-1]


def test_quotation_marks_are_paired():
    assert toxicity.quoted("he said “ you idiot ” yesterday".split(), 4) and toxicity.quoted('the word "idiot" means'.split(), 2)
    assert not toxicity.quoted("you idiot".split(), 1) and not toxicity.quoted('a "quoted" thing, you idiot'.split(), 4) and not toxicity.quoted('you idiot "yes"'.split(), 1)


def brute_toxicity(text, model):
    """The score of one text, words cut and compared one by one with every term."""
    w = WORD.findall(text or "")
    if not model.coefficients:
        return 0.0
    x, found = [0.0] * toxicity.FEATURES, 0
    for i, raw in enumerate(w):
        word = raw.lower().strip(toxicity.EDGE)
        near = min(((distance(word, t), t) for t, e in model.terms.items() if distance(word, t) <= e), default=None)
        if near is None:
            continue
        low = max(0, i - toxicity.WINDOW)
        window = w[low : i + toxicity.WINDOW + 1]
        weight, found = model.weights[near[1]], found + 1
        x[(near[0] > 0) + 2 * toxicity.quoted(window, i - low)] += weight
        x[4] = max(x[4], weight / (1 + near[0]))
        x[5] += sum(model.cues.get(c, 0.0) for c in {v.lower().strip(toxicity.EDGE) for k, v in enumerate(window) if k != i - low} - {""})
    x = [math.log1p(v) for v in x[:4]] + [x[4], x[5] / max(1, found)]
    return 1 / (1 + math.exp(-(model.coefficients[0] + sum(a * b for a, b in zip(model.coefficients[1:], x, strict=True)))))


@pytest.mark.parametrize("joint", [" ", "\u00a0", "\u0085"])
def test_toxicity_equals_brute_force_and_cuts_words_alike(spark, joint):
    rng = random.Random(12)
    plain = [f"{a}{b}{c}" for a in ("mor", "tal", "ven", "sul") for b in ("an", "ir", "ob") for c in ("da", "ke", "", "st")]
    bad = ["blargface", "snotbucket", "grumplord"]
    docs, labels = [], []
    for d in range(200):
        words = [rng.choice(plain) for _ in range(30)]
        if d % 2:
            term = rng.choice(bad)
            words[7] = term if d % 3 else term.replace("o", "0", 1)
        elif d == 50:
            words[6:9] = ["said", f'"{rng.choice(bad)}"', "calmly"]
        docs.append((d, joint.join(words[:20]) + " " + " ".join(words[20:])))
        labels.append((d, d % 2))
    docs += [(1000, None), (1001, ""), (1001, ""), (None, docs[1][1]), (1002, " ".join(plain * 3000) + " blargfacee")]
    df, lf = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df, lf)
    rows = toxicity.score(df, model).collect()
    got = collections.Counter((r["doc_id"], round(r["score"], 9)) for r in rows)
    assert got == collections.Counter((d, round(brute_toxicity(t if d != 1002 else t[-200:], model), 9)) for d, t in docs)
    if joint == " ":
        assert len({"blargface", "grumplord", "snotbucket"} & set(model.terms)) >= 2
    wrong = [r["doc_id"] for r in rows if r["doc_id"] is not None and r["doc_id"] < 200 and r["predicted"] != r["doc_id"] % 2]
    assert len(wrong) <= (4 if joint == " " else 100)
    clean = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 200 and r["doc_id"] % 2 == 0]
    assert sum(r["predicted"] for r in clean) <= 4


def test_automaton_forgets_states_without_changing_answers(monkeypatch):
    rng = random.Random(2)
    terms = {"".join(rng.choice("abc") for _ in range(6)): 2 for _ in range(20)}
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(500)]
    want = [toxicity.Automaton(terms).match(w) for w in words]
    monkeypatch.setattr(toxicity, "KNOWN_STATES", 5)
    machine = toxicity.Automaton(terms)
    assert [machine.match(w) for w in words] == want and len(machine.states) < 100


def test_toxicity_on_held_out_rows(spark, awkward, none):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).join(labels.withColumnRenamed("doc_id", "l"), F.col("doc_id") == F.col("l"), "left").collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
    test = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    assert sum(r["predicted"] == r["toxic"] for r in test) / len(test) > 0.88
    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(docs, other).coefficients == pytest.approx(model.coefficients)  # held-out labels are never read
    assert toxicity.score(awkward, model).count() == len(AWKWARD) and toxicity.score(none, model).count() == 0
    assert toxicity.without_toxic(awkward, model).columns == awkward.columns
    assert {r["score"] for r in toxicity.score(awkward, toxicity.train(awkward, labels.limit(0))).collect()} == {0.0}
    twice = toxicity.train(docs.union(docs), labels.union(labels))  # rows given twice train twice, with the same words
    assert set(twice.terms) >= set(model.terms) and toxicity.score(docs.union(docs), model).count() == 2000


# --- quality ---


def test_quality_on_held_out_rows(spark, awkward, none):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).join(labels.withColumnRenamed("doc_id", "l"), F.col("doc_id") == F.col("l")).filter("held_out").collect()
    assert sum(r["grade"] == r["quality"] for r in rows) / len(rows) > 0.93
    assert quality.score(awkward, model).count() == len(AWKWARD) and quality.score(none, model).count() == 0
    assert {r["selected"] for r in quality.score(awkward, quality.train(awkward, labels.limit(0))).collect()} == {False}
    assert {r["grade"] for r in quality.score(awkward, quality.train(docs, labels.withColumn("quality", F.lit(2)))).collect()} == {2}


def test_thresholds_stay_in_order():
    rng = np.random.default_rng(2)
    x = [(np.array([0, 1 + int(g)]), np.array([1.0, 1.0])) for g in rng.integers(0, 4, 400)]
    y = np.array([i[1] - 1 for i, _ in x])
    w, cuts = quality.fit(x, y, 4)
    score = np.array([w[i] @ v for i, v in x])
    assert (np.diff(cuts) > 0).all() and np.mean((score[:, None] > cuts[None, :]).sum(axis=1) == y) > 0.95


# --- url filters ---


def test_rules_and_hosts(spark):
    urls = [
        "https://a.example.com/en/5", "http://B.Example.COM/en/71?x", "https://example.net/de/80", "https://example.net/de/1#f", "http://org/es/", "http://forg/es/", "no scheme", None, "https://example.com?x", "x://", "https://com.evil/en/",
    ]
    pages = spark.createDataFrame([(i, u, "extra") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, labels).collect()}
    assert got[0] == ("a.example.com", "/en/5", "com/en/", "block") and got[1] == ("b.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[2][2:] == ("example.net/de/8", "block") and got[3] == ("example.net", "/de/1", "net/de/", "allow") and got[4][2:] == ("org/es/", "block")
    assert got[5][2:] == (None, "allow") and got[6] == ("", "", None, "allow") == got[7] and got[8] == ("example.com", "", None, "allow") and got[10][2] is None
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(6)
    hosts = ["bad.example.com", "good.example.com", "mixed.example.net", "www.bad.example.org"]
    pages = [(i, f"https://{rng.choice(hosts)}/{rng.choice(['en', 'fr'])}/{i}") for i in range(400)]
    labels = [(i, 0 if "bad" in u or ("mixed" in u and "/fr/" in u) else 1, 0) for i, u in pages]
    df = spark.createDataFrame(pages, "page_id long, url string")
    got = {r["page_id"]: r["mined"] is not None for r in url_filter.judge(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rules=(), min_lift=1.1, min_confidence=0.95).collect()}
    assert got == {i: q == 0 for i, q, _ in labels}
