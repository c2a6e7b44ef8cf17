"""Importance resampling, personal data and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quarrygraph.llm import embedding_dedup, importance, line_dedup, periodic_runs, personal_data, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
SCHEMA = "doc_id long, text string, n_words long, runs string, weight string, spans string, row string, base int"
ODD = [
    (1, "one two three four five six"), (2, None), (3, ""), (4, " \n\t "), (5, "one"), (6, LONG), (None, "a b " * 9), (7, "same row same row same row same row"), (7, "same row same row same row same row"),
    (8, "\x00 odd é \U0001f600 \x85 word \U0001f600 mail a.b@c.de"), (9, "x" * 300_000), (10, "1" * 200_000), (11, "la " * 50_000), (12, "\n" * 1000 + "end"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, "x", "y", "z", "r", 1) for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- periodic runs ---


def brute_runs(words, least=6, exponent=4):
    out = []
    n = len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(least, exponent * q) and not any(all(words[k] == words[k + d] for k in range(start, start + length - d)) for d in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapse(words, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize(("least", "exponent"), [(6, 2), (6, 3), (6, 4), (9, 2), (12, 5)])
def test_runs_of_random_sequences(least, exponent):
    rng = random.Random(least * exponent)
    for _ in range(150):
        words = [rng.randrange(rng.choice((1, 2, 3))) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            p, at = rng.randrange(1, 9), rng.randrange(len(words) + 1)
            part = [rng.randrange(3) for _ in range(p)]
            words[at:at] = (part * 9)[: rng.randrange(p, 9 * p)]
        assert periodic_runs.runs_of(words, least, exponent) == brute_runs(words, least, exponent)


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (6, 2), (7, 3)])
def test_find_runs_equals_brute_force(spark, least, exponent):
    rng = random.Random(3)
    docs = []
    for d in range(60):
        words = [f"v{rng.randrange(40)}é" for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(4)):
            p, at = rng.randrange(1, 12), rng.randrange(len(words) + 1)
            words[at:at] = ([f"r{rng.randrange(4)}" for _ in range(p)] * 9)[: rng.randrange(p, 9 * p)]
        docs.append((d, rng.choice((" ", "\n", "  \t")).join(words)))
    got = {r["doc_id"]: r for r in periodic_runs.find_runs(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), least, exponent).collect()}
    met = 0
    for d, text in docs:
        words = WORD.findall(text)
        want = brute_runs(words, least, exponent)
        met += len(want)
        assert [tuple(r) for r in got[d]["runs"]] == want and got[d]["n_words"] == len(words)
        assert got[d]["collapsed"] == brute_collapse(words, want)
    assert met > 30


def test_periodic_query_equals_brute_force(spark, sf):
    rows = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    changed = 0
    for d, text in docs:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(d).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            changed += 1
        runs = brute_runs(words) if len(words) < 3000 or h % 10 else periodic_runs.runs_of([hash(w) for w in words])
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        digest = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        want = (d, len(runs), *top, 1000 * top[1] // top[2] if runs else None, digest, hashlib.sha256(brute_collapse(words, runs).encode()).hexdigest())
        assert tuple(rows[d]) == want
    assert changed > 10


def test_runs_of_odd_rows(odd, none):
    rows = periodic_runs.find_runs(odd).collect()
    assert len(rows) == len(ODD)
    got = {r["doc_id"]: r for r in rows}
    for d in (2, 3, 4):
        assert (got[d]["n_words"], got[d]["runs"], got[d]["collapsed"]) == (0, [], "")
    assert got[5]["collapsed"] == "one" and got[6]["runs"] == [] and got[6]["collapsed"] == LONG and got[9]["n_words"] == 1
    assert [tuple(r) for r in got[11]["runs"]] == [(0, 50_000, 1)] and got[11]["collapsed"] == "la"
    assert [tuple(r) for r in got[None]["runs"]] == [(0, 18, 2)] and [tuple(r) for r in got[7]["runs"]] == [(0, 8, 2)] and got[12]["collapsed"] == "end"
    assert periodic_runs.find_runs(none).count() == 0 and periodic_runs.digest(periodic_runs.find_runs(none)).count() == 0
    assert periodic_runs.planted(odd).count() == len(ODD)
    assert dict(periodic_runs.collapse(odd).filter("doc_id = 11").collect())[11] == "la"
    with pytest.raises(ValueError, match="two periods"):
        periodic_runs.find_runs(odd, min_exponent=1)


# --- importance ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text, order):
    w = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]


def brute_importance(docs, target, order=1, buckets=10_000, percent=10, least=20, seed=2024):
    s, t = [0] * buckets, [0] * buckets
    for out, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in terms(text, order)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for d, text in docs:
        w, f = terms(text, order)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    take = len(fit) * percent // 100
    return sorted([(*r, k + 1 if k < take else None) for k, r in enumerate(fit)] + [(*r, None) for r in rows if r[1] < least], key=repr)


@pytest.mark.parametrize(("order", "buckets", "percent"), [(1, 10_000, 10), (2, 1000, 33), (4, 17, 100)])
def test_importance_equals_brute_force(spark, sf, order, buckets, percent):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + [(-1, None), (-2, ""), (None, "w " * 30), (5, "über Ärger %s x9" % ("é" * 200))]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    out = importance.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), order=order, buckets=buckets, percent=percent)
    want = brute_importance(docs, target, order, buckets, percent)
    assert sorted(map(tuple, out.collect()), key=repr) == want
    assert sum(r[5] is not None for r in want) > 10


def test_crcs_compose():
    import numpy as np

    rng = random.Random(5)
    words = [bytes(rng.randrange(128, 256) for _ in range(rng.choice((1, 2, 7, 31, 32, 33, 500)))) for _ in range(300)]
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - np.array([len(w) for w in words])
    crcs = importance.word_crcs(data, starts, ends)
    assert crcs.tolist() == [zlib.crc32(w) for w in words]
    both = importance.Shift()(crcs[:-1], (ends - starts)[1:]) ^ crcs[1:]
    assert both.tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[1:])]


def test_importance_of_odd_rows(spark, odd, none):
    target = spark.createDataFrame([("same row",), (None,)], "text string")
    rows = importance.resample(odd, target, percent=50).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == brute_importance(ODD, ["same row", None], percent=50)
    assert importance.resample(none, target).count() == 0
    assert importance.resample(odd, none).count() == len(ODD)
    kept = importance.drawn(odd, target, percent=100)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {6, 11}
    with pytest.raises(ValueError, match="buckets"):
        importance.gains(odd, target, buckets=0)


# --- personal data ---

RULES = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(x) for x in reversed(digits))) % 10 == 0


def brute_base(text):
    return [(kind, m.start(), m.end()) for kind, (rule, good) in RULES.items() for m in rule.finditer(text or "") if good(m[0])]


def named(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def card(rng, n=16):
    digits = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def test_base_spans_equal_the_plain_rules(spark):
    rng = random.Random(11)
    bits = ["a.b@c.de", "x@y", "@", "@b.c_d@e.f.g", "1.2.3.4", "256.1.1.1", "001.02.3.4.5.6.7.8.9", "0000000000000000000000000000000000000001.2.3.4", "+1 (499) 555-6503", "+4", "+1-", "12", "4 1-2", "--", ".", "\U0001f600", "é", " ", "\n", "+", "()", "_z", "%"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400)] + [" ".join([card(rng), *rng.choices(bits, k=3), card(rng, 13)]) for _ in range(50)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = frame.select("doc_id", personal_data.base_spans(F.col("text")).alias("b")).collect()
    met = set()
    for r in rows:
        want = brute_base(texts[r["doc_id"]])
        assert [(personal_data.KINDS[s["kind"]], s["start"], s["end"]) for s in r["b"]] == want, texts[r["doc_id"]]
        met |= {k for k, _, _ in want}
    assert len(met) == 4


def test_many_matches_of_one_text(spark):
    text = "ä1.2.3.4\n" * 3000
    spans = spark.createDataFrame([(text,)], "text string").select(personal_data.base_spans(F.col("text")).alias("b")).first()["b"]
    assert [(s["start"], s["end"]) for s in spans] == [(m.start(), m.end()) for m in RULES["ip"][0].finditer(text)]


def test_personal_data_query_equals_the_plain_rules(spark, sf):
    rows = {r["doc_id"]: r for r in queries.op13_personal_data(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d, text in docs:
        base = brute_base(text)
        r = rows[d]
        assert [r[f"n_{k}"] for k in RULES] == [sum(b[0] == k for b in base) for k in RULES]
        assert r["base_sha256"] == hashlib.sha256(named(base).encode()).hexdigest()
        assert {named([b]) for b in base} <= set(r["spans"].split(","))


def corpus(rng, n):
    """Texts with base spans, look-alikes that are none, and hidden forms; and what hidden forms stand where."""
    docs, hidden, clean = [], {}, set()
    say = lambda: " ".join(rng.choice(("lorem", "ipsum", "dolor", "sit", "amet")) for _ in range(rng.randrange(3, 9)))
    for d in range(n):
        phone = f"({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        wrong = card(rng)
        wrong = wrong[:-1] + str((int(wrong[-1]) + rng.randrange(1, 9)) % 10)
        kind = d % 10
        middle = [
            f"call +1 {phone}", f"mail joe.{d}@mail{d % 9}.example.com", f"host {rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.7", f"card {card(rng)}", f"number {wrong}",
            f"id x{rng.randrange(10**9, 10**10)}f", f"part {rng.randrange(300, 999)}.{rng.randrange(300, 999)}.1.2", f"mail joe.{d} [at] mail{d % 9} [dot] example [dot] com", f"cards {card(rng)} {card(rng)} paid", "nothing here at all",
        ][kind]
        text = f"{say()} {middle} {say()}"
        if kind == 7:
            at = text.index("joe.")
            hidden[d] = {("email", at, at + len(middle) - 5)}
        if kind == 8 and not brute_base(text):
            at = text.index("cards ") + 6
            hidden[d] = {("card", at, at + 16), ("card", at + 17, at + 33)}
        if kind in (4, 5, 6, 9):
            clean.add(d)
        docs.append((d, text))
    return docs, hidden, clean


def test_trees_add_hidden_forms_and_leave_look_alikes(spark):
    docs, hidden, clean = corpus(random.Random(2), 1500)
    rows = personal_data.digest(personal_data.find(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))).collect()
    got = {r["doc_id"]: {s for s in r["spans"].split(",") if s} for r in rows}
    want = {(d, named([s])) for d, spans in hidden.items() for s in spans}
    found = {(d, s) for d, s in want if s in got[d]}
    assert len(found) >= 0.95 * len(want) and len(want) > 300
    wrong = [(d, s) for d in clean for s in got[d] if s not in {named([b]) for b in brute_base(docs[d][1])}]
    assert len(wrong) <= 0.01 * len(clean)
    for d, text in docs:
        assert {named([b]) for b in brute_base(text)} <= got[d]


def test_redaction(spark):
    docs, hidden, _ = corpus(random.Random(4), 600)
    out = dict(personal_data.redact(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect())
    for d, text in docs:
        for _, a, b in brute_base(text):
            assert text[a:b] not in out[d]
    d, (a, b) = 0, brute_base(docs[0][1])[0][1:]
    assert out[d] == docs[0][1][:a] + "[phone]" + docs[0][1][b:]
    assert out[9] == docs[9][1]


def test_personal_data_of_odd_rows(odd, none):
    rows = personal_data.digest(personal_data.find(odd)).collect()
    assert len(rows) == len(ODD)
    got = {r["doc_id"]: r for r in rows}
    assert got[2]["spans"] == got[3]["spans"] == got[9]["spans"] == got[10]["spans"] == "" and got[8]["n_email"] == 1
    text = dict(ODD)[8]
    assert got[8]["spans"] == named(brute_base(text)) and text[text.index("a.b") :] == "a.b@c.de"
    assert personal_data.find(none).count() == 0
    assert personal_data.redact(odd).count() == len(ODD)


def test_personal_data_is_native(spark, sf):
    plan = queries.op13_personal_data(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- shared spans, windows and shards ---


def brute_spans(docs, span=50):
    """The word places of each text that a window of `span` words covers which stands earlier, in another text or that far before."""
    seen, out = {}, {}
    for d, text in docs:
        words = [w.lower() for w in WORD.findall(text)]
        gone = set()
        for a in range(len(words) - span + 1):
            first = seen.setdefault(tuple(words[a : a + span]), (d, a))
            if first[0] != d or a >= first[1] + span:
                gone |= set(range(a, a + span))
        out[d] = gone
    return out


def test_every_repeated_span_goes_whatever_earlier_texts_share(spark):
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(10**7)}"
    docs, spans = [], []
    for k in range(300):
        span = [word() for _ in range(60)]
        cut = rng.randrange(16)
        shared = span[cut : cut + 45]
        for part, text in enumerate((shared, span, span)):
            docs.append((part * 1000 + k, " ".join([*(word() for _ in range(rng.randrange(5, 40))), *text, *(word() for _ in range(rng.randrange(5, 40)))])))
        spans.append(" ".join(span))
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    text = dict(docs)
    for k, span in enumerate(spans):
        assert out[k]["text"] == text[k] and out[1000 + k]["text"] == text[1000 + k]
        (piece,) = out[2000 + k]["removed"]
        assert text[2000 + k][piece["start"] : piece["end"]] == span and piece["first_doc"] == 1000 + k


def test_spans_equal_brute_force(spark):
    rng = random.Random(9)
    pool = [[f"{k}x{i}" for i in range(70)] for k in range(6)]
    docs = []
    for d in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p, a = rng.choice(pool), rng.randrange(40)
            parts += p[a : a + rng.randrange(20, 70)] + [f"own{d}e{rng.random()}"]
        docs.append((d, "xİ " + " ".join(parts)))  # a letter whose lower case is longer
    docs.append((500, " ".join(pool[0] + pool[0])))
    want = brute_spans(docs)
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    met = 0
    for d, text in docs:
        places = [m.span() for m in WORD.finditer(text)]
        got = {i for i, (a, b) in enumerate(places) for x in rows[d]["removed"] if x["start"] <= a and b <= x["end"]}
        assert got == want[d], d
        met += len(got)
    assert met > 1000


def test_windows_alone_find_planted_pairs(spark):
    import numpy as np

    from quarrygraph.llm.common import Stash

    rng = np.random.default_rng(5)
    one = rng.standard_normal((1500, 32))
    two = one + 0.19 * rng.standard_normal((1500, 32))
    cosine = (one * two).sum(1) / np.linalg.norm(one, axis=1) / np.linalg.norm(two, axis=1)
    keep = cosine >= embedding_dedup.THRESHOLD
    vectors = [(int(i), v.astype("float32").tolist(), 1) for i, v in enumerate(one)] + [(int(i) + 5000, v.astype("float32").tolist(), 1) for i, v in enumerate(two) if keep[i]]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    stash = Stash(spark)
    rows = stash.put(embedding_dedup.usable(frame).select("vec_id", "label", "v").withColumn("m", F.lit(1).cast("long")))
    placed = embedding_dedup._placed(embedding_dedup._coded(rows, embedding_dedup.PASSES, embedding_dedup.WINDOW), stash)
    crowded, _ = embedding_dedup._crowds(placed, rows, embedding_dedup.PASSES, embedding_dedup.WINDOW, stash)
    assert crowded.count() <= 0.1 * placed.count()  # few places are dense by chance
    members, rows = embedding_dedup._crowds(placed, rows, embedding_dedup.PASSES, 10**9, stash)
    assert members.count() == 0  # nothing is compared but windows
    found = {(r["dst"], r["src"]) for r in embedding_dedup.window_pairs(placed, rows, embedding_dedup.THRESHOLD, embedding_dedup.WINDOW).collect()}
    planted = {(int(i), int(i) + 5000) for i in np.flatnonzero(keep)}
    assert len(planted) > 700 and len(found & planted) >= 0.99 * len(planted)
    linked = {r["vec_id"] for r in embedding_dedup.near_duplicates(frame).filter("n_links > 0").collect()}
    assert len(linked & {x for p in planted for x in p}) >= 0.99 * 2 * len(planted)


def test_the_registered_mixture_has_several_shards(spark, sf):
    rows = queries.op4_mixing(spark, sf).collect()
    shards = {x for r in rows for x in r["shards"]}
    assert len(shards) >= 4
    words = [sum(r["size"] for r in rows for x in r["shards"] if x == s) for s in sorted(shards)]
    assert min(words) > 0


# --- quality ---


def plain_loss(rows, y, w, cuts, ridge=1e-5):
    """Mean negative log likelihood of the grades, one by one, and the ridge."""
    total = 0.0
    for (i, v), g in zip(rows, y, strict=True):
        score = float((w[i] * v).sum())
        below = lambda k: 0.0 if k < 0 else 1.0 if k >= len(cuts) else 1 / (1 + math.exp(-max(-35, min(35, cuts[k] - score))))
        total -= math.log(max(1e-12, below(g) - below(g - 1)))
    return total / len(rows) + ridge / 2 * float((w * w).sum())


def test_the_fit_reaches_the_optimum_of_a_plain_optimiser():
    import numpy as np

    from quarrygraph.llm import quality

    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 3))
    truth = np.array([1.0, -0.7, 0.4])
    y = np.digitize(base @ truth + rng.logistic(size=300), [-1.0, 0.5, 1.5])
    rows = [(np.arange(3), b) for b in base]
    w, cuts = quality.fit(rows, y, 4)

    def loss(p):
        return plain_loss(rows, y, p[:3], np.cumsum([p[3], math.exp(p[4]), math.exp(p[5])]))

    p, rate = np.array([0.0, 0.0, 0.0, -1.0, 0.0, 0.0]), 1.0
    for _ in range(120):  # plain descent by numeric slopes, with a step that is halved until it helps
        slope = np.array([(loss(p + d) - loss(p - d)) / 2e-5 for d in np.eye(6) * 1e-5])
        while loss(p - rate * slope) > loss(p) and rate > 1e-6:
            rate /= 2
        p, rate = p - rate * slope, rate * 1.5
    assert abs(plain_loss(rows, y, w.astype(float), cuts) - loss(p)) < 2e-3
    assert np.allclose(w[:3], p[:3], atol=0.08) and np.allclose(cuts, np.cumsum([p[3], math.exp(p[4]), math.exp(p[5])]), atol=0.08)


def test_four_grades_tails_and_expected_grades_equal_brute_force(spark, odd):
    import numpy as np
    import pyarrow as pa

    from quarrygraph.llm import quality

    rng = random.Random(6)
    kinds = [["fine", "words", "here"], ["some", "words", "there"], ["junk", "x", "here"], ["zzz", "qqq", "x"]]
    docs = [(d, " ".join(rng.choice(kinds[d % 4]) if rng.random() < 0.8 else rng.choice(kinds[(d + 1) % 4]) for _ in range(rng.randrange(5, 30)))) for d in range(600)]
    grades = [0, 2, 3, 7]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(d, grades[d % 4]) for d in range(600)] + [(5, 7), (None, 1), (6, None)], "doc_id long, quality int")
    model = quality.train(frame, labels)
    assert model.grades == grades and (np.diff(model.thresholds) > 0).all()
    rows = quality.score(frame.union(frame.limit(20)), model, cut=0.3).collect()  # rows given twice come out alike
    assert len(rows) == 620
    right = 0
    for r in rows:
        ((index, value),) = quality.features(pa.array([dict(docs)[r["doc_id"]]]))
        score = sum(float(model.weights[i]) * float(v) for i, v in zip(index, value, strict=True))
        tails = [1 / (1 + math.exp(-(score - float(t)))) for t in model.thresholds]
        expected = grades[0] + sum(t * (b - a) for t, a, b in zip(tails, grades, grades[1:]))
        assert r["expected_grade"] == pytest.approx(expected, abs=1e-4) and r["tail_probability"] == pytest.approx(tails[-1], abs=1e-5)
        assert r["grade"] == grades[sum(t >= 0.5 for t in tails)] and r["selected"] == (r["tail_probability"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        right += r["grade"] == grades[r["doc_id"] % 4]
    assert right > 0.9 * 620
    assert quality.score(odd, model).count() == len(ODD)


def test_training_rows_stay_within_their_bound(spark):
    from quarrygraph.llm import quality

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "good words here").otherwise("bad x").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    held = []
    fit = quality.fit
    quality.fit = lambda rows, *a, **k: held.append(len(rows)) or fit(rows, *a, **k)
    try:
        quality.train(docs, labels, max_labelled=400)
    finally:
        quality.fit = fit
    assert 250 < held[0] < 550
