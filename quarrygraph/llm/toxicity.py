"""Toxicity by a lexicon trie walked with Levenshtein automata, and context windows.

Training learns from labelled rows whose crc32(doc_id as text) mod 5 is not 0:

1. Each word's document frequency among toxic and among clean texts is counted with partial
   sums; words of enough support whose log odds are high form the lexicon.
2. The lexicon is a trie. Its product with a Levenshtein automaton accepts a word that is within a
   term's edit limit; states are made when first reached and shared by all words. A second pass
   counts how misspelt forms divide, and terms whose misspellings stand in clean texts as well
   (common in inflected languages) are matched exactly only.
3. The words in the windows around matches are counted by label in the same pass. Their log odds are
   the cues of context: reporting and quoting words speak against abuse, words of address for it,
   as far as the labels say so.
4. A logistic model weighs each text's matches: exact and misspelt ones, inside and outside
   quotation marks apart, the strongest one, and the sum of the cues around them.

Words are cut at [\\x20\\x09-\\x0D]+ everywhere, in training as in scoring; case and marks at their
edges don't count. At most about MAX_LABELLED labelled rows train, chosen by a hash of doc_id; they
are few enough to be broadcast as ids, so documents are scanned and never shuffled. The lexicon and the
cues come from these rows alone and need a share of them as support, so they are bounded too. Every
document is scored over its whole text.

Defined cases: null and empty texts have no match and get the score of such texts; rows of a null
doc_id count as not held out and never train; repeated rows train and are scored as often as they
stand; a doc_id labelled twice counts as toxic if one label says so; labels that are null are left
out; without labelled toxic rows, or without documents, all scores are 0; a text of any length is
scored whole; `score` returns its own columns only, `without_toxic` all of the input's.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, release_memory
from .textpack import buffer_of, slices, span_hashes, word_counts, word_spans

MAX_LABELLED = 20_000
MIN_SUPPORT, SUPPORT_SHARE = 3, 0.004  # a term stands in so many toxic texts, and in this share of them
MIN_ODDS = 2.5
WINDOW = 5
CUE_SUPPORT, CUE_PRIOR = 5, 5.0  # a cue stands around matches in so many texts; its odds are drawn to 0 by as many more
FEATURES = 6
KNOWN_WORDS = 200_000  # answers a task keeps at hand
KNOWN_STATES = 100_000  # states of the automaton a task keeps at hand
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’‚‹›…–—¡¿"
OPENING, CLOSING = "\"“„«‘‹", "\"”“»’›"


def edit_limit(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The product of a lexicon trie and a Levenshtein automaton, made state by state as needed."""

    def __init__(self, terms: dict[str, int]):
        """terms: the edit limit of each term."""
        self.children: list[dict[str, int]] = [{}]
        self.terms: list[str | None] = [None]
        self.most: list[int] = [0]
        self.limit = dict(terms)
        for term, limit in terms.items():
            node = 0
            self.most[0] = max(self.most[0], limit)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.terms.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], limit)
            self.terms[node] = term
        self._begin()

    def _begin(self) -> None:
        """Forgets all states but the first; they are made anew as words reach them."""
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        """A state is the set of trie nodes with the least edits spent to be there; -1 is dead."""
        queue = list(reached.items())
        while queue:  # letters of the term that the word lacks
            node, e = queue.pop()
            if reached.get(node, 99) < e or e >= self.most[node]:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and e + 1 < reached.get(child, 99):
                    reached[child] = e + 1
                    queue.append((child, e + 1))
        if not reached:
            return -1
        key = tuple(sorted(reached.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            hits = [(e, self.terms[n]) for n, e in key if self.terms[n] is not None and e <= self.limit[self.terms[n]]]
            self.accepts.append(min(hits)[::-1] if hits else None)
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}
        for node, e in self.states[state]:
            if e < self.most[node] and e + 1 < reached.get(node, 99):
                reached[node] = e + 1  # a letter too many
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and cost < reached.get(child, 99):
                    reached[child] = cost
        return self._state(reached)

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its limit and the edits between, or None."""
        if len(self.states) > KNOWN_STATES:
            self._begin()
        state = self.start
        for c in word:
            following = self.moves[state].get(c)
            if following is None:
                following = self.moves[state][c] = self._move(state, c)
            if following < 0:
                return None
            state = following
        return self.accepts[state]


def bare(word: str) -> str:
    return word.lower().strip(EDGE)


def quoted(tokens: list[str], at: int) -> bool:
    """Whether tokens[at] stands between an opening mark before it and a closing one after it."""
    opened = next((i for i in range(at, -1, -1) if tokens[i][:1] in OPENING and tokens[i]), None)
    ends = [t.rstrip(".,;:!?") for t in tokens]
    if opened is None or not any(t and t[-1] in CLOSING for t in ends[at:]):
        return False
    if len(ends[opened]) == 1 and opened < at:
        ends[opened] = ""  # the opening mark itself
    return not any(t and t[-1] in CLOSING for t in ends[opened:at])


class Matcher:
    """Finds lexicon matches in batches of texts; the answer for a word is looked up once."""

    def __init__(self, terms: dict[str, int]):
        self.automaton = Automaton(terms)
        self.shortest = max(1, min((len(t) - e for t, e in terms.items()), default=1))
        self.known: dict[bytes, tuple[str, int] | None] = {}

    def find(self, column: pa.Array) -> Iterator[tuple[int, str, int, list[str], int]]:
        """(document, term, edits, raw words of the window, place in it) of each match."""
        data, offsets = buffer_of(column)
        starts, ends = word_spans(data, offsets)
        if not self.automaton.limit or not len(starts):
            return
        long = np.flatnonzero(ends - starts >= self.shortest)
        hashes, first, back = np.unique(span_hashes(data, starts[long], ends[long]), return_index=True, return_inverse=True)
        raw = data.tobytes()
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        hits = {}
        for i, (a, b) in enumerate(zip(starts[long[first]].tolist(), ends[long[first]].tolist(), strict=True)):
            word = raw[a:b]
            if word not in self.known:
                self.known[word] = self.automaton.match(bare(word.decode("utf-8", "replace")))
            if self.known[word]:
                hits[i] = self.known[word]
        if not hits:
            return
        found = np.isin(back, np.fromiter(hits, dtype=np.int64))
        edge = np.concatenate(([0], np.cumsum(word_counts(starts, offsets))))
        for w, i in zip(long[found].tolist(), back[found].tolist(), strict=True):
            d = int(np.searchsorted(edge, w, "right")) - 1
            a, b = max(int(edge[d]), w - WINDOW), min(int(edge[d + 1]), w + WINDOW + 1)
            tokens = [raw[starts[k] : ends[k]].decode("utf-8", "replace") for k in range(a, b)]
            yield d, *hits[i], tokens, w - a


def cues_of(tokens: list[str], at: int) -> set[str]:
    """The words around a match."""
    return {w for w in map(bare, [*tokens[:at], *tokens[at + 1 :]]) if w}


@dataclass
class Model:
    terms: dict[str, int] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    cues: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = ()

    def features(self, matcher: Matcher, column: pa.Array) -> np.ndarray:
        """Log sums of the odds of exact and misspelt matches, outside quotes and inside; the strongest; the mean of cues."""
        sums = np.zeros((len(column), FEATURES))
        found = np.zeros(len(column))
        for d, term, edits, tokens, at in matcher.find(column):
            weight = self.weights.get(term, 1.0)
            sums[d, (1 if edits else 0) + (2 if quoted(tokens, at) else 0)] += weight
            sums[d, 4] = max(sums[d, 4], weight / (1 + edits))
            sums[d, 5] += sum(self.cues.get(w, 0.0) for w in sorted(cues_of(tokens, at)))
            found[d] += 1
        sums[:, :4] = np.log1p(sums[:, :4])
        sums[:, 5] /= np.maximum(found, 1)
        return sums

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.coefficients:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(self.coefficients[0] + features @ np.array(self.coefficients[1:]), -30, 30)))


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = ridge * np.r_[0, np.ones(len(w) - 1)]
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        w += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, stash: Stash | None = None) -> Model:
    spark = docs.sparkSession
    stash = stash or Stash(spark)
    usable = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("l_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("l_id"))
    usable = usable.groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    total = usable.count()
    share = 1 << 30 if total <= max_labelled else int((1 << 30) * max_labelled / total)
    sample = usable.filter(F.pmod(F.xxhash64("l_id"), F.lit(1 << 30)) < share)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = stash.put(texts.join(F.broadcast(sample), texts["doc_id"] == sample["l_id"]).select("text", "toxic"))
    classes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = classes.get(1, 0), sum(classes.values()) - classes.get(1, 0)
    if not toxic:
        stash.drop(rows)
        return Model()

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for pdf in frames:
            for text, label in zip(pdf.text, pdf.toxic, strict=True):
                counts[label == 1].update({w for w in map(bare, set(WORDS.findall(text))) if len(w) >= 3})
        for label in (0, 1):
            for start in range(0, len(counts[label]), 100_000):
                part = list(counts[label].items())[start : start + 100_000]
                yield pd.DataFrame({"term": [p[0] for p in part], "toxic": label, "n": [p[1] for p in part]})

    per = rows.mapInPandas(words, "term string, toxic int, n long").groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    lexicon = per.filter(F.col("t") >= max(MIN_SUPPORT, math.ceil(SUPPORT_SHARE * toxic))).withColumn("odds", odds).filter(F.col("odds") >= MIN_ODDS).orderBy("term").collect()
    if not lexicon:
        stash.drop(rows)
        return Model()
    weights = {r["term"]: float(r["odds"]) for r in lexicon}
    trial = {t: edit_limit(t) for t in weights}

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many texts of each label hold a misspelt form of a term (edits), or a word beside some match (cue)."""
        matcher, out = Matcher(trial), Counter()
        for batch in slices(batches, "text"):
            label = batch.column("toxic").to_pylist()
            seen = set()
            for d, term, edits, tokens, at in matcher.find(batch.column("text")):
                seen.update(("cue", w, d) for w in cues_of(tokens, at))
                if edits:
                    seen.add(("edits", term, d))
            out.update((kind, word, int(label[d] == 1)) for kind, word, d in seen)
        keys = list(out)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)), pa.array([k[2] for k in keys], pa.int32()), pa.array([out[k] for k in keys], pa.int64())], ["kind", "word", "toxic", "n"])

    of = lambda label: F.sum(F.when(F.col("toxic") == label, F.col("n")).otherwise(0))
    counted = rows.mapInArrow(around, "kind string, word string, toxic int, n long").groupBy("kind", "word").agg(of(0).alias("c"), of(1).alias("t"))
    counted = counted.filter((F.col("kind") == "edits") | (F.col("c") + F.col("t") >= CUE_SUPPORT)).collect()
    doubtful = {r["word"] for r in counted if r["kind"] == "edits" and r["c"] and math.log((r["t"] + 0.5) / (toxic + 1)) - math.log((r["c"] + 0.5) / (clean + 1)) < MIN_ODDS}
    beside = [r for r in counted if r["kind"] == "cue"]
    share = sum(r["t"] for r in beside) / max(1, sum(r["t"] + r["c"] for r in beside))
    cues = {r["word"]: math.log((r["t"] + CUE_PRIOR * share + 0.01) / (r["c"] + CUE_PRIOR * (1 - share) + 0.01)) - math.log((share + 0.01) / (1 - share + 0.01)) for r in beside}
    model = Model({t: 0 if t in doubtful else e for t, e in trial.items()}, weights, cues)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms)
        for batch in slices(batches, "text"):
            x = model.features(matcher, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(x[:, k]) for k in range(FEATURES))], ["toxic", *names])

    names = [f"f{k}" for k in range(FEATURES)]
    measured = rows.mapInArrow(measure, "toxic int, " + ", ".join(f"{n} double" for n in names)).toPandas()  # at most about max_labelled rows of numbers
    measured = measured.sort_values(["toxic", *names])
    model.coefficients = _fit(measured[names].to_numpy(), (measured.toxic == 1).to_numpy(float))
    stash.drop(rows)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value.terms)
        for batch in slices(batches, "text"):
            value = sent.value.score(sent.value.features(matcher, batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value)], ["doc_id", "score"])
        del matcher
        release_memory()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, all columns kept, in one scan."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value.terms)
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(sent.value.score(sent.value.features(matcher, batch.column("text"))) < 0.5))
        del matcher
        release_memory()

    return docs.mapInArrow(run, docs.schema)
