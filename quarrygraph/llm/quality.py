"""Quality by ordinal cumulative-link regression on graded labels.

    P(grade <= k | text) = sigmoid(t_k - w . x),   t_0 < t_1 < ...

One weight vector w is shared by all grades; x holds hashed words (log frequencies, scaled to unit
length) and hashed bins of a few whole-text measures: share of letters, capitals and symbols, word
length, line length, repetition. Expected grade is the sum of tail probabilities; a text is
selected when the probability of at least the grade asked for reaches the cut.

Training uses labelled rows whose crc32(doc_id as text) mod 5 is not 0, at most about MAX_LABELLED
of them by a hash of doc_id. Their ids are broadcast, so documents are scanned and never shuffled;
their hashed features, of bounded number, are fitted on the driver. All documents are scored.

Defined cases: null and empty texts are scored from the empty text's measures; null labels and ids
never train; a doc_id labelled twice has its lower grade; with labels of one grade only every
text gets that grade, and without labels grade 0 and nothing is selected. Rows repeated whole are scored alike and each train
if their id is labelled; texts of any length are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash
from .textpack import LOWER, MIX, buffer_of, finish, slices, span_hashes, word_counts, word_spans

MAX_LABELLED = 20_000
WIDTH = 1 << 15
MEASURES = 9
CLASS = np.zeros(256, dtype=np.int64)
CLASS[[*range(97, 123), *range(128, 256)]] = 1
CLASS[65:91] = 2
CLASS[48:58] = 3
CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,"]] = 4


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed positions and values of each text."""
    data, offsets = buffer_of(column)
    starts, ends = word_spans(data, offsets)
    counts = word_counts(starts, offsets)
    hashes = span_hashes(LOWER[data], starts, ends)
    slots = (hashes % np.uint64(WIDTH)).astype(np.int64)
    kinds = CLASS[data]
    edge = np.concatenate(([0], np.cumsum(counts)))
    for d in range(len(counts)):
        a, b = int(offsets[d]), int(offsets[d + 1])
        words = slots[edge[d] : edge[d + 1]]
        index, n = np.unique(words, return_counts=True)
        value = np.log1p(n)
        value = value / max(1e-9, np.sqrt((value * value).sum()))
        share = np.bincount(kinds[a:b], minlength=5) / max(1, b - a)
        total = max(1, len(words))
        lines = 1 + int((data[a:b] == 10).sum())
        same = int((words[1:] == words[:-1]).sum()) if len(words) > 1 else 0
        bins = [
            int(20 * share[1]), int(20 * share[2]), int(20 * share[3]), min(20, int(100 * share[4])), min(20, int((b - a) / total)),
            min(20, int(np.log2(1 + total))), min(20, int(np.log2(1 + total / lines) * 2)), int(10 * len(index) / total), int(10 * same / total),
        ]
        named = finish(np.array([(k << 8) + x for k, x in enumerate(bins)], dtype=np.uint64) * MIX[5] + MIX[6])
        yield np.concatenate([index, (named % np.uint64(WIDTH)).astype(np.int64) + WIDTH]), np.concatenate([value, np.full(MEASURES, 0.5)])


@dataclass
class Model:
    grades: list[int] = field(default_factory=lambda: [0])
    weights: np.ndarray = field(default_factory=lambda: np.zeros(2 * WIDTH, dtype=np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def tails(self, column: pa.Array) -> np.ndarray:
        """P(grade >= g) of each text for all grades but the lowest."""
        score = np.array([float(self.weights[i] @ v) for i, v in features(column)])
        return _sigmoid(score[:, None] - self.thresholds[None, :]) if len(score) else np.zeros((0, len(self.thresholds)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, levels: int, ridge: float = 1e-5, steps: int = 200, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adam over the whole sample; thresholds are a start and positive gaps."""
    n = len(rows)
    owner = np.repeat(np.arange(n), [len(i) for i, _ in rows])
    index, value = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
    share = np.cumsum(np.bincount(y, minlength=levels))[:-1] / n
    start = np.log((share + 1e-3) / (1 - share + 1e-3))
    theta = np.concatenate(([start[0]], np.log(np.maximum(np.diff(start), 1e-2))))
    w = np.zeros(2 * WIDTH)
    m, s = np.zeros(len(w) + len(theta)), np.zeros(len(w) + len(theta))
    for t in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate(([theta[0]], np.exp(theta[1:]))))
        bounds = np.concatenate(([-np.inf], cuts, [np.inf]))
        score = np.bincount(owner, value * w[index], minlength=n)
        high, low = _sigmoid(bounds[y + 1] - score), _sigmoid(bounds[y] - score)
        p = np.maximum(high - low, 1e-9)
        dh, dl = high * (1 - high) / p, low * (1 - low) / p
        slope = dh - dl  # of -log p by the score
        gw = np.bincount(index, value * slope[owner], minlength=len(w)) / n + ridge * w
        gc = np.array([dl[y == k + 1].sum() - dh[y == k].sum() for k in range(levels - 1)]) / n
        tail = np.cumsum(gc[::-1])[::-1]
        g = np.concatenate([gw, tail * np.concatenate(([1.0], np.exp(theta[1:])))])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        w, theta = w - move[: len(w)], theta - move[len(w) :]
    return w.astype(np.float32), np.cumsum(np.concatenate(([theta[0]], np.exp(theta[1:]))))


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, stash: Stash | None = None) -> Model:
    usable = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("grade")).filter(F.col("l_id").isNotNull() & F.col("grade").isNotNull() & ~held_out("l_id"))
    usable = usable.groupBy("l_id").agg(F.min("grade").alias("grade"))
    total = usable.count()
    share = 1 << 30 if total <= max_labelled else int((1 << 30) * max_labelled / total)
    sample = usable.filter(F.pmod(F.xxhash64("l_id"), F.lit(1 << 30)) < share)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), texts["doc_id"] == sample["l_id"]).select("doc_id", "grade", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = list(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())], ["doc_id", "grade", "i", "v"])

    # at most about max_labelled rows of hashed features
    held = rows.mapInArrow(extract, "doc_id long, grade int, i binary, v binary").toArrow().to_pydict()
    order = sorted(range(len(held["grade"])), key=lambda k: (held["doc_id"][k], held["i"][k]))
    grades = sorted(set(held["grade"]))
    if not grades:
        return Model()
    if len(grades) == 1:
        return Model(grades)
    y = np.array([grades.index(held["grade"][k]) for k in order])
    x = [(np.frombuffer(held["i"][k], np.int32), np.frombuffer(held["v"][k], np.float32)) for k in order]
    weights, cuts = fit(x, y, len(grades))
    return Model(grades, weights, cuts)


def score(docs: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability (of the top grade), grade, selected of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        gaps = np.diff(model.grades)
        for batch in slices(batches, "text"):
            n = batch.num_rows
            tails = model.tails(batch.column("text")) if len(gaps) else np.zeros((n, 0))
            expected = model.grades[0] + tails @ gaps
            top = tails[:, -1] if len(gaps) else np.full(n, float(model.grades[0] > 0))
            grade = np.array(model.grades)[(tails >= 0.5).sum(axis=1)] if n else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(expected, pa.float64()), pa.array(top, pa.float64()), pa.array(grade, pa.int32())], ["doc_id", "expected_grade", "tail_probability", "grade"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, grade int")
    return scored.select("doc_id", held_out().alias("held_out"), "expected_grade", "tail_probability", "grade", (F.col("tail_probability") >= cut).alias("selected"))
