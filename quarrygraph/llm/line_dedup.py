"""Substring dedup by line hashing: of each repeated line or passage, only the earliest occurrence stays.

Lines are the units. A line is normalised (lower case, runs of white space as one blank, no blanks at
its ends), cut and hashed to 128 bits by JVM expressions. Digests are grouped over the whole
corpus with count and min, which are combined before the shuffle, so that a line in a third of all
documents moves one row a task. The digests found twice are written before units are joined to
them: both sides of the join are then plain exchanges, whose hot partitions adaptive execution
splits. The earliest occurrence, ranked by (doc_id, text hash, place), is kept; every other one
goes, whatever its length, within a text as well as between texts. A caller that wants short lines
left alone gives `min_words`; the others are handled as before.

Passages are also pasted into the middle of lines. With `spans`, they are found whatever surrounds
them. Runs of SEED words are hashed, and the least hash of each SPAN_WORDS - SEED + 1 runs is a
seed, so that any SPAN_WORDS words in a row give the same seed wherever they stand. Seeds are units
beside the lines. A seed is wanted if it stands again somewhere amid words that don't go with their lines
anyway; so the texts of a group of copies give no more than their seeds. Each text that holds a
wanted seed is read once more for its stretches: the windows of SPAN_WORDS words in a row that have this
seed. A stretch that equals an earlier one goes whole, by group and min like the lines. Of the rest, the first
stretches of their kinds, windows are told apart by hash and grouped in the same way, if their seed has more than one
kind of stretch at all. So a window goes unless it is the earliest of its kind, whatever other texts
share of it; windows that overlap are one span. Within one document a window counts if it starts
SPAN_WORDS words or more after its first occurrence. Texts are joined to their own seeds; no pair of texts is ever made.

Offsets are code points of the original text. A line that goes whole goes with its break.

Defined cases: a null text stays null and has nothing removed; blank lines are never units and
stay; a null doc_id ranks last; rows repeated whole are one document given several times and come
out alike; a text all of whose lines go becomes ''; a text of any length is cut and hashed whole; an
empty table gives no rows. The result of `dedup_lines` keeps all rows and columns, with `text`
replaced, and has three more; those of the input with their names give way, unless other names are
given. `without_repeats` keeps the columns of the input as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, release_memory
from .textpack import MIX, buffer_of, finish, slices, span_hashes, word_counts, word_spans

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = re.compile(r"[\x20\x09]*")
SPAN_WORDS, SEED = 50, 12
PIECES = "array<struct<start: long, end: long, first_doc: long>>"
SPANS = "array<struct<low: int, high: int, first_doc: long>>"
UNIT = ["doc_id", "rid", "seed", "unit", "low", "high", "digest", "check"]


def normal_lines(text: str) -> Column:
    """The lines of a text that aren't blank, normalised, as an array."""
    plain = F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.filter(F.split(F.trim(F.regexp_replace(plain, r"\x20?\n\x20?", "\n")), "\n"), lambda x: x != "")


def line_units(texts: DataFrame, min_words: int = 1) -> DataFrame:
    """UNIT rows of lines; a unit is the number of the line among those that aren't blank."""
    lines = texts.select("doc_id", "rid", F.posexplode(normal_lines("text")).alias("unit", "line"))
    if min_words > 1:
        lines = lines.filter(F.size(F.split("line", " ")) >= min_words)
    none = F.lit(0)
    return lines.select("doc_id", "rid", F.lit(False).alias("seed"), "unit", none.alias("low"), none.alias("high"), F.xxhash64("line").alias("digest"), F.xxhash64(F.lit(1), "line").alias("check"))


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """The least or greatest of each `width` values in a row."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = best(values[:-step], values[step:])
        have += step
    return values


def _least_runs(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of SEED words, and the least in each window of SPAN_WORDS words; 0 for a window over the end of a text."""
    n = len(hashes) - SEED + 1
    if len(hashes) < SPAN_WORDS:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    runs = np.zeros(n, dtype=np.uint64)
    for k in range(SEED):
        runs += hashes[k : k + n] * MIX[k]
    runs = finish(runs)
    least = _sliding(runs, SPAN_WORDS - SEED + 1, np.minimum)
    least[np.arange(len(least)) + SPAN_WORDS > np.repeat(np.cumsum(counts), counts)[: len(least)]] = 0
    return runs, least


def seeds_of(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place of its first word in all texts, and digest of each seed, given the words' hashes and their number by text."""
    runs, least = _least_runs(hashes, counts)
    if not len(runs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    window = SPAN_WORDS - SEED + 1
    edge = np.zeros(window - 1, dtype=np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate((edge, least, edge)), window, np.maximum) == runs)
    return np.repeat(np.arange(len(counts)), counts)[at], at, runs[at].view(np.int64)


def seed_units(texts: DataFrame) -> DataFrame:
    """UNIT rows of seeds: unit is the place of the first word; low and high are the first and last lines that windows around it touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = buffer_of(pc.utf8_lower(batch.column("text")))
            starts, ends = word_spans(data, offsets)
            counts = word_counts(starts, offsets)
            of, at, digests = seeds_of(span_hashes(data, starts, ends), counts)
            if not len(at):
                continue
            first = np.cumsum(counts) - counts
            breaks = np.searchsorted(np.flatnonzero(data == 10), starts)
            new = np.concatenate(([0], (breaks[1:] != breaks[:-1]).astype(np.int64)))
            new[first[first < len(new)]] = 0
            line = np.cumsum(new)  # of each word, among lines that aren't blank
            base, last = first[of], first[of] + counts[of] - 1
            low, high = np.maximum(at + SEED - SPAN_WORDS, base), np.minimum(at + SPAN_WORDS - 1, last)
            columns = [
                batch.column("doc_id").take(pa.array(of)), batch.column("rid").take(pa.array(of)), pa.array(np.ones(len(at), bool)), pa.array((at - first[of]).astype(np.int32)),
                pa.array((line[low] - line[base]).astype(np.int32)), pa.array((line[high] - line[base]).astype(np.int32)), pa.array(digests), pa.array(np.zeros(len(at), np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, UNIT)
            release_memory()

    return texts.select("doc_id", "rid", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, rid long, seed boolean, unit int, low int, high int, digest long, check long")


def repeats(docs: DataFrame, spans: bool, min_words: int, stash: Stash) -> DataFrame:
    """(doc_id, rid, gone, spans): the lines that go as array<struct<unit, first_doc>>, and spans by words."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), F.col("text").cast("string").alias("text"))
    lines = line_units(texts, min_words)
    units = stash.put(lines.union(seed_units(texts)) if spans else lines, "zstd")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", "unit")
    key = ["seed", "digest", "check"]
    first = stash.put(units.groupBy(*key).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "zstd")
    again = units.join(first, key).filter(~place.eqNullSafe(F.col("first")))
    line = F.when(~F.col("seed"), F.struct("unit", F.col("first.doc_id").alias("first_doc")))
    sown = F.when(F.col("seed"), F.struct("digest", "low", "high"))
    per = stash.put(again.groupBy("doc_id", "rid").agg(F.array_sort(F.collect_set(line)).alias("gone"), F.collect_set(sown).alias("seeds")), "zstd")
    if not spans:
        return per.select("doc_id", "rid", "gone", F.lit(None).cast(SPANS).alias("spans"))
    lines = F.transform("gone", lambda x: x["unit"])
    alone = F.filter("seeds", lambda x: F.size(F.array_except(F.sequence(x["low"], x["high"]), lines)) > 0)
    wanted = stash.put(per.select(F.explode(alone).alias("s")).select(F.col("s.digest").alias("wanted")).distinct())
    found = _spans(units.filter("seed").join(wanted, F.col("digest") == F.col("wanted")), texts, stash).select(F.col("doc_id").alias("s_doc"), F.col("rid").alias("s_rid"), "spans")
    both = per.select("doc_id", "rid", "gone").join(found, F.col("doc_id").eqNullSafe(F.col("s_doc")) & (F.col("rid") == F.col("s_rid")), "left")
    return both.select("doc_id", "rid", "gone", "spans").filter((F.size("gone") > 0) | F.col("spans").isNotNull())


def _spans(seeds: DataFrame, texts: DataFrame, stash: Stash) -> DataFrame:
    """(doc_id, rid, spans): by words, what windows of SPAN_WORDS words around wanted seeds hold and what stands earlier."""
    held = seeds.groupBy(F.col("doc_id").alias("h_doc"), F.col("rid").alias("h_rid")).agg(F.collect_set("digest").alias("seeds"))
    once = texts.dropDuplicates(["doc_id", "rid"])
    joined = once.join(held, F.col("doc_id").eqNullSafe(F.col("h_doc")) & (F.col("rid") == F.col("h_rid"))).select("doc_id", "rid", "text", "seeds")
    stretches = stash.put(joined.mapInArrow(_stretches, "doc_id long, rid long, at int, seed long, windows array<long>"), "zstd")
    place = lambda at: F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid", F.col(at).alias("at"))
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("rid") == F.col("first.rid"))
    close = own & (F.col("at") < F.col("first.at") + SPAN_WORDS)

    named = stretches.withColumn("kind", F.xxhash64("windows"))
    kinds = stash.put(named.groupBy("seed", "kind").agg(F.min(place("at")).alias("first")), "zstd")
    placed = named.join(kinds, ["seed", "kind"])
    whole = placed.filter(~close).select("doc_id", "rid", "at", (F.col("at") + F.size("windows")).alias("to"), "first")
    apart = stash.put(placed.filter(close & (F.col("at") > F.col("first.at"))).select("seed").distinct())  # periodic within a text
    several = kinds.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed").union(apart).distinct()
    firsts = placed.filter(close).join(several, "seed", "left_semi")
    windows = firsts.select("doc_id", "rid", "seed", F.col("at").alias("begin"), F.posexplode("windows").alias("nth", "window")).select("doc_id", "rid", "seed", "window", (F.col("begin") + F.col("nth")).alias("at"))
    first = stash.put(windows.groupBy("seed", "window").agg(F.min(place("at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "zstd")
    single = windows.join(first, ["seed", "window"]).filter(~close).select("doc_id", "rid", "at", (F.col("at") + 1).alias("to"), "first")

    again = whole.union(single).select("doc_id", "rid", "at", "to", F.col("first.doc_id").alias("first_doc"))
    order = Window.partitionBy("doc_id", "rid").orderBy("at", "to")
    reach = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1)) + SPAN_WORDS - 1
    runs = again.withColumn("new", F.coalesce(F.col("at") >= reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = runs.groupBy("doc_id", "rid", "run").agg(F.min("at").alias("low"), (F.max("to") + SPAN_WORDS - 1).alias("high"), F.min_by("first_doc", "at").alias("first_doc"))
    return pieces.groupBy("doc_id", "rid").agg(F.array_sort(F.collect_list(F.struct("low", "high", "first_doc"))).alias("spans"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of the first word, the seed and the windows' hashes of each stretch whose seed is one of its text's wanted ones."""
    most = SPAN_WORDS - SEED + 1
    for batch in slices(batches, "text"):
        data, offsets = buffer_of(pc.utf8_lower(batch.column("text")))
        starts, ends = word_spans(data, offsets)
        counts = word_counts(starts, offsets)
        hashes = span_hashes(data, starts, ends)
        _, least = _least_runs(hashes, counts)
        first = np.cumsum(counts) - counts
        wanted = np.zeros(len(least), dtype=bool)
        for k in range(batch.num_rows):
            part = slice(first[k], min(first[k] + counts[k], len(least)))
            wanted[part] = np.isin(least[part], batch.column("seeds")[k].values.to_numpy().view(np.uint64))
        at = np.flatnonzero(wanted & (least > 0))
        if not len(at):
            continue
        values = np.zeros(len(at), np.uint64)
        for k in range(SPAN_WORDS):
            values = (values ^ hashes[at + k]) * MIX[61]
        values = finish(values).view(np.int64)
        of = np.searchsorted(first + counts, at, "right")
        new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]) | (of[1:] != of[:-1])))
        run = np.flatnonzero(new)
        since = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        edges = np.flatnonzero(since % most == 0)  # a word after word run of one seed is cut, as in a text that repeats a word
        bounds = pa.array(np.append(edges, len(at)).astype(np.int32))
        windows = pa.ListArray.from_arrays(bounds, pa.array(values))
        for k in range(0, len(edges), 5_000):
            here = slice(k, k + 5_000)
            ids = [batch.column(c).take(pa.array(of[edges[here]])) for c in ("doc_id", "rid")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array((at - first[of])[edges[here]].astype(np.int32)), pa.array(least[at[edges[here]]].view(np.int64)), windows.slice(k, 5_000)], ["doc_id", "rid", "at", "seed", "windows"])
        release_memory()


def merged(pieces: list[tuple[int, int, int | None]]) -> list[tuple[int, int, int | None]]:
    """The pieces in order, without what an earlier or longer one holds."""
    out, at = [], 0
    for start, end, first in sorted(pieces, key=lambda x: (x[0], -x[1])):
        if end > at:
            out.append((max(start, at), end, first))
            at = end
    return out


def line_places(text: str) -> list[tuple[int, int]]:
    """(start, end) of the lines that aren't blank, without the blanks at their ends."""
    out, base = [], 0
    for line in text.split("\n"):
        body = line.strip("\x20\x09\x0b\x0c\x0d")
        if body:
            start = base + line.index(body)
            out.append((start, start + len(body)))
        base += len(line) + 1
    return out


def without(text: str, gone: dict[int, int | None], spans: list[tuple[int, int, int | None]] = ()) -> tuple[str, list[tuple[int, int, int | None]]]:
    """A text without the lines and spans given, and (start, end, first_doc) of what went."""
    lines = [(start, end, gone[k]) for k, (start, end) in enumerate(line_places(text)) if k in gone]
    removed = merged([*lines, *spans])
    out, base, k = [], 0, 0
    for line in text.split("\n"):
        stop, at, parts = base + len(line), 0, []
        while k < len(removed) and removed[k][1] <= base:
            k += 1
        here = k
        while here < len(removed) and removed[here][0] < stop:
            parts.append(line[at : max(removed[here][0] - base, at)])
            at = BLANKS.match(line, min(removed[here][1], stop) - base).end()
            here += 1
        left = "".join([*parts, line[at:]])
        if not parts:
            out.append(line)
        elif WORDS.search(left):
            out.append(left.strip("\x20\x09"))
        base = stop + 1
    return "\n".join(out), removed


CLEANED = f"text string, removed {PIECES}, passages int"


def _passages(text: str, removed: list[tuple[int, int, int | None]]) -> int:
    """How many passages of SPAN_WORDS words and more went; pieces with blanks alone between them are one."""
    runs: list[list[int]] = []
    for start, end, _ in removed:
        if runs and not WORDS.search(text, runs[-1][1], start):
            runs[-1][1] = end
        else:
            runs.append([start, end])
    return sum(len(WORDS.findall(text, a, b)) >= SPAN_WORDS for a, b in runs)


def _cleaned(texts: pd.Series, gone: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, units, more in zip(texts, gone, spans, strict=True):
        units, more = ([] if x is None else x for x in (units, more))
        if text is None or not len(units) + len(more):
            rows.append((text, [], 0))
        else:
            places = [m.span() for m in WORDS.finditer(text)] if len(more) else []
            spans_of = [(places[x["low"]][0], places[x["high"] - 1][1], x["first_doc"]) for x in more]
            clean, removed = without(text, {int(u["unit"]): u["first_doc"] for u in units}, spans_of)
            rows.append((clean, [{"start": a, "end": b, "first_doc": d} for a, b, d in removed], _passages(text, removed)))
    return pd.DataFrame(rows, columns=["text", "removed", "passages"])


def _deduped(docs: DataFrame, spans: bool, min_words: int, stash: Stash | None) -> DataFrame:
    """Each row, as `row`, with its new text and what was removed, as `c`."""
    stash = stash or Stash(docs.sparkSession)
    gone = repeats(docs, spans, min_words, stash).select(F.col("doc_id").alias("g_doc"), F.col("rid").alias("g_rid"), "gone", "spans")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("j_doc"), F.xxhash64("text").alias("j_rid"))
    joined = rows.join(gone, F.col("j_doc").eqNullSafe(F.col("g_doc")) & (F.col("j_rid") == F.col("g_rid")), "left")
    # only texts that lose something go to Python
    touched = F.when(F.col("g_rid").isNotNull(), F.col("row.text").cast("string"))
    cleaned = joined.withColumn("c", F.pandas_udf(_cleaned, CLEANED)(touched, F.col("gone"), F.col("spans")))
    text = F.when(F.col("g_rid").isNull(), F.col("row.text")).otherwise(F.col("c.text"))
    return cleaned.select("row", text.alias("text"), "c")


def dedup_lines(docs: DataFrame, spans: bool = True, min_words: int = 1, removed: str = "removed", n_removed: str = "n_removed", n_passages: str = "n_passages", stash: Stash | None = None) -> DataFrame:
    """All rows with repeated lines and passages taken out of `text`.

    Beside them stand what was removed, how many pieces, and how many passages of SPAN_WORDS words and more.
    """
    columns = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in (removed, n_removed, n_passages)]
    out = _deduped(docs, spans, min_words, stash)
    return out.select(*columns, F.col("c.removed").alias(removed), F.size("c.removed").cast("long").alias(n_removed), F.col("c.passages").cast("long").alias(n_passages))


def without_repeats(docs: DataFrame, spans: bool = True, min_words: int = 1, stash: Stash | None = None) -> DataFrame:
    """The same with the input's columns alone; documents whose text is left without a word go."""
    out = _deduped(docs, spans, min_words, stash).filter((F.size("c.removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
