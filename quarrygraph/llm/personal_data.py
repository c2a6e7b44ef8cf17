"""Personal data: base rules, wide generators, boosted trees over the candidates, calibrated thresholds.

Everything is a DataFrame operation: Spark's own regular expressions find matches, array functions place and
check them, and the boosted trees are Spark's own.

Base rules give spans that always stay. Generators of high recall propose further spans, which may overlap: chains of
digits with any usual separators, cut wide and tight and offered for each kind that their digits allow, and names beside
an `@` or `at` with a domain of dots or `dot`. A candidate is a positive example where it is a valid base span of its
kind, and a negative one where it fails the check of its kind, overlaps a valid span of another kind or is
part of an identifier; all others have no label. Trees are fitted to shapes, checks and contexts: the marks that base
rules ask for first (a plus sign, an at sign, plain dots) are no feature, so a candidate without them is judged by the rest.
On held-out examples each kind gets the lowest threshold whose precision there is PRECISION. Candidates above it are
added where they overlap no base span; of several that overlap one another the likeliest stays. A kind of which
the corpus has no negative examples, as e-mail addresses may be, gets the threshold SURE.

All examples train and calibrate the model: those of two thirds of the rows, chosen by hash, and those of the others. Each kind and
label weighs the same in training.

Patterns are written so that no run of characters is scanned again from each of its places, and none recurses:
possessive runs that begin where a run begins or where the last match ended give the leftmost matches of the plain
patterns in linear time, texts of any length and shape included.

Defined cases: null and empty texts have no spans; repeated rows and null ids give a row each; a kind without enough
positive examples gets no additions, nor does any where a corpus has examples of one label only; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stash, partitions

KINDS = ("email", "ip", "card", "phone")
LOCAL = "A-Za-z0-9._%+-"
#: The base rules, as possessive runs.
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators: the kinds that each may propose, and its pattern.
AT = r"(?:\x20?@\x20?|\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?)"
DOTS = r"(?:\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT)\x20)"
DOT = rf"(?:\.|{DOTS})"
LABEL = "[A-Za-z0-9-]++"
WIDE = {
    "name": (("email",), rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++(?:{AT}{LABEL}(?:{DOT}{LABEL})++|\x20(?:at|AT)\x20{LABEL}(?:{DOTS}{LABEL})++)"),
    "wide": (("card", "phone"), r"(?:(?<![0-9])|\G)(?:\+|00)?+\(?+[0-9]++(?:[\x20()./-]{1,3}+[0-9]++)*+"),
    "tight": (("card", "phone"), r"(?:(?<![0-9])|\G)[0-9]++(?:[.-][0-9]++)*+"),
    "dotted": (("ip",), r"(?:(?<![0-9])|\G)[0-9]{1,3}+(?:\x20?[\[({]?+\x20?(?:\.|dot)\x20?[\])}]?+\x20?[0-9]{1,3}+){3}(?![0-9])"),
}
CONTEXT = 32
BLOCK = 128
PRECISION, SURE, LEAST_EXAMPLES = 0.98, 0.9, 20
TREES, DEPTH = 20, 4


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(lengths: Column) -> Column:
    """For each of an array of lengths, the sum of those before it; in blocks, so that no long array is copied for each of its items."""

    def running(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda sums, x: F.array_append(sums, F.element_at(sums, -1) + x))

    def of(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x))
        bases = running(totals, F.lit(0).cast("long"))
        return F.flatten(F.zip_with(blocks, F.slice(bases, 1, F.size(blocks)), lambda b, base: F.slice(running(b, base), 1, F.size(b))))

    def cut(whole: Column) -> Column:
        last = F.size(whole) - 1
        places = lambda k: F.sequence(k * BLOCK, F.least(k * BLOCK + (BLOCK - 1), last))
        return F.transform(F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int")), lambda k: F.transform(places(k), lambda i: F.get(whole, i)))

    return _let(_let(lengths, cut), of)


MATCH = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"


def matches(text: Column, pattern: str) -> Column:
    """All leftmost matches that don't overlap: start and end in code points, value, and CONTEXT characters beside it, fewer beyond its next neighbours."""

    def placed(values: Column) -> Column:
        def of(pieces: Column) -> Column:
            sizes = F.transform(pieces, lambda p, i: (F.length(p) + F.coalesce(F.length(F.get(values, i)), F.lit(0))).cast("long"))

            def spans(before: Column) -> Column:
                def span(v: Column, i: Column) -> Column:
                    start = F.get(before, i) + F.length(F.get(pieces, i))
                    earlier = F.concat(F.coalesce(F.substring(F.get(pieces, i - 1), -CONTEXT, CONTEXT), F.lit("")), F.coalesce(F.get(values, i - 1), F.lit("")))
                    later = F.concat(F.coalesce(F.get(values, i + 1), F.lit("")), F.coalesce(F.substring(F.get(pieces, i + 2), 1, CONTEXT), F.lit("")))
                    return F.struct(
                        start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"),
                        F.substring(F.concat(earlier, F.substring(F.get(pieces, i), -CONTEXT, CONTEXT)), -CONTEXT, CONTEXT).alias("before"),
                        F.substring(F.concat(F.substring(F.get(pieces, i + 1), 1, CONTEXT), later), 1, CONTEXT).alias("after"),
                    )

                return F.transform(values, span)

            return _let(_before(sizes), spans)

        return F.when(F.size(values) > 0, _let(F.split(text, pattern, -1), of)).otherwise(F.lit(None).cast(MATCH))

    none = F.array().cast(MATCH)
    return F.coalesce(_let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed), none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    places = F.sequence(F.lit(1), F.length(digits))

    def worth(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of a kind passes that kind's check."""
    if kind == "ip":
        parts = F.regexp_extract_all(value, F.lit("0*+([0-9]*+)"), F.lit(1))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return _let(_digits(value), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """kind (its place in KINDS), start, end of all valid base spans of a text."""

    def of(k: int, kind: str) -> Column:
        held = F.filter(matches(text, BASE[kind]), lambda m: valid(kind, m["value"]))
        return F.transform(held, lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    return F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)])


def candidates(text: Column) -> Column:
    """kind, start, end, value, before, after of all spans that a generator proposes."""

    def fits(m: Column, kind: str) -> Column:
        n = F.length(_digits(m["value"]))
        return n.between(7, 15) if kind == "phone" else n.between(13, 19) if kind == "card" else F.lit(True)

    def offered(found: Column, kind: str) -> Column:
        fields = lambda m: [m[n].alias(n) for n in ("start", "end", "value", "before", "after")]
        return F.transform(F.filter(found, lambda m: fits(m, kind)), lambda m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), *fields(m)))

    parts = []
    for name, (kinds, pattern) in WIDE.items():
        held = matches(text, pattern)
        if name in ("wide", "tight"):  # most numbers are short
            held = F.filter(held, lambda m: F.length(m["value"]) >= 7)
        parts.append(_let(held, lambda found: F.concat(*[offered(found, kind) for kind in kinds])))  # noqa: B023
    return F.concat(*parts)


def _class(c: Column) -> Column:
    """Of the character beside a span: 0 none or blank, 1 letter, 2 digit or underscore, 3 other."""
    return F.when(F.length(F.trim(c)) == 0, 0).when(c.rlike(r"\p{L}"), 1).when(c.rlike(r"[\p{N}_]"), 2).otherwise(3)


def features() -> dict[str, Column]:
    """Columns of numbers that tell a candidate's shape and surroundings, without the marks that base rules ask for."""
    value, before, after = F.col("value"), F.col("before"), F.col("after")
    groups = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    sizes = F.transform(groups, lambda g: F.length(g))
    domain = F.regexp_extract(value, rf"(?:{AT}|\x20(?:at|AT)\x20)(.*)$", 1)
    count = lambda chars: F.length(value) - F.length(F.regexp_replace(value, f"[{chars}]", ""))
    word = F.lower(F.regexp_extract(before, r"([\p{L}]+)[^\p{L}]*$", 1))
    out = {f"is_{kind}": (F.col("kind") == k).cast("int") for k, kind in enumerate(KINDS)}
    return out | {
        "checked": F.col("checked").cast("int"), "digits": F.length(_digits(value)), "groups": F.size(groups), "widest": F.coalesce(F.array_max(sizes), F.lit(0)), "narrowest": F.coalesce(F.array_min(sizes), F.lit(0)),
        "first": F.coalesce(F.get(sizes, F.lit(0)), F.lit(0)), "last": F.coalesce(F.get(sizes, F.size(sizes) - 1), F.lit(0)), "blanks": count(r"\x20"), "hyphens": count("-"), "rounds": count("()"), "slashes": count("/"),
        "letters": count(r"\p{L}"), "labels": F.when(F.col("kind") == 0, F.size(F.split(domain, DOT))).otherwise(0), "top": F.when(F.col("kind") == 0, F.length(F.regexp_extract(domain, "([A-Za-z]*)$", 1))).otherwise(0),
        "name": F.when(F.col("kind") == 0, F.length(F.regexp_extract(value, rf"^[{LOCAL}]+", 0))).otherwise(0),
        "left": _class(F.substring(before, -1, 1)), "right": _class(F.substring(after, 1, 1)), "cue": F.when(word == "", -1).otherwise(F.pmod(F.xxhash64(word), F.lit(16))),
        "digits_left": F.length(_digits(before)), "digits_right": F.length(_digits(after)), "own_line": (F.trim(before).isin("") | before.endswith("\n")).cast("int"),
    }


def checked() -> Column:
    """Whether a candidate passes the check of its kind."""
    value = F.col("value")
    parts = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    ip = F.forall(parts, lambda p: p.try_cast("int") <= 255)
    digits = _digits(value)
    card = F.length(digits).between(13, 19) & luhn(digits)
    return F.when(F.col("kind") == 1, ip).when(F.col("kind") == 2, card).when(F.col("kind") == 3, F.length(digits).between(9, 15)).otherwise(F.lit(True))


def _labelled(rows: DataFrame) -> DataFrame:
    """The candidates of all rows with features, island, base (whether one overlaps a base span of its island) and label.

    Spans that overlap or touch one another through others are an island, told by a running maximum of ends.
    """
    names = ["kind", "start", "end", "value", "before", "after"]
    proposed = rows.select("row", F.explode("candidates").alias("c")).select("row", *[F.col(f"c.{n}").alias(n) for n in names])
    # two generators may propose one span, with contexts that end at different neighbours
    proposed = proposed.groupBy("row", "kind", "start", "end").agg(F.min(F.struct("value", "before", "after")).alias("c")).select("row", "kind", "start", "end", "c.*", F.lit(False).alias("fixed"))
    fixed = rows.select("row", F.explode("base").alias("c")).select("row", "c.kind", "c.start", "c.end", *[F.lit(None).cast("string").alias(n) for n in names[3:]], F.lit(True).alias("fixed"))
    both = proposed.union(fixed)
    order = Window.partitionBy("row").orderBy("start", "end")
    both = both.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    both = both.withColumn("island", F.sum(F.when(F.col("reach") > F.col("start"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    held = Window.partitionBy("row", "island")
    spot = Window.partitionBy("row", "island", "kind", "start", "end")
    both = both.withColumn("base", F.max(F.col("fixed").cast("int")).over(held) == 1).withColumn("is_base", F.max(F.col("fixed").cast("int")).over(spot) == 1)
    shape = features()
    out = both.filter(~F.col("fixed")).withColumn("checked", checked()).select("*", *[c.cast("double").alias(f"f_{n}") for n, c in shape.items()])
    within = F.col("f_left").isin(1, 2) | F.col("f_right").isin(1, 2)
    label = F.when(F.col("is_base"), 1).when(~F.col("checked") | F.col("base") | within, 0)
    return out.select("row", "kind", "start", "end", "island", "base", "checked", label.alias("label"), *[f"f_{n}" for n in shape])


def _floors(graded: DataFrame, precision: float, stash: Stash) -> DataFrame:
    """(kind, floor): the least probability at which, of a kind's examples at least as likely, that share is positive.

    graded: kind, probability, label. Examples are counted by probability; the counts are sorted by range and summed within each
    range, over what the ranges before it hold, so no kind lies in one task.
    """
    counts = graded.groupBy("kind", "probability").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positive"))
    order = [F.col("kind"), F.desc("probability")]
    ranged = stash.put(counts.repartitionByRange(partitions(graded.sparkSession), *order).select("*", F.spark_partition_id().alias("part")))
    sums = ranged.groupBy("kind", "part").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))  # a row a kind and range
    earlier = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("kind", "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "positive")])
    within = Window.partitionBy("kind", "part").orderBy(F.desc("probability"))
    right = (F.col("positive_before") + F.sum("positive").over(within)) / (F.col("n_before") + F.sum("n").over(within))
    held = ranged.join(F.broadcast(before), ["kind", "part"]).select("kind", "probability", right.alias("right"))
    return held.filter((F.col("right") >= precision) & (F.col("probability") >= 0.5)).groupBy("kind").agg(F.min("probability").alias("floor"))


def accepted(rows: DataFrame, stash: Stash, precision: float = PRECISION) -> DataFrame:
    """row, kind, start, end, probability of the spans that the trees add to the base spans of stored rows."""
    known = stash.put(_labelled(rows))
    columns = [c for c in known.columns if c.startswith("f_")]
    assemble = VectorAssembler(inputCols=columns, outputCol="features")
    examples = known.filter("label is not null").withColumn("fold", F.pmod(F.xxhash64("row", F.lit("fold")), F.lit(3)))
    none = known.select("row", "kind", "start", "end", F.lit(0.0).alias("probability")).filter(F.lit(False))
    sizes = {(r["kind"], r["label"]): r["n"] for r in examples.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most eight rows
    able = [k for k in range(len(KINDS)) if sizes.get((k, 1), 0) >= LEAST_EXAMPLES]
    both = [k for k in able if sizes.get((k, 0), 0) >= LEAST_EXAMPLES]
    if not both:
        return none
    # so that no kind or label outweighs the others by its number, each has the same weight in all
    weights = F.create_map(*[F.lit(x) for (k, label), n in sizes.items() for x in (2 * k + label, sum(sizes.values()) / len(sizes) / n)])
    weighted = examples.filter("fold > 0").withColumn("weight", F.element_at(weights, (2 * F.col("kind") + F.col("label")).cast("int")))
    trees = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=1)
    model = trees.fit(assemble.transform(weighted))

    def scored(df: DataFrame) -> DataFrame:
        return model.transform(assemble.transform(df)).withColumn("probability", vector_to_array("probability")[1])

    floors = _floors(scored(examples.filter("fold = 0")).select("kind", "probability", "label"), precision, stash)
    floors = floors.select("kind", F.when(F.col("kind").isin(both), F.col("floor")).otherwise(F.greatest("floor", F.lit(SURE))).alias("floor"))  # at most four rows
    open_ = known.filter(F.col("label").isNull() & F.col("kind").isin(able))
    likely = scored(open_).join(F.broadcast(floors), "kind").filter("probability >= floor")
    best = likely.groupBy("row", "island").agg(F.max(F.struct("probability", (F.col("end") - F.col("start")).alias("size"), (-F.col("kind")).alias("k"), "start", "end")).alias("best"))
    return best.select("row", (-F.col("best.k")).alias("kind"), "best.start", "best.end", "best.probability")


def find(docs: DataFrame, stash: Stash | None = None, keep_text: bool = False, **options) -> DataFrame:
    """doc_id, base and spans (kind, start, end, by kind and start; spans holds those of base too) of each row; text on request."""
    stash = stash or Stash(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = stash.put(read.select(F.monotonically_increasing_id().alias("row"), "doc_id", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("candidates"), *(["text"] if keep_text else [])))
    added = accepted(rows, stash, **options).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    out = rows.drop("candidates").join(added, "row", "left")
    own = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return out.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.coalesce("added", own))).alias("spans"), *(["text"] if keep_text else []))


def _named(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The numbers of base spans by kind, their digest, and all spans as one string, of rows of find()."""
    counts = [F.size(F.array_remove(F.col("base.kind"), k)) for k in range(len(KINDS))]
    counts = [(F.size("base") - n).cast("long").alias(f"n_{kind}") for n, kind in zip(counts, KINDS, strict=True)]
    return found.select("doc_id", *counts, F.sha2(_named(F.col("base")).cast("binary"), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, **options) -> DataFrame:
    """doc_id and text with each span replaced by its kind in square brackets; of spans that overlap the first, then the longest, counts."""
    found = find(docs, keep_text=True, **options)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        end = -s["back"]
        mark = F.concat(F.lit("["), F.get(kinds, s["kind"]), F.lit("]"))
        part = F.concat(F.substring("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), mark)
        return F.when(s["start"] >= acc["at"], F.struct(end.alias("at"), F.array_append(acc["parts"], part).alias("parts"))).otherwise(F.struct(F.greatest(acc["at"], end).alias("at"), acc["parts"].alias("parts")))

    done = F.aggregate(ordered, state, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring("text", (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return found.select("doc_id", done.alias("text"))
