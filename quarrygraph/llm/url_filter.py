"""URL filters: explicit host and path rules, then association rules mined from labels.

FP-growth mines the token sets of labelled URLs together with an item for the bad label. Of the
rules that conclude this item, those with enough support, confidence and lift stay, and of these
only rules that no shorter rule with at least the same confidence covers. Tokens that stand in the same
labelled pages are one item, so that the words of a host don't multiply the item sets; any of them
stands for it. Rules are matched by an inverted index, once for each distinct set of tokens: rule items
are joined to those of the set, and a rule fires where all of its items are met. A page that a mined rule hits is blocked, any other page is allowed, unless an explicit
rule decides: of those whose host is the page's host or a parent domain of it and whose path
begins the page's path, the longest wins.

Defined cases: a null url, or one without ://, has empty host and path, no tokens and the verdict
allow; ties of explicit rules go to the longer host, then to allow; repeated page ids are judged
as rows of their own; without labels no rules are mined; labels given twice count as bad if one is,
and null labels as good; urls of any length are read whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stash, offer

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
BAD = "label=bad"
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT, MIN_PAGES = 0.002, 0.6, 2.0, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url="url") -> tuple:
    """(host, path) columns of a url column."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def tokens(host="host", path="path"):
    """Distinct tokens: the host, its words, its top label, and the path's segments without digits."""
    words = F.regexp_extract_all(F.col(host), F.lit(r"[a-z]+"), F.lit(0))
    segments = F.filter(F.split(F.lower(F.col(path)), "/"), lambda s: (s != "") & ~s.rlike("[0-9]"))
    made = F.concat(F.when(F.col(host) != "", F.array(F.concat(F.lit("host="), F.col(host)))).otherwise(F.array()), F.transform(words, lambda w: F.concat(F.lit("word="), w)), F.transform(segments, lambda s: F.concat(F.lit("path="), s)))
    return F.array_distinct(made)


def items(pages: DataFrame) -> DataFrame:
    """(token, item): the first of the tokens that stand in the same pages, given page and tokens."""
    met = pages.select("page", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64(F.lit(k), "page").cast("decimal(38,0)")).alias(f"in_{k}") for k in (0, 1)])
    first = met.groupBy("n", "in_0", "in_1").agg(F.min("token").alias("item"))
    return met.join(first, ["n", "in_0", "in_1"]).select("token", "item")


def mine(pages: DataFrame, labels: DataFrame, min_support=MIN_SUPPORT, min_confidence=MIN_CONFIDENCE, min_lift=MIN_LIFT, stash: Stash | None = None) -> tuple[DataFrame, DataFrame]:
    """Rules (rule, antecedent, confidence, support) mined from pages whose id is labelled, and (token, item).

    A label is bad when quality is 0 or toxic is 1.
    """
    stash = stash or Stash(pages.sparkSession)
    bad = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    labelled = stash.put(pages.join(bad, pages["page_id"] == bad["l_id"]).filter(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("page"), "tokens", "bad"))
    equal = stash.put(items(labelled))
    named = labelled.select("page", "bad", F.explode("tokens").alias("token")).join(offer(equal), "token")
    baskets = named.groupBy("page", "bad").agg(F.collect_set("item").alias("tokens"))
    baskets = stash.put(baskets.select(F.when(F.col("bad") == 1, F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items")))
    min_support = max(min_support, MIN_PAGES / max(1, baskets.count()))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, min_support), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter((F.size("consequent") == 1) & F.array_contains("consequent", BAD) & (F.col("lift") >= min_lift))
    rules = stash.put(rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support").withColumn("rule", F.sha2(F.array_join("antecedent", "\n"), 256)))
    # a rule that contains a shorter one of no less confidence adds nothing: found through their shared tokens
    one = rules.select("rule", "confidence", F.size("antecedent").alias("n"), F.explode("antecedent").alias("t"))
    two = one.select(F.col("rule").alias("r2"), F.col("confidence").alias("c2"), F.col("n").alias("n2"), F.col("t").alias("t2"))
    covered = one.join(two, (F.col("t") == F.col("t2")) & (F.col("n2") < F.col("n")) & (F.col("c2") >= F.col("confidence"))).groupBy("rule", "r2", "n2").agg(F.count(F.lit(1)).alias("met")).filter("met = n2").select("rule").distinct()
    return rules.join(covered, "rule", "left_anti"), equal


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the sorted first mined rule that fires) of each row."""
    stash = Stash(pages.sparkSession)
    host, path = parts()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rows = stash.put(rows.select("*", F.array_sort(tokens()).alias("tokens")))
    mined, equal = mine(rows, labels, stash=stash, **options)
    index = mined.select("rule", F.concat_ws(" ", "antecedent").alias("pattern"), F.size("antecedent").alias("n"), F.explode("antecedent").alias("item"))
    # urls share few token sets, so rules are matched once for each set, and what fires is joined to the pages
    sets = rows.filter(F.size("tokens") > 0).select(F.col("tokens").alias("set")).distinct()
    met = sets.select("set", F.explode("set").alias("token")).join(offer(equal), "token").select("set", "item").distinct()
    fired = met.join(index, "item").groupBy("set", "rule", "pattern", "n").agg(F.count(F.lit(1)).alias("met")).filter("met = n").groupBy("set").agg(F.min("pattern").alias("mined"))
    out = rows.join(offer(stash.put(fired)), F.col("tokens") == F.col("set"), "left")
    fitting = []
    for verdict, rule in rules:
        domain, _, start = rule.partition("/")
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith("/" + start)
        fitting.append(F.when(fits, F.struct(F.lit(len(rule)).alias("length"), F.lit(len(domain)).alias("host_length"), F.lit(verdict == "allow").alias("allow"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    best = F.array_max(F.array(*fitting)) if fitting else F.lit(None).cast("struct<rule:string,verdict:string>")
    own = F.when(F.col("mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], own).alias("verdict"), "mined")

