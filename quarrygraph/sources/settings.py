"""Settings kept as JSON documents, read as tables; texts filled in for commits indexed before; events and reports as they go out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.assistant import filter_events


def members(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of each member of a JSON document that is one object, the value as VARIANT; names that begin with _ are remarks."""
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    return doc.select(F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("name", "value")).filter(~F.col("name").startswith("_"))


def refs(spark: SparkSession, path: str) -> DataFrame:
    """(repo, ref, tenant, env) of the refs that are indexed: repo to a list of refs."""
    each = members(spark, path).select(F.col("name").alias("repo"), F.explode(F.try_variant_get("value", "$", "array<variant>")).alias("r"))
    return each.select("repo", *[F.try_variant_get("r", f"$.{n}", "string").alias(n) for n in ("ref", "tenant", "env")]).filter("ref is not null")


def tenants(spark: SparkSession, path: str) -> DataFrame:
    """(word, pattern) of the words that people use for a customer, each pattern of company names a row."""
    return members(spark, path).select(F.lower("name").alias("word"), F.explode(F.try_variant_get("value", "$", "array<string>")).alias("pattern"))


def mirrored(spark: SparkSession, path: str) -> DataFrame:
    """(table, key, cursor, columns, large) of the tables that are mirrored."""
    of = lambda n, kind: F.try_variant_get("value", f"$.{n}", kind).alias(n)
    rows = members(spark, path).select(F.col("name").alias("table"), of("key", "string"), of("cursor", "string"), of("columns", "array<string>"), F.coalesce(F.try_variant_get("value", "$.large", "boolean"), F.lit(False)).alias("large"))
    return rows.filter("columns is not null")


def companies(owners: DataFrame, words: DataFrame, names: DataFrame, most: int = 12) -> DataFrame:
    """(item_id, owner) of the companies (owner, name, active, overrides) that names (item_id, name) mean, those with most overrides first.

    A name that is a tenant's word means its patterns; another one the companies whose name holds it, and if there are
    none, the patterns of a tenant's word among its own words.
    """
    asked = names.select("item_id", F.trim(F.regexp_replace("name", r"[^\w &.\-']+", " ")).alias("raw")).filter(F.length("raw") >= 3).withColumn("key", F.lower("raw"))
    live = owners.filter("active").select("owner", F.lower("name").alias("company"), "overrides")
    told = words.select("word", F.lower("pattern").alias("pattern"))
    own = asked.join(told, F.col("key") == F.col("word")).select("item_id", "pattern")
    held = asked.join(told.select("word").distinct(), F.col("key") == F.col("word"), "left_anti").select("item_id", F.concat(F.lit("%"), F.replace(F.replace("key", F.lit("_"), F.lit("\\_")), F.lit("%"), F.lit("\\%")), F.lit("%")).alias("pattern"), "key")
    first = _met(own.union(held.select("item_id", "pattern")), live)
    # a tenant's word is met by its own number of words, at either end of the name or within
    left = held.join(first.select("item_id").distinct(), "item_id", "left_anti")
    grams = left.select("item_id", F.split("key", " +").alias("w")).select("item_id", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.slice("w", i, n), " "))))).alias("gram")).distinct()
    word = grams.join(told, F.col("gram") == F.col("word"))
    one = word.groupBy("item_id").agg(F.min("word").alias("one"))
    second = _met(word.join(one, "item_id").filter("word = one").select("item_id", "pattern"), live)
    from pyspark.sql import Window

    order = Window.partitionBy("item_id").orderBy(F.desc("overrides"), "owner")
    return first.union(second).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).select("item_id", "owner", "overrides")


def _met(patterns: DataFrame, live: DataFrame) -> DataFrame:
    """(item_id, owner, overrides) of companies that a pattern of an item matches; distinct patterns are few and are sent to the companies."""
    few = patterns.select("pattern").distinct()
    hits = live.join(F.broadcast(few) if few.limit(10_001).count() <= 10_000 else few, F.expr("company like pattern"))
    return patterns.join(hits, "pattern").select("item_id", "owner", "overrides").distinct()


def backfill(tree: DataFrame, stored: DataFrame, read) -> DataFrame:
    """(blob, text) of the blobs of indexed commits whose text isn't stored yet; `read` brings (blob, text) for a tree of them."""
    return read(tree.join(stored.select("blob").distinct(), "blob", "left_anti").dropDuplicates(["blob"])).filter(~F.col("text").contains("\0"))


def frames(events: DataFrame) -> Column:
    """Each event as the lines of a server-sent one: its type, and its members that aren't null as JSON."""
    rest = [c for c in events.columns if c not in ("run", "seq")]
    return F.concat(F.lit("event: "), F.col("type"), F.lit("\ndata: "), F.to_json(F.struct(*rest)), F.lit("\n\n"))


def sent(events: DataFrame, role: str) -> DataFrame:
    """(run, seq, frame): what goes out of each run to a reader of a role; seq orders a run's events."""
    seen = filter_events(events, role)
    return seen.select("run", "seq", frames(seen).alias("frame"))


def event_sink(events: DataFrame, role: str, target: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream of events as one role may see them, a folder a run, and stops when all that is there is written."""
    return sent(events, role).writeStream.format("json").partitionBy("run").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def report_lines(results: DataFrame, title: str) -> DataFrame:
    """(at, line) of a report in Markdown: totals by group, then the questions that failed with the checks they failed on.

    results: id, grp, passed, seconds, failed (checks).
    """
    head = results.agg(F.count_if("passed").alias("p"), F.count(F.lit(1)).alias("n"), F.round(F.percentile("seconds", F.lit(0.5)), 1).alias("m"))
    top = head.select(F.lit("0").alias("at"), F.format_string(f"# {title}: %d of %d passed, median %s s", "p", "n", F.col("m").cast("string")).alias("line"))
    per = results.groupBy("grp").agg(F.count_if("passed").alias("p"), F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("1 "), "grp").alias("at"), F.format_string("| %s | %d | %d |", "grp", "p", "n").alias("line"))
    bad = results.filter(~F.col("passed")).select(F.concat(F.lit("2 "), F.lpad(F.col("id").cast("string"), 12, "0")).alias("at"), F.concat(F.lit("- "), F.col("id").cast("string"), F.lit(": "), F.array_join("failed", ", ")).alias("line"))
    return top.union(per).union(bad)


def write_report(results: DataFrame, title: str, target: str) -> None:
    """The results as JSON lines, and the report as one text file beside them."""
    results.write.mode("overwrite").json(f"{target}/results")
    # a line a group and a failed question of one evaluation run
    report_lines(results, title).coalesce(1).sortWithinPartitions("at").select("line").write.mode("overwrite").text(f"{target}/report")
