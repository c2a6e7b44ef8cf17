"""Layered configuration: default, master by group, active override by owner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: keys that stand in one row while owners are spread over them
CHUNK = 1_000


def effective(owners: DataFrame, defaults: DataFrame, masters: DataFrame, overrides: DataFrame) -> DataFrame:
    """(owner, config_key, value, source) of each owner and key.

    owners: owner, grp. defaults: config_key, value. masters: grp, config_key, value.
    overrides: owner, config_key, value, active, at; of an owner's active overrides the latest
    counts, and a null value in it is a value. Every owner has every key.
    """
    w = Window.partitionBy("owner", "config_key").orderBy(F.desc("at"), F.desc("value"))
    last = overrides.filter("active").withColumn("n", F.row_number().over(w)).filter("n = 1").select("owner", "config_key", F.col("value").alias("o_value"), F.lit(True).alias("o"))
    # every owner has every key: an owner meets the keys by chunks of about CHUNK, so no row holds them all
    chunks = max(1, -(-defaults.count() // CHUNK))
    part = F.pmod(F.xxhash64("config_key"), F.lit(chunks)).cast("int")
    keys = defaults.groupBy(part.alias("chunk")).agg(F.collect_list(F.struct("config_key", F.col("value").alias("d_value"))).alias("keys"))
    rows = owners.select("owner", "grp", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")).join(keys, "chunk").select("owner", "grp", F.inline("keys"))
    rows = rows.join(masters.select("grp", "config_key", F.col("value").alias("m_value"), F.lit(True).alias("m")), ["grp", "config_key"], "left").join(last, ["owner", "config_key"], "left")
    value = F.when(F.col("o"), F.col("o_value")).when(F.col("m"), F.col("m_value")).otherwise(F.col("d_value"))
    source = F.when(F.col("o"), "override").when(F.col("m"), "master").otherwise("default")
    return rows.select("owner", "grp", "config_key", value.alias("value"), source.alias("source"))


def chosen(values: DataFrame, about: DataFrame, keys_like: str | None = None, keys: Sequence[str] | None = None, only: str | None = None) -> DataFrame:
    """The effective values of the keys asked for, by owner and key.

    about: config_key, name, description. `keys_like` is a part of any of the three, in any case; `keys` are whole ones; `only` is
    `on`, `off` or `overrides`, and anything else asks for all.
    """
    named = about.select("config_key", "name", "description")
    if keys_like is not None:
        text = keys_like.lower()
        named = named.filter(F.lower("config_key").contains(text) | F.coalesce(F.lower("name").contains(text), F.lit(False)) | F.coalesce(F.lower("description").contains(text), F.lit(False)))
    if keys is not None:
        named = named.filter(F.col("config_key").isin(list(keys)))
    wanted = {"on": F.lower("value").isin("true", "on"), "off": F.lower("value").isin("false", "off"), "overrides": F.col("source") == "override"}
    rows = values.filter(wanted[only]) if only in wanted else values
    return rows.join(named, "config_key").orderBy("owner", "config_key")


def agree_differ(values: DataFrame) -> DataFrame:
    """(config_key, owners, distinct_values, agrees) over the owners compared."""
    n = values.agg(F.countDistinct("owner").alias("all_owners"))
    per = values.groupBy("config_key").agg(F.count(F.lit(1)).alias("owners"), F.countDistinct("value").alias("distinct_values"))
    return per.crossJoin(F.broadcast(n)).select("config_key", "owners", "distinct_values", ((F.col("distinct_values") == 1) & (F.col("owners") == F.col("all_owners"))).alias("agrees"))


def owners_with(values: DataFrame, config_key: str, value: str) -> DataFrame:
    """How many owners have a switch at a value, of how many, and from which layer."""
    rows = values.filter(F.col("config_key") == config_key)
    hit = F.col("value") == value
    return rows.agg(F.count(F.lit(1)).alias("owners"), F.count_if(hit).alias("matching"), F.count_if(hit & (F.col("source") == "override")).alias("by_override"), F.count_if(hit & (F.col("source") == "master")).alias("by_master"))


def sample_owners(values: DataFrame, config_key: str, value: str, limit: int = 60) -> DataFrame:
    return values.filter((F.col("config_key") == config_key) & (F.col("value") == value)).orderBy("owner").select("owner", "source").limit(limit)


def resolve_owner(owners: DataFrame, counts: DataFrame, name: str, limit: int = 12) -> DataFrame:
    """Active owners whose name holds a text, those with most overrides first."""
    hit = owners.filter(F.col("active") & F.lower("name").contains(name.lower()))
    return hit.join(counts, "owner", "left").select("owner", "name", F.coalesce("overrides", F.lit(0)).alias("overrides")).orderBy(F.desc("overrides"), "owner").limit(limit)


def mentions(owners: DataFrame, questions: DataFrame, most_words: int = 4, limit: int = 6) -> DataFrame:
    """(item_id, owner): capitalised phrases of a question that begin an owner's name, six a question at most."""
    words = F.filter(F.split("text", r"[^A-Za-z0-9]+"), lambda w: w != "")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most_words)), lambda n: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: i + n - 1 <= F.size("w")), lambda i: F.array_join(F.slice("w", i, n), " "))))
    phrases = questions.withColumn("w", words).select("item_id", F.explode(F.array_distinct(F.filter(grams, lambda g: g.rlike("^[A-Z]")))).alias("phrase"))
    names = owners.select("owner", F.explode(F.transform(F.sequence(F.lit(1), F.lit(most_words)), lambda n: F.array_join(F.slice(F.split("name", r"[^A-Za-z0-9]+"), 1, n), " "))).alias("start")).distinct()
    found = phrases.join(names, F.lower("phrase") == F.lower("start")).select("item_id", "owner").distinct()
    w = Window.partitionBy("item_id").orderBy("owner")
    return found.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).drop("n")
