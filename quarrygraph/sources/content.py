"""Content-addressed ingestion: git trees, blobs, extraction once a distinct blob, complete snapshots."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.texts import SECRET_PATH
from ..operators.versions import cache_misses

LARGEST = 512 * 1024


def git_tree(spark: SparkSession, repository: str, ref: str, folders: int = 64) -> DataFrame:
    """(path, blob, size) of a ref's files. Tasks list the tree by top-level entry, each streaming its own listing.

    The repository is read by path in the tasks, so it has to lie on a file system that all machines share.
    """
    top = subprocess.run(["git", "-C", repository, "ls-tree", "--name-only", "-z", ref], check=True, capture_output=True).stdout.decode("utf-8", "replace")
    names = spark.createDataFrame([(n,) for n in filter(None, top.split("\0"))], "name string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name in pdf.name:
                with subprocess.Popen(["git", "-C", repository, "ls-tree", "-r", "-l", "-z", ref, "--", name], stdout=subprocess.PIPE) as listing:
                    rows, left = [], b""
                    while block := listing.stdout.read(1 << 20):
                        *entries, left = (left + block).split(b"\0")
                        for entry in entries:
                            meta, _, path = entry.decode("utf-8", "replace").partition("\t")
                            _, kind, blob, size = meta.split()
                            if kind == "blob":
                                rows.append((path, blob, int(size)))
                        yield pd.DataFrame(rows, columns=["path", "blob", "size"])
                        rows = []

    return names.repartition(min(folders, max(1, top.count("\0")))).mapInPandas(run, "path string, blob string, size long")


def git_texts(tree: DataFrame, repository: str) -> DataFrame:
    """(blob, text) of the distinct blobs of a tree, read in tasks one after another; binary content is left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with subprocess.Popen(["git", "-C", repository, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for pdf in frames:
                for blob in pdf.blob:
                    git.stdin.write(blob.encode() + b"\n")
                    git.stdin.flush()
                    size = int(git.stdout.readline().split()[2])
                    body = git.stdout.read(size)
                    git.stdout.read(1)
                    if b"\0" not in body:
                        yield pd.DataFrame({"blob": [blob], "text": [body.decode("utf-8", "replace")]})
            git.stdin.close()

    return tree.select("blob").distinct().mapInPandas(run, "blob string, text string")


def git_log(spark: SparkSession, log: DataFrame) -> DataFrame:
    """(person, at, path) of each touch, from rows (entry) of a log written as `--format=%x01%ae%x02%cI --name-only`, one commit a row."""
    parts = F.split("entry", "\n")
    head = F.split(F.regexp_replace(parts[0], "^\u0001", ""), "\u0002")
    paths = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != "")
    return log.select(F.lower(head[0]).alias("person"), F.to_timestamp(head[1]).alias("at"), F.explode(paths).alias("path"))


def indexable(tree: DataFrame) -> DataFrame:
    """Files small enough to index whose path is no secret."""
    return tree.filter((F.col("size") <= LARGEST) & ~F.col("path").rlike(SECRET_PATH))


def document_tree(documents: DataFrame) -> DataFrame:
    """Documents as files of commits: commit is the source, path the id, blob the hash of the text."""
    return documents.select(F.col("source").alias("commit"), F.col("doc_id").cast("string").alias("path"), F.sha1("text").alias("blob"), F.length("text").cast("long").alias("size"))


def blob_texts(documents: DataFrame) -> DataFrame:
    return documents.groupBy(F.sha1("text").alias("blob")).agg(F.first("text").alias("text"))


def new_facts(tree: DataFrame, texts: DataFrame, facts: DataFrame, extractor: str, version: str, extract) -> DataFrame:
    """(blob, extractor, version, fact) for blobs not seen before; `extract` maps the text column to an array of facts."""
    missing = texts.join(cache_misses(tree, facts, extractor, version), "blob", "left_semi")
    return missing.select("blob", F.lit(extractor).alias("extractor"), F.lit(version).alias("version"), F.explode(extract(F.col("text"))).alias("fact"))


def resolve(tree: DataFrame, facts: DataFrame) -> DataFrame:
    """(commit, path, fact): a complete snapshot from the facts of its blobs."""
    return tree.join(facts.select("blob", "fact"), "blob").select("commit", "path", "fact").distinct()


def call_sites(text):
    """Facts of HTTP calls in source text: verb and literal or template path, placeholders as *."""
    found = F.regexp_extract_all(text, F.lit(r"""(?i)\b(get|post|put|patch|delete)\(\s*['"`]([^'"`]+)['"`]"""), F.lit(0))
    verb = lambda x: F.upper(F.regexp_extract(x, r"(?i)\b(get|post|put|patch|delete)\(", 1))
    path = lambda x: F.regexp_replace(F.regexp_extract(x, r"""['"`]([^'"`]+)['"`]""", 1), r"\$\{[^}]*\}", "*")
    return F.transform(found, lambda x: F.concat_ws(" ", verb(x), path(x)))


def tables_created(text):
    """Facts of tables that a schema file creates."""
    return F.regexp_extract_all(text, F.lit(r"""create_table\s+[:"']([a-z_][a-z0-9_]*)"""), F.lit(1))


def external_hosts(text):
    """Facts of hosts that a text calls."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"https?://([a-z0-9.-]+\.[a-z]{2,})"), F.lit(1)))


def symbols(text):
    """Facts of classes and modules that source text declares."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:class|module)\s+([A-Z][A-Za-z0-9]*(?:::[A-Z][A-Za-z0-9]*)*)"), F.lit(1)))


def insert_new(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """The incoming rows, one a key, that the table lacks: an append that ignores what is there already.

    Of several incoming rows of a key the least as a whole is taken, so that a retry appends the same.
    """
    rest = [c for c in incoming.columns if c not in key]
    one = incoming.groupBy(*key).agg(F.min(F.struct(*rest)).alias("r")).select(*key, *[F.col("r")[c].alias(c) for c in rest]) if rest else incoming.distinct()
    return one.join(existing.select(*key).distinct(), key, "left_anti").select(incoming.columns)


def insert_edges(existing: DataFrame, incoming: DataFrame, entities: DataFrame) -> DataFrame:
    """New edges by (kind, src, dst, site) both of whose ends are entities of the graph; attributes are kept."""
    ids = entities.select("id").distinct()
    ends = incoming.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return insert_new(existing, ends.select(incoming.columns), ["kind", "src", "dst", "site"])
