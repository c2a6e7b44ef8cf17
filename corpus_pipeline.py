"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, mixing.

Each stage takes the documents its predecessor kept. All but the last return the columns of
documents; the last returns a row for each copy that the mixture takes, with copy, shard and
shuffle_key beside the document's columns. Stages keep rows of null or empty text, except that a
text all of whose lines repeat earlier ones goes with its document. Rows repeated whole or of one doc_id are near
duplicates, of which one document stays; texts of any length go through every stage whole; an empty table
gives no rows, with the columns of the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm import decontaminate, jaccard_join, line_dedup, mixing, toxicity
from quarrygraph.llm.common import table


#: Words from which on a repeated line goes from the texts of the corpus.
LINE_WORDS = 25


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among them, doesn't reject."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: five words a shingle, similarity 0.8.

    Rows of one doc_id are one document and stay or go together; documents without words and rows
    of null ids are in no group and all stay.
    """
    groups = jaccard_join.jaccard_components(docs, width=5, percent=80)
    gone = groups.filter("n_shingles > 0 and doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines and passages that stand earlier; texts left blank go.

    Repeated lines of fewer than LINE_WORDS words are left alone here: a text that shares no more than
    a short line with others is a clean one, and stays as it is. (The operator and its query take them too.)
    """
    return line_dedup.without_repeats(docs, min_words=LINE_WORDS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of what is left, by the default weights."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_similar),
    ("substring_dedup", drop_repeats),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: Models, edit distances and random draws are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
