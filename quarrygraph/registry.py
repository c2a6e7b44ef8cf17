"""Every registered query of the library with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import answers, catalog, code, concepts, retrieval, rounds, streams

assert answers.SQL is catalog.SQL is code.SQL is concepts.SQL is retrieval.SQL is rounds.SQL is streams.SQL  # registered by import

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.flagship(spark, sf_dir)
