"""Queries over mirrored operational tables: allowlisted columns, typed filters, exact totals."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import json_contains

LONGEST = 600


def conditions(allowed: Sequence[str], where: Mapping | None = None, like: Mapping | None = None, contains: Mapping | None = None, not_null: Sequence[str] = ()) -> Column:
    """The filter of a live query as a column; a column that isn't allowed is refused.

    where: equality as text, any of a list, or null. like: part of the text in any case; under
    "any" with columns and value, of one of several columns. contains: JSON containment.
    """

    def column(name: str) -> Column:
        if name not in allowed:
            raise ValueError(f"column {name} is not allowed")
        return F.col(name)

    parts: list[Column] = [F.lit(True)]
    for name, value in (where or {}).items():
        c = column(name)
        if value is None:
            parts.append(c.isNull())
        elif isinstance(value, (list, tuple)):
            parts.append(c.cast("string").isin([str(v) for v in value]))
        else:
            parts.append(c.cast("string") == str(value))
    for name, value in (like or {}).items():
        if name == "any":
            columns = [c for c in value["columns"] if c in allowed]
            if not columns:
                raise ValueError("like.any needs allowed columns")
            parts.append(reduce(lambda a, b: a | b, [F.lower(F.col(c).cast("string")).contains(str(value["value"]).lower()) for c in columns]))
        else:
            parts.append(F.lower(column(name).cast("string")).contains(str(value).lower()))
    for name, value in (contains or {}).items():
        parts.append(json_contains(column(name), value))
    parts += [column(name).isNotNull() for name in not_null]
    return reduce(lambda a, b: a & b, parts)


def query_live(table: DataFrame, allowed: Sequence[str], columns: Sequence[str] | None = None, limit: int = 50, order_by: str | None = None, cursor: str = "ts", key: str | None = None, **filters) -> DataFrame:
    """Allowed columns of the rows that pass, newest first, 1 to 500 of them; long texts are cut."""
    kept = [c for c in (columns or allowed) if c in allowed]
    if not kept:
        raise ValueError("no allowed columns requested")
    order = order_by if order_by in allowed else cursor
    rows = table.filter(conditions(allowed, **filters)).orderBy(F.desc(order), *([key] if key else []))
    types = dict(table.dtypes)
    cut = [F.when(F.length(c) > LONGEST, F.concat(F.substring(F.col(c), 1, LONGEST), F.lit("…"))).otherwise(F.col(c)).alias(c) if types[c] == "string" else F.col(c) for c in kept]
    return rows.limit(min(max(1, limit), 500)).select(*cut)


def live_total(table: DataFrame, allowed: Sequence[str], **filters) -> DataFrame:
    return table.filter(conditions(allowed, **filters)).agg(F.count(F.lit(1)).alias("total"))


#: fixed value: words of a question that asks for a whole set
WHOLE = r"(?i)\b(all|every|which|how many|list|each)\b"
LARGEST_SET = 500


def completed(question: str, table: DataFrame, allowed: Sequence[str], limit: int = 50, **options) -> DataFrame:
    """query_live for a question: one that asks for all rows gets them all, up to LARGEST_SET, where the limit would cut them."""
    filters = {k: v for k, v in options.items() if k in ("where", "like", "contains", "not_null")}
    if re.search(WHOLE, question) and limit < LARGEST_SET:
        held = table.filter(conditions(allowed, **filters)).limit(LARGEST_SET + 1).count()
        limit = LARGEST_SET if limit < held <= LARGEST_SET else limit
    return query_live(table, allowed, limit=limit, **options)


def freshness(table: DataFrame, by: str, cursor: str) -> DataFrame:
    """(by, rows_total, last_run) of each group."""
    return table.groupBy(by).agg(F.count(F.lit(1)).alias("rows_total"), F.max(cursor).alias("last_run"))


def dependent(first: DataFrame, second: DataFrame, on: tuple[str, str]) -> DataFrame:
    """Rows of the second query whose column stands in the first's: a semi join, whatever the size."""
    ids = first.select(F.col(on[0]).alias("dependency")).distinct()
    return second.join(ids, second[on[1]] == ids["dependency"], "left_semi")


def any_cell(table: DataFrame, text: str) -> DataFrame:
    """Rows one of whose cells holds a text, in any case."""
    return table.filter(F.lower(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in table.columns])).contains(text.lower()))
