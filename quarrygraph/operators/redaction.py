"""What a role may see of nested facts: a walk over the schema of any depth writes one expression a column.

Where a struct has a `kind`, rows of kinds that the role may not see are null, and leave the list that holds them; members
that tell places in code are left out for roles that see none, in structs and in maps; every text is scrubbed of
paths and, for roles that see no names of code, of those as well. A role that sees all gets its facts unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from .assistant import BUSINESS_KINDS, ENDPOINT_KINDS, ROLES, scrub

#: fixed values: members that tell where something stands, and the endings and roots of paths
PLACES = ("path", "line", "start_line", "end_line", "blob_sha", "file", "paths", "site", "scope")
PATHS = r"`?(?:[\w.-]+/)+[\w.-]+\.(?:yaml|rake|json|jsx|tsx|mjs|erb|yml|sql|rb|js|ts|md)(?::\d+(?:-\d+)?)?`?|`?\b(?:app|src|lib|config|db|spec|test|uploads)/[\w./-]*[\w-]`?"


def hidden(kind: Column, policy: dict) -> Column:
    """Whether a role may not see entities of a kind; unknown kinds are code."""
    endpoint, business = kind.isin(*ENDPOINT_KINDS), kind.isin(*BUSINESS_KINDS)
    return kind.isNotNull() & ~business & F.when(endpoint, not policy["endpoints"]).otherwise(not policy["code_names"])


def _text(value: Column, policy: dict) -> Column:
    plain = value if policy["paths"] else F.regexp_replace(value, PATHS, "a file")
    return plain if policy["code_names"] else scrub(plain)


def _seen(value: Column, kind: DataType, policy: dict) -> Column:
    """The part of a value that a role may see."""
    if isinstance(kind, StringType):
        return _text(value, policy)
    if isinstance(kind, StructType):
        kept = [f for f in kind if policy["paths"] or f.name not in PLACES]
        # a kind is what decides, so it is not scrubbed itself
        members = [(value[f.name] if f.name == "kind" and isinstance(f.dataType, StringType) else _seen(value[f.name], f.dataType, policy)).alias(f.name) for f in kept]
        told = any(f.name == "kind" and isinstance(f.dataType, StringType) for f in kind)
        gone = value.isNull() | hidden(value["kind"], policy) if told else value.isNull()
        return F.when(~gone, F.struct(*members)) if members else F.lit(None)
    if isinstance(kind, ArrayType):
        out = F.transform(value, lambda x: _seen(x, kind.elementType, policy))
        return F.filter(out, lambda x: x.isNotNull()) if isinstance(kind.elementType, StructType) else out
    if isinstance(kind, MapType):
        shown = F.map_filter(value, lambda k, v: ~k.isin(*PLACES)) if isinstance(kind.keyType, StringType) and not policy["paths"] else value
        return F.transform_values(shown, lambda k, v: _seen(v, kind.valueType, policy))
    return value


def redact(facts: DataFrame, role: str) -> DataFrame:
    """The facts as a role may see them; rows whose own kind is hidden go."""
    policy = ROLES.get(role, ROLES["cs"])
    if policy["paths"] and policy["code_names"] and policy["endpoints"]:
        return facts
    rows = facts
    if "kind" in facts.columns:
        rows = rows.filter(~hidden(F.col("kind"), policy))
    kept = [f for f in facts.schema if policy["paths"] or f.name not in PLACES]
    return rows.select(*[(F.col(f.name) if f.name == "kind" else _seen(F.col(f.name), f.dataType, policy)).alias(f.name) for f in kept])
