"""Read-only SQL over named tables: one query, walked as a parsed tree before it runs, with a cap that tells when it bites."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CAP = 200
#: fixed values: columns that hold ids of entities, and how many of them get evidence
ID_COLUMNS = ("id", "entity_id", "src_entity_id", "dst_entity_id", "subject_id")
MOST_EVIDENCE = 80
#: the functions that a query may call: aggregates, windows, text, dates, numbers, arrays, maps and JSON; none runs code or reads files
ALLOWED = frozenset(
    "count sum avg mean min max min_by max_by any_value first last first_value last_value count_if bool_and bool_or every some median mode percentile approx_percentile percentile_approx approx_count_distinct "
    "stddev stddev_samp stddev_pop variance var_samp var_pop corr collect_list collect_set array_agg listagg string_agg row_number rank dense_rank percent_rank cume_dist ntile lag lead nth_value grouping "
    "lower upper length char_length octet_length trim ltrim rtrim btrim substr substring left right concat concat_ws replace translate split split_part regexp_extract regexp_extract_all regexp_replace regexp_like "
    "regexp_count rlike like ilike contains startswith endswith instr locate position lpad rpad repeat reverse initcap ascii chr md5 sha1 sha2 crc32 hex format_string "
    "coalesce nullif nvl ifnull if iff greatest least isnull isnotnull isnan abs round bround floor ceil ceiling sign sqrt exp ln log log2 log10 power pow mod pmod div "
    "date_trunc date_add date_sub datediff date_diff dateadd date_format to_date to_timestamp year month day dayofmonth dayofweek hour minute second quarter unix_timestamp current_date current_timestamp now make_date interval "
    "array size cardinality array_contains element_at explode posexplode sort_array array_distinct struct named_struct map map_keys map_values get_json_object from_json to_json cast try_cast string int bigint double date timestamp boolean decimal between extract date_part regexp overlay any all not".split()
)


def _each(sequence: JavaObject) -> Iterator[JavaObject]:
    iterator = sequence.iterator()
    while iterator.hasNext():
        yield iterator.next()


#: what a class of nodes is: an operator, an expression that holds a query, or any other expression
PLAN, QUERY = "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan", "org.apache.spark.sql.catalyst.expressions.PlanExpression"


def _tree(plan: JavaObject) -> Iterator[tuple[str, JavaObject]]:
    """(class name, node) of a parsed plan: its operators, their expressions, and the queries within them."""
    todo, kinds = [plan], {}
    while todo:
        node = todo.pop()
        of = node.getClass()
        name = of.getSimpleName()
        if name not in kinds:
            kinds[name] = None
            while of is not None and kinds[name] is None:
                kinds[name] = of.getName() if of.getName() in (PLAN, QUERY) else None
                of = of.getSuperclass()
        yield name, node
        todo.extend(_each(node.children()))
        if kinds[name] == PLAN:
            todo.extend(_each(node.expressions()))
            if name == "UnresolvedWith":
                todo.extend(pair._2() for pair in _each(node.cteRelations()))
        elif kinds[name] == QUERY:
            todo.append(node.plan())


def used(spark: SparkSession, sql: str) -> tuple[set[tuple[str, ...]], set[str], set[str]]:
    """(tables by the parts of their names, functions, names defined by WITH) of one query, in lower case; ValueError if it is no single query."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parseQuery(sql)
    except Exception as e:  # the gateway wraps the parser's error
        raise ValueError(f"refused: not a single query ({str(e).splitlines()[0][:120]})") from (None if isinstance(e, Py4JError) else e)
    tables, functions, made = set(), set(), set()
    for name, node in _tree(plan):
        if name == "UnresolvedRelation":
            tables.add(tuple(p.lower() for p in _each(node.multipartIdentifier())))
        elif name == "UnresolvedFunction":
            functions.add(".".join(p.lower() for p in _each(node.nameParts())))
        elif name == "UnresolvedTableValuedFunction":
            functions.add(".".join(p.lower() for p in _each(node.name())))
        elif name == "UnresolvedGenerator":
            functions.add(node.name().funcName().lower())
        elif name == "UnresolvedWith":
            made.update(pair._1().lower() for pair in _each(node.cteRelations()))
        elif name in ("UnresolvedTable", "UnresolvedTableOrView", "UnresolvedIdentifier", "PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier", "ScriptTransformation"):
            functions.add(f"<{name}>")
    return tables, functions, made


def read_only(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame] | None = None) -> str:
    """The statement if it is one query that calls allowed functions only, over the tables given if any; ValueError otherwise.

    Spark's parser has a rule for queries, which admits SELECT, WITH, VALUES and set operations and nothing that changes
    anything. The tree that it gives is walked whole, so quoting, comments, capitals, nesting and width make no difference.
    """
    text = sql.strip()
    text = text[:-1] if text.endswith(";") else text
    relations, functions, made = used(spark, text)
    unsafe = sorted(functions - ALLOWED)
    if unsafe:
        raise ValueError(f"refused: function {unsafe[0]} is not allowed")
    if tables is not None:
        known = {n.lower() for n in tables} | made
        unknown = sorted(".".join(r) for r in relations if len(r) > 1 or r[0] not in known)
        if unknown:
            raise ValueError(f"refused: unknown table {unknown[0]}")
    return text


def run_sql(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], cap: int = CAP) -> DataFrame:
    """The rows of a read-only query over the tables, and one more than the cap if it bites.

    The tables are bound by names of their own, so a caller's views of the same names are neither seen nor touched.
    """
    text = read_only(spark, sql, tables)
    own = {name: f"asked_{uuid.uuid4().hex}" for name in tables}
    for name, view in own.items():
        tables[name].createOrReplaceTempView(view)
    try:
        bound = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in own.items())
        return spark.sql(f"{f'WITH {bound} ' if bound else ''}SELECT * FROM (\n{text}\n)").limit(cap + 1)
    finally:
        for view in own.values():
            spark.catalog.dropTempView(view)


def capped(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """One row: how many rows are shown, and whether there are more."""
    n = rows.limit(cap + 1).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.least("n", F.lit(cap)).cast("long").alias("row_count"), (F.col("n") > cap).alias("capped"))


def cited(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Where the entities stand whose ids a result holds, in whatever id column, up to MOST_EVIDENCE of them."""
    columns = [c for c in rows.columns if c in ID_COLUMNS]
    if not columns:
        return entities.select("id", "kind", "repo", "path").limit(0)
    ids = rows.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("id")).filter("id is not null").distinct().orderBy("id").limit(MOST_EVIDENCE)
    return entities.join(ids, "id", "left_semi").select("id", "kind", "repo", "path")
