"""Import of another knowledge base: its entities under the graph's names, its relations in the graph's directions.

Kinds are mapped, columns gathered by their table, and relations turned so that code leads to the defects that it triggers,
whichever way they were stored. Methods are tied to the classes that own them and handlers to the methods that they run.
Defects that nothing leads to are linked by the method that their title begins with, as a guess that says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: fixed values: (kind, prefix of the id, subkind) of each kind that is taken over; routes aren't, the graph's own are more complete
KINDS = {
    "method": ("SYMBOL", "be:sym:", "method"), "class_method": ("SYMBOL", "be:sym:", "class_method"), "class": ("SYMBOL", "be:sym:", "class"), "module": ("SYMBOL", "be:sym:", "module"), "ci_job": ("CI_JOB", "be:ci:", None),
    "workflow": ("FILE", "be:file:", "workflow"), "dockerfile": ("FILE", "be:file:", "dockerfile"), "api_response_template": ("FILE", "be:file:", "jbuilder"), "tool_definition": ("SYMBOL", "be:sym:mcp:", "mcp_tool"),
    "external_dependency": ("EXTERNAL_SERVICE", "be:external:", "github_action"), "observed_defect": ("OBSERVED_DEFECT", "be:defect:", None),
}
#: fixed values: confidence of relations seen at run time, of those told by name alone, and the pattern of a method in a title
SEEN, BRIDGED, GUESSED = 0.95, 0.95, 0.8
TITLE = r"^([A-Z][\w:]*[#.][\w?!]+)"


def _of(index: int) -> Column:
    """The part of KINDS at an index for the column `kind`; null for kinds that aren't taken over."""
    return F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[index])])[F.col("kind")]


def imported(entities: DataFrame) -> DataFrame:
    """(source_id, id, kind, subkind, name, owner, path, line, confidence, resolution) of the entities that are taken over; files go by path."""
    rows = entities.filter(F.col("kind").isin(*KINDS))
    name = F.when(_of(0) == "FILE", F.col("file_path")).otherwise(F.col("name"))
    owner = F.when(F.col("kind").isin("method", "class_method"), F.split("name", "[#.]")[0])
    return rows.select(F.col("id").alias("source_id"), F.concat(_of(1), name).alias("id"), _of(0).alias("kind"), _of(2).alias("subkind"), "name", owner.alias("owner"), F.col("file_path").alias("path"), F.col("line_start").alias("line"),
        F.lit(1.0).alias("confidence"), F.when(F.col("kind") == "observed_defect", "RUNTIME").otherwise("EXACT").alias("resolution"))


def columns_of_tables(entities: DataFrame) -> DataFrame:
    """(table, columns): the columns of each table by name, as (name, type)."""
    rows = entities.filter("kind = 'column' and table is not null").select("table", F.substring_index("name", ".", -1).alias("name"), F.col("column_type").alias("type"))
    return rows.groupBy("table").agg(F.array_sort(F.collect_set(F.struct("name", "type"))).alias("columns"))


def relations(taken: DataFrame, stored: DataFrame) -> DataFrame:
    """(kind, src, dst, confidence, resolution) of stored (from_id, to_id, rel_type) both of whose ends are taken over; each once."""
    ends = lambda side: taken.select(F.col("source_id").alias(f"{side}_source"), F.col("id").alias(side), F.col("kind").alias(f"{side}_kind"))
    both = stored.join(ends("a"), F.col("from_id") == F.col("a_source")).join(ends("b"), F.col("to_id") == F.col("b_source"))
    call, need = F.col("rel_type") == "calls", F.col("rel_type") == "depends_on"
    turned = ~call & ~need & (F.col("a_kind") == "OBSERVED_DEFECT")
    kind = F.when(call, "CALLS").when(need, "USES_SERVICE").otherwise("TRIGGERS_DEFECT")
    return both.select(kind.alias("kind"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("dst"),
        F.when(call, SEEN).otherwise(1.0).alias("confidence"), F.when(need, "EXACT").otherwise("RUNTIME").alias("resolution")).distinct()


def owned(taken: DataFrame) -> DataFrame:
    """DECLARES edges from each class or module to its methods."""
    classes = taken.filter("subkind in ('class', 'module')").select(F.col("name").alias("c_name"), F.col("id").alias("src")).distinct()
    return taken.filter("owner is not null").join(classes, F.col("owner") == F.col("c_name")).select(F.lit("DECLARES").alias("kind"), "src", F.col("id").alias("dst"), F.lit(1.0).alias("confidence"), F.lit("EXACT").alias("resolution")).distinct()


def controller_class(controller: Column | str) -> Column:
    """`api/v1/trade_orders` as `Api::V1::TradeOrdersController`."""
    c = F.col(controller) if isinstance(controller, str) else controller
    camel = lambda part: F.array_join(F.transform(F.split(part, "_"), F.initcap), "")
    return F.concat(F.array_join(F.transform(F.split(c, "/"), camel), "::"), F.lit("Controller"))


def bridged(handlers: DataFrame, taken: DataFrame) -> DataFrame:
    """DECLARES edges from handlers (id, controller, action) to the methods that they run; handlers without one have none."""
    symbol = F.concat(F.lit("be:sym:"), controller_class("controller"), F.lit("#"), F.col("action"))
    methods = taken.filter("kind = 'SYMBOL'").select(F.col("id").alias("dst")).distinct()
    return handlers.select(F.col("id").alias("src"), symbol.alias("dst")).join(methods, "dst", "left_semi").select(F.lit("DECLARES").alias("kind"), "src", "dst", F.lit(BRIDGED).alias("confidence"), F.lit("EXACT").alias("resolution")).distinct()


def orphans_linked(taken: DataFrame, edges: DataFrame) -> DataFrame:
    """TRIGGERS_DEFECT edges to the defects that no edge leads to, from the method that the title names first, if there is one."""
    met = edges.filter("kind = 'TRIGGERS_DEFECT'").select(F.col("dst").alias("id")).distinct()
    title = F.regexp_extract("name", TITLE, 1)
    lone = taken.filter("kind = 'OBSERVED_DEFECT'").join(met, "id", "left_anti").filter(title != "").select(F.concat(F.lit("be:sym:"), title).alias("src"), F.col("id").alias("dst"))
    symbols = taken.filter("kind = 'SYMBOL'").select(F.col("id").alias("src")).distinct()
    return lone.join(symbols, "src", "left_semi").select(F.lit("TRIGGERS_DEFECT").alias("kind"), "src", "dst", F.lit(GUESSED).alias("confidence"), F.lit("HEURISTIC").alias("resolution")).distinct()


def import_edges(entities: DataFrame, stored: DataFrame, handlers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities taken over, all edges of the import)."""
    taken = imported(entities)
    told = relations(taken, stored)
    return taken, told.union(owned(taken)).union(bridged(handlers, taken)).union(orphans_linked(taken, told))


