"""Facts of source code found by lines and characters: declarations with their owners, and HTTP calls whatever their argument.

Both take (blob, text) of distinct blobs and stay within the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: words that may stand before a method, and the verbs of a call
MODIFIERS = "private|protected|public|private_class_method|memoize|memoized|sig"
VERBS = "GET|POST|PUT|PATCH|DELETE"
#: how sure a call site is whose path can be read, and one whose path cannot
READ, UNREAD = 0.95, 0.4
#: characters behind a call in which its argument's end is looked for first; what is longer is looked at whole
NEAR, WINDOW = 80, 400


def lines(texts: DataFrame) -> DataFrame:
    """(blob, line, content, indent) of the lines that are neither blank nor comments."""
    rows = texts.select("blob", F.posexplode(F.split("text", "\n")).alias("n", "content"))
    rows = rows.select("blob", (F.col("n") + 1).alias("line"), F.rtrim("content").alias("content"))
    return rows.filter(~F.trim("content").rlike("^(#|$)")).withColumn("indent", F.length("content") - F.length(F.ltrim("content")))


def declarations(texts: DataFrame) -> DataFrame:
    """(blob, line, kind, name, owner, superclass) of classes, modules and methods, nested by indentation.

    A class is open from its line to the first `end` at its own indentation, and no longer than what it stands in. For a
    line and each lesser indentation of its file, the last class or `end` there, a window over the lines of that indentation,
    tells whether a class is open. Methods within `class << self`, or named after `self.`, are class methods; methods that
    nothing owns are left out.
    """
    c = F.col("content")
    kind = F.when(c.rlike(r"^\s*end\b"), "end").when(c.rlike(r"^\s*(class|module)\s+[A-Z]"), F.regexp_extract(c, r"^\s*(class|module)", 1)).when(c.rlike(r"^\s*class\s*<<\s*self\b"), "own")
    method = rf"^\s*(?:(?:{MODIFIERS})\s+)*def\s+(self\.)?([\w?!=<>+\-*/%\[\]~^&|]+)"
    kind = kind.when(c.rlike(method), "method")
    marks = lines(texts).withColumn("kind", kind).filter("kind is not null").select(
        "blob", "line", "indent", "kind", F.when(F.col("kind") == "method", F.regexp_extract(c, method, 2)).otherwise(F.regexp_extract(c, r"^\s*(?:class|module)\s+([A-Z][\w:]*)", 1)).alias("name"),
        F.when(F.col("kind") == "method", F.regexp_extract(c, method, 1) != "").alias("of_self"), F.nullif(F.regexp_extract(c, r"^\s*class\s+[\w:]+\s*<\s*([\w:]+)", 1), F.lit("")).alias("superclass"), c.rlike(r";\s*end$").alias("closed"),
    )
    frames = marks.filter("kind <> 'method' and not closed")
    levels = frames.filter("kind <> 'end'").groupBy("blob").agg(F.array_sort(F.collect_set("indent")).alias("levels"))  # few a file
    asking = marks.filter("kind <> 'end' and kind <> 'own'").join(levels, "blob", "left")
    lower = F.filter(F.coalesce("levels", F.array().cast("array<int>")), lambda i: i < F.col("indent"))
    probes = asking.select("blob", "line", F.explode(lower).alias("level"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("name"))
    events = frames.select("blob", "line", F.col("indent").alias("level"), "kind", "name").union(probes)
    before = Window.partitionBy("blob", "level").orderBy("line", F.col("kind").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind").isNotNull(), F.struct(F.col("line").alias("at"), "kind", "name")), ignorenulls=True).over(before)
    met = events.withColumn("last", last).filter("kind is null and last is not null")
    nest = met.groupBy("blob", "line").agg(F.array_sort(F.collect_list(F.struct("level", "last.at", "last.kind", "last.name"))).alias("nest"))
    # what begins later at a lesser indentation has closed what stands deeper
    standing = F.filter("nest", lambda f: (f["kind"] != "end") & ~F.exists("nest", lambda o: (o["level"] < f["level"]) & (o["at"] > f["at"])))
    owned = asking.drop("levels").join(nest.select("blob", "line", standing.alias("nest")), ["blob", "line"], "left")
    held = F.filter(F.coalesce("nest", F.array().cast("array<struct<level:int,at:int,kind:string,name:string>>")), lambda f: f["kind"] != "own")
    owner = F.array_join(F.transform(held, lambda f: f["name"]), "::")
    single = F.coalesce(F.col("of_self") | F.exists("nest", lambda f: f["kind"] == "own"), F.col("of_self"))
    rows = owned.withColumn("owner", owner)
    name = F.when(F.col("kind") != "method", F.concat_ws("::", F.nullif("owner", F.lit("")), "name")).otherwise(F.concat("owner", F.when(single, ".").otherwise("#"), "name"))
    told = F.when((F.col("kind") == "method") & single, "class_method").otherwise(F.col("kind"))
    return rows.filter("kind <> 'method' or owner <> ''").select("blob", "line", told.alias("kind"), name.alias("name"), F.when(F.col("kind") == "method", F.col("owner")).alias("owner"), "superclass")


def declares(found: DataFrame) -> DataFrame:
    """(blob, src, dst) edges from each class or module to the methods it declares; both ends are in the same blob."""
    owners = found.filter("owner is null").select("blob", F.col("name").alias("owner")).distinct()
    return found.filter("owner is not null").join(owners, ["blob", "owner"]).select("blob", F.concat(F.lit("be:sym:"), "owner").alias("src"), F.concat(F.lit("be:sym:"), "name").alias("dst")).distinct()


def argument(text: Column) -> Column:
    """What stands before the comma or bracket that ends the first argument of a text that begins within a call; null if nothing does.

    Characters are folded one by one: brackets count up and down, those within quotes don't, and what a backslash escapes is passed over.
    """
    state = F.struct(F.lit(1).alias("depth"), F.lit("").alias("quote"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

    def step(s: Column, c: Column) -> Column:
        quoted = s["quote"] != ""
        marks = c.isin('"', "'", "`")
        depth = s["depth"] + F.when(quoted, 0).when(c.isin("(", "[", "{"), 1).when(c.isin(")", "]", "}"), -1).otherwise(0)
        quote = F.when(quoted & ~s["escaped"] & (c == s["quote"]), "").when(~quoted & marks, c).otherwise(s["quote"])
        ends = ~quoted & ((depth == 0) | ((c == ",") & (s["depth"] == 1)))
        return F.when(s["end"] >= 0, s).otherwise(F.struct(depth.alias("depth"), quote.alias("quote"), (quoted & ~s["escaped"] & (c == "\\")).alias("escaped"), (s["at"] + 1).alias("at"), F.when(ends, s["at"]).otherwise(-1).alias("end")))

    end = F.aggregate(F.split(text, ""), state, step, lambda s: s["end"])
    return F.element_at(F.transform(F.array(end), lambda e: F.when(e >= 0, F.substring(text, F.lit(1), e))), 1)


def shape(raw: Column) -> Column:
    return F.when(raw.startswith("`"), "TEMPLATE").when(raw.startswith('"') | raw.startswith("'"), "LITERAL").when(raw.rlike(r"^[A-Za-z_$][\w$]*$"), "IDENTIFIER").otherwise("OTHER")


def call_sites(texts: DataFrame, wrapper: str = "promisifiedXHR") -> DataFrame:
    """(blob, line, col, method, shape, raw, path_template, confidence, resolution) of every call of an HTTP wrapper.

    A literal or template tells its path, with * for what is put in; any other argument leaves the site unresolved,
    and it stays as such. The second argument tells the verb. A call whose argument doesn't end is none.
    """
    call = rf"{wrapper}\s*\("
    pieces = texts.select("blob", F.regexp_extract_all("text", F.lit(f"({call})")).alias("calls"), F.split("text", call, -1).alias("parts"))
    rows = pieces.select("blob", "calls", "parts", F.posexplode("calls").alias("n", "call"))
    rows = rows.select("blob", "n", "call", F.get("parts", F.col("n")).alias("before"), F.slice("parts", F.col("n") + 2, F.size("parts")).alias("later"), F.slice("calls", F.col("n") + 2, F.size("calls")).alias("more"))
    # the text behind a call, other calls within it put back
    rest = F.array_join(F.zip_with("later", "more", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    order = Window.partitionBy("blob").orderBy("n")
    told = F.concat(F.coalesce(F.lag("call").over(order), F.lit("")), "before")  # from the last call's beginning to this one's
    rows = rows.withColumn("told", told).withColumn("rest", rest)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    line = 1 + F.sum(breaks(F.col("told"))).over(upto)
    since = F.sum(F.when(F.col("told").contains("\n"), 1).otherwise(0)).over(upto)
    rows = rows.withColumn("line", line).withColumn("row", since)
    col = F.sum(F.length(F.substring_index("told", "\n", -1))).over(Window.partitionBy("blob", "row").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    near = F.substring("rest", 1, WINDOW)
    rows = rows.withColumn("col", col).withColumn("arg", F.coalesce(argument(F.substring("rest", 1, NEAR)), argument(near), argument(F.col("rest")))).filter("arg is not null")
    rows = rows.withColumn("raw", F.regexp_replace("arg", r"^\s+|\s+$", "")).withColumn("shape", shape(F.col("raw")))
    inner = F.expr("substring(raw, 2, length(raw) - 2)")
    path = F.when(F.col("shape") == "LITERAL", inner).when(F.col("shape") == "TEMPLATE", F.regexp_replace(inner, r"\$\{[^}]*\}", "*"))
    behind = F.expr(f"substring(rest, length(arg) + 1, {WINDOW})")
    verb = F.nullif(F.upper(F.regexp_extract(behind, rf"(?i)^,\s*[\"']({VERBS})[\"']", 1)), F.lit(""))
    read = F.col("path_template").isNotNull()
    rows = rows.withColumn("path_template", path)
    return rows.select("blob", F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"), verb.alias("method"), "shape", F.substring("raw", 1, 200).alias("raw"), "path_template",
        F.when(read, READ).otherwise(UNREAD).alias("confidence"), F.when(read, "EXACT").otherwise("AMBIGUOUS").alias("resolution"))


def targets(sites: DataFrame, tree: DataFrame, normal) -> DataFrame:
    """(src, dst, line, confidence) edges from the resolved sites of a commit's files to endpoints; `normal` makes a path a path family."""
    placed = tree.join(sites.filter("path_template is not null"), "blob")
    return placed.select(F.concat(F.lit("fe:"), "path", F.lit("#L"), "line").alias("src"), F.concat_ws(" ", F.coalesce("method", F.lit("ANY")), normal(F.col("path_template"))).alias("dst"), "line", "confidence")
