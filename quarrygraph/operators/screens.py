"""Linking screens to code: owners of files by longest prefix and by imports, and clicks by the nearest line above."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: how many lines above a navigation its click may stand, and how many imports away an owner may be
CLICK_LINES, IMPORT_HOPS = 80, 2


def by_longest_prefix(files: DataFrame, folders: DataFrame, separators: str = r"[/.]") -> DataFrame:
    """(path, owner): for each file the owner of the longest folder that its path lies in, ties to the least owner.

    A path is spread over its own prefixes at separators, and these are joined by equality: no pair of a file
    and a folder is compared. files: path; folders: folder, owner.
    """
    ends = F.array_append(F.regexp_extract_all("path", F.lit(separators), F.lit(0)), F.lit(""))
    parts = F.split("path", separators)
    start = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.aggregate(F.slice(F.zip_with(parts, ends, lambda p, e: F.struct(p.alias("p"), e.alias("e"))), F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x["p"]) + F.length(x["e"])))
    prefixes = files.select("path", F.explode(start).alias("n"), ends.alias("ends")).select("path", F.expr("regexp_replace(substring(path, 1, n), '[/.]$', '')").alias("folder")).distinct()
    found = prefixes.join(folders.select("folder", "owner"), "folder")
    return found.groupBy("path").agg(F.min_by("owner", F.struct(-F.length("folder"), "owner")).alias("owner"))


def owners(files: DataFrame, folders: DataFrame, imports: DataFrame, hops: int = IMPORT_HOPS) -> DataFrame:
    """(path, owner, hops): owners by folder; a file outside all folders belongs to that of a file that imports it, few hops away.

    imports: path, imported. Of several importers with an owner the least owner is taken.
    """
    known = by_longest_prefix(files, folders).withColumn("hops", F.lit(0))
    left = files.select("path").distinct()
    for h in range(1, hops + 1):
        rest = left.join(known.select("path"), "path", "left_anti")
        reached = imports.select(F.col("path").alias("importer"), F.col("imported").alias("path")).join(rest, "path", "left_semi")
        new = reached.join(known.select(F.col("path").alias("importer"), "owner"), "importer").groupBy("path").agg(F.min("owner").alias("owner")).withColumn("hops", F.lit(h))
        known = known.unionByName(new)
    return known


def nearest_above(targets: DataFrame, marks: DataFrame, by: str, line: str, within: int = CLICK_LINES) -> DataFrame:
    """Each target row with the mark of its file that stands nearest above it, or on its line, not further than `within` lines.

    Both tables are laid in one order by file and line, in which the last mark so far is carried along: an as-of
    join without pairs. targets: by, line, target; marks: by, line, mark.
    """
    rows = marks.select(by, line, F.lit(0).alias("later"), F.col("mark"), F.lit(None).cast(dict(targets.dtypes)["target"]).alias("target")).unionByName(
        targets.select(by, line, F.lit(1).alias("later"), F.lit(None).cast(dict(marks.dtypes)["mark"]).alias("mark"), F.col("target"))
    )
    so_far = Window.partitionBy(by).orderBy(line, "later", "mark").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("later") == 0, F.struct(F.col(line).alias("at"), "mark")), ignorenulls=True).over(so_far)
    out = rows.withColumn("last", last).filter("later = 1")
    near = F.col(line) - F.col("last.at") <= within
    return out.select(by, line, "target", F.when(near, F.col("last.mark")).alias("mark"))


def navigation_edges(owned: DataFrame, navigations: DataFrame, clicks: DataFrame, screens: DataFrame) -> DataFrame:
    """NAVIGATES_TO edges (kind, src, dst, line, confidence): from a file's screen to where it goes, and from the click above.

    owned: path, owner; navigations: path, line, to; clicks: path, line, mark; screens: screen. A screen doesn't lead to itself.
    """
    from_screen = navigations.join(owned.select("path", "owner"), "path").join(screens.select(F.col("screen").alias("to")), "to", "left_semi").filter(F.col("owner") != F.col("to"))
    direct = from_screen.select(F.lit("NAVIGATES_TO").alias("kind"), F.col("owner").alias("src"), F.col("to").alias("dst"), "line", F.lit(0.8).alias("confidence"))
    clicked = nearest_above(from_screen.select("path", "line", F.col("to").alias("target")), clicks, "path", "line").filter("mark is not null")
    return direct.union(clicked.select(F.lit("NAVIGATES_TO"), "mark", "target", "line", F.lit(0.6))).distinct()


def routes_declared(text):
    """Facts of routes in source text: path and name of each route object."""
    found = F.regexp_extract_all(text, F.lit(r"path:\s*['\"]([^'\"]+)['\"][^}]*?name:\s*['\"]([^'\"]+)['\"]"), F.lit(0))
    value = lambda x, key: F.regexp_extract(x, key + r":\s*['\"]([^'\"]+)['\"]", 1)
    return F.transform(found, lambda x: F.concat_ws(" ", value(x, "path"), value(x, "name")))


def imports_of(text):
    """Facts of modules that source text imports."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:from|import|require\()\s*['\"]([^'\"]+)['\"]"), F.lit(1)))
