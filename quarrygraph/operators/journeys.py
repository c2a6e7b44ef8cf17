"""Journeys across screens in the order that a question names them: legs between screens, joined to one route.

Shortest paths from the screens asked for are found once, for all questions together; legs are then joined on, one
place of the questions' orders at a time, so a step is one join over a row a question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import trace

#: fixed values: the most screens that a question takes, the nodes of a leg between two of them, and the hops of any path
MOST_SCREENS, LEG_NODES, MOST_HOPS = 8, 4, 6


def routes(links: DataFrame, asked: DataFrame) -> DataFrame:
    """(item_id, path, covered) of the questions whose first screen leads to their last.

    links: src, dst; asked: item_id, position, node, in the order of the question. A screen between the first and the last is
    taken in if it can still reach the last, isn't on the route yet, and lies at most LEG_NODES nodes on, the
    present one counted; others are passed over. The last leg goes to the last screen.
    """
    asked = asked.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy("position"))).filter(F.col("n") <= MOST_SCREENS)
    ends = asked.groupBy("item_id").agg(F.min_by("node", "n").alias("begin"), F.max_by("node", "n").alias("end"), F.count(F.lit(1)).alias("n")).filter("n > 1 and begin <> end")
    found = cut(trace.shortest_paths(links, asked.select("node").distinct(), MOST_HOPS).filter("hops > 0").select("start", F.col("node").alias("to"), F.col("path").alias("leg")))
    middle = asked.join(ends.select("item_id", "begin", "end"), "item_id").filter("node <> begin and node <> end")
    middle = middle.join(found.select("start", "to"), (F.col("node") == F.col("start")) & (F.col("end") == F.col("to")), "left_semi")
    middle = cut(middle.groupBy("item_id", "node").agg(F.min("n").alias("n")).withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy("n"))).select(F.col("item_id").alias("m_item"), F.col("node").alias("next"), "k"))
    legs = found.select(F.col("start").alias("l_start"), F.col("to").alias("l_to"), "leg")
    state = ends.select("item_id", "end", F.array("begin").alias("path"), F.col("begin").alias("at"))
    for k in range(1, MOST_SCREENS - 1):
        step = state.join(middle.filter(F.col("k") == k).drop("k"), F.col("item_id") == F.col("m_item"), "left")
        step = step.join(legs, (F.col("at") == F.col("l_start")) & (F.col("next") == F.col("l_to")) & (F.size("leg") <= LEG_NODES) & ~F.array_contains("path", F.col("next")), "left")
        on = F.col("leg").isNotNull()
        state = step.select("item_id", "end", F.when(on, F.concat("path", F.slice("leg", F.lit(2), F.size("leg")))).otherwise(F.col("path")).alias("path"), F.when(on, F.col("next")).otherwise(F.col("at")).alias("at"))
    last = state.join(legs, (F.col("at") == F.col("l_start")) & (F.col("end") == F.col("l_to")))
    whole = cut(last.select("item_id", F.concat("path", F.slice("leg", F.lit(2), F.size("leg"))).alias("path")))
    met = whole.select("item_id", F.explode("path").alias("node")).join(asked.select("item_id", "node").distinct(), ["item_id", "node"]).groupBy("item_id").agg(F.count(F.lit(1)).alias("covered"))
    return whole.join(met, "item_id")


def hops(paths: DataFrame, screens: DataFrame, clicks: DataFrame) -> DataFrame:
    """(item_id, hop, from_screen, to_screen, click): the screens of each route by name, and what is clicked between them.

    screens: node, name; clicks: src, dst, mark. Entries of one name in a row are one screen, the first; several marks of
    a way are told together, by name; a way without any has none.
    """
    steps = paths.select("item_id", F.posexplode("path").alias("at", "node")).join(screens.select("node", "name"), "node")
    order = Window.partitionBy("item_id").orderBy("at")
    seen = steps.withColumn("before", F.lag("name").over(order)).filter(~F.col("name").eqNullSafe(F.col("before")) | F.col("before").isNull())
    pairs = seen.withColumn("next", F.lead("node").over(order)).withColumn("to_screen", F.lead("name").over(order)).withColumn("hop", F.row_number().over(order)).filter("next is not null")
    marks = clicks.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_set("mark")), " / ").alias("click"))
    return pairs.join(marks, (F.col("node") == F.col("src")) & (F.col("next") == F.col("dst")), "left").select("item_id", "hop", F.col("name").alias("from_screen"), "to_screen", "click")
