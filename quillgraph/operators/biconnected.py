"""Tags of a rooted spanning forest: first and last numbers of subtrees, what their edges reach, and the bridges that follow.

The forest is that of a breadth-first search from the least vertex of each component, so there are as many rounds as levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.components import connected_components
from quillgraph.operators.graph import symmetrise, union_all
from quillgraph.plans.cut import cut


def rooted_forest(e: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(vid, parent, root, level) for undirected edges (src, dst): the parent is the least neighbour one level up; roots are their own parents."""
    e = cut(symmetrise(e))
    roots = connected_components(e).where("vid = label")
    frontier = cut(roots.select("vid", F.col("vid").alias("parent"), F.col("vid").alias("root"), F.lit(0).cast("long").alias("level")))
    levels = [frontier]
    for level in range(1, max_rounds):
        step = frontier.select(F.col("vid").alias("src"), "root").join(e, "src").groupBy(F.col("dst").alias("vid")).agg(F.min("src").alias("parent"), F.min("root").alias("root"))
        for past in levels[-2:]:  # edges of an undirected graph lead no further than one level
            step = step.join(past.select("vid"), "vid", "left_anti")
        frontier = cut(step.select("vid", "parent", "root", F.lit(level).cast("long").alias("level")))
        if frontier.isEmpty():
            return union_all(levels)
        levels.append(frontier)
    raise RuntimeError("too many levels")


def tags(e: DataFrame) -> DataFrame:
    """(vid, parent, root, level, first, last, low, high) for undirected edges (src, dst), without self loops, repeats counted once.

    A subtree has the numbers first, ..., last of its root, in preorder, children in order of their ids; `low` and `high` are the least and
    largest number that an edge not of the forest leads to from within it, or its own.
    """
    e = cut(symmetrise(e))
    forest = cut(rooted_forest(e))
    depth = forest.agg(F.max("level")).first()[0]
    if depth is None:
        return forest.select("*", *(F.lit(0).cast("long").alias(c) for c in ("first", "last", "low", "high")))
    at = [forest.where(F.col("level") == k) for k in range(depth + 1)]
    sizes: list[DataFrame] = [None] * (depth + 1)
    for k in range(depth, -1, -1):
        own = at[k].select("vid", "parent")
        if k == depth:
            sizes[k] = cut(own.withColumn("n", F.lit(1).cast("long")))
        else:
            below = sizes[k + 1].groupBy(F.col("parent").alias("_p")).agg(F.sum("n").alias("_n"))
            sizes[k] = cut(own.join(below, F.col("vid") == F.col("_p"), "left").select("vid", "parent", (F.coalesce("_n", F.lit(0)) + 1).alias("n")))
    numbered = [sizes[0].select("vid", F.lit(0).cast("long").alias("first"), (F.col("n") - 1).alias("last"))]
    for k in range(1, depth + 1):
        earlier = F.sum("n").over(Window.partitionBy("parent").orderBy("vid")) - F.col("n")
        up = numbered[-1].select(F.col("vid").alias("_p"), F.col("first").alias("_f"))
        here = sizes[k].withColumn("_before", earlier).join(up, F.col("parent") == F.col("_p"))
        first = F.col("_f") + 1 + F.col("_before")
        numbered.append(cut(here.select("vid", first.alias("first"), (first + F.col("n") - 1).alias("last"))))
    number = cut(union_all(numbered))
    parent = forest.select("vid", "parent")
    other = e.join(parent.select(F.col("vid").alias("src"), F.col("parent").alias("_ps")), "src").join(parent.select(F.col("vid").alias("dst"), F.col("parent").alias("_pd")), "dst").where("_ps <> dst and _pd <> src")
    reach = other.join(number.select(F.col("vid").alias("dst"), "first"), "dst").groupBy(F.col("src").alias("vid")).agg(F.min("first").alias("a"), F.max("first").alias("b"))
    known = cut(forest.join(number, "vid").join(reach, "vid", "left").select("*", F.least("first", "a").alias("low"), F.greatest("first", "b").alias("high")).drop("a", "b"))
    out: list[DataFrame] = []
    above: DataFrame | None = None
    for k in range(depth, -1, -1):
        here = known.where(F.col("level") == k)
        if above is not None:
            below = above.groupBy(F.col("parent").alias("_p")).agg(F.min("low").alias("_l"), F.max("high").alias("_h"))
            here = here.join(below, F.col("vid") == F.col("_p"), "left").withColumns({"low": F.least("low", "_l"), "high": F.greatest("high", "_h")}).drop("_p", "_l", "_h")
        above = cut(here)
        out.append(above)
    return union_all(out)


def bridges(e: DataFrame) -> DataFrame:
    """(src, dst), src < dst: the edges whose loss would part their component: no edge leads out of the subtree but that to its parent."""
    cut_off = tags(e).where("vid <> parent and low >= first and high <= last")
    return cut_off.select(F.least("vid", "parent").alias("src"), F.greatest("vid", "parent").alias("dst"))
