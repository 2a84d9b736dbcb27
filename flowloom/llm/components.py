"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the undirected `links` (a, b); root is one node of its component.

    Each round every node points to the least node among itself and its neighbours, pointers are
    followed once more, and what points to the same node becomes one. With nodes named by hashes the
    least ones lie anywhere, so a constant share of the nodes goes each round, chains included.
    """
    links = stored(links.where("a <> b").select("a", "b").distinct(), "links")
    roots = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("to"))
        least = stored(least, "pointers")
        further = least.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = stored(least.join(further, "to").select("node", F.col("next").alias("root")), "steps")
        if roots is None:
            roots = step
        else:
            moved = step.select(F.col("node").alias("root"), F.col("root").alias("new"))
            renamed = roots.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
            renamed = stored(renamed, "roots")
            discard(roots)
            roots = renamed
        left = step.select(F.col("node").alias("a"), F.col("root").alias("to_a"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("to_b"))
        moved = links.join(left, "a").join(right, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        moved = stored(moved.where("a <> b").distinct(), "links")
        discard(links, least, *([] if roots is step else [step]))
        links = moved
    return roots if roots is not None else stored(links.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")
