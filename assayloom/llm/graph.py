"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id that is reachable.

    Each round points every node to its smallest neighbour, follows the pointers
    to their ends by doubling, and shrinks the links to those between the ends;
    at least half of the nodes go. Links, nodes and labels stay distributed.
    """
    edges = saved(links.select("a", "b").filter("a <> b").distinct(), "links")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = saved(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("end")), "pointers")
        while True:
            further = ends.select(F.col("node").alias("end"), F.col("end").alias("next"))
            ends = saved(ends.join(further, "end").select("node", F.col("next").alias("end"), (F.col("next") != F.col("end")).alias("moved")), "pointers")
            moved = ends.filter("moved").isEmpty()
            ends = ends.drop("moved")
            if moved:
                break
        if labels is None:
            labels = ends.select(F.col("node").alias("id"), F.col("end").alias("component"))
        else:
            joined = labels.join(ends, F.col("component") == F.col("node"), "left")
            labels = saved(joined.select("id", F.coalesce("end", "component").alias("component")), "labels")
        a, b = (ends.select(F.col("node").alias(c), F.col("end").alias(f"{c}_end")) for c in "ab")
        edges = saved(edges.join(a, "a").join(b, "b").select(F.col("a_end").alias("a"), F.col("b_end").alias("b")).filter("a <> b").distinct(), "links")
        if edges.isEmpty():
            return labels
