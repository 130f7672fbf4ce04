"""Connected components by DataFrame rounds: every node learns the smallest node it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import materialize, shuffled


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of the component.

    Each round, every node of the contracted graph takes the smallest of itself and its neighbours, chains of such
    steps are followed twice, and edges are drawn anew between the nodes reached.  Edges inside one group
    vanish, so the graph shrinks each round; nothing is collected.  Null ends and self-loops are ignored; an empty table gives an empty result.
    """
    e = materialize(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    reached = None
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to"))
        for _ in range(2):
            on = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
            step = step.join(shuffled(on), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        step = materialize(step, "step")
        if reached is None:
            reached = step.withColumnRenamed("to", "root")
        else:
            reached = materialize(reached.join(shuffled(step.select(F.col("node").alias("root"), "to")), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "reached")
        a, b = step.select(F.col("node").alias("a"), F.col("to").alias("x")), step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        e = e.join(shuffled(a), "a").join(shuffled(b), "b").where("x <> y")
        e = materialize(e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if reached is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return reached
