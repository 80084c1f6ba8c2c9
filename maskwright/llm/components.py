"""Connected components of an edge table, by small stars and pointer jumps over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """edges(a, b) to (node, root): each node that has an edge and isn't the least of its component.

    Each round ties a node's lesser neighbours to the least of them and lifts the node to that
    one's own least neighbour. Every round only joins and pre-aggregates, so no task holds a
    component; a node that many others point at is the side of a join that Spark can split.
    Rows with a null end and loops are passed over.
    """
    lesser = lambda e: e.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(lesser(edges), "cc-edges")
    for _ in range(max_rounds):
        least = written(now.groupBy("a").agg(F.min("b").alias("p"), F.count(F.lit(1)).alias("n")), "cc-least")
        up = least.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        lifted = least.join(up, "p", "left")
        done = lifted.agg(F.count_if(F.expr("n > 1 or pp is not null"))).first()[0] == 0
        if done:
            return least.select(F.col("a").alias("node"), F.col("p").alias("root"))
        jumped = lifted.select("a", F.coalesce("pp", "p").alias("b"))
        tied = now.join(least, "a").where("b <> p").select(F.col("b").alias("a"), F.col("p").alias("b"))
        now = written(lesser(jumped.unionByName(tied)), "cc-edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
