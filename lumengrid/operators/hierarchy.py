"""Roll-ups over a tree of nodes, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumengrid.sources.folders import cut


def rolled_up(nodes: DataFrame) -> DataFrame:
    """node, parent, depth (0 at a root), n_below (nodes of the subtree, itself included), total (of their values).

    nodes: node (unique), parent (null, or no node: a root), value (long; null: 0). Each node keeps its ancestor 2^k levels
    up and the sum over the nodes less than 2^k levels below it. A round adds to a node the sums of those whose ancestor it
    is, and doubles the jump, so a tree of any depth takes log2(depth) rounds, with one row a node in each; no pair of node
    and ancestor is ever written down. Sums by ancestor are aggregated before they move, so a parent of a third of all
    nodes is one row a task. Nodes on or below a cycle have no depth and no sums.
    """
    known = nodes.select(F.col("node").alias("up"))
    linked = nodes.join(known, nodes["parent"] == known["up"], "left")
    state = linked.select("node", "parent", F.col("up").alias("jump"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.lit(1).cast("long").alias("n_below"), F.coalesce(F.col("value").cast("long"), F.lit(0)).alias("total"))
    state = cut(state, "tree")
    left = state.where("jump IS NOT NULL").count()
    rounds = max(1, state.count()).bit_length() + 1  # what a tree can take; a cycle takes more
    while left and rounds:
        sums = state.where("jump IS NOT NULL").groupBy(F.col("jump").alias("node")).agg(F.sum("n_below").alias("n"), F.sum("total").alias("t"))
        above = state.select(F.col("node").alias("jump"), F.col("jump").alias("next"), F.col("depth").alias("up"))
        both = state.join(sums, "node", "left").join(above, "jump", "left")
        state = cut(both.select("node", "parent", F.col("next").alias("jump"), (F.col("depth") + F.coalesce("up", F.lit(0))).alias("depth"), (F.col("n_below") + F.coalesce("n", F.lit(0))).alias("n_below"), (F.col("total") + F.coalesce("t", F.lit(0))).alias("total")), "tree")
        left, rounds = state.where("jump IS NOT NULL").count(), rounds - 1
    free = F.col("jump").isNull()
    return state.select("node", "parent", *(F.when(free, F.col(c)).alias(c) for c in ("depth", "n_below", "total")))
