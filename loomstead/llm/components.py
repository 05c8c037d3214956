"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import staged, unstage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), both bigint.

    Every round maps each node to its least neighbour (or itself) and renames
    the ends of the edges, so edges inside a component vanish; with hashed
    node numbers the rounds grow with the logarithm of the longest chain.
    Hubs are met by partial aggregation and by joins that can be split.
    Nulls among the ends are dropped; an empty table gives no rows.
    """
    given = staged(edges.select("a", "b").where("a is not null and b is not null").distinct(), "given")
    nodes = given.select(F.col("a").alias("node")).union(given.select(F.col("b").alias("node"))).distinct()
    labels = staged(nodes.select("node", F.col("node").alias("root")), "labels")
    live = staged(given.where("a <> b"), "edges")
    unstage(given)
    while not live.isEmpty():
        least = staged(
            live.union(live.select("b", "a"))
            .groupBy(F.col("a").alias("at"))
            .agg(F.min("b").alias("least"))
            .select("at", F.least("at", "least").alias("to")),
            "least",
        )
        one, two = (least.select(F.col("at").alias(f"{c}_at"), F.col("to").alias(f"{c}_to")) for c in "ab")
        renamed = live.join(one, live.a == one.a_at).join(two, live.b == two.b_at)
        fewer = staged(renamed.where("a_to <> b_to").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct(), "edges")
        moved = labels.join(least, labels.root == least.at, "left")
        relabelled = staged(moved.select("node", F.coalesce("to", "root").alias("root")), "labels")
        unstage(live, labels, least)
        live, labels = fewer, relabelled
    unstage(live)
    return labels
