"""Connected components of an undirected graph by alternating neighbour minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.plans.lineage import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node, component`` of every node of an edge, the component being its smallest node.

    Each round gives a node the least label among its own and its neighbours', hooks the old label's node onto it, and jumps to the
    label's label. Rounds end when nothing changes; each is written to the shared folder. A node with very many edges is one key
    of a partially aggregated minimum, so it is not gathered anywhere. Null ends and loops are left out; no edges give no rows.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    for _ in range(most_rounds):
        known = labels.select(F.col("node").alias("v"), F.col("label").alias("heard"))
        heard = both.join(known, "v").groupBy(F.col("u").alias("node")).agg(F.min("heard").alias("heard"))
        step = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("new"))
        hooks = step.where("new < label").groupBy(F.col("label").alias("node")).agg(F.min("new").alias("hook"))
        step = step.join(hooks, "node", "left").select("node", "label", F.least("new", F.coalesce("hook", "new")).alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        fresh = cut(step.join(jump, "new", "left").select("node", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        labels = fresh.select("node", F.col("new").alias("label"))
        if fresh.where("new <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
