"""Connected components of an edge table by contraction.

In each round every node names the neighbour (or itself) of the least rank, and edges are redrawn between the named nodes; a star or
clique is done in one round, a long chain loses a share of its nodes in each. Ranks are hashes with the round's number, so no
order of ids makes it slow. Edges with a null end and loops join nothing and are left out; repeated edges count once; an empty table has no nodes. Minima are pre-aggregated, and hot nodes are joined, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.llm.shared import written


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label (the least node of its component) for every node of ``edges`` (u, v)."""
    edges = written(edges.where("u <> v").select("u", "v").distinct(), "component-edges")
    names = None
    for turn in range(most_rounds):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("id"))
        nearest = both.groupBy("u").agg(F.min(rank("v")).alias("near"))
        least = written(nearest.select(F.col("u").alias("node"), F.least(rank("u"), "near")["id"].alias("m")), "component-names")
        by = lambda c: least.select(F.col("node").alias(f"node_{c}"), F.col("m").alias(f"m_{c}"))
        edges = edges.join(by("u"), F.col("u") == F.col("node_u")).join(by("v"), F.col("v") == F.col("node_v")).where("m_u <> m_v").select(F.col("m_u").alias("u"), F.col("m_v").alias("v")).distinct()
        edges = written(edges, "component-edges")
        if names is None:
            names = least.select("node", F.col("m").alias("label"))
        else:
            names = names.join(by("l"), F.col("label") == F.col("node_l"), "left").select("node", F.coalesce("m_l", "label").alias("label"))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    if names is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    names = written(names, "component-names")
    least = names.groupBy(F.col("label").alias("l")).agg(F.min("node").alias("least"))
    return names.join(least, F.col("label") == F.col("l")).select("node", F.col("least").alias("label"))


def relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, label) after more edges: these are drawn between labels, so only what they touch is worked on."""
    at = lambda c: labels.select(F.col("node").alias(f"node_{c}"), F.col("label").alias(f"label_{c}"))
    drawn = edges.join(at("u"), F.col("u") == F.col("node_u"), "left").join(at("v"), F.col("v") == F.col("node_v"), "left").select(F.coalesce("label_u", "u").alias("u"), F.coalesce("label_v", "v").alias("v"))
    new = written(connected(drawn), "component-new").withColumnsRenamed({"node": "n2", "label": "l2"})
    old = labels.join(new, F.col("label") == F.col("n2"), "left").select("node", F.coalesce("l2", "label").alias("label"))
    return old.unionByName(new.join(labels, F.col("n2") == F.col("node"), "left_anti").select(F.col("n2").alias("node"), F.col("l2").alias("label")))
