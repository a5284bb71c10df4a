"""Connected components by large and small stars.

In turn, every node hangs its larger neighbours, then its smaller ones and itself, on the least node it knows; edges shrink to stars around the
least node of each component in a logarithmic number of rounds. A hot node's minimum is pre-aggregated and joined back, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.sources.tables import written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v), u > v, after one turn: of each node's neighbours the larger (or the others and itself) hang on the least of them and it."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("least")).select("n", F.least("least", "n").alias("m"))
    met = near.hint("merge").join(least.hint("merge"), F.col("u") == F.col("n"))
    if large:
        hung = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label (the least node that it is joined to) for every node of ``edges`` (u, v). Loops and edges with a null end join nothing."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star-edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(now)
    for _ in range(most_rounds):
        now = written(star(star(now, True), False), "star-edges")
        after = mark(now)
        if after == before:
            roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
        before = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
