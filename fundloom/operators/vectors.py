"""Nearest vectors by cosine: exact, with cells around pivots and bounds by the triangle inequality.

On unit vectors the order by cosine is that of distance. A bounded number of vectors are pivots; every vector belongs to the cell of its nearest pivot. A query
first meets its own cell, which bounds the distance of its k-th neighbour; then only cells that reach nearer than that: a cell's vectors are at
least its pivot's distance less its radius away. Within a cell a vector can be left out if its and the query's distances to the pivot differ by
more than the bound. What meets is multiplied in blocks: a cell's vectors and its queries are dealt over parts of bounded size, and each pair of
parts is one product, so neither a cell that holds most vectors nor any number of queries makes a large task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fundloom.sources.tables import written

#: Vectors and queries of one product.
BLOCK = 4096
#: What rounding may add to a distance, and digits of a score by which neighbours are ranked.
SLACK, DIGITS = 1e-7, 12


def unit(df: DataFrame, key: str) -> DataFrame:
    """``key`` and u, the vector at length 1; null and zero vectors are left out."""
    told = df.where("embedding is not null and vec_id is not null").select(F.col("vec_id").alias(key), F.expr("transform(embedding, x -> cast(x as double))").alias("x"))
    told = told.withColumn("norm", F.expr("sqrt(aggregate(x, 0D, (s, v) -> s + v * v))")).where("norm > 0")
    return told.select(key, F.expr("transform(x, v -> v / norm)").alias("u"))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def celled(vectors: DataFrame, key: str, pivots: np.ndarray) -> DataFrame:
    """key, u, cell, d: each vector's nearest pivot and the distance to it."""

    def assign(batches):
        for batch in batches:
            x = matrix(batch.column("u"))
            d = distances(x, pivots) if len(x) else np.zeros((0, len(pivots)))
            cell = d.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("u"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(x)), cell])], names=[key, "u", "cell", "d"])

    return vectors.select(key, "u").mapInArrow(assign, f"{key} long, u array<double>, cell int, d double")


def in_reach(queries: DataFrame, pivots: np.ndarray, radius: np.ndarray) -> DataFrame:
    """query_id, u, cell, d, tau for each other cell that may hold something nearer than ``tau``. queries: query_id, u, cell, tau."""

    def reach(batches):
        for batch in batches:
            x, own, tau = matrix(batch.column("u")), batch.column("cell").to_numpy(), batch.column("tau").to_numpy()
            if not len(x):
                continue
            d = distances(x, pivots)
            may = (d - radius[None, :] <= tau[:, None] + SLACK) & (np.arange(len(pivots))[None, :] != own[:, None]) & (radius[None, :] >= 0)
            q, cell = np.nonzero(may)
            taken = batch.take(pa.array(q))
            yield pa.RecordBatch.from_arrays([taken.column("query_id"), taken.column("u"), pa.array(cell.astype(np.int32)), pa.array(d[q, cell]), taken.column("tau")], names=["query_id", "u", "cell", "d", "tau"])

    return queries.select("query_id", "u", "cell", "tau").mapInArrow(reach, "query_id long, u array<double>, cell int, d double, tau double")


def best_in_blocks(queries: DataFrame, vectors: DataFrame, k: int, least: float) -> DataFrame:
    """query_id, vec_id, score: of each pair of parts the ``k`` best of each query. queries: query_id, u, cell, d, tau. vectors: vec_id, u, cell, d."""
    parts = lambda df, name: df.groupBy(F.col("cell").alias("c")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    sizes = written(parts(vectors, "parts").join(parts(queries, "q_parts"), "c"), "cell-sizes")  # a row a pivot
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sized = lambda df: df.join(F.broadcast(sizes), F.col("cell") == F.col("c"))
    left = sized(vectors).select("cell", dealt("vec_id", "parts").alias("part"), every("q_parts").alias("q_part"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "u", "d", F.lit(0.0).alias("tau"))
    right = sized(queries).select("cell", every("parts").alias("part"), dealt("query_id", "q_parts").alias("q_part"), F.lit(True).alias("asks"), F.col("query_id").alias("id"), "u", "d", "tau")

    def meet(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        q, v = group.filter(pa.array(asks)), group.filter(pa.array(~asks))
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if q.num_rows and v.num_rows:
            x, y = matrix(q.column("u")), matrix(v.column("u"))
            q_id, v_id, q_d, v_d, tau = q.column("id").to_numpy(), v.column("id").to_numpy(), q.column("d").to_numpy(), v.column("d").to_numpy(), q.column("tau").to_numpy()
            order = np.argsort(v_id, kind="stable")
            y, v_id, v_d = y[order], v_id[order], v_d[order]
            rows = []
            for a in range(0, len(q_id), 256):
                own = slice(a, a + 256)
                score = np.round(x[own] @ y.T, DIGITS)
                score[(np.abs(q_d[own, None] - v_d[None, :]) > tau[own, None] + SLACK) | (q_id[own, None] == v_id[None, :]) | (score < least)] = -np.inf
                # By score, equal ones by id: the sort is stable and ids are in order.
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                i, j = np.nonzero(np.take_along_axis(score, best, axis=1) > -np.inf)
                rows.append((q_id[own][i], v_id[best[i, j]], score[i, best[i, j]]))
            out = [np.concatenate(c) for c in zip(*rows, strict=True)]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return left.unionByName(right).groupBy("cell", "part", "q_part").applyInArrow(meet, "query_id long, vec_id long, score double")


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, least: float = -1.0, n_pivots: int = 64) -> DataFrame:
    """query_id, vec_id, rank, score: for each query row the ``k`` rows most alike by cosine (equal ones by id), at ``least`` alike, itself left out.

    vectors, queries: vec_id, embedding, all of one length. The ``n_pivots`` rows that come first by a hash of their id are the pivots."""
    every = unit(vectors, "vec_id")
    first = every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).select("u").collect()
    if not first:
        return queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("vec_id").cast("long").alias("vec_id"), F.lit(1).alias("rank"), F.lit(0.0).alias("score")).limit(0)
    pivots = np.array([r["u"] for r in first])
    held = written(celled(every, "vec_id", pivots), "vector-cells")
    radius = np.full(len(pivots), -1.0)
    for r in held.groupBy("cell").agg(F.max("d").alias("r")).collect():  # a row a pivot
        radius[r["cell"]] = r["r"]
    asked = written(celled(unit(queries, "query_id"), "query_id", pivots), "query-cells")
    far = 2.0 if least <= -1 else float(np.sqrt(max(2 - 2 * least, 0)))
    own = written(best_in_blocks(asked.withColumn("tau", F.lit(far)), held, k, least), "own-cell")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    # The k-th neighbour in the own cell bounds what others may add; with fewer there is only the given least.
    bound = ranked(own).where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("t"))
    bounded = asked.hint("merge").join(bound.hint("merge"), F.col("query_id") == F.col("q"), "left").withColumn("tau", F.coalesce("t", F.lit(far)))
    others = best_in_blocks(written(in_reach(bounded, pivots, radius), "in-reach"), held, k, least)
    return ranked(own.unionByName(others)).select("query_id", "vec_id", "rank", F.round("score", 4).alias("score"))
