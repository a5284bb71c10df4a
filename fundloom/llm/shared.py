"""Small helpers that the training-data operators have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.sources.tables import new_path, shared_dir, written

__all__ = ["SPACE", "free_names", "let", "new_path", "shared_dir", "table", "words_of", "written"]

SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a text: runs without the six ASCII white-space characters; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def free_names(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` doesn't have, whatever the case of its own."""
    taken, out, k = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if f"own_{k}" not in taken:
            out.append(f"own_{k}")
        k += 1
    return out
