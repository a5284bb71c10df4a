"""Entitlement and firm scope: which rows a reader may see, and views over what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def graph_visible(sensitivity: Column, entitlements: list[str]) -> Column:
    """Graph reads: no sensitivity means visible."""
    return sensitivity.isNull() | sensitivity.isin(entitlements)


def text_visible(sensitivity: Column, entitlements: list[str]) -> Column:
    """Text reads: no sensitivity means public."""
    return F.coalesce(sensitivity, F.lit("public")).isin(entitlements)


def entitlement_scope(asked: Column) -> Column:
    """A request's entitlements: trimmed, lower case, distinct, sorted, 'public' always among them."""
    clean = F.transform(F.coalesce(asked, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.concat(F.filter(clean, lambda x: x != ""), F.array(F.lit("public")))))


def entitlement_filter(edges: DataFrame, nodes: DataFrame, entitlements: list[str]) -> DataFrame:
    """Edges whose own sensitivity and that of both ends are visible. nodes: node, sensitivity."""
    seen = nodes.where(graph_visible(F.col("sensitivity"), entitlements)).select("node")
    own = edges.where(graph_visible(F.col("sensitivity"), entitlements))
    return own.join(seen, F.col("src") == F.col("node"), "left_semi").join(seen, F.col("dst") == F.col("node"), "left_semi")


def entitlement_split(docs: DataFrame, by: list[str], entitlements: list[str]) -> DataFrame:
    """Visible and withheld rows of each group."""
    seen = text_visible(F.col("sensitivity"), entitlements)
    return docs.groupBy(*by).agg(F.count(F.when(seen, 1)).alias("n_visible"), F.count(F.when(~seen, 1)).alias("n_withheld"))


def min_confidence(edges: DataFrame, least: float) -> DataFrame:
    return edges.where(F.coalesce(F.col("confidence"), F.lit(1.0)) >= least)


def held_by(holds: DataFrame, managed_by: DataFrame, firm: int) -> DataFrame:
    """Distinct issuers that a firm's funds hold."""
    return holds.join(managed_by.where(F.col("firm") == firm).select("fund"), "fund", "left_semi").select("company").distinct()


def firm_scope_edges(firm: int, managed_by: DataFrame, holds: DataFrame, supplies_to: DataFrame, exposed_to: DataFrame, mentions: DataFrame) -> DataFrame:
    """Five arms of a firm's subgraph as (rel, src, dst); a supply edge needs both ends held."""
    own = managed_by.where(F.col("firm") == firm)
    held = held_by(holds, managed_by, firm)
    edge = lambda df, rel, a, b: df.select(F.lit(rel).alias("rel"), F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst"))
    supply = supplies_to.join(held, F.col("src") == F.col("company"), "left_semi").join(held, F.col("dst") == F.col("company"), "left_semi")
    arms = [
        edge(own, "MANAGED_BY", "fund", "firm"),
        edge(holds.join(own.select("fund"), "fund", "left_semi"), "HOLDS", "fund", "company"),
        edge(supply, "SUPPLIES_TO", "src", "dst"),
        edge(exposed_to.join(held, "company", "left_semi"), "EXPOSED_TO", "company", "risk_title"),
        edge(mentions.join(held, "company", "left_semi"), "MENTIONS", "doc_id", "company"),
    ]
    out = arms[0]
    for arm in arms[1:]:
        out = out.unionByName(arm)
    return out


def firm_scope_documents(document: DataFrame, mentions: DataFrame, held: DataFrame, stamped: DataFrame) -> DataFrame:
    """Documents stamped with the firm (column doc_id) or that mention an issuer it holds: two equi-joins, not one OR."""
    by_mention = mentions.join(held, "company", "left_semi").select("doc_id")
    return document.join(by_mention.unionByName(stamped.select("doc_id")).distinct(), "doc_id", "left_semi")


def subgraph_nodes(edges: DataFrame) -> DataFrame:
    """Distinct nodes of edges with their degree."""
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))


def graph_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("label"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def cross_firm_leaks(scoped: DataFrame, managed_by: DataFrame, firm: int) -> DataFrame:
    """HOLDS rows of a firm's view whose fund another firm manages."""
    own = managed_by.where(F.col("firm") == firm).select(F.col("fund").cast("string").alias("f"))
    return scoped.where("rel = 'HOLDS'").join(own, F.col("src") == F.col("f"), "left_anti")


def delete_firm(firm: int, managed_by: DataFrame, holds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """managed_by and holds without the firm's funds; shared issuers stay."""
    gone = managed_by.where(F.col("firm") == firm).select("fund")
    return managed_by.join(gone, "fund", "left_anti"), holds.join(gone, "fund", "left_anti")
