"""Report packs, registry, provenance, collections for screens, impact briefings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundloom.functions.text import severity_band
from fundloom.graphmodel import CATEGORIES
from fundloom.operators import risk


def said(c: str | Column, digits: int | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.format_string(f"%.{digits}f", c) if digits is not None else c.cast("string")


def joined(items: Column, separator: str) -> Column:
    return F.coalesce(F.nullif(F.array_join(items, separator), F.lit("")), F.lit("none"))


def risk_report(holds: DataFrame, supplies_to: DataFrame, exposed_to: DataFrame, risk_factor: DataFrame, provenance: DataFrame) -> DataFrame:
    """One row for each fund: HHI, holdings, coverage, and its best figures: top supplier, top category, flags, clusters.

    fund, hhi, n_holdings, total_weight, covered_pct, top_supplier, top_score, top_n, top_category, top_mass, n_flags, n_clusters."""
    best = lambda df, key, by: df.groupBy("fund").agg(F.min_by(key, F.struct((-F.col(by)).alias("v"), key)).alias("top"), F.max(by).alias("best"))
    suppliers = risk.supplier_concentration(holds, supplies_to)
    top = suppliers.groupBy("fund").agg(F.min(F.struct((-F.col("score")).alias("v"), F.col("supplier").alias("top_supplier"), F.col("n_holdings").alias("top_n"))).alias("x")).select("fund", "x.top_supplier", (-F.col("x.v")).alias("top_score"), "x.top_n")
    heat = best(risk.risk_heatmap(holds, exposed_to, risk_factor), "category", "mass").select("fund", F.col("top").alias("top_category"), F.col("best").alias("top_mass"))
    flags = risk.single_source_flags(holds, supplies_to).groupBy("fund").agg(F.count("*").alias("n_flags"))
    clusters = risk.shared_supplier_clusters(holds, supplies_to).groupBy("fund").agg(F.count("*").alias("n_clusters"))
    cover = risk.source_coverage(provenance).select("fund", F.col("coverage_pct").alias("covered_pct"))
    out = holds.groupBy("fund").agg(F.count("*").alias("n_holdings"), risk.total("weight_pct").alias("total_weight")).join(risk.portfolio_hhi(holds), "fund")
    for part in (top, heat, flags, clusters, cover):
        out = out.join(part, "fund", "left")
    return out.fillna(0, ["n_flags", "n_clusters"])


def narrative(report: DataFrame) -> DataFrame:
    """fund, narrative: the figures of a risk report as sentences."""
    first = F.format_string("%s: portfolio HHI %.1f across %d holdings.", F.col("fund").cast("string"), "hhi", "n_holdings")
    supplier = F.when(F.col("top_supplier").isNotNull(), F.format_string(" Top supplier dependency is %s (weighted score %.1f, shared by %d holdings).", F.col("top_supplier").cast("string"), "top_score", "top_n")).otherwise("")
    category = F.when(F.col("top_category").isNotNull(), F.format_string(" The dominant risk-factor category by weight is %s (%.1f%% of fund weight).", "top_category", "top_mass")).otherwise("")
    cover = F.format_string(" Only %.1f%% of fund weight is backed by an ingested source; %.1f%% remains uncovered.", "covered_pct", 100 - F.col("covered_pct"))
    return report.select("fund", F.concat(first, supplier, category, cover).alias("narrative"))


def report_sections(report: DataFrame, holds: DataFrame, gaps: DataFrame) -> DataFrame:
    """fund, ord, heading, body, stale: the sections of a report pack. gaps: fund, category."""
    top = risk.top_holdings(holds, 4).groupBy("fund").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight_pct")).alias("w"), "company"))).alias("t"))
    largest = F.array_join(F.transform("t", lambda x: F.concat(x["company"].cast("string"), F.lit(" "), F.format_string("%.2f", -x["w"]), F.lit("%"))), ", ")
    missing = gaps.groupBy("fund").agg(F.array_sort(F.collect_set("category")).alias("missing"))
    rows = report.join(top, "fund").join(missing, "fund", "left").withColumns({"largest": largest, "missing": F.coalesce("missing", F.array().cast("array<string>"))})
    hhi, gap = said("hhi", 2), joined(F.col("missing"), ", ")
    bodies = [
        ("Executive summary", F.concat(said("fund"), F.lit(" holds "), said("n_holdings"), F.lit(" positions ("), said("total_weight", 2), F.lit("% of assets) with a portfolio HHI of "), hhi, F.lit(". Uncovered principal-risk categories: "), gap, F.lit("."))),
        ("Portfolio concentration", F.concat(F.lit("HHI "), hhi, F.lit(" over "), said("n_holdings"), F.lit(" holdings. Largest positions: "), F.col("largest"), F.lit("."))),
        ("Supplier dependency", F.concat(F.lit("Top weighted supplier dependency: "), F.coalesce(said("top_supplier"), F.lit("none")), F.lit("."))),
        ("Risk-factor heatmap", F.concat(F.lit("Largest holding-weight mass: "), F.coalesce("top_category", F.lit("none")), F.lit("."))),
        ("Disclosure coverage", F.when(F.size("missing") > 0, F.concat(F.lit("Uncovered principal-risk categories: "), gap, F.lit("."))).otherwise("All exposed principal risks are covered by a prospectus section.")),
        ("Source coverage", F.concat(said("covered_pct", 2), F.lit("% of fund weight is backed by an ingested source; "), said(100 - F.col("covered_pct"), 2), F.lit("% is uncovered."))),
        ("Single-source supplier flags", said("n_flags")),
    ]
    each = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(h).alias("heading"), b.alias("body"), (F.lit(h == "Disclosure coverage") & (F.size("missing") > 0)).alias("stale")) for k, (h, b) in enumerate(bodies)])
    return rows.select("fund", F.explode(each).alias("x")).select("fund", "x.*")


def report_provenance(report: DataFrame, sources: DataFrame, gaps: DataFrame) -> DataFrame:
    """fund, claim, doc_id: what a pack says and from where. sources: fund, doc_id."""
    hhi = report.select("fund", F.concat(F.lit("Portfolio HHI = "), said("hhi", 2)).alias("claim"), F.lit(None).cast("long").alias("doc_id"))
    by_doc = sources.select("fund", F.lit("Supports supplier-dependency / exposure figures").alias("claim"), "doc_id").distinct()
    missing = gaps.groupBy(F.col("fund").alias("f")).agg(F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("m"))
    gap = report.select("fund").join(missing, F.col("fund") == F.col("f"), "left").select("fund", F.concat(F.lit("Disclosure coverage gap: "), F.coalesce("m", F.lit("none"))).alias("claim"), F.lit(None).cast("long").alias("doc_id"))
    return hhi.unionByName(by_doc).unionByName(gap)


def upsert_registry(existing: DataFrame, packs: DataFrame, now: str) -> DataFrame:
    """report_id, title, period, sha256, created_at: a pack that is known gets new values and keeps its creation."""
    new = packs.select("report_id", F.col("title").alias("t"), F.col("period").alias("p"), F.col("sha256").alias("s"))
    both = existing.join(new, "report_id", "full_outer")
    return both.select("report_id", F.coalesce("t", "title").alias("title"), F.coalesce("p", "period").alias("period"), F.coalesce("s", "sha256").alias("sha256"), F.coalesce("created_at", F.lit(now)).alias("created_at"))


def write_derived_from(provenance: DataFrame, document: DataFrame, chunks: DataFrame) -> DataFrame:
    """report_id, kind, target: edges to the documents and chunks of a report's provenance that exist. provenance: report_id, doc_id, chunk_id."""
    docs = provenance.select("report_id", "doc_id").distinct().join(document.select("doc_id"), "doc_id", "left_semi").select("report_id", F.lit("Document").alias("kind"), F.col("doc_id").cast("string").alias("target"))
    parts = provenance.select("report_id", "chunk_id").distinct().join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("report_id", F.lit("Chunk").alias("kind"), F.col("chunk_id").alias("target"))
    return docs.unionByName(parts)


def reports_deriving(items: DataFrame, derived: DataFrame) -> DataFrame:
    """item, report_id: reports derived from an item's document or chunk: two equi-joins, not one OR. items: item, doc_id, chunk_id."""
    by = lambda kind, key: items.select("item", F.col(key).cast("string").alias("k")).join(derived.where(F.col("kind") == kind), F.col("k") == F.col("target")).select("item", "report_id")
    return by("Document", "doc_id").union(by("Chunk", "chunk_id")).distinct()


def risk_collection_cells(holds: DataFrame, exposed_to: DataFrame, risk_factor: DataFrame) -> DataFrame:
    """company, category, place, severity: held issuers by category (in its fixed order), 0 to 3 by the strongest language."""
    held = holds.select("company").distinct()
    found = exposed_to.join(held, "company", "left_semi").join(risk_factor, F.col("risk_title") == F.col("title"))
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")).cast("int")
    return found.groupBy("company", "category").agg(F.max(severity_band(F.col("severity"))).alias("severity")).select("company", "category", place.alias("place"), "severity")


def fact_triples(diff: DataFrame) -> DataFrame:
    """subject, predicate, object, detail: changed facts for a screen; what changed, or what is new or gone.

    diff: kind, name, subject, object, change, old_value, new_value."""
    detail = F.when(F.col("change") == "changed", F.concat(F.lit("changed: "), F.coalesce("new_value", F.lit("")))).otherwise(F.coalesce("new_value", F.lit("")))
    return diff.select("subject", F.col("name").alias("predicate"), F.coalesce("object", F.lit("")).alias("object"), "change", detail.alias("detail"))


def impact_briefings(reached: DataFrame, holds: DataFrame) -> DataFrame:
    """fund, hops, reason: one hop if the fund holds what changed (the smallest such issuer is named), else two, over what it holds.

    reached: target_kind, target, via, held."""
    funds = reached.where("target_kind = 'fund'").select(F.col("target").cast("long").alias("fund"), "via", "held")
    anchor = funds.where(F.col("via") == F.col("held").cast("string")).groupBy("fund").agg(F.min("via").alias("anchor")).withColumnRenamed("fund", "f")
    every = funds.groupBy("fund").agg(F.min("held").alias("first_held"), F.countDistinct("held").alias("n_held"))
    weight = holds.select(F.col("fund").alias("f2"), "company", "weight_pct")
    out = every.join(anchor, F.col("fund") == F.col("f"), "left").join(weight, (F.col("fund") == F.col("f2")) & (F.col("anchor") == F.col("company").cast("string")), "left")
    reason = F.when(F.col("anchor").isNotNull(), F.format_string("holds %s at %.6f%% (inbound HOLDS, 1 hop)", "anchor", "weight_pct")).otherwise(F.format_string("holds %d and %d more in the affected supply chain (2 hops)", "first_held", F.col("n_held") - 1))
    return out.select("fund", F.when(F.col("anchor").isNotNull(), 1).otherwise(2).alias("hops"), reason.alias("reason"))


def impact_event(diff: DataFrame, reached: DataFrame) -> DataFrame:
    """One row: how many facts were added, removed and changed, and how many targets of each kind they reach."""
    n = lambda c: F.count(F.when(F.col("change") == c, 1)).alias(c)
    targets = reached.select("target_kind", "target").distinct()
    m = lambda k, name: F.count(F.when(F.col("target_kind") == k, 1)).alias(name)
    counts = targets.agg(m("fund", "affected_funds"), m("section", "stale_sections"), m("report", "out_of_date_reports")).withColumn("k", F.lit(1))
    return diff.agg(n("added"), n("removed"), n("changed")).withColumn("k", F.lit(1)).join(F.broadcast(counts), "k").drop("k")  # two rows of counts
