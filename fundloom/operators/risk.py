"""Portfolio concentration, supplier dependency, exposure and coverage metrics, for all funds at once.

Tables: holds(fund, company, weight_pct, value_usd, as_of), supplies_to(src, dst, criticality, component) with src the
dependent and dst its supplier, exposed_to(company, risk_title, severity), risk_factor(title, category),
mentions(doc_id, company), document(doc_id, filing_date, sensitivity). Sums are of decimals, so they don't depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fundloom.graphmodel import CRITICALITY, exact

STALE_DAYS = 180


def multiplier(criticality: Column) -> Column:
    out = F.lit(0.0)
    for kind, weight in CRITICALITY.items():
        out = F.when(F.lower(criticality) == kind, F.lit(weight)).otherwise(out)
    return out


def total(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.sum(exact(c)).cast("double"), digits)


def fund_holdings(holds: DataFrame, company: DataFrame) -> DataFrame:
    return holds.join(company.select("company", "name"), "company").select("fund", "company", "name", "weight_pct", "value_usd", "as_of")


def holding_suppliers(holds: DataFrame, supplies_to: DataFrame) -> DataFrame:
    """Each holding with the suppliers it depends on."""
    return holds.select("fund", "company", "weight_pct").join(supplies_to, F.col("company") == F.col("src")).select("fund", "company", "weight_pct", "dst", "criticality", "component")


def fund_exposures(holds: DataFrame, exposed_to: DataFrame, risk_factor: DataFrame) -> DataFrame:
    found = holds.select("fund", "company", "weight_pct").join(exposed_to, "company")
    return found.join(risk_factor, F.col("risk_title") == F.col("title")).select("fund", "company", "weight_pct", "risk_title", "category", "severity")


def holding_provenance(holds: DataFrame, mentions: DataFrame, document: DataFrame) -> DataFrame:
    """Holdings with the number of documents that mention them and the newest filing date; null without any."""
    dated = mentions.join(document.select("doc_id", "filing_date"), "doc_id", "left").groupBy("company").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("filing_date").alias("newest"))
    return holds.select("fund", "company", "weight_pct", "as_of").join(dated, "company", "left").select("fund", "company", "weight_pct", "as_of", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"), "newest")


def portfolio_hhi(holds: DataFrame) -> DataFrame:
    """Sum of squared percent weights, not normalised."""
    return holds.groupBy("fund").agg(total(F.col("weight_pct") * F.col("weight_pct")).alias("hhi"))


def concentration_summary(holds: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("fund").orderBy(F.desc("weight_pct"), "company"))
    return holds.withColumn("r", rank).groupBy("fund").agg(F.count("*").alias("n_holdings"), total("weight_pct", 4).alias("total_weight"), total(F.col("weight_pct") * F.col("weight_pct"), 4).alias("hhi"), total(F.when(F.col("r") <= 5, F.col("weight_pct")).otherwise(0.0), 4).alias("top5_weight"))


def supplier_concentration(holds: DataFrame, supplies_to: DataFrame) -> DataFrame:
    """Per fund and supplier: holdings' weights times the edge's criticality; edges of no weight don't count."""
    # Made one row for each holding and for each pair of issuers before they meet, so that what met is counted without telling it apart again.
    held = holds.withColumn("w", F.col("weight_pct").cast("decimal(18,6)")).where("w > 0").groupBy("fund", "company").agg(F.sum("w").cast("decimal(22,6)").alias("w"), F.count("*").alias("k"))
    edges = supplies_to.withColumn("m", multiplier(F.col("criticality")).cast("decimal(4,2)")).where("m > 0").groupBy("src", "dst").agg(F.sum("m").cast("decimal(10,2)").alias("m"), F.count("*").alias("n"))
    found = held.join(edges, F.col("company") == F.col("src")).groupBy("fund", F.col("dst").alias("supplier"))
    return found.agg(F.round(F.sum(F.col("w") * F.col("m")), 6).cast("double").alias("score"), F.count("*").alias("n_holdings"), F.sum(F.col("k") * F.col("n")).alias("n_edges"))


def shared_supplier_clusters(holds: DataFrame, supplies_to: DataFrame, min_holdings: int = 2) -> DataFrame:
    """Suppliers on which at least ``min_holdings`` holdings of a fund depend critically."""
    edges = supplies_to.where("criticality = 'critical'").groupBy("src", "dst").agg(F.collect_set("component").alias("parts"))
    found = holds.select("fund", "company").distinct().join(edges, F.col("company") == F.col("src")).groupBy("fund", F.col("dst").alias("supplier"))
    out = found.agg(F.count("*").alias("n_members"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("parts")))), ",").alias("components"))
    return out.where(F.col("n_members") >= min_holdings)


def shared_suppliers(holds: DataFrame, supplies_to: DataFrame, sensitivities: list[str] | None = None) -> DataFrame:
    """Critical suppliers of a fund's holdings and how many share them; with a list, over edges whose sensitivity (none: public) is in it."""
    edges = supplies_to.where("criticality = 'critical'")
    if sensitivities is not None:
        edges = edges.where(F.coalesce("sensitivity", F.lit("public")).isin(sensitivities))
    met = holds.select("fund", "company").distinct().join(edges.select("src", "dst").distinct(), F.col("company") == F.col("src"))
    return met.groupBy("fund", F.col("dst").alias("supplier")).agg(F.count("*").alias("n_holders"))


def risk_heatmap(holds: DataFrame, exposed_to: DataFrame, risk_factor: DataFrame) -> DataFrame:
    """Weight exposed to each category; a company counts once in a category."""
    kinds = exposed_to.join(risk_factor, F.col("risk_title") == F.col("title")).select("company", "category").distinct()
    held = holds.groupBy("fund", "company").agg(F.max("weight_pct").alias("weight_pct"))
    return held.join(kinds, "company").groupBy("fund", "category").agg(total("weight_pct").alias("mass"), F.count("*").alias("n_companies"))


def single_source_flags(holds: DataFrame, supplies_to: DataFrame) -> DataFrame:
    """(holding, component) with one supplier over all criticalities, and that one critical."""
    by = supplies_to.where("src is not null").groupBy(F.col("src").alias("company"), F.coalesce("component", F.lit("")).alias("component"))
    single = by.agg(F.countDistinct("dst").alias("n"), F.min("dst").alias("supplier"), F.bool_or(F.col("criticality") == "critical").alias("critical")).where("n = 1 and critical")
    # Suppliers are counted once for all funds that hold an issuer; a fund may list it twice.
    return holds.select("fund", "company").join(single.select("company", "component", "supplier"), "company").select("fund", "company", "component", "supplier").distinct()


def single_source_supplier_major(holds: DataFrame, supplies_to: DataFrame) -> DataFrame:
    """Per critical supplier of held issuers: dependents, funds, and the largest weight that one fund has on it."""
    flags = holding_suppliers(holds, supplies_to).where("criticality = 'critical'").select("fund", "company", "weight_pct", F.col("dst").alias("supplier")).distinct()
    per_fund = flags.groupBy("supplier", "fund").agg(F.sum(exact("weight_pct")).alias("w"))
    worst = per_fund.groupBy("supplier").agg(F.count("*").alias("n_funds"), F.round(F.max("w").cast("double"), 6).alias("worst_weight"))
    return worst.join(flags.groupBy("supplier").agg(F.countDistinct("company").alias("n_dependents")), "supplier")


def source_coverage(provenance: DataFrame) -> DataFrame:
    """Share of each fund's weight that some document backs."""
    covered = F.col("n_docs") > 0
    out = provenance.groupBy("fund").agg(total("weight_pct").alias("total_weight"), total(F.when(covered, F.col("weight_pct")).otherwise(0.0)).alias("covered_weight"), F.count(F.when(~covered, 1)).alias("n_uncovered"))
    return out.withColumn("coverage_pct", F.round(F.when(F.col("total_weight") > 0, 100 * F.col("covered_weight") / F.col("total_weight")).otherwise(0.0), 4))


def stale_sources(provenance: DataFrame, as_of: str, days: int = STALE_DAYS) -> DataFrame:
    """Covered holdings whose newest filing is older than ``days`` at a date; no date, or no filing date, and nothing is stale."""
    age = F.datediff(F.lit(as_of).try_cast("date"), "newest")
    return provenance.where("n_docs > 0").withColumn("age_days", age.cast("long")).where(F.col("age_days") > days).select("fund", "company", "age_days")


def fund_comparison(holds: DataFrame) -> DataFrame:
    """Each fund's HHI against the mean of all, and the spread."""
    hhi = portfolio_hhi(holds)
    mean = hhi.agg(F.round(F.avg(exact("hhi")).cast("double"), 4).alias("mean_hhi"), F.round((F.max("hhi") - F.min("hhi")), 4).alias("spread"), F.max_by("fund", F.struct("hhi", "fund")).alias("most_concentrated"))
    return hhi.join(F.broadcast(mean)).withColumn("delta", F.round(F.col("hhi") - F.col("mean_hhi"), 4))  # one row of global figures


def hhi_vs_average(holds: DataFrame, managed_by: DataFrame) -> DataFrame:
    """Each fund's HHI against the average of its firm's funds, and what it says: how concentrated, and how much more (from 1.05
    times on) or less (up to 0.95) than the average, if the firm has several funds."""
    by = portfolio_hhi(holds).join(managed_by, "fund")
    firm = by.groupBy("firm").agg(F.round(F.avg(exact("hhi")).cast("double"), 6).alias("firm_avg"), F.count("*").alias("n_funds"))
    size = holds.groupBy("fund").agg(F.count("*").alias("n_holdings"), F.max("weight_pct").alias("top_weight"))
    out = by.join(firm, "firm").join(size, "fund")
    ratio = F.col("hhi") / F.col("firm_avg")
    band = F.when((F.col("n_funds") < 2) | (F.col("firm_avg") <= 0) | (F.col("hhi") <= 0), "none").when(ratio >= 1.05, "more").when(ratio <= 0.95, "less").otherwise("none")
    return out.withColumn("band", band).withColumn("interpretation", hhi_interpretation())


def hhi_interpretation() -> Column:
    """The sentence for a row of ``hhi_vs_average``."""
    top = F.col("top_weight")
    size = F.when(top >= 15, "Highly concentrated").when(top >= 10, "Moderately concentrated").otherwise("Diversified")
    first = F.format_string("%s — HHI %.0f over %d holdings, top position %.1f%%.", size, "hhi", "n_holdings", top)
    more = F.when(F.col("band") == "more", F.format_string(" ~%.1fx more concentrated than the firm average.", F.col("hhi") / F.col("firm_avg"))).when(F.col("band") == "less", F.format_string(" ~%.1fx less concentrated than the firm average.", F.col("firm_avg") / F.col("hhi"))).otherwise("")
    return F.concat(first, more)


def concentration_table(holds: DataFrame, company: DataFrame) -> DataFrame:
    return fund_holdings(holds, company).select("fund", "name", "weight_pct").orderBy(F.desc("weight_pct"), "fund", "name")


def top_holdings(holds: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` heaviest holdings of each fund."""
    rank = F.row_number().over(Window.partitionBy("fund").orderBy(F.desc("weight_pct"), "company"))
    return holds.withColumn("rank", rank).where(F.col("rank") <= k).select("fund", "company", "weight_pct", "rank")


def firm_top_holdings(holds: DataFrame, managed_by: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` issuers with the largest total weight over a firm's funds."""
    summed = holds.join(managed_by, "fund").groupBy("firm", "company").agg(total("weight_pct").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("firm").orderBy(F.desc("weight"), "company"))
    return summed.withColumn("rank", rank).where(F.col("rank") <= k)


def structural_holdings(holds: DataFrame, managed_by: DataFrame, k: int = 5) -> DataFrame:
    """Per firm: its funds and distinct issuers, and the ``k`` issuers with the largest weight in one fund (ties: the smaller id)."""
    own = holds.join(managed_by, "fund")
    heaviest = own.groupBy("firm", "company").agg(F.max("weight_pct").alias("w"))
    rank = F.row_number().over(Window.partitionBy("firm").orderBy(F.desc("w"), "company"))
    top = heaviest.withColumn("r", rank).where(F.col("r") <= k).groupBy("firm").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "company"))), lambda x: x["company"].cast("string")), ",").alias("top"))
    return own.groupBy("firm").agg(F.countDistinct("fund").alias("n_funds"), F.countDistinct("company").alias("n_companies")).join(top, "firm")


def firm_directory(managed_by: DataFrame) -> DataFrame:
    return managed_by.groupBy("firm").agg(F.count("*").alias("n_funds"), F.array_join(F.transform(F.array_sort(F.collect_list("fund")), lambda x: x.cast("string")), ",").alias("funds"))


def firm_companies(holds: DataFrame, managed_by: DataFrame) -> DataFrame:
    return holds.select("fund", "company").join(managed_by, "fund").select("firm", "company").distinct()
