"""Disclosure coverage, 13F rows and report packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundloom.operators import risk


def fund_risks(holds: DataFrame, exposed_to: DataFrame) -> DataFrame:
    """Distinct (fund, risk_title) that some holding is exposed to."""
    return holds.select("fund", "company").join(exposed_to.select("company", "risk_title"), "company").select("fund", "risk_title").distinct()


def coverage_gap(holds: DataFrame, exposed_to: DataFrame, covers: DataFrame, fund: DataFrame) -> DataFrame:
    """Risks of a fund without a section of its own filings; a section's series stands before the colon of its form_ref."""
    sections = covers.select(F.split_part("form_ref", F.lit(":"), F.lit(1)).alias("series_id"), "risk_title")
    risks = fund_risks(holds, exposed_to).join(fund.select("fund", "series_id"), "fund")
    return risks.join(sections, ["series_id", "risk_title"], "left_anti").select("fund", "risk_title")


def coverage_gap_any(holds: DataFrame, exposed_to: DataFrame, covers: DataFrame) -> DataFrame:
    """Risks of a fund that no section of anyone covers."""
    return fund_risks(holds, exposed_to).join(covers.select("risk_title"), "risk_title", "left_anti").select("fund", "risk_title")


def over_coverage(holds: DataFrame, exposed_to: DataFrame, covers: DataFrame) -> DataFrame:
    """Sections of a fund about risks that none of its holdings has."""
    return covers.join(fund_risks(holds, exposed_to), ["fund", "risk_title"], "left_anti").select("fund", "section_key", "risk_title")


def gap_categories(gap: DataFrame, risk_factor: DataFrame) -> DataFrame:
    return gap.join(risk_factor, F.col("risk_title") == F.col("title")).select("fund", "category").distinct()


def coverage_summary(holds: DataFrame, exposed_to: DataFrame, covers: DataFrame, fund: DataFrame) -> DataFrame:
    """Per fund: exposed and covered risks, gaps and over-coverage."""
    count = lambda df, name: df.groupBy("fund").agg(F.count("*").alias(name))
    exposed, gap = fund_risks(holds, exposed_to), coverage_gap(holds, exposed_to, covers, fund)
    out = fund.select("fund").join(count(exposed, "n_exposed"), "fund", "left").join(count(gap, "n_gaps"), "fund", "left").join(count(over_coverage(holds, exposed_to, covers), "n_over"), "fund", "left")
    out = out.fillna(0, ["n_exposed", "n_gaps", "n_over"])
    return out.select("fund", "n_exposed", (F.col("n_exposed") - F.col("n_gaps")).alias("n_covered"), "n_gaps", "n_over")


def thirteen_f_entries(holds: DataFrame, company: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """13F rows: holdings with their CUSIP, whole-dollar value and the flags a reviewer needs. crosswalk: company, cusip, title_of_class."""
    out = holds.join(company.select("company", "name"), "company").join(crosswalk, "company", "left")
    flags = F.array_compact(F.array(F.when(F.col("cusip").isNull(), "NO_CUSIP"), F.when(F.col("value_usd").isNull(), "MISSING_VALUE"), F.when(F.col("shares").isNull(), "MISSING_SHARES")))
    return out.select("fund", F.col("name").alias("issuer"), F.coalesce("cusip", F.lit("")).alias("cusip"), F.coalesce("title_of_class", F.lit("COM")).alias("title_of_class"), F.bround("value_usd").cast("long").alias("value"), F.array_join(flags, ";").alias("flags"))


def thirteen_f_totals(entries: DataFrame) -> DataFrame:
    return entries.groupBy("fund").agg(F.count("*").alias("n_entries"), F.sum("value").alias("total_value"))


def xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def thirteen_f_xml(entries: DataFrame) -> DataFrame:
    """One information table for each fund, its entries by value, issuer and CUSIP."""
    row = F.concat(F.lit("<infoTable><nameOfIssuer>"), xml_escape(F.col("issuer")), F.lit("</nameOfIssuer><titleOfClass>"), xml_escape(F.col("title_of_class")), F.lit("</titleOfClass><cusip>"), xml_escape(F.col("cusip")), F.lit("</cusip><value>"), F.col("value").cast("string"), F.lit("</value></infoTable>"))
    keyed = entries.select("fund", F.struct((-F.col("value")).alias("v"), "issuer", "cusip", row.alias("row")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["row"]), "")
    return keyed.groupBy("fund").agg(F.concat(F.lit("<informationTable><!-- draft -->"), body, F.lit("</informationTable>")).alias("xml"))


def reviewer_rows(entries: DataFrame) -> DataFrame:
    """A reviewer's worksheet: a row for each holding, with what is missing or to be looked at."""
    return entries.select("fund", "issuer", "title_of_class", "cusip", "value", "flags")


def period_of(as_of: Column) -> Column:
    return F.coalesce(F.concat(F.year(as_of).cast("string"), F.lit("-Q"), F.quarter(as_of).cast("string")), F.lit("unknown"))


def report_packs(holds: DataFrame, exposed_to: DataFrame, covers: DataFrame, fund: DataFrame, supplies_to: DataFrame) -> DataFrame:
    """One row per fund: period, figures as canonical text (keys in order, no time stamps) and its hash."""
    figures = risk.concentration_summary(holds).join(coverage_summary(holds, exposed_to, covers, fund), "fund").join(holds.groupBy("fund").agg(F.max("as_of").alias("as_of")), "fund")
    top = risk.supplier_concentration(holds, supplies_to).groupBy("fund").agg(F.min_by("supplier", F.struct((-F.col("score")).alias("s"), "supplier")).alias("top_supplier"))
    figures = figures.join(top, "fund", "left")
    said = F.concat_ws(";", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in ("n_covered", "n_exposed", "n_gaps", "n_holdings", "n_over", "top_supplier")])
    period = period_of(F.col("as_of"))
    return figures.select("fund", F.concat(F.lit("pack_"), F.col("fund").cast("string"), F.lit("_"), period).alias("report_id"), period.alias("period"), said.alias("figures"), F.sha2(said, 256).alias("sha256"))
