"""Risk, traversal and disclosure queries over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fundloom.graphmodel import Graph, sql
from fundloom.operators import disclosure, risk, traversal
from fundloom.plans.graph_queries import CHANGES, changes


def crosswalk(g: Graph):
    """CUSIP of every issuer but the largest in size."""
    return g.company.where("country <= 40").select("company", F.lpad(F.col("company").cast("string"), 9, "0").alias("cusip"), F.lit("CL A").alias("title_of_class"))


def provenance(g: Graph):
    return risk.holding_provenance(g.holds, g.mentions, g.document)


def chain_pairs(g: Graph):
    """Pairs of issuers asked for a path: each with the one 7 further."""
    return g.company.select(F.col("company").alias("a"), (F.col("company") + 7).alias("b"))


def changed(g: Graph):
    """Issuers whose facts differ between the two versions."""
    return changes(g).where("name = 'Company' and change = 'changed'").select(F.col("subject").cast("long").alias("company"))


def duplicates(g: Graph):
    """Parts that agree in name, brand, type and size are one issuer, the smallest."""
    parts = g.table("part").select("p_partkey", F.struct("p_name", "p_brand", "p_type", "p_size").alias("k"))
    canon = parts.groupBy("k").agg(F.min("p_partkey").alias("canon"))
    return parts.join(canon, "k").where("p_partkey <> canon").select(F.col("p_partkey").alias("dup"), "canon")


BUILD = {
    "fund_holdings": lambda g: risk.fund_holdings(g.holds, g.company),
    "holding_suppliers": lambda g: risk.holding_suppliers(g.holds, g.supplies_to),
    "fund_exposures": lambda g: risk.fund_exposures(g.holds, g.exposed_to, g.risk_factor),
    "holding_provenance": provenance,
    "portfolio_hhi": lambda g: risk.portfolio_hhi(g.holds),
    "concentration_summary": lambda g: risk.concentration_summary(g.holds),
    "supplier_concentration": lambda g: risk.supplier_concentration(g.holds, g.supplies_to),
    "shared_supplier_clusters": lambda g: risk.shared_supplier_clusters(g.holds, g.supplies_to),
    "shared_suppliers": lambda g: risk.shared_suppliers(g.holds, g.supplies_to),
    "risk_heatmap": lambda g: risk.risk_heatmap(g.holds, g.exposed_to, g.risk_factor),
    "single_source_flags": lambda g: risk.single_source_flags(g.holds, g.supplies_to),
    "single_source_supplier_major": lambda g: risk.single_source_supplier_major(g.holds, g.supplies_to),
    "source_coverage": lambda g: risk.source_coverage(provenance(g)),
    "stale_sources": lambda g: risk.stale_sources(provenance(g), "2001-12-31"),
    "fund_comparison": lambda g: risk.fund_comparison(g.holds),
    "hhi_vs_average": lambda g: risk.hhi_vs_average(g.holds, g.managed_by),
    "concentration_table": lambda g: risk.concentration_table(g.holds, g.company),
    "hhi_explain_edges": lambda g: risk.top_holdings(g.holds),
    "top_k_holdings": lambda g: risk.firm_top_holdings(g.holds, g.managed_by),
    "structural_holdings": lambda g: risk.structural_holdings(g.holds, g.managed_by),
    "firm_directory": lambda g: risk.firm_directory(g.managed_by),
    "firm_companies": lambda g: risk.firm_companies(g.holds, g.managed_by),
    "reach_min_hops": lambda g: traversal.reach_min_hops(g.supplies_to, g.holds.select("company")),
    "second_order_chokepoints": lambda g: traversal.second_order_chokepoints(g.holds, g.supplies_to),
    "chokepoints_not_held": lambda g: traversal.chokepoints_not_held(g.holds, g.supplies_to),
    "supplier_dependents": lambda g: traversal.supplier_dependents(g.supplies_to, g.company),
    "exposure_path": lambda g: traversal.exposure_paths(g.supplies_to, chain_pairs(g)),
    "funds_holding": lambda g: traversal.funds_holding(g.holds, changed(g)),
    "repoint_entity": lambda g: traversal.repoint(g.supplies_to, duplicates(g)),
    "coverage_gap": lambda g: disclosure.coverage_gap(g.holds, g.exposed_to, g.covers, g.fund),
    "coverage_gap_any": lambda g: disclosure.coverage_gap_any(g.holds, g.exposed_to, g.covers),
    "over_coverage": lambda g: disclosure.over_coverage(g.holds, g.exposed_to, g.covers),
    "gap_categories": lambda g: disclosure.gap_categories(disclosure.coverage_gap(g.holds, g.exposed_to, g.covers, g.fund), g.risk_factor),
    "coverage_summary": lambda g: disclosure.coverage_summary(g.holds, g.exposed_to, g.covers, g.fund),
    "thirteen_f_entries": lambda g: disclosure.thirteen_f_entries(g.holds, g.company, crosswalk(g)),
    "thirteen_f_totals": lambda g: disclosure.thirteen_f_totals(disclosure.thirteen_f_entries(g.holds, g.company, crosswalk(g))),
    "write_13f_xml": lambda g: disclosure.thirteen_f_xml(disclosure.thirteen_f_entries(g.holds, g.company, crosswalk(g))),
    "write_reviewer_csv": lambda g: disclosure.reviewer_rows(disclosure.thirteen_f_entries(g.holds, g.company, crosswalk(g))),
    "report_packs": lambda g: disclosure.report_packs(g.holds, g.exposed_to, g.covers, g.fund, g.supplies_to),
}

SUM = "round(CAST(sum(CAST({} AS DECIMAL(28,6))) AS DOUBLE), {})"
HS = "hs AS (SELECT fund, company, weight_pct, dst, criticality, component FROM holds JOIN supplies_to ON company = src)"
PROV = "dated AS (SELECT company, count(DISTINCT doc_id) n, max(filing_date) newest FROM mentions LEFT JOIN document USING (doc_id) GROUP BY company), prov AS (SELECT fund, company, weight_pct, as_of, coalesce(n, 0) n_docs, newest FROM holds LEFT JOIN dated USING (company))"
HHI = f"hhi AS (SELECT fund, {SUM.format('weight_pct * weight_pct', 6)} hhi FROM holds GROUP BY fund)"
FLAGS = f"{HS}, flags AS (SELECT fund, company, coalesce(component, '') component, min(dst) supplier FROM hs GROUP BY 1, 2, 3 HAVING count(DISTINCT dst) = 1 AND bool_or(criticality = 'critical'))"
STEPS = "links AS (SELECT DISTINCT src, dst FROM supplies_to)"
REACH = f"{STEPS}, seeds AS (SELECT DISTINCT company AS seed FROM holds), walk AS (SELECT seed, dst AS node, 1 AS hops FROM seeds JOIN links ON seed = src UNION SELECT seed, b.dst, 2 FROM seeds JOIN links a ON seed = a.src JOIN links b ON a.dst = b.src), reach AS (SELECT seed, node, min(hops) hops FROM walk WHERE seed <> node GROUP BY ALL)"
RISKS = "risks AS (SELECT DISTINCT fund, risk_title FROM holds JOIN exposed_to USING (company))"
GAP = f"{RISKS}, gap AS (SELECT fund, risk_title FROM risks r JOIN fund USING (fund) WHERE NOT EXISTS (SELECT 1 FROM covers c WHERE starts_with(c.form_ref, series_id || ':') AND c.risk_title = r.risk_title))"
OVER = "over_ AS (SELECT fund, section_key, risk_title FROM covers c WHERE NOT EXISTS (SELECT 1 FROM risks r WHERE r.fund = c.fund AND r.risk_title = c.risk_title))"
SUMMARY = f"{GAP}, {OVER}, summary AS (SELECT fund, (SELECT count(*) FROM risks r WHERE r.fund = f.fund) n_exposed, (SELECT count(*) FROM gap r WHERE r.fund = f.fund) n_gaps, (SELECT count(*) FROM over_ r WHERE r.fund = f.fund) n_over FROM fund f)"
ENTRIES = "entries AS (SELECT fund, name AS issuer, CASE WHEN country <= 40 THEN lpad(CAST(company AS VARCHAR), 9, '0') ELSE '' END cusip, CASE WHEN country <= 40 THEN 'CL A' ELSE 'COM' END title_of_class, CAST(round_even(value_usd, 0) AS BIGINT) AS value, CASE WHEN country <= 40 THEN '' ELSE 'NO_CUSIP' END flags FROM holds JOIN company USING (company))"
CONC = f"conc AS (SELECT fund, count(*) n_holdings, {SUM.format('weight_pct', 4)} total_weight, {SUM.format('weight_pct * weight_pct', 4)} hhi, {SUM.format('CASE WHEN r <= 5 THEN weight_pct ELSE 0 END', 4)} top5_weight FROM (SELECT *, row_number() OVER (PARTITION BY fund ORDER BY weight_pct DESC, company) r FROM holds) GROUP BY fund)"
SUPP = f"{HS}, supp AS (SELECT fund, dst AS supplier, CAST(round(sum(share), 6) AS DOUBLE) score, count(DISTINCT company) n_holdings, count(*) n_edges FROM (SELECT *, CAST(weight_pct AS DECIMAL(18,6)) * CAST(CASE criticality WHEN 'critical' THEN 1.0 WHEN 'named' THEN 0.5 WHEN 'mentioned' THEN 0.2 ELSE 0 END AS DECIMAL(4,2)) AS share FROM hs) WHERE share > 0 GROUP BY ALL)"

SQL = {
    "fund_holdings": "SELECT fund, company, name, weight_pct, value_usd, as_of FROM holds JOIN company USING (company)",
    "holding_suppliers": f"WITH {HS} SELECT * FROM hs",
    "fund_exposures": "SELECT fund, company, weight_pct, risk_title, category, severity FROM holds JOIN exposed_to USING (company) JOIN risk_factor ON risk_title = title",
    "holding_provenance": f"WITH {PROV} SELECT * FROM prov",
    "portfolio_hhi": f"WITH {HHI} SELECT * FROM hhi",
    "concentration_summary": f"WITH {CONC} SELECT * FROM conc",
    "supplier_concentration": f"WITH {SUPP} SELECT * FROM supp",
    "shared_supplier_clusters": f"WITH {HS} SELECT fund, dst AS supplier, count(DISTINCT company) n_members, string_agg(DISTINCT component, ',' ORDER BY component) components FROM hs WHERE criticality = 'critical' GROUP BY ALL HAVING n_members >= 2",
    "shared_suppliers": f"WITH {HS} SELECT fund, dst AS supplier, count(DISTINCT company) n_holders FROM hs WHERE criticality = 'critical' GROUP BY ALL",
    "risk_heatmap": f"SELECT fund, category, {SUM.format('w', 6)} mass, count(*) n_companies FROM (SELECT fund, category, company, max(weight_pct) w FROM holds JOIN exposed_to USING (company) JOIN risk_factor ON risk_title = title GROUP BY ALL) GROUP BY ALL",
    "single_source_flags": f"WITH {FLAGS} SELECT * FROM flags",
    "single_source_supplier_major": f"WITH {HS}, each AS (SELECT DISTINCT fund, company, dst AS supplier, weight_pct FROM hs WHERE criticality = 'critical'), pf AS (SELECT supplier, fund, sum(CAST(weight_pct AS DECIMAL(28,6))) w FROM each GROUP BY ALL), dep AS (SELECT supplier, count(DISTINCT company) n FROM each GROUP BY ALL) SELECT supplier, count(*) n_funds, round(CAST(max(w) AS DOUBLE), 6) worst_weight, max(n) n_dependents FROM pf JOIN dep USING (supplier) GROUP BY supplier",
    "source_coverage": f"WITH {PROV}, c AS (SELECT fund, {SUM.format('weight_pct', 6)} total_weight, {SUM.format('CASE WHEN n_docs > 0 THEN weight_pct ELSE 0 END', 6)} covered_weight, count(*) FILTER (n_docs = 0) n_uncovered FROM prov GROUP BY fund) SELECT *, round(CASE WHEN total_weight > 0 THEN 100 * covered_weight / total_weight ELSE 0 END, 4) coverage_pct FROM c",
    "stale_sources": f"WITH {PROV} SELECT fund, company, date_diff('day', newest, DATE '2001-12-31') age_days FROM prov WHERE n_docs > 0 AND age_days > 180",
    "fund_comparison": f"WITH {HHI}, m AS (SELECT round(CAST(avg(hhi) AS DOUBLE), 4) mean_hhi, round(max(hhi) - min(hhi), 4) spread, arg_max(fund, (hhi, fund)) most_concentrated FROM hhi) SELECT *, round(hhi - mean_hhi, 4) delta FROM hhi, m",
    "hhi_vs_average": f"""WITH {HHI}, f AS (SELECT firm, round(avg(hhi), 6) firm_avg, count(*) n_funds FROM hhi JOIN managed_by USING (fund) GROUP BY firm), s AS (SELECT fund, count(*) n_holdings, max(weight_pct) top_weight FROM holds GROUP BY fund),
        x AS (SELECT *, CASE WHEN n_funds < 2 OR firm_avg <= 0 OR hhi <= 0 THEN 'none' WHEN hhi / firm_avg >= 1.05 THEN 'more' WHEN hhi / firm_avg <= 0.95 THEN 'less' ELSE 'none' END band FROM hhi JOIN managed_by USING (fund) JOIN f USING (firm) JOIN s USING (fund))
        SELECT *, printf('%s — HHI %.0f over %d holdings, top position %.1f%%.', CASE WHEN top_weight >= 15 THEN 'Highly concentrated' WHEN top_weight >= 10 THEN 'Moderately concentrated' ELSE 'Diversified' END, hhi, n_holdings, top_weight)
            || CASE band WHEN 'more' THEN printf(' ~%.1fx more concentrated than the firm average.', hhi / firm_avg) WHEN 'less' THEN printf(' ~%.1fx less concentrated than the firm average.', firm_avg / hhi) ELSE '' END AS interpretation FROM x""",
    "concentration_table": "SELECT fund, name, weight_pct FROM holds JOIN company USING (company)",
    "hhi_explain_edges": "SELECT fund, company, weight_pct, row_number() OVER (PARTITION BY fund ORDER BY weight_pct DESC, company) rank FROM holds QUALIFY rank <= 3",
    "top_k_holdings": f"SELECT firm, company, weight, row_number() OVER (PARTITION BY firm ORDER BY weight DESC, company) rank FROM (SELECT firm, company, {SUM.format('weight_pct', 6)} weight FROM holds JOIN managed_by USING (fund) GROUP BY ALL) QUALIFY rank <= 5",
    "structural_holdings": "WITH o AS (SELECT firm, fund, company, weight_pct FROM holds JOIN managed_by USING (fund)), h AS (SELECT firm, company, max(weight_pct) w FROM o GROUP BY ALL), t AS (SELECT firm, string_agg(CAST(company AS VARCHAR), ',' ORDER BY w DESC, company) AS top FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY firm ORDER BY w DESC, company) <= 5) GROUP BY firm) SELECT firm, count(DISTINCT fund) n_funds, count(DISTINCT company) n_companies, max(top) AS top FROM o JOIN t USING (firm) GROUP BY firm",
    "firm_directory": "SELECT firm, count(*) n_funds, string_agg(CAST(fund AS VARCHAR), ',' ORDER BY fund) funds FROM managed_by GROUP BY firm",
    "firm_companies": "SELECT DISTINCT firm, company FROM holds JOIN managed_by USING (fund)",
    "reach_min_hops": f"WITH {REACH} SELECT * FROM reach",
    "second_order_chokepoints": f"WITH {REACH} SELECT fund, node, count(DISTINCT company) n_reachers, count(*) FILTER (hops = 2) n_two_hop FROM holds JOIN reach ON company = seed GROUP BY ALL HAVING n_reachers >= 3 AND n_two_hop > 0",
    "chokepoints_not_held": f"WITH {REACH} SELECT h.fund, node, count(DISTINCT company) n_holdings FROM holds h JOIN reach ON company = seed WHERE NOT EXISTS (SELECT 1 FROM holds o WHERE o.fund = h.fund AND o.company = node) GROUP BY ALL",
    "supplier_dependents": f"WITH {STEPS}, walk AS (SELECT company, company AS dependent, 0 AS hops FROM company UNION SELECT company, src, 1 FROM company JOIN links ON dst = company UNION SELECT company, b.src, 2 FROM company JOIN links a ON a.dst = company JOIN links b ON b.dst = a.src) SELECT company, dependent, min(hops) hops FROM walk GROUP BY ALL",
    "exposure_path": f"""WITH {STEPS}, l0 AS (SELECT company AS a, company AS spot, [company] AS path FROM company), l1 AS (SELECT a, dst AS spot, min(list_append(path, dst)) AS path FROM l0 JOIN links ON spot = src GROUP BY ALL), l2 AS (SELECT a, dst AS spot, min(list_append(path, dst)) AS path FROM l1 JOIN links ON spot = src GROUP BY ALL), l3 AS (SELECT a, dst AS spot, min(list_append(path, dst)) AS path FROM l2 JOIN links ON spot = src GROUP BY ALL), l4 AS (SELECT a, dst AS spot, min(list_append(path, dst)) AS path FROM l3 JOIN links ON spot = src GROUP BY ALL), l5 AS (SELECT a, dst AS spot, min(list_append(path, dst)) AS path FROM l4 JOIN links ON spot = src GROUP BY ALL), every AS (SELECT l1.a, spot AS b, 1 AS hops, path FROM l1 WHERE spot = a + 7 UNION ALL SELECT l2.a, spot AS b, 2 AS hops, path FROM l2 WHERE spot = a + 7 UNION ALL SELECT l3.a, spot AS b, 3 AS hops, path FROM l3 WHERE spot = a + 7 UNION ALL SELECT l4.a, spot AS b, 4 AS hops, path FROM l4 WHERE spot = a + 7 UNION ALL SELECT l5.a, spot AS b, 5 AS hops, path FROM l5 WHERE spot = a + 7),
        best AS (SELECT a, b, arg_min(path, hops) AS path, min(hops) AS hops FROM every GROUP BY a, b), named AS (SELECT src, dst, min(coalesce(component, criticality, 'supplies_to')) AS label FROM supplies_to GROUP BY ALL),
        steps AS (SELECT a, b, i, path[i] AS u, path[i + 1] AS v FROM (SELECT *, unnest(range(1, hops + 1)) AS i FROM best)), said AS (SELECT a, b, string_agg(label, '>' ORDER BY i) AS labels FROM steps JOIN named ON u = src AND v = dst GROUP BY a, b)
        SELECT a, b, hops, array_to_string(path, '>') AS path, labels FROM best JOIN said USING (a, b)""",
    "funds_holding": f"WITH {CHANGES} SELECT fund, count(DISTINCT company) n_held, {SUM.format('weight_pct', 6)} weight FROM holds WHERE company IN (SELECT CAST(subject AS BIGINT) FROM changes WHERE name = 'Company' AND change = 'changed') GROUP BY fund",
    "repoint_entity": "WITH k AS (SELECT p_partkey AS dup, min(p_partkey) OVER (PARTITION BY p_name, p_brand, p_type, p_size) AS canon FROM part), moved AS (SELECT a.canon s, b.canon d, component, (a.dup <> a.canon OR b.dup <> b.canon) m FROM supplies_to JOIN k a ON src = a.dup JOIN k b ON dst = b.dup) SELECT s AS src, d AS dst, arg_max(component, (m, component)) component, count(*) n_merged FROM moved WHERE s <> d GROUP BY s, d",
    "coverage_gap": f"WITH {GAP} SELECT * FROM gap",
    "coverage_gap_any": f"WITH {RISKS} SELECT fund, risk_title FROM risks WHERE risk_title NOT IN (SELECT risk_title FROM covers)",
    "over_coverage": f"WITH {RISKS}, {OVER} SELECT * FROM over_",
    "gap_categories": f"WITH {GAP} SELECT DISTINCT fund, category FROM gap JOIN risk_factor ON risk_title = title",
    "coverage_summary": f"WITH {SUMMARY} SELECT fund, n_exposed, n_exposed - n_gaps AS n_covered, n_gaps, n_over FROM summary",
    "thirteen_f_entries": f"WITH {ENTRIES} SELECT * FROM entries",
    "thirteen_f_totals": f"WITH {ENTRIES} SELECT fund, count(*) n_entries, CAST(sum(value) AS BIGINT) total_value FROM entries GROUP BY fund",
    "write_13f_xml": f"WITH {ENTRIES} SELECT fund, '<informationTable><!-- draft -->' || string_agg('<infoTable><nameOfIssuer>' || issuer || '</nameOfIssuer><titleOfClass>' || title_of_class || '</titleOfClass><cusip>' || cusip || '</cusip><value>' || value || '</value></infoTable>', '' ORDER BY value DESC, issuer, cusip) || '</informationTable>' AS xml FROM entries GROUP BY fund",
    "write_reviewer_csv": f"WITH {ENTRIES} SELECT fund, issuer, title_of_class, cusip, value, flags FROM entries",
    "report_packs": f"""WITH {SUMMARY}, {CONC}, {SUPP}, top AS (SELECT fund, arg_min(supplier, (-score, supplier)) t FROM supp GROUP BY fund), dated AS (SELECT fund, max(as_of) d FROM holds GROUP BY fund),
        said AS (SELECT fund, year(d) || '-Q' || quarter(d) AS period, 'n_covered=' || (n_exposed - n_gaps) || ';n_exposed=' || n_exposed || ';n_gaps=' || n_gaps || ';n_holdings=' || n_holdings || ';n_over=' || n_over || ';top_supplier=' || coalesce(CAST(t AS VARCHAR), 'null') AS figures
            FROM conc JOIN summary USING (fund) JOIN dated USING (fund) LEFT JOIN top USING (fund))
        SELECT fund, 'pack_' || fund || '_' || period AS report_id, period, figures, sha256(figures) AS sha256 FROM said""",
}

QUERIES = {name: (lambda spark, sf_dir, build=build: build(Graph(spark, sf_dir))) for name, build in BUILD.items()}
ORACLE_SQL = {name: sql(body) for name, body in SQL.items()}
