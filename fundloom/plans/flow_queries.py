"""Evidence, onboarding, queue, report and ontology queries over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fundloom.functions import ontology as onto
from fundloom.functions import text as tf
from fundloom.graphmodel import CATEGORIES, Graph, sql
from fundloom.operators import disclosure, evidence, impact, ingestflow, mdm, onboard, reports, risk, scope, sets, simjoin, steward, textjobs, traversal
from fundloom.plans.graph_queries import CHANGES, DERIVED, FIRM, FORM_CASE, INTERNAL_CASE, NORM, REACHED, RECORDS, RESOLVED, STRIPPED, WS, changes, derived, fund_changes, golden, holdings_reached, kept_lines, mentions, records, spine, stamped
from fundloom.plans.more_queries import ROLES, budget_lists, roles
from fundloom.plans.risk_queries import HHI, PROV, REACH, SUM, SUPP, chain_pairs, provenance
from fundloom.sources.filings import scan_documents
from fundloom.sources.tables import written

PREFIXES = {"fibo-fnd-plc-rp": "https://spec.edmcouncil.org/fibo/ontology/FND/Places/RealProperty/", "cmns-org": "https://www.omg.org/spec/Commons/Organizations/", "ex": "https://example.org/", "ex-sub": "https://example.org/sub/"}
SYSTEM_RANKS = {"curated": 3, "pms": 2}
ITEM = r"(?i)^\s*(item|part)?\s*[^ ]{1,30}\.$"


def text_of(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def chunks(g: Graph) -> DataFrame:
    """A chunk for each part of an order, in the order of parts."""
    lines = g.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("company")).distinct()
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("company"))
    doc = g.document.select("doc_id", "sensitivity")
    return lines.withColumn("n", n).join(doc, "doc_id").select("doc_id", F.concat(text_of("doc_id"), F.lit("_c"), text_of("n")).alias("chunk_id"), text_of("n").alias("page"), "company", F.when(F.col("n") % 7 != 0, F.concat(F.lit("Order "), text_of("doc_id"), F.lit(" has part "), text_of("company"))).alias("text"), "sensitivity")


CHUNK = "chunk AS (SELECT doc_id, doc_id || '_c' || n AS chunk_id, CAST(n AS VARCHAR) AS page, company, CASE WHEN n % 7 <> 0 THEN 'Order ' || doc_id || ' has part ' || company END AS text, sensitivity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY company) AS n FROM (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS company FROM lineitem)) JOIN document USING (doc_id))"
OWN = f"own AS (SELECT fund FROM managed_by WHERE firm = {FIRM}), mine AS (SELECT DISTINCT company FROM holds WHERE fund IN (FROM own)), stamped AS (SELECT o_orderkey AS doc_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_nationkey IN (FROM own))"


def briefings(g: Graph) -> DataFrame:
    g = kept_lines(g)
    holds = written(g.holds.select("fund", "company", "weight_pct"), "briefing-holds")
    return reports.impact_briefings(written(holdings_reached(g, fund_changes(g), holds), "holdings-reached"), holds)


def event(g: Graph) -> DataFrame:
    """An event counts targets, so what changed is left out where it leads to documents."""
    g = kept_lines(g)
    diff = written(changes(g), "changes")
    matched = impact.trigger_match(diff).withColumn("subject", F.lit(None).cast("string"))
    return reports.impact_event(diff, holdings_reached(g, diff, g.holds).unionByName(impact.documents_reached(matched, g.covers, derived(g)).drop("rule")))


def titled(g: Graph) -> DataFrame:
    return g.document.withColumn("title", F.concat(F.lit("Order "), text_of("doc_id")))


def held(g: Graph) -> DataFrame:
    return scope.held_by(g.holds, g.managed_by, FIRM)


def asked(g: Graph) -> DataFrame:
    """Each fund asks for its three heaviest holdings."""
    return risk.top_holdings(g.holds).select(F.col("fund").alias("query"), "company")


ASKED = "asked AS (SELECT fund AS query, company FROM holds QUALIFY row_number() OVER (PARTITION BY fund ORDER BY weight_pct DESC, company) <= 3)"
EVIDENCE = f"{CHUNK}, {ASKED}, ev AS (SELECT DISTINCT query, chunk_id, doc_id, 'Order ' || doc_id AS title, coalesce(sensitivity, 'public') = 'public' AS visible FROM asked JOIN chunk USING (company))"


def evidence_of(g: Graph) -> DataFrame:
    return evidence.evidence_chunks(asked(g), chunks(g), chunks(g).select("chunk_id", "company"), titled(g), ["public"])


def nearest(g: Graph) -> DataFrame:
    """The five first chunks of each nation's first orders, as a vector search might give them."""
    w = Window.partitionBy("query").orderBy("doc_id", "chunk_id")
    mine = chunks(g).join(g.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("fund").alias("query")), "doc_id")
    return mine.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query", "chunk_id", "rank")


NEAREST = "nearest AS (SELECT CAST(c_nationkey AS BIGINT) AS query, chunk_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY doc_id, chunk_id) AS rank FROM chunk JOIN orders ON doc_id = o_orderkey JOIN customer ON o_custkey = c_custkey QUALIFY rank <= 5)"


def filing(g: Graph) -> DataFrame:
    """Positions as new filings give them."""
    ids = g.company.select("company", F.concat(F.lit("t"), text_of(F.col("company") % 90)).alias("ticker"), F.when(F.col("company") % 3 == 0, F.concat(F.lit("L"), text_of("company"))).alias("lei"))
    return g.holds.join(ids, "company").select("fund", text_of("fund").alias("series_id"), F.concat(F.lit("c"), text_of("fund")).alias("cik"), F.when(F.col("fund") % 2 == 0, F.concat(F.lit("F"), text_of("fund"))).alias("fund_lei"), "company", "ticker", "lei", F.round(F.col("weight_pct") * 2, 6).alias("weight_pct"))


def known(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = g.fund.select("fund", F.lit("old").alias("series_id"), F.lit(None).cast("string").alias("cik"), F.lit("old").alias("lei"))
    c = g.company.select("company", F.when(F.col("country") > 25, F.concat(F.lit("k"), text_of("company"))).alias("ticker"), F.lit(None).cast("string").alias("lei"))
    return f, c, g.holds.select("fund", "company", "weight_pct")


def queue(g: Graph) -> DataFrame:
    """Customers' names as a queue of unresolved mentions."""
    k = F.col("c_custkey")
    return g.table("customer").select(k.alias("id"), F.lit("provisional").alias("status"), F.when(k % 4 == 0, F.concat(F.lit("0"), text_of(k))).alias("cik"), (k % 10 / 10.0).alias("confidence"), F.col("c_name").alias("mention"), F.lit(None).cast("string").alias("ticker"))


def actions(g: Graph) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "merge").when(F.col("o_orderstatus") == "P", "promote").otherwise("reject")
    return g.table("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), kind.alias("action"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("9"), text_of("o_orderkey"))).alias("cik"))


QUEUE = "queue AS (SELECT c_custkey AS id, 'provisional' AS status, CASE WHEN c_custkey % 4 = 0 THEN '0' || c_custkey END AS cik, c_custkey % 10 / 10.0 AS confidence, c_name AS mention FROM customer)"
APPLIED = f"{QUEUE}, acts AS (SELECT o_custkey AS i2, arg_max(CASE o_orderstatus WHEN 'F' THEN 'merge' WHEN 'P' THEN 'promote' ELSE 'reject' END, o_orderkey) AS action, max(o_orderkey) AS newest FROM orders GROUP BY o_custkey), applied AS (SELECT id, CASE action WHEN 'merge' THEN 'merged' WHEN 'promote' THEN 'promoted' WHEN 'reject' THEN 'rejected' ELSE status END AS status, CASE WHEN action IN ('merge', 'promote') AND newest % 3 = 0 THEN '9' || newest ELSE cik END AS cik, CASE WHEN action IN ('merge', 'promote') THEN 1.0 ELSE confidence END AS confidence FROM queue LEFT JOIN acts ON id = i2)"


def applied(g: Graph) -> DataFrame:
    return onboard.queue_apply(queue(g).select("id", "status", "cik", "confidence"), actions(g))


def filings(g: Graph) -> DataFrame:
    """Orders as filings of their nation's series; the text of some names another."""
    other = F.when(F.col("o_orderpriority").startswith("3"), F.lit("<seriesId>S999</seriesId>")).when(F.col("o_orderpriority").startswith("4"), F.lit("no id")).otherwise(F.concat(F.lit("< SeriesId >s"), text_of("fund"), F.lit("</seriesId>")))
    return g.orders.select(F.concat(F.lit("S"), text_of("fund")).alias("series_id"), F.col("o_orderdate").cast("date").alias("filing_date"), F.col("o_orderkey").alias("accession"), other.alias("xml"))


FILINGS = "filings AS (SELECT 'S' || c_nationkey AS series_id, CAST(o_orderdate AS DATE) AS filing_date, o_orderkey AS accession, o_orderpriority AS p FROM orders JOIN customer ON o_custkey = c_custkey)"


def report(g: Graph) -> DataFrame:
    return reports.risk_report(g.holds, g.supplies_to, g.exposed_to, g.risk_factor, provenance(g))


def gap_categories(g: Graph) -> DataFrame:
    return disclosure.gap_categories(disclosure.coverage_gap(g.holds, g.exposed_to, g.covers, g.fund), g.risk_factor)


FLAGS = "flags AS (SELECT fund, company, component, min(dst) s FROM hs GROUP BY 1, 2, 3 HAVING count(DISTINCT dst) = 1 AND bool_or(criticality = 'critical'))"
REPORT = f"""{PROV}, {SUPP}, {FLAGS}, {HHI}, heat AS (SELECT fund, category, {SUM.format('w', 6)} mass FROM (SELECT fund, category, company, max(weight_pct) w FROM holds JOIN exposed_to USING (company) JOIN risk_factor ON risk_title = title GROUP BY ALL) GROUP BY ALL),
clus AS (SELECT fund, dst FROM hs WHERE criticality = 'critical' GROUP BY ALL HAVING count(DISTINCT company) >= 2), cov AS (SELECT fund, {SUM.format('weight_pct', 6)} t, {SUM.format('CASE WHEN n_docs > 0 THEN weight_pct ELSE 0 END', 6)} c FROM prov GROUP BY fund),
report AS (SELECT h.fund, h.hhi, n.n AS n_holdings, n.t AS total_weight, s.supplier AS top_supplier, s.score AS top_score, s.n_holdings AS top_n, k.category AS top_category, k.mass AS top_mass, coalesce(f.n, 0) AS n_flags, coalesce(c.n, 0) AS n_clusters, round(CASE WHEN cov.t > 0 THEN 100 * cov.c / cov.t ELSE 0 END, 4) AS covered_pct
    FROM hhi h JOIN (SELECT fund, count(*) n, {SUM.format('weight_pct', 6)} t FROM holds GROUP BY fund) n USING (fund) LEFT JOIN (SELECT * FROM supp QUALIFY row_number() OVER (PARTITION BY fund ORDER BY score DESC, supplier) = 1) s USING (fund)
    LEFT JOIN (SELECT * FROM heat QUALIFY row_number() OVER (PARTITION BY fund ORDER BY mass DESC, category) = 1) k USING (fund) LEFT JOIN (SELECT fund, count(*) n FROM flags GROUP BY fund) f USING (fund) LEFT JOIN (SELECT fund, count(*) n FROM clus GROUP BY fund) c USING (fund) JOIN cov USING (fund)),
risks AS (SELECT DISTINCT fund, risk_title FROM holds JOIN exposed_to USING (company)), miss AS (SELECT fund, string_agg(DISTINCT category, ', ' ORDER BY category) AS m FROM risks r JOIN risk_factor ON risk_title = title WHERE NOT EXISTS (SELECT 1 FROM covers c WHERE c.fund = r.fund AND c.risk_title = r.risk_title) GROUP BY fund)"""


def packs(g: Graph) -> DataFrame:
    return disclosure.report_packs(g.holds, g.exposed_to, g.covers, g.fund, g.supplies_to).withColumn("title", F.concat(F.lit("Exposure "), text_of("fund")))


def registry(g: Graph) -> DataFrame:
    """Half of the funds have a report already."""
    return packs(g).where("fund < 13").select("report_id", F.lit("old").alias("title"), "period", F.lit("0").alias("sha256"), F.lit("2020-01-01").alias("created_at"))


def reports_of(g: Graph) -> DataFrame:
    """Documents and chunks that each fund's report names; some don't exist."""
    d = g.orders.select(F.concat(F.lit("pack_"), text_of("fund")).alias("report_id"), F.when(F.col("o_orderstatus") == "P", -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("doc_id"))
    return d.withColumn("chunk_id", F.concat(text_of("doc_id"), F.lit("_c3")))


def entities(g: Graph) -> DataFrame:
    """Orders' suppliers and customers as extracted entities: typed by status, with attributes."""
    attrs = F.create_map(F.lit("role"), F.when(F.col("o_orderpriority").startswith("1"), F.lit("Bond issuer")), F.lit("property_type"), F.when(F.col("o_orderpriority").startswith("2"), F.lit(" Office ")).otherwise("barn"), F.lit("unknown"), F.lit("x"))
    label = F.element_at(F.array(*map(F.lit, ["Company", "RealProperty", "Fund", "Person"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return g.table("orders").select(F.col("o_orderkey").alias("id"), label.alias("label"), F.col("o_orderstatus").alias("category"), attrs.alias("attributes"))


ENTITY = "entity AS (SELECT o_orderkey AS id, (['Company', 'RealProperty', 'Fund', 'Person'])[o_orderkey % 4 + 1] AS label, o_orderstatus AS category, o_orderpriority LIKE '1%' AS issuer, o_orderpriority LIKE '2%' AS office FROM orders)"
CLASS_CASE = f"CASE WHEN label = 'Company' AND issuer THEN '{onto.DEBT_ISSUER}' WHEN label = 'RealProperty' AND office THEN '{onto.PROPERTY_CLASS}' " + " ".join(f"WHEN label = '{k}' THEN '{v}'" for k, v in onto.LABEL_CLASS.items()) + " END"


def spine_funds(g: Graph) -> DataFrame:
    return g.fund.select("series_id", F.concat(F.lit("00"), text_of("fund")).alias("cik"), F.array(F.concat(F.lit("f."), text_of("fund")), F.concat(F.lit("G"), text_of(F.col("fund") % 10))).alias("tickers"), F.col("fund").alias("ord"))


def asked_funds(g: Graph) -> DataFrame:
    k = F.col("c_custkey")
    return g.table("customer").select(F.when(k % 3 == 0, text_of(k % 40)).alias("series_id"), F.when(k % 2 == 0, F.concat(F.lit(" F-"), text_of(k % 50))).otherwise(F.concat(F.lit("g"), text_of(k % 20))).alias("ticker"))


def groups(g: Graph) -> DataFrame:
    """Canonical names of resolved mentions, with what existing companies are looked up by."""
    r = steward.resolve_mentions(mentions(g), spine(g)).withColumns({"key": steward.mention_key(), "norm": steward.normalize_name(F.col("mention"))})
    return steward.canonical_names(steward.resolve_mentions(mentions(g), spine(g))).join(r.groupBy("key").agg(F.max("cik").alias("cik"), F.min("norm").alias("norm")), "key").select("key", "cik", "norm", "canonical")


def existing(g: Graph) -> DataFrame:
    """Every other issuer is known already, some by cik and some by norm."""
    return g.company.where("country > 25").select("name", F.when(F.col("country") > 35, steward.pad_cik(F.col("company") * 37)).alias("cik"), steward.normalize_name(F.col("name")).alias("norm"))


def extraction(g: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks of orders with the entities and relations that an extractor might give; some spans are altered, some made up."""
    # Written, as all three tables take it, some of them twice.
    c = written(chunks(g).where("text is not null").select("doc_id", "chunk_id", "page", "company", "text"), "extraction-chunks")
    span = F.when(F.col("company") % 11 == 0, F.lit("nothing of the kind was said anywhere")).when(F.col("company") % 5 == 0, F.upper(F.replace("text", F.lit(" "), F.lit("  ")))).when(F.col("company") % 13 == 0, F.replace("text", F.lit("has"), F.lit("hbs"))).otherwise(F.col("text"))
    name = F.concat(F.lit("Part#"), F.lpad(text_of("company"), 9, "0"), F.when(F.col("company") % 2 == 0, F.lit(", Inc.")).otherwise(""))
    base = c.select("doc_id", "chunk_id", (F.col("doc_id") * 100 + F.col("page").cast("int")).alias("ord"), name.alias("name"), span.alias("span"), "company")
    e = base.select("doc_id", "chunk_id", "ord", F.when(F.col("company") % 17 == 0, "Fund").otherwise("Company").alias("label"), "name", "span")
    ahead = F.lead("name").over(Window.partitionBy("doc_id").orderBy("ord"))
    r = base.withColumn("object", ahead).where("object is not null").select("doc_id", "chunk_id", "ord", F.when(F.col("company") % 3 == 0, "SUBSIDIARY_OF").otherwise("SUPPLIES_TO").alias("rel"), F.col("name").alias("subject"), "object", "span", ((F.col("company") % 10) / 10.0 + 0.05).alias("confidence"))
    return c.select("doc_id", "chunk_id", "text"), e, r


def spec(g: Graph) -> DataFrame:
    return g.spark.createDataFrame([("SUPPLIES_TO", ["Company"], ["Company"]), ("SUBSIDIARY_OF", ["Company"], ["Company"]), ("MANAGED_BY", ["Fund"], ["Company"]), ("HOLDS", ["Fund"], ["Company"])], "rel string, domain array<string>, range array<string>")


def ingested(g: Graph) -> dict[str, DataFrame]:
    c, e, r = extraction(g)
    none = g.supplies_to.select(F.col("src").cast("string").alias("subject"), F.lit("SUPPLIES_TO").alias("rel"), F.col("dst").cast("string").alias("object"), F.lit(1).cast("long").alias("corroboration"))
    return ingestflow.ingest_documents(e, r, c, spine(g), written(none, "extraction-known"), spec(g))


def gate(g: Graph) -> DataFrame:
    c, e, _ = extraction(g)
    return ingestflow.grounding_gate(e, c).select("chunk_id", "name", "grounded")


def rejected(g: Graph) -> DataFrame:
    flow = ingested(g)
    return ingestflow.write_rejected(flow["claims"], flow["decisions"]).select("fact_id", "reason", "doc_id", F.round("confidence", 4).alias("confidence"))


def firm_chunks(g: Graph) -> DataFrame:
    """Chunks of each firm: those that mention an issuer its funds hold."""
    return risk.firm_companies(g.holds, g.managed_by).join(chunks(g).select("chunk_id", "company"), "company").select("firm", "chunk_id").distinct()


def results(g: Graph) -> DataFrame:
    """Analytics results: each supplier with the issuers that depend on it; some are about none."""
    return g.supplies_to.groupBy(F.col("dst").alias("result")).agg(F.collect_set(F.when(F.col("criticality") != "rumoured", F.col("src"))).alias("entities"))


def named_documents(g: Graph, k: int) -> DataFrame:
    """ord, name: the even or odd documents under their first three words, as names that are like each other by chance and as near copies are."""
    head = F.regexp_extract(F.coalesce("text", F.lit("")), r"[^ \t\n]+(?:[ \t\n]+[^ \t\n]+){0,2}", 0)
    words = F.regexp_extract_all(head, F.lit(r"[^ \t\n]+"), F.lit(0))
    return g.table("documents").where(F.col("doc_id") % 2 == k).select(F.col("doc_id").alias("ord"), F.array_join(F.slice(words, 1, 3), " ").alias("name"))


def itemised(g: Graph) -> DataFrame:
    """Documents whose third, fifth and seventh lines (and their multiples) head items."""
    head = lambda line, i: F.when(i % 3 == 0, F.concat(F.lit("  Item 1A. "), line)).when(i % 5 == 0, F.concat(F.lit("ITEM 7: "), line)).when(i % 7 == 0, F.concat(F.lit("item 1 "), line)).otherwise(line)
    return g.table("documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda line, i: head(line, i + 1)), "\n").alias("text"))


BUILD = {
    "item_sections": lambda g: sets.item_sections(itemised(g), ["1A", "Item 7"]).select("doc_id", F.md5("text").alias("text_md5"), F.char_length("text").alias("n_chars")),
    "firm_scope_chunks": lambda g: evidence.firm_scope_chunks(chunks(g), chunks(g).select("chunk_id", "company"), held(g), stamped(g)).select("chunk_id"),
    "firm_has_chunks": lambda g: evidence.firm_has_chunks(firm_chunks(g), g.firm),
    "evidence_chunks": evidence_of,
    "citation_union": lambda g: evidence.citation_union(evidence_of(g).where("visible"), nearest(g)),
    "vector_post_filter": lambda g: evidence.post_filtered(nearest(g), chunks(g), ["public"]),
    "entity_union": lambda g: evidence.entity_union(asked(g).select("query", text_of("company").alias("entity")), g.holds.join(g.supplies_to, F.col("company") == F.col("src")).where("criticality = 'critical'").select(F.col("fund").alias("query"), text_of("dst").alias("entity"))),
    "vocab_union": lambda g: evidence.vocab_union(g.table("part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.concat(F.lit("T"), text_of(F.col("p_partkey") % 70)).alias("ticker"))),
    "documents_view": lambda g: evidence.documents_view(titled(g), chunks(g), ["public"]).select("doc_id", "title", "n_spans", F.md5("text").alias("text_md5")),
    "node_label_coalesce": lambda g: g.table("orders").select(F.col("o_orderkey").alias("id"), evidence.node_label(F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("n"), text_of("o_orderkey"))), F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")), kind="Document").alias("label")),
    "strip_embedding": lambda g: g.table("embeddings").select("vec_id", onto.sorted_text(evidence.strip_embedding(F.create_map(F.lit("embedding"), F.lit("v"), F.lit("label"), text_of("label")))).alias("props")),
    "edge_limit": lambda g: evidence.edge_limit(scope.firm_scope_edges(FIRM, g.managed_by, g.holds, g.supplies_to, g.exposed_to, g.mentions)),
    "analytics_in_firm": lambda g: evidence.analytics_in_firm(results(g), held(g)).select("result"),
    "chokepoint_paths": lambda g: evidence.chokepoint_paths(g.holds, g.supplies_to),
    "coverage_gap_paths": lambda g: evidence.coverage_gap_paths(g.holds, g.exposed_to, g.risk_factor, g.covers),
    "board_paths": lambda g: evidence.board_paths(sets.board_links(roles(g), g.company)),
    "exposure_steps": lambda g: evidence.exposure_steps(traversal.exposure_paths(g.supplies_to, chain_pairs(g))),
    "ui_paths": lambda g: evidence.shared_supplier_paths(g.holds, g.supplies_to),
    "top_holdings_filter": lambda g: onboard.top_holdings_filter(g.table("part").select("p_partkey", F.when(F.col("p_size") == 1, " n/a ").when(F.col("p_size") == 2, "").when(F.col("p_size") != 3, F.col("p_name")).alias("name"))),
    "fund_universe": lambda g: onboard.fund_universe(g.fund, g.managed_by, FIRM).select("fund", "name"),
    "entitlement_scope": lambda g: g.table("conversations").select("conv_id", "turn", F.array_join(scope.entitlement_scope(F.array(F.upper("role"), F.lit(" Internal "), F.lit(""))), ",").alias("scope")),
    "queue_apply": applied,
    "queue_by_status": lambda g: onboard.queue_by_status(applied(g), "merged").select("id", "cik"),
    "queue_projection": lambda g: onboard.queue_projection(applied(g)),
    "enqueue_provisional": lambda g: onboard.enqueue_provisional(queue(g), steward.resolve_mentions(mentions(g), spine(g))).select("id", "mention", "status"),
    "item_triple_projection": lambda g: reports.fact_triples(changes(g)),
    "upsert_holds": lambda g: onboard.upsert_holds(*known(g), filing(g))[2],
    "upsert_holds_funds": lambda g: onboard.upsert_holds(*known(g), filing(g))[0],
    "upsert_holds_companies": lambda g: onboard.upsert_holds(*known(g), filing(g))[1],
    "upsert_firm_and_managed_by": lambda g: onboard.upsert_firm_and_managed_by(g.firm.select("firm", F.lit("old").alias("cik"), F.lit(None).cast("string").alias("lei")), g.managed_by, g.managed_by.select((F.col("firm") + 3).alias("firm"), (F.col("fund") + 20).alias("fund"), F.when(F.col("fund") % 2 == 0, text_of("fund")).alias("cik"), F.lit("L").alias("lei")))[0],
    "latest_filing": lambda g: onboard.latest_filing(filings(g)),
    "series_guard": lambda g: onboard.series_guard(filings(g)).select("series_id", "accession"),
    "spine_lookup_fund": lambda g: onboard.spine_lookup_fund(asked_funds(g), spine_funds(g)),
    "canonical_existing_lookup": lambda g: onboard.canonical_existing(groups(g), existing(g)),
    "enrich_lei": lambda g: onboard.enrich_lei(g.company.select("company", F.upper("name").alias("title")), g.company.where("country > 10").select(F.concat(F.lit(" "), "name").alias("legal_name"), F.concat(F.lit("L"), text_of("company")).alias("lei"))).select("company", "lei"),
    "existing_edges": lambda g: onboard.existing_edges(g.supplies_to.select(text_of("src").alias("subject"), F.lit("SUPPLIES_TO").alias("rel"), text_of("dst").alias("object")), changes(g).where("kind = 'relation' and change = 'added'").select("subject", F.col("name").alias("rel"))),
    "attach_lei": lambda g: onboard.attach_lei(named_documents(g, 0).select("ord", "name", F.when(F.col("ord") % 8 == 0, "has").alias("lei")), named_documents(g, 1).select("ord", "name", F.concat(F.lit("L"), text_of("ord")).alias("lei"))),
    "name_containment": lambda g: simjoin.containment_pairs(named_documents(g, 0).select(F.lower("name").alias("a")), named_documents(g, 1).select(F.lower(F.substring_index("name", " ", 2)).alias("b"))),
    "name_pairs": lambda g: simjoin.name_pairs(named_documents(g, 0).select(F.lower("name").alias("a")), named_documents(g, 1).select(F.lower("name").alias("b"))),
    "name_similarity": lambda g: g.company.join(g.table("part").select(F.col("p_partkey").alias("company"), "p_name", "p_type"), "company").select("company", onboard.candidate_score(F.lit("red ring"), F.col("p_name"), F.when(F.col("country") > 25, "fund_family").otherwise("company"), F.when(F.col("country") > 10, "edgar").otherwise("gleif"), F.when(F.col("country") > 5, F.lit("1")), F.lit(None).cast("string"), F.col("country")).alias("score")),
    "onboard_holdings": lambda g: onboard.onboard_holdings(g.holds.join(g.company.select("company", F.concat(F.lit("The PART#"), F.lpad(text_of(F.col("company") % 300), 9, "0"), F.lit(", Corp")).alias("company_name")), "company"), g.managed_by, steward.resolve_mentions(mentions(g).select("mention", F.lit(None).cast("string").alias("ticker")).distinct(), spine(g))),
    "enrich_firms": lambda g: onboard.enrich_firms(budgeted(g), g.table("documents").select(F.concat(F.lit("c"), text_of("doc_id")).alias("key"), "doc_id", "text")).select("firm", "kind", "key", "doc_id", F.md5("text").alias("text_md5")),
    "link_subject": lambda g: onboard.link_subject(chunks(g), g.supply_lines.select("doc_id", F.col("src").alias("company")), chunks(g).select("chunk_id", "company")),
    "record_supersedes": lambda g: onboard.record_supersedes(titled(g).select("doc_id", F.lit("10-K").alias("doc_type"), "title"), versions_of(g))[1],
    "record_supersedes_documents": lambda g: onboard.record_supersedes(titled(g).select("doc_id", F.lit("10-K").alias("doc_type"), "title"), versions_of(g))[0],
    "risk_factors_added": lambda g: onboard.risk_factors_added(g.exposed_to, g.covers),
    "section_filter": lambda g: sets.section_filter(g.table("documents"), ITEM).select("doc_id", F.md5("text").alias("text_md5"), F.char_length("text").alias("n_chars")),
    "risk_report": report,
    "report_narrative": lambda g: reports.narrative(report(g)),
    "report_sections": lambda g: reports.report_sections(report(g), g.holds, gap_categories(g)),
    "report_provenance": lambda g: reports.report_provenance(report(g), g.holds.select("fund", "company").join(g.mentions, "company").select("fund", "doc_id"), gap_categories(g)),
    "upsert_registry": lambda g: reports.upsert_registry(registry(g), packs(g), "2024-01-01").select("report_id", "title", "created_at"),
    "write_derived_from": lambda g: reports.write_derived_from(reports_of(g), g.document, chunks(g)),
    "reports_deriving": lambda g: reports.reports_deriving(changes(g).where("name = 'MetricObservation'").select(F.col("subject").alias("item"), F.col("ord").alias("doc_id"), F.concat(text_of("ord"), F.lit("_c1")).alias("chunk_id")), derived(g).unionByName(g.orders.select(F.concat(F.lit("late_"), text_of("fund")).alias("report_id"), F.lit("Chunk").alias("kind"), F.concat(text_of("o_orderkey"), F.lit("_c1")).alias("target")))),
    "risk_collection": lambda g: reports.risk_collection_cells(g.holds, g.exposed_to, g.risk_factor),
    "impact_briefings": briefings,
    "impact_event": event,
    "survive_classification": lambda g: mdm.survive_classification(records(g).where("attribute = 'class'"), "Commercial Office", ["building", "household"], onto.PROPERTY_CLASS),
    "upsert_gold_dim": lambda g: mdm.upsert_gold_dim(gold(g), golden(g).where("n_sources > 1").select("pk", "cluster", "golden", F.lit(2).alias("version")), ["pk"]),
    "publish_golden": lambda g: mdm.publish_golden(gold(g), golden(g), 2).groupBy("version").agg(F.count("*").alias("n"), F.countDistinct("pk").alias("n_pk")),
    "mdm_entities": lambda g: mdm.mdm_entities(records(g), "name", SYSTEM_RANKS),
    "mdm_sources": lambda g: mdm.mdm_sources(records(g)).select("cluster", "record_id", "system", "place", F.md5("said").alias("said_md5")),
    "gold_lookup": lambda g: mdm.gold_lookup(golden(g), mdm.lineage(mdm.survive_trust(records(g)))).select("cluster", "pk", "lineage"),
    "replace_lineage": lambda g: mdm.replace_lineage(mdm.lineage(mdm.survive_most_complete(records(g))), mdm.lineage(mdm.survive_trust(records(g))).where("cluster < 20")),
    "system_order": lambda g: mdm.system_order(records(g).select("system", "trust").distinct()),
    "firm_order": lambda g: onboard.firm_order(g.firm.select("firm", "name", (F.col("firm") == 3).alias("is_demo"), (F.col("firm") % 2 == 0).alias("is_active"))),
    "detect_fund": lambda g: textjobs.detect_fund(g.table("documents").select(F.col("doc_id").alias("question"), "text"), g.table("benchmark").select(F.col("item_id").alias("fund"), F.concat(F.lit("the fund "), F.substr("text", F.lit(1), F.lit(40))).alias("name"))),
    "ground_class": lambda g: entities(g).select("id", onto.ground_class(F.col("label"), F.col("category"), F.col("attributes")).alias("curie")),
    "curie_iri": lambda g: entities(g).select("id", onto.iri_of(F.concat_ws(":", F.element_at(F.array(*map(F.lit, [*PREFIXES, "none"])), (F.col("id") % 5 + 1).cast("int")), text_of("id")), PREFIXES).alias("iri")).select("id", "iri", onto.curie_of(F.col("iri"), PREFIXES).alias("curie")),
    "pairs_to_map": lambda g: g.table("orders").select(F.col("o_orderkey").alias("id"), onto.sorted_text(onto.pairs_to_map(F.array(F.struct(F.lit("a").alias("key"), F.col("o_orderstatus").alias("value")), F.struct(F.when(F.col("o_orderstatus") == "F", "a").otherwise("b").alias("key"), F.col("o_orderpriority").alias("value")), F.struct(F.lit(None).cast("string").alias("key"), F.lit("x").alias("value"))))).alias("said")),
    "canonical_json": lambda g: g.table("nation").select("n_nationkey", F.sha2(onto.sorted_text(F.create_map(F.lit("region"), text_of("n_regionkey"), F.lit("name"), F.col("n_name"), F.lit("none"), F.lit(None).cast("string"))), 256).alias("sha256")),
    "infer_label": lambda g: entities(g).select("id", onto.infer_label(F.col("label"), F.array(F.lit("Fund"), F.lit("Company"))).alias("label")),
    "entity_props": lambda g: entities(g).select("id", onto.sorted_text(onto.entity_props(F.col("attributes"), ["role", "property_type"], F.when(F.col("label") == "Company", F.concat(F.lit("c"), text_of("id"))), onto.ground_class(F.col("label"), F.col("category"), F.col("attributes")))).alias("props")),
    "cite": lambda g: g.document.select("doc_id", onto.cited("sensitivity", "filing_date").alias("said")),
    "text_functions_2": lambda g: g.table("documents").select("doc_id", tf.norm_id(F.col("source")).alias("norm_id"), tf.fund_slug(F.col("source")).alias("fund_slug"), F.md5(tf.bounded_excerpt(F.coalesce("text", F.lit("")), ["the ", "der ", "le "], 200)).alias("excerpt_md5"), F.md5(tf.first_sentence(F.coalesce("text", F.lit("")))).alias("sentence_md5"), onto.clamped(F.col("doc_id") / 500.0 - 0.5).alias("clamped")),
    "iso_z": lambda g: g.table("events").select("event_id", tf.iso_z(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("iso")),
    "cosine": lambda g: pairs_of_vectors(g),
    "spec_integrity": lambda g: spec(g).unionByName(g.spark.createDataFrame([("LEASES_SPACE_AT", ["Company"], ["RealProperty"]), ("SERVICED_BY", ["Loan"], ["Company"])], "rel string, domain array<string>, range array<string>")).select("rel", F.explode(F.array_union("domain", "range")).alias("label")).join(entities(g).select("label").distinct(), "label", "left_anti"),
    "scan_documents": lambda g: scanned(g),
    "grounding_gate": gate,
    "build_triples": lambda g: ingested(g)["claims"],
    "write_mentions": lambda g: ingested(g)["mentions"],
    "write_rejected": rejected,
    "extraction_counts": lambda g: ingestflow.extraction_counts(ingested(g)["counts"]),
    "ingest_documents": lambda g: ingested(g)["decisions"].groupBy("decision", "reason").agg(F.count("*").alias("n")),
    "write_chunks": lambda g: written_chunks(g),
}


def budgeted(g: Graph) -> DataFrame:
    return sets.budgeted(*budget_lists(g), 8)


def versions_of(g: Graph) -> DataFrame:
    """Open orders as new versions of the one before; the first has none that exists."""
    return g.table("orders").where("o_orderstatus = 'O'").select((F.col("o_orderkey") + 1_000_000).alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, "10-Q").alias("doc_type"), F.lit("new").alias("title"), (F.col("o_orderkey") - 1).alias("old_doc_id"))


def gold(g: Graph) -> DataFrame:
    """An older gold table: half of the records as they are, at version 1."""
    return golden(g).where("cluster >= 20").select("pk", "cluster", F.lit("old").alias("golden"), F.lit(1).alias("version"))


def pairs_of_vectors(g: Graph) -> DataFrame:
    """Each vector with the next."""
    e = g.table("embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("v2"), F.col("embedding").alias("e2"))
    return e.join(after, F.col("vec_id") == F.col("v2")).select("vec_id", F.round(tf.cosine(F.col("embedding"), F.col("e2")), 4).alias("score"))


def scanned(g: Graph) -> DataFrame:
    """Pages as source documents."""
    return scan_documents(g.table("pages").select(F.concat(F.lit("page "), text_of("page_id")).alias("name"), F.col("html").alias("text"))).select("doc_id", "doc_type", "sensitivity", "pages", "chars", F.md5("text").alias("text_md5"))


def written_chunks(g: Graph) -> DataFrame:
    docs = g.table("pages").select(F.col("page_id").alias("doc_id"), tf.strip_html(F.col("html")).alias("text"), F.lit("public").alias("sensitivity"))
    return ingestflow.write_chunks(textjobs.chunk_documents(docs, target=100, hard=120), docs).select("chunk_id", "page", "start", F.md5("text").alias("text_md5"))


GOLDEN = f"{RECORDS}, gold AS (SELECT cluster, coalesce(max(value) FILTER (attribute = 'id'), CAST(cluster AS VARCHAR)) AS pk, string_agg(attribute || '=' || value, ';' ORDER BY attribute || '=' || value) golden, count(DISTINCT record_id) n_sources FROM trusted GROUP BY cluster)"
KNOWN = "known AS (SELECT company, CASE WHEN country > 25 THEN 'k' || company END AS ticker FROM company)"
FIRM_EDGES_LIMIT = f"{OWN}, fe AS (SELECT 'MANAGED_BY' AS rel, CAST(fund AS VARCHAR) src, CAST(firm AS VARCHAR) dst FROM managed_by WHERE firm = {FIRM} UNION ALL SELECT 'HOLDS', CAST(fund AS VARCHAR), CAST(company AS VARCHAR) FROM holds WHERE fund IN (FROM own) UNION ALL SELECT 'SUPPLIES_TO', CAST(src AS VARCHAR), CAST(dst AS VARCHAR) FROM supplies_to WHERE src IN (FROM mine) AND dst IN (FROM mine) UNION ALL SELECT 'EXPOSED_TO', CAST(company AS VARCHAR), risk_title FROM exposed_to WHERE company IN (FROM mine) UNION ALL SELECT 'MENTIONS', CAST(doc_id AS VARCHAR), CAST(company AS VARCHAR) FROM mentions WHERE company IN (FROM mine))"
IRI_CASE = "CASE id % 5 " + " ".join(f"WHEN {k} THEN '{b}' || id" for k, b in enumerate(PREFIXES.values())) + " ELSE 'none:' || id END"
PLACE_CASE = "CASE category " + " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(CATEGORIES, 1)) + " END"
BAND = "CASE WHEN severity = '' THEN 0 WHEN " + " OR ".join(f"contains(lower(severity), '{w}')" for w in tf.SEVERE) + " THEN 3 WHEN " + " OR ".join(f"contains(lower(severity), '{w}')" for w in tf.MODERATE) + " THEN 2 ELSE 1 END"

SQL = {
    "firm_scope_chunks": f"WITH {CHUNK}, {OWN} SELECT chunk_id FROM chunk WHERE company IN (FROM mine) OR doc_id IN (FROM stamped)",
    "firm_has_chunks": "SELECT firm, firm IN (SELECT firm FROM managed_by JOIN holds USING (fund) WHERE company IN (SELECT l_partkey FROM lineitem)) AS has_chunks FROM firm",
    "evidence_chunks": f"WITH {EVIDENCE} SELECT * FROM ev",
    "citation_union": f"WITH {EVIDENCE}, {NEAREST} SELECT query, chunk_id, CASE WHEN min(k) = 0 THEN 'evidence' ELSE 'vector' END AS kind FROM (SELECT query, chunk_id, 0 AS k FROM ev WHERE visible UNION ALL SELECT query, chunk_id, 1 FROM nearest) GROUP BY 1, 2",
    "vector_post_filter": f"WITH {CHUNK}, {NEAREST} SELECT query, chunk_id, rank FROM nearest JOIN chunk USING (chunk_id) WHERE coalesce(sensitivity, 'public') = 'public'",
    "entity_union": f"WITH {ASKED} SELECT query, CAST(company AS VARCHAR) AS entity FROM asked UNION SELECT fund, CAST(dst AS VARCHAR) FROM holds JOIN supplies_to ON company = src WHERE criticality = 'critical'",
    "vocab_union": "SELECT alias, arg_max(canonical, (o, k)) AS canonical FROM (SELECT lower(p_name) AS alias, p_name AS canonical, p_partkey AS o, 0 AS k FROM part UNION ALL SELECT 't' || (p_partkey % 70), p_name, p_partkey, 1 FROM part) GROUP BY alias",
    "documents_view": f"WITH {CHUNK} SELECT d.doc_id, 'Order ' || d.doc_id AS title, CAST(count(text) AS INT) AS n_spans, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page, chunk_id), '')) AS text_md5 FROM document d LEFT JOIN chunk c USING (doc_id) WHERE d.sensitivity IS NULL OR d.sensitivity = 'public' GROUP BY d.doc_id",
    "node_label_coalesce": "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'n' || o_orderkey WHEN 'P' THEN o_orderpriority ELSE 'Document' END AS label FROM orders",
    "strip_embedding": "SELECT vec_id, 'label=' || label AS props FROM embeddings",
    "edge_limit": f"WITH {FIRM_EDGES_LIMIT} SELECT * FROM fe ORDER BY rel, src, dst LIMIT 300",
    "analytics_in_firm": f"WITH {OWN} SELECT dst AS result FROM supplies_to GROUP BY dst HAVING bool_or(criticality <> 'rumoured' AND src IN (FROM mine)) OR NOT bool_or(criticality <> 'rumoured')",
    "ui_paths": "WITH e AS (SELECT DISTINCT fund, company, dst AS supplier FROM holds JOIN supplies_to ON company = src WHERE criticality = 'critical'), n AS (SELECT fund, supplier, count(*) AS n FROM e GROUP BY fund, supplier), t AS (SELECT fund, arg_min(supplier, (-n, supplier)) AS supplier FROM n GROUP BY fund) SELECT fund, fund || ' → ' || company || ' → ' || supplier AS label, fund || '-HOLDS-' || company || '|' || company || '-SUPPLIES_TO-' || supplier AS steps FROM e JOIN t USING (fund, supplier)",
    "top_holdings_filter": "SELECT p_partkey, p_name AS name FROM part WHERE p_size > 3",
    "fund_universe": f"SELECT fund, name FROM fund JOIN managed_by USING (fund) WHERE firm = {FIRM}",
    "entitlement_scope": "SELECT conv_id, turn, array_to_string(list_sort(list_distinct([lower(trim(role)), 'internal', 'public'])), ',') AS scope FROM conversations",
    "queue_apply": f"WITH {APPLIED} SELECT * FROM applied",
    "queue_by_status": f"WITH {APPLIED} SELECT id, cik FROM applied WHERE status = 'merged'",
    "queue_projection": f"WITH {APPLIED} SELECT id, CASE status WHEN 'provisional' THEN 'pending' WHEN 'promoted' THEN 'kept_new' ELSE status END AS status, cik, round(confidence, 2) AS confidence FROM applied",
    "enqueue_provisional": f"WITH {RESOLVED}, {QUEUE}, new AS (SELECT DISTINCT mention, ticker FROM resolved WHERE method = 'provisional') SELECT id, mention, status FROM queue UNION ALL SELECT (SELECT max(id) FROM queue) + row_number() OVER (ORDER BY substr(md5(mention), 1, 2), mention, ticker NULLS FIRST), mention, 'provisional' FROM new",
    "item_triple_projection": f"WITH {CHANGES} SELECT subject, name AS predicate, coalesce(object, '') AS object, change, CASE WHEN change = 'changed' THEN 'changed: ' || coalesce(new_value, '') ELSE coalesce(new_value, '') END AS detail FROM changes",
    "upsert_holds": "SELECT fund, company, round(weight_pct * 2, 6) AS weight_pct FROM holds",
    "upsert_holds_funds": "SELECT fund, CAST(fund AS VARCHAR) AS series_id, 'c' || fund AS cik, CASE WHEN fund % 2 = 0 THEN 'F' || fund ELSE 'old' END AS lei FROM fund WHERE fund IN (SELECT fund FROM holds) UNION ALL SELECT fund, 'old', NULL, 'old' FROM fund WHERE fund NOT IN (SELECT fund FROM holds)",
    "upsert_holds_companies": f"WITH {KNOWN}, h AS (SELECT DISTINCT company FROM holds) SELECT k.company, coalesce(ticker, CASE WHEN h.company IS NOT NULL THEN 't' || (k.company % 90) END) AS ticker, CASE WHEN h.company % 3 = 0 THEN 'L' || k.company END AS lei FROM known k LEFT JOIN h USING (company)",
    "upsert_firm_and_managed_by": "WITH n AS (SELECT firm + 3 AS firm, max(CASE WHEN fund % 2 = 0 THEN CAST(fund AS VARCHAR) END) AS c2 FROM managed_by GROUP BY 1) SELECT coalesce(f.firm, n.firm) AS firm, coalesce(c2, CASE WHEN f.firm IS NOT NULL THEN 'old' END) AS cik, CASE WHEN n.firm IS NOT NULL THEN 'L' END AS lei FROM firm f FULL JOIN n ON f.firm = n.firm",
    "latest_filing": f"WITH {FILINGS} SELECT series_id, max(filing_date) AS filing_date, arg_max(accession, (filing_date, accession)) AS accession FROM filings GROUP BY series_id",
    "series_guard": f"WITH {FILINGS} SELECT series_id, accession FROM filings WHERE p NOT LIKE '3%' OR series_id = 'S999'",
    "spine_lookup_fund": "WITH q AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 40 AS VARCHAR) END AS series_id, CASE WHEN c_custkey % 2 = 0 THEN ' F-' || (c_custkey % 50) ELSE 'g' || (c_custkey % 20) END AS ticker FROM customer), t AS (SELECT t, arg_min('00' || fund, fund) AS cik FROM (SELECT fund, unnest(['F-' || fund, 'G' || (fund % 10)]) AS t FROM fund) GROUP BY t), x AS (SELECT q.*, s.cik AS a, t.cik AS b FROM q LEFT JOIN (SELECT series_id AS s, '00' || fund AS cik FROM fund) s ON q.series_id = s.s LEFT JOIN t ON upper(trim(ticker)) = t.t) SELECT series_id, ticker, coalesce(a, b) AS cik, CASE WHEN a IS NOT NULL THEN 'series' WHEN b IS NOT NULL THEN 'fund_ticker' ELSE 'provisional' END AS method FROM x",
    "canonical_existing_lookup": f"WITH {RESOLVED}, r AS (SELECT *, coalesce(cik, 'norm:' || {NORM.format('mention')}) AS key, {NORM.format('mention')} AS norm FROM resolved), gr AS (SELECT key, max(cik) AS cik, min(norm) AS norm, arg_min(mention, (length(mention), mention)) AS canonical FROM r GROUP BY key), ex AS (SELECT name, CASE WHEN country > 35 THEN lpad(ltrim(CAST(company * 37 AS VARCHAR), '0'), 10, '0') END AS cik, {NORM.format('name')} AS norm FROM company WHERE country > 25) SELECT key, coalesce((SELECT min(name) FROM ex WHERE ex.cik = gr.cik), (SELECT min(name) FROM ex WHERE ex.norm = gr.norm), canonical) AS canonical FROM gr",
    "enrich_lei": "SELECT company, CASE WHEN country > 10 THEN 'L' || company END AS lei FROM company",
    "existing_edges": f"WITH {CHANGES} SELECT CAST(src AS VARCHAR) AS subject, 'SUPPLIES_TO' AS rel, CAST(dst AS VARCHAR) AS object FROM supplies_to WHERE CAST(src AS VARCHAR) IN (SELECT subject FROM changes WHERE name = 'SUPPLIES_TO' AND change = 'added')",
    "onboard_holdings": f"WITH {RESOLVED}, one AS (SELECT DISTINCT mention FROM m), known_ AS (SELECT o.mention, n.cik FROM one o LEFT JOIN (SELECT {NORM.format('title')} n, arg_min(cik, ord) cik FROM spine GROUP BY 1) n ON n.n = {NORM.format('mention')}), h AS (SELECT firm, fund, 'The PART#' || lpad(CAST(company % 300 AS VARCHAR), 9, '0') || ', Corp' AS c FROM holds JOIN managed_by USING (fund)) SELECT firm, count(DISTINCT fund) n_funds, count(*) n_positions, count(DISTINCT c) FILTER (cik IS NOT NULL) n_resolved, count(DISTINCT c) FILTER (cik IS NULL) n_provisional FROM h LEFT JOIN known_ ON c = mention GROUP BY firm",
    "enrich_firms": f"WITH w AS (SELECT firm, company, round(CAST(sum(CAST(weight_pct AS DECIMAL(28,6))) AS DOUBLE), 6) AS w FROM holds JOIN managed_by USING (fund) GROUP BY ALL), t AS (SELECT firm, company FROM w QUALIFY row_number() OVER (PARTITION BY firm ORDER BY w DESC, company) <= 5) SELECT firm, 'holding' AS kind, 'c' || doc_id AS key, doc_id, md5(substr(text, CASE WHEN contains(lower(text), 'item 1a') THEN strpos(lower(text), 'item 1a') WHEN contains(lower(text), 'risk factors') THEN strpos(lower(text), 'risk factors') ELSE 1 END, 24000)) AS text_md5 FROM t JOIN documents ON company = doc_id",
    "link_subject": f"WITH {CHUNK} SELECT chunk_id, company FROM chunk UNION SELECT chunk_id, src FROM chunk JOIN supply_lines USING (doc_id)",
    "record_supersedes": "SELECT o_orderkey + 1000000 AS doc_id, o_orderkey - 1 AS old_doc_id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey - 1 IN (SELECT o_orderkey FROM orders)",
    "record_supersedes_documents": "WITH n AS (SELECT o_orderkey + 1000000 AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN '10-Q' END AS t FROM orders WHERE o_orderstatus = 'O') SELECT coalesce(n.doc_id, o_orderkey) AS doc_id, coalesce(t, CASE WHEN o_orderkey IS NOT NULL THEN '10-K' END) AS doc_type, CASE WHEN n.doc_id IS NOT NULL THEN 'new' ELSE 'Order ' || o_orderkey END AS title FROM orders FULL JOIN n ON o_orderkey = n.doc_id",
    "risk_factors_added": "SELECT DISTINCT risk_title FROM covers WHERE risk_title NOT IN (SELECT risk_title FROM exposed_to)",
    "section_filter": rf"WITH l AS (SELECT doc_id, unnest(s) AS said, generate_subscripts(s, 1) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)), n AS (SELECT *, sum(CAST(regexp_matches(said, '{ITEM}') AS INT)) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM l) SELECT doc_id, md5(string_agg(said, chr(10) ORDER BY line)) AS text_md5, length(string_agg(said, chr(10) ORDER BY line)) AS n_chars FROM n WHERE section > 0 GROUP BY doc_id",
    "risk_report": f"WITH {REPORT} SELECT * FROM report",
    "report_narrative": f"WITH {REPORT} SELECT fund, printf('%d: portfolio HHI %.1f across %d holdings.', fund, hhi, n_holdings) || coalesce(printf(' Top supplier dependency is %d (weighted score %.1f, shared by %d holdings).', top_supplier, top_score, top_n), '') || coalesce(printf(' The dominant risk-factor category by weight is %s (%.1f%% of fund weight).', top_category, top_mass), '') || printf(' Only %.1f%% of fund weight is backed by an ingested source; %.1f%% remains uncovered.', covered_pct, 100 - covered_pct) AS narrative FROM report",
    "report_sections": f"""WITH {REPORT}, big AS (SELECT fund, string_agg(company || ' ' || printf('%.2f', weight_pct) || '%', ', ' ORDER BY weight_pct DESC, company) AS l FROM (SELECT * FROM holds QUALIFY row_number() OVER (PARTITION BY fund ORDER BY weight_pct DESC, company) <= 4) GROUP BY fund), x AS (SELECT r.*, l, coalesce(m, 'none') AS m, m IS NOT NULL AS gap FROM report r JOIN big USING (fund) LEFT JOIN miss USING (fund))
        SELECT fund, 0 AS ord, 'Executive summary' AS heading, printf('%d holds %d positions (%.2f%% of assets) with a portfolio HHI of %.2f. Uncovered principal-risk categories: %s.', fund, n_holdings, total_weight, hhi, m) AS body, false AS stale FROM x
        UNION ALL SELECT fund, 1, 'Portfolio concentration', printf('HHI %.2f over %d holdings. Largest positions: %s.', hhi, n_holdings, l), false FROM x
        UNION ALL SELECT fund, 2, 'Supplier dependency', 'Top weighted supplier dependency: ' || coalesce(CAST(top_supplier AS VARCHAR), 'none') || '.', false FROM x
        UNION ALL SELECT fund, 3, 'Risk-factor heatmap', 'Largest holding-weight mass: ' || coalesce(top_category, 'none') || '.', false FROM x
        UNION ALL SELECT fund, 4, 'Disclosure coverage', CASE WHEN gap THEN 'Uncovered principal-risk categories: ' || m || '.' ELSE 'All exposed principal risks are covered by a prospectus section.' END, gap FROM x
        UNION ALL SELECT fund, 5, 'Source coverage', printf('%.2f%% of fund weight is backed by an ingested source; %.2f%% is uncovered.', covered_pct, 100 - covered_pct), false FROM x
        UNION ALL SELECT fund, 6, 'Single-source supplier flags', CAST(n_flags AS VARCHAR), false FROM x""",
    "report_provenance": f"WITH {REPORT} SELECT fund, printf('Portfolio HHI = %.2f', hhi) AS claim, CAST(NULL AS BIGINT) AS doc_id FROM report UNION ALL SELECT DISTINCT fund, 'Supports supplier-dependency / exposure figures', doc_id FROM holds JOIN mentions USING (company) UNION ALL SELECT fund, 'Disclosure coverage gap: ' || coalesce(m, 'none'), NULL FROM report LEFT JOIN miss USING (fund)",
    "upsert_registry": f"WITH d AS (SELECT fund, max(as_of) d FROM holds GROUP BY fund) SELECT 'pack_' || fund || '_' || year(d) || '-Q' || quarter(d) AS report_id, 'Exposure ' || fund AS title, CASE WHEN fund < 13 THEN '2020-01-01' ELSE '2024-01-01' END AS created_at FROM d",
    "write_derived_from": f"WITH {CHUNK}, r AS (SELECT DISTINCT 'pack_' || c_nationkey AS report_id, o_orderkey AS doc_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' OR o_orderkey = 0) SELECT report_id, 'Document' AS kind, CAST(doc_id AS VARCHAR) AS target FROM r UNION ALL SELECT report_id, 'Chunk', doc_id || '_c3' FROM r WHERE doc_id || '_c3' IN (SELECT chunk_id FROM chunk)",
    "reports_deriving": f"WITH {CHANGES}, {DERIVED}, m AS (SELECT subject AS item, ord FROM changes WHERE name = 'MetricObservation') SELECT DISTINCT item, report_id FROM m JOIN derived ON CAST(ord AS VARCHAR) = target UNION SELECT item, 'late_' || c_nationkey FROM m JOIN orders ON ord = o_orderkey JOIN customer ON o_custkey = c_custkey",
    "risk_collection": f"SELECT company, category, {PLACE_CASE} AS place, max({BAND}) AS severity FROM exposed_to JOIN risk_factor ON risk_title = title WHERE company IN (SELECT company FROM holds) GROUP BY company, category",
    "impact_briefings": f"WITH {REACHED}, f AS (SELECT CAST(target AS BIGINT) AS fund, via, held FROM reached WHERE target_kind = 'fund'), a AS (SELECT fund, min(via) AS anchor FROM f WHERE via = CAST(held AS VARCHAR) GROUP BY fund), e AS (SELECT fund, min(held) AS first_held, count(DISTINCT held) AS n FROM f GROUP BY fund) SELECT e.fund, CASE WHEN anchor IS NOT NULL THEN 1 ELSE 2 END AS hops, CASE WHEN anchor IS NOT NULL THEN printf('holds %s at %.6f%% (inbound HOLDS, 1 hop)', anchor, weight_pct) ELSE printf('holds %d and %d more in the affected supply chain (2 hops)', first_held, n - 1) END AS reason FROM e LEFT JOIN a USING (fund) LEFT JOIN holds h ON h.fund = e.fund AND CAST(h.company AS VARCHAR) = anchor",
    "impact_event": f"WITH {REACHED}, t AS (SELECT DISTINCT target_kind, target FROM reached) SELECT (SELECT count(*) FROM changes WHERE change = 'added') AS added, (SELECT count(*) FROM changes WHERE change = 'removed') AS removed, (SELECT count(*) FROM changes WHERE change = 'changed') AS changed, (SELECT count(*) FROM t WHERE target_kind = 'fund') AS affected_funds, (SELECT count(*) FROM t WHERE target_kind = 'section') AS stale_sections, (SELECT count(*) FROM t WHERE target_kind = 'report') AS out_of_date_reports",
    "survive_classification": f"WITH {RECORDS} SELECT cluster, attribute, 'Commercial Office' AS value, 'ontology rule engine' AS system, string_agg(DISTINCT value, ', ' ORDER BY value) AS variants, CASE WHEN bool_or(lower(trim(value)) IN ('building', 'household')) THEN '{onto.PROPERTY_CLASS}' END AS curie FROM full_ WHERE attribute = 'class' GROUP BY ALL",
    "upsert_gold_dim": f"WITH {GOLDEN}, n AS (SELECT pk, max(cluster) AS cluster, arg_max(golden, cluster) AS golden FROM gold WHERE n_sources > 1 GROUP BY pk) SELECT pk, cluster, golden, 2 AS version FROM n UNION ALL SELECT pk, cluster, 'old', 1 FROM gold WHERE cluster >= 20 AND pk NOT IN (SELECT pk FROM n)",
    "publish_golden": f"WITH {GOLDEN} SELECT 2 AS version, count(DISTINCT pk) AS n, count(DISTINCT pk) AS n_pk FROM gold",
    "mdm_entities": f"WITH {RECORDS} SELECT cluster, coalesce(arg_min(value, (-CASE system WHEN 'curated' THEN 3 WHEN 'pms' THEN 2 ELSE 1 END, record_id)) FILTER (attribute = 'name'), CAST(cluster AS VARCHAR)) AS display_name, count(DISTINCT record_id) n_sources, count(DISTINCT attribute) n_attributes FROM records GROUP BY cluster",
    "mdm_sources": f"WITH {RECORDS}, x AS (SELECT cluster, record_id, system, trust, string_agg(attribute || coalesce('=' || value, ''), ';' ORDER BY attribute || coalesce('=' || value, '')) AS said FROM records GROUP BY ALL) SELECT cluster, record_id, system, row_number() OVER (PARTITION BY cluster ORDER BY trust DESC, record_id) AS place, md5(said) AS said_md5 FROM x",
    "gold_lookup": f"WITH {GOLDEN} SELECT gold.cluster, max(pk) AS pk, string_agg(attribute || ':' || record_id, ';' ORDER BY attribute || ':' || record_id) AS lineage FROM gold JOIN trusted USING (cluster) GROUP BY gold.cluster",
    "replace_lineage": rf"WITH {RECORDS}, old AS (SELECT cluster, attribute, record_id, system FROM full_ QUALIFY row_number() OVER (PARTITION BY cluster, attribute ORDER BY length(value) + CASE WHEN attribute = 'address' AND regexp_matches(value, '[A-Z]{{1,2}}\d[A-Z\d]?\s*\d[A-Z]{{2}}') THEN 100 ELSE 0 END DESC, trust DESC, record_id) = 1) SELECT * FROM old WHERE cluster >= 20 UNION ALL SELECT cluster, attribute, record_id, system FROM trusted WHERE cluster < 20",
    "system_order": f"WITH {RECORDS} SELECT DISTINCT system, trust FROM records",
    "firm_order": "SELECT firm, name, firm = 3 AS is_demo, firm % 2 = 0 AS is_active FROM firm",
    "detect_fund": r"""WITH tok AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\W+'), lambda x: length(x) > 2))) AS q FROM documents), named AS (SELECT item_id AS fund, unnest(list_distinct(list_filter(regexp_split_to_array(lower('the fund ' || substr(text, 1, 40)), '\W+'), lambda x: length(x) > 2))) AS t FROM benchmark),
        spread AS (SELECT t, count(*) = (SELECT count(*) FROM benchmark) AS common FROM named GROUP BY t), size AS (SELECT fund, count(*) AS s FROM named GROUP BY fund), met AS (SELECT doc_id AS question, fund, count(*) FILTER (NOT common) AS own, count(*) FILTER (common) AS shared FROM tok JOIN named ON q = t JOIN spread USING (t) GROUP BY ALL) SELECT question, arg_max(fund, (own, shared, -s, -fund)) AS fund FROM met JOIN size USING (fund) GROUP BY question""",
    "ground_class": f"WITH {ENTITY} SELECT id, {CLASS_CASE} AS curie FROM entity",
    "curie_iri": f"WITH {ENTITY} SELECT id, {IRI_CASE} AS iri, CASE id % 5 " + " ".join(f"WHEN {k} THEN '{p}:' || id" for k, p in enumerate(PREFIXES)) + " ELSE 'none:' || id END AS curie FROM entity",
    "pairs_to_map": "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'a=' || o_orderpriority ELSE 'a=' || o_orderstatus || ';b=' || o_orderpriority END AS said FROM orders",
    "canonical_json": "SELECT n_nationkey, sha256('name=' || n_name || ';none=null;region=' || n_regionkey) AS sha256 FROM nation",
    "infer_label": f"WITH {ENTITY} SELECT id, CASE WHEN label IN ('Fund', 'Company') THEN label ELSE 'Fund' END AS label FROM entity",
    "entity_props": f"WITH {ENTITY}, x AS (SELECT *, {CLASS_CASE} AS curie FROM entity) SELECT id, concat_ws(';', CASE WHEN label = 'Company' THEN 'cik=c' || id END, 'fibo_class=' || curie, 'fibo_grounded=' || CASE WHEN curie IS NOT NULL THEN 'true' END, 'property_type=' || CASE WHEN office THEN ' Office ' ELSE 'barn' END, 'reasoning_valid=' || CASE WHEN curie IS NOT NULL THEN 'true' END, CASE WHEN issuer THEN 'role=Bond issuer' END) AS props FROM x",
    "cite": "SELECT doc_id, concat_ws(';', 'sensitivity=' || sensitivity, 'filing_date=' || filing_date) AS said FROM document",
    "text_functions_2": r"""SELECT doc_id, CASE WHEN regexp_replace(lower(coalesce(source, '')), '[^a-z0-9]+', '', 'g') IN ('notstated', 'na', 'none') THEN '' ELSE regexp_replace(lower(coalesce(source, '')), '[^a-z0-9]+', '', 'g') END AS norm_id, regexp_replace(regexp_replace(lower(source), '[^\pL\pN]', '_', 'g'), '^_+|_+$', '', 'g') AS fund_slug,
        md5(substr(t, CASE WHEN contains(lower(t), 'the ') THEN strpos(lower(t), 'the ') WHEN contains(lower(t), 'der ') THEN strpos(lower(t), 'der ') WHEN contains(lower(t), 'le ') THEN strpos(lower(t), 'le ') ELSE 1 END, 200)) AS excerpt_md5, md5(CASE WHEN s <> '' AND NOT ends_with(s, '.') THEN s || '.' ELSE s END) AS sentence_md5, greatest(0.0, least(1.0, CAST(doc_id / 500.0 - 0.5 AS DOUBLE))) AS clamped
        FROM (SELECT *, coalesce(text, '') AS t, trim(split_part(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '. ', 1)) AS s FROM documents)""",
    "iso_z": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events",
    "cosine": "SELECT a.vec_id, round(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 4) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "spec_integrity": f"WITH {ENTITY} SELECT label, rel FROM (VALUES ('Company', 'SUPPLIES_TO'), ('Company', 'LEASES_SPACE_AT'), ('RealProperty', 'LEASES_SPACE_AT'), ('Loan', 'SERVICED_BY'), ('Company', 'SERVICED_BY')) v(label, rel) WHERE label NOT IN (SELECT label FROM entity)",
}

#: A text without a form's label may have it in its name.
NAME_CASE = " ".join(f"WHEN contains(upper(name), '{f}') THEN '{f}'" for f in tf.FORMS) + " ELSE 'text' END"
#: The same flow for DuckDB. Which spans stand in their chunks is known from how they were made: those of every eleventh part don't.
FLOW = f"""{CHUNK}, base AS (SELECT doc_id, chunk_id, doc_id * 100 + CAST(page AS BIGINT) AS ord, 'Part#' || lpad(CAST(company AS VARCHAR), 9, '0') || CASE WHEN company % 2 = 0 THEN ', Inc.' ELSE '' END AS name, company, company % 11 <> 0 AS grounded,
    CASE WHEN company % 17 = 0 THEN 'Fund' ELSE 'Company' END AS label, CASE WHEN company % 3 = 0 THEN 'SUBSIDIARY_OF' ELSE 'SUPPLIES_TO' END AS rel, (company % 10) / 10.0 + 0.05 AS confidence FROM chunk WHERE text IS NOT NULL),
rels AS (SELECT *, lead(name) OVER (PARTITION BY doc_id ORDER BY ord) AS object FROM base), tri AS (SELECT ord, doc_id, chunk_id, rel, name AS subject, object, confidence FROM rels WHERE object IS NOT NULL AND grounded),
good AS (SELECT *, row_number() OVER (PARTITION BY subject, rel, object ORDER BY ord) AS nth, min(ord) OVER (PARTITION BY subject, rel) AS first_ord FROM tri WHERE confidence >= 0.6),
decided AS (SELECT ord, doc_id, CASE WHEN rel = 'SUBSIDIARY_OF' AND nth = 1 AND first_ord < ord THEN 'conflict' WHEN nth > 1 THEN 'corroborate' ELSE 'insert' END AS decision, CAST(NULL AS VARCHAR) AS reason FROM good UNION ALL SELECT ord, doc_id, 'reject', 'low confidence' FROM tri WHERE confidence < 0.6)"""
SQL |= {
    "chokepoint_paths": f"WITH {REACH}, v AS (SELECT DISTINCT h.fund, h.company, node FROM holds h JOIN reach ON h.company = seed WHERE NOT EXISTS (SELECT 1 FROM holds o WHERE o.fund = h.fund AND o.company = node)), n AS (SELECT fund, node, count(*) AS n FROM v GROUP BY ALL), t AS (SELECT fund, arg_min(node, (-n, node)) AS node FROM n GROUP BY fund) SELECT fund, company || ' → … → ' || node AS label, company || '-SUPPLIES_TO*1..2-' || node AS steps FROM v JOIN t USING (fund, node)",
    "coverage_gap_paths": "WITH s AS (SELECT DISTINCT fund, risk_title, company || '-EXPOSED_TO-' || risk_title || '[' || coalesce(category, '') || ']' AS step FROM holds JOIN exposed_to USING (company) JOIN risk_factor ON title = risk_title WHERE risk_title NOT IN (SELECT risk_title FROM covers)) SELECT fund, 'Uncovered: ' || risk_title AS label, string_agg(step, '|' ORDER BY step) || '|prospectus (485BPOS)-COVERS?-' || risk_title || '[MISSING]' AS steps FROM s GROUP BY fund, risk_title",
    "board_paths": f"WITH {ROLES}, l AS (SELECT DISTINCT r.company, r.person, r.role, o.person || '-' || o.role || '-' || o.company AS step FROM roles r LEFT JOIN roles o ON o.person = r.person AND o.company <> r.company WHERE r.role <> 'FORMERLY_AT') SELECT company, person || ' interlocks/alumni' AS label, person || '-' || role || '-' || company || coalesce('|' || string_agg(step, '|' ORDER BY step), '') AS steps FROM l GROUP BY company, person, role",
    "item_sections": r"""WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
        m AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN '1a' WHEN i % 5 = 0 THEN '7' WHEN i % 7 = 0 THEN '1' END AS k, CASE WHEN i % 3 = 0 THEN '  Item 1A. ' WHEN i % 5 = 0 THEN 'ITEM 7: ' WHEN i % 7 = 0 THEN 'item 1 ' ELSE '' END || line AS line FROM l),
        n AS (SELECT *, count(k) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM m),
        b AS (SELECT doc_id, part, max(k) AS k, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS body FROM n WHERE part > 0 GROUP BY doc_id, part),
        t AS (SELECT doc_id, string_agg(body, chr(10) || chr(10) ORDER BY part) AS text FROM b WHERE k IN ('1a', '7') AND body <> '' GROUP BY doc_id)
        SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS INT) AS n_chars FROM t""",
    "name_containment": r"""WITH n AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n]+') AS w FROM documents), a AS (SELECT DISTINCT lower(array_to_string(w[1:3], ' ')) AS a FROM n WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT lower(array_to_string(w[1:2], ' ')) AS b FROM n WHERE doc_id % 2 = 1)
        SELECT a, b FROM a JOIN b ON b <> '' AND contains(a, b)""",
    "grounding_gate": f"WITH {FLOW} SELECT chunk_id, name, grounded FROM base",
    "build_triples": f"WITH {FLOW} SELECT ord, doc_id, chunk_id, rel, subject, 'Company' AS subject_label, object, 'Company' AS object_label, CAST(confidence AS DOUBLE) AS confidence FROM tri",
    "write_mentions": f"WITH {FLOW} SELECT DISTINCT chunk_id, label, name AS entity FROM base WHERE grounded",
    "write_rejected": f"WITH {FLOW} SELECT substr(sha256('Company|' || subject || '|' || rel || '|Company|' || object), 1, 16) AS fact_id, 'low confidence' AS reason, arg_min(doc_id, ord) AS doc_id, round(CAST(arg_min(confidence, ord) AS DOUBLE), 4) AS confidence FROM tri WHERE confidence < 0.6 GROUP BY 1",
    "extraction_counts": f"WITH {FLOW} SELECT doc_id, count(*) AS chunks, count(*) FILTER (grounded) AS entities, count(*) FILTER (grounded AND object IS NOT NULL) AS relations, count(*) FILTER (NOT grounded) + count(*) FILTER (NOT grounded AND object IS NOT NULL) AS dropped, CAST(coalesce(max(a), 0) AS BIGINT) AS accepted, CAST(coalesce(max(j), 0) AS BIGINT) AS rejected FROM rels LEFT JOIN (SELECT doc_id, count(*) FILTER (decision <> 'reject') AS a, count(*) FILTER (decision = 'reject') AS j FROM decided GROUP BY doc_id) USING (doc_id) GROUP BY doc_id",
    "ingest_documents": f"WITH {FLOW} SELECT decision, reason, count(*) AS n FROM decided GROUP BY ALL",
    "scan_documents": rf"""WITH s AS (SELECT 'page ' || page_id AS name, CASE WHEN regexp_matches(lower(substr(html, 1, 2048)), '<html|<!doctype html|<body|<div') THEN {STRIPPED} ELSE html END AS t FROM pages), c AS (SELECT name, array_to_string(list_filter(list_transform(regexp_split_to_array(replace(regexp_replace(t, '\r\n?', chr(10), 'g'), chr(160), ' '), '\n[ \t]*\n'), lambda p: {WS}), lambda p: p <> ''), chr(10) || chr(10)) AS text FROM s)
        SELECT 'doc_' || substr(sha256(text), 1, 10) AS doc_id, {FORM_CASE.replace("ELSE 'text' END", NAME_CASE)} AS doc_type, CASE WHEN {INTERNAL_CASE} THEN 'internal' ELSE 'public' END AS sensitivity, CAST(greatest(1, round_even(length(text) / 3000, 0)) AS BIGINT) AS pages, length(text) AS chars, md5(text) AS text_md5 FROM c WHERE text <> ''""",
}

QUERIES = {name: (lambda spark, sf_dir, build=build: build(Graph(spark, sf_dir))) for name, build in BUILD.items()}
ORACLE_SQL = {name: sql(body) for name, body in SQL.items()}
