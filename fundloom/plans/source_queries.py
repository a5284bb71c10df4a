"""Readers and streaming jobs over files that are derived from the test tables, with their SQL: what goes out comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundloom.functions.ontology import sorted_text
from fundloom.graphmodel import Graph, sql
from fundloom.operators.disclosure import xml_escape
from fundloom.plans.graph_queries import CHANGES, TRIPLES, reviewed, triples, versions
from fundloom.sources import filings
from fundloom.sources.tables import new_path, written
from fundloom.streaming import ingest


def text_of(c: str) -> Column:
    return F.col(c).cast("string")


def new_folder(g: Graph, name: str) -> str:
    return new_path(g.spark, name)


def tag(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


#: Positions of one filing, about: a fund of more files several.
FILED = 10_000


def nport(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Each fund's holdings as filings in XML of some ``FILED`` positions, read again; every fifth position lacks a weight."""
    h = g.holds.join(g.company.select("company", "name"), "company")
    weight = F.when(F.col("company") % 5 != 0, tag("pctVal", F.format_string("%.6f", "weight_pct"))).otherwise("")
    position = tag("invstOrSec", F.concat(tag("name", xml_escape(F.col("name"))), tag("balance", F.format_string("%,.2f", "shares")), tag("valUSD", F.format_string("%,.2f", "value_usd")), weight))
    each = h.groupBy("fund").agg(F.max("as_of").alias("as_of"), F.ceil(F.count("*") / FILED).cast("int").alias("parts"))
    dealt = h.drop("as_of").join(each, "fund").withColumn("part", F.pmod(F.xxhash64("company"), F.col("parts")))
    body = dealt.groupBy("fund", "part").agg(F.array_join(F.array_sort(F.collect_list(position)), "").alias("positions"), F.max("as_of").alias("as_of"))
    filed = body.join(g.fund, "fund").select("fund", "part", tag("edgarSubmission", F.concat(tag("headerData", tag("filerInfo", tag("seriesClassInfo", tag("seriesId", F.lit("S0"))))), tag("formData", F.concat(tag("genInfo", F.concat(tag("regCik", text_of("fund")), tag("seriesName", xml_escape(F.col("name"))), tag("seriesId", F.concat(F.lit("S"), "series_id")), tag("repPdEnd", text_of("as_of")))), tag("invstOrSecs", F.col("positions")))))).alias("value"))
    folder = new_folder(g, "nport")
    filed.write.partitionBy("fund", "part").text(folder)  # a file each, as filings come
    return filings.scan_nport(g.spark, folder)


def issuer_spine(g: Graph) -> DataFrame:
    """Issuers as ticker files, one for each size."""
    entry = F.struct(text_of("p_partkey").alias("cik_str"), F.concat(F.lit(" t."), text_of("p_size")).alias("ticker"), F.concat("p_name", F.lit(" Inc.")).alias("title"))
    files = g.table("part").groupBy("p_size").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(text_of("p_partkey"), entry)))).alias("value")).select("value")
    folder = new_folder(g, "issuers")
    files.repartition(4).write.text(folder)
    return g.spark.read.text(folder).transform(lambda lines: filings.issuer_entries(lines))


def fund_spine(g: Graph) -> DataFrame:
    """Funds as a column-positional file: two share classes each."""
    rows = g.fund.select(F.explode(F.array(*[F.array(F.concat(F.lit("00"), text_of("fund")), F.concat(F.lit("S"), "series_id"), F.concat(F.lit(f"C{k}-"), "series_id"), F.concat(F.lit(f"f{k}"), text_of("fund"))) for k in (1, 2)])).alias("row"))
    file = rows.agg(F.to_json(F.struct(F.array(*map(F.lit, ["cik", "seriesId", "classId", "symbol"])).alias("fields"), F.array_sort(F.collect_list("row")).alias("data"))).alias("value"))
    folder = new_folder(g, "funds")
    file.write.text(folder)
    return filings.scan_fund_spine(g.spark, folder)


def crosswalk_file(g: Graph) -> DataFrame:
    """Suppliers as a crosswalk in which tickers repeat: the last row of each counts."""
    k = F.col("s_suppkey")
    rows = g.table("supplier").select(k.alias("k"), F.concat(F.lit("t."), (k % 40).cast("string")).alias("ticker"), F.lpad(k.cast("string"), 9, "0").alias("cusip"), F.col("s_name").alias("issuer_name"), F.lit("COM").alias("title_of_class"))
    folder = new_folder(g, "crosswalk")
    rows.orderBy("k").drop("k").write.option("header", True).csv(folder)
    return filings.scan_crosswalk(g.spark, folder)


def extractions(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Orders as model output in JSON: an entity with attributes (one key twice), and a relation; some of unknown kinds."""
    label = F.when(F.col("o_orderstatus") == "P", "Spaceship").otherwise("Company")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    entity = F.struct(label.alias("label"), F.concat(F.lit("c"), text_of("o_custkey")).alias("name"), F.lit("said").alias("span"), (F.col("o_totalprice") / 100000).alias("confidence"), F.array(pair("a", F.col("o_orderstatus")), pair("a", F.col("o_orderpriority")), pair("b", F.lit("x"))).alias("attributes"))
    relation = F.struct(F.when(F.col("o_orderkey") % 3 == 0, "KNOWS").otherwise("SUPPLIES_TO").alias("type"), text_of("o_custkey").alias("subject"), text_of("o_orderkey").alias("object"), F.lit("said").alias("span"), F.lit(None).cast("double").alias("confidence"))
    raw = g.table("orders").select(text_of("o_orderkey").alias("chunk_id"), F.to_json(F.struct(F.array(entity).alias("entities"), F.array(relation).alias("relations"))).alias("payload"))
    return filings.scan_extractions(raw, ["Company", "Fund"], ["SUPPLIES_TO"])


def seeds(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Suppliers as bronze records, a seed file for each nation, read again."""
    record = F.struct(F.concat(F.lit("r"), text_of("s_suppkey")).alias("record_id"), F.lit("pms").alias("system_id"), F.lit("Supplier").alias("entity_type"), text_of("s_nationkey").alias("master_key"), F.create_map(F.lit("name"), F.col("s_name"), F.lit("balance"), text_of("s_acctbal")).alias("attributes"))
    system = F.array(F.struct(F.concat(F.lit("sys"), text_of("nation")).alias("system_id"), F.lit("S").alias("name"), F.lit("bronze").alias("layer"), F.col("nation").cast("int").alias("trust_score")))
    files = g.table("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.collect_list(record).alias("bronze")).select("nation", F.to_json(F.struct(system.alias("source_systems"), "bronze")).alias("value"))
    folder = new_folder(g, "seeds")
    files.repartition("nation").write.partitionBy("nation").text(folder)
    return filings.scan_medallion_seed(g.spark, f"{folder}/*")


def fact_sets(g: Graph) -> DataFrame:
    """Each fund's holdings as a fact set, a file of its own, read again."""
    weight = F.col("weight_pct").cast("decimal(12,6)").cast("string")
    fact = F.struct(F.lit("relation").alias("kind"), F.lit("HOLDS").alias("type"), text_of("fund").alias("subject"), text_of("company").alias("object"), F.create_map(F.lit("weight"), weight, F.lit("period"), text_of("as_of")).alias("qualifiers"))
    said = F.struct(text_of("fund").alias("version"), F.struct(F.concat(F.lit("d"), text_of("fund")).alias("doc_id")).alias("document"), F.lit("d0").alias("supersedes"), "facts")
    folder = new_folder(g, "fact-sets")
    g.holds.groupBy("fund").agg(F.collect_list(fact).alias("facts")).select("fund", F.to_json(said).alias("value")).repartition("fund").write.partitionBy("fund").text(folder)
    return filings.scan_fact_set(g.spark, f"{folder}/*")


def policy(g: Graph) -> DataFrame:
    """A rule for each region, written as one small policy file, read again."""
    rule = F.format_string("- name: %s\n  trigger: {kind: relation, type: R%d, change: [added, changed]}\n  traverse:\n  - {relation: SUPPLIES_TO}\n  - {relation: HOLDS}\n", F.col("name"), F.col("firm"))
    folder = new_folder(g, "policy")
    g.firm.agg(F.concat(F.lit("rules:\n"), F.array_join(F.sort_array(F.collect_list(rule)), "")).alias("value")).coalesce(1).write.text(folder)
    return filings.load_policy(g.spark, folder)


def frozen(g: Graph) -> DataFrame:
    """Tables of a snapshot as they come back."""
    folder = new_folder(g, "snapshot")
    filings.write_snapshot(g.spark, {"supplies_to": g.supplies_to, "managed_by": g.managed_by}, folder)
    back = filings.scan_snapshot(g.spark, folder)
    return back["supplies_to"].select(F.lit("supplies_to").alias("name"), text_of("src").alias("a"), text_of("dst").alias("b")).unionByName(back["managed_by"].select(F.lit("managed_by").alias("name"), text_of("fund").alias("a"), text_of("firm").alias("b")))


def accepted(g: Graph) -> DataFrame:
    keep = reviewed(g).where("decision <> 'reject'").select("ord", "subject", "rel", "object").distinct()
    return keep.join(triples(g), ["ord", "subject", "rel", "object"]).select("ord", "subject", "rel", "object", "confidence", "doc_id")


def through_stream(g: Graph, parts: list[DataFrame], job) -> DataFrame:
    """What a job appends when the parts come one after the other."""
    source, out, marks = (new_folder(g, n) for n in ("stream-in", "stream-out", "stream-marks"))
    for part in parts:
        part.write.mode("append").parquet(source)
        job(g.spark.readStream.schema(part.schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return g.spark.read.parquet(out)


def in_three(rows: DataFrame) -> list[DataFrame]:
    """Rows in three parts by order, which their numbers begin with, as they might come one after the other."""
    first, second = rows.approxQuantile("doc_id", [0.3, 0.7], 0.01) if not rows.isEmpty() else (0, 0)
    return [rows.where(F.col("doc_id") <= first), rows.where((F.col("doc_id") > first) & (F.col("doc_id") <= second)), rows.where(F.col("doc_id") > second)]


def steward_stream(g: Graph) -> DataFrame:
    rows = accepted(g).select("ord", text_of("subject").alias("subject"), "rel", text_of("object").alias("object"), "doc_id")
    return through_stream(g, in_three(written(rows, "stream-rows")), ingest.steward_state)


def impact_changes(g: Graph) -> DataFrame:
    last = lambda v: v.groupBy("name", "subject", "object").agg(F.max_by("payload", "ord").alias("payload"), F.max("ord").alias("ord"))
    return through_stream(g, [last(v) for v in versions(g)], ingest.impact_stream)


def edges_stream(g: Graph) -> DataFrame:
    """The edge table after all accepted triples came as a stream, in three parts."""
    rows = accepted(g).select(text_of("subject").alias("subject"), "rel", text_of("object").alias("object"), "ord", "confidence", "doc_id")
    source, root, marks = (new_folder(g, n) for n in ("edges-in", "edges", "edges-marks"))
    for part in in_three(written(rows, "stream-rows")):
        part.write.mode("append").parquet(source)
        ingest.upsert_stream(g.spark.readStream.schema(rows.schema).parquet(source), root, marks).awaitTermination()
    return ingest.latest(g.spark, root, 3).select("subject", "rel", "object", "corroboration", F.size("doc_ids").alias("n_docs"))


BUILD = {
    "scan_nport": lambda g: nport(g)[1].select("series_id", "name", "shares", "value_usd", "weight_pct", "as_of"),
    "scan_nport_funds": lambda g: nport(g)[0].select("series_id", "name", "cik", "as_of").distinct(),
    "nport_totals": lambda g: filings.nport_totals(nport(g)[1]),
    "scan_issuer_spine": issuer_spine,
    "scan_fund_spine": lambda g: fund_spine(g).select("series_id", "cik", F.array_join("class_ids", ",").alias("class_ids"), F.array_join("tickers", ",").alias("tickers")),
    "scan_crosswalk": crosswalk_file,
    "scan_extractions": lambda g: extractions(g)[0].select("chunk_id", "label", "name", F.round("confidence", 8).alias("confidence"), sorted_text(F.col("attributes")).alias("attributes")),
    "scan_extractions_relations": lambda g: extractions(g)[1].select("chunk_id", "type", "subject", "object", "confidence"),
    "write_snapshot": frozen,
    "scan_medallion_seed": lambda g: seeds(g)[1].select("record_id", "system_id", "entity_type", "master_key", sorted_text(F.col("attributes")).alias("attributes")),
    "scan_medallion_systems": lambda g: seeds(g)[0].select("system_id", "layer", "trust_score"),
    "scan_fact_set": lambda g: fact_sets(g).select("version", "document", "supersedes", "kind", "name", "subject", "object", "period", "payload"),
    "load_policy": lambda g: policy(g).select("rule", "kind", "name", "traversal", F.array_join("changes", ",").alias("changes")),
    "ingest_stream": edges_stream,
    "steward_state": steward_stream,
    "impact_stream": impact_changes,
}

GOOD = f"{TRIPLES}, fine AS (SELECT DISTINCT t.ord, t.subject, t.rel, t.object, t.doc_id FROM decided d JOIN triples t USING (ord, subject, rel, object) WHERE decision <> 'reject')"
SQL = {
    "scan_nport": "SELECT 'S' || fund AS series_id, name, round(shares, 2) AS shares, round(value_usd, 2) AS value_usd, weight_pct, CAST((SELECT max(as_of) FROM holds o WHERE o.fund = h.fund) AS VARCHAR) AS as_of FROM holds h JOIN company USING (company) WHERE company % 5 <> 0",
    "scan_nport_funds": "SELECT 'S' || fund AS series_id, name, lpad(ltrim(CAST(fund AS VARCHAR), '0'), 10, '0') AS cik, CAST(d AS VARCHAR) AS as_of FROM fund JOIN (SELECT fund, max(as_of) AS d FROM holds GROUP BY fund) USING (fund)",
    "nport_totals": "SELECT 'S' || fund AS series_id, round(CAST(sum(CAST(weight_pct AS DECIMAL(28,6))) AS DOUBLE), 6) AS total_weight, round(CAST(sum(CAST(round(value_usd, 2) AS DECIMAL(28,6))) AS DOUBLE), 2) AS total_value FROM holds WHERE company % 5 <> 0 GROUP BY fund",
    "scan_issuer_spine": "SELECT lpad(ltrim(CAST(p_partkey AS VARCHAR), '0'), 10, '0') AS cik, 'T-' || p_size AS ticker, p_name || ' Inc.' AS title, p_name AS norm, p_partkey AS ord FROM part",
    "scan_fund_spine": "SELECT 'S' || fund AS series_id, lpad(ltrim(CAST(fund AS VARCHAR), '0'), 10, '0') AS cik, 'C1-' || fund || ',C2-' || fund AS class_ids, 'f1' || fund || ',f2' || fund AS tickers FROM fund",
    "scan_crosswalk": "SELECT 'T-' || (s_suppkey % 40) AS ticker, lpad(CAST(max(s_suppkey) AS VARCHAR), 9, '0') AS cusip, arg_max(s_name, s_suppkey) AS issuer_name, 'COM' AS title_of_class FROM supplier GROUP BY 1",
    "scan_extractions": "SELECT CAST(o_orderkey AS VARCHAR) AS chunk_id, 'Company' AS label, 'c' || o_custkey AS name, round(least(1.0, o_totalprice / 100000), 8) AS confidence, 'a=' || o_orderpriority || ';b=x' AS attributes FROM orders WHERE o_orderstatus <> 'P'",
    "scan_extractions_relations": "SELECT CAST(o_orderkey AS VARCHAR) AS chunk_id, 'SUPPLIES_TO' AS type, CAST(o_custkey AS VARCHAR) AS subject, CAST(o_orderkey AS VARCHAR) AS object, CAST(1.0 AS DOUBLE) AS confidence FROM orders WHERE o_orderkey % 3 <> 0",
    "write_snapshot": "SELECT 'supplies_to' AS name, CAST(src AS VARCHAR) AS a, CAST(dst AS VARCHAR) AS b FROM supplies_to UNION ALL SELECT 'managed_by', CAST(fund AS VARCHAR), CAST(firm AS VARCHAR) FROM managed_by",
    "scan_medallion_seed": "SELECT 'r' || s_suppkey AS record_id, 'pms' AS system_id, 'Supplier' AS entity_type, CAST(s_nationkey AS VARCHAR) AS master_key, 'balance=' || s_acctbal || ';name=' || s_name AS attributes FROM supplier",
    "scan_medallion_systems": "SELECT DISTINCT 'sys' || s_nationkey AS system_id, 'bronze' AS layer, CAST(s_nationkey AS INT) AS trust_score FROM supplier",
    "scan_fact_set": "SELECT CAST(fund AS VARCHAR) AS version, 'd' || fund AS document, 'd0' AS supersedes, 'relation' AS kind, 'HOLDS' AS name, CAST(fund AS VARCHAR) AS subject, CAST(company AS VARCHAR) AS object, CAST(as_of AS VARCHAR) AS period, 'period=' || as_of || ';weight=' || CAST(weight_pct AS DECIMAL(12,6)) AS payload FROM holds",
    "load_policy": "SELECT name AS rule, 'relation' AS kind, 'R' || firm AS name, 'SUPPLIES_TO,HOLDS' AS traversal, 'added,changed' AS changes FROM firm",
    "ingest_stream": f"WITH {GOOD} SELECT CAST(subject AS VARCHAR) AS subject, rel, CAST(object AS VARCHAR) AS object, count(*) AS corroboration, CAST(count(DISTINCT doc_id) AS INT) AS n_docs FROM fine GROUP BY ALL",
    "steward_state": f"WITH {GOOD}, x AS (SELECT *, row_number() OVER (PARTITION BY subject, rel, object ORDER BY ord) AS n, min(ord) OVER (PARTITION BY subject, rel) AS first_ord FROM fine) SELECT ord, CAST(subject AS VARCHAR) AS subject, rel, CAST(object AS VARCHAR) AS object, CASE WHEN rel IN ('SUBSIDIARY_OF', 'MANAGED_BY') AND n = 1 AND first_ord < ord THEN 'conflict' WHEN n > 1 THEN 'corroborate' ELSE 'insert' END AS decision, n AS corroboration FROM x",
    "impact_stream": f"WITH {CHANGES} SELECT name, subject, object, 'added' AS change, NULL AS old_value, payload AS new_value FROM v1 UNION ALL SELECT name, subject, object, change, old_value, new_value FROM changes WHERE change <> 'removed'",
}

QUERIES = {name: (lambda spark, sf_dir, build=build: build(Graph(spark, sf_dir))) for name, build in BUILD.items()}
ORACLE_SQL = {name: sql(body) for name, body in SQL.items()}
