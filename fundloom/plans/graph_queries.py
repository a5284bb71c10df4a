"""Scope, impact, steward, master-data, quality and text queries over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.functions import text as tf
from fundloom.graphmodel import Graph, exact, sql
from fundloom.operators import impact, mdm, scope, steward, textjobs, traversal
from fundloom.sources.tables import written

FIRM = 2
CASE = r"(CASE WHEN sensitivity IS NULL THEN 'public' ELSE sensitivity END)"


def supply_edges(g: Graph) -> DataFrame:
    """Supply edges with a confidence and sensitivity of their own."""
    k = F.col("src") + F.col("dst")
    return g.supplies_to.select("src", "dst", F.when(k % 7 == 0, None).otherwise((k % 10) / 10.0).alias("confidence"), F.when(k % 5 == 0, "internal").when(k % 5 == 1, None).otherwise("public").alias("sensitivity"))


SUPPLY = "edges AS (SELECT src, dst, CASE WHEN (src + dst) % 7 = 0 THEN NULL ELSE ((src + dst) % 10) / 10.0 END AS confidence, CASE WHEN (src + dst) % 5 = 0 THEN 'internal' WHEN (src + dst) % 5 = 1 THEN NULL ELSE 'public' END AS sensitivity FROM supplies_to)"


def nodes(g: Graph) -> DataFrame:
    return g.company.select(F.col("company").alias("node"), F.when(F.col("company") % 6 == 0, "internal").otherwise("public").alias("sensitivity"))


NODES = "nodes AS (SELECT company AS node, CASE WHEN company % 6 = 0 THEN 'internal' ELSE 'public' END sensitivity FROM company)"


def firm_edges(g: Graph) -> DataFrame:
    return scope.firm_scope_edges(FIRM, g.managed_by, g.holds, g.supplies_to, g.exposed_to, g.mentions)


FIRM_EDGES = f"""own AS (SELECT fund FROM managed_by WHERE firm = {FIRM}), mine AS (SELECT DISTINCT company FROM holds WHERE fund IN (FROM own)), fe AS (
    SELECT 'MANAGED_BY' AS rel, CAST(fund AS VARCHAR) src, CAST(firm AS VARCHAR) dst FROM managed_by WHERE firm = {FIRM}
    UNION ALL SELECT 'HOLDS', CAST(fund AS VARCHAR), CAST(company AS VARCHAR) FROM holds WHERE fund IN (FROM own)
    UNION ALL SELECT 'SUPPLIES_TO', CAST(src AS VARCHAR), CAST(dst AS VARCHAR) FROM supplies_to WHERE src IN (FROM mine) AND dst IN (FROM mine)
    UNION ALL SELECT 'EXPOSED_TO', CAST(company AS VARCHAR), risk_title FROM exposed_to WHERE company IN (FROM mine)
    UNION ALL SELECT 'MENTIONS', CAST(doc_id AS VARCHAR), CAST(company AS VARCHAR) FROM mentions WHERE company IN (FROM mine))"""


def stamped(g: Graph) -> DataFrame:
    """Finished orders carry the stamp of the firm whose fund they are of."""
    own = g.managed_by.where(F.col("firm") == FIRM).select("fund")
    return g.orders.where("o_orderstatus = 'F'").join(own, "fund", "left_semi").select(F.col("o_orderkey").alias("doc_id"))


def fact_sets(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Orders up to the end of 1998 and from 1997 on as two versions of facts; identity (customer, priority)."""
    o = g.table("orders").select(F.col("o_custkey").alias("custkey"), F.when(F.col("o_orderpriority").startswith("4"), None).otherwise(F.col("o_orderpriority")).alias("priority"), F.concat_ws("/", "o_orderstatus", F.format_string("%.2f", "o_totalprice")).alias("payload"), F.col("o_orderkey").alias("ord"), F.year("o_orderdate").alias("y"))
    return o.where("y <= 1998").drop("y"), o.where("y >= 1997").drop("y")


FACTS = """o AS (SELECT o_custkey AS custkey, CASE WHEN o_orderpriority LIKE '4%' THEN NULL ELSE o_orderpriority END AS priority, o_orderstatus || '/' || printf('%.2f', o_totalprice) AS payload, o_orderkey AS ord, year(o_orderdate) AS y FROM orders),
a AS (SELECT * FROM o WHERE y <= 1998 QUALIFY row_number() OVER (PARTITION BY custkey, priority ORDER BY ord DESC) = 1), b AS (SELECT * FROM o WHERE y >= 1997 QUALIFY row_number() OVER (PARTITION BY custkey, priority ORDER BY ord DESC) = 1),
diff AS (SELECT coalesce(b.custkey, a.custkey) custkey, coalesce(b.priority, a.priority) priority, CASE WHEN a.ord IS NULL THEN 'added' WHEN b.ord IS NULL THEN 'removed' ELSE 'changed' END AS change, a.payload AS old_value, b.payload AS new_value
    FROM a FULL JOIN b ON a.custkey = b.custkey AND a.priority IS NOT DISTINCT FROM b.priority WHERE a.payload IS DISTINCT FROM b.payload OR a.ord IS NULL OR b.ord IS NULL)"""


def diff(g: Graph) -> DataFrame:
    return impact.fact_diff(*fact_sets(g), ["custkey", "priority"])


def versions(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Facts of orders up to the end of 1998 and from 1997 on: what is supplied, what one is exposed to, issuers, and order metrics."""
    lines = g.supply_lines.withColumn("y", F.year("filed"))
    fact = lambda kind, name, subject, object_, payload: lines.select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), subject.cast("string").alias("subject"), object_.cast("string").alias("object"), payload.alias("payload"), F.col("doc_id").alias("ord"), "y")
    none = F.lit(None).cast("string")
    facts = fact("relation", "SUPPLIES_TO", F.col("src"), F.col("dst"), F.col("priority")).unionByName(fact("relation", "EXPOSED_TO", F.col("src"), F.col("risk_title"), F.col("priority"))).unionByName(fact("entity", "Company", F.col("src"), none, F.col("component"))).unionByName(fact("entity", "MetricObservation", F.concat(F.lit("m"), (F.col("doc_id") % 1000).cast("string")), none, F.col("priority")))
    return facts.where("y <= 1998").drop("y"), facts.where("y >= 1997").drop("y")


def changes(g: Graph) -> DataFrame:
    return impact.fact_diff(*versions(g), ["kind", "name", "subject", "object"], carry="ord")


CHANGES = """facts AS (SELECT 'relation' AS kind, 'SUPPLIES_TO' AS name, CAST(src AS VARCHAR) AS subject, CAST(dst AS VARCHAR) AS object, priority AS payload, doc_id AS ord, year(filed) AS y FROM supply_lines
    UNION ALL SELECT 'relation', 'EXPOSED_TO', CAST(src AS VARCHAR), risk_title, priority, doc_id, year(filed) FROM supply_lines
    UNION ALL SELECT 'entity', 'Company', CAST(src AS VARCHAR), NULL, component, doc_id, year(filed) FROM supply_lines
    UNION ALL SELECT 'entity', 'MetricObservation', 'm' || (doc_id % 1000), NULL, priority, doc_id, year(filed) FROM supply_lines),
v1 AS (SELECT kind, name, subject, object, arg_max(payload, ord) AS payload, max(ord) AS ord FROM facts WHERE y <= 1998 GROUP BY ALL), v2 AS (SELECT kind, name, subject, object, arg_max(payload, ord) AS payload, max(ord) AS ord FROM facts WHERE y >= 1997 GROUP BY ALL),
changes AS (SELECT coalesce(b.kind, a.kind) AS kind, coalesce(b.name, a.name) AS name, coalesce(b.subject, a.subject) AS subject, coalesce(b.object, a.object) AS object,
        CASE WHEN a.ord IS NULL THEN 'added' WHEN b.ord IS NULL THEN 'removed' ELSE 'changed' END AS change, a.payload AS old_value, b.payload AS new_value, coalesce(b.ord, a.ord) AS ord
    FROM v1 a FULL JOIN v2 b ON a.kind = b.kind AND a.name = b.name AND a.subject = b.subject AND a.object IS NOT DISTINCT FROM b.object WHERE a.ord IS NULL OR b.ord IS NULL OR a.payload <> b.payload),
matched AS (SELECT c.*, rule, traversal FROM changes c JOIN (VALUES ('changed_issuer_to_funds', 'entity', 'Company', 'HOLDS', ['added', 'removed', 'changed']), ('changed_supplier_to_funds', 'relation', 'SUPPLIES_TO', 'SUPPLIES_TO,HOLDS', ['added', 'removed', 'changed']),
        ('changed_risk_to_disclosure', 'relation', 'EXPOSED_TO', 'COVERS', ['added', 'changed']), ('changed_metric_to_reports', 'entity', 'MetricObservation', 'DERIVED_FROM', ['added', 'changed'])) r(rule, k, n, traversal, kinds) ON c.kind = k AND c.name = n AND list_contains(kinds, change))"""


#: The rules that lead to funds.
TO_FUNDS = [r for r in impact.RULES if r[3] in ("HOLDS", "SUPPLIES_TO,HOLDS")]


def kept_lines(g: Graph) -> Graph:
    return g.kept("supply_lines", "doc_id", "src", "dst", "component", "risk_title", "priority", "filed")


def fund_changes(g: Graph) -> DataFrame:
    """Of ``changes`` those of facts that lead to funds; the others are not compared."""
    return impact.fact_diff(*[v.where(F.col("name").isin([r[2] for r in TO_FUNDS])) for v in versions(g)], ["kind", "name", "subject", "object"], carry="ord")


def holdings_reached(g: Graph, diff: DataFrame, holds: DataFrame) -> DataFrame:
    """The funds of ``reached`` for counts by holding: a holding stands once however many changes reach it."""
    matched = written(impact.trigger_match(diff, TO_FUNDS).select("traversal", "subject").distinct(), "changed")
    asked = matched.where("traversal = 'SUPPLIES_TO,HOLDS'").select(F.col("subject").try_cast("long").alias("company"))
    return impact.holdings_reached(matched, holds, traversal.dependents_of_any(g.supplies_to, asked))


def derived(g: Graph) -> DataFrame:
    """A report for each fund and the orders that it comes from."""
    return g.orders.select(F.concat(F.lit("pack_"), F.col("fund").cast("string")).alias("report_id"), F.lit("Document").alias("kind"), F.col("o_orderkey").cast("string").alias("target"))


DERIVED = "derived AS (SELECT 'pack_' || c_nationkey AS report_id, 'Document' AS kind, CAST(o_orderkey AS VARCHAR) AS target FROM orders JOIN customer ON o_custkey = c_custkey)"


def all_matched(g: Graph) -> DataFrame:
    return written(impact.trigger_match(changes(kept_lines(g))).select("rule", "traversal", "subject", "object", "ord"), "matched")


def rollup(g: Graph) -> DataFrame:
    return impact.rollup(all_matched(g), g.holds, g.supplies_to, g.covers, derived(g))


def reached(g: Graph) -> DataFrame:
    return impact.propagate_along(all_matched(g), g.holds, g.supplies_to, g.covers, derived(g))


REACHED = f"""{CHANGES}, {DERIVED}, links AS (SELECT DISTINCT src, dst FROM supplies_to), subj AS (SELECT DISTINCT CAST(subject AS BIGINT) AS company FROM matched WHERE traversal = 'SUPPLIES_TO,HOLDS'),
deps AS (SELECT company, company AS dependent FROM subj UNION SELECT company, src FROM subj JOIN links ON dst = company UNION SELECT company, y.src FROM subj JOIN links x ON x.dst = company JOIN links y ON y.dst = x.src),
near AS (SELECT DISTINCT rule, subject, dependent AS held FROM matched JOIN deps ON CAST(subject AS BIGINT) = company WHERE traversal = 'SUPPLIES_TO,HOLDS' UNION SELECT rule, subject, CAST(subject AS BIGINT) FROM matched WHERE traversal = 'HOLDS'),
reached AS (SELECT rule, 'fund' AS target_kind, CAST(fund AS VARCHAR) AS target, subject AS via, company AS held FROM near JOIN holds ON held = company
    UNION SELECT rule, 'section', section_key, subject, NULL FROM matched JOIN covers ON object = risk_title WHERE traversal = 'COVERS'
    UNION SELECT rule, 'report', report_id, subject, NULL FROM matched JOIN derived ON CAST(ord AS VARCHAR) = target WHERE traversal = 'DERIVED_FROM')"""


def triples(g: Graph) -> DataFrame:
    """Lines as a stream of candidate triples in a total order."""
    kinds = F.array(*map(F.lit, ["SUPPLIES_TO", "SUBSIDIARY_OF", "MANAGED_BY", "HOLDS", "KNOWS"]))
    ordered = g.table("lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_shipdate").alias("ord"), F.col("l_suppkey").alias("subject"), F.element_at(kinds, (F.col("l_linenumber") % 5 + 1).cast("int")).alias("rel"), (F.col("l_partkey") % 20).alias("object"),
        F.when(F.col("l_returnflag") == "N", "Fund").otherwise("Company").alias("subject_label"), F.when(F.col("l_linestatus") == "O", "Company").otherwise("Region").alias("object_label"), (1 - F.col("l_discount") * 6).alias("confidence"), F.col("l_orderkey").alias("doc_id"),
    )
    return ordered.distinct().withColumn("ord", F.concat_ws("-", *[F.lpad(F.col(f"ord.{c}").cast("string"), 12, "0") for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")], F.date_format("ord.l_shipdate", "yyyyMMdd")))


TRIPLES = """triples AS (SELECT DISTINCT lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_linenumber AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') || '-' || lpad(CAST(l_extendedprice AS VARCHAR), 12, '0') || '-' || strftime(l_shipdate, '%Y%m%d') AS ord,
    l_suppkey AS subject, (['SUPPLIES_TO', 'SUBSIDIARY_OF', 'MANAGED_BY', 'HOLDS', 'KNOWS'])[l_linenumber % 5 + 1] AS rel, l_partkey % 20 AS object, CASE WHEN l_returnflag = 'N' THEN 'Fund' ELSE 'Company' END AS subject_label,
    CASE WHEN l_linestatus = 'O' THEN 'Company' ELSE 'Region' END AS object_label, 1 - l_discount * 6 AS confidence, l_orderkey AS doc_id FROM lineitem),
existing AS (SELECT src AS subject, 'SUPPLIES_TO' AS rel, dst % 20 AS object, CAST(count(*) AS BIGINT) AS corroboration FROM supplies_to GROUP BY ALL UNION ALL SELECT s, 'SUBSIDIARY_OF', s % 20, 1 FROM (SELECT DISTINCT src AS s FROM supplies_to)),
reviewed AS (SELECT t.*, CASE WHEN rel = 'KNOWS' THEN 'unknown relation' WHEN subject_label = 'Fund' AND rel IN ('SUPPLIES_TO', 'SUBSIDIARY_OF') OR subject_label = 'Company' AND rel IN ('HOLDS', 'MANAGED_BY') THEN 'bad domain' WHEN object_label = 'Region' THEN 'bad range' WHEN confidence < 0.6 THEN 'low confidence' END AS reason FROM triples t),
good AS (SELECT r.*, e.corroboration AS had_n, EXISTS (SELECT 1 FROM existing x WHERE x.subject = r.subject AND x.rel = r.rel) AS had, row_number() OVER (PARTITION BY r.subject, r.rel, r.object ORDER BY ord) AS nth, min(ord) OVER (PARTITION BY r.subject, r.rel) AS first_ord FROM reviewed r LEFT JOIN existing e USING (subject, rel, object) WHERE reason IS NULL),
decided AS (SELECT ord, subject, rel, object, CASE WHEN rel IN ('SUBSIDIARY_OF', 'MANAGED_BY') AND had_n IS NULL AND nth = 1 AND (had OR first_ord < ord) THEN 'conflict' WHEN coalesce(had_n, 0) + nth > 1 THEN 'corroborate' ELSE 'insert' END AS decision, CAST(NULL AS VARCHAR) AS reason, coalesce(had_n, 0) + nth AS corroboration FROM good
    UNION ALL SELECT ord, subject, rel, object, 'reject', reason, 0 FROM reviewed WHERE reason IS NOT NULL)"""


def existing_edges(g: Graph) -> DataFrame:
    a = g.supplies_to.groupBy(F.col("src").alias("subject"), F.lit("SUPPLIES_TO").alias("rel"), (F.col("dst") % 20).alias("object")).agg(F.count("*").alias("corroboration"))
    b = g.supplies_to.select(F.col("src").alias("subject")).distinct().select("subject", F.lit("SUBSIDIARY_OF").alias("rel"), (F.col("subject") % 20).alias("object"), F.lit(1).cast("long").alias("corroboration"))
    return a.unionByName(b)


def reviewed(g: Graph) -> DataFrame:
    spec = g.spark.createDataFrame([("SUPPLIES_TO", ["Company"], ["Company"]), ("SUBSIDIARY_OF", ["Company"], ["Company"]), ("MANAGED_BY", ["Fund"], ["Company"]), ("HOLDS", ["Fund"], ["Company"])], "rel string, domain array<string>, range array<string>")
    return steward.steward_review(triples(g), existing_edges(g), spec)


def upserted(g: Graph) -> DataFrame:
    accepted = reviewed(g).where("decision <> 'reject'").select("ord", "subject", "rel", "object").join(triples(g).select("ord", "subject", "rel", "object", "confidence", "doc_id"), ["ord", "subject", "rel", "object"])
    old = existing_edges(g).select("*", F.lit(1.0).alias("confidence"), F.array(F.lit(-1).cast("long")).alias("doc_ids"))
    return steward.upsert_edges(old, accepted.distinct()).select("subject", "rel", "object", "corroboration", F.round("confidence", 4).alias("confidence"), F.size("doc_ids").cast("long").alias("n_docs"))


def spine(g: Graph) -> DataFrame:
    return g.company.select(steward.pad_cik(F.col("company") * 37).alias("cik"), F.concat(F.lit("s."), (F.col("company") % 50).cast("string")).alias("ticker"), F.concat("name", F.lit(" Inc.")).alias("title"), F.col("company").alias("ord"))


def mentions(g: Graph) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat(F.lit("The PART#"), F.lpad((k % 200).cast("string"), 9, "0"), F.lit(", Corp"))
    return g.table("customer").select(name.alias("mention"), F.when(k % 3 == 0, F.concat(F.lit(" S-"), (k % 70).cast("string"), F.lit(" "))).when(k % 3 == 1, F.lit("")).alias("ticker"))


#: A name's words without suffixes and stopwords.
NORM = "array_to_string(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains(" + str(steward.SUFFIXES + steward.STOPWORDS) + ", w)), ' ')"
TICK = "nullif(replace(upper(trim({})), '.', '-'), '')"
RESOLVED = f"""spine AS (SELECT lpad(ltrim(CAST(company * 37 AS VARCHAR), '0'), 10, '0') AS cik, 's.' || (company % 50) AS ticker, name || ' Inc.' AS title, company AS ord FROM company),
m AS (SELECT 'The PART#' || lpad(CAST(c_custkey % 200 AS VARCHAR), 9, '0') || ', Corp' AS mention, CASE c_custkey % 3 WHEN 0 THEN ' S-' || (c_custkey % 70) || ' ' WHEN 1 THEN '' END AS ticker FROM customer),
resolved AS (SELECT mention, m.ticker, coalesce(t.cik, n.cik) AS cik, CASE WHEN t.cik IS NOT NULL THEN 'ticker' WHEN n.cik IS NOT NULL THEN 'alias' ELSE 'provisional' END AS method FROM m
    LEFT JOIN (SELECT {TICK.format('ticker')} t, arg_min(cik, ord) cik FROM spine GROUP BY 1) t ON t.t = {TICK.format('m.ticker')}
    LEFT JOIN (SELECT {NORM.format('title')} n, arg_min(cik, ord) cik FROM spine GROUP BY 1) n ON n.n = {NORM.format('mention')})"""


def records(g: Graph) -> DataFrame:
    """Source records of 30 clusters a thousand customers: three systems that disagree."""
    k = F.col("c_custkey")
    value = F.explode(F.create_map(F.lit("id"), F.when(k % 5 == 0, F.lit("Not Stated")).otherwise(F.concat(F.lit("PROP-"), (k % 7).cast("string"))), F.lit("class"), F.when(k % 11 == 0, F.lit("")).otherwise(F.col("c_mktsegment")), F.lit("area"), F.when(k % 13 == 0, F.lit("unknown")).otherwise(F.concat(F.format_string("%.2f", F.abs("c_acctbal")), F.lit(" sq ft"))), F.lit("name"), F.concat(F.lit("The Prop-"), (k % 40).cast("string"), F.element_at(F.array(F.lit(" Tower Ltd"), F.lit(" Tower, Limited"), F.lit(" (Tower East) Holdings"), F.lit(" House Co.")), (k % 4 + 1).cast("int"))), F.lit("address"), F.element_at(F.array(F.lit("12 High St"), F.lit("12 High St SW1A 1AA"), F.lit("Flat 3, 12 High Street, London"), F.lit("N/A")), (k % 4 + 1).cast("int")))).alias("attribute", "value")
    return g.table("customer").select((k % 40 + F.floor(k / 1000) * 40).alias("cluster"), k.alias("record_id"), F.element_at(F.array(F.lit("loan"), F.lit("pms"), F.lit("curated")), (k % 3 + 1).cast("int")).alias("system"), F.element_at(F.array(F.lit(80), F.lit(88), F.lit(95)), (k % 3 + 1).cast("int")).alias("trust"), value)


RECORDS = """r AS (SELECT c_custkey % 40 + (c_custkey // 1000) * 40 AS cluster, c_custkey AS record_id, (['loan', 'pms', 'curated'])[c_custkey % 3 + 1] AS system, ([80, 88, 95])[c_custkey % 3 + 1] AS trust, * FROM customer),
records AS (SELECT cluster, record_id, system, trust, 'id' AS attribute, CASE WHEN c_custkey % 5 = 0 THEN 'Not Stated' ELSE 'PROP-' || (c_custkey % 7) END AS value FROM r UNION ALL SELECT cluster, record_id, system, trust, 'class', CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END FROM r
    UNION ALL SELECT cluster, record_id, system, trust, 'area', CASE WHEN c_custkey % 13 = 0 THEN 'unknown' ELSE printf('%.2f', abs(c_acctbal)) || ' sq ft' END FROM r
    UNION ALL SELECT cluster, record_id, system, trust, 'name', 'The Prop-' || (c_custkey % 40) || ([' Tower Ltd', ' Tower, Limited', ' (Tower East) Holdings', ' House Co.'])[c_custkey % 4 + 1] FROM r
    UNION ALL SELECT cluster, record_id, system, trust, 'address', (['12 High St', '12 High St SW1A 1AA', 'Flat 3, 12 High Street, London', 'N/A'])[c_custkey % 4 + 1] FROM r),
full_ AS (SELECT * FROM records WHERE value IS NOT NULL AND value NOT IN ('', 'Not Stated', 'N/A', 'na')),
trusted AS (SELECT cluster, attribute, value, record_id, system FROM full_ QUALIFY row_number() OVER (PARTITION BY cluster, attribute ORDER BY trust DESC, record_id) = 1)"""
def golden(g: Graph) -> DataFrame:
    return mdm.golden_record(mdm.survive_trust(records(g)), mdm.survive_crosswalk(records(g).where("attribute = 'id'"), "loan"))


def pairs(g: Graph) -> DataFrame:
    return mdm.pairwise_match(records(g), "name", "address", "id")


def pages_text(g: Graph) -> DataFrame:
    text = tf.strip_html(F.col("html"))
    return g.table("pages").select("page_id", tf.looks_like_html(F.col("html")).alias("is_html"), F.char_length(text).cast("long").alias("n_chars"), F.md5(text).alias("text_md5"))


WS = r"trim(regexp_replace(p, '[ \t\n]+', ' ', 'g'))"
DOC_TEXT = "coalesce(text, '')"
FORM_CASE = "CASE " + " ".join(f"WHEN contains(upper(replace(substr(text, 1, 4000), 'ß', 'ss')), '{f}') OR contains(translate(upper(replace(substr(text, 1, 4000), 'ß', 'ss')), '- ', ''), '{f.replace('-', '').replace(' ', '')}') THEN '{f}'" for f in tf.FORMS) + " ELSE 'text' END"
INTERNAL_CASE = " OR ".join(f"contains(lower(substr({DOC_TEXT}, 1, 4000)), '{m}')" for m in tf.INTERNAL)


def ANY(words: list[str]) -> str:  # noqa: N802
    return "(" + " OR ".join(f"contains(lower({DOC_TEXT}), '{w}')" for w in words) + ")"


STRIPPED = r"regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
for tag in tf.DROP_TAGS:
    STRIPPED = f"regexp_replace({STRIPPED}, '{rf'(?is)<{tag}\b[^>]*>' if tag in tf.VOID_TAGS else rf'(?is)<{tag}\b.*?</{tag}\s*>'}', '', 'g')"
for tag in tf.BLOCK_TAGS:
    STRIPPED = f"regexp_replace({STRIPPED}, '{rf'(?i)<{tag}\b[^>]*>' if tag in tf.VOID_TAGS else rf'(?i)</{tag}\s*>'}', chr(10) || chr(10), 'g')"
STRIPPED = f"regexp_replace({STRIPPED}, '<[^>]*>', '', 'g')"
# The references of the test pages; the ampersand last, so that each is read once.
for said, meant in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&amp;", "&")]:
    STRIPPED = f"replace({STRIPPED}, '{said}', '{meant}')"


def text_features(g: Graph) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return g.table("documents").select("doc_id", tf.slug(t).alias("slug"), tf.hash_id(t).alias("hash_id"), tf.detect_doc_type(t).alias("doc_type"), tf.detect_sensitivity(t).alias("sensitivity"), tf.is_table(t).alias("is_table"), tf.is_heading(t).alias("is_heading"), tf.approx_tokens(t).alias("tokens"), tf.page_estimate(t).alias("pages"), F.md5(tf.snippet(t)).alias("snippet_md5"), tf.severity_band(t).alias("band"))


def vocabulary(g: Graph) -> DataFrame:
    """Words of benchmark items, and their first sentences and first 40 characters as they are up to a word's end, each naming its smallest item."""
    low = F.lower("text")
    as_they_are = [F.regexp_extract(low, p, 1) for p in (r"^([^.]*[\p{L}\p{N}])\.", r"(?s)^(.{40}[\p{L}\p{N}]*)")]
    words = g.table("benchmark").select("item_id", F.explode(F.concat(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array(*as_they_are))).alias("alias"))
    return words.where(r"alias rlike '[\\p{L}\\p{N}]$'").groupBy("alias").agg(F.min("item_id").alias("canonical"))


BUILD = {
    "entitlement_filter": lambda g: scope.entitlement_filter(supply_edges(g), nodes(g), ["public"]).select("src", "dst"),
    "entitlement_split": lambda g: scope.entitlement_split(g.document.withColumn("y", F.year("filing_date")), ["y"], ["public"]),
    "min_confidence_filter": lambda g: scope.min_confidence(supply_edges(g), 0.5).select("src", "dst"),
    "firm_scope_edges": firm_edges,
    "firm_scope_documents": lambda g: scope.firm_scope_documents(g.document, g.mentions, scope.held_by(g.holds, g.managed_by, FIRM), stamped(g)).select("doc_id", "filing_date"),
    "subgraph_view": lambda g: scope.subgraph_nodes(firm_edges(g)),
    "graph_counts": lambda g: scope.graph_counts({"firm": g.firm, "fund": g.fund, "company": g.company, "holds": g.holds, "supplies_to": g.supplies_to, "exposed_to": g.exposed_to, "covers": g.covers, "mentions": g.mentions}),
    "cross_firm_leak_check": lambda g: scope.cross_firm_leaks(firm_edges(g).unionByName(g.holds.select(F.lit("HOLDS").alias("rel"), F.col("fund").cast("string").alias("src"), F.col("company").cast("string").alias("dst"))), g.managed_by, FIRM),
    "delete_firm": lambda g: scope.delete_firm(FIRM, g.managed_by, g.holds)[1].groupBy("fund").agg(F.count("*").alias("n")),
    "fact_diff_join": diff,
    "diff_counts": lambda g: impact.diff_counts(diff(g)),
    "facts_added": lambda g: diff(g).where("change = 'added'").select("custkey", "priority"),
    "facts_removed": lambda g: diff(g).where("change = 'removed'").select("custkey", "priority"),
    "facts_changed": lambda g: diff(g).where("change = 'changed'").select("custkey", "priority", "old_value", "new_value"),
    "trigger_match": lambda g: impact.trigger_match(changes(g)),
    "propagate": reached,
    "impact_rollup": rollup,
    "apply_flags": lambda g: impact.apply_flags(g.covers.select("section_key"), reached(g).where("target_kind = 'section'"), "section_key", "stale"),
    "steward_review": reviewed,
    "facts_accepted": lambda g: reviewed(g).groupBy("decision", "reason").agg(F.count("*").alias("n")),
    "upsert_edges": upserted,
    "resolve_mentions": lambda g: steward.resolve_mentions(mentions(g), spine(g)),
    "canonical_names": lambda g: steward.canonical_names(steward.resolve_mentions(mentions(g), spine(g))),
    "survive_trust": lambda g: mdm.survive_trust(records(g)),
    "survive_system_of_record": lambda g: mdm.survive_system_of_record(records(g), "pms"),
    "survive_most_complete": lambda g: mdm.survive_most_complete(records(g)),
    "survive_crosswalk": lambda g: mdm.survive_crosswalk(records(g).where("attribute = 'id'"), "loan"),
    "survive_numeric_tolerance": lambda g: mdm.survive_numeric_tolerance(records(g).where("attribute in ('area', 'class')"), "pms", 50000.0),
    "golden_record": lambda g: golden(g),
    "lineage": lambda g: mdm.lineage(mdm.survive_trust(records(g))),
    "pairwise_match": lambda g: pairs(g),
    "match_confidence": lambda g: mdm.match_confidence(records(g), pairs(g)),
    "master_entities": lambda g: records(g).where("cluster is not null").groupBy("cluster").agg(F.countDistinct("system").alias("n_systems"), F.countDistinct("record_id").alias("n_records")),
    "key_uniqueness": lambda g: g.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1"),
    "vocabulary_check": lambda g: g.supplies_to.where(~F.col("criticality").isin("critical", "named", "mentioned")).groupBy("criticality").agg(F.count("*").alias("n")),
    "provenance_completeness": lambda g: g.document.agg(F.count("*").alias("n"), F.count(F.when(F.col("sensitivity").isNull(), 1)).alias("no_sensitivity"), F.count(F.when(F.col("filing_date").isNull(), 1)).alias("no_date")),
    "embedding_check": lambda g: g.table("embeddings").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")),
    "domain_range_check": lambda g: reviewed(g).where("reason in ('bad domain', 'bad range')").groupBy("rel", "reason").agg(F.count("*").alias("n")),
    "text_functions": text_features,
    "strip_html": pages_text,
    "hash_embed": lambda g: textjobs.hash_embed(g.table("documents")),
    "detect_mentions": lambda g: textjobs.detect_mentions(g.table("documents"), vocabulary(g)),
    "chunk_documents": lambda g: textjobs.chunk_documents(g.table("pages").select(F.col("page_id").alias("doc_id"), tf.strip_html(F.col("html")).alias("text")), target=100, hard=120),
    "vector_top_k": lambda g: textjobs.vector_top_k(g.table("embeddings"), g.table("embeddings").where("vec_id % 100 = 0")),
    "job_event_log": lambda g: g.table("events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(exact("value")).cast("double"), 4).alias("total")),
}

SQL = {
    "entitlement_filter": f"WITH {SUPPLY}, {NODES} SELECT src, dst FROM edges e WHERE (sensitivity IS NULL OR sensitivity = 'public') AND src IN (SELECT node FROM nodes WHERE sensitivity = 'public') AND dst IN (SELECT node FROM nodes WHERE sensitivity = 'public')",
    "entitlement_split": f"SELECT CAST(year(filing_date) AS INT) AS y, count(*) FILTER ({CASE} = 'public') n_visible, count(*) FILTER ({CASE} <> 'public') n_withheld FROM document GROUP BY 1",
    "min_confidence_filter": f"WITH {SUPPLY} SELECT src, dst FROM edges WHERE coalesce(confidence, 1.0) >= 0.5",
    "firm_scope_edges": f"WITH {FIRM_EDGES} SELECT * FROM fe",
    "firm_scope_documents": f"WITH {FIRM_EDGES} SELECT doc_id, filing_date FROM document WHERE doc_id IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_nationkey IN (FROM own)) OR doc_id IN (SELECT doc_id FROM mentions WHERE company IN (FROM mine))",
    "subgraph_view": f"WITH {FIRM_EDGES} SELECT node, count(*) degree FROM (SELECT src AS node FROM fe UNION ALL SELECT dst FROM fe) GROUP BY node",
    "graph_counts": " UNION ALL ".join(f"SELECT '{t}' AS label, count(*) n FROM {t}" for t in ("firm", "fund", "company", "holds", "supplies_to", "exposed_to", "covers", "mentions")),
    "cross_firm_leak_check": f"WITH {FIRM_EDGES}, every AS (SELECT * FROM fe UNION ALL SELECT 'HOLDS', CAST(fund AS VARCHAR), CAST(company AS VARCHAR) FROM holds) SELECT * FROM every WHERE rel = 'HOLDS' AND src NOT IN (SELECT CAST(fund AS VARCHAR) FROM own)",
    "delete_firm": f"SELECT fund, count(*) n FROM holds WHERE fund NOT IN (SELECT fund FROM managed_by WHERE firm = {FIRM}) GROUP BY fund",
    "fact_diff_join": f"WITH {FACTS} SELECT * FROM diff",
    "diff_counts": f"WITH {FACTS} SELECT change, count(*) n FROM diff GROUP BY change",
    "facts_added": f"WITH {FACTS} SELECT custkey, priority FROM diff WHERE change = 'added'",
    "facts_removed": f"WITH {FACTS} SELECT custkey, priority FROM diff WHERE change = 'removed'",
    "facts_changed": f"WITH {FACTS} SELECT custkey, priority, old_value, new_value FROM diff WHERE change = 'changed'",
    "trigger_match": f"WITH {CHANGES} SELECT * FROM matched",
    "propagate": f"WITH {REACHED} SELECT * FROM reached",
    "impact_rollup": f"WITH {REACHED} SELECT target_kind, target, count(DISTINCT via) n_via, count(DISTINCT held) n_held, string_agg(DISTINCT rule, ',' ORDER BY rule) rules FROM reached GROUP BY ALL",
    "apply_flags": f"WITH {REACHED} SELECT section_key, section_key IN (SELECT target FROM reached WHERE target_kind = 'section') AS stale FROM covers",
    "steward_review": f"WITH {TRIPLES} SELECT * FROM decided",
    "facts_accepted": f"WITH {TRIPLES} SELECT decision, reason, count(*) n FROM decided GROUP BY ALL",
    "upsert_edges": f"WITH {TRIPLES}, fine AS (SELECT t.* FROM decided d JOIN triples t USING (ord, subject, rel, object) WHERE decision <> 'reject'), more AS (SELECT subject, rel, object, count(DISTINCT doc_id) d, count(*) c, arg_max(confidence, ord) AS last FROM fine GROUP BY ALL) SELECT subject, rel, object, CAST(coalesce(corroboration, 0) + coalesce(c, 0) AS BIGINT) AS corroboration, round(coalesce(last, 1.0), 4) AS confidence, coalesce(d, 0) + CASE WHEN corroboration IS NULL THEN 0 ELSE 1 END AS n_docs FROM existing FULL JOIN more USING (subject, rel, object)",
    "resolve_mentions": f"WITH {RESOLVED} SELECT * FROM resolved",
    "canonical_names": f"WITH {RESOLVED} SELECT coalesce(cik, 'norm:' || {NORM.format('mention')}) AS key, arg_min(mention, (length(mention), mention)) canonical, count(DISTINCT mention) n_mentions FROM resolved GROUP BY 1",
    "survive_trust": f"WITH {RECORDS} SELECT * FROM trusted",
    "survive_system_of_record": f"WITH {RECORDS} SELECT cluster, attribute, value, record_id, system FROM full_ QUALIFY row_number() OVER (PARTITION BY cluster, attribute ORDER BY (system = 'pms') DESC, trust DESC, record_id) = 1",
    "survive_most_complete": rf"WITH {RECORDS} SELECT cluster, attribute, value, record_id, system FROM full_ QUALIFY row_number() OVER (PARTITION BY cluster, attribute ORDER BY length(value) + CASE WHEN attribute = 'address' AND regexp_matches(value, '[A-Z]{{1,2}}\d[A-Z\d]?\s*\d[A-Z]{{2}}') THEN 100 ELSE 0 END DESC, trust DESC, record_id) = 1",
    "survive_crosswalk": f"WITH {RECORDS}, best AS (SELECT cluster, attribute, value, record_id, system FROM full_ WHERE attribute = 'id' QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY (system = 'loan') DESC, trust DESC, record_id) = 1) SELECT *, coalesce((SELECT string_agg(DISTINCT value, ',' ORDER BY value) FROM full_ f WHERE f.attribute = 'id' AND f.cluster = best.cluster AND f.value <> best.value), '') AS alternates FROM best",
    "survive_numeric_tolerance": f"WITH {RECORDS}, num AS (SELECT *, TRY_CAST(replace(regexp_extract(value, '-?\\d[\\d,]*(\\.\\d+)?'), ',', '') AS DOUBLE) x FROM records WHERE attribute IN ('area', 'class')), n2 AS (SELECT * FROM num WHERE x IS NOT NULL), sp AS (SELECT cluster, attribute, 100 * ((max(x) - min(x)) / greatest(abs(min(x)), 1)) <= 50000 AS agree FROM n2 GROUP BY ALL) SELECT cluster, attribute, value, record_id, system, agree FROM n2 JOIN sp USING (cluster, attribute) QUALIFY row_number() OVER (PARTITION BY cluster, attribute ORDER BY (system = 'pms') DESC, trust DESC, record_id) = 1 UNION ALL SELECT cluster, attribute, value, record_id, system, NULL FROM trusted t WHERE attribute IN ('area', 'class') AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.cluster = t.cluster AND sp.attribute = t.attribute)",
    "golden_record": f"WITH {RECORDS}, best AS (SELECT cluster, value FROM full_ WHERE attribute = 'id' QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY (system = 'loan') DESC, trust DESC, record_id) = 1), alts AS (SELECT f.cluster, string_agg(DISTINCT f.value, ',' ORDER BY f.value) AS a FROM full_ f JOIN best USING (cluster) WHERE f.attribute = 'id' AND f.value <> best.value GROUP BY f.cluster) SELECT cluster, coalesce(max(value) FILTER (attribute = 'id'), CAST(cluster AS VARCHAR)) AS pk, string_agg(attribute || '=' || value, ';' ORDER BY attribute || '=' || value) golden, count(DISTINCT record_id) n_sources, string_agg(attribute || '=' || system, ';' ORDER BY attribute || '=' || system) AS rationale, coalesce(max(a), '') AS alternates FROM trusted LEFT JOIN alts USING (cluster) GROUP BY cluster",
    "lineage": f"WITH {RECORDS} SELECT cluster, attribute, record_id, system FROM trusted",
    "master_entities": f"WITH {RECORDS} SELECT cluster, count(DISTINCT system) n_systems, count(DISTINCT record_id) n_records FROM records GROUP BY cluster",
    "key_uniqueness": "SELECT l_orderkey, l_linenumber, count(*) n FROM lineitem GROUP BY ALL HAVING n > 1",
    "vocabulary_check": "SELECT criticality, count(*) n FROM supplies_to WHERE criticality NOT IN ('critical', 'named', 'mentioned') GROUP BY 1",
    "provenance_completeness": "SELECT count(*) n, count(*) FILTER (sensitivity IS NULL) no_sensitivity, count(*) FILTER (filing_date IS NULL) no_date FROM document",
    "embedding_check": "SELECT len(embedding) AS dim, count(*) n FROM embeddings GROUP BY 1",
    "domain_range_check": f"WITH {TRIPLES} SELECT rel, reason, count(*) n FROM decided WHERE reason IN ('bad domain', 'bad range') GROUP BY ALL",
    "text_functions": rf"""SELECT doc_id, substr(regexp_replace(regexp_replace(lower({DOC_TEXT}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 64) AS slug, 'doc_' || substr(sha256({DOC_TEXT}), 1, 10) AS hash_id, {FORM_CASE} AS doc_type,
        CASE WHEN {INTERNAL_CASE} THEN 'internal' ELSE 'public' END AS sensitivity,
        len(lines) >= 2 AND len(list_filter(lines, lambda x: regexp_matches(x, '\|.*\||\t.*\t'))) >= greatest(2, len(lines) // 2) AS is_table,
        regexp_matches(lines[1], '{tf.HEADING}') AND length(lines[1]) < 120 AS is_heading, greatest(1, length({DOC_TEXT}) // 4) AS tokens, CAST(greatest(1, round_even(length({DOC_TEXT}) / 3000, 0)) AS BIGINT) AS pages,
        md5(CASE WHEN length(flat) > 240 THEN substr(flat, 1, 239) || '…' ELSE flat END) AS snippet_md5, CASE WHEN {DOC_TEXT} = '' THEN 0 WHEN {ANY(tf.SEVERE)} THEN 3 WHEN {ANY(tf.MODERATE)} THEN 2 ELSE 1 END AS band
        FROM (SELECT *, trim(regexp_replace({DOC_TEXT}, '\s+', ' ', 'g')) AS flat, string_split(regexp_replace({DOC_TEXT}, '^\s+|\s+$', '', 'g'), chr(10)) AS lines FROM documents)""",
    "strip_html": rf"""WITH s AS (SELECT page_id, html, {STRIPPED} AS t FROM pages),
        c AS (SELECT page_id, html, array_to_string(list_filter(list_transform(regexp_split_to_array(replace(regexp_replace(t, '\r\n?', chr(10), 'g'), chr(160), ' '), '\n[ \t]*\n'), lambda p: {WS}), lambda p: p <> ''), chr(10) || chr(10)) AS text FROM s)
        SELECT page_id, regexp_matches(lower(substr(html, 1, 2048)), '<html|<!doctype html|<body|<div') AS is_html, length(text) AS n_chars, md5(text) AS text_md5 FROM c""",
    "hash_embed": """WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS token FROM documents), n AS (SELECT doc_id, sha256(token) AS h, count(*) AS n FROM tok GROUP BY doc_id, token),
        p AS (SELECT doc_id, n, CAST('0x' || substr(h, k * 4 + 1, 2) AS INT) AS f, CAST('0x' || substr(h, k * 4 + 3, 2) AS INT) AS s FROM n, range(16) t(k)), v AS (SELECT doc_id, (f * 256 + s) % 384 AS bucket, sum(CASE WHEN f % 2 = 0 THEN n ELSE -n END) AS v FROM p GROUP BY 1, 2)
        SELECT doc_id, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM v WHERE v <> 0""",
    "detect_mentions": r"""WITH item AS (SELECT item_id, lower(text) AS t FROM benchmark),
        said AS (SELECT item_id, unnest(list_concat(regexp_extract_all(t, '[\p{L}\p{N}]+'), [regexp_extract(t, '^([^.]*[\p{L}\p{N}])\.', 1), regexp_extract(t, '(?s)^(.{40}[\p{L}\p{N}]*)', 1)])) AS alias FROM item),
        vocab AS (SELECT alias, min(item_id) AS canonical FROM said WHERE length(alias) >= 3 AND regexp_matches(alias, '[\p{L}\p{N}]$') GROUP BY alias),
        doc AS (SELECT doc_id, lower(text) AS t, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS w FROM documents),
        part AS (SELECT doc_id, i, word, sum(length(word)) OVER (PARTITION BY doc_id ORDER BY i) - length(word) AS pos FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM doc)),
        words AS (SELECT doc_id, alias, canonical, min(pos) AS pos FROM part JOIN vocab ON word = alias GROUP BY ALL),
        spans AS (SELECT doc_id, alias, canonical, w, regexp_extract_all(alias, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS v FROM doc JOIN (SELECT * FROM vocab WHERE NOT regexp_full_match(alias, '[\p{L}\p{N}_]+')) ON contains(t, alias)),
        found AS (SELECT s.doc_id, alias, canonical, min(pos) AS pos FROM spans s JOIN part p ON p.doc_id = s.doc_id AND p.word = v[1] WHERE array_to_string(w[i : i + len(v) - 1], '') = alias GROUP BY ALL)
        SELECT doc_id, canonical, CAST(pos AS BIGINT) AS first_pos FROM (SELECT * FROM words UNION ALL SELECT * FROM found) QUALIFY row_number() OVER (PARTITION BY doc_id, canonical ORDER BY length(alias) DESC, alias, pos) = 1""",
    "vector_top_k": "WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(e, CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings WHERE query_id <> vec_id) SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, round(score, 4) AS score FROM s QUALIFY rank <= 5",
    "job_event_log": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) n, round(CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE), 4) AS total FROM events GROUP BY ALL",
}

QUERIES = {name: (lambda spark, sf_dir, build=build: build(Graph(spark, sf_dir))) for name, build in BUILD.items()}
ORACLE_SQL = {name: sql(body) for name, body in SQL.items()}
