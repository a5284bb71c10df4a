"""Closures, sections, budgets, registries and rollups over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.graphmodel import Graph, sql
from fundloom.operators import mdm, risk, rules, sets, steward, textjobs
from fundloom.plans.graph_queries import NORM

HEADING = r"^[^ ]{1,30}\.$"
#: What is no part of a word, in any script: the word boundaries of Java and RE2 differ beyond ASCII.
EDGE = r"[^\p{L}\p{M}\p{N}_]"
INTENTS = [(name, rf"(^|{EDGE})({words})($|{EDGE})") for name, words in (("english", "the"), ("german", "der|die|das"), ("french", "le|la|les"), ("spanish", "el|los|que"))]


def tree(g: Graph) -> DataFrame:
    """A class tree over the issuers: each under a third of its number."""
    return g.company.where("company > 0").select(F.col("company").alias("child"), F.floor(F.col("company") / 3).alias("parent"))


def axioms(g: Graph, said: str, names: str) -> DataFrame:
    return g.spark.createDataFrame([tuple(x.split()) for x in said.split(", ")], ", ".join(f"{n} string" for n in names.split()))


def inferred(g: Graph) -> DataFrame:
    """Holdings, managers and the tree of issuers as facts, with a parent property, two inverses and a transitive property."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    facts = g.holds.select(name("f", "fund").alias("s"), F.lit("HOLDS").alias("p"), name("c", "company").alias("o"))
    facts = facts.unionByName(g.managed_by.select(name("m", "firm").alias("s"), F.lit("MANAGES").alias("p"), name("f", "fund").alias("o")))
    facts = facts.unionByName(tree(g).select(name("c", "child").alias("s"), F.lit("PART_OF").alias("p"), name("c", "parent").alias("o")))
    return rules.inferred_facts(facts, axioms(g, "MANAGES CONTROLS, HOLDS RELATED, CONTROLS RELATED", "child parent"), axioms(g, "HOLDS HELD_BY, PART_OF HAS_PART", "p q"), axioms(g, "PART_OF", "p"))


INFERRED = f"""{{TREE}}, fact AS (SELECT 'f' || fund AS s, 'HOLDS' AS p, 'c' || company AS o FROM holds UNION ALL SELECT 'm' || firm, 'MANAGES', 'f' || fund FROM managed_by UNION ALL SELECT 'c' || child, 'PART_OF', 'c' || ancestor FROM up),
inferred AS (SELECT * FROM fact UNION SELECT s, 'RELATED', o FROM fact WHERE p IN ('HOLDS', 'MANAGES') UNION SELECT s, 'CONTROLS', o FROM fact WHERE p = 'MANAGES' UNION SELECT o, 'HELD_BY', s FROM fact WHERE p = 'HOLDS' UNION SELECT o, 'HAS_PART', s FROM fact WHERE p = 'PART_OF')"""


def scored(g: Graph) -> DataFrame:
    """Critical supplies as pairs of records, scored by their numbers."""
    return g.supplies_to.where("criticality = 'critical'").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("score", F.pmod(F.col("a") * 13 + F.col("b") * 29, F.lit(100)) / 100)


def roles(g: Graph) -> DataFrame:
    """Customers at the issuers that their orders begin with."""
    who = g.table("orders").select("o_orderkey", F.col("o_custkey").alias("person"))
    role = F.when(F.col("priority") < "2", "OFFICER_OF").when(F.col("priority") < "4", "DIRECTOR_OF").otherwise("FORMERLY_AT")
    return g.supply_lines.join(who, F.col("doc_id") == F.col("o_orderkey")).select("person", F.col("src").alias("company"), role.alias("role")).distinct()


ROLES = "roles AS (SELECT DISTINCT o_custkey AS person, src AS company, CASE WHEN priority < '2' THEN 'OFFICER_OF' WHEN priority < '4' THEN 'DIRECTOR_OF' ELSE 'FORMERLY_AT' END AS role FROM supply_lines JOIN orders ON doc_id = o_orderkey)"


def old_and_new(g: Graph) -> tuple[DataFrame, DataFrame]:
    c = g.table("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return c.where("key % 2 = 0"), c.where("key % 3 = 0").select("key", F.when(F.col("key") % 5 == 0, None).otherwise(F.concat(F.lit("new "), "name")).alias("name"), (F.col("balance") + 1).alias("balance"))


def budget_lists(g: Graph) -> tuple[DataFrame, DataFrame]:
    held = risk.firm_top_holdings(g.holds, g.managed_by).select("firm", F.concat(F.lit("c"), F.col("company").cast("string")).alias("key"), F.col("rank").cast("double").alias("ord"))
    funds = g.managed_by.select("firm", F.concat(F.lit("f"), F.col("fund").cast("string")).alias("key"), F.col("fund").cast("double").alias("ord"))
    return held, funds


def candidates(g: Graph) -> DataFrame:
    """Customers as candidates for their nation; names repeat, and some share a cik."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    name = F.concat(F.lit("Cand "), (k % 90).cast("string"))
    return g.table("customer").select(F.col("c_nationkey").alias("query"), k.alias("ord"), name.alias("name"), F.when(k % 4 == 0, F.concat(F.lit("0"), (k % 60).cast("string"))).otherwise(none).alias("cik"), F.when(k % 7 == 0, F.concat(F.lit("L"), k.cast("string"))).otherwise(none).alias("lei"), F.array(F.concat(F.lit("S"), (k % 5).cast("string"))).alias("series"), F.when(k % 3 == 0, "fund_family").otherwise("company").alias("kind"), F.col("c_acctbal").alias("score"))


def citations(g: Graph) -> DataFrame:
    """What each line cites; some lines name a document alone."""
    return g.table("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linestatus") == "O", F.concat(F.col("l_orderkey").cast("string"), F.lit("_c"), F.col("l_linenumber").cast("string"))).alias("chunk_id"), F.when(F.col("l_returnflag") == "R", F.col("l_partkey").cast("string")).alias("span"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("ord"))


BUILD = {
    "class_closure": lambda g: sets.closure(tree(g)),
    "inferred_facts": lambda g: inferred(g),
    "inferred_types": lambda g: rules.inferred_types(g.holds.where("fund < 3").select(F.concat(F.lit("f"), F.col("fund").cast("string")).alias("instance"), F.lit("MutualFund").alias("cls")), inferred(g), axioms(g, "Fund Vehicle, MutualFund Fund, Vehicle Thing, Firm Thing", "child parent"), axioms(g, "Company Issuer", "a b"), axioms(g, "HOLDS Fund, MANAGES Firm", "p cls"), axioms(g, "HOLDS Company", "p cls")),
    "match_clusters": lambda g: mdm.match_clusters(g.company.select(F.col("company").alias("record_id")), scored(g)),
    "disjoint_violations": lambda g: sets.disjoint_violations(g.holds.select(F.col("fund").alias("instance"), F.col("company").alias("cls")), sets.closure(tree(g)), g.spark.createDataFrame([(3, 8), (13, 2), (20, 21)], "a long, b long")),
    "board_links": lambda g: sets.board_links(roles(g), g.company),
    "section_slice": lambda g: sets.section_slice(g.table("documents"), HEADING),
    "budgeted_filings": lambda g: sets.budgeted(*budget_lists(g), 8),
    "llm_usage_rollup": lambda g: sets.usage_rollup(g.table("events"), g.spark.createDataFrame([("click", 0.5), ("view", 0.25)], "event_type string, price double")),
    "tag_intent": lambda g: g.table("conversations").where("role = 'user'").select("conv_id", "turn", sets.tag_intent(F.coalesce("text", F.lit("")), INTENTS).alias("intent")),
    "dedup_citations": lambda g: sets.dedup_citations(citations(g)),
    "sync_absent": lambda g: sets.absent(g.company.select(F.col("company").alias("firm"), "name"), g.company.where("company % 3 = 0").select("company", F.concat(F.lit("Part#"), F.lpad((F.col("company") + 1).cast("string"), 9, "0")).alias("name")).withColumnRenamed("company", "firm")).select("firm", "name"),
    "rank_candidates": lambda g: sets.rank_candidates(candidates(g)).withColumn("series", F.array_join("series", ",")),
    "event_seq": lambda g: sets.event_seq(g.table("events")).select("event_id", "user_id", "seq"),
    "upsert_nodes": lambda g: steward.upsert_nodes(*old_and_new(g), "key"),
    "embedding_candidates": lambda g: textjobs.embedding_candidates(g.table("embeddings"), g.table("embeddings").where("vec_id % 100 = 0"), 0.25),
    "normalization": lambda g: g.table("supplier").select("s_suppkey", steward.normalize_name(F.concat(F.lit("The "), "s_name", F.lit(" Holdings, Inc."))).alias("norm"), steward.pad_cik(F.col("s_suppkey") + 5).alias("cik"), steward.fact_id(F.col("s_suppkey").cast("string"), F.col("s_name")).alias("fact_id")),
    "fund_families": lambda g: g.fund.join(g.managed_by, "fund").groupBy("firm").agg(F.min_by("name", "fund").alias("family"), F.count("*").alias("n_series"), F.array_join(F.transform(F.array_sort(F.collect_list("fund")), lambda x: x.cast("string")), "|").alias("series")),
}

TREE = "up AS (SELECT company AS child, company // 3 AS ancestor FROM company WHERE company > 0 UNION SELECT u.child, u.ancestor // 3 FROM up u WHERE u.ancestor > 0)"
INFERRED = INFERRED.replace("{TREE}", TREE)
SCORED = "scored AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, (least(src, dst) * 13 + greatest(src, dst) * 29) % 100 / 100 AS score FROM supplies_to WHERE criticality = 'critical')"
SQL = {
    "inferred_facts": f"WITH {INFERRED} SELECT * FROM inferred",
    "inferred_types": f"""WITH {INFERRED}, own AS (SELECT 'f' || fund AS instance, 'MutualFund' AS cls FROM fund WHERE fund IN (SELECT fund FROM holds WHERE fund < 3) UNION SELECT s, 'Fund' FROM inferred WHERE p = 'HOLDS' UNION SELECT s, 'Firm' FROM inferred WHERE p = 'MANAGES' UNION SELECT o, 'Company' FROM inferred WHERE p = 'HOLDS'),
        above AS (SELECT * FROM (VALUES ('MutualFund', 'Fund'), ('MutualFund', 'Vehicle'), ('MutualFund', 'Thing'), ('Fund', 'Vehicle'), ('Fund', 'Thing'), ('Firm', 'Thing'), ('Company', 'Issuer')) v(child, ancestor))
        SELECT * FROM own UNION SELECT instance, ancestor FROM own JOIN above ON cls = child""",
    "match_clusters": f"""WITH {SCORED}, link AS (SELECT a AS u, b AS v FROM scored WHERE score >= 0.88 UNION SELECT b, a FROM scored WHERE score >= 0.88), reach AS (SELECT u AS node, u AS m FROM link UNION SELECT l.v, r.m FROM reach r JOIN link l ON l.u = r.node WHERE r.m < l.v),
        lab AS (SELECT node, min(m) AS label FROM reach GROUP BY node), mean AS (SELECT x.label AS l, round(CAST(sum(CAST(score AS DECIMAL(28,10))) AS DOUBLE) / count(*), 6) AS mean FROM scored JOIN lab x ON x.node = a JOIN lab y ON y.node = b AND x.label = y.label GROUP BY 1), size AS (SELECT label AS l, count(*) AS n FROM lab GROUP BY 1)
        SELECT company AS record_id, coalesce(label, company) AS match_id, coalesce(n, 1) AS n_matched, coalesce(mean, 1.0) AS confidence FROM company LEFT JOIN lab ON node = company LEFT JOIN size s ON s.l = label LEFT JOIN mean m ON m.l = label""",
    "class_closure": f"WITH {TREE} SELECT * FROM up",
    "disjoint_violations": f"WITH {TREE}, t AS (SELECT DISTINCT fund AS instance, company AS c FROM holds UNION SELECT fund, ancestor FROM holds JOIN up ON company = child), d AS (SELECT * FROM (VALUES (3, 8), (2, 13), (20, 21)) v(a, b)) SELECT DISTINCT x.instance, CAST(a AS BIGINT) a, CAST(b AS BIGINT) b FROM t x JOIN d ON x.c = a JOIN t y ON y.instance = x.instance AND y.c = b",
    "board_links": f"WITH {ROLES} SELECT DISTINCT r.company, r.person, r.role, o.company AS other, o.role AS other_role FROM roles r LEFT JOIN roles o ON o.person = r.person AND o.company <> r.company WHERE r.role <> 'FORMERLY_AT'",
    "section_slice": rf"WITH l AS (SELECT doc_id, unnest(s) AS said, generate_subscripts(s, 1) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)), m AS (SELECT *, regexp_matches(said, '{HEADING}') AS h FROM l), n AS (SELECT *, sum(CAST(h AS INT)) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM m) SELECT doc_id, CAST(section AS BIGINT) AS section, max(said) FILTER (h) AS heading, count(*) n_lines, CAST(sum(length(said)) AS BIGINT) n_chars FROM n GROUP BY doc_id, section",
    "budgeted_filings": "WITH w AS (SELECT firm, company, round(CAST(sum(CAST(weight_pct AS DECIMAL(28,6))) AS DOUBLE), 6) AS w FROM holds JOIN managed_by USING (fund) GROUP BY ALL), t AS (SELECT firm, company, row_number() OVER (PARTITION BY firm ORDER BY w DESC, company) AS r FROM w QUALIFY r <= 5), b AS (SELECT firm, 'holding' AS kind, 'c' || company AS key, CAST(r AS DOUBLE) AS ord, 0 AS p FROM t UNION ALL SELECT firm, 'fund', 'f' || fund, CAST(fund AS DOUBLE), 1 FROM managed_by) SELECT firm, kind, key, row_number() OVER (PARTITION BY firm ORDER BY p, ord, key) AS rank FROM b QUALIFY rank <= 8",
    "llm_usage_rollup": "WITH s AS (SELECT event_type, count(*) n_calls, sum(CAST(value AS DECIMAL(28,6))) t FROM events GROUP BY 1) SELECT event_type, n_calls, CAST(round(t, 4) AS DOUBLE) AS tokens, CAST(round(t * CAST(CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.25 ELSE 0 END AS DECIMAL(6,3)), 4) AS DOUBLE) AS cost FROM s",
    "tag_intent": "SELECT conv_id, turn, CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(text, '')), '{p}') THEN '{n}'" for n, p in INTENTS) + " ELSE 'open' END AS intent FROM conversations WHERE role = 'user'",
    "dedup_citations": "SELECT l_orderkey AS doc_id, CASE WHEN l_linestatus = 'O' THEN l_orderkey || '_c' || l_linenumber END AS chunk_id, CASE WHEN l_returnflag = 'R' THEN CAST(l_partkey AS VARCHAR) END AS span, min(l_orderkey * 1000 + l_linenumber) AS ord FROM lineitem GROUP BY ALL",
    "sync_absent": "WITH r AS (SELECT company AS firm, 'Part#' || lpad(CAST(company + 1 AS VARCHAR), 9, '0') AS name FROM company WHERE company % 3 = 0) SELECT company AS firm, name FROM company WHERE company NOT IN (SELECT firm FROM r) AND name NOT IN (SELECT name FROM r)",
    "rank_candidates": """WITH c AS (SELECT c_nationkey AS query, c_custkey AS ord, 'Cand ' || (c_custkey % 90) AS name, CASE WHEN c_custkey % 4 = 0 THEN '0' || (c_custkey % 60) END AS cik, CASE WHEN c_custkey % 7 = 0 THEN 'L' || c_custkey END AS lei, 'S' || (c_custkey % 5) AS ser, CASE WHEN c_custkey % 3 = 0 THEN 'fund_family' ELSE 'company' END AS kind, c_acctbal AS score FROM customer),
        m AS (SELECT query, coalesce('cik:' || cik, 'name:' || lower(name)) AS key, arg_min(name, ord) AS name, arg_min(cik, ord) FILTER (cik IS NOT NULL) AS cik, arg_min(lei, ord) FILTER (lei IS NOT NULL) AS lei, string_agg(DISTINCT ser, ',' ORDER BY ser) AS series, CASE WHEN bool_or(kind = 'fund_family') THEN 'fund_family' ELSE 'company' END AS kind, max(score) AS score, count(*) n_merged FROM c GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, name, key) AS rank FROM m QUALIFY rank <= 8""",
    "event_seq": "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events",
    "upsert_nodes": "WITH o AS (SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 5 <> 0 THEN 'new ' || c_name END AS name, c_acctbal + 1 AS balance FROM customer WHERE c_custkey % 3 = 0) SELECT key, coalesce(n.name, o.name) AS name, coalesce(n.balance, o.balance) AS balance FROM o FULL JOIN n USING (key)",
    "embedding_candidates": "WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(e, CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings WHERE query_id <> vec_id) SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, round(score, 4) AS score FROM s WHERE score >= 0.25 QUALIFY rank <= 5",
    "normalization": f"SELECT s_suppkey, {NORM.format('''('The ' || s_name || ' Holdings, Inc.')''')} AS norm, lpad(CAST(s_suppkey + 5 AS VARCHAR), 10, '0') AS cik, substr(sha256(s_suppkey || '|' || s_name), 1, 16) AS fact_id FROM supplier",
    "fund_families": "SELECT firm, arg_min(name, fund) AS family, count(*) n_series, string_agg(CAST(fund AS VARCHAR), '|' ORDER BY fund) series FROM fund JOIN managed_by USING (fund) GROUP BY firm",
}

QUERIES = {name: (lambda spark, sf_dir, build=build: build(Graph(spark, sf_dir))) for name, build in BUILD.items()}
ORACLE_SQL = {name: sql(body) for name, body in SQL.items()}
