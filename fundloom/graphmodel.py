"""The knowledge-graph tables, and how the star-schema test tables map to them.

A fund is a nation, its firm a region, an issuer a part. A holding is what a nation's customers sent back; a supply edge joins the
parts of an order's first and last line (dependent -> supplier), and a company is exposed to the brands of its suppliers. Filings
are orders, and mention the parts of their open lines. All rows of the tables take part.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.sources.tables import written

#: Risk categories in their order, criticalities and their weights.
CATEGORIES = ["supply_chain", "customer_concentration", "regulatory", "geopolitical", "technology", "litigation", "other"]
CRITICALITY = {"critical": 1.0, "named": 0.5, "mentioned": 0.2}
#: What an exposure says, by the urgency of the order.
HEDGES = {"1": "We are highly dependent on a limited number of suppliers", "2": "A substantial share", "3": "We rely on others", "5": "Events may occur"}


def exact(c: str | Column) -> Column:
    """For sums that do not depend on their order."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(28,6)")


@dataclass
class Graph:
    """Lazy tables of one data folder."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def kept(self, name: str, *columns: str) -> Graph:
        """The graph with columns of one table written, for queries that take them several times."""
        out = Graph(self.spark, self.sf_dir)
        setattr(out, name, written(getattr(self, name).select(*columns), name.replace("_", "-")))
        return out

    @cached_property
    def firm(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").cast("long").alias("firm"), F.col("r_name").alias("name"))

    @cached_property
    def fund(self) -> DataFrame:
        key = F.col("n_nationkey").cast("long")
        return self.table("nation").select(key.alias("fund"), F.col("n_name").alias("name"), key.cast("string").alias("series_id"))

    @cached_property
    def managed_by(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").cast("long").alias("fund"), F.col("n_regionkey").cast("long").alias("firm"))

    @cached_property
    def company(self) -> DataFrame:
        name = F.concat(F.lit("Part#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
        return self.table("part").select(F.col("p_partkey").alias("company"), name.alias("name"), F.col("p_size").cast("long").alias("country"), F.col("p_retailprice").alias("balance"))

    @cached_property
    def orders(self) -> DataFrame:
        """Orders with their fund."""
        nation = self.table("customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("fund"))
        return self.table("orders").join(nation, F.col("o_custkey") == F.col("c_custkey"))

    @cached_property
    def holds(self) -> DataFrame:
        lines = self.table("lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate", "l_quantity")
        held = (
            lines.join(self.orders.select("o_orderkey", "fund"), F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("fund", F.col("l_partkey").alias("company"))
            .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("value_usd"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("shares"), F.max(F.col("l_shipdate").cast("date")).alias("as_of"))
        )
        total = held.groupBy("fund").agg(F.sum(F.col("value_usd").cast("decimal(28,2)")).cast("double").alias("total"))
        return held.join(total, "fund").select("fund", "company", "value_usd", "shares", "as_of", F.round(100 * F.col("value_usd") / F.col("total"), 6).alias("weight_pct"))

    @cached_property
    def supply_lines(self) -> DataFrame:
        """doc_id, src, dst, component, risk_title, priority, filed: one row for each order of two different parts."""
        place = F.struct("l_linenumber", "l_suppkey", "l_partkey")
        ends = self.table("lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.min_by("l_partkey", place).alias("src"), F.max_by("l_partkey", place).alias("dst")).where("src <> dst")
        made = self.table("part").select(F.col("p_partkey").alias("p"), F.col("p_type").alias("component"), F.col("p_brand").alias("risk_title"))
        dated = self.table("orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("date").alias("filed"))
        return ends.join(made, F.col("dst") == F.col("p")).join(dated, F.col("doc_id") == F.col("o_orderkey")).drop("p", "o_orderkey")

    @cached_property
    def supplies_to(self) -> DataFrame:
        edges = self.supply_lines.groupBy("src", "dst").agg(F.min("component").alias("component"))
        kind = F.pmod(F.col("src") * 7 + F.col("dst") * 3, F.lit(4))
        return edges.withColumn("criticality", F.when(kind == 0, "critical").when(kind == 1, "named").when(kind == 2, "mentioned").otherwise("rumoured"))

    @cached_property
    def risk_factor(self) -> DataFrame:
        n = F.regexp_extract("title", r"(\d+)", 1).cast("int")
        titles = self.table("part").select(F.col("p_brand").alias("title")).distinct()
        return titles.withColumn("category", F.element_at(F.array(*map(F.lit, CATEGORIES)), F.pmod(n, F.lit(len(CATEGORIES))) + 1))

    @cached_property
    def exposed_to(self) -> DataFrame:
        found = self.supply_lines.groupBy(F.col("src").alias("company"), "risk_title").agg(F.min(F.substr("priority", F.lit(1), F.lit(1))).alias("p"))
        said = F.lit("")
        for p, text in HEDGES.items():
            said = F.when(F.col("p") == p, F.lit(text)).otherwise(said)
        return found.select("company", "risk_title", said.alias("severity"))

    @cached_property
    def covers(self) -> DataFrame:
        """Disclosure sections: fund, form_ref, section_key, risk_title. Sections are about brands (none about every fifth) and types."""
        brand = self.risk_factor.select(F.col("title").alias("risk_title"), F.regexp_extract("title", r"(\d+)", 1).cast("long").alias("n")).where("n % 5 <> 0")
        kind = self.table("part").select(F.col("p_type").alias("risk_title"), F.char_length("p_type").cast("long").alias("n")).distinct()
        topics = brand.unionByName(kind).withColumn("k", F.pmod(-F.col("n"), F.lit(3)))
        pairs = self.fund.select("fund", "series_id", F.pmod("fund", F.lit(3)).alias("k")).join(topics, "k")
        form = F.concat("series_id", F.lit(":485"))
        return pairs.select("fund", form.alias("form_ref"), F.concat(form, F.lit("|"), "risk_title").alias("section_key"), "risk_title")

    @cached_property
    def document(self) -> DataFrame:
        """Filings: orders."""
        return self.table("orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").cast("date").alias("filing_date"), F.when(F.col("o_orderpriority").startswith("1"), "internal").when(F.col("o_orderpriority").startswith("5"), None).otherwise("public").alias("sensitivity"))

    @cached_property
    def mentions(self) -> DataFrame:
        return self.table("lineitem").where("l_linestatus = 'O' and l_returnflag = 'N'").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("company")).distinct()


#: The same tables for DuckDB.
SQL = r"""
firm AS (SELECT CAST(r_regionkey AS BIGINT) firm, r_name AS name FROM region),
fund AS (SELECT CAST(n_nationkey AS BIGINT) fund, n_name AS name, CAST(n_nationkey AS VARCHAR) series_id FROM nation),
managed_by AS (SELECT CAST(n_nationkey AS BIGINT) fund, CAST(n_regionkey AS BIGINT) firm FROM nation),
company AS (SELECT p_partkey AS company, 'Part#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS name, CAST(p_size AS BIGINT) country, p_retailprice AS balance FROM part),
held AS (
    SELECT CAST(c_nationkey AS BIGINT) fund, l_partkey AS company, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) value_usd,
        CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) shares, max(CAST(l_shipdate AS DATE)) as_of
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    WHERE l_returnflag = 'R' GROUP BY ALL),
holds AS (SELECT *, round(100 * value_usd / CAST(sum(CAST(value_usd AS DECIMAL(28,2))) OVER (PARTITION BY fund) AS DOUBLE), 6) weight_pct FROM held),
ends AS (
    SELECT l_orderkey AS doc_id, arg_min(l_partkey, (l_linenumber, l_suppkey, l_partkey)) AS src, arg_max(l_partkey, (l_linenumber, l_suppkey, l_partkey)) AS dst
    FROM lineitem GROUP BY l_orderkey HAVING src <> dst),
supply_lines AS (
    SELECT doc_id, src, dst, p_type AS component, p_brand AS risk_title, o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS filed
    FROM ends JOIN part ON dst = p_partkey JOIN orders ON doc_id = o_orderkey),
supplies_to AS (
    SELECT src, dst, min(component) component, CASE (src * 7 + dst * 3) % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'named' WHEN 2 THEN 'mentioned' ELSE 'rumoured' END criticality
    FROM supply_lines GROUP BY src, dst),
risk_factor AS (
    SELECT DISTINCT p_brand AS title, (CATEGORY_LIST)[CAST(regexp_extract(p_brand, '(\d+)', 1) AS INT) % 7 + 1] category FROM part),
exposed_to AS (
    SELECT src AS company, risk_title, CASE substr(min(priority), 1, 1) HEDGE_CASE ELSE '' END AS severity FROM supply_lines GROUP BY src, risk_title),
topics AS (
    SELECT title AS risk_title, CAST(regexp_extract(title, '(\d+)', 1) AS BIGINT) n FROM risk_factor WHERE n % 5 <> 0
    UNION SELECT p_type, length(p_type) FROM part),
covers AS (
    SELECT fund, series_id || ':485' AS form_ref, series_id || ':485|' || risk_title AS section_key, risk_title FROM fund JOIN topics ON (fund + n) % 3 = 0),
document AS (
    SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) filing_date, CASE WHEN o_orderpriority LIKE '1%' THEN 'internal' WHEN o_orderpriority LIKE '5%' THEN NULL ELSE 'public' END sensitivity FROM orders),
mentions AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS company FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'N')
""".replace("CATEGORY_LIST", str(CATEGORIES)).replace("HEDGE_CASE", " ".join(f"WHEN '{p}' THEN '{text}'" for p, text in HEDGES.items()))


def sql(body: str) -> str:
    """``body`` over the graph tables; it may start with more CTEs."""
    body = body.strip()
    return f"WITH RECURSIVE {SQL}" + (f", {body[4:].lstrip()}" if body.startswith("WITH") else body)
