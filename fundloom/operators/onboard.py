"""Onboarding of firms and their filings: holdings, identifiers, budgets, the queue of unresolved names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fundloom.functions import ratios
from fundloom.functions.text import bounded_excerpt
from fundloom.operators import simjoin
from fundloom.operators.steward import first_wins, normalize_ticker
from fundloom.sources.tables import written

#: What a holding without a name says; states of the queue on screen; headings that excerpts start at.
NO_NAME = "N/A"
STATUS = {"provisional": "pending", "promoted": "kept_new"}
RISK_HEADINGS = ["item 1a", "risk factors"]
PRINCIPAL_HEADINGS = ["principal investment risks", "principal risks", "principal risk"]


def upsert_holds(funds: DataFrame, companies: DataFrame, holds: DataFrame, filing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """funds, companies and holds after filings: a fund's series and cik are overwritten and its lei kept where the filing has none, a
    company keeps the ticker and lei that it has, a holding is overwritten.

    funds: fund, series_id, cik, lei. companies: company, ticker, lei. holds: fund, company, weight_pct. filing: all of these for each position."""
    new = filing.groupBy("fund").agg(F.max("series_id").alias("s2"), F.max("cik").alias("c2"), F.max("fund_lei").alias("l2"))
    f = funds.join(new, "fund", "full_outer").select("fund", F.coalesce("s2", "series_id").alias("series_id"), F.coalesce("c2", "cik").alias("cik"), F.coalesce("l2", "lei").alias("lei"))
    new = filing.groupBy("company").agg(F.max("ticker").alias("t2"), F.max("lei").alias("l2"))
    c = companies.join(new, "company", "full_outer").select("company", F.coalesce("ticker", "t2").alias("ticker"), F.coalesce("lei", "l2").alias("lei"))
    new = filing.groupBy("fund", "company").agg(F.max("weight_pct").alias("w2"))
    h = holds.join(new, ["fund", "company"], "full_outer").select("fund", "company", F.coalesce("w2", "weight_pct").alias("weight_pct"))
    return f, c, h


def upsert_firm_and_managed_by(firms: DataFrame, managed_by: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Firms (firm, cik, lei) with ids filled from the new ones, and one edge for each fund. new: firm, fund, cik, lei."""
    ids = new.groupBy("firm").agg(F.max("cik").alias("c2"), F.max("lei").alias("l2"))
    f = firms.join(ids, "firm", "full_outer").select("firm", F.coalesce("c2", "cik").alias("cik"), F.coalesce("l2", "lei").alias("lei"))
    return f, managed_by.select("fund", "firm").union(new.select("fund", "firm")).distinct()


def top_holdings_filter(holds: DataFrame) -> DataFrame:
    return holds.where(F.col("name").isNotNull() & (F.upper(F.trim("name")) != NO_NAME) & (F.trim("name") != ""))


def latest_filing(filings: DataFrame) -> DataFrame:
    """The newest filing of each series (ties: the larger accession), never a sibling's."""
    return filings.groupBy("series_id").agg(F.max(F.struct("filing_date", "accession")).alias("x")).select("series_id", "x.filing_date", "x.accession")


def series_guard(filings: DataFrame) -> DataFrame:
    """Filings whose own text names no other series; text without a series id passes. filings: series_id, xml."""
    own = F.nullif(F.regexp_extract("xml", r"(?i)<\s*seriesId\s*>\s*(S\d+)\s*<", 1), F.lit(""))
    return filings.where(own.isNull() | (F.upper(own) == F.upper("series_id")))


def fund_universe(funds: DataFrame, managed_by: DataFrame, firm: int | None = None) -> DataFrame:
    """Funds of one firm, or all, by name."""
    own = funds if firm is None else funds.join(managed_by.where(F.col("firm") == firm).select("fund"), "fund", "left_semi")
    return own.orderBy("name", "fund")


def firm_order(firms: DataFrame) -> DataFrame:
    """The demo firm first, then active ones, then by name."""
    return firms.orderBy(F.desc("is_demo"), F.desc("is_active"), "name")


def spine_lookup_fund(asked: DataFrame, spine: DataFrame) -> DataFrame:
    """asked (series_id, ticker) with the fund's cik: by series, else by share-class ticker; the first spine row wins.

    spine: series_id, cik, tickers (array), ord."""
    by_series = first_wins(spine.where("series_id is not null"), ["series_id"], ["ord"]).select(F.col("series_id").alias("s"), F.col("cik").alias("cik_s"))
    classes = spine.select("cik", "ord", F.explode("tickers").alias("t0")).select("cik", "ord", normalize_ticker(F.col("t0")).alias("t")).where("t is not null")
    by_ticker = first_wins(classes, ["t"], ["ord"]).select("t", F.col("cik").alias("cik_t"))
    out = asked.withColumn("tk", normalize_ticker(F.col("ticker"))).hint("merge").join(by_series.hint("merge"), F.col("series_id") == F.col("s"), "left").join(by_ticker.hint("merge"), F.col("tk") == F.col("t"), "left")
    method = F.when(F.col("cik_s").isNotNull(), "series").when(F.col("cik_t").isNotNull(), "fund_ticker").otherwise("provisional")
    return out.select("series_id", "ticker", F.coalesce("cik_s", "cik_t").alias("cik"), method.alias("method"))


def canonical_existing(groups: DataFrame, companies: DataFrame) -> DataFrame:
    """key, canonical: a group's name is that of the company with its cik, else with its norm, else its own shortest mention.

    groups: key, cik, norm, canonical. companies: name, cik, norm."""
    by = lambda c: companies.where(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"k_{c}")).agg(F.min("name").alias(f"n_{c}"))
    out = groups.join(by("cik"), F.col("cik") == F.col("k_cik"), "left").join(by("norm"), F.col("norm") == F.col("k_norm"), "left")
    return out.select("key", F.coalesce("n_cik", "n_norm", "canonical").alias("canonical"))


def enrich_lei(resolved: DataFrame, leis: DataFrame) -> DataFrame:
    """Rows with the LEI of their legal name. leis: legal_name, lei."""
    one = leis.groupBy(F.lower(F.trim("legal_name")).alias("k")).agg(F.min("lei").alias("found"))
    return resolved.join(one, F.lower(F.trim("title")) == F.col("k"), "left").select(*[c for c in resolved.columns if c != "lei"], F.col("found").alias("lei"))


def existing_edges(edges: DataFrame, triples: DataFrame) -> DataFrame:
    """Current edges of the (subject, rel) that a batch is about."""
    return edges.join(triples.select("subject", "rel").distinct(), ["subject", "rel"], "left_semi")


def queue_apply(queue: DataFrame, actions: DataFrame) -> DataFrame:
    """The queue after the last action on each row: merge and promote pin what they name (nothing named keeps what was there) with
    confidence 1, reject only marks. queue: id, status, cik, confidence. actions: id, ord, action, cik."""
    last = actions.groupBy(F.col("id").alias("i2")).agg(F.max_by(F.struct("action", F.col("cik").alias("c2")), "ord").alias("x")).select("i2", "x.*")
    out = queue.join(last, F.col("id") == F.col("i2"), "left")
    pinned = F.coalesce(F.col("action").isin("merge", "promote"), F.lit(False))
    status = F.when(F.col("action") == "merge", "merged").when(F.col("action") == "promote", "promoted").when(F.col("action") == "reject", "rejected").otherwise(F.col("status"))
    return out.select("id", status.alias("status"), F.when(pinned, F.coalesce("c2", "cik")).otherwise(F.col("cik")).alias("cik"), F.when(pinned, 1.0).otherwise(F.col("confidence")).alias("confidence"))


def queue_by_status(queue: DataFrame, status: str | None = "provisional") -> DataFrame:
    return (queue if status is None else queue.where(F.col("status") == status)).orderBy("id")


def queue_projection(queue: DataFrame) -> DataFrame:
    """The queue as a screen shows it."""
    shown = F.coalesce(*[F.when(F.col("status") == k, F.lit(v)) for k, v in STATUS.items()], F.col("status"))
    return queue.select("id", shown.alias("status"), "cik", F.round("confidence", 2).alias("confidence"))


def enqueue_provisional(queue: DataFrame, resolved: DataFrame) -> DataFrame:
    """The queue with a row for each mention that was not resolved; numbers go on from the last. resolved: mention, ticker, method."""
    new = resolved.where("method = 'provisional'").select("mention", "ticker").distinct().withColumn("part", F.substr(F.md5("mention"), F.lit(1), F.lit(2)))
    # Numbers run through 256 parts, each ranked by itself after the sizes of those before it.
    sizes = new.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = queue.agg(F.coalesce(F.max("id"), F.lit(0)).alias("start"))
    offsets = sizes.select(F.col("part").alias("p2"), before.alias("before")).join(F.broadcast(start))  # one row with at most 256
    rank = F.row_number().over(Window.partitionBy("part").orderBy("mention", "ticker"))
    added = new.withColumn("r", rank).join(F.broadcast(offsets), F.col("part") == F.col("p2")).select((F.col("start") + F.col("before") + F.col("r")).cast("long").alias("id"), "mention", "ticker", F.lit("provisional").alias("status"))
    return queue.select("id", "mention", "ticker", "status").unionByName(added)


def attach_lei(candidates: DataFrame, records: DataFrame, least: float = 0.85) -> DataFrame:
    """name, lei, source: a record's LEI goes to the first candidate of its name, if that has none; of several records the first counts. Records
    without a candidate are appended in order and are candidates for those after them.

    Names match when they are equal in lower case, one holds the other, or by sequence ratio; a null or empty name matches none, a record
    without LEI counts for nothing. candidates, records: ord, name, lei."""
    low = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    known = written(candidates.select("ord", "name", "lei", low.alias("a")), "lei-candidates")
    told = written(records.where("lei <> ''").select("ord", "name", "lei", low.alias("b")), "lei-records")
    pairs = written(simjoin.name_pairs(known.select("a"), told.select("b"), least), "lei-pairs")
    by_name = known.groupBy("a").agg(F.min("ord").alias("o"))
    first = written(pairs.hint("merge").join(by_name.hint("merge"), "a").groupBy("b").agg(F.min("o").alias("o")), "lei-first")
    given = told.hint("merge").join(first.hint("merge"), "b").groupBy("o").agg(F.min_by("lei", "ord").alias("new_lei"))
    kept = known.hint("merge").join(given.hint("merge"), F.col("ord") == F.col("o"), "left").select("name", F.coalesce("lei", "new_lei").alias("lei"), F.lit("edgar").alias("source"))
    rest = written(told.hint("merge").join(first.hint("merge"), "b", "left_anti"), "lei-rest")
    names = written(rest.where("b <> ''").groupBy(F.col("b").alias("s")).agg(F.min("ord").alias("ord")), "lei-names")
    at = lambda c: names.select(F.col("s").alias(c), F.col("ord").alias(f"ord_{c}"))
    alike = simjoin.name_pairs(names.select(F.col("s").alias("a")), names.select(F.col("s").alias("b")), least).where("a <> b")
    later = alike.hint("merge").join(at("a").hint("merge"), "a").join(at("b").hint("merge"), "b").where("ord_a < ord_b").select(F.col("a").alias("earlier"), F.col("b").alias("later"))
    stays = simjoin.first_of_alike(names, later).select("s", F.col("ord").alias("o"))
    added = rest.hint("merge").join(stays.hint("merge"), (F.col("b") == F.col("s")) & (F.col("ord") == F.col("o")), "left_semi").unionByName(rest.where("b = ''"))
    return kept.unionByName(added.select("name", "lei", F.lit("gleif").alias("source")))


def names_match(a: Column, b: Column) -> Column:
    """Whether two names of one row match; for tables of names there is ``simjoin.name_pairs``."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    alike = ratios.vectorised(ratios.seq_ratio)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x) | (alike(x, y) >= 0.85))


def candidate_score(query: Column, name: Column, kind: Column, source: Column, cik: Column, lei: Column, n_series: Column) -> Column:
    """How well a candidate fits what was asked for: its name, and boosts for what can be onboarded and is identified."""
    q, n = F.lower(F.trim(query)), F.lower(F.coalesce(name, F.lit("")))
    base = F.when(n != "", ratios.vectorised(ratios.seq_ratio)(q, n)).otherwise(0.0)
    base = F.when((q != "") & (n != "") & F.contains(n, q), F.greatest(base, F.lit(0.6)) + 0.15).otherwise(base)
    boost = lambda c, x: F.when(c, x).otherwise(0.0)
    return F.round(base + boost((kind == "fund_family") & (n_series > 0), 0.15) + boost(source == "edgar", 0.05) + boost(cik.isNotNull(), 0.03) + boost(lei.isNotNull(), 0.02), 4)


def onboard_holdings(filings: DataFrame, managers: DataFrame, resolved: DataFrame) -> DataFrame:
    """firm, n_funds, n_positions, n_resolved, n_provisional: what onboarding of all filings at once did for each firm.

    filings: fund, company_name. managers: fund, firm. resolved: mention, method."""
    told = filings.join(managers, "fund").join(resolved.select("mention", "method").distinct(), F.col("company_name") == F.col("mention"), "left")
    good = F.col("method").isNotNull() & (F.col("method") != "provisional")
    return told.groupBy("firm").agg(F.countDistinct("fund").alias("n_funds"), F.count("*").alias("n_positions"), F.countDistinct(F.when(good, F.col("company_name"))).alias("n_resolved"), F.countDistinct(F.when(~good, F.col("company_name"))).alias("n_provisional"))


def enrich_firms(budgeted: DataFrame, filings: DataFrame) -> DataFrame:
    """firm, kind, key, doc_id, text: each budgeted holding's or fund's filing, cut to its section on risks. filings: key, doc_id, text."""
    met = budgeted.join(filings, "key")
    text = F.when(F.col("kind") == "holding", bounded_excerpt(F.col("text"), RISK_HEADINGS)).otherwise(bounded_excerpt(F.col("text"), PRINCIPAL_HEADINGS))
    return met.select("firm", "kind", "key", "doc_id", text.alias("text"))


def link_subject(chunks: DataFrame, subjects: DataFrame, mentions: DataFrame) -> DataFrame:
    """Mentions with every chunk of a document on its known subject. chunks: chunk_id, doc_id. subjects: doc_id, company."""
    return mentions.select("chunk_id", "company").union(chunks.select("chunk_id", "doc_id").join(subjects, "doc_id").select("chunk_id", "company")).distinct()


def record_supersedes(document: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with new versions (a missing type keeps the old one), and edges to old documents that exist. document, versions: doc_id,
    doc_type, title; versions: old_doc_id too."""
    new = versions.select("doc_id", F.col("doc_type").alias("t2"), F.col("title").alias("n2"))
    docs = document.select("doc_id", "doc_type", "title").join(new, "doc_id", "full_outer").select("doc_id", F.coalesce("t2", "doc_type").alias("doc_type"), F.coalesce("n2", "title").alias("title"))
    edges = versions.join(document.select(F.col("doc_id").alias("old_doc_id")), "old_doc_id", "left_semi").select("doc_id", "old_doc_id").distinct()
    return docs, edges


def risk_factors_added(before: DataFrame, after: DataFrame) -> DataFrame:
    """Risk titles that a run wrote."""
    return after.select("risk_title").distinct().join(before.select("risk_title"), "risk_title", "left_anti")
