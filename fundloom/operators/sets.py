"""Closures, set operations, sections, budgets and small rollups."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fundloom.operators import rules


def closure(edges: DataFrame) -> DataFrame:
    """All (child, ancestor) pairs of ``edges`` (child, parent)."""
    return rules.closure(edges).select("child", "ancestor")


def disjoint_violations(types: DataFrame, closed: DataFrame, disjoint: DataFrame) -> DataFrame:
    """instance, a, b: instances that are, directly or by closure, of two classes declared disjoint (in either order)."""
    every = types.select("instance", F.col("cls").alias("c")).unionByName(types.join(closed, F.col("cls") == F.col("child")).select("instance", F.col("ancestor").alias("c"))).distinct()
    pairs = disjoint.select("a", "b").unionByName(disjoint.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = every.join(F.broadcast(pairs), F.col("c") == F.col("a")).where("a < b")  # axioms are a small, given list
    right = every.select(F.col("instance").alias("i2"), F.col("c").alias("c2"))
    return left.join(right, (F.col("instance") == F.col("i2")) & (F.col("b") == F.col("c2"))).select("instance", "a", "b").distinct()


def board_links(roles: DataFrame, companies: DataFrame) -> DataFrame:
    """company, person, role, other, other_role: directors and officers of the asked companies and their roles elsewhere (null without any)."""
    at = roles.where(F.col("role").isin("DIRECTOR_OF", "OFFICER_OF")).join(companies.select("company").distinct(), "company", "left_semi")
    other = roles.select("person", F.col("company").alias("other"), F.col("role").alias("other_role"))
    found = at.join(other.withColumnRenamed("person", "p2"), (F.col("person") == F.col("p2")) & (F.col("company") != F.col("other")), "left")
    return found.select("company", "person", "role", "other", "other_role").distinct()


def section_slice(docs: DataFrame, heading: str) -> DataFrame:
    """doc_id, section, heading, n_lines, n_chars: lines from a heading to the line before the next; what comes first has section 0."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "said"))
    w = Window.partitionBy("doc_id").orderBy("line")
    marked = lines.withColumn("is_heading", F.col("said").rlike(heading)).withColumn("section", F.sum(F.col("is_heading").cast("int")).over(w))
    return marked.groupBy("doc_id", "section").agg(F.max(F.when(F.col("is_heading"), F.col("said"))).alias("heading"), F.count("*").alias("n_lines"), F.sum(F.char_length("said")).alias("n_chars"))


def section_filter(docs: DataFrame, heading: str) -> DataFrame:
    """doc_id, text: what stands from the first heading on, as lines; documents without a heading give nothing."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "said"))
    w = Window.partitionBy("doc_id").orderBy("line")
    inside = lines.withColumn("section", F.sum(F.col("said").rlike(heading).cast("int")).over(w)).where("section > 0")
    return inside.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "said"))), lambda x: x["said"]), "\n").alias("text"))


#: How the lines start that head a filing's items.
ITEM_HEADS = {"1": ["item 1.", "item 1:", "item 1 "], "1a": ["item 1a"], "7": ["item 7.", "item 7:", "item 7 "]}
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def item_sections(docs: DataFrame, sections: list[str]) -> DataFrame:
    """doc_id, text: the asked items of each filing (like ``["1", "1A", "Item 7"]``), each from its heading to the next item's, white space at its ends left
    off, joined by blank lines in order; filings without any give no row. An item that stands twice is given twice; rows are taken by themselves."""
    wanted = [s.lower().replace("item", "").strip() for s in sections]
    starts = lambda keys: rf"[ \t]*(?i:{'|'.join(re.escape(h) for k in keys for h in ITEM_HEADS[k]) or '(?!)'})"
    asked = starts([k for k in ITEM_HEADS if k in wanted])
    # A text is cut at its headings by one pattern: an array of lines with their keys was worked out anew for each of its items.
    some = docs.where(F.col("text").rlike(rf"(?:^|{LINE_END}){asked}"))
    parts = F.split(F.regexp_replace("text", LINE_END, "\n"), rf"(?dm)^(?={starts(ITEM_HEADS)})")
    bodies = F.transform(F.filter(parts, lambda x: x.rlike(rf"^{asked}")), lambda x: F.trim(x, F.lit(" \t\n\x0b\x0c\r")))
    return some.select("doc_id", F.array_join(bodies, "\n\n").alias("text"))


def budgeted(first: DataFrame, second: DataFrame, budget: int) -> DataFrame:
    """firm, kind, key, rank: at most ``budget`` of each firm, all of the first list before the second; both: firm, key, ord."""
    both = first.select("firm", F.lit("holding").alias("kind"), "key", "ord", F.lit(0).alias("p")).unionByName(second.select("firm", F.lit("fund").alias("kind"), "key", "ord", F.lit(1).alias("p")))
    once = both.groupBy("firm", "key").agg(F.min(F.struct("p", "ord", "kind")).alias("x")).select("firm", "key", "x.*")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("firm").orderBy("p", "ord", "key"))).where(F.col("rank") <= budget).select("firm", "kind", "key", "rank")


def usage_rollup(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens and cost by kind. prices: event_type, price; a given list."""
    summed = calls.groupBy("event_type").agg(F.count("*").alias("n_calls"), F.sum(F.col("value").cast("decimal(28,6)")).alias("tokens"))
    cost = F.round((F.col("tokens") * F.coalesce("price", F.lit(0)).cast("decimal(6,3)")), 4).cast("double")
    return summed.join(F.broadcast(prices), "event_type", "left").select("event_type", "n_calls", F.round("tokens", 4).cast("double").alias("tokens"), cost.alias("cost"))


def tag_intent(text: Column, classes: list[tuple[str, str]], default: str = "open") -> Column:
    """The first class whose pattern is found."""
    return F.coalesce(*[F.when(F.lower(text).rlike(p), F.lit(name)) for name, p in classes], F.lit(default))


def dedup_citations(citations: DataFrame) -> DataFrame:
    """Distinct (doc_id, chunk_id, span), nulls equal to each other, the first by ``ord`` kept; citations without any of the three left out."""
    some = citations.where("doc_id is not null or chunk_id is not null or span is not null")
    return some.groupBy("doc_id", "chunk_id", "span").agg(F.min("ord").alias("ord"))


def absent(graph: DataFrame, registry: DataFrame) -> DataFrame:
    """Firms of the graph that the registry has neither by id nor by name: two anti-joins, not one OR."""
    return graph.join(registry.select("firm"), "firm", "left_anti").join(registry.select("name"), "name", "left_anti")


def rank_candidates(candidates: DataFrame, k: int = 8) -> DataFrame:
    """Per query the ``k`` best candidates. Duplicates (by cik, else by name) are merged: best score, first name and ids that are there,
    all series, a fund family if one is. candidates: query, ord, name, cik, lei, series (array), kind, score."""
    key = F.coalesce(F.concat(F.lit("cik:"), "cik"), F.concat(F.lit("name:"), F.lower(F.trim(F.coalesce("name", F.lit(""))))))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    merged = candidates.withColumn("key", key).groupBy("query", "key").agg(
        first("name").alias("name"), first("cik").alias("cik"), first("lei").alias("lei"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("series")))).alias("series"),
        F.when(F.bool_or(F.col("kind") == "fund_family"), "fund_family").otherwise(first("kind")).alias("kind"), F.max("score").alias("score"), F.count("*").alias("n_merged"),
    )
    return merged.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "name", "key"))).where(F.col("rank") <= k)


def event_seq(events: DataFrame) -> DataFrame:
    """Gap-free numbers of a job's events in time order."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
