"""Entity resolution and the steward: names to identifiers, triples to accepted edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Legal suffixes and stopwords that names lose; relations with one object.
SUFFIXES = ["incorporated", "corporation", "companies", "company", "holdings", "holding", "limited", "group", "corp", "inc", "co", "ltd", "llc", "lp", "plc", "nv", "sa", "ag", "se", "adr", "ads", "cl", "class"]
STOPWORDS = ["and", "the", "of"]
FUNCTIONAL = ["SUBSIDIARY_OF", "MANAGED_BY"]
LEAST_CONFIDENCE = 0.6


def normalize_name(name: Column) -> Column:
    """The words of a name without punctuation (each mark parts words), suffixes and stopwords."""
    words = F.split(F.lower(name), "[^a-z0-9]+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(SUFFIXES + STOPWORDS)), " ")


def normalize_ticker(ticker: Column) -> Column:
    return F.nullif(F.replace(F.upper(F.trim(ticker)), F.lit("."), F.lit("-")), F.lit(""))


def pad_cik(cik: Column) -> Column:
    return F.lpad(F.regexp_replace(cik.cast("string"), "^0+", ""), 10, "0")


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def resolve_mentions(mentions: DataFrame, spine: DataFrame) -> DataFrame:
    """mention, ticker -> cik by exact ticker, else by exact normalised name, else provisional; the first spine row wins.

    spine: cik, ticker, title, ord."""
    keyed = spine.select("cik", normalize_ticker(F.col("ticker")).alias("t"), normalize_name(F.col("title")).alias("n"), "ord")
    by_ticker = first_wins(keyed.where("t is not null"), ["t"], ["ord"]).select("t", F.col("cik").alias("cik_t"))
    by_name = first_wins(keyed.where("n <> ''"), ["n"], ["ord"]).select("n", F.col("cik").alias("cik_n"))
    out = mentions.withColumns({"t": normalize_ticker(F.col("ticker")), "n": normalize_name(F.col("mention"))}).join(by_ticker, "t", "left").join(by_name, "n", "left")
    method = F.when(F.col("cik_t").isNotNull(), "ticker").when(F.col("cik_n").isNotNull(), "alias").otherwise("provisional")
    return out.select("mention", "ticker", F.coalesce("cik_t", "cik_n").alias("cik"), method.alias("method"))


def mention_key() -> Column:
    """What a resolved mention is grouped by: its cik, else its normalised name."""
    return F.coalesce(F.col("cik"), F.concat(F.lit("norm:"), normalize_name(F.col("mention"))))


def canonical_names(resolved: DataFrame) -> DataFrame:
    """Per issuer (cik, else the normalised name) its shortest, then smallest, mention."""
    return resolved.groupBy(mention_key().alias("key")).agg(F.min_by("mention", F.struct(F.char_length("mention"), "mention")).alias("canonical"), F.countDistinct("mention").alias("n_mentions"))


def steward_review(triples: DataFrame, existing: DataFrame, spec: DataFrame) -> DataFrame:
    """A decision for each triple in batch order.

    triples: ord, subject, rel, object, subject_label, object_label, confidence. existing: subject, rel, object, corroboration.
    spec: rel, domain, range (arrays of labels). Reasons come in a fixed order; the n-th accepted sighting has corroboration
    existing + n; a functional relation's first sighting of another object is kept, as a conflict."""
    checked = triples.join(F.broadcast(spec), "rel", "left")  # one row for each relation type
    reason = (
        F.when(F.col("domain").isNull(), "unknown relation")
        .when(~F.array_contains("domain", F.col("subject_label")), "bad domain")
        .when(~F.array_contains("range", F.col("object_label")), "bad range")
        .when(F.coalesce(F.col("confidence"), F.lit(1.0)) < LEAST_CONFIDENCE, "low confidence")
    )
    checked = checked.withColumn("reason", reason).drop("domain", "range")
    good = checked.where("reason is null").join(existing.select("subject", "rel", "object", "corroboration"), ["subject", "rel", "object"], "left")
    known = existing.select("subject", "rel").distinct().withColumn("had", F.lit(True))
    good = good.join(known, ["subject", "rel"], "left")
    same, slot = Window.partitionBy("subject", "rel", "object").orderBy("ord"), Window.partitionBy("subject", "rel")
    good = good.withColumns({"nth": F.row_number().over(same), "first_ord": F.min("ord").over(slot)})
    new_object = F.col("corroboration").isNull() & (F.col("nth") == 1)
    conflict = F.col("rel").isin(FUNCTIONAL) & new_object & (F.col("had").isNotNull() | (F.col("first_ord") < F.col("ord")))
    total = F.coalesce(F.col("corroboration"), F.lit(0)) + F.col("nth")
    decision = F.when(conflict, "conflict").when(total > 1, "corroborate").otherwise("insert")
    accepted = good.select("ord", "subject", "rel", "object", decision.alias("decision"), F.lit(None).cast("string").alias("reason"), total.cast("long").alias("corroboration"))
    rejected = checked.where("reason is not null").select("ord", "subject", "rel", "object", F.lit("reject").alias("decision"), "reason", F.lit(0).cast("long").alias("corroboration"))
    return accepted.unionByName(rejected)


def upsert_edges(existing: DataFrame, accepted: DataFrame) -> DataFrame:
    """Edges after a batch: properties of the last accepted triple, corroboration the running count, documents joined.

    existing: subject, rel, object, corroboration, confidence, doc_ids. accepted: subject, rel, object, ord, confidence, doc_id."""
    new = accepted.groupBy("subject", "rel", "object").agg(F.max_by("confidence", "ord").alias("new_confidence"), F.array_sort(F.collect_set("doc_id")).alias("new_docs"), F.count("*").alias("more"))
    both = existing.join(new, ["subject", "rel", "object"], "full_outer")
    none = F.array().cast("array<long>")
    return both.select("subject", "rel", "object", (F.coalesce("corroboration", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("corroboration"), F.coalesce("new_confidence", "confidence").alias("confidence"), F.array_union(F.coalesce("doc_ids", none), F.coalesce("new_docs", none)).alias("doc_ids"))


def upsert_nodes(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; a new value overwrites, an absent one keeps the old."""
    cols = [c for c in existing.columns if c != key]
    renamed = new.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    return existing.join(renamed, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in cols])


def fact_id(*parts: Column) -> Column:
    return F.substr(F.sha2(F.concat_ws("|", *parts), 256), F.lit(1), F.lit(16))
