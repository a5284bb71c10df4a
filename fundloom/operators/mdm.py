"""Master data: matching of source records, attribute survivorship, golden records and lineage.

Records are long: cluster, record_id, system, trust, attribute, value. Ties go to the smaller record_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fundloom.functions import ratios
from fundloom.functions.text import norm_id
from fundloom.operators.components import components
from fundloom.operators.steward import normalize_name
from fundloom.sources.tables import written

#: What counts as no value.
EMPTY = ["", "Not Stated", "N/A", "na"]


def non_empty(value: Column) -> Column:
    return value.isNotNull() & ~value.isin(EMPTY)


def parse_number(value: Column) -> Column:
    """The first number in a text, commas removed."""
    return F.regexp_replace(F.regexp_extract(value, r"-?\d[\d,]*(\.\d+)?", 0), ",", "").try_cast("double")


def ranked(records: DataFrame, order: list) -> DataFrame:
    w = Window.partitionBy("cluster", "attribute").orderBy(*order, "record_id")
    return records.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("cluster", "attribute", "value", "record_id", "system")


def survive_trust(records: DataFrame) -> DataFrame:
    """The most trusted non-empty value."""
    return ranked(records.where(non_empty(F.col("value"))), [F.desc("trust")])


def survive_system_of_record(records: DataFrame, system: str) -> DataFrame:
    """The named system's value if it has one, else the most trusted."""
    return ranked(records.where(non_empty(F.col("value"))), [F.desc(F.col("system") == system), F.desc("trust")])


#: Fixed value: a postcode, which makes an address more complete than any length.
POSTCODE = r"[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}"


def survive_most_complete(records: DataFrame) -> DataFrame:
    """The longest value (an address with a postcode counts 100 more), then the most trusted."""
    bonus = F.when((F.col("attribute") == "address") & F.col("value").rlike(POSTCODE), 100).otherwise(0)
    return ranked(records.where(non_empty(F.col("value"))), [F.desc(F.char_length("value") + bonus), F.desc("trust")])


def survive_crosswalk(records: DataFrame, system: str) -> DataFrame:
    """The system's identifier, and the other distinct ones sorted."""
    best = survive_system_of_record(records, system)
    every = records.where(non_empty(F.col("value"))).groupBy("cluster", "attribute").agg(F.array_sort(F.collect_set("value")).alias("every"))
    return best.hint("merge").join(every.hint("merge"), ["cluster", "attribute"]).select("cluster", "attribute", "value", "record_id", "system", F.array_join(F.array_remove(F.col("every"), F.col("value")), ",").alias("alternates"))


def survive_numeric_tolerance(records: DataFrame, system: str, tolerance_pct: float) -> DataFrame:
    """The system's number, else the most trusted; whether all sources agree within the tolerance. Where no source has a number, the
    most trusted value, and nothing is said of agreement."""
    numbers = records.withColumn("x", parse_number(F.col("value"))).where("x is not null")
    spread = numbers.groupBy("cluster", "attribute").agg(((F.max("x") - F.min("x")) / F.greatest(F.abs(F.min("x")), F.lit(1.0))).alias("spread"))
    best = ranked(numbers, [F.desc(F.col("system") == system), F.desc("trust")])
    told = best.hint("merge").join(spread.hint("merge"), ["cluster", "attribute"]).select("cluster", "attribute", "value", "record_id", "system", (F.col("spread") * 100 <= tolerance_pct).alias("agree"))
    rest = survive_trust(records).hint("merge").join(spread.hint("merge"), ["cluster", "attribute"], "left_anti")
    return told.unionByName(rest.withColumn("agree", F.lit(None).cast("boolean")))


def survive_classification(records: DataFrame, canonical: str, classes: list[str], curie: str) -> DataFrame:
    """One canonical value for all variants, from the rule engine and not from a record; the class if all variants are of it."""
    seen = records.where(non_empty(F.col("value"))).withColumn("of", F.lower(F.trim("value")).isin(classes))
    out = seen.groupBy("cluster", "attribute").agg(F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("variants"), F.bool_or("of").alias("some"))
    return out.select("cluster", "attribute", F.lit(canonical).alias("value"), F.lit("ontology rule engine").alias("system"), "variants", F.when(F.col("some"), curie).alias("curie"))


def golden_record(decisions: DataFrame, alternates: DataFrame | None = None, id_attribute: str = "id") -> DataFrame:
    """One row for each cluster: pk (the surviving id, else the cluster), attributes as sorted ``name=value`` text, the alternates that
    a crosswalk keeps, how many records won something, and why: who won which attribute."""
    pair = lambda v: F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "attribute", v))), ";")
    pk = F.coalesce(F.max(F.when(F.col("attribute") == id_attribute, F.col("value"))), F.first("cluster").cast("string"))
    golden = decisions.groupBy("cluster").agg(pk.alias("pk"), pair("value").alias("golden"), F.countDistinct("record_id").alias("n_sources"), pair("system").alias("rationale"))
    if alternates is None:
        return golden.withColumn("alternates", F.lit(""))
    kept = alternates.select("cluster", "alternates")
    return golden.hint("merge").join(kept.hint("merge"), "cluster", "left").withColumn("alternates", F.coalesce("alternates", F.lit("")))


def publish_golden(gold: DataFrame, golden: DataFrame, version: int) -> DataFrame:
    """The gold dimension after new golden records: rows of their pk are replaced. gold: pk, cluster, golden, version."""
    new = golden.select("pk", "cluster", "golden", F.lit(version).alias("version"))
    return upsert_gold_dim(gold, new, ["pk"])


def upsert_gold_dim(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of equal keys; of several new ones the last by cluster stays."""
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in new.columns if c not in keys]), "cluster").alias("x")).select(*keys, "x.*")
    return existing.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*existing.columns))


def mdm_entities(records: DataFrame, name_attribute: str, ranks: dict[str, int]) -> DataFrame:
    """Clusters with the name that their best-ranked system gives (ties: the smaller record), sources and attributes."""
    rank = F.coalesce(*[F.when(F.col("system") == s, F.lit(k)) for s, k in ranks.items()], F.lit(1))
    best = records.where(F.col("attribute") == name_attribute).groupBy("cluster").agg(F.min_by("value", F.struct((-rank).alias("r"), "record_id")).alias("name"))
    counts = records.groupBy("cluster").agg(F.countDistinct("record_id").alias("n_sources"), F.countDistinct("attribute").alias("n_attributes"))
    return counts.hint("merge").join(best.hint("merge"), "cluster", "left").select("cluster", F.coalesce("name", F.col("cluster").cast("string")).alias("display_name"), "n_sources", "n_attributes")


def mdm_sources(records: DataFrame) -> DataFrame:
    """Each record's values as sorted text, with its place by trust in the cluster (ties: the smaller record)."""
    values = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "attribute", "value"))), ";")
    rows = records.groupBy("cluster", "record_id", "system", "trust").agg(values.alias("said"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("trust"), "record_id")))


def gold_lookup(golden: DataFrame, lines: DataFrame) -> DataFrame:
    """Golden rows with the records behind each attribute, in order."""
    by = lines.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "attribute", F.col("record_id").cast("string")))), ";").alias("lineage"))
    return golden.hint("merge").join(by.hint("merge"), "cluster", "left").select("cluster", "pk", "golden", "lineage")


def system_order(systems: DataFrame) -> DataFrame:
    return systems.orderBy(F.desc("trust"), "system")


def lineage(decisions: DataFrame) -> DataFrame:
    return decisions.select("cluster", "attribute", "record_id", "system")


def replace_lineage(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Lineage with all rows of the clusters in ``new`` replaced."""
    return existing.join(new.select("cluster").distinct(), "cluster", "left_anti").unionByName(new)


def pair_score(similarities: Column, decisive: Column) -> Column:
    """Three quarters of the best and a quarter of the mean of the similarities that are there; what is decisive counts as 1."""
    sims = F.array_compact(F.concat(similarities, F.when(decisive, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>"))))
    mean = F.aggregate(sims, F.lit(0.0), lambda s, x: s + x) / F.size(sims)
    return F.when(F.size(sims) == 0, 0.0).otherwise(0.75 * F.array_max(sims) + 0.25 * mean)


def pairwise_match(records: DataFrame, name: str, address: str, identifier: str, strong: list[str] = ()) -> DataFrame:
    """Pairs of a cluster's records (a < b) with their score: how alike names and addresses are, a shared identifier decides.

    A cluster is the few records that share a master key, so its pairs are few."""
    value = lambda k: F.max(F.when(F.col("attribute") == k, F.col("value")))
    told = records.groupBy("cluster", "record_id").agg(value(name).alias("name"), value(address).alias("addr"), value(identifier).alias("id"), F.array_compact(F.array(*[value(s) for s in strong], F.lit(None).cast("string"))).alias("strong"))
    told = told.select("cluster", "record_id", normalize_name(F.coalesce("name", F.lit(""))).alias("name"), normalize_name(F.coalesce("addr", F.lit(""))).alias("addr"), norm_id(F.col("id")).alias("id"), F.transform("strong", lambda x: F.upper(F.trim(x))).alias("strong"))
    other = told.select(*[F.col(c).alias(f"{c}_b") for c in told.columns])
    pairs = told.hint("merge").join(other.hint("merge"), (F.col("cluster") == F.col("cluster_b")) & (F.col("record_id") < F.col("record_id_b")))
    alike = ratios.vectorised(ratios.token_set_ratio)
    sims = F.array(F.when((F.col("name") != "") & (F.col("name_b") != ""), alike("name", "name_b")), F.when((F.col("addr") != "") & (F.col("addr_b") != ""), alike("addr", "addr_b")))
    decisive = F.arrays_overlap("strong", "strong_b") | ((F.col("id") != "") & (F.col("id") == F.col("id_b")))
    return pairs.select("cluster", F.col("record_id").alias("a"), F.col("record_id_b").alias("b"), F.round(pair_score(sims, F.coalesce(decisive, F.lit(False))), 6).alias("score"))


def match_confidence(records: DataFrame, pairs: DataFrame, threshold: float = 0.88) -> DataFrame:
    """Mean pair score of each cluster, 1.0 for single records."""
    mean = pairs.groupBy("cluster").agg(F.avg("score").alias("m"))
    out = records.groupBy("cluster").agg(F.countDistinct("record_id").alias("n_records")).join(mean, "cluster", "left").withColumn("confidence", F.round(F.coalesce("m", F.lit(1.0)), 3))
    return out.select("cluster", "n_records", "confidence", (F.col("confidence") >= threshold).alias("resolved"))


def match_clusters(records: DataFrame, pairs: DataFrame, threshold: float = 0.88) -> DataFrame:
    """record_id, match_id (the least record that it is one with), n_matched, confidence (mean score of the pairs within): records joined, over any number of steps, by
    pairs that score ``threshold`` or more; a record without such a pair is by itself, with confidence 1. pairs: a, b, score."""
    good = pairs.where(F.col("score") >= threshold)
    label = written(components(good.select(F.col("a").alias("u"), F.col("b").alias("v"))), "match-labels")
    at = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    within = pairs.hint("merge").join(at("a").hint("merge"), "a").join(at("b").hint("merge"), "b").where("label_a = label_b")
    mean = within.groupBy(F.col("label_a").alias("l")).agg(F.round(F.avg(F.col("score").cast("decimal(20,10)")).cast("double"), 6).alias("mean"))
    size = label.groupBy(F.col("label").alias("l")).agg(F.count("*").alias("n"))
    told = label.join(size.join(mean, "l"), F.col("label") == F.col("l")).select(F.col("node").alias("k"), "label", "n", "mean")
    out = records.select("record_id").distinct().hint("merge").join(told.hint("merge"), F.col("record_id") == F.col("k"), "left")
    return out.select("record_id", F.coalesce("label", "record_id").alias("match_id"), F.coalesce("n", F.lit(1)).alias("n_matched"), F.coalesce("mean", F.lit(1.0)).alias("confidence"))
