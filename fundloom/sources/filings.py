"""Readers of filings, spines and seeds, and versioned table writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.functions.ontology import clamped, pairs_to_map, sorted_text
from fundloom.functions.text import collapse_ws, detect_doc_type, detect_sensitivity, hash_id, looks_like_html, page_estimate, strip_html
from fundloom.operators.steward import normalize_name, normalize_ticker, pad_cik

FILING = """
headerData struct<filerInfo: struct<seriesClassInfo: struct<seriesId: string>>>,
formData struct<
  genInfo: struct<regName: string, regCik: string, seriesName: string, seriesId: string, seriesLei: string, repPdEnd: string, repPdDate: string>,
  invstOrSecs: struct<invstOrSec: array<struct<name: string, lei: string, cusip: string, identifiers: struct<ticker: struct<_value: string>>, balance: string, valUSD: string, pctVal: string>>>>
"""


def number(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double")


def scan_nport(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Funds and holdings of N-PORT filings; positions without name, weight or value are left out, a filing without a
    series id is an error when its rows are read."""
    raw = spark.read.format("xml").option("rowTag", "edgarSubmission").option("ignoreNamespace", "true").schema(FILING).load(path)
    gen = F.col("formData.genInfo")
    series = F.coalesce(F.nullif(F.trim(gen["seriesId"]), F.lit("")), F.nullif(F.trim(F.col("headerData.filerInfo.seriesClassInfo.seriesId")), F.lit("")))
    series = F.when(series.isNull(), F.raise_error(F.lit("filing without a series id"))).otherwise(series)
    as_of = F.coalesce(gen["repPdEnd"], gen["repPdDate"])
    funds = raw.select(series.alias("series_id"), F.coalesce(gen["seriesName"], series).alias("name"), pad_cik(gen["regCik"]).alias("cik"), gen["seriesLei"].alias("lei"), as_of.alias("as_of"))
    each = raw.select(series.alias("series_id"), as_of.alias("as_of"), F.explode("formData.invstOrSecs.invstOrSec").alias("p"))
    holds = each.select("series_id", F.trim("p.name").alias("name"), normalize_ticker(F.col("p.identifiers.ticker._value")).alias("ticker"), F.col("p.cusip").alias("cusip"), F.col("p.lei").alias("lei"), number(F.col("p.balance")).alias("shares"), number(F.col("p.valUSD")).alias("value_usd"), number(F.col("p.pctVal")).alias("weight_pct"), "as_of")
    return funds, holds.where("name is not null and name <> '' and value_usd is not null and weight_pct is not null")


def nport_totals(holds: DataFrame) -> DataFrame:
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,6)")).cast("double")
    return holds.groupBy("series_id").agg(F.round(exact("weight_pct"), 6).alias("total_weight"), F.round(exact("value_usd"), 2).alias("total_value"))


def scan_issuer_spine(spark: SparkSession, path: str) -> DataFrame:
    """cik, ticker, title, norm and ord of a ticker file: an object of numbered entries."""
    return issuer_entries(spark.read.text(path, wholetext=True))


def issuer_entries(text: DataFrame) -> DataFrame:
    """The same of a column ``value`` that holds such objects."""
    entries = text.select(F.explode(F.from_json("value", "map<string, struct<cik_str: string, ticker: string, title: string>>")).alias("k", "v"))
    return entries.select(pad_cik(F.col("v.cik_str")).alias("cik"), normalize_ticker(F.col("v.ticker")).alias("ticker"), F.col("v.title").alias("title"), normalize_name(F.col("v.title")).alias("norm"), F.col("k").cast("long").alias("ord"))


def scan_fund_spine(spark: SparkSession, path: str) -> DataFrame:
    """series_id, cik, class ids and tickers (distinct, in order) of a column-positional file {fields, data}."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "fields array<string>, data array<array<string>>").alias("j"))
    at = lambda name: F.get(F.col("row"), (F.array_position(F.col("fields"), name) - 1).cast("int"))
    rows = text.select("j.fields", F.posexplode("j.data").alias("ord", "row"))
    typed = rows.select("ord", at("seriesId").alias("series_id"), at("cik").alias("cik"), at("classId").alias("class_id"), at("symbol").alias("symbol"))
    listed = lambda c: F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("ord", c))), lambda x: x[c]), lambda x: x.isNotNull()))
    return typed.where("series_id is not null").groupBy("series_id").agg(pad_cik(F.min_by("cik", "ord")).alias("cik"), listed("class_id").alias("class_ids"), listed("symbol").alias("tickers"))


def scan_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """ticker, cusip, issuer_name, title_of_class; of a ticker's rows the last of the file wins."""
    raw = spark.read.csv(path, header=True, schema="ticker string, cusip string, issuer_name string, title_of_class string")
    # Where a row's split starts, then its place in the split.
    raw = raw.withColumn("ord", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")))
    return raw.groupBy(normalize_ticker(F.col("ticker")).alias("ticker")).agg(*[F.max_by(c, "ord").alias(c) for c in ("cusip", "issuer_name", "title_of_class")])


def scan_extractions(raw: DataFrame, labels: list[str], relations: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of model output: chunk_id, payload (JSON). Unknown labels and types are dropped; confidence is clamped."""
    schema = "entities array<struct<label: string, name: string, span: string, confidence: double, attributes: array<struct<key: string, value: string>>>>, relations array<struct<type: string, subject: string, object: string, span: string, confidence: double>>"
    parsed = raw.select("chunk_id", F.from_json("payload", schema).alias("j"))
    clamp = lambda c: clamped(F.coalesce(F.col(c), F.lit(1.0)))
    entities = parsed.select("chunk_id", F.explode("j.entities").alias("e")).where(F.col("e.label").isin(labels))
    pairs = pairs_to_map(F.coalesce("e.attributes", F.array().cast("array<struct<key:string,value:string>>")))
    edges = parsed.select("chunk_id", F.explode("j.relations").alias("r")).where(F.col("r.type").isin(relations))
    return entities.select("chunk_id", "e.label", "e.name", "e.span", clamp("e.confidence").alias("confidence"), pairs.alias("attributes")), edges.select("chunk_id", "r.type", "r.subject", "r.object", "r.span", clamp("r.confidence").alias("confidence"))


def write_version(df: DataFrame, root: str, version: int, partition_by: list[str] | None = None) -> str:
    """A new version folder of a table; what readers have open is never overwritten."""
    path = f"{root}/v{version:08d}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_snapshot(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> DataFrame:
    """Freeze tables and a manifest: rows and an order-free digest of each."""
    out = None
    for name, df in tables.items():
        path = write_version(df, f"{root}/{name}", 1)
        digest = spark.read.parquet(path).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("digest")).select(F.lit(name).alias("name"), F.lit(path).alias("path"), "n", "digest")
        out = digest if out is None else out.unionByName(digest)
    out.coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifest")
    return spark.read.parquet(f"{root}/manifest")


def damaged(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Rows of a manifest whose tables don't match it. A manifest names a handful of tables."""
    out = None
    for r in manifest.select("name", "path", "n", "digest").collect():
        df = spark.read.parquet(r["path"])
        now = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("digest")).where((F.col("n") != r["n"]) | ~F.col("digest").eqNullSafe(F.lit(r["digest"]))).select(F.lit(r["name"]).alias("name"))
        out = now if out is None else out.unionByName(now)
    return out


def scan_documents(raw: DataFrame) -> DataFrame:
    """doc_id, name, doc_type, sensitivity, text, chars, pages of named texts: pages lose their tags, others their spare white space; texts
    without content are left out. raw: name, text."""
    plain = F.when(looks_like_html(F.col("text")) | F.lower("name").rlike(r"\.html?$"), strip_html(F.col("text"))).otherwise(collapse_ws(F.col("text")))
    docs = raw.select("name", plain.alias("text")).where("text <> ''")
    return docs.select(hash_id(F.col("text")).alias("doc_id"), "name", detect_doc_type(F.col("text"), F.col("name")).alias("doc_type"), detect_sensitivity(F.col("text"), F.col("name")).alias("sensitivity"), "text", F.char_length("text").alias("chars"), page_estimate(F.col("text")).alias("pages"))


def scan_medallion_seed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Source systems, and bronze records with their attributes as a map, of a nested JSON file."""
    schema = "source_systems array<struct<system_id: string, name: string, layer: string, trust_score: int>>, bronze array<struct<record_id: string, system_id: string, entity_type: string, master_key: string, attributes: map<string, string>>>"
    seed = spark.read.schema(schema).json(path, multiLine=True)
    return seed.select(F.explode("source_systems").alias("x")).select("x.*"), seed.select(F.explode("bronze").alias("x")).select("x.*")


def scan_fact_set(spark: SparkSession, path: str) -> DataFrame:
    """version, doc_id and supersedes of a fact set with one row for each fact: kind, name, subject, object, payload (in order of its keys), ord."""
    fact = "struct<kind: string, type: string, label: string, subject: string, key: string, object: string, period: string, qualifiers: map<string, string>, props: map<string, string>, doc_id: string, chunk_id: string, span: string>"
    sets = spark.read.schema(f"version string, supersedes string, document struct<doc_id: string>, facts array<{fact}>").json(path, multiLine=True)
    each = sets.select("version", "supersedes", F.col("document.doc_id").alias("document"), F.posexplode("facts").alias("ord", "f"))
    bag = F.coalesce(F.when(F.col("f.kind") == "relation", F.col("f.qualifiers")).otherwise(F.col("f.props")), F.create_map().cast("map<string,string>"))
    return each.select("version", "document", "supersedes", "ord", "f.kind", F.coalesce("f.type", "f.label").alias("name"), F.coalesce("f.subject", "f.key").alias("subject"), "f.object", F.coalesce("f.period", F.try_element_at(bag, F.lit("period"))).alias("period"), sorted_text(bag).alias("payload"), "f.span")


def scan_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of a snapshot by name; an error if one doesn't match the manifest."""
    manifest = spark.read.parquet(f"{root}/manifest")
    wrong = [r["name"] for r in damaged(spark, manifest).collect()]  # names of tables
    if wrong:
        raise ValueError(f"tables that don't match the manifest: {wrong}")
    return {r["name"]: spark.read.parquet(r["path"]) for r in manifest.select("name", "path").collect()}


def load_policy(spark: SparkSession, path: str) -> DataFrame:
    """rule, kind, name, traversal, changes of an impact policy in YAML: a small list that comes with the job."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()["value"]  # one file of a few rules
    rows = []
    for r in yaml.safe_load(text)["rules"]:
        trigger = r["trigger"]
        rows.append((r["name"], trigger["kind"], trigger.get("type") or trigger.get("label"), ",".join(t["relation"] for t in r["traverse"]), list(trigger["change"])))
    return spark.createDataFrame(rows, "rule string, kind string, name string, traversal string, changes array<string>")
