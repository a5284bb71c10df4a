import json

import pytest
from pyspark.sql import functions as F

from fundloom.operators import steward
from fundloom.sources import filings
from fundloom.streaming import ingest

XML = """<?xml version="1.0"?><edgarSubmission xmlns="http://www.sec.gov/edgar/nport"><headerData><filerInfo><seriesClassInfo><seriesId>{head}</seriesId></seriesClassInfo></filerInfo></headerData>
<formData><genInfo><regCik>0000123</regCik><seriesName>Growth</seriesName><seriesId>{series}</seriesId><repPdDate>2026-05-31</repPdDate></genInfo><invstOrSecs>
<invstOrSec><name>A Corp</name><cusip>012345678</cusip><identifiers><ticker value="a.b"/></identifiers><balance>1,000</balance><valUSD>2,500.5</valUSD><pctVal>11.5</pctVal></invstOrSec>
<invstOrSec><name>No weight</name><valUSD>1</valUSD></invstOrSec></invstOrSecs></formData></edgarSubmission>"""


def test_nport(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML.format(head="S9", series=""))
    funds, holds = filings.scan_nport(spark, str(tmp_path / "a.xml"))
    assert funds.first().asDict() == {"series_id": "S9", "name": "Growth", "cik": "0000000123", "lei": None, "as_of": "2026-05-31"}
    assert [(r["name"], r["ticker"], r["cusip"], r["shares"], r["value_usd"], r["weight_pct"]) for r in holds.collect()] == [("A Corp", "A-B", "012345678", 1000.0, 2500.5, 11.5)]
    assert filings.nport_totals(holds).first()["total_value"] == 2500.5
    (tmp_path / "b.xml").write_text(XML.format(head="", series=""))
    with pytest.raises(Exception, match="series id"):
        filings.scan_nport(spark, str(tmp_path / "b.xml"))[1].collect()


def test_spines(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 1045810, "ticker": "nvda", "title": "NVIDIA CORP"}, "1": {"cik_str": 2, "ticker": "", "title": "X"}}))
    rows = filings.scan_issuer_spine(spark, str(tmp_path / "t.json")).orderBy("ord").collect()
    assert (rows[0]["cik"], rows[0]["ticker"], rows[0]["norm"], rows[1]["ticker"]) == ("0001045810", "NVDA", "nvidia", None)
    (tmp_path / "f.json").write_text(json.dumps({"fields": ["cik", "seriesId", "classId", "symbol"], "data": [[7, "S1", "C2", "AA"], [7, "S1", "C1", "BB"], [7, "S1", "C2", "AA"]]}))
    r = filings.scan_fund_spine(spark, str(tmp_path / "f.json")).first()
    assert (r["series_id"], r["cik"], r["class_ids"], r["tickers"]) == ("S1", "0000000007", ["C2", "C1"], ["AA", "BB"])
    (tmp_path / "c.csv").write_text("ticker,cusip,issuer_name,title_of_class\na,001,A,COM\na,002,A2,CL B\n")
    assert filings.scan_crosswalk(spark, str(tmp_path / "c.csv")).first()["cusip"] == "002"


def test_extractions(spark):
    payload = json.dumps({"entities": [{"label": "Company", "name": "N", "confidence": 3.0, "attributes": [{"key": "cik", "value": "1"}]}, {"label": "Nope", "name": "x"}], "relations": [{"type": "SUPPLIES_TO", "subject": "a", "object": "b", "confidence": -1.0}, {"type": "LIKES", "subject": "a", "object": "b"}]})
    entities, relations = filings.scan_extractions(spark.createDataFrame([("c1", payload), ("c2", "broken")], "chunk_id string, payload string"), ["Company"], ["SUPPLIES_TO"])
    assert [(r["name"], r["confidence"], r["attributes"]) for r in entities.collect()] == [("N", 1.0, {"cik": "1"})]
    assert [(r["type"], r["confidence"]) for r in relations.collect()] == [("SUPPLIES_TO", 0.0)]


def test_snapshot(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    manifest = filings.write_snapshot(spark, {"nodes": df, "edges": df.limit(3)}, str(tmp_path))
    assert filings.damaged(spark, manifest).count() == 0
    assert filings.damaged(spark, manifest.withColumn("n", F.col("n") + 1)).count() == 2


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_batch(spark, tmp_path, files):
    schema = "subject string, rel string, object string, ord long, confidence double, doc_id long"
    rows = [(f"s{i % 4}", "R", f"o{i % 3}", i, i / 40, i % 6) for i in range(30)]
    for k in range(files):
        spark.createDataFrame(rows[k * 30 // files : (k + 1) * 30 // files], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # started again, it finds nothing new
        ingest.upsert_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = ingest.latest(spark, str(tmp_path / "out"), files)
    want = steward.upsert_edges(spark.createDataFrame([], ingest.EDGE), spark.createDataFrame(rows, schema))
    key = lambda r: (r["subject"], r["object"])
    flat = lambda df: [(*key(r), r["corroboration"], r["confidence"] if files == 1 else None, sorted(r["doc_ids"])) for r in sorted(df.collect(), key=key)]
    assert flat(got) == flat(want)


def test_stage_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = ingest.stage_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("stage_counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = {(r["h"], r["event_type"]): r["n"] for r in events.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert {(r["start"], r["event_type"]): r["n"] for r in spark.table("stage_counts").collect()} == want


def streamed(spark, tmp_path, rows, schema, job, cuts, name):
    """What a job appends when its rows come in the given number of files, one after the other."""
    folder = tmp_path / f"in{cuts}"
    for k in range(cuts):
        part = rows[k * len(rows) // cuts : (k + 1) * len(rows) // cuts]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = str(tmp_path / f"out{cuts}")
    job(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"cp{cuts}")).trigger(availableNow=True).start().awaitTermination()
    return sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str)


@pytest.mark.parametrize("cuts", [1, 4])
def test_steward_state_is_the_batch_result_for_any_cut(spark, tmp_path, cuts):
    rows = [(f"{k:03d}", f"s{k % 3}", "SUBSIDIARY_OF" if k % 2 else "SUPPLIES_TO", f"o{k * k % 5}") for k in range(40)]
    got = streamed(spark, tmp_path, rows, "ord string, subject string, rel string, object string", ingest.steward_state, cuts, "steward")
    typed = spark.createDataFrame([(*r, "Company", "Company", 1.0) for r in rows], "ord string, subject string, rel string, object string, subject_label string, object_label string, confidence double")
    spec = spark.createDataFrame([("SUPPLIES_TO", ["Company"], ["Company"]), ("SUBSIDIARY_OF", ["Company"], ["Company"])], "rel string, domain array<string>, range array<string>")
    none = spark.createDataFrame([], "subject string, rel string, object string, corroboration long")
    want = steward.steward_review(typed, none, spec).select("ord", "subject", "rel", "object", "decision", "corroboration").collect()
    assert got == sorted((tuple(r) for r in want), key=str)


@pytest.mark.parametrize("cuts", [1, 3])
def test_steward_state_goes_by_number(spark, tmp_path, cuts):
    rows = [(k, "s", "SUBSIDIARY_OF", f"o{k // 5}") for k in (10, 9, 100, 11, 101, 99)] if cuts == 1 else [(k, "s", "SUBSIDIARY_OF", f"o{k // 5}") for k in (9, 10, 99, 11, 100, 101)]
    got = streamed(spark, tmp_path, rows, "ord long, subject string, rel string, object string", ingest.steward_state, cuts, "numbers")
    told = {r[0]: (r[4], r[5]) for r in got}
    assert told[9] == ("insert", 1) and told[10][0] == told[99][0] == "conflict" and told[100] == ("conflict", 1) and told[101] == ("corroborate", 2)
    assert told[11] == (("corroborate", 2) if cuts == 1 else ("corroborate", 2))


def test_a_batch_writes_the_buckets_that_it_touches(spark, tmp_path):
    schema, root = "subject string, rel string, object string, ord long, confidence double, doc_id long", str(tmp_path / "edges")
    first = spark.createDataFrame([(f"s{i}", "R", f"o{i}", i, 0.5, i) for i in range(200)], schema)
    second = spark.createDataFrame([("s3", "R", "o3", 900, 0.75, 7), ("new", "R", "o", 901, 0.25, 8)], schema)
    ingest.merge_batch(first, root, 0)
    size = lambda v: len(list((tmp_path / "edges" / "data" / f"v{v:08d}").glob("bucket=*")))
    assert size(1) > 50
    # A run that was killed before its commit leaves files; the next run writes them over.
    first.limit(9).write.parquet(f"{root}/data/v00000002/bucket=1")
    for _ in range(2):
        ingest.merge_batch(second, root, 1)
    assert size(2) <= 2 and ingest.latest(spark, root, 1).count() == 200 and ingest.latest(spark, root, 2).count() == 201
    row = ingest.latest(spark, root, 2).where("subject = 's3'").first()
    assert (row["corroboration"], row["confidence"], row["doc_ids"]) == (2, 0.75, [3, 7])
    ingest.merge_batch(second.limit(0), root, 2)
    assert ingest.latest(spark, root, 3).count() == 201


@pytest.mark.parametrize("cuts", [1, 3])
def test_impact_stream(spark, tmp_path, cuts):
    rows = [("E", "a", "x", "1", 1), ("E", "a", None, "1", 2), ("E", "a", "x", "1", 3), ("E", "a", "x", "2", 4), ("F", "a", "x", None, 5), ("E", "a", None, "3", 6)]
    got = streamed(spark, tmp_path, rows, "name string, subject string, object string, payload string, ord long", ingest.impact_stream, cuts, "impact")
    assert got == sorted([("E", "a", "x", "added", None, "1"), ("E", "a", None, "added", None, "1"), ("E", "a", "x", "changed", "1", "2"), ("F", "a", "x", "added", None, None), ("E", "a", None, "changed", "1", "3")], key=str)


def test_policy_facts_and_snapshots(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("rules:\n- name: r\n  trigger: {kind: relation, type: SUPPLIES_TO, change: [added]}\n  traverse:\n  - {relation: SUPPLIES_TO}\n  - {relation: HOLDS}\n")
    assert tuple(filings.load_policy(spark, str(tmp_path / "p.yaml")).first()) == ("r", "relation", "SUPPLIES_TO", "SUPPLIES_TO,HOLDS", ["added"])
    (tmp_path / "v.json").write_text('{"version": "2", "supersedes": "d1", "document": {"doc_id": "d2"}, "facts": [{"kind": "relation", "type": "S", "subject": "a", "object": "b", "qualifiers": {"z": "1", "period": "q"}}, {"kind": "entity", "label": "L", "key": "k", "props": {"p": "v"}}, {"kind": "entity", "label": "L", "key": "k2"}]}')
    got = [(r["name"], r["subject"], r["object"], r["period"], r["payload"]) for r in filings.scan_fact_set(spark, str(tmp_path / "v.json")).orderBy("ord").collect()]
    assert got == [("S", "a", "b", "q", "period=q;z=1"), ("L", "k", None, None, "p=v"), ("L", "k2", None, None, "")]
    (tmp_path / "s.json").write_text('{"source_systems": [{"system_id": "pms", "name": "P", "layer": "l", "trust_score": 88}], "bronze": [{"record_id": "r", "system_id": "pms", "entity_type": "Fund", "master_key": "m", "attributes": {"a": "1"}}]}')
    systems, bronze = filings.scan_medallion_seed(spark, str(tmp_path / "s.json"))
    assert systems.first()["trust_score"] == 88 and bronze.first()["attributes"] == {"a": "1"}
    filings.write_snapshot(spark, {"t": spark.range(5)}, str(tmp_path / "snap"))
    assert filings.scan_snapshot(spark, str(tmp_path / "snap"))["t"].count() == 5
    spark.range(1).write.mode("append").parquet(str(tmp_path / "snap" / "t" / "v00000001"))
    with pytest.raises(ValueError):
        filings.scan_snapshot(spark, str(tmp_path / "snap"))
