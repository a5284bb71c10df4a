"""The acceptance numbers of the small fund graph."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fundloom.operators import disclosure, impact, mdm, risk, steward, traversal

GF = {"NVIDIA": 11.5, "Microsoft": 9.0, "Apple": 7.5, "Amazon": 7.0, "Meta": 5.5, "Broadcom": 5.0, "Lilly": 4.5, "AMD": 3.5, "TSMC": 2.5}
FF = {"NVIDIA": 16.0, "Microsoft": 12.0, "Apple": 9.0, "Amazon": 8.5, "Broadcom": 7.5, "Meta": 6.5, "Lilly": 6.0, "AMD": 5.0}
RISKS = {"NVIDIA": ["supply_chain", "customer_concentration", "geopolitical", "technology"], "AMD": ["supply_chain", "technology"], "Apple": ["supply_chain", "regulatory"], "Broadcom": ["supply_chain"], "TSMC": ["supply_chain", "geopolitical"], "Microsoft": ["regulatory"]}


@pytest.fixture(scope="module")
def graph(spark):
    day = dt.date(2026, 5, 31)
    rows = [("GF", c, w, w * 80e6, day) for c, w in GF.items()] + [("FF", c, w, w * 30e6, day) for c, w in FF.items()]
    t = {"holds": spark.createDataFrame(rows, "fund string, company string, weight_pct double, value_usd double, as_of date")}
    t["supplies"] = spark.createDataFrame([(a, "TSMC", "critical", f"part{i}") for i, a in enumerate(["NVIDIA", "AMD", "Apple", "Broadcom"])] + [("TSMC", "ASML", "critical", "litho")], "src string, dst string, criticality string, component string")
    t["exposed"] = spark.createDataFrame([(c, r, "may") for c, rs in RISKS.items() for r in rs], "company string, risk_title string, severity string")
    t["factor"] = spark.createDataFrame([(r, r) for r in {x for v in RISKS.values() for x in v}], "title string, category string")
    t["fund"] = spark.createDataFrame([("GF", "S1"), ("FF", "S2")], "fund string, series_id string")
    covers = [("GF", "S1", r) for r in ("technology", "customer_concentration", "regulatory")] + [("FF", "S2", r) for r in ("technology", "customer_concentration")]
    t["covers"] = spark.createDataFrame([(f, f"{s}:485BPOS", f"{s}:485BPOS|{r}", r) for f, s, r in covers], "fund string, form_ref string, section_key string, risk_title string")
    return t


def test_concentration(graph):
    assert {r["fund"]: r["hhi"] for r in risk.portfolio_hhi(graph["holds"]).collect()} == {"GF": 412.5, "FF": 712.75}
    assert risk.fund_comparison(graph["holds"]).first()["mean_hhi"] == 562.625
    got = {(r["fund"], r["supplier"]): r["score"] for r in risk.supplier_concentration(graph["holds"], graph["supplies"]).collect()}
    assert got == {("GF", "TSMC"): 27.5, ("GF", "ASML"): 2.5, ("FF", "TSMC"): 37.5}


def test_heatmap_and_chokepoints(graph):
    mass = {r["category"]: r["mass"] for r in risk.risk_heatmap(graph["holds"], graph["exposed"], graph["factor"]).where("fund = 'GF'").collect()}
    assert mass == {"supply_chain": 30.0, "regulatory": 16.5, "technology": 15.0, "geopolitical": 14.0, "customer_concentration": 11.5}
    got = {(r["fund"], r["node"]): (r["n_reachers"], r["n_two_hop"]) for r in traversal.second_order_chokepoints(graph["holds"], graph["supplies"]).collect()}
    assert got[("GF", "ASML")] == (5, 4)


def test_gaps(graph):
    gap = disclosure.coverage_gap(graph["holds"], graph["exposed"], graph["covers"], graph["fund"]).collect()
    assert {r["risk_title"] for r in gap if r["fund"] == "GF"} == {"geopolitical", "supply_chain"}
    assert {r["risk_title"] for r in gap if r["fund"] == "FF"} == {"geopolitical", "supply_chain", "regulatory"}


def test_coverage(spark, graph):
    mentions = spark.createDataFrame([("n", "NVIDIA"), ("n", "TSMC"), ("t", "ASML")], "doc_id string, company string")
    document = spark.createDataFrame([("n", dt.date(2026, 2, 26))], "doc_id string, filing_date date")
    got = risk.source_coverage(risk.holding_provenance(graph["holds"], mentions, document)).where("fund = 'GF'").first()
    assert (got["total_weight"], got["covered_weight"], got["coverage_pct"]) == (56.0, 14.0, 25.0)


def test_empty_inputs(graph):
    none = graph["holds"].limit(0)
    assert risk.portfolio_hhi(none).count() == 0 and risk.supplier_concentration(none, graph["supplies"]).count() == 0
    assert traversal.chokepoints_not_held(none, graph["supplies"]).count() == 0 and risk.fund_comparison(none).count() == 0


def test_fact_diff(spark):
    v1 = spark.createDataFrame([("S", "N", "T", None, "a", 1), ("E", "N", "C", None, "x", 1), ("E", "N", "C", None, "y", 2), ("R", "a", "b", "q", "z", 1)], "rel string, s string, o string, period string, payload string, ord int")
    v2 = spark.createDataFrame([("S", "N", "T", None, "a", 1), ("S", "N", "H", None, "a", 1), ("E", "N", "C", None, "z", 1)], v1.schema)
    got = {(r["rel"], r["o"]): (r["change"], r["old_value"], r["new_value"]) for r in impact.fact_diff(v1, v2, ["rel", "s", "o", "period"]).collect()}
    assert got == {("S", "H"): ("added", None, "a"), ("E", "C"): ("changed", "y", "z"), ("R", "b"): ("removed", "z", None)}


@pytest.mark.parametrize("raw,want", [("NVIDIA Corp.", "nvidia"), ("The Coca-Cola Company", "coca cola"), ("AT&T Inc", "at t"), ("  Eli   Lilly & Co ", "eli lilly"), ("Eli Lilly and Company", "eli lilly"), ("Marvell Technology Class A", "marvell technology a"), ("Bank of N.V.", "bank n v"), ("", "")])
def test_names(spark, raw, want):
    assert spark.range(1).select(steward.normalize_name(F.lit(raw)).alias("n")).first()["n"] == want


def test_golden_property(spark):
    rows = [("P", 1, "loan", 80, "id", "PROP1001"), ("P", 2, "pms", 88, "id", "PROP-1001"), ("P", 3, "pdf", 86, "id", "HVT-001"), ("P", 4, "curated", 95, "id", "Not Stated")]
    got = mdm.survive_crosswalk(spark.createDataFrame(rows, "cluster string, record_id int, system string, trust int, attribute string, value string"), "pms").first()
    assert (got["value"], got["alternates"]) == ("PROP-1001", "HVT-001,PROP1001")


def test_rerun_and_repartition_give_the_same(graph):
    a = risk.supplier_concentration(graph["holds"], graph["supplies"]).collect()
    b = risk.supplier_concentration(graph["holds"].repartition(7), graph["supplies"].repartition(5)).collect()
    assert sorted(a) == sorted(b)
