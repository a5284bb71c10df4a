"""That work grows with the input: what is made on the way, not only what comes out."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fundloom import registry
from fundloom.functions import ratios
from fundloom.graphmodel import Graph
from fundloom.operators import align, evidence, impact, ingestflow, reports, risk, rules, sets, textjobs, traversal
from fundloom.plans import flow_queries, source_queries
from fundloom.streaming import ingest


@pytest.mark.parametrize("most", [1, 2, 3, 4, 5])
def test_paths_go_half_the_way(spark, monkeypatch, most):
    rnd, depths = random.Random(most), []
    edges = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(70)} | {(0, k) for k in range(1, 30)} | {(k, 39) for k in range(10, 35)}
    far, best = traversal.paths_from, {}
    monkeypatch.setattr(traversal, "LIST", 4)
    monkeypatch.setattr(traversal, "paths_from", lambda *a: depths.append(a[-1]) or far(*a))
    for a in range(40):
        at = {a: (a,)}
        for _ in range(most):
            at = {v: min(p + (v,) for u, p in at.items() if (u, v) in edges) for v in {v for u, v in edges if u in at}}
            for b, p in at.items():
                best.setdefault((a, b), p)
    pairs = [(a, b) for a in range(40) for b in range(0, 40, 3)]
    asked = spark.createDataFrame(pairs, "a long, b long")
    table = spark.createDataFrame([(*e, None, "named") for e in edges], "src long, dst long, component string, criticality string")
    got = traversal.exposure_paths(table, asked, most).collect()
    assert {(r["a"], r["b"]): r["path"] for r in got} == {k: ">".join(map(str, best[k])) for k in pairs if k in best and k[0] != k[1]}
    assert max(depths) <= max(most // 2, 1)


def test_halves_of_paths_keep_what_is_between(spark, monkeypatch):
    """Not whole paths, nor sorted to find the least; edges are worked out once."""
    plans, put = [], traversal.written
    monkeypatch.setattr(traversal, "written", lambda df, name: plans.append((name, df.columns, df._jdf.queryExecution().executedPlan().toString())) or put(df, name))
    table = spark.createDataFrame([(k, (k * k + 1) % 23, "c", None) for k in range(23)] + [(k, k + 1, None, "x") for k in range(22)], "src long, dst long, component string, criticality string")
    got = traversal.exposure_paths(table, spark.createDataFrame([(0, 5), (3, 20)], "a long, b long"))
    halves = [(c, p) for name, c, p in plans if name in ("paths-from", "paths-into")]
    assert len(halves) == 4 and all(c[1:] == ["at", "via"] and "SortAggregate" not in p for c, p in halves)
    assert [name for name, *_ in plans].count("path-edges") == 1 and "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 2


def test_identities_share_a_worker_call(spark, tmp_path):
    schema = "name string, subject string, object string, payload string, ord long"
    for k in range(2):
        spark.createDataFrame([("E", f"s{i}", None if i % 3 else "o", str(i % (k + 2)), i + 1000 * k) for i in range(300)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        rows = ingest.impact_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), groups=3)
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = [("E", f"s{i}", None if i % 3 else "o", "added", None, str(i % 2)) for i in range(300)] + [("E", f"s{i}", None if i % 3 else "o", "changed", str(i % 2), str(i % 3)) for i in range(300) if i % 2 != i % 3]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_spans_are_looked_up_once(spark, monkeypatch):
    calls, fitting = [], align.fitting
    monkeypatch.setattr(align, "fitting", lambda *a: calls.append(1) or fitting(*a))
    registry.QUERIES["build_triples"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_spans_stay_behind_the_gate(spark, monkeypatch):
    """No stage after it carries them, and rejected facts are the same with or without them."""
    tables, put = {}, ingestflow.written
    monkeypatch.setattr(ingestflow, "written", lambda df, name: tables.setdefault(name, df) and put(df, name))
    flow = flow_queries.ingested(Graph(spark, "/root/testdata/sf0.001"))
    assert "span" not in {c for name in ("claims", "decisions", "canonical") for c in flow[name].columns} and "span" in flow["triples"].columns
    assert {"ingest-entities", "ingest-relations", "ingest-triples"} <= tables.keys() and all("span" not in tables[k].columns for k in ("ingest-entities", "ingest-relations", "ingest-triples"))
    plain = ingestflow.write_rejected(flow["claims"], flow["decisions"])
    full = flow["rejected"]
    assert full.columns == ["fact_id", "reason", "span", "doc_id", "confidence"] and plain.count() > 0
    assert sorted(map(tuple, full.drop("span").collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("own_row", [0, 1_000_000])
def test_pieces_in_the_row_lose_nothing(spark, monkeypatch, own_row):
    monkeypatch.setattr(align, "OWN_ROW", own_row)
    rnd, every = random.Random(own_row), []
    for _ in range(600):
        text = "".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 90)))
        span = list(text[rnd.randint(0, len(text) // 2) :] or "x")
        for _ in range(rnd.randint(0, 4)):
            span[rnd.randrange(len(span))] = rnd.choice(["", "z", "ab"])
        every.append(("".join(span), text))
    got = {tuple(r) for r in align.fitting(spark.createDataFrame(every, "s string, c string"), 0.9).collect()}
    assert got == {(s, c) for s, c in every if s and c and ratios.partial_ratio(s, c, 0.9) >= 0.9}


def test_large_funds_file_in_parts(spark, monkeypatch):
    folders, new = [], source_queries.new_folder
    monkeypatch.setattr(source_queries, "new_folder", lambda *a: folders.append(new(*a)) or folders[-1])
    monkeypatch.setattr(source_queries, "FILED", 7)
    run = lambda q: sorted(map(str, registry.QUERIES[q](spark, "/root/testdata/sf0.001").collect()))
    parts = [run(q) for q in ("scan_nport", "scan_nport_funds", "nport_totals")]
    assert spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(folders[0]).count() > 50
    monkeypatch.setattr(source_queries, "FILED", 10_000)
    assert parts == [run(q) for q in ("scan_nport", "scan_nport_funds", "nport_totals")]


def test_facts_are_not_dealt_by_property(spark):
    """A property has most facts, so a task that got them all would grow with the data."""
    rnd = random.Random(3)
    known = [(f"s{i}", "HOLDS" if i % 50 else "PART_OF", f"o{rnd.randrange(99)}") for i in range(3000)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        facts = spark.createDataFrame(known, "s string, p string, o string")
        of = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
        said = rules.from_single_facts(facts, of([("HOLDS", "RELATED")], "child parent"), of([("HOLDS", "HELD_BY"), ("HELD_BY", "HOLDS")], "p q"))
        paths = rules.paths_to_close(facts, facts, of([("PART_OF",), ("NEAR",)], "p"))
        ends = rules.types_of_ends(facts, of([("HOLDS", "Fund")], "p cls"), of([("HOLDS", "Company")], "p cls"))
        sizes = [[len(x) for x in df.rdd.glom().collect()] for df in (said, ends, paths)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    held = sum(p == "HOLDS" for _, p, _ in known)
    assert [sum(x) for x in sizes] == [2 * held, 2 * held, len(known) - held] and all(max(x) < sum(x) / 2 for x in sizes)


def test_single_suppliers_are_counted_once_for_all_funds(spark, monkeypatch):
    calls, meet = [], risk.holding_suppliers
    monkeypatch.setattr(risk, "holding_suppliers", lambda *a: calls.append(1) or meet(*a))
    holds = spark.createDataFrame([(f, c) for f in (1, 2, None) for c in range(5)] + [(1, 0)], "fund long, company long").withColumn("weight_pct", F.lit(1.0))
    edges = [(0, 9, "a", "critical"), (0, 9, "a", "named"), (0, 8, "b", "named"), (1, 9, None, "critical"), (1, 8, "", "critical"), (2, 7, None, "critical"), (2, None, "", "named"), (None, 9, "a", "critical"), (3, 6, "c", None)]
    got = [tuple(r) for r in risk.single_source_flags(holds, spark.createDataFrame(edges, "src long, dst long, component string, criticality string")).collect()]
    assert sorted(got, key=str) == sorted([(f, *x) for f in (1, 2, None) for x in ((0, "a", 9), (2, "", 7))], key=str) and not calls


def test_risks_are_made_one_row_before_funds_meet_them(spark, monkeypatch):
    """Holdings and edges that stand twice give what they gave when all that met was told apart afterwards."""
    calls, rnd = [], random.Random(5)
    for name in ("holding_suppliers", "fund_exposures"):
        monkeypatch.setattr(risk, name, lambda *a, name=name: calls.append(name))
    held = [(rnd.randrange(3), rnd.randrange(12), rnd.choice([0.5, 1.25, 3.000001])) for _ in range(40)]
    edges = [(rnd.randrange(12), rnd.randrange(6), rnd.choice(["a", "b", None]), rnd.choice(["critical", "named", "mentioned", "rumoured"])) for _ in range(60)]
    shown = [(rnd.randrange(12), f"r{rnd.randrange(5)}") for _ in range(30)]
    of = {f"r{k}": "xyz"[k % 3] for k in range(5)}
    holds, supplies = spark.createDataFrame(held, "fund long, company long, weight_pct double"), spark.createDataFrame(edges, "src long, dst long, component string, criticality string")
    exposed, factors = spark.createDataFrame(shown, "company long, risk_title string"), spark.createDataFrame(list(of.items()), "title string, category string")
    score, n_edges, members, parts, heat = defaultdict(int), defaultdict(int), defaultdict(set), defaultdict(set), defaultdict(dict)
    critical = defaultdict(set)
    for f, c, w in held:
        for s, d, part, kind in edges:
            m = {"critical": 100, "named": 50, "mentioned": 20}.get(kind, 0)
            if s == c and m:
                score[f, d] += round(w * 1e6) * m
                n_edges[f, d] += 1
                members[f, d].add(c)
            if s == c and kind == "critical":
                critical[f, d].add(c)
                parts[f, d] |= {part} - {None}
        for c2, r in shown:
            if c2 == c:
                heat[f, of[r]][c] = max(w, heat[f, of[r]].get(c, 0))
    got = {(r["fund"], r["supplier"]): (r["score"], r["n_holdings"], r["n_edges"]) for r in risk.supplier_concentration(holds, supplies).collect()}
    assert got == {k: (pytest.approx(v / 1e8, abs=1e-6), len(members[k]), n_edges[k]) for k, v in score.items()}
    got = {(r["fund"], r["supplier"]): (r["n_members"], r["components"]) for r in risk.shared_supplier_clusters(holds, supplies).collect()}
    assert got == {k: (len(v), ",".join(sorted(parts[k]))) for k, v in critical.items() if len(v) > 1}
    assert {(r["fund"], r["supplier"]): r["n_holders"] for r in risk.shared_suppliers(holds, supplies).collect()} == {k: len(v) for k, v in critical.items()}
    got = {(r["fund"], r["category"]): (r["mass"], r["n_companies"]) for r in risk.risk_heatmap(holds, exposed, factors).collect()}
    assert got == {k: (pytest.approx(sum(v.values())), len(v)) for k, v in heat.items()} and not calls


def test_a_report_names_the_largest_positions(spark):
    """Of a fund's holdings only the four that are named are brought together."""
    holds = spark.createDataFrame([(1, c, float(c % 50)) for c in range(500)], "fund long, company long, weight_pct double")
    report = spark.createDataFrame([(1, 1.0, 500, 9.0, 1.0, None, None, 0)], "fund long, hhi double, n_holdings long, total_weight double, covered_pct double, top_supplier long, top_category string, n_flags long")
    out = reports.report_sections(report, holds, spark.createDataFrame([], "fund long, category string"))
    assert "Largest positions: 49 49.00%, 99 49.00%, 149 49.00%, 199 49.00%." in {r["heading"]: r["body"] for r in out.collect()}["Portfolio concentration"]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_a_filing_is_cut_once(spark):
    rows = [(1, "\n".join(f"Item {'1A' if i % 2 else '7.'} x{i}\n\t y" for i in range(2000))), (2, "item 8"), (3, None)]
    out = sets.item_sections(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "concat(text, '') as text"), ["1A"])
    assert [tuple(r) for r in out.collect()] == [(1, "\n\n".join(f"Item 1A x{i}\n\t y" for i in range(1, 2000, 2)))]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


@pytest.mark.parametrize("small", [200_000, 1])
def test_places_are_not_counted_from_the_start_of_a_text(spark, small):
    rnd = random.Random(small)
    words = [f"w{rnd.randrange(10**rnd.randint(1, 4))}" for _ in range(3000)]
    text = "".join(w + rnd.choice([" ", "  ", ", "]) for w in words)
    known = {w: k for k, w in enumerate(dict.fromkeys(words)) if len(w) >= 3}
    out = textjobs.detect_mentions(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string"), spark.createDataFrame(list(known.items()), "alias string, canonical long"), small)
    assert {(r["doc_id"], r["canonical"]): r["first_pos"] for r in out.collect()} == {(1, k): re.search(rf"\b{w}\b", text).start() for w, k in known.items()}
    assert not re.search(r"slice\(w#\d+, 1, \(own", out._jdf.queryExecution().optimizedPlan().toString()) or small == 1
    assert "starts" in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("small", [2_000_000, 1])
def test_words_of_all_funds_meet_no_fund(spark, small):
    names = {k: f"the fund {' '.join(random.Random(k).sample(['alpha', 'beta', 'gamma', 'delta', 'omega'], 1 + k % 3))}" for k in range(40)}
    said = {i: " ".join(random.Random(i + 99).sample(["the", "fund", "alpha", "beta", "gamma", "delta", "xxx", "of"], 1 + i % 4)) for i in range(80)} | {900: None, 901: "The"}
    out = textjobs.detect_fund(spark.createDataFrame(list(said.items()), "question long, text string"), spark.createDataFrame(list(names.items()), "fund long, name string"), small)
    want = {}
    for q, t in said.items():
        words = {w for w in (t or "").lower().split() if len(w) > 2}
        met = [(len(words & set(n.split()) - {"the", "fund"}), -len(n.split()), -f) for f, n in names.items() if words & set(n.split())]
        want |= {q: -max(met)[2]} if met else {}
    assert {r["question"]: r["fund"] for r in out.collect()} == want
    counted = textjobs.detect_fund(spark.createDataFrame([(i, "the fund") for i in range(50)], "question long, text string"), spark.createDataFrame(list(names.items()), "fund long, name string"), small)
    assert counted.count() == 50 and "shared" not in counted._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_briefings_take_each_holding_once(spark, seed):
    """The same as over all pairs of a change and what depends on it, without making them."""
    rnd = random.Random(seed)
    ids = [str(k) for k in range(0, 60, 2)] + ["007", " 8", "+10", "x", "", None]
    said = [("r", t, rnd.choice(ids), None, k) for k in range(14) for t in [rnd.choice(["HOLDS", "SUPPLIES_TO,HOLDS", "COVERS"])]] + [("r2", "SUPPLIES_TO,HOLDS", "007", "a", 1), ("r2", "HOLDS", "4", None, 1)]
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(70)] + [(5, 5), (5, 7), (7, 5), (None, 4), (4, None)]
    held = [(rnd.randrange(6), rnd.randrange(60), k / 7) for k in range(90)]
    held = list({h[:2]: h for h in held}.values()) + [(None, 4, 1.0), (3, None, 1.0)]
    matched = spark.createDataFrame(said, "rule string, traversal string, subject string, object string, ord long")
    supplies, holds = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(held, "fund long, company long, weight_pct double")
    asked = matched.where("traversal = 'SUPPLIES_TO,HOLDS'").select(F.col("subject").try_cast("long").alias("company"))
    covers, derived = spark.createDataFrame([], "risk_title string, section_key string"), spark.createDataFrame([], "report_id string, kind string, target string")
    pairs = impact.propagate(matched, holds, traversal.supplier_dependents(supplies, asked), covers, derived)
    once = impact.holdings_reached(matched, holds, traversal.dependents_of_any(supplies, asked))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert once.columns == ["target_kind", "target", "via", "held"] and rows(once.select("target", "held")) == rows(pairs.select("target", "held").distinct())
    assert rows(reports.impact_briefings(once, holds)) == rows(reports.impact_briefings(pairs, holds)) and once.count() < pairs.count()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reach_is_counted_and_listed_without_pairs_of_paths(spark, monkeypatch, seed):
    rnd = random.Random(seed)
    monkeypatch.setattr(traversal, "LIST", 3)
    ids = [str(k) for k in range(0, 60, 2)] + ["007", " 8", "+10", "x", "", None]
    said = [(rnd.choice("rst"), rnd.choice(impact.TRAVERSALS), rnd.choice(ids), rnd.choice("abcd"), k % 9) for k in range(60)] + [("r", "SUPPLIES_TO,HOLDS", "4", None, 1), ("r", "HOLDS", "4", None, 1)]
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(70)] + [(5, 5), (5, 7), (7, 5), (None, 4), (4, None)]
    held = {(rnd.randrange(100), rnd.randrange(60)) for _ in range(90)} | {(None, 4), (3, None)}
    matched = spark.createDataFrame(said, "rule string, traversal string, subject string, object string, ord long")
    supplies, holds = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(sorted(held, key=str), "fund long, company long")
    asked = matched.where("traversal = 'SUPPLIES_TO,HOLDS'").select(F.col("subject").try_cast("long").alias("company"))
    covers = spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "2"), ("b", "2"), ("c", "3"), (None, "3"), ("z", "4"), ("d", None)], "risk_title string, section_key string")
    derived = spark.createDataFrame([(f"pack_{k % 3}", "Document", str(k)) for k in range(8)], "report_id string, kind string, target string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    pairs = impact.propagate(matched, holds, traversal.supplier_dependents(supplies, asked), covers, derived)
    want, counts = rows(pairs), rows(impact.impact_rollup(pairs))
    assert len({w[1] for w in want}) == 3
    for name in ("propagate", "reach_min_hops", "supplier_dependents"):
        monkeypatch.setattr(impact if name == "propagate" else traversal, name, None)
    assert rows(impact.propagate_along(matched, holds, supplies, covers, derived)) == want
    assert rows(impact.rollup(matched, holds, supplies, covers, derived)) == counts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chokepoints_are_counted_where_holdings_meet(spark, monkeypatch, seed):
    """As over all pairs of a holding and what it reaches, with funds of several parts, loops and ties."""
    rnd = random.Random(seed)
    monkeypatch.setattr(traversal, "LIST", 3)
    monkeypatch.setattr(traversal, "fund_reach", None)
    edges = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(60)} | {(5, 5), (5, 7), (7, 5), (None, 4), (4, None)}
    held = {(rnd.randrange(90), rnd.randrange(40)) for _ in range(260)} | {(None, 4), (3, None)}
    out, step = defaultdict(set), {(a, b) for a, b in edges if a is not None and b is not None}
    for a, b in step:
        out[a].add(b)
    want = []
    for fund in {f for f, _ in held} - {None}:
        own = {c for f, c in held if f == fund}
        near = {c: out[c] | {z for y in out[c] for z in out[y]} - {c} for c in own - {None}}
        n = Counter(v for c, vs in near.items() for v in vs - own - {c})
        if n:
            top = min(n, key=lambda v: (-n[v], v))
            want += [(fund, f"{c} → … → {top}", f"{c}-SUPPLIES_TO*1..2-{top}") for c, vs in near.items() if top in vs and top != c]
    got = evidence.chokepoint_paths(spark.createDataFrame(sorted(held, key=str), "fund long, company long"), spark.createDataFrame(sorted(edges, key=str), "src long, dst long"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len({w[0] for w in want}) > 64


@pytest.mark.parametrize("query,n", [("impact_briefings", 25), ("impact_event", 1)])
def test_no_pairs_of_changes_and_holdings(spark, monkeypatch, query, n):
    calls = []
    for of, name in ((impact, "propagate"), (traversal, "supplier_dependents"), (traversal, "reach_min_hops")):
        monkeypatch.setattr(of, name, lambda *a, name=name, real=getattr(of, name): calls.append(name) or real(*a))
    assert registry.QUERIES[query](spark, "/root/testdata/sf0.001").count() == n and not calls


def test_versions_meet_in_one_grouping(spark):
    rnd = random.Random(11)
    rows = [[(rnd.choice(["E", "R"]), rnd.choice(["a", "b", "c", None]), rnd.choice(["x", "y", None]), rnd.choice(["p", "q", None]), k) for k in rnd.sample(range(100), 20)] for _ in range(2)]
    v1, v2 = (spark.createDataFrame(r, "kind string, s string, o string, payload string, ord long") for r in rows)
    out = impact.fact_diff(v1, v2, ["kind", "s", "o"], carry="ord")
    last = [{r[:3]: r[3:] for r in sorted(v, key=lambda r: r[4])} for v in rows]
    want = []
    for k in last[0].keys() | last[1].keys():
        a, b = (v.get(k) for v in last)
        change = "added" if a is None else "removed" if b is None else "changed" if a[0] != b[0] else None
        want += [(*k, change, a and a[0], b and b[0], (b or a)[1])] if change else []
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str) and {"added", "removed", "changed"} == {w[3] for w in want}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
