"""Text functions, ratios, chunks and the ingest flow against plain versions and stated values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fundloom.functions import ontology, ratios
from fundloom.functions import text as tf
from fundloom.operators import impact, ingestflow, mdm, onboard, risk, sets, textjobs, traversal


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_ratios_against_plain_versions():
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcd é") for _ in range(n))
    for _ in range(150):
        a, b = text(rnd.randint(0, 12)), text(rnd.randint(0, 30))
        assert ratios.common_subsequence(a, b) == plain_lcs(a, b)
        short, long = sorted((a, b), key=len)
        plain = lambda x, y: 2 * plain_lcs(x, y) / (len(x) + len(y)) if x or y else 1.0
        m = len(short)
        windows = {long[i : i + m] for i in range(len(long) - m + 1)} | {long[:k] for k in range(1, m)} | {long[-k:] for k in range(1, m)}
        want = max((plain(short, w) for w in windows), default=0.0) if short else float(not long)
        assert abs(ratios.partial_ratio(a, b) - want) < 1e-12
    assert ratios.token_set_ratio("fuzzy was a bear", "a bear fuzzy was") == 1.0 and ratios.token_set_ratio("red ring", "red ring north") == 1.0
    assert 0.4 < ratios.token_set_ratio("red ring", "red gear") < 1 and ratios.token_set_ratio("", "x") == 0.0


@pytest.mark.parametrize("said,band", [("highly dependent on a limited number", 3), ("we rely on others", 2), ("it may occur", 1), ("", 0), (None, 0)])
def test_severity(spark, said, band):
    assert one(spark, said, tf.severity_band) == band


def test_text_functions(spark):
    assert one(spark, "see <div class=x>", tf.looks_like_html) and not one(spark, "a < b", tf.looks_like_html)
    assert [one(spark, x, tf.detect_doc_type) for x in ("Form 10-K for 2020", "FORM10K", "def14a", "nothing")] == ["10-K", "10-K", "DEF 14A", "text"]
    assert one(spark, "INTERNAL USE ONLY: x", tf.detect_sensitivity) == "internal" and one(spark, "public", tf.detect_sensitivity) == "public"
    assert [one(spark, x, tf.is_table) for x in ("a|b|c\nd|e|f", "a\tb\tc", "a\tb\nc\td", "x\na|b|c\nd|e|f")] == [True, False, False, True]
    assert [one(spark, x, tf.is_heading) for x in ("Item 1A. Risk", "it is", "OVERVIEW OF US\\nmore", "# x", "(short)")] == [True, False, True, True, False]
    assert one(spark, "<html><head>h</head><p>a <b>b</b>c</p><script>x</script>d<br>e<!-- c --></html>", tf.strip_html) == "a bc\n\nd\n\ne"
    assert one(spark, "<p>AT&amp;T &amp;lt; caf&eacute; &#8364;5 &#x1F600;&#39;s &nosuch; &#0; &#55296; a&b &amp</p>", tf.strip_html) == "AT&T &lt; café €5 \U0001f600's &nosuch; \ufffd \ufffd a&b &amp"
    assert one(spark, None, tf.decoded) is None and one(spark, "", tf.decoded) == ""
    assert one(spark, "xx Item 1A yy", lambda c: tf.bounded_excerpt(c, ["risk factors", "item 1a"], 9)) == "Item 1A y"
    assert one(spark, " One two. Three", tf.first_sentence) == "One two."
    assert one(spark, "Not Stated", tf.norm_id) == "" and one(spark, "PROP-10 01", tf.norm_id) == "prop1001"
    assert one(spark, "2024-01-02 03:04:05", tf.iso_z) == "2024-01-02T03:04:05Z"


def plain_chunks(text, target, hard):
    """Paragraph by paragraph, as lists of lines."""
    paras, at = [], 0
    for part in re.split(r"(\n\s*\n)", text):
        if part.strip():
            paras.append((at, at + len(part)))
        at += len(part)
    done, open_, head = [], [], None
    size = lambda a, b: max(1, (b - a) // 4)
    for a, b in paras:
        lines = text[a:b].strip().splitlines()
        table = len(lines) > 1 and sum(x.count("|") > 1 or x.count("\t") > 1 for x in lines) >= max(2, len(lines) // 2)
        if re.match(tf.HEADING, lines[0]) and len(lines[0]) < 120:
            done, open_ = [*done, *([(open_, head)] if open_ else [])], []
            head = lines[0][:120]
        if table and open_ and size(open_[0][0], open_[-1][1]) + size(a, b) > hard:
            done, open_ = [*done, (open_, head)], []
        open_ = [*open_, (a, b)]
        if not table and size(open_[0][0], b) >= target:
            done, open_ = [*done, (open_, head)], []
    done += [(open_, head)] if open_ else []
    out = []
    for ps, h in done:
        body = text[ps[0][0] : ps[-1][1]].strip("\n")
        out.append((ps[0][0], ps[0][0] + len(body), h))
    return out


def test_chunks_against_a_plain_version(spark):
    rnd = random.Random(2)
    block = lambda: rnd.choice(["item 1. things", "a|b|c\nd|e|f\ng|h|i" * rnd.randint(1, 4), "some words here\nand more of them " * rnd.randint(1, 9), "x"])
    texts = ["", " \n \n", None, *["\n\n".join(block() for _ in range(rnd.randint(1, 14))) for _ in range(60)]]
    got = textjobs.chunk_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 40, 50).collect()
    for i, t in enumerate(texts):
        own = sorted((r["chunk"], r["start"], r["start"] + r["length"], r["heading"]) for r in got if r["doc_id"] == i)
        assert own == [(k, *x) for k, x in enumerate(plain_chunks(t or "", 40, 50), 1)]


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "child long, parent long")
    assert sets.closure(edges).count() == 210


def test_longest_exposure_path(spark):
    edges = spark.createDataFrame([(i, i + 1, f"c{i}", "named") for i in range(7)] + [(0, 3, None, "critical")], "src long, dst long, component string, criticality string")
    pairs = spark.createDataFrame([(0, 3), (0, 5), (0, 7), (1, 6), (1, 7), (3, 0)], "a long, b long")
    got = {(r["a"], r["b"]): (r["hops"], r["path"], r["labels"]) for r in traversal.exposure_paths(edges, pairs).collect()}
    assert got == {(0, 3): (1, "0>3", "critical"), (0, 5): (3, "0>3>4>5", "critical>c3>c4"), (0, 7): (5, "0>3>4>5>6>7", "critical>c3>c4>c5>c6"), (1, 6): (5, "1>2>3>4>5>6", "c1>c2>c3>c4>c5")}


RECORD = "cluster string, record_id int, system string, trust int, attribute string, value string"


def test_matching_and_survivorship(spark):
    rows = [("A", 1, "loan", 80, "name", "Harbour View Tower Ltd"), ("A", 2, "pms", 88, "name", "The Harbour View Tower"), ("A", 3, "curated", 95, "name", "Other House"), ("B", 4, "pms", 88, "name", "Alone"), ("A", 1, "loan", 80, "id", "P-1"), ("A", 3, "curated", 95, "id", "p1"), ("A", 1, "loan", 80, "address", "1 A St SW1A 1AA"), ("A", 2, "pms", 88, "address", "1 Avenue Street, London, England"), ("A", 1, "loan", 80, "area", "none"), ("A", 2, "pms", 88, "area", "n")]
    df = spark.createDataFrame(rows, RECORD)
    pairs = {(r["a"], r["b"]): r["score"] for r in mdm.pairwise_match(df, "name", "none", "id").collect()}
    assert pairs[1, 2] == 1.0 and pairs[1, 3] == pytest.approx(0.75 + 0.25 * (1 + ratios.token_set_ratio("harbour view tower", "other house")) / 2, abs=1e-6)
    conf = {r["cluster"]: (r["confidence"], r["resolved"]) for r in mdm.match_confidence(df, mdm.pairwise_match(df, "name", "none", "id")).collect()}
    assert conf["B"] == (1.0, True) and conf["A"][1] is (conf["A"][0] >= 0.88)
    best = {r["attribute"]: r["value"] for r in mdm.survive_most_complete(df).collect() if r["cluster"] == "A"}
    assert best["address"] == "1 A St SW1A 1AA"
    area = mdm.survive_numeric_tolerance(df.where("attribute = 'area'"), "curated", 1.0).first()
    assert (area["value"], area["agree"]) == ("n", None)


def test_hhi_words(spark):
    holds = spark.createDataFrame([("a", "x", 16.0), ("b", "x", 10.5), ("b", "y", 10.5)], "fund string, company string, weight_pct double")
    got = {r["fund"]: (r["band"], r["interpretation"]) for r in risk.hhi_vs_average(holds, spark.createDataFrame([("a", 1), ("b", 1)], "fund string, firm int")).collect()}
    assert got["a"] == ("more", "Highly concentrated — HHI 256 over 1 holdings, top position 16.0%. ~1.1x more concentrated than the firm average.")
    assert got["b"][0] == "less" and got["b"][1].startswith("Moderately concentrated")


CHUNKS = [("d1_c1", "d1", "NVIDIA Corporation depends on  TSMC for chips, a lot. More text follows here."), ("d1_c2", "d1", "Apple Inc supplies nobody.")]


def test_grounding_gate(spark):
    spans = [("d1_c1", "nvidia corporation DEPENDS on tsmc"), ("d1_c1", "NVIDIA Corporation depend on TSMC for chip, a lot"), ("d1_c1", "Intel depends on somebody else entirely"), ("d1_c2", ""), ("d1_c2", None), ("gone", "Apple")]
    got = ingestflow.grounding_gate(spark.createDataFrame(spans, "chunk_id string, span string"), spark.createDataFrame(CHUNKS, "chunk_id string, doc_id string, text string")).collect()
    assert {(r["chunk_id"], r["span"]): r["grounded"] for r in got} == {spans[0]: True, spans[1]: True, spans[2]: False, spans[3]: False, spans[4]: False, spans[5]: False} and len(got) == 6


def test_ingest_flow(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, doc_id string, text string")
    e = [("d1", "d1_c1", 1, "Company", "NVIDIA Corporation", "NVIDIA Corporation"), ("d1", "d1_c1", 2, "Company", "TSMC", "TSMC"), ("d1", "d1_c1", 3, "Company", "Intel", "Intel makes chips that are sold elsewhere"), ("d1", "d1_c2", 4, "Company", "Nvidia Corp", "Apple Inc"), ("d1", "d1_c2", 5, "Person", "Ann", "supplies")]
    r = [("d1", "d1_c1", 1, "SUPPLIES_TO", "NVIDIA Corporation", "TSMC", "depends on TSMC", 0.9), ("d1", "d1_c1", 2, "SUPPLIES_TO", "NVIDIA Corporation", "TSMC", "depends on TSMC", 0.3), ("d1", "d1_c2", 3, "SUPPLIES_TO", "Nvidia Corp", "TSMC", "Apple Inc supplies", 0.8), ("d1", "d1_c2", 4, "SUPPLIES_TO", "Ann", "TSMC", "never written at all", 0.8)]
    spine = spark.createDataFrame([("0000000001", "NVDA", "NVIDIA CORP", 1)], "cik string, ticker string, title string, ord long")
    spec = spark.createDataFrame([("SUPPLIES_TO", ["Company"], ["Company"])], "rel string, domain array<string>, range array<string>")
    old = spark.createDataFrame([], "subject string, rel string, object string, corroboration long")
    out = ingestflow.ingest_documents(spark.createDataFrame(e, "doc_id string, chunk_id string, ord long, label string, name string, span string"), spark.createDataFrame(r, "doc_id string, chunk_id string, ord long, rel string, subject string, object string, span string, confidence double"), chunks, spine, old, spec)
    assert {(x["name"], x["canonical"]) for x in out["canonical"].collect()} == {("NVIDIA Corporation", "Nvidia Corp"), ("Nvidia Corp", "Nvidia Corp"), ("TSMC", "TSMC")}
    assert {(x["ord"], x["decision"], x["corroboration"]) for x in out["decisions"].collect()} == {(1, "insert", 1), (2, "reject", 0), (3, "corroborate", 2)}
    assert ingestflow.extraction_counts(out["counts"]).first()[1:] == (2, 4, 3, 2, 2, 1)
    assert {(x["chunk_id"], x["entity"]) for x in out["mentions"].collect()} == {("d1_c1", "Nvidia Corp"), ("d1_c1", "TSMC"), ("d1_c2", "Nvidia Corp"), ("d1_c2", "Ann")}
    assert out["rejected"].first()["reason"] == "low confidence"


def test_unknown_traversal_is_an_error(spark):
    with pytest.raises(NotImplementedError):
        impact.trigger_match(spark.createDataFrame([], "kind string, name string, change string"), [("r", "entity", "X", "SIDEWAYS", ["added"])])


def test_ontology(spark):
    df = spark.createDataFrame([(1,)], "x int").select(ontology.pairs_to_map(F.expr("array(struct('a' as key, '1' as value), struct('a' as key, '2' as value), struct('b' as key, null as value))")).alias("m"))
    assert df.first()["m"] == {"a": "2", "b": None}
    prefixes = {"p": "http://x/", "q": "http://x/y/"}
    assert one(spark, "http://x/y/Z", lambda c: ontology.curie_of(c, prefixes)) == "q:Z" and one(spark, "q:Z", lambda c: ontology.iri_of(c, prefixes)) == "http://x/y/Z" and one(spark, "r:Z", lambda c: ontology.iri_of(c, prefixes)) == "r:Z"


def test_names_and_scores(spark):
    df = spark.createDataFrame([("Vanguard Group", "vanguard"), ("Fidelity", "Vanguard"), ("", "x"), ("BlackRock Fund", "BlackRock Funds")], "a string, b string")
    assert [r["m"] for r in df.select(onboard.names_match(F.col("a"), F.col("b")).alias("m")).collect()] == [True, False, False, True]


def test_item_sections(spark):
    """As a loop over lines does it."""
    text = "intro\nItem 1. Business\nwe do\n\n  ITEM 1A Risk\r\nmay fail\x0bItem 7: talk\n \nitem 12. no item\nitem 1 again"
    rows = [(1, text), (2, None), (3, "no items"), (4, "Item 7.\n"), (5, "Item 1:"), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as lines", "2 as marks")

    def plain(text, wanted):
        lines, marks = (text or "").splitlines(), []
        for i, x in enumerate(lines):
            marks += [(i, k) for k, heads in sets.ITEM_HEADS.items() if any(x.strip().lower().startswith(h) for h in heads)]
        parts = ["\n".join(lines[i : (marks[n + 1][0] if n + 1 < len(marks) else len(lines))]).strip() for n, (i, k) in enumerate(marks) if k in wanted]
        return "\n\n".join(p for p in parts if p)

    for asked, wanted in ((["1A", "Item 7"], {"1a", "7"}), (["1"], {"1"}), (["item 1a"], {"1a"})):
        got = {r["doc_id"]: r["text"] for r in sets.item_sections(df, asked).collect()}
        assert got == {i: t for i, x in rows if (t := plain(x, wanted))}
