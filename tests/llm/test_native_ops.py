"""Brute-force versions on small fixtures with nulls, ties, repeats, empty tables and extra columns."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from fundloom.llm import chat, decontaminate, neardup, quality, secrets, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = r"[^\x20\x09-\x0D]+"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


KEYS = "AKIA" + "B7" * 8
TEXTS = [
    None, "", "   \n\t ", "plain words only", f"é password = 'hunter2hunter' and {KEYS}", "token=secret: longvalue123 tail",
    "api_key: abc12 user=root https://db.example.com/x", "apikey=abc12 nobody near", "x" * 500 + " AKIA12345 " + "0f" * 20 + " 日本 token:12345678",
    "a1b2c3d4e5f60718293a " + "z " * 300 + " login: bob", "password=aaaaaaaa" * 40, "SECRET==abcdefgh; Token = short", "AKIAAKIA12345678901 ffffffffffffffffffffffffffffffffF",
]


def base_spans(text):
    out = []
    for m in re.finditer(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text or ""):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, "assign", m.end()))
    for k, (kind, p, least) in enumerate([("access", r"AKIA[A-Z0-9]+", 16), ("hex", r"[0-9a-f]+", 32)], 1):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(p, text or "") if len(m[0]) >= least]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def test_secret_base_spans(spark):
    got = {r["doc_id"]: r for r in secrets.secret_report(docs(spark, TEXTS)).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, want, got[i])
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(got[i]["spans"].split(",")) | ({""} - set(want))


def test_weak_candidates_need_a_complement(spark):
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_report(docs(spark, TEXTS)).collect()}
    assert "weak_assign" in got[6] and "ident" in got[6] and "endpoint" in got[6]
    assert got[7] == "" and got[9] == "" and got[0] == ""
    assert "weak_access" in got[8]


def test_secrets_repeats_nulls_and_redaction(spark):
    rows = [(1, f"token: {'a' * 9} b"), (1, f"token: {'a' * 9} b"), (1, "nothing"), (None, "password=12345678 é " + "0" * 40), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "'x' as kind", "2 as d")
    assert secrets.secret_report(df).count() == 5
    out = [r["text"] for r in secrets.redacted(df).collect()]
    assert sorted(map(str, out)) == sorted(map(str, ["[REDACTED] b", "[REDACTED] b", "nothing", "[REDACTED] é [REDACTED]", None]))
    assert secrets.secret_report(df.limit(0)).count() == 0 and secrets.redacted(df).columns == df.columns


def brute_quality(text):
    w = re.findall(SPACES, text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    hit = {i + j for i, t in enumerate(tri) if n[t] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(SPACES, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(spark):
    rnd = random.Random(5)
    texts = [None, "", " \n ", "a b c a b c", "a a a a a", "é # b\né # b\n\né # b", *[" ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 60))) + "\n" + rnd.choice("ab") for _ in range(40)]]
    got = {r["doc_id"]: r for r in quality.quality_rules(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(t), t
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_quality_adapts_and_keeps_whole(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8)))
    rows = [(i, " ".join(word() for _ in range(80)), "en" if i % 2 else None, None if i % 3 else "s", 1) for i in range(300)]
    rows += [(1000, " ".join(word() + "%%%" for _ in range(80)), "en", "s", 1), (1000, " ".join(word() + "%%%" for _ in range(80)), "en", "s", 1)]
    got = quality.quality_rules(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 302 and sum(r["kept"] for r in got) == 300
    assert not any(r["kept"] for r in got if r["doc_id"] == 1000)
    assert quality.quality_rules(spark.createDataFrame([], DOCS)).count() == 0


def test_quality_fences_follow_the_data(spark):
    rnd = random.Random(6)
    word = lambda a, b: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(a, b)))
    text = lambda a, b, end="": " ".join(word(a, b) + end for _ in range(80))
    rows = [(i, text(3, 8), "en", "s", 1) for i in range(1500)] + [(2000 + i, text(3, 8, "%%"), "en", "junk", 1) for i in range(60)]
    rows += [(3000, text(10, 12), "en", "s", 1), (3001, text(2, 2), "en", "s", 1), (3002, text(3, 8) + " 100%", "en", "s", 1)]
    rows += [(4000 + i, text(10, 12), "fi", "s", 1) for i in range(60)]  # long words are common here
    kept = {r["doc_id"] for r in quality.quality_rules(spark.createDataFrame(rows, DOCS)).collect() if r["kept"]}
    assert 3000 not in kept and 3001 not in kept and 3002 in kept
    assert not {2000 + i for i in range(60)} & kept and {4000 + i for i in range(60)} <= kept
    assert len(kept) > 1550


def exact_kept(rows, min_group=50, reach=3.0):
    """The fences from exact quantiles; also how near each row is to the nearest fence it was held against."""
    told = []
    for i, t, lang, source in rows:
        n, chars, symbols, dup, rep = brute_quality(t)
        lines = len([x for x in t.split("\n") if re.search(SPACES, x)])
        few = lambda a, b, k: max(a - k, 0) / b if b else 0.0
        rate = {"symbol_rate": few(symbols, chars, 0), "dup_line_rate": few(dup, lines, 0), "repeat_rate": few(rep, n, 0), "mean_word": few(chars, n, 0)}
        less = {"symbol_rate": few(symbols, chars, 1), "dup_line_rate": few(dup, lines, 1), "repeat_rate": few(rep, n, 6), "mean_word": few(chars, n, 0)}
        told.append((i, lang, source, n < 50 or 100 * rep > 50 * n, rate, less))

    def fences(group):
        out = {}
        for m in quality.SLACK:
            v = sorted(r[4][m] for r in group)
            at = lambda q: v[max(math.ceil(q * len(v)), 1) - 1]  # noqa: E731, B023
            q1, q3 = at(0.25), at(0.75)
            out[m] = (max(q3 + reach * (q3 - q1), at(quality.TAIL)), min(q1 - reach * (q3 - q1), at(1 - quality.TAIL)))
        return out

    good = [r for r in told if not r[3]]
    near = lambda own, parent: min(max(own, parent / quality.APART), parent * quality.APART)
    top, kept, close = fences(good), {}, {}
    for i, lang, source, failed, rate, less in told:
        by_lang, own = [r for r in good if r[1] == lang], [r for r in good if r[1:3] == (lang, source)]
        f1, f0 = fences(by_lang) if len(by_lang) >= min_group else None, fences(own) if len(own) >= min_group else None
        bad, gap = False, 1.0
        for m in quality.SLACK:
            for side in (0, 1) if m == "mean_word" else (0,):
                f = top[m][side] if f1 or side else max(top[m][side], quality.SLACK[m])
                f = near(f1[m][side], top[m][side]) if f1 else f
                f = near(f0[m][side], f) if f0 else f
                x = less[m] if side == 0 else rate[m]
                bad |= x > f * (1 + 2 * quality.ALPHA) if side == 0 else x < f * (1 - 2 * quality.ALPHA)
                gap = min(gap, abs(x / f - 1) if f > 0 else 1.0)
        kept[i], close[i] = not failed and not bad, gap
    return kept, close


def test_quality_against_exact_quantiles(spark):
    rnd = random.Random(12)
    word = lambda a, b: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(a, b)))
    rows = []
    for i in range(1200):
        lang, source = rnd.choice(["en", "de"]), rnd.choices(["web", "news", "code"], [5, 5, 1.2])[0]
        a = 3 if lang == "en" else 6
        end = "#" if source == "code" else ""
        text = " ".join(word(a, a + 5) + (end if rnd.random() < 0.3 else "") for _ in range(rnd.randint(45, 90)))
        if rnd.random() < 0.05:
            text += " " + "%%%% " * rnd.randint(1, 20)
        rows.append((i, text, lang, source))
    symbols = " ".join(word(3, 8) + ("#" if k % 4 == 0 else "") for k in range(80))
    rows += [(1000, symbols, "en", "code"), (1001, symbols, "en", "news")]
    got = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame([(*r, 1) for r in rows], DOCS)).collect()}
    want, close = exact_kept(rows)
    assert {i for i in got if got[i] != want[i] and close[i] > 5 * quality.ALPHA} == set()
    assert 0.01 < sum(not k for k in got.values()) / len(got) < 0.4
    assert got[1000] and not got[1001]  # common in one source, an outlier in the other


def test_repeated_lines_are_judged_by_their_like(spark):
    """A source of songs is kept by its own sketch; elsewhere the few texts that repeat lines are held against each other."""
    rnd = random.Random(8)
    line = lambda: " ".join("".join(rnd.choice("abcdefghijklm") for _ in range(6)) for _ in range(2))

    def text(lines, again):
        own = [line() for _ in range(lines - again)]
        for _ in range(again):
            own.insert(rnd.randrange(len(own)) + 1, own[0])
        return "\n".join(own)

    rows = [(i, text(33, 2), "en", "songs", 1) for i in range(140)] + [(10_000 + i, text(33, 0), "en", f"s{i % 5}", 1) for i in range(5000)]
    few = [(5000 + i, text(30 + i % 9, 1 + (i % 3 == 0)), "en", f"s{i % 5}", 1) for i in range(80)]
    far = [(9000 + i, text(30, 11), "en", f"s{i}", 1) for i in range(3)]
    kept = {r["doc_id"] for r in quality.quality_rules(spark.createDataFrame(rows + few + far, DOCS)).collect() if r["kept"]}
    assert {r[0] for r in rows} <= kept
    # By the rule: over all texts of the language that repeat lines, three times the middle half's width above it.
    rate = {}
    for i, t, *_ in rows + few + far:
        lines = t.split("\n")
        rate[i] = (len(lines) - len(set(lines))) / len(lines)
    some = sorted(x for x in rate.values() if x > 0)
    q1, q3, top = (some[math.ceil(q * len(some)) - 1] for q in (0.25, 0.75, 0.95))
    fence = max(q3 + 3 * (q3 - q1), top)
    for i, *_ in few + far:
        if abs(rate[i] / fence - 1) > 5 * quality.ALPHA:
            assert (i in kept) == (rate[i] <= fence)
    assert not {r[0] for r in far} & kept and len({r[0] for r in few} & kept) > 70


def test_sketches_merge(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join("w" * rnd.randint(1, 9) for _ in range(60)), "en", f"s{i % 4}", 1) for i in range(200)]
    fences = {(r["level"], r["source"]): r for r in quality.thresholds(quality.sketches(quality.measures(spark.createDataFrame(rows, DOCS)))).collect()}
    means = sorted(sum(map(len, r[1].split())) / 60 for r in rows)
    q1, q3 = means[49], means[149]
    assert fences[(2, None)]["size"] == 200 and abs(fences[(2, None)]["mean_word"] - max(12.0, q3 + 3 * (q3 - q1))) < 0.5


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be <|end|>\n nice \\ \\n \\l"), (1, 1, "user", None), (1, 2, "assistant", "<|turn|>user\nhi<|end|>\n"), (1, 3, "assistant", "\\"), (1, 4, "user", "bye"), (2, 0, "user", "no reply"), (None, None, None, None), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (4, 1, "ro<le\nx", "é日本")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as end", "2 as segments")
    examples = chat.chat_examples(df)
    assert {(r["conv_id"], r["example"]) for r in examples.collect()} == {(1, 3), (1, 4), (1, 5), (2, 1), (None, 1), (3, 1), (3, 2), (4, 1)}
    got = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(own) and got[conv]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.chat_examples(df.limit(0)).count() == 0


def test_listed_url_rules(spark):
    cases = {"http://a.net/x": ("a.net", "/x", "net/", "block"), "http://WWW.Example.NET/en/1?q": ("www.example.net", "/en/1", "example.net/en/", "allow"), "http://net": ("net", "", None, "allow"), "https://example.com/de/#a": ("example.com", "/de/", "example.com/de/", "block"), "http://badexample.com/de/": ("badexample.com", "/de/", None, "allow"), "http://x.org/fr/?a": ("x.org", "/fr/", "org/fr/", "allow"), "nothing here": ("", "", None, "allow"), "a://b/c://d": ("b", "/c://d", None, "allow")}
    rows = [(i, u, "h") for i, u in enumerate(cases)] + [(99, None, None), (None, "http://a.net/x", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as tokens")
    labels = spark.createDataFrame([(0, True), (None, True), (1, None)], "page_id long, bad boolean").limit(0)
    got = {(r["page_id"]): r for r in urls.url_verdicts(df, labels).collect()}
    for i, u in enumerate(cases):
        assert tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) == cases[u], u
    assert got[99]["host"] == "" and got[99]["verdict"] == "allow" and got[None]["rule"] == "net/"


def test_mined_url_rules(spark):
    rows = [(i, f"http://site{i % 7}.com/{'casino' if i % 3 == 0 else 'news'}/{i}?{'promo' if i % 2 else 'id'}=1") for i in range(240)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 3 == 0 and i % 2 == 1) for i in range(210)], "page_id long, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in urls.url_verdicts(pages, labels, listed=[("none", "/", "block")], min_support=0.02, min_confidence=0.8, least=10).collect()}
    assert got == {i: "block" if i % 3 == 0 and i % 2 == 1 else "allow" for i in range(240)}


def brute_rules(labelled, support, confidence, least):
    """All token sets, counted one by one."""
    sets = [(frozenset(t), bad) for t, bad in labelled]
    n, freq, hits = len(sets), Counter(), Counter()
    for tokens, bad in sets:
        for size in range(1, len(tokens) + 1):
            for part in combinations(sorted(tokens), size):
                freq[part] += 1
                hits[part] += bad
    z2 = urls.DEVIATIONS**2
    low = lambda h, f: (h / f + z2 / (2 * f) - urls.DEVIATIONS * math.sqrt(h / f * (1 - h / f) / f + z2 / (4 * f * f))) / (1 + z2 / f)
    sure = {p: low(h, freq[p]) for p, h in hits.items() if h >= max(support * n, least) and low(h, freq[p]) >= confidence}
    return {p: c for p, c in sure.items() if not any(sure.get(tuple(x for x in p if x != t), -1) >= c for t in p)}


@pytest.mark.parametrize("n", [30, 300, 1500])
def test_rules_against_all_token_sets(spark, n):
    rnd = random.Random(n)
    rows = []
    for _ in range(n):
        url = f"http://{rnd.choice('abc')}.{rnd.choice(['com', 'net'])}/{rnd.choice(['x', 'casino', 'y'])}/{rnd.choice('pq')}"
        rows.append((url, rnd.random() < (0.95 if "casino" in url and "/p" in url else 0.25)))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    tokens = {r["url"]: r["t"] for r in df.select("url", urls.tokens_of(F.col("url")).alias("t")).distinct().collect()}
    got = {tuple(sorted(r["tokens"])): r["confidence"] for r in urls.mined_rules(df).collect()}
    want = brute_rules([(tokens[u], bad) for u, bad in rows], 0.002, 0.7, urls.LEAST)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert all({"path:casino", "path:p"} <= set(k) for k in got) and bool(got) == (n >= 300)  # no rules out of noise at any size


def brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = words(text), set(), set()
    for k, t in items:
        x = words(t)
        n = min(window, len(x))
        wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                ids.add(str(k))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("bound", [10**6, 0])
def test_contamination(spark, bound):
    rnd = random.Random(9)
    text = lambda n: " ".join(rnd.choice(["Ab", "É", "c9", "d-e", "f"]) for _ in range(n))
    items = [(1, text(15)), (2, text(12)), (10, "Ab É c9"), (11, ""), (12, None), (13, "zz"), (2, "Ab É c9")]
    texts = [None, "", "Ab", "zz ZZ zZ!", *[text(rnd.randint(1, 80)) for _ in range(30)], "x " + items[0][1].upper() + " y"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination_report(docs(spark, texts), bench, broadcast_rows=bound).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == brute_hits(t, items), (i, t)


def test_contamination_edges(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    rows = [(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (1, "clean"), (None, "a b c d e f g h i j"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pos", "2 as n", "3 as w", "4 as hash")
    assert sorted(r["n_hit"] for r in decontaminate.contamination_report(df, bench).collect()) == [0, 0, 10, 10, 10]
    kept = decontaminate.clean_documents(df, bench)
    assert kept.columns == df.columns and sorted(str(r["text"]) for r in kept.collect()) == ["None", "clean"]
    assert decontaminate.clean_documents(df, bench.limit(0)).count() == 5 and decontaminate.contamination_report(df.limit(0), bench).count() == 0


CLASH = ["_d", "_h", "_hash", "_cuts", "d", "h", "own_0", "OWN_1", "text_hash", "measure", "row", "i", "kept", "bucket"]


@pytest.mark.parametrize("stage", ["redacted", "clean_documents", "without_near_duplicates", "without_toxic"])
def test_columns_with_clashing_names_come_through(spark, stage):
    texts = ["the quick brown fox " * 20, "the quick brown fox " * 20, "say password=hunter2hunter now", "one two three four five six seven eight nine ten eleven", None]
    base = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df = base.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASH])
    items = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    work = {"redacted": secrets.redacted, "clean_documents": lambda x: decontaminate.clean_documents(x, items), "without_near_duplicates": neardup.without_near_duplicates, "without_toxic": lambda x: toxicity.without_toxic(x, labels)}[stage]
    out = work(df)
    assert out.columns == df.columns
    rows = out.collect()
    want = {"redacted": {0, 1, 2, 3, 4}, "clean_documents": {0, 1, 2, 4}, "without_near_duplicates": {0, 2, 3, 4}, "without_toxic": {0, 1, 2, 3, 4}}[stage]
    assert {r["doc_id"] for r in rows} == want and len(rows) == len(want)
    assert all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in CLASH)
    assert stage != "redacted" or [r["text"] for r in rows if r["doc_id"] == 2] == ["say [REDACTED] now"]


def test_tokens_that_stand_together_are_mined_as_one(spark):
    rnd = random.Random(2)
    keys = "&".join(f"{chr(97 + k)}{chr(97 + k)}=1" for k in range(25))
    rows = [(f"http://a.com/{rnd.choice('pq')}?{keys}" if i % 20 == 0 else f"http://a.com/{rnd.choice('pq')}", i % 20 == 0) for i in range(2000)]
    rules = urls.mined_rules(spark.createDataFrame(rows, "url string, bad boolean")).collect()
    assert {tuple(r["tokens"]) for r in rules} == {(f"query:{chr(97 + k) * 2}",) for k in range(25)} and len(rules) == 25
