"""Tensored MinHash against all pairs on full sets."""

import random
import re

import pytest

from fundloom.llm import neardup


def brute(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefé") for _ in range(rnd.randint(2, 6)))
    texts = [None, "", " \t\n", "one two", "One  TWO", "one two three", "É a b c d e", "é a b c d e"]
    shared = [word() for _ in range(40)]
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(60, 300))]
        texts += [" ".join(base), " ".join(base).upper()]
        for _ in range(8):  # chains of copies: each step changes a little more
            base = list(base)
            base[rnd.randrange(len(base))] = word()
            texts.append("\n".join(base))
    texts += [" ".join([*shared, *[word() for _ in range(30)]]) for _ in range(100)]  # one passage in many documents
    rnd.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def test_against_all_pairs(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(neardup, "BLOCK", 8)  # buckets of several blocks occur here too
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "2 as key", "3 as label", "4 as u")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text), (5, "other words are here today my friend"), (9, "other words are here today my friend"), (7, text + " x"), (None, text), (None, None), (1, None), (2, "")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 26, 5, True), (5, 26, 5, True), (5, 3, 5, True), (9, 3, 5, False), (7, 27, 5, False), (None, 26, None, True), (None, 0, None, True), (1, 0, 1, True), (2, 0, 2, True)], key=str)
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def family(n, words, rate, seed):
    """Texts that each change some words of one text that is not among them: few pairs are just alike enough."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        text = list(base)
        for k in rnd.sample(range(words), rnd.randint(*rate)):
            text[k] = f"x{i}_{k}"
        out.append((i, " ".join(text)))
    return out


@pytest.mark.parametrize("n,words,rate", [(300, 400, (4, 12)), (60, 200, (2, 6)), (60, 900, (6, 12))])
def test_family_of_copies_unlike_their_source_loses_no_link(spark, n, words, rate):
    rows = family(n, words, rate, 5)
    want = brute(rows)
    assert 1 < len({c for _, c in want.values()}) < n
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want


def test_blank_row_of_a_repeated_document_stays_with_it(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = neardup.near_duplicates(spark.createDataFrame([(2, text), (5, text), (5, None)], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()) == [(2, 26, 2, True), (5, 0, 2, False), (5, 26, 2, False)]


def test_a_link_that_one_block_decides_by_estimate(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LOW", 64)  # sets larger than their sketches
    rows = family(80, 300, (3, 9), 9)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(rows)
