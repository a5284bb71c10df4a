"""Runs against all periods and places by brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from fundloom.llm import queries, runs


def brute(w, least=12):
    """All (start, length, period): stretches whose smallest period is q, that can't be extended."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in out.items())


def collapsed(w, found):
    drop = {k for a, n, q in found for k in range(a + q, a + n)}
    return [x for k, x in enumerate(w) if k not in drop]


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


def texts(seed, n):
    rnd = random.Random(seed)
    out = [None, "", " \n", "a", " ".join("a" * 300), "ab " * 11, "x y " * 7 + "x", "  é " * 9]
    for _ in range(n):
        kind, letters = rnd.random(), "abcdefgh"[: rnd.randint(1, 8)]
        w = [rnd.choice(letters) for _ in range(rnd.randint(0, 120))]
        if kind < 0.5:
            for _ in range(rnd.randint(1, 4)):
                p = [rnd.choice(letters) for _ in range(rnd.randint(1, 20))]
                at, n_ = rnd.randint(0, len(w)), rnd.randint(8, 90)
                w[at:at] = (p * n_)[:n_]
        if kind > 0.9:  # Fibonacci words: runs of many periods
            x, y = ["a"], ["a", "b"]
            for _ in range(rnd.randint(4, 9)):
                x, y = y, y + x
            w = y
        out.append(rnd.choice([" ", "\n", " \t"]).join(w))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_grammar_extensions(seed):
    rnd = np.random.default_rng(seed)
    words = np.concatenate([[900], rnd.integers(0, 1 + seed * 2, 400), np.tile(rnd.integers(0, 3, 7), 60), [5] * 300, [901]]).astype(np.int64)
    levels = runs.grammar(words)
    assert len(levels[-1].symbols) < len(words) / 4 and sum(len(x.symbols) for x in levels) < 12 * len(words)
    x, y = rnd.integers(1, len(words) - 1, (2, 4000))
    x, y = x[x != y], y[x != y]
    for way in (1, -1):
        got = runs.extended(levels, x, y, way)
        for a, b, n in zip(x, y, got):
            k = 0
            while words[a + way * k] == words[b + way * k]:
                k += 1
            assert n == k


def test_runs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(runs, "GATHER", 500)
    rows = [(i, t) for i, t in enumerate(texts(1, 400))] + [(None, "a b " * 9), (3, "q " * 13), (3, "q " * 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as runs", "'x' as collapsed", "2 as start")
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(df).collect()), key=str)
    want = []
    for i, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        found = brute(w)
        want.append((i, found, " ".join(collapsed(w, found))))
    assert got == sorted(want, key=str)
    assert sum(len(x[1]) for x in got) > 300
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks_of_candidates(monkeypatch):
    w = texts(5, 60)[-1].split() * 3
    numbers = {x: k for k, x in enumerate(dict.fromkeys(w))}
    words = np.array([90, *(numbers[x] for x in w), 91])
    whole = runs.runs_in(words, np.array([1]), np.array([len(w)]), 12)
    monkeypatch.setattr(runs, "BLOCK", 50)
    assert (runs.runs_in(words, np.array([1]), np.array([len(w)]), 12) == whole).all()
    assert [tuple(x) for x in np.stack([whole[0] - 1, whole[1] - whole[0], whole[2]], axis=1).tolist()] == brute(w)


def test_query_against_brute_force(spark, tmp_path):
    rows = list(enumerate(texts(2, 300))) + [(None, "z " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, t in rows:
        w = planted(i, [x.decode() for x in (t or "").encode().split()])
        found = brute(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *(best or (None,) * 3))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == sha("".join(f"{a},{n},{q}\n" for a, n, q in found))
        assert r["collapsed_sha256"] == sha(" ".join(collapsed(w, found)))
