"""The backoff model against a plain version with dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from fundloom.llm import katz


def plain(rows):
    lowered = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    toks = [(i, ["<s>", *re.findall(r"[^\x20\x09-\x0D]+", lowered(t)), "</s>"]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in toks]
    c, big = Counter(), Counter()
    for (_, t), x in zip(toks, held):
        if not x:
            c.update(t[1:])
            big.update(zip(t, t[1:]))
    n, v = sum(c.values()), len(c)
    z = n + 0.1 * (v + 1)
    p = lambda w: (c[w] + 0.1) / z
    d = katz.discounts([float(sum(x == r for x in big.values())) for r in range(1, katz.K + 2)])
    d = {r: d[r - 1] for r in range(1, katz.K + 1)}
    after, ch = defaultdict(list), Counter()
    for (h, w), r in big.items():
        after[h].append((w, r))
        ch[h] += r
    alpha = lambda h: (1 + sum(r * (1 - d.get(r, 1)) for _, r in after[h])) / (ch[h] + 1) / (1 - sum(p(w) for w, _ in after[h]))
    cond = lambda h, w: d.get(big[h, w], 1) * big[h, w] / (ch[h] + 1) if big[h, w] else alpha(h) * p(w)
    for h in list(ch)[:50]:  # exactly normalised, one place for unknown words
        assert abs(sum(cond(h, w) for w in c) + alpha(h) * 0.1 / z - 1) < 1e-9
    out = []
    for (i, t), x in zip(toks, held):
        out.append((i, x, len(t) - 1, sum(c[w] > 0 for w in t[1:]), n, sum(math.log10(p(w)) for w in t[1:]), sum(math.log10(cond(h, w)) for h, w in zip(t, t[1:]))))
    return out


def close(got, want):
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), *r[1:4], round(r[5], 3))
    for a, b in zip(sorted((tuple(r) for r in got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], abs=1e-6)


@pytest.mark.parametrize("tokens,docs", [(3_000_000, 30_000), (300, 7)])
def test_against_plain(spark, tokens, docs):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(40)] + [f"rare{i}" for i in range(400)]
    weights = [200 / (i + 1) for i in range(440)]
    rows = [(i, " ".join(rnd.choices(words, weights, k=rnd.randint(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "É W1\tw1"), (None, "w1 w2 rare3"), (3, rows[3][1]), (3, "other text of three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as held", "3 as key").repartition(3)
    close(katz.katz_scores(df, tokens, docs).collect(), plain(rows))


def test_no_rows_no_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.katz_scores(empty).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(alone, "all held out")]
    close(katz.katz_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect(), plain(rows))


def test_texts_without_frequent_words(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(3000))), (2, " ".join(f"v{i}" for i in range(2500)))]
    close(katz.katz_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect(), plain(rows))


def test_hot_bigrams_and_many_buckets(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(i, ("spam spam eggs " * rnd.randint(0, 9)) + " ".join(f"w{rnd.randrange(50)}" for _ in range(20))) for i in range(200)]
    close(katz.katz_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 500, 20).collect(), plain(rows))


def test_tables_score_other_texts(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(f"w{int(rnd.random() ** 2 * 60)}" for _ in range(rnd.randint(0, 40)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model, _ = katz.trained(df)
    want = {r[0]: r[6] for r in plain(rows)}
    got = {r["doc_id"]: r["score"] for r in katz.evaluated(df, model).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)
