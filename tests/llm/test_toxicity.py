import math
import random
import re
from collections import Counter, defaultdict

import pytest
from fundloom.llm import toxicity


def rows(n=600):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 4)))
    out = []
    for i in range(n):
        w = [word() for _ in range(rnd.randint(20, 80))]
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), rnd.choice(["Zorgon!", "zorgon", "quux,", "frumious"]))
        out.append((i, " ".join(w), int(bad)))
    return out


def test_held_out_accuracy_and_edges(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(None, "zorgon quux frumious"), (9999, None), (9998, ""), (0, data[0][1]), (9997, "clean " * 50)], "doc_id long, text string").selectExpr("*", "1 as measure", "2 as toxic", "3 as score")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(data) + 5
    truth = {i: y for i, _, y in data}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 60 and sum(p == y for p, y in held) / len(held) > 0.95
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] in (9997, 9998, 9999):
            assert r["predicted"] == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {9999, 9998} <= {r["doc_id"] for r in kept.collect()}


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.toxicity_scores(docs, labels).collect()] == [0.0, 0.0]
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_a_capped_sample_keeps_the_class_ratio(spark):
    rnd = random.Random(7)
    # One word in ten texts of both classes is all that there is to learn: the scores are the labels' ratio.
    data = [(i, " ".join(rnd.choice("abcdefgh") * 2 for _ in range(20)), int(i % 10 == 0)) for i in range(3000)]
    docs = spark.createDataFrame([x[:2] for x in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, labels, per_class=200).collect()
    assert abs(sum(r["score"] for r in got) / len(got) - 0.1) < 0.05
    assert sum(r["predicted"] for r in got) < 30


def plain_measures(train, texts):
    """Both models with dictionaries, each a distribution; each text's mean log ratio over its tokens."""
    words = lambda t: ["<s>", *re.findall(r"[a-z0-9]+", t.lower())]
    held, alone = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    for t, y in train:
        w = words(t)
        held[y].update(set(zip(w, w[1:])))
        alone[y].update(set(w[1:]))
    before = {y: Counter(w for _, w in held[y]) for y in (0, 1)}
    vocabulary = {*before[0], *before[1]}

    def discount(counts):
        ones, twos = sum(n == 1 for n in counts), sum(n == 2 for n in counts)
        return min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)

    beyond = lambda n, expected: n > expected + toxicity.Z * math.sqrt(expected) + 1
    tested = {y: {w: min(before[y][w], alone[y][w]) for w in vocabulary} for y in (0, 1)}
    part = sum(tested[1].values()) / (sum(tested[0].values()) + sum(tested[1].values()))
    own = {w for w in vocabulary if any(beyond(tested[y][w], (tested[0][w] + tested[1][w]) * (part if y else 1 - part)) for y in (0, 1))}
    total = {y: sum(before[y].values()) for y in (0, 1)}
    less = discount([before[0][w] + before[1][w] for w in vocabulary])
    rest = {y: 1 - sum(max(before[y][w] - less, 0) / total[y] for w in own) for y in (0, 1)}
    shared = {w: (before[0][w] + before[1][w]) / (total[0] + total[1]) for w in vocabulary}
    word_p = lambda y, w: (max(before[y][w] - less, 0) / total[y] if w in own else 0) + rest[y] * shared[w]
    assert all(abs(sum(word_p(y, w) for w in vocabulary) - 1) < 1e-9 for y in (0, 1))

    after = {y: Counter() for y in (0, 1)}
    for y in (0, 1):
        for (h, _), n in held[y].items():
            after[y][h] += n
    every = {y: sum(held[y].values()) for y in (0, 1)}
    part = {y: every[y] / (every[0] + every[1]) for y in (0, 1)}
    free = {*held[0], *held[1]}
    share = lambda y, h: min(after[y][h] / (after[0][h] + after[1][h]), min(1, toxicity.NEAR * part[y]))
    kept = {g for g in free if any(beyond(held[y][g], (held[0][g] + held[1][g]) * share(y, g[0])) for y in (0, 1))}
    less_pairs = discount([held[0][g] + held[1][g] for g in free])
    top = lambda y, g: max(held[y][g] - less_pairs, 0) / after[y][g[0]] if after[y][g[0]] else 0.0
    left = {y: Counter() for y in (0, 1)}
    for y in (0, 1):
        for g in kept:
            left[y][g[0]] += top(y, g)

    def log_p(y, h, w):
        below = word_p(y, w) if w in shared else rest[y]
        return math.log((top(y, (h, w)) if (h, w) in kept else 0) + (1 - left[y][h]) * below)

    for y in (0, 1):  # a distribution after every context
        for h in ["<s>", *list(vocabulary)[:40]]:
            assert abs(sum(math.exp(log_p(y, h, w)) for w in vocabulary) - 1) < 1e-9
    out = []
    for t in texts:
        w = words(t)
        out.append(sum(log_p(1, h, x) - log_p(0, h, x) for h, x in zip(w, w[1:])) / (len(w) - 1) if len(w) > 1 else math.log(rest[1] / rest[0]))
    return out


def held_out_recall(spark, said, n=4000, words=40):
    """Texts of random words, a quarter with a phrase put in by ``said``: toxic ones found of those held out, and false alarms."""
    rnd = random.Random(3)
    data = []
    for i in range(n):
        w = [f"w{rnd.randrange(2000)}" for _ in range(words)]
        data.append((i, " ".join(said(w, rnd) if i % 4 == 0 else w), int(i % 4 == 0)))
    docs = spark.createDataFrame([x[:2] for x in data], "doc_id long, text string").repartition(4)
    got = toxicity.toxicity_scores(docs, spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")).where("held_out").collect()
    bad = [r["predicted"] for r in got if r["doc_id"] % 4 == 0]
    return sum(bad), len(bad), sum(r["predicted"] for r in got) - sum(bad)


@pytest.mark.parametrize("said", [
    lambda w, rnd: ["you", "stupid", "idiot", *w], lambda w, rnd: [*w, "you", "stupid", "idiot"], lambda w, rnd: [*w[:9], "w1", "idiot", *w[9:]],
    lambda w, rnd: (lambda k: [*w[:k], "idiot", *w[k:]])(rnd.randrange(40)),
], ids=["start", "end", "after one word", "anywhere"])
def test_a_phrase_is_found_wherever_it_stands(spark, said):
    found, there, false = held_out_recall(spark, said)
    assert there > 180 and found == there and false == 0


def test_copies_teach_once(spark):
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(900)}"
    base = [word() for _ in range(60)]
    texts = [(" ".join(base), 1)] * 80 + [(" ".join([*base[:k], "x", *base[k:]]), 1) for k in range(60)] + [(" ".join(word() for _ in range(60)), k % 2) for k in range(100)] + [("", 1), (None, 0)]
    df = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(texts)], "row long, text string, toxic int")
    kept = toxicity.without_copies(df).collect()
    assert len([r for r in kept if r["row"] < 140]) <= 4 and len([r for r in kept if 140 <= r["row"] < 240]) == 100


def test_against_plain_models(spark):
    rnd = random.Random(5)
    common = [f"c{i}" for i in range(300)]
    train = []
    for i in range(1200):
        w = [rnd.choice(common) for _ in range(rnd.randint(0, 25))]
        if i % 3 == 0:
            for said in (rnd.choice(["zorgon", "quux", "frumious"]), "seldom c2"):
                w.insert(rnd.randrange(len(w) + 1), said)
        else:
            w.insert(rnd.randrange(len(w) + 1), f"seldom c{rnd.randrange(30)}")
        train.append((" ".join(w), int(i % 3 == 0)))
    model = toxicity.fitted(spark.createDataFrame(train, "text string, toxic int"))
    texts = [t for t, _ in train[:60]] + ["", "zorgon", "nothing known here", "seldom c2 zorgon seldom c2"]
    shared = spark.sparkContext.broadcast(model)
    got = [r["measure"] for r in spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).selectExpr("text", "1 as k").mapInArrow(toxicity.measurer(shared), "k int, measure double").collect()]
    want = plain_measures(train, texts)
    assert len(model["words"]) and len(model["pairs"]) and sum(x != 0 for x in want) > 20
    assert got == pytest.approx(want, abs=1e-5)
