"""Similarity joins against all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from fundloom.operators import onboard, simjoin


def names(seed, n, most=22):
    rnd = random.Random(seed)
    parts = ["black", "rock", "capital", "jp", "morgan", "chase", "fund", "trust", "é", "co", "north", "a", "first", "ltd"]
    out = {"", "a", "ab", "aaaa", "aaaaaaaa", "x" * 250, "x" * 240 + "y"}
    while len(out) < n:
        s = rnd.choice(["", " ", "-"]).join(rnd.choice(parts) for _ in range(rnd.randint(1, 4)))[:most]
        for _ in range(rnd.choice([0, 0, 1, 2])):
            k = rnd.randint(0, len(s))
            s = s[:k] + rnd.choice(["", "q", "a"]) + s[k + rnd.randint(0, 1) :]
        out.add(s)
    return sorted(out)


def held(spark, xs, c):
    return spark.createDataFrame([(x,) for x in xs], f"{c} string")


@pytest.mark.parametrize("q,part", [(6, 20_000), (3, 7)])
def test_all_name_pairs_are_found(spark, monkeypatch, q, part):
    monkeypatch.setattr(simjoin, "PART", part)
    a, b = names(1, 500), names(2, 400)
    got = {tuple(r) for r in simjoin.containment_pairs(held(spark, a, "a"), held(spark, b, "b"), q).collect()}
    assert got == {(x, y) for x in a for y in b if y and y in x}
    told = simjoin.ratio_pairs(held(spark, a, "a"), held(spark, b, "b")).collect()
    got |= {(r["a"], r["b"]) for r in told}
    want = {(x, y) for x in a for y in b if x and y and (y in x or SequenceMatcher(None, x, y).ratio() >= 0.85)}
    apart = {(x, y) for x, y in want if y not in x and x not in y}
    assert len(apart) > 100 and {p for p in got if p[1] not in p[0] and p[0] not in p[1]} == apart
    assert len(told) == len({(r["a"], r["b"]) for r in told})
    every = {tuple(r) for r in simjoin.name_pairs(held(spark, a, "a"), held(spark, b, "b")).collect()}
    assert every == want | {(x, y) for x in a for y in b if x and x in y}


def test_blocks_hold_all_pairs_at_once(monkeypatch):
    monkeypatch.setattr(simjoin, "TILE", 32)
    rnd = random.Random(7)
    syllables = ["th", "an", "the", "in", "ö", "en", "\U0001f600"]
    some = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 7))) for _ in range(300)] + ["ab", "a" * 300, "ab" * 400, "a" * 290]
    aligned = []
    monkeypatch.setattr(simjoin.ratios, "ratio", lambda *p, known=simjoin.ratios.ratio: aligned.append(p) or known(*p))
    for least in (0.85, 0.95):
        aligned.clear()
        a, b = sorted(set(some[::2])), sorted(set(some[1::2]))
        want = {(x, y) for x in a for y in b if len(x) > 1 and len(y) > 1 and SequenceMatcher(None, x, y).ratio() >= least}
        a, b = [x for x in a if len(x) > 1], [y for y in b if len(y) > 1]
        assert {p[:2] for p in simjoin.alike_in_block(a, b, least)} == want and len(want) > 10
        assert len(aligned) < len(a) * len(b) / 20  # the others are told apart by counts
    assert simjoin.alike_in_block([], b, 0.85) == [] == simjoin.alike_in_block(a, [], 0.85)


def test_names_are_dealt_into_bounded_parts():
    size = lambda side, band, rows, n: {"side": side, "band": band, "rows": rows, "chars": rows * n, "shortest": n, "longest": n}
    many = simjoin.bands_that_meet([size("a", 25, 1_000_000, 17), size("b", 26, 10, 20), size("b", 40, 10, 100), size("b", 60, 50_000, 1000)], 0.85)
    assert many == [(25, 50, 26, 1)]  # lengths too far apart never meet
    assert simjoin.bands_that_meet([size("a", 60, 10, 1000), size("b", 60, 50_000, 1000)], 0.85) == [(60, 1, 60, 125)]


def test_empty_sides(spark):
    none, some = held(spark, [], "b"), held(spark, ["x", None], "a")
    assert simjoin.name_pairs(some, none).count() == 0
    with pytest.raises(ValueError):
        simjoin.ratio_pairs(some, none, 0.8)


def one_after_another(candidates, records):
    """As a loop does it."""
    known = [{"name": n, "lei": lei, "source": "edgar"} for _, n, lei in sorted(candidates)]

    def match(a, b):
        a, b = (a or "").lower().strip(" "), (b or "").lower().strip(" ")
        return bool(a and b) and (a in b or b in a or SequenceMatcher(None, a, b).ratio() >= 0.85)

    for _, n, lei in sorted(records):
        if lei:
            hit = next((c for c in known if match(c["name"], n)), None)
            if hit is None:
                known.append({"name": n, "lei": lei, "source": "gleif"})
            elif not hit["lei"]:
                hit["lei"] = lei
    return sorted((str(c["name"]), str(c["lei"]), c["source"]) for c in known)


@pytest.mark.parametrize("seed", range(2))
def test_leis_as_one_after_another(spark, seed):
    rnd = random.Random(seed)
    some = [x.title() for x in names(seed + 5, 160, 40) if len(x) > 6]
    rnd.shuffle(some)
    candidates = [(k, x, rnd.choice([None, "has"])) for k, x in enumerate([*some[:40], "BlackRok Advisors", "JPMorgan", None, ""])]
    records = [(k, x, rnd.choice([f"L{k}"] * 5 + [None, ""])) for k, x in enumerate([*some[40:], some[50], "blackrock advisors", "JPMorganChase & Co", None, " ", some[3]])]
    kind = "ord long, name string, lei string"
    got = onboard.attach_lei(spark.createDataFrame(candidates, kind), spark.createDataFrame(records, kind)).collect()
    assert sorted((str(r["name"]), str(r["lei"]), r["source"]) for r in got) == one_after_another(candidates, records)
