"""Closures, rules and components against plain versions."""

import random
from collections import defaultdict, deque

from fundloom.operators import mdm, rules
from fundloom.operators.components import components


def plain_hops(edges):
    out, after = {}, defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    for a in list(after):
        seen, queue = {}, deque((b, 1) for b in after[a])
        while queue:
            x, n = queue.popleft()
            if x not in seen:
                seen[x] = n
                queue.extend((y, n + 1) for y in after[x])
        out |= {(a, x): n for x, n in seen.items()}
    return out


def test_closure_of_chains_cycles_and_random_graphs(spark):
    rnd = random.Random(2)
    chain = [(i, i + 1) for i in range(1000)]
    edges = [(5000 + i, 5000 + (i + 1) % 37) for i in range(37)] + [(9000, 9000), (9001, 9002), (9001, 9002)] + [(7000 + rnd.randrange(60), 7000 + rnd.randrange(60)) for _ in range(90)]
    got = rules.closure(spark.createDataFrame([*chain, *edges, (None, 1), (2, None)], "child long, parent long"))
    assert got.where("child < 5000").count() == 500_500 and got.where("child < 5000 and hops <> ancestor - child").count() == 0
    rest = got.where("child >= 5000").collect()
    assert {(r["child"], r["ancestor"]): r["hops"] for r in rest} == plain_hops(edges) and len(rest) == len(plain_hops(edges))
    assert rules.closure(spark.createDataFrame([], "child long, parent long")).count() == 0


def plain_facts(facts, sub, inverse, transitive):
    known = set(facts)
    while True:
        new = {(s, q, o) for s, p, o in known for c, q in sub if c == p} | {(o, y if p == x else x, s) for s, p, o in known for x, y in inverse if p in (x, y)}
        new |= {(s, p, o2) for s, p, o in known if p in transitive for s2, p2, o2 in known if p2 == p and s2 == o}
        if new <= known:
            return known
        known |= new


def test_facts_and_types(spark):
    rnd = random.Random(6)
    facts = [(f"n{rnd.randrange(14)}", rnd.choice(["part", "owns", "near", "likes"]), f"n{rnd.randrange(14)}") for _ in range(22)]
    sub, inverse, transitive = [("owns", "controls"), ("controls", "rules"), ("has", "linked")], [("part", "has"), ("near", "near")], {"has", "rules", "near"}
    d = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    every = rules.inferred_facts(d([*facts, facts[0], (None, "owns", "x")], "s p o"), d(sub, "child parent"), d(inverse, "p q"), d([(p,) for p in transitive], "p"))
    want = plain_facts(facts, sub, inverse, transitive)
    got = [tuple(r) for r in every.collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > len(set(facts)) + 40
    types = rules.inferred_types(d([("n0", "A")], "instance cls"), every, d([("A", "B"), ("C", "A")], "child parent"), d([("B", "E")], "a b"), d([("owns", "C")], "p cls"), d([("owns", "D")], "p cls"))
    own = {("n0", "A")} | {(s, "C") for s, p, _ in want if p == "owns"} | {(o, "D") for _, p, o in want if p == "owns"}
    above = {"A": "BE", "C": "ABE", "B": "EB", "E": "BE"}
    assert {tuple(r) for r in types.collect()} == own | {(i, a) for i, c in own for a in above.get(c, "")}


def test_components_and_clusters(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + rnd.randrange(200), 2000 + rnd.randrange(200)) for _ in range(120)] + [(5, 5), (None, 3), (7, None)]
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want, seen = {}, set()
    for a in sorted(near):
        if a not in seen:
            todo = [a]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    want[x] = a
                    todo += near[x]
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["label"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    records = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 6)], "record_id long")
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.88), (1, 3, 0.5), (4, 5, 0.87)], "a long, b long, score double")
    told = {r["record_id"]: (r["match_id"], r["n_matched"], r["confidence"]) for r in mdm.match_clusters(records, pairs).collect()}
    assert told == {1: (1, 3, 0.76), 2: (1, 3, 0.76), 3: (1, 3, 0.76), 4: (4, 1, 1.0), 5: (5, 1, 1.0), 6: (6, 1, 1.0)}
