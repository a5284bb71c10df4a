import random

import pytest

from fundloom.llm.components import connected, relabelled


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["chain", "random", "star", "none"])
def test_components(spark, kind):
    rnd = random.Random(1)
    edges = {"chain": [(i, i + 1) for i in range(60)], "random": [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + [(5, 5)], "star": [(50, i) for i in range(40)] + [(100, 101)], "none": []}[kind]
    labels = connected(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"]: r["label"] for r in labels.collect()} == plain(edges)
    more = [(1000, 3), (0, 59), (2000, 2001)]
    got = relabelled(labels, spark.createDataFrame(more, "u long, v long"))
    assert {r["node"]: r["label"] for r in got.collect()} == plain(edges + more)
