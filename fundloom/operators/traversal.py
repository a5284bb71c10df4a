"""Bounded-hop reachability over the supply graph, for all seeds at once.

A step is one equi-join of the frontier with distinct edges and a distinct; the number of steps is a parameter, so the plan is
unrolled and never loops over data on the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.graphmodel import exact
from fundloom.sources.tables import written


def links(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def reach_min_hops(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """seed, node, hops: nodes within ``hops`` steps of each seed (column ``company``), the seed itself excluded."""
    step = links(edges)
    front = seeds.select(F.col("company").alias("seed")).distinct().withColumn("at", F.col("seed"))
    found = None
    for d in range(1, hops + 1):
        front = front.join(step, F.col("at") == F.col("src")).select("seed", F.col("dst").alias("at")).where("seed <> at").distinct()
        here = front.select("seed", F.col("at").alias("node"), F.lit(d).alias("hops"))
        found = here if found is None else found.unionByName(here)
    return found.groupBy("seed", "node").agg(F.min("hops").alias("hops"))


def fund_reach(holds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """fund, company, node, hops: each node that a fund's holding reaches, once."""
    reach = reach_min_hops(edges, holds, hops)
    return holds.select("fund", "company").distinct().join(reach, F.col("company") == F.col("seed")).select("fund", "company", "node", "hops")


def second_order_chokepoints(holds: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """Nodes that at least ``k`` holdings of a fund reach, one of them at exactly two hops; held nodes may be among them."""
    out = fund_reach(holds, edges).groupBy("fund", "node").agg(F.count("*").alias("n_reachers"), F.count(F.when(F.col("hops") == 2, 1)).alias("n_two_hop"))
    return out.where((F.col("n_reachers") >= k) & (F.col("n_two_hop") > 0))


def chokepoints_not_held(holds: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes within two hops of a fund's holdings that the fund doesn't hold."""
    held = holds.select("fund", F.col("company").alias("node"))
    return fund_reach(holds, edges).join(held, ["fund", "node"], "left_anti").groupBy("fund", "node").agg(F.count("*").alias("n_holdings"))


def fund_masks(holds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """fund, part, bit: a place for each fund, 64 to a part; company, part, mask: the funds that hold each company, a bit for each. holds: fund, company, taken several times."""
    names = written(holds.select("fund").distinct(), "funds")
    n = F.monotonically_increasing_id()
    # Few files, so that parts are full.
    numbered = names.coalesce(max(1, math.ceil(names.count() / 1_000_000))).select("fund", n.alias("n"))
    funds = written(numbered.select("fund", F.floor(F.col("n") / 64).alias("part"), (F.col("n") % 64).cast("int").alias("bit")), "fund-numbers")
    marked = holds.where("company is not null").join(funds.withColumnRenamed("fund", "f"), F.col("fund").eqNullSafe(F.col("f")))
    own = marked.groupBy("company", "part").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("mask"))
    return funds, written(own, "fund-masks")


def one_bit_each(masks: DataFrame) -> DataFrame:
    """A row for each bit of ``mask`` that is set, with ``bit``."""
    return masks.withColumn("bit", F.explode(F.array(*map(F.lit, range(64))))).where(F.getbit("mask", F.col("bit")) == 1)


def top_chokepoints(holds: DataFrame, step: DataFrame) -> DataFrame:
    """fund, node: the node within two hops that most of a fund's holdings reach and that the fund doesn't hold (ties: the smaller id).

    Holdings go along the edges in lists, each with the funds that hold it as bits, and are counted where they meet. holds: fund, company. step: ``links``. Both are taken several times."""
    funds, own = fund_masks(holds)
    before = step.join(own, F.col("src") == F.col("company")).select(F.col("dst").alias("k"), F.struct("company", "part", "mask").alias("v"))
    before = written(listed(before), "chokepoint-lists")
    told = before.select(F.col("k").alias("node"), "list").unionByName(step.join(before, F.col("src") == F.col("k")).select(F.col("dst").alias("node"), "list"))
    pairs = told.repartition(F.col("node")).select("node", F.explode("list").alias("v")).select("node", "v.*").where("company <> node").distinct()
    counts = one_bit_each(pairs).groupBy("node", "part", "bit").agg(F.count("*").alias("n"))
    held = own.select(F.col("company").alias("c"), F.col("part").alias("p"), F.col("mask").alias("m"))
    free = counts.join(held, (F.col("node") == F.col("c")) & (F.col("part") == F.col("p")), "left").where(F.col("m").isNull() | (F.getbit("m", F.col("bit")) == 0))
    top = free.groupBy("part", "bit").agg(F.min_by("node", F.struct((-F.col("n")).alias("n"), "node")).alias("node"))
    return funds.join(top, ["part", "bit"]).select("fund", "node")


def supplier_dependents(edges: DataFrame, companies: DataFrame, hops: int = 2) -> DataFrame:
    """company, dependent, hops: those that reach a company within ``hops`` steps, and the company itself at 0."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    own = companies.select("company").distinct()
    reached = reach_min_hops(back, own, hops).select(F.col("seed").alias("company"), F.col("node").alias("dependent"), "hops")
    return own.select("company", F.col("company").alias("dependent"), F.lit(0).alias("hops")).unionByName(reached)


def dependents_of_any(edges: DataFrame, companies: DataFrame, hops: int = 2) -> DataFrame:
    """dependent: those that reach any of the companies within ``hops`` steps, and the companies themselves; each once. Grows with edges, not with pairs."""
    step = written(links(edges), "dependent-steps")
    front = found = companies.select(F.col("company").alias("dependent")).where("dependent is not null").distinct()
    for _ in range(hops):
        front = written(step.join(front, F.col("dst") == F.col("dependent"), "left_semi").select(F.col("src").alias("dependent")).distinct(), "dependents")
        found = found.unionByName(front)
    return found.distinct()


def least_via(rows: DataFrame, key: str, hops: int) -> DataFrame:
    """``key``, at, via: the smallest of the nodes on the way, for each ``key`` and at. One node is compared as a number, which needs no sort."""
    if hops > 2:
        return rows.groupBy(key, "at").agg(F.min("via").alias("via"))
    return rows.groupBy(key, "at").agg(F.min(F.get("via", F.lit(0))).alias("v")).select(key, "at", F.array("v").alias("via"))


def paths_from(step: DataFrame, ends: DataFrame, key: str, hops: int) -> dict[int, DataFrame]:
    """Steps -> (``key``, at, via): the smallest path of that many steps to each node, by the nodes between. Grows with nodes reached, not with paths."""
    own, none = ends.select(F.col(key)).distinct(), F.array().cast("array<long>")
    out = {0: own.select(key, F.col(key).alias("at"), none.alias("via"))}
    for d in range(1, hops + 1):
        ahead = out[d - 1].join(step, F.col("at") == F.col("src")).select(key, F.col("dst").alias("at"), F.concat("via", F.array("at")).alias("via") if d > 1 else none.alias("via"))
        # A first step is there once.
        out[d] = written(least_via(ahead, key, d) if d > 1 else ahead, "paths-from")
    return out


#: Values that one row of a list holds at about most.
LIST = 500


def listed(pairs: DataFrame) -> DataFrame:
    """k, list: the values ``v`` of each ``k``, those of a hot one over several rows."""
    parts = pairs.groupBy(F.col("k").alias("k2")).agg(F.ceil(F.count("*") / LIST).cast("int").alias("parts"))
    dealt = pairs.join(parts, F.col("k") == F.col("k2")).select("k", "v", F.pmod(F.xxhash64("v"), F.col("parts")).alias("p"))
    return dealt.groupBy("k", "p").agg(F.collect_list("v").alias("list")).select("k", "list")


def exposure_paths(edges: DataFrame, pairs: DataFrame, most: int = 5) -> DataFrame:
    """a, b, hops, path, labels: a shortest directed supply path of at most ``most`` steps for each pair (a, b), the smallest on ties,
    with what each edge is (its component, else its criticality).

    Paths from a and into b meet in the middle, so neither side goes more than half the way. A step that is left over between the halves is taken
    for the pairs that have not met by then, whole lists of successors against whole lists of starts; what meets is looked up again."""
    edges = written(edges.select("src", "dst", F.coalesce("component", "criticality", F.lit("supplies_to")).alias("label")), "path-edges")
    step = written(links(edges), "path-steps")
    asked = written(pairs.select("a", "b").distinct().where("a <> b"), "path-pairs")
    half = most // 2
    ahead, turned = paths_from(step, asked, "a", max(half, 1)), paths_into(step, asked, "b", half)
    found = None
    for d in range(1, max(half, 1) + 1):
        # Each half from a meets both halves into b that it is for at once.
        rights = [turned[r].select(F.col("b").alias("b2"), F.col("at").alias("m2"), F.col("via").alias("rest"), F.lit(r).alias("r")) for r in ((d - 1, d) if half else (0,))]
        right = rights[0] if len(rights) == 1 else rights[0].unionByName(rights[1])
        left = ahead[d].select("a", F.col("at").alias("m"), "via")
        met = asked.join(left, "a").join(right, (F.col("b") == F.col("b2")) & (F.col("m") == F.col("m2")))
        end = F.when(F.col("r") > 0, F.array("b")).otherwise(F.array().cast("array<long>"))
        here = met.select("a", "b", (F.col("r") + d).alias("hops"), F.concat(F.array("a"), "via", F.array("m"), "rest", end).alias("path"))
        found = here if found is None else found.unionByName(here)
    if half and most % 2:
        found = written(found, "paths-met")
        apart = asked.join(found.select("a", "b").distinct(), ["a", "b"], "left_anti")
        starts = listed(turned[half].select(F.col("b").alias("k"), F.col("at").alias("v"))).select(F.col("k").alias("b2"), F.col("list").alias("starts"))
        after = listed(step.select(F.col("src").alias("k"), F.col("dst").alias("v"))).select(F.col("k").alias("src"), F.col("list").alias("next"))
        at = apart.join(ahead[half].select("a", F.col("at").alias("m")), "a").join(after, F.col("m") == F.col("src")).select("a", "b", "m", "next")
        over = at.join(starts, F.col("b") == F.col("b2")).where(F.arrays_overlap("next", "starts"))
        over = written(over.select("a", "b", "m", F.explode(F.array_intersect("next", "starts")).alias("m2")).distinct(), "paths-over")
        left, right = ahead[half].select(F.col("a").alias("a1"), F.col("at").alias("m1"), "via"), turned[half].select(F.col("b").alias("b2"), F.col("at").alias("m3"), F.col("via").alias("rest"))
        whole = over.join(left, (F.col("a") == F.col("a1")) & (F.col("m") == F.col("m1"))).join(right, (F.col("b") == F.col("b2")) & (F.col("m2") == F.col("m3")))
        found = found.unionByName(whole.select("a", "b", F.lit(most).alias("hops"), F.concat(F.array("a"), "via", F.array("m"), F.array("m2"), "rest", F.array("b")).alias("path")))
    best = found.groupBy("a", "b").agg(F.min(F.struct("hops", "path")).alias("x")).select("a", "b", "x.hops", "x.path")
    each = best.select("a", "b", F.posexplode(F.expr("transform(sequence(1, hops), i -> struct(element_at(path, i) as u, element_at(path, i + 1) as v))")).alias("i", "e"))
    named = edges.groupBy("src", "dst").agg(F.min("label").alias("label"))
    labels = each.join(named, (F.col("e.u") == F.col("src")) & (F.col("e.v") == F.col("dst"))).groupBy("a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "label"))), lambda x: x["label"]), ">").alias("labels"))
    return best.join(labels, ["a", "b"]).select("a", "b", "hops", F.array_join(F.transform("path", lambda v: v.cast("string")), ">").alias("path"), "labels")


def paths_into(step: DataFrame, ends: DataFrame, key: str, hops: int) -> dict[int, DataFrame]:
    """Like ``paths_from``, for paths that end in ``key`` and start at ``at``."""
    own, none = ends.select(F.col(key)).distinct(), F.array().cast("array<long>")
    out = {0: own.select(key, F.col(key).alias("at"), none.alias("via"))}
    for d in range(1, hops + 1):
        before = out[d - 1].join(step, F.col("at") == F.col("dst")).select(key, F.col("src").alias("at"), F.concat(F.array("at"), "via").alias("via") if d > 1 else none.alias("via"))
        out[d] = written(least_via(before, key, d) if d > 1 else before, "paths-into")
    return out


def funds_holding(holds: DataFrame, companies: DataFrame) -> DataFrame:
    """Funds that hold any of the companies, with how many and their weight."""
    return holds.join(companies.select("company").distinct(), "company", "left_semi").groupBy("fund").agg(F.countDistinct("company").alias("n_held"), F.round(F.sum(exact("weight_pct")).cast("double"), 6).alias("weight"))


def repoint(edges: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Edges after duplicates (dup, canon) are merged into their canonical node: self-loops go, equal edges become one."""
    a = duplicates.select(F.col("dup").alias("src"), F.col("canon").alias("new_src"))
    b = duplicates.select(F.col("dup").alias("dst"), F.col("canon").alias("new_dst"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst"), "component", F.col("new_src").isNotNull() | F.col("new_dst").isNotNull())
    moved = moved.toDF("src", "dst", "component", "moved").where("src <> dst")
    # A duplicate's edge properties win.
    return moved.groupBy("src", "dst").agg(F.max(F.struct("moved", "component"))["component"].alias("component"), F.count("*").alias("n_merged"))
