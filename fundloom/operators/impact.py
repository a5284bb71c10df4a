"""Versioned fact sets: their difference, and what a change reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundloom.operators.traversal import dependents_of_any, fund_masks, links, listed, one_bit_each
from fundloom.sources.tables import written


def fact_diff(v1: DataFrame, v2: DataFrame, keys: list[str], carry: str | None = None) -> DataFrame:
    """Added, removed and changed facts; columns: the keys, payload and ord (``carry`` keeps it). Of an identity the last by ``ord`` counts. Null keys are equal to each other."""
    said = F.struct("ord", "payload")
    # Both versions in one grouping; told apart in windows and then joined, each was sorted and sent twice.
    every = v1.select(*keys, said.alias("said"), F.lit(True).alias("old")).unionByName(v2.select(*keys, said.alias("said"), F.lit(False).alias("old")))
    both = every.groupBy(*keys[::-1]).agg(F.max(F.when(F.col("old"), F.col("said"))).alias("a"), F.max(F.when(~F.col("old"), F.col("said"))).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a.payload").eqNullSafe(F.col("b.payload")), "changed")
    kept = [] if carry is None else [F.coalesce("b.ord", "a.ord").alias(carry)]
    return both.withColumn("change", change).where("change is not null").select(*keys, "change", F.col("a.payload").alias("old_value"), F.col("b.payload").alias("new_value"), *kept)


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count("*").alias("n"))


#: The rules: their name, the kind and name of the fact that triggers them, how they travel, which changes do.
RULES = [
    ("changed_issuer_to_funds", "entity", "Company", "HOLDS", ["added", "removed", "changed"]),
    ("changed_supplier_to_funds", "relation", "SUPPLIES_TO", "SUPPLIES_TO,HOLDS", ["added", "removed", "changed"]),
    ("changed_risk_to_disclosure", "relation", "EXPOSED_TO", "COVERS", ["added", "changed"]),
    ("changed_metric_to_reports", "entity", "MetricObservation", "DERIVED_FROM", ["added", "changed"]),
]
TRAVERSALS = ["HOLDS", "SUPPLIES_TO,HOLDS", "COVERS", "DERIVED_FROM"]


def trigger_match(diff: DataFrame, rules: list = RULES) -> DataFrame:
    """Changes with each rule that they trigger. The rules are a small list given with the job; one that travels otherwise is an error."""
    unknown = {r[3] for r in rules} - set(TRAVERSALS)
    if unknown:
        raise NotImplementedError(f"no way to travel {sorted(unknown)}")
    table = diff.sparkSession.createDataFrame(rules, "rule string, kind string, name string, traversal string, changes array<string>")
    return diff.join(F.broadcast(table), ["kind", "name"]).where(F.array_contains("changes", F.col("change"))).drop("changes")


def propagate(matched: DataFrame, holds: DataFrame, dependents: DataFrame, covers: DataFrame, derived: DataFrame) -> DataFrame:
    """What triggered changes reach: rule, target_kind (fund, section, report), target, via (what changed), held (the holding, for funds).

    matched: rule, traversal, subject, object, ord (the document). dependents: company, dependent. derived: report_id, kind, target."""
    by = lambda t: matched.where(F.col("traversal") == t)
    near = by("SUPPLIES_TO,HOLDS").select("rule", "subject").distinct().join(dependents, F.col("subject").try_cast("long") == F.col("company")).select("rule", "subject", F.col("dependent").alias("held"))
    direct = by("HOLDS").select("rule", "subject", F.col("subject").try_cast("long").alias("held"))
    once = lambda df, *c: df.select(*c).distinct()
    # Distinct on both sides, so the many rows that they make need not be told apart again.
    funds = near.unionByName(direct).distinct().join(once(holds, "fund", "company"), F.col("held") == F.col("company")).select("rule", F.lit("fund").alias("target_kind"), F.col("fund").cast("string").alias("target"), F.col("subject").alias("via"), "held")
    return funds.unionByName(documents_reached(matched, covers, derived))


def near_pairs(step: DataFrame, asked: DataFrame, held: DataFrame) -> DataFrame:
    """held, company: each asked company (company) with those of ``held`` (company) that reach it within two steps or are it; each pair once.

    Nodes hand on lists of the asked companies after them, and all that a holding is told meets in one place: pairs are sent once, in lists."""
    asked = asked.select("company").where("company is not null").distinct()
    ahead = written(listed(step.join(asked, F.col("dst") == F.col("company"), "left_semi").select(F.col("src").alias("k"), F.col("dst").alias("v"))), "asked-ahead")
    told = step.join(ahead, F.col("dst") == F.col("k")).select(F.col("src").alias("held"), "list").unionByName(ahead.select(F.col("k").alias("held"), "list")).unionByName(asked.select(F.col("company").alias("held"), F.array("company").alias("list")))
    known = told.join(held.select(F.col("company").alias("h")).distinct(), F.col("held") == F.col("h"), "left_semi")
    return known.repartition(F.col("held")).select("held", F.explode("list").alias("company")).distinct()


def propagate_along(matched: DataFrame, holds: DataFrame, edges: DataFrame, covers: DataFrame, derived: DataFrame) -> DataFrame:
    """``propagate`` with the dependents within two hops, its pairs made as ``near_pairs`` does. ``matched`` is taken several times."""
    step, once = written(links(edges), "reach-steps"), written(holds.select("fund", "company").distinct(), "reach-holdings")
    said = lambda t: matched.where(F.col("traversal") == t).select("rule", "subject", F.col("subject").try_cast("long").alias("company")).where("company is not null").distinct()
    near, plain = said("SUPPLIES_TO,HOLDS"), F.col("subject") == F.col("company").cast("string")
    # A changed one's number is its name, so names need not travel; rules are few. Other spellings of a number, if any, are looked up.
    passes = [near_pairs(step, near.where(plain & (F.col("rule") == r["rule"])), once).select(F.lit(r["rule"]).alias("rule"), F.col("company").cast("string").alias("subject"), "held") for r in near.where(plain).select("rule").distinct().collect()]
    odd = near.where(~plain)
    if not odd.isEmpty():
        passes.append(near_pairs(step, odd, once).join(odd.withColumnRenamed("company", "c"), F.col("company") == F.col("c")).select("rule", "subject", "held"))
    # What is near too is among those pairs.
    direct = said("HOLDS").join(near, ["rule", "subject"], "left_anti").select("rule", "subject", F.col("company").alias("held"))
    funds = None
    for reached in [*passes, direct]:
        here = reached.hint("merge").join(once.hint("merge"), F.col("held") == F.col("company")).select("rule", F.lit("fund").alias("target_kind"), F.col("fund").cast("string").alias("target"), F.col("subject").alias("via"), "held")
        funds = here if funds is None else funds.unionByName(here)
    return funds.unionByName(documents_reached(matched, covers, derived))


def documents_reached(matched: DataFrame, covers: DataFrame, derived: DataFrame) -> DataFrame:
    """The sections and reports of ``propagate``."""
    by = lambda t: matched.where(F.col("traversal") == t)
    once = lambda df, *c: df.select(*c).distinct()
    none = F.lit(None).cast("long").alias("held")
    sections = once(by("COVERS"), "rule", "subject", "object").join(covers, F.col("object") == F.col("risk_title")).select("rule", F.lit("section").alias("target_kind"), F.col("section_key").alias("target"), F.col("subject").alias("via"), none)
    packs = once(by("DERIVED_FROM"), "rule", "subject", "ord").join(derived.where("kind = 'Document'").select("report_id", F.col("target").alias("doc")), F.col("ord").cast("string") == F.col("doc")).select("rule", F.lit("report").alias("target_kind"), F.col("report_id").alias("target"), F.col("subject").alias("via"), none)
    return sections.distinct().unionByName(packs.distinct())


def holdings_reached(matched: DataFrame, holds: DataFrame, dependents: DataFrame) -> DataFrame:
    """The funds of ``propagate``, each holding once: target_kind, target, via (what changed, where that is the holding itself; else null), held.

    Grows with holdings, not with what each change reaches. matched: traversal, subject. dependents: dependent; those of any changed supplier, itself included."""
    held = F.col("subject").try_cast("long")
    own = matched.where(F.col("traversal").isin("HOLDS", "SUPPLIES_TO,HOLDS")).select(held.alias("held"), (F.col("subject") == held.cast("string")).alias("named"))
    marks = own.unionByName(dependents.select(F.col("dependent").alias("held"), F.lit(False).alias("named"))).groupBy("held").agg(F.bool_or("named").alias("named"))
    once = holds.select("fund", "company").distinct()
    return once.join(marks, F.col("company") == F.col("held")).select(F.lit("fund").alias("target_kind"), F.col("fund").cast("string").alias("target"), F.when(F.col("named"), F.col("held").cast("string")).alias("via"), "held")


def impact_rollup(reached: DataFrame) -> DataFrame:
    """Per target: what changed, by which rules, over how many holdings."""
    none = F.lit(None)
    said = F.array(F.struct("rule", "via", none.cast("long").alias("held")), F.struct(none.cast("string").alias("rule"), none.cast("string").alias("via"), F.col("held").cast("long").alias("held")))
    # What is said of a target, each thing once; few rows are left to be counted.
    once = reached.select("target_kind", "target", F.explode(said).alias("x")).select("target_kind", "target", "x.*").distinct()
    return once.groupBy("target_kind", "target").agg(F.countDistinct("via").alias("n_via"), F.count("held").alias("n_held"), names_of(F.col("rule")).alias("rules"))


def rollup(matched: DataFrame, holds: DataFrame, edges: DataFrame, covers: DataFrame, derived: DataFrame, hops: int = 2) -> DataFrame:
    """``impact_rollup`` of what ``propagate`` gives with the dependents within ``hops`` steps, without making it: sets of funds go from each holding along the edges to what it
    depends on, a bit for each fund, and sections about the same risks are counted once. Grows with edges and holdings, not with what each change reaches."""
    step, once = written(links(edges), "rollup-steps"), written(holds.select("fund", "company").distinct(), "rollup-holdings")
    funds, own = fund_masks(once)
    both = lambda df, *keys: df.groupBy(*keys, "part").agg(F.bit_or("mask").alias("mask"))
    near = own
    for _ in range(hops):
        ahead = near.join(step, F.col("company") == F.col("src")).select(F.col("dst").alias("company"), "part", "mask")
        near = written(both(near.unionByName(ahead), "company"), "fund-masks")
    said = lambda t, masks: matched.where(F.col("traversal") == t).select("rule", "subject").distinct().join(masks, F.col("subject").try_cast("long") == F.col("company")).select("rule", "subject", "part", "mask")
    told = written(said("HOLDS", own).unionByName(said("SUPPLIES_TO,HOLDS", near)), "rollup-said")
    n_via = one_bit_each(both(told, "subject")).groupBy("part", "bit").agg(F.count("*").alias("n_via"))
    rules = one_bit_each(both(told, "rule")).groupBy(F.col("part").alias("p2"), F.col("bit").alias("b2")).agg(names_of(F.col("rule")).alias("rules"))
    asked = matched.where("traversal = 'SUPPLIES_TO,HOLDS'").select(F.col("subject").try_cast("long").alias("company"))
    n_held = holdings_reached(matched, once, dependents_of_any(step, asked, hops)).groupBy(F.col("target").alias("t")).agg(F.count("*").alias("n_held"))
    counted = funds.join(n_via, ["part", "bit"]).join(rules, (F.col("part") == F.col("p2")) & (F.col("bit") == F.col("b2"))).withColumn("target", F.col("fund").cast("string"))
    by_fund = counted.join(n_held, F.col("target").eqNullSafe(F.col("t"))).select(F.lit("fund").alias("target_kind"), "target", "n_via", "n_held", "rules")
    reports = impact_rollup(documents_reached(matched.where("traversal = 'DERIVED_FROM'"), covers, derived))
    return by_fund.unionByName(sections_rollup(matched, covers)).unionByName(reports)


def names_of(rule: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(rule)), ",")


def sections_rollup(matched: DataFrame, covers: DataFrame) -> DataFrame:
    """The sections of ``impact_rollup``. Those about the same risks have the same counts."""
    about = written(covers.groupBy("section_key").agg(F.array_sort(F.collect_set("risk_title")).alias("risks")), "section-risks")
    each = about.select("risks").distinct().select("risks", F.explode("risks").alias("risk"))
    met = written(matched.where("traversal = 'COVERS'").select("rule", "subject", "object").distinct().join(each, F.col("object") == F.col("risk")).select("rule", "subject", "risks").distinct(), "risks-changed")
    n_via = met.select("risks", "subject").distinct().groupBy("risks").agg(F.count("subject").alias("n_via"))
    rules = met.groupBy(F.col("risks").alias("r2")).agg(names_of(F.col("rule")).alias("rules"))
    counted = n_via.join(rules, F.col("risks") == F.col("r2")).select(F.col("risks").alias("r3"), "n_via", "rules")
    return about.join(counted, F.col("risks") == F.col("r3")).select(F.lit("section").alias("target_kind"), F.col("section_key").alias("target"), "n_via", F.lit(0).cast("long").alias("n_held"), "rules")


def apply_flags(nodes: DataFrame, flagged: DataFrame, key: str, flag: str) -> DataFrame:
    """``nodes`` with a boolean column that says whether the key is flagged."""
    marks = flagged.select(F.col("target").alias("_t")).distinct()
    return nodes.join(marks, F.col(key).cast("string") == F.col("_t"), "left").withColumn(flag, F.col("_t").isNotNull()).drop("_t")
