"""Closures and rules over facts, evaluated by what is new: a round joins only the facts that the last one added.

Facts are (s, p, o). Axioms are tables: subclasses and subproperties (child, parent), equivalent classes (a, b), inverse properties (p, q; a symmetric one is its
own inverse), transitive properties (p), domains and ranges (p, cls). Nothing is derived from nulls; repeated facts count once. Facts that a
round adds are written once and never again; what is known is the union of these tables.

Axioms are as many as an ontology has, facts as many as the data: a few properties and classes have most facts, so the axioms go to the facts (broadcast), and
facts are never dealt by property or class alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundloom.sources.tables import written


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def closure(edges: DataFrame, by: tuple[str, ...] = (), most_rounds: int = 40) -> DataFrame:
    """(by,) child, ancestor, hops (least) of all pairs that a path of ``edges`` (by, child, parent) joins, paths staying within equal ``by``.

    After round r all pairs of up to 2^r steps are known. The next ones begin with a pair of just 2^r steps, so only those are joined with what is known: a
    chain of n steps takes log n rounds, and a pair is found once for each of its shortest paths' middles, not for each of its places."""
    keys = [*by, "child", "ancestor"]
    first = edges.withColumnRenamed("parent", "ancestor").where(" and ".join(f"{k} is not null" for k in keys)).select(*keys).distinct()
    frontier = written(first.withColumn("hops", F.lit(1).cast("long")), "closure")
    known = [frontier]
    for turn in range(most_rounds):
        step = frontier.where(F.col("hops") == 1 << turn)
        if step.isEmpty():
            return union(known)
        after = union(known).select(*by, F.col("child").alias("ancestor"), F.col("ancestor").alias("a2"), F.col("hops").alias("h2"))
        more = step.hint("merge").join(after.hint("merge"), [*by, "ancestor"]).groupBy(*by, "child", F.col("a2").alias("ancestor")).agg(F.min(F.col("hops") + F.col("h2")).alias("hops"))
        frontier = written(more.hint("merge").join(union(known).select(*keys).hint("merge"), keys, "left_anti"), "closure")
        known.append(frontier)
    raise RuntimeError(f"the closure did not settle in {most_rounds} rounds")


def from_single_facts(new: DataFrame, sub_property: DataFrame, both: DataFrame) -> DataFrame:
    """s, p, o: what each fact says by its properties above and its inverses, repeated ones included. both: p, q, in either order."""
    up = new.join(F.broadcast(sub_property.select(F.col("child").alias("p"), "parent")), "p").select("s", F.col("parent").alias("p"), "o")
    turned = new.join(F.broadcast(both), "p").select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o"))
    return up.unionByName(turned)


def paths_to_close(facts: DataFrame, changed: DataFrame, transitive: DataFrame) -> DataFrame:
    """The facts of those transitive properties that ``changed`` has facts of."""
    moved = changed.join(F.broadcast(transitive.select("p").distinct()), "p", "left_semi").select("p").distinct()
    return facts.join(F.broadcast(moved), "p", "left_semi")


def types_of_ends(facts: DataFrame, domain: DataFrame, range_: DataFrame) -> DataFrame:
    """instance, cls: what domains and ranges say, repeated ones included."""
    first = facts.join(F.broadcast(domain), "p").select(F.col("s").alias("instance"), "cls")
    return first.unionByName(facts.join(F.broadcast(range_), "p").select(F.col("o").alias("instance"), "cls"))


def by_single_facts(facts: DataFrame, sub_property: DataFrame, inverse: DataFrame, most_rounds: int = 40) -> list[DataFrame]:
    """Tables of ``facts`` and all that follows from one fact at a time; the first is ``facts``."""
    both = inverse.select("p", "q").unionByName(inverse.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct()
    known = [written(facts.where("s is not null and p is not null and o is not null").select("s", "p", "o").distinct(), "facts")]
    for _ in range(most_rounds):
        # Dealt first: what was made distinct before would fill each reading task with rows that hardly repeat.
        found = from_single_facts(known[-1], sub_property, both).repartition("s", "p", "o").distinct()
        more = written(found.hint("merge").join(union(known).hint("merge"), ["s", "p", "o"], "left_anti"), "facts")
        if more.isEmpty():
            return known
        known.append(more)
    raise RuntimeError(f"the rules did not settle in {most_rounds} rounds")


def inferred_facts(facts: DataFrame, sub_property: DataFrame, inverse: DataFrame, transitive: DataFrame, most_rounds: int = 40) -> DataFrame:
    """s, p, o: ``facts`` and all that subproperties, inverses and transitive properties add.

    Paths are closed for the transitive properties that got facts in the last turn; what that adds goes through the other rules again."""
    known = by_single_facts(facts, sub_property, inverse)
    changed = union(known)
    for _ in range(most_rounds):
        paths = paths_to_close(union(known), changed, transitive)
        closed = closure(paths.select("p", F.col("s").alias("child"), F.col("o").alias("parent")), ("p",)).where("hops > 1").select(F.col("child").alias("s"), "p", F.col("ancestor").alias("o"))
        more = written(closed.join(union(known), ["s", "p", "o"], "left_anti"), "facts")
        if more.isEmpty():
            return union(known)
        changed = written(union(by_single_facts(more, sub_property, inverse)).join(union(known), ["s", "p", "o"], "left_anti"), "facts")
        known.append(changed)
    raise RuntimeError(f"the rules did not settle in {most_rounds} rounds")


def inferred_types(types: DataFrame, facts: DataFrame, sub_class: DataFrame, equivalent: DataFrame, domain: DataFrame, range_: DataFrame) -> DataFrame:
    """instance, cls: given types, those that the domains and ranges of ``facts`` (with all that was inferred) say, and all classes above them."""
    same = equivalent.select(F.col("a").alias("child"), F.col("b").alias("parent")).unionByName(equivalent.select(F.col("b").alias("child"), F.col("a").alias("parent")))
    above = closure(sub_class.select("child", "parent").unionByName(same)).select("child", "ancestor")
    own = written(types.select("instance", "cls").unionByName(types_of_ends(facts, domain, range_)).where("instance is not null and cls is not null").distinct(), "types")
    return own.unionByName(own.join(F.broadcast(above), F.col("cls") == F.col("child")).select("instance", F.col("ancestor").alias("cls"))).distinct()
