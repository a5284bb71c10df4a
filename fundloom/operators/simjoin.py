"""Joins of names by containment and by sequence ratio: all pairs that match are found, few others are looked at.

Both sides are tables with one column of distinct strings, ``a`` and ``b``. Empty strings match nothing; case is as given.

Containment: a short string stands under its rarest run of ``q`` characters (under itself, if it is shorter), a long one under all its runs of
the lengths that the short side needs; who meets is compared whole.

Ratio: 2 M / (len a + len b) with M matched characters. At a ratio of ``least`` M is known to be ceil(least * T / 2) at least, T both lengths, so so many characters
are common. Each unmatched one parts two matched neighbours at most, hence 3 M - T - 1 neighbour pairs (bigrams, the k-th of equal ones told apart) are common too.
Names are dealt into bands of lengths and these into parts; parts whose lengths may match meet in one task each, where one product of tables gives the common
characters of all pairs. All pairs of like lengths are looked at so: some nanoseconds each, in bounded memory. (An index of bigrams or of pieces of three or four characters,
all that the bound leaves of short names, brings most pairs together too, and one by one.)
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundloom.functions import ratios
from fundloom.sources.tables import written

#: Names that a part of a band takes (of 20 characters; fewer of longer ones), and how much longer the names of the next band are.
PART, BAND = 20_000, 1.12
#: Columns of characters of their own and of shared ones, and names of one side that are compared at once.
OWN, SHARED, TILE = 48, 14, 512


def grams(text: Column, q: Column | int) -> Column:
    """All runs of ``q`` characters, in order."""
    q = F.lit(q) if isinstance(q, int) else q
    n = F.char_length(text) - q + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(text, i, q))).otherwise(F.array().cast("array<string>"))


def containment_pairs(long: DataFrame, short: DataFrame, q: int = 6) -> DataFrame:
    """a, b with ``b`` somewhere in ``a``. long: a. short: b."""
    long, short = long.where("a <> ''").select("a").distinct(), short.where("b <> ''").select("b").distinct()
    keys = short.select("b", F.least(F.char_length("b"), F.lit(q)).alias("n"))
    # At most q lengths.
    needed = [r["n"] for r in keys.select("n").distinct().collect()]
    if not needed:
        return long.sparkSession.createDataFrame([], "a string, b string")
    under = written(long.select("a", F.explode(F.array_distinct(F.concat(*[grams(F.col("a"), n) for n in sorted(needed)]))).alias("gram")), "gram-index")
    counts = under.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("n_under"))
    own = keys.select("b", F.explode(F.array_distinct(grams(F.col("b"), F.col("n")))).alias("gram"))
    # A run that no long string has rules its string out, so the rarest is among those found only if all are.
    found = own.hint("merge").join(counts.hint("merge"), F.col("gram") == F.col("g"), "left")
    rarest = written(found.groupBy("b").agg(F.min(F.struct(F.coalesce("n_under", F.lit(0)).alias("n"), "gram")).alias("x")).where("x.n > 0").select("b", F.col("x.gram").alias("k"), F.col("x.n").alias("n")), "gram-keys")
    return under.hint("merge").join(rarest.hint("merge"), (F.col("gram") == F.col("k")) & F.contains("a", "b")).select("a", "b")


def bands_that_meet(sizes: list, least: float) -> list[tuple]:
    """(band of a, its parts, band of b, its parts) of all lengths that may match. sizes: side, band, rows, chars, shortest, longest."""
    short = least / (2 - least)
    parts = lambda r: math.ceil(max(r["rows"] / PART, r["chars"] / (PART * 20)))
    a, b = ([r for r in sizes if r["side"] == side] for side in "ab")
    return [(x["band"], parts(x), y["band"], parts(y)) for x in a for y in b if y["longest"] >= x["shortest"] * short - 1e-9 and x["longest"] >= y["shortest"] * short - 1e-9]


def runs_of(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each run of one or two characters; the k-th of equal ones in a row has a number of its own."""
    n = np.array([len(t) for t in texts])
    code, row = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64), np.repeat(np.arange(len(texts)), n)
    if size == 2:
        same = row[1:] == row[:-1]
        code, row = (code[:-1] << np.uint64(21) | code[1:])[same], row[:-1][same]
    order = np.lexsort((code, row))
    code, row = code[order], row[order]
    first = np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])][: len(code)]
    at = np.arange(len(code))
    return row, code << np.uint64(20) | (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)


def counts_of(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For both sides a row of numbers for each text; the product of two rows is what they have of the same characters, or more. The most common characters
    have a column each, the others share some."""
    (row_a, x), (row_b, y) = runs_of(a, 1), runs_of(b, 1)
    kinds, inverse, often = np.unique(np.r_[x, y], return_inverse=True, return_counts=True)
    place = np.empty(len(kinds), np.int64)
    place[np.argsort(-often, kind="stable")] = np.arange(len(kinds))
    column = np.where(place < OWN, place, OWN + place % SHARED)[inverse]
    table = lambda row, c, n: np.bincount(row * (OWN + SHARED) + c, minlength=n * (OWN + SHARED)).reshape(n, OWN + SHARED).astype(np.float32)
    return table(row_a, column[: len(x)], len(a)), table(row_b, column[len(x) :], len(b))


def bigram_bits(texts: list[str]) -> np.ndarray:
    """256 bits for each text, one set by each of its bigrams. Bits that one text has and another lacks are at most as many as the bigrams that it alone has."""
    row, code = runs_of(texts, 2)
    bit = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    set_ = np.zeros((len(texts), 256), bool)
    set_[row, bit.astype(int)] = True
    return np.packbits(set_, axis=1).view(np.uint64)


def alike_in_block(a: list[str], b: list[str], least: float) -> list[tuple[str, str, float]]:
    """All pairs of two lists whose ratio is ``least`` or more, with it. Counts of characters of all pairs are one product of tables; what passes
    is held against bigrams, then against the longest common subsequence."""
    if not a or not b:
        return []
    out, (x, y), (p, q) = [], counts_of(a, b), (bigram_bits(a), bigram_bits(b))
    la, lb = np.array([len(t) for t in a]), np.array([len(t) for t in b])
    slack = 0.01 + 1e-6 * (la.max() + lb.max())
    # Two more columns take least / 2 of both lengths off.
    x = np.c_[x, -least / 2 * la + slack, np.ones(len(a))].astype(np.float32)
    y = np.c_[y, np.ones(len(b)), -least / 2 * lb].astype(np.float32)
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), 8 * TILE):
            at = np.flatnonzero(x[i : i + TILE] @ y[j : j + 8 * TILE].T >= 0)
            wide = min(8 * TILE, len(b) - j)
            u, v = at // wide + i, at % wide + j
            both = la[u] + lb[v]
            need = 3 * np.ceil(both * (least / 2) - 1e-9) - both - 1
            good = (np.bitwise_count(p[u] & ~q[v]).sum(axis=1) <= la[u] - 1 - need) & (np.bitwise_count(q[v] & ~p[u]).sum(axis=1) <= lb[v] - 1 - need)
            for k, m in zip(u[good], v[good], strict=True):
                if ratios.ratio(a[k], b[m]) >= least and (r := ratios.seq_ratio(a[k], b[m])) >= least:
                    out.append((a[k], b[m], r))
    return out


def ratio_pairs(left: DataFrame, right: DataFrame, least: float = 0.85) -> DataFrame:
    """a, b, ratio of all pairs whose sequence ratio is ``least`` or more. left: a. right: b."""
    if least <= 0.8:
        raise ValueError("the bound on common bigrams holds above 0.8")
    sides = []
    for side, df, c in (("a", left, "a"), ("b", right, "b")):
        sides.append(df.where(F.char_length(c) > 1).select(F.lit(side).alias("side"), F.col(c).alias("s")).distinct())
    n = F.char_length("s")
    strings = written(sides[0].unionByName(sides[1]).withColumn("band", F.floor(F.log(n) / math.log(BAND)).cast("int")), "ratio-names")
    # A row for each band, and lengths are within some hundred of them.
    sizes = strings.groupBy("side", "band").agg(F.count("*").alias("rows"), F.sum(n).alias("chars"), F.min(n).alias("shortest"), F.max(n).alias("longest")).collect()
    meet = bands_that_meet(sizes, least)
    own = lambda parts: F.pmod(F.xxhash64("s"), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    table = lambda: F.broadcast(strings.sparkSession.createDataFrame(meet, "i int, parts_i int, j int, parts_j int"))
    a = strings.where("side = 'a'").join(table(), F.col("band") == F.col("i")).select("i", own("parts_i").alias("p"), "j", each("parts_j").alias("q"), F.col("s").alias("a"))
    b = strings.where("side = 'b'").join(table(), F.col("band") == F.col("j")).select("i", each("parts_i").alias("p"), "j", own("parts_j").alias("q"), F.col("s").alias("b"))
    # A number of our own, as few bytes are much work here.
    tasks = max(4 * strings.sparkSession.sparkContext.defaultParallelism, int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    block = lambda df: df.repartition(tasks, "i", "p", "j", "q").groupBy("i", "p", "j", "q")

    def alike(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(alike_in_block(x["a"].tolist(), y["b"].tolist(), least), columns=["a", "b", "ratio"])

    return block(a).cogroup(block(b)).applyInPandas(alike, "a string, b string, ratio double")


def name_pairs(left: DataFrame, right: DataFrame, least: float = 0.85) -> DataFrame:
    """a, b: names that are equal, of which one holds the other, or whose ratio is ``least`` or more."""
    # Either side is taken several times.
    left, right = written(left.select("a").where("a <> ''").distinct(), "names"), written(right.select("b").where("b <> ''").distinct(), "names")
    held = containment_pairs(left, right)
    holds = containment_pairs(right.select(F.col("b").alias("a")), left.select(F.col("a").alias("b"))).select(F.col("b").alias("a"), F.col("a").alias("b"))
    return held.unionByName(holds).unionByName(ratio_pairs(left, right, least).select("a", "b")).distinct()


def first_of_alike(names: DataFrame, pairs: DataFrame, most_rounds: int = 200) -> DataFrame:
    """The names that stay when each, in order, is dropped if one that stays before it is alike. names: s, ord. pairs: earlier, later.

    A name that no undecided one precedes stays, those alike to it go, and what is left is looked at again; a chain of n names takes n/2 rounds."""
    edges, gone = written(pairs.select("earlier", "later").distinct(), "alike-pairs"), None
    for _ in range(most_rounds):
        if edges.isEmpty():
            break
        stays = edges.select(F.col("earlier").alias("s")).join(edges.select(F.col("later").alias("s")), "s", "left_anti").distinct()
        goes = written(edges.join(stays, F.col("earlier") == F.col("s"), "left_semi").select(F.col("later").alias("s")).distinct(), "alike-gone")
        gone = goes if gone is None else gone.unionByName(goes)
        edges = written(edges.join(goes, F.col("earlier") == F.col("s"), "left_anti").join(goes, F.col("later") == F.col("s"), "left_anti"), "alike-pairs")
    else:
        raise RuntimeError(f"the order of alike names did not settle in {most_rounds} rounds")
    return names if gone is None else names.join(gone, "s", "left_anti")
