"""Quality rules with adaptive thresholds.

Every text gets a handful of measures. Their distribution per language and source is held in
mergeable log-bucket quantile sketches (relative error ``ALPHA``); a sketch is a set of bucket counts, so sketches
of a language or of everything are sums of the finer ones. Rows that fail the base rule are not sketched. A group's
thresholds are read from its sketch: the higher of the Tukey fence and the ``TAIL`` quantile, and for the mean word length a
lower fence in the same way. They stay within a factor ``APART`` of the language's, and those of a language of the
thresholds of all rows, so a source that is mostly junk can't lift its own fence. They are joined to the measures and
applied. Native DataFrame expressions throughout.

Most texts repeat no line, so the fence of repeated lines is often zero and would make any repeated line an outlier. There the fence is read from a
second sketch, of the texts that do repeat some: the nearest of the source, the language and all rows whose fence is above zero or that
has ``min_group`` such texts decides. It isn't held to its parent's: a source of songs may repeat lines as it likes, and text that repeats itself
throughout fails the base rule.

Nulls and edge cases: a null text has no words and fails the base rule; null ``lang`` or ``source`` form a group of
their own; a group with fewer than ``min_group`` sketched rows uses its language's thresholds, and such a language those of all
rows, there with the least fences of ``SLACK``; repeated rows are measured one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fundloom.llm.shared import SPACE, let, words_of, written

ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Quantile above which rows may be outliers, and how many times its parent's a group's fence may be (and a fraction of it).
TAIL, APART = 0.95, 2.0
#: Measure -> what a text may have beyond its fence, so that one stray symbol or one repeated window of 3 words is no outlier in a group of
#: spotless texts, whose fences are at zero.
STRAY = {"symbol_rate": ("n_symbols", 1), "repeat_rate": ("n_repeat_words", 6)}
#: The measure of texts that repeat lines, among themselves.
SOME = "dup_line_some"
#: Measure -> least upper fence over all rows, for languages with too few rows to have fences of their own.
SLACK = {"symbol_rate": 0.05, "dup_line_rate": 0.2, "repeat_rate": 0.2, "mean_word": 12.0}


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text has twice or more. Windows are compared by 64-bit hash."""

    def windows(w: Column) -> Column:
        last = F.size(w) - 3
        spots = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def spots_of_repeats(t: Column) -> Column:
        pairs = F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        kept = let(pairs, lambda s: F.filter(s, lambda x, i: same(s, x, i - 1) | same(s, x, i + 1)))
        return F.sort_array(F.transform(kept, lambda x: x["p"]))

    def covered(spots: Column) -> Column:
        gaps = let(spots, lambda s: F.transform(s, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - p, F.lit(3)))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def count(t: Column) -> Column:
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(covered(spots_of_repeats(t)))

    return let(words, lambda w: let(windows(w), count)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the measures of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = docs.select("doc_id", "lang", "source", text.alias("text"), words_of(F.col("text")).alias("w"))
    base = words.select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )
    return base.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words", F.col("lines.n").alias("n_lines"))


def rates(stray: bool = False) -> dict[str, Column]:
    """The measures that are judged; with ``stray``, after what a text may have beyond its fence."""

    def over(measure: str, a: str, b: str) -> Column:
        few = STRAY[measure][1] if stray and measure in STRAY else 0
        return F.when(F.col(b) > 0, F.greatest(F.col(a) - few, F.lit(0)) / F.col(b)).otherwise(F.lit(0.0))

    of = {"symbol_rate": ("n_symbols", "word_chars"), "dup_line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words"), "mean_word": ("word_chars", "n_words")}
    return {m: over(m, *ab) for m, ab in of.items()}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketches(measured: DataFrame) -> DataFrame:
    """Bucket counts per (lang, source), per lang and over all; ``level`` 0, 1, 2. Bucket -100000 holds zeros."""
    told = rates()
    told[SOME] = F.when(told["dup_line_rate"] > 0, told["dup_line_rate"])
    values = F.explode(F.create_map(*[x for k, v in told.items() for x in (F.lit(k), v)])).alias("measure", "value")
    bucket = F.when(F.col("value") > 0, F.ceil(F.log(F.col("value")) / math.log(GAMMA)).cast("int")).otherwise(F.lit(-100_000))
    fine = measured.select("lang", "source", values).where("value is not null").groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    by_lang = fine.groupBy("lang", F.lit(None).cast("string").alias("source"), "measure", "bucket").agg(F.sum("n").alias("n")).withColumn("level", F.lit(1))
    overall = fine.groupBy(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "measure", "bucket").agg(F.sum("n").alias("n")).withColumn("level", F.lit(2))
    return fine.withColumn("level", F.lit(0)).unionByName(by_lang).unionByName(overall)


def thresholds(counts: DataFrame, reach: float = 3.0) -> DataFrame:
    """One row per group: its size; the upper fence of each measure, ``q3 + reach * (q3 - q1)`` or the ``TAIL`` quantile if that
    is higher (over all rows ``SLACK`` at least; ``_raw``: without that); and ``_low``, the lower fence in the same way."""
    group = Window.partitionBy("level", "lang", "source", "measure")
    ranked = counts.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))
    value = F.when(F.col("bucket") == -100_000, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")) * 2 / (1 + GAMMA))
    at = lambda q: F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("all")), value))
    fences = ranked.groupBy("level", "lang", "source", "measure").agg(F.max("all").alias("size"), at(0.25).alias("q1"), at(0.75).alias("q3"), at(TAIL).alias("top"), at(1 - TAIL).alias("bottom"))
    spread = F.lit(reach) * (F.col("q3") - F.col("q1"))
    fences = fences.withColumns({"fence": F.greatest(F.col("q3") + spread, F.col("top")), "low": F.least(F.col("q1") - spread, F.col("bottom"))})
    picked = []
    for m, slack in SLACK.items():
        of = lambda c, m=m: F.max(F.when(F.col("measure") == m, c))
        least = F.when(F.col("level") == 2, F.greatest(F.col("fence"), F.lit(slack))).otherwise(F.col("fence"))
        picked += [of(least).alias(m), of(F.col("fence")).alias(f"{m}_raw"), of(F.col("low")).alias(f"{m}_low")]
    some = F.col("measure") == SOME
    picked += [F.max(F.when(some, F.col("fence"))).alias(SOME), F.coalesce(F.max(F.when(some, F.col("size"))), F.lit(0)).alias(f"{SOME}_n")]
    return fences.groupBy("level", "lang", "source").agg(F.max("size").alias("size"), *picked)


def near(own: Column, parent: Column) -> Column:
    """``own``, but within a factor ``APART`` of ``parent``."""
    return F.when(own.isNotNull(), F.least(F.greatest(own, parent / APART), parent * APART))


def quality_rules(docs: DataFrame, min_group: int = 50, reach: float = 3.0) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` for each row of ``docs``."""
    measured = written(measures(docs), "quality-measures")
    # A few numbers for each language and source, written so that the planner sees their true size.
    fences = written(thresholds(sketches(measured.where(~base_failed())), reach), "quality-thresholds")
    names = [*(f"{m}{end}" for m in SLACK for end in ("", "_raw", "_low")), SOME, f"{SOME}_n"]
    as_level = lambda n: fences.where((F.col("level") == n) & ((F.col("size") >= min_group) | F.lit(n == 2))).select(F.col("lang").alias(f"l{n}"), F.col("source").alias(f"s{n}"), F.struct(*names).alias(f"f{n}"))
    with_fences = (
        measured.join(as_level(0), F.col("lang").eqNullSafe(F.col("l0")) & F.col("source").eqNullSafe(F.col("s0")), "left")
        .join(as_level(1), F.col("lang").eqNullSafe(F.col("l1")), "left")
        .join(F.broadcast(as_level(2)), F.lit(True), "left")  # one row
    )

    def fence(m: str, end: str) -> Column:
        f0, f1, f2 = (F.col(f"f{n}")[m + end] for n in range(3))
        f1 = near(f1, f2)
        return F.coalesce(near(f0, f1), f1, F.col("f2")[m] if end == "_raw" else f2)

    def line_fence() -> Column:
        levels = [F.col(f"f{n}") for n in range(3)]
        own = [x for f in levels for x in (F.when(f["dup_line_rate_raw"] > 0, f["dup_line_rate_raw"]), F.when(f[f"{SOME}_n"] >= min_group, f[SOME]))]
        return F.coalesce(*own, F.lit(SLACK["dup_line_rate"]))

    # bool_or over the measures; the sketch's relative error is allowed for.
    outlier = F.lit(False)
    for m, rate in rates(stray=True).items():
        outlier = outlier | (rate > (line_fence() if m == "dup_line_rate" else fence(m, "_raw")) * (1 + 2 * ALPHA))
    outlier = outlier | (rates()["mean_word"] < fence("mean_word", "_low") * (1 - 2 * ALPHA))
    failed = base_failed()
    return with_fences.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~outlier).alias("kept"))
