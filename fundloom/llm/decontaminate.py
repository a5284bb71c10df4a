"""Benchmark decontamination by a hash set of normalised test n-grams.

Windows of ``window`` words of the benchmark items (an item of fewer words is one window) are hashed. The set that is broadcast are
the hashes of their first words (``LEAD``, or all of a shorter one): each position of a document costs one short hash and one
lookup, in one pass over its words. Only where that hits, whole windows are hashed, joined and verified word by word; hit words are
counted or removed. The set is broadcast while it has at most ``broadcast_rows`` hashes; a larger one is joined by a shuffled
merge join, with the same result. Windows stand for the set of items that hold them, so a window common to many items is one row a
document. Native expressions throughout.

Nulls and edge cases: a null text has no words; rows with a null ``doc_id`` and rows that repeat one are judged by their
own text (told apart by a text hash); items without words have no window; equal windows of several items count for each
item; repeated benchmark rows change nothing; empty tables give no hits; other columns are ignored by
``contamination`` and carried along by ``clean_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fundloom.llm.shared import free_names, written

#: What separates words once A-Z are lower case. Upper case counts as a word here and is lowered word by word.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a window that are looked for first.
LEAD = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def norm_words(text: Column) -> Column:
    lowered = lambda w: F.when(w.rlike("[A-Z]"), F.translate(w, UPPER, LOWER)).otherwise(w)
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), ""), lowered)


def row_key() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]


def hash_at(words: str, pos: str, n: int) -> str:
    return f"xxhash64({', '.join(f'get({words}, {pos} + {k})' for k in range(n))})"


def by_length(n: Column, make, most: int) -> Column:
    """``make(k)`` where ``n`` is ``k``, for 1 to ``most``."""
    return F.coalesce(*[F.when(n == k, make(k)) for k in range(1, most + 1)])


def benchmark_windows(benchmark: DataFrame, window: int = 10) -> DataFrame:
    """n (words in the window), hash, lead (hash of its first words), said, items: the distinct windows and who holds them."""
    items = benchmark.select("item_id", norm_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.lit(window), F.size("w"))
    each = items.select("item_id", "w", n.alias("n"), F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("p"))
    said = F.array_join(F.slice("w", F.col("p") + 1, F.col("n")), " ")
    hashed = lambda most: by_length(F.least("n", F.lit(most)), lambda k: F.expr(hash_at("w", "p", k)), most)
    each = each.select(F.col("item_id").cast("string").alias("item"), "n", hashed(window).alias("hash"), hashed(min(LEAD, window)).alias("lead"), said.alias("said"))
    return each.groupBy("n", "hash", "lead", "said").agg(F.sort_array(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, windows: DataFrame, broadcast_rows: int = 2_000_000) -> DataFrame:
    """doc_id, text_hash, pos, n, held of every verified occurrence of a window; held names its items. ``windows``: as read from a table."""
    # At most ``window`` values.
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())
    words = docs.select(*row_key(), norm_words(F.col("text")).alias("w"))
    whole = windows.select(F.col("n").alias("n2"), F.col("hash").alias("hash2"), F.col("said").alias("said2"), F.xxhash64("items").alias("held"))
    found = None
    for lead in sorted({min(n, LEAD) for n in lengths}):
        own = [n for n in lengths if min(n, LEAD) == lead]
        leads = windows.where(F.least("n", F.lit(LEAD)) == lead).select(F.col("lead").alias("known")).distinct()
        small = leads.count() <= broadcast_rows
        spots = f"case when size(w) >= {lead} then sequence(0, size(w) - {lead}) else cast(array() as array<int>) end"
        scanned = words.select("doc_id", "text_hash", "w", F.posexplode(F.expr(f"transform({spots}, i -> {hash_at('w', 'i', lead)})")).alias("pos", "at"))
        met = scanned.join(F.broadcast(leads) if small else leads.hint("merge"), F.col("at") == F.col("known"), "left_semi")
        # Whole windows of each length, where as many words follow.
        each = ", ".join(f"case when pos + {n} <= size(w) then struct({n} as n, {hash_at('w', 'pos', n)} as hash, array_join(slice(w, pos + 1, {n}), ' ') as said) end" for n in own)
        each = met.select("doc_id", "text_hash", "pos", F.explode(F.expr(f"array_compact(array({each}))")).alias("x")).select("doc_id", "text_hash", "pos", "x.*")
        each = each.hint("merge").join(whole.where(F.col("n2").isin(own)).hint("merge"), (F.col("n") == F.col("n2")) & (F.col("hash") == F.col("hash2")) & (F.col("said") == F.col("said2"))).select("doc_id", "text_hash", "pos", "n", "held")
        found = each if found is None else found.unionByName(each)
    if found is None:
        found = words.select("doc_id", "text_hash", F.lit(0).alias("pos"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("held")).where(F.lit(False))
    return found.distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_rows: int = 2_000_000) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, items (distinct ids as sorted strings) for each row of ``docs``."""
    windows = written(benchmark_windows(benchmark, window), "benchmark-windows")
    found = written(hits(docs, windows, broadcast_rows), "benchmark-hits")
    by = Window.partitionBy("doc_id", "text_hash").orderBy("pos", "n")
    stop = F.col("pos") + F.col("n")
    before = F.coalesce(F.max(stop).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = found.select("doc_id", "text_hash", F.greatest(F.lit(0), stop - F.greatest("pos", before)).alias("new")).groupBy("doc_id", "text_hash").agg(F.sum("new").alias("n_hit"))
    # A document has few sets of items; each is a list that the benchmark bounds.
    sets = written(windows.select(F.xxhash64("items").alias("set"), "items").dropDuplicates(["set"]), "benchmark-sets")
    ids = found.select("doc_id", "text_hash", "held").distinct().hint("merge").join(sets.hint("merge"), F.col("held") == F.col("set"))
    items = ids.groupBy(F.col("doc_id").alias("d2"), F.col("text_hash").alias("h2")).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    told = covered.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    told = told.join(items, F.col("d").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left").drop("d2", "h2")
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), BETWEEN), "")).cast("long")
    keys = docs.select(*row_key(), n_words.alias("n_words"))
    return keys.join(told, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, **kind) -> DataFrame:
    told = contamination(docs, benchmark, **kind)
    return told.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **kind) -> DataFrame:
    """Rows of ``docs`` without any hit; all their columns."""
    d, h = free_names(docs, 2)
    bad = contamination(docs, benchmark, **kind).where("n_hit > 0").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(d)) & (row_key()[1] == F.col(h)), "left_anti")
