"""Secret scans by multipart credential linking.

Parts of credentials are found in each text: access identifiers, secrets and endpoints, strong ones and weak ones. A
strong part is a finding by itself. A weak one is reported only when a complementary part lies within its scope
(``scope`` code points between the two): an interval join of weak candidates with all parts, bucketed by scope, decides.
Native expressions throughout: positions come from the lengths of the matches and of the pieces between them.

Nulls and edge cases: a null text is empty and has no spans; an empty text likewise; rows with a null ``doc_id`` and
rows that repeat a ``doc_id`` get the spans of their own text (rows are told apart by ``doc_id`` and a text hash);
matches of one kind never overlap, those of different kinds may; an empty table gives an empty result; other columns
are ignored by ``secret_spans`` and carried along by ``redacted``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fundloom.llm.shared import free_names, written

#: The patterns of the base kinds and of the weaker parts. Group 2 of the assignments is the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
IDENT = r"""((?i:user_?name|user|login|client_?id|access_?key_?id|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)"""
ENDPOINT = r"""((?i:https?|ftps?|sftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://)([^\x20\x09-\x0D"'<>]+)"""
#: Pattern -> (length that counts: whole match or group 2, strong kind, least length, weak kind, least length, role).
PARTS = [
    (ASSIGN, 2, "assign", 8, "weak_assign", 4, "secret"),
    (ACCESS, 0, "access", 16, "weak_access", 8, "identifier"),
    (HEX, 0, "hex", 32, "weak_hex", 16, "secret"),
    (IDENT, 2, None, 0, "ident", 3, "identifier"),
    (ENDPOINT, 2, None, 0, "endpoint", 4, "endpoint"),
]
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "weak_assign", "weak_access", "weak_hex", "ident", "endpoint"]


def row_key() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]


def matches(text: Column, n: int) -> Column:
    """Matches of pattern ``n`` in order: code points between it and the last one, its length, the length that counts."""
    pattern, group = PARTS[n][:2]
    gaps = F.transform(F.split(text, pattern), lambda x: F.char_length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = (lambda x: F.char_length(F.regexp_extract(x, pattern, group))) if group else (lambda x: F.char_length(x))
    each = F.transform(F.arrays_zip(found.alias("m"), gaps.alias("gap")), lambda x, i: F.struct(F.lit(n).alias("part"), i.alias("i"), x["gap"].alias("gap"), F.char_length(x["m"]).alias("len"), F.when(x["m"].isNotNull(), counted(x["m"])).alias("counted")))
    each = F.filter(each, lambda x: x["len"].isNotNull())  # the piece after the last match
    return F.when(text.rlike(pattern), each).otherwise(F.array().cast("array<struct<part:int,i:int,gap:int,len:int,counted:int>>"))


def parts_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, kind, role, base, start, stop of every strong part and weak candidate."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(*row_key(), F.explode(F.concat(*[matches(text, n) for n in range(len(PARTS))])).alias("x")).select("doc_id", "text_hash", "x.*").distinct()
    before = Window.partitionBy("doc_id", "text_hash", "part").orderBy("i")
    placed = found.withColumn("stop", F.sum(F.col("gap") + F.col("len")).over(before).cast("int")).withColumn("start", F.col("stop") - F.col("len"))
    kind, role = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, (_, _, strong, least, weak, weak_least, part_role) in enumerate(PARTS):
        kind = F.when((F.col("part") == n) & (F.col("counted") >= weak_least), F.when(F.lit(strong is not None) & (F.col("counted") >= least), F.lit(strong)).otherwise(F.lit(weak))).otherwise(kind)
        role = F.when(F.col("part") == n, F.lit(part_role)).otherwise(role)
    return placed.select("doc_id", "text_hash", kind.alias("kind"), role.alias("role"), "start", "stop").where("kind is not null").withColumn("base", F.col("kind").isin(BASE))


def secret_spans(docs: DataFrame, scope: int = 200) -> DataFrame:
    """doc_id, text_hash, kind, start, stop (code points, end exclusive): all strong parts, and weak ones that are linked."""
    parts = written(parts_of(docs), "secret-parts")
    buckets = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    weak = parts.where("not base").withColumn("bucket", buckets(F.greatest(F.col("start") - scope, F.lit(0)), F.col("stop") + scope))
    # A part stands in the buckets of its two ends and those between, so any overlap with a scope meets in a bucket.
    held = parts.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("role").alias("other"), F.col("start").alias("a"), F.col("stop").alias("b"), buckets(F.col("start"), F.col("stop")).alias("k"))
    complement = F.when(F.col("role") == "secret", F.col("other").isin("identifier", "endpoint")).otherwise(F.col("other") == "secret")
    near = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")) & (F.col("bucket") == F.col("k")) & complement & (F.col("a") <= F.col("stop") + scope) & (F.col("b") + scope >= F.col("start"))
    linked = weak.hint("merge").join(held.hint("merge"), near, "left_semi").drop("bucket").distinct()
    return parts.where("base").unionByName(linked).select("doc_id", "text_hash", "kind", "start", "stop")


def span_order(kinds: list[str] = KINDS) -> Column:
    return F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")).cast("int")


def secret_report(docs: DataFrame, scope: int = 200) -> DataFrame:
    """Per row of ``docs``: counts of the base kinds, their digest, and all spans."""
    spans = secret_spans(docs, scope)
    one = F.struct("start", span_order().alias("order"), F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("stop").cast("string")).alias("said"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["said"]), ",")
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    told = spans.groupBy("doc_id", "text_hash").agg(n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), joined(F.when(F.col("kind").isin(BASE), one)).alias("base"), joined(one).alias("spans"))
    told = told.withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    keys = docs.select(*row_key())
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return keys.hint("merge").join(told.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left").select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redacted(docs: DataFrame, scope: int = 200, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with each reported span (overlapping ones merged) replaced by ``mark``; all columns and rows stay."""
    spans = secret_spans(docs, scope)
    by = Window.partitionBy("doc_id", "text_hash").orderBy("start", "stop")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("run", F.sum(F.when(F.col("start") <= reach, 0).otherwise(1)).over(by))
    merged = runs.groupBy("doc_id", "text_hash", "run").agg(F.min("start").alias("a"), F.max("stop").alias("b"))
    d, h, c, own = free_names(docs, 4)
    cuts = merged.groupBy(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias(c))
    joined = docs.withColumn(own, row_key()[1]).hint("merge").join(cuts.hint("merge"), docs["doc_id"].eqNullSafe(F.col(d)) & (F.col(own) == F.col(h)), "left")
    pieces = F.expr(f"transform(sequence(0, size({c})), i -> substring(text, coalesce(get({c}, i - 1).b, 0) + 1, coalesce(get({c}, i).a, char_length(text)) - coalesce(get({c}, i - 1).b, 0)))")
    clean = F.when(F.col(c).isNull(), F.col("text")).otherwise(F.array_join(pieces, mark))
    out = joined.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(c).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
