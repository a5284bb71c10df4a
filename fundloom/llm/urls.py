"""URL filters by association rules.

Labelled pages give transactions of URL tokens plus a ``label:block`` item. FP-growth mines the token combinations that
go with it; rules are pruned by support (a share of the pages and ``LEAST`` of them), by the lower bound of their confidence, so that a
few hits of a few pages are no rule at any size of the table, and by a shorter rule that is as sure. Each rule is filed under its
rarest token (the smallest on ties) in an inverted index; a URL meets only the rules filed under its own tokens, then all tokens are confirmed.
Listed rules (host and path prefix) come first; the mined rules decide the rest.

Nulls and edge cases: a null url, or one without ``://``, has an empty host and path, no tokens, and is allowed; a null
label counts as none; repeated pages are judged alike, each in its own row; no labels or no sure rule mean that
nothing is blocked by rules mined; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundloom.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "label:block"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Pages that a rule must block at least, and the deviations that its confidence's lower bound (Wilson's) is off.
LEAST, DEVIATIONS = 20, 2.58
#: The listed rules (host, path prefix, action).
LISTED = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: scheme, labels and suffixes of the host, path segments (numbers as ``0``), query keys, fragment."""
    numbered = lambda c: F.regexp_replace(c, r"[0-9]+", "0")
    parts = lambda c, sep, mark: F.transform(F.array_remove(F.split(numbered(c), sep), ""), lambda x: F.concat(F.lit(mark), x))
    host, path = host_of(url), path_of(url)
    keys = F.regexp_extract_all(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))))
    domain = F.array(F.concat(F.lit("domain:"), F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1)))
    fragment = F.when(url.contains("#"), F.array(F.lit("fragment:"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(scheme, domain, parts(host, r"\.", "host:"), parts(path, "/", "path:"), F.transform(keys, lambda x: F.concat(F.lit("query:"), numbered(x))), fragment)
    return F.when(url.contains("://"), F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def surely(hits: Column, of: Column, deviations: float = DEVIATIONS) -> Column:
    """The lower bound of a share of ``hits`` in ``of``."""
    z2 = deviations * deviations
    p = hits / of
    return (p + z2 / (2 * of) - deviations * F.sqrt(p * (1 - p) / of + z2 / (4 * of * of))) / (1 + z2 / of)


def twin_tokens(each: DataFrame, fewest: int) -> DataFrame:
    """twin, tokens: the tokens that at least ``fewest`` rows hold, those that just the same rows hold together under the least of them; the label stands alone.

    each: row, token. Rows are compared by their number and two sums of hashes. Tokens with that many rows are few, so lists are short."""
    mark = lambda seed: F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(38,0)"))
    held = each.groupBy("token").agg(F.count("*").alias("n"), mark(1).alias("a"), mark(2).alias("b")).where(F.col("n") >= fewest)
    alone = F.when(F.col("token") == BLOCK, F.lit(1)).otherwise(F.lit(0))
    return held.groupBy("n", "a", "b", alone).agg(F.min("token").alias("twin"), F.sort_array(F.collect_list("token")).alias("tokens")).select("twin", "tokens")


def with_twins(rules: DataFrame, twins: DataFrame) -> DataFrame:
    """Each rule once for every choice of a token in place of each of its twins."""
    each = rules.select("tokens", "confidence", "support", F.explode("tokens").alias("twin")).hint("merge").join(twins.withColumnRenamed("tokens", "like").hint("merge"), "twin")
    kept = each.groupBy("tokens", "confidence", "support").agg(F.collect_list("like").alias("likes"))
    none = F.array(F.array().cast("array<string>"))
    choices = F.aggregate("likes", none, lambda done, like: F.flatten(F.transform(done, lambda d: F.transform(like, lambda x: F.concat(d, F.array(x))))))
    return kept.select(F.explode(choices).alias("tokens"), "confidence", "support").withColumn("tokens", F.sort_array("tokens"))


def mined_rules(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.7, least: int = LEAST) -> DataFrame:
    """``labelled``: url, bad (boolean). tokens, confidence (its lower bound), support; no rule that a part of it makes as surely."""
    items = labelled.where("url is not null and bad is not null").select(F.concat(tokens_of(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items")).where(F.size("items") > 0)
    items = written(items.withColumn("row", F.monotonically_increasing_id()), "url-items")
    n = items.count()
    support = max(min_support, least / max(n, 1))
    if support > 1:  # fewer pages than a rule needs
        return written(items.select(F.col("items").alias("tokens"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")).limit(0), "url-rules")
    fewest = math.ceil(support * n - 1e-9)
    each = items.select("row", F.explode("items").alias("token"))
    twins = written(twin_tokens(each, fewest), "url-twins")
    # One token of each set of twins is mined; tokens that are too rare for any rule are in no set anyway.
    mined = written(each.hint("merge").join(twins.select(F.col("twin").alias("token")).hint("merge"), "token", "left_semi").groupBy("row").agg(F.collect_list("token").alias("items")), "url-mined")
    sets = FPGrowth(itemsCol="items", minSupport=(fewest - 0.5) / max(mined.count(), 1), minConfidence=min_confidence).fit(mined).freqItemsets
    sets = written(sets.withColumn("items", F.sort_array("items")), "url-itemsets")
    bad = sets.where(F.array_contains("items", BLOCK)).select(F.array_remove("items", BLOCK).alias("tokens"), F.col("freq").alias("hits")).where(F.size("tokens") > 0)
    both = bad.hint("merge").join(sets.withColumnRenamed("items", "tokens").hint("merge"), "tokens")
    rules = both.select("tokens", surely(F.col("hits"), F.col("freq")).alias("confidence"), (F.col("hits") / F.lit(n)).alias("support")).where(F.col("confidence") >= min_confidence)
    rules = written(rules, "url-rules")
    # A rule is dropped if leaving out one token leaves a rule that is as sure.
    shorter = rules.select("tokens", "confidence", F.explode("tokens").alias("t")).select("tokens", "confidence", F.array_remove(F.col("tokens"), F.col("t")).alias("part"))
    known = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("sure"))
    beaten = shorter.hint("merge").join(known.hint("merge"), "part").where("sure >= confidence").select("tokens").distinct()
    return written(with_twins(rules.hint("merge").join(beaten.hint("merge"), "tokens", "left_anti"), twins), "url-rules-pruned")


def blocked_urls(urls: DataFrame, rules: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """Distinct urls that a rule matches in full, by the inverted index (each rule under its rarest token)."""
    known = urls.where("url is not null").select("url").distinct().withColumn("tokens", tokens_of(F.col("url")))
    index = rules.select(F.sort_array("tokens").alias("rule"), F.explode("tokens").alias("token"))
    common = index.groupBy("token").agg(F.count("*").alias("in_rules"))
    rarest = index.hint("merge").join(common.hint("merge"), "token").groupBy("rule").agg(F.min_by("token", F.struct("in_rules", "token")).alias("token"))
    rarest = written(rarest, "url-index")
    small = rarest.count() <= broadcast_rows
    met = known.select("url", "tokens", F.explode("tokens").alias("token")).join(F.broadcast(rarest) if small else rarest.hint("merge"), "token")
    return met.where(F.size(F.array_except("rule", "tokens")) == 0).select("url").distinct()


def listed_rule(host: Column, path: Column, listed=LISTED) -> Column:
    """The longest listed rule that fits, as a struct (length, rule, action) or null. The list is a parameter of the job."""
    every = F.array(*[F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(a).alias("action"), F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p, a in listed])
    fits = F.filter(every, lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
    return F.array_max(fits)


def url_verdicts(pages: DataFrame, labels: DataFrame, listed=LISTED, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict of each page. ``labels``: page_id, bad."""
    known = labels.where("bad is not null").groupBy(F.col("page_id").alias("labelled")).agg(F.bool_or("bad").alias("bad"))
    rules = mined_rules(pages.select("page_id", "url").join(known, F.col("page_id") == F.col("labelled")).select("url", "bad"), **mining)
    blocked = written(blocked_urls(pages, rules), "url-blocked").select(F.col("url").alias("met"))
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).join(blocked, F.col("url") == F.col("met"), "left")
    judged = judged.withColumn("listed", listed_rule(F.col("host"), F.col("path"), listed))
    by_method = F.when(F.col("met").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), F.coalesce("listed.action", by_method).alias("verdict"))
