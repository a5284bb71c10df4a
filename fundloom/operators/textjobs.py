"""Table jobs over texts: chunks, hashed vectors, mentions, nearest vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundloom.functions.text import HEADING
from fundloom.operators.vectors import vector_top_k
from fundloom.sources.tables import spread, written

HEADING_RE = re.compile(HEADING)


def blocks_of(text: str) -> list[tuple[int, int]]:
    """(start, end) of the runs of text between blank lines."""
    out, at = [], 0
    for gap in re.finditer(r"\n\s*\n", text):
        if text[at : gap.start()].strip():
            out.append((at, gap.start()))
        at = gap.end()
    return [*out, (at, len(text))] if text[at:].strip() else out


def tokens_in(a: int, b: int) -> int:
    return max(1, (b - a) // 4)


def chunks_of(text: str, target: int, hard: int) -> list[tuple[int, int, str | None]]:
    """(start, end, heading) of chunks: a heading starts a new one, ``target`` tokens end one unless a table stands at its end, and a
    table that would pass ``hard`` starts a new one; no block is split. Newlines at either end are left off."""
    out, start, end, heading = [], None, 0, None

    def close() -> None:
        body = text[start:end].strip("\n")
        out.append((start, start + len(body), heading))

    for a, b in blocks_of(text):
        block = text[a:b].strip()
        lines = block.splitlines()
        ruled = sum(x.count("|") >= 2 or x.count("\t") >= 2 for x in lines)
        table = len(lines) >= 2 and ruled >= max(2, len(lines) // 2)
        if HEADING_RE.match(lines[0]) and len(lines[0]) < 120:
            if start is not None:
                close()
                start = None
            heading = lines[0][:120]
        if table and start is not None and tokens_in(start, end) + tokens_in(a, b) > hard:
            close()
            start = None
        start, end = a if start is None else start, b
        if tokens_in(start, end) >= target and not table:
            close()
            start = None
    if start is not None:
        close()
    return out


def chunk_documents(docs: DataFrame, target: int = 1500, hard: int = 1800) -> DataFrame:
    """doc_id, chunk (from 1), start, length, heading: blocks stand between blank lines, sizes are in tokens (4 characters)."""

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += [(doc_id, k, a, b - a, h) for k, (a, b, h) in enumerate(chunks_of(text or "", target, hard), 1)]
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "chunk", "start", "length", "heading"])

    return docs.select("doc_id", "text").mapInArrow(chunk, "doc_id long, chunk long, start long, length long, heading string")


class TokenPairs:
    """The 16 byte pairs of each token's digest as signed buckets (bucket, or -1 - bucket where the first byte is odd); tokens are hashed once, while ``MOST`` are held."""

    MOST = 500_000

    def __init__(self, dim: int):
        self.dim, self.at, self.table = dim, {}, np.zeros((1024, 16), np.int32)

    def rows(self, tokens: list[bytes]) -> np.ndarray:
        if len(self.at) > self.MOST:
            self.at.clear()
        at = [self.at.setdefault(t, len(self.at)) for t in tokens]
        if len(self.at) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(len(self.at) - len(self.table), len(self.table)), 16), np.int32)])
        return np.array(at, np.int64)

    def counted(self, tokens: list[bytes]) -> np.ndarray:
        """The sum of signed counts in each bucket."""
        known = len(self.at) if len(self.at) <= self.MOST else 0
        at = self.rows(tokens)
        for t, k in dict(zip(tokens, at.tolist(), strict=True)).items():
            if k >= known:
                pairs = np.frombuffer(hashlib.sha256(t).digest(), ">u2").astype(np.int32)
                self.table[k] = np.where(pairs >> 8 & 1, -1 - pairs % self.dim, pairs % self.dim)
        pairs = self.table[at].ravel()
        odd = pairs < 0
        return np.bincount(pairs[~odd], minlength=self.dim) - np.bincount(-1 - pairs[odd], minlength=self.dim)


def hash_embed(docs: DataFrame, dim: int = 384) -> DataFrame:
    """doc_id, bucket, value: signed feature hashing of each token's digest (16 byte pairs), normalised; zeros left out. Each row is embedded
    where it lies, by itself; null texts have no tokens."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TokenPairs(dim)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            for a in range(0, batch.num_rows, 1000):
                ids, buckets, values = [], [], []
                for doc_id, text in zip(batch.column("doc_id").slice(a, 1000).to_pylist(), texts.slice(a, 1000), strict=True):
                    tokens = re.findall(rb"[a-z0-9]+", text.as_py() or b"")
                    v = known.counted(tokens) if tokens else np.zeros(dim, np.int64)
                    bucket = np.flatnonzero(v)
                    ids += [doc_id] * len(bucket)
                    buckets.append(bucket)
                    values.append(v[bucket] / np.sqrt((v * v).sum(dtype=np.float64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(buckets), pa.int64()), pa.array(np.concatenate(values), pa.float64())], names=["doc_id", "bucket", "value"])

    low = spread(docs.select("doc_id", F.lower("text").alias("text")))
    return low.mapInArrow(embed, "doc_id long, bucket long, value double").select("doc_id", "bucket", F.round("value", 6).alias("value"))


#: A text is taken apart into words and what stands between them; letters, digits and the underscore are of words.
WORD = r"[\p{L}\p{N}_]"
PARTS = rf"{WORD}+|[^\p{{L}}\p{{N}}_]+"


def parts_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PARTS), F.lit(0))


def alias_index(vocabulary: DataFrame) -> DataFrame:
    """alias, canonical, parts, anchor, back: each alias under its rarest part among all aliases, ``back`` parts from its start. Aliases of under 3
    characters are left out; an alias of several canonical names has each of them."""
    known = vocabulary.where(F.char_length("alias") >= 3).select("alias", "canonical").distinct().withColumn("parts", parts_of(F.col("alias")))
    each = known.select("alias", "canonical", F.posexplode("parts").alias("back", "part"))
    counts = each.groupBy(F.col("part").alias("p2")).agg(F.count("*").alias("n"))
    # Words before what is between them: a blank is in most texts.
    order = F.struct((~F.col("part").rlike(f"^{WORD}")).alias("gap"), "n", F.col("part").alias("anchor"), "back")
    best = each.hint("merge").join(counts.hint("merge"), F.col("part") == F.col("p2")).groupBy("alias", "canonical").agg(F.min(order).alias("x")).select(F.col("alias").alias("a2"), F.col("canonical").alias("c2"), "x.anchor", "x.back")
    met = (F.col("alias") == F.col("a2")) & F.col("canonical").eqNullSafe(F.col("c2"))
    return known.hint("merge").join(best.hint("merge"), met).select("alias", "canonical", "parts", "anchor", "back")


def detect_mentions(docs: DataFrame, vocabulary: DataFrame, small: int = 200_000) -> DataFrame:
    """doc_id, canonical, first_pos: names of which a text, in lower case, holds an alias (3 characters and more) between word boundaries;
    the place (in characters) where the longest such alias (of equally long ones the first in order) first stands.

    An alias between boundaries is a run of whole parts, so it is found where its anchor, its rarest part, stands and the parts
    around it agree. The index of anchors is broadcast if it has at most ``small`` aliases of bounded length, else joined by
    anchor with just the parts around. An alias that starts or ends otherwise than with a word needs a word there in the text.
    vocabulary: alias (in lower case), canonical. Null texts hold nothing."""
    index = written(alias_index(vocabulary), "alias-index")
    # Numbers of the vocabulary: aliases, the longest in parts, characters in all.
    n, before, after, size = index.agg(F.count("*"), F.max("back"), F.max(F.size("parts") - F.col("back")), F.sum(F.char_length("alias"))).first()
    if not n:
        return docs.select("doc_id", F.lit(None).cast(vocabulary.schema["canonical"].dataType).alias("canonical"), F.lit(0).cast("long").alias("first_pos")).limit(0)
    chars = lambda parts: F.char_length(F.array_join(parts, ""))
    # Places are counted from the start of a block of parts, as many as there are blocks, not from the text's start for each name found.
    cut = spread(docs).select("doc_id", parts_of(F.lower("text")).alias("w")).select("doc_id", "w", F.greatest(F.ceil(F.sqrt(F.size("w"))).cast("int"), F.lit(1)).alias("block"))
    sizes = cut.select("doc_id", "w", "block", F.transform(F.sequence(F.lit(0), F.floor(F.size("w") / F.col("block")).cast("int")), lambda k: chars(F.slice("w", k * F.col("block") + 1, F.col("block")))).alias("sizes"))
    starts = F.transform(F.sequence(F.lit(0), F.size("sizes") - 1), lambda k: F.aggregate(F.slice("sizes", F.lit(1), k), F.lit(0), lambda a, b: a + b))
    seen = sizes.select("doc_id", "w", "block", starts.alias("starts")).select("doc_id", "w", "block", "starts", F.posexplode("w").alias("i", "part"))
    place = lambda i: F.get("starts", F.floor(i / F.col("block")).cast("int")) + chars(F.slice("w", i - i % F.col("block") + 1, i % F.col("block")))
    if n <= small and size <= 64 * small:
        met = seen.select("doc_id", "w", "block", "starts", "part", F.col("i").alias("own"), F.lit(0).alias("left_out")).join(F.broadcast(index), F.col("part") == F.col("anchor"))
    else:
        # Only the parts around one go with it: those before it up to the longest way back, those after it and one more.
        start = F.greatest(F.col("i") - before, F.lit(0))
        near = seen.select("doc_id", F.slice("w", start + 1, before + after + 1).alias("near"), "part", (F.col("i") - start).alias("own"), place(start).alias("left_out"))
        place = lambda i: F.col("left_out") + chars(F.slice("w", F.lit(1), i))
        met = near.withColumnRenamed("near", "w").hint("merge").join(index.hint("merge"), F.col("part") == F.col("anchor"))
    at, size = F.col("own") - F.col("back"), F.size("parts")
    whole = met.where((at >= 0) & (F.slice("w", F.greatest(at, F.lit(0)) + 1, size) == F.col("parts")))
    is_word = lambda part: part.rlike(f"^{WORD}")
    bounded = whole.where((is_word(F.col("parts")[0]) | (at > 0) | (F.col("left_out") > 0)) & (is_word(F.element_at("parts", -1)) | (at + size < F.size("w"))))
    found = bounded.select("doc_id", "canonical", "alias", place(at).cast("long").alias("pos"))
    once = found.groupBy("doc_id", "canonical", "alias").agg(F.min("pos").alias("pos"))
    first = once.groupBy("doc_id", "canonical").agg(F.min(F.struct((-F.char_length("alias")).alias("n"), "alias", "pos")).alias("x"))
    return first.select("doc_id", "canonical", F.col("x.pos").alias("first_pos"))


def detect_fund(questions: DataFrame, funds: DataFrame, small: int = 2_000_000) -> DataFrame:
    """question, fund: the fund whose own words a question holds most, then words that all funds have, then the shorter name, then the smaller id.

    funds: fund, name. Words are longer than 2 letters and looked for as words. The index of words is broadcast if names have at most ``small`` words in
    all, else joined by word and a part of the questions, as many ask for the same word."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda x: F.char_length(x) > 2))
    named = funds.select("fund", F.explode(tokens(F.col("name"))).alias("t"))
    n = funds.count()
    spread = named.groupBy("t").agg((F.count("*") == n).alias("common"))
    sizes = named.groupBy("fund").agg(F.count("*").alias("size"))
    asked = questions.select("question", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("q"))
    # Words that all funds have say nothing between them: a question with no other word is of the first fund of all, without meeting each.
    score = F.struct("own", (-F.col("size")).alias("size"), (-F.col("fund")).alias("id"))
    few = named.count() <= small
    given = F.broadcast if few else (lambda df: df.hint("merge"))
    first = sizes.agg(F.max_by("fund", F.struct((-F.col("size")).alias("size"), (-F.col("fund")).alias("id"))).alias("fund"))
    common = spread.where("common").select("t").withColumn("fund", F.lit(None).cast(funds.schema["fund"].dataType))
    own = named.join(given(spread.where("not common").select("t")), "t").select("t", "fund")
    parts = 1 if few else 32
    index = own.unionByName(common).groupBy("t").agg(F.collect_list("fund").alias("funds")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = asked.withColumn("p2", F.pmod(F.xxhash64("question"), F.lit(parts)).cast("int"))
    met = asked.join(given(index), (F.col("q") == F.col("t")) & (F.col("p2") == F.col("part"))).select("question", F.explode_outer("funds").alias("fund"))
    counted = met.groupBy("question", "fund").agg(F.count("fund").alias("own"))
    best = counted.join(given(sizes), "fund", "left").groupBy("question").agg(F.max_by("fund", score).alias("fund"))
    return best.join(F.broadcast(first.withColumnRenamed("fund", "other"))).select("question", F.coalesce("fund", "other").alias("fund"))


def embedding_candidates(vectors: DataFrame, mentions: DataFrame, threshold: float = 0.9, k: int = 5) -> DataFrame:
    """The ``k`` titles most alike to each mention, from the threshold on."""
    return vector_top_k(vectors, mentions, k, threshold)
