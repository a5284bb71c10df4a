"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary texts. At the top are a class's own counts, an expression once a text, less an absolute
discount; what the discount leaves goes to the class's words by continuation counts (in how many contexts a word stands there), and from
these to the continuation counts of both classes together. A text's measure is the difference of its two log-likelihoods
over the number of its tokens; a logistic curve fitted on labelled texts that the models haven't seen makes it a score.

Only n-grams that a class repeats beyond chance (``Z`` standard deviations over what the counts of both lead one to expect) have counts of
their own in the models; the mass of all others goes to the level below, so rare words are smoothed through the shared counts and are as likely under both. (With counts
of all n-grams chance differences of thousands of rare words hide the few words that matter: an area under the curve of 0.88 on the labelled
rows held out.) What is expected after a word that hardly one class uses at all is at most ``NEAR`` times that class's share of all, so a
phrase counts to its end. Where neither model departs from the shared counts the two likelihoods are equal and cancel, so what is looked up
are logarithms of ratios: of bigrams, of words, and of what a context leaves to the level below.

The models are fitted on a bounded sample of labelled rows: the ``per_class`` rows of each class that come first by
a hash of their id (a fifth of them for the curve). Copies teach once: of the sample's texts of a class that agree in one of two minhashes of
their runs of 5 words one is taken, so what stands in a text that was copied is not repeated by that. What is broadcast are the n-grams of
that sample that are beyond chance: each takes several of its tokens. All scoring covers whole texts of all rows. The curve weighs the rows of a class by how many learning labels
of the class there are for each row that was taken. (A sample that takes the same number of each class would otherwise pass for the classes' shares.)

Nulls and edge cases: a null text is empty; a text without tokens is measured like one of unknown words; rows with a
null ``doc_id`` or label teach nothing (a null id is not held out) but are scored; of several labels of one id the highest
counts; repeated rows are scored alike; without labels of both classes all scores are 0; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundloom.llm import texthash
from fundloom.llm.shared import free_names, written

#: The context of a text's first token.
START = np.uint64(1)
#: Deviations beyond the expectation at which an n-gram has counts of its own; how many times a class's share of all is expected of it at most.
Z, NEAR = 5.0, 2.0
#: Words of a run by which copies are known.
RUN = 5


def tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of each text; words are runs of letters, digits and non-ASCII characters, A-Z lowered."""
    for row, hashes, first in texthash.hashed_texts(texthash.column(batch, "text"), texthash.NOT_ALNUM):
        for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            yield row + k, hashes[a:b]


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return texthash.mixed(h * np.uint64(0x9FB21C651E98DF25) + w)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigrams (h, w) of each batch with the texts of either class that hold them; and each word (h null) with its texts."""
    for batch in batches:
        kinds, parts, alone = batch.column("toxic").to_pylist(), [], []
        for i, w in tokens(batch):
            if len(w):
                parts.append((np.concatenate([[START], w[:-1]]), w, np.full(len(w), i)))
                own = np.unique(w)
                alone.append((own, np.full(len(own), kinds[i])))
        if not parts:
            continue
        h, w, text = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((text, w, h))
        h, w, text = h[order], w[order], text[order]
        new_pair = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
        new_text = new_pair | np.concatenate([[True], text[1:] != text[:-1]])
        first = np.flatnonzero(new_pair)
        bad, all_ = np.add.reduceat(new_text * np.array(kinds)[text], first), np.add.reduceat(new_text.astype(np.int64), first)
        yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(w[first].view(np.int64)), pa.array(bad, pa.int64()), pa.array(all_ - bad, pa.int64())], names=COUNTED)
        w, toxic = (np.concatenate(x) for x in zip(*alone, strict=True))
        keys, at = np.unique(w, return_inverse=True)
        bad, all_ = np.bincount(at, toxic, len(keys)).astype(np.int64), np.bincount(at, minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.int64()), pa.array(keys.view(np.int64)), pa.array(bad), pa.array(all_ - bad, pa.int64())], names=COUNTED)


COUNTED = ["h", "w", "t", "o"]


def copy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, toxic, a, b: two minhashes of each text's runs of words; a text without words has those of nothing."""
    for batch in batches:
        keys = np.zeros((2, batch.num_rows), np.uint64)
        for i, w in tokens(batch):
            if len(w):
                x = texthash.shingles(w, RUN)
                keys[:, i] = x.min(), texthash.mixed(x ^ np.uint64(0x9FB21C651E98DF25)).min()
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("toxic"), *(pa.array(k.view(np.int64)) for k in keys)], names=["row", "toxic", "a", "b"])


def without_copies(texts: DataFrame) -> DataFrame:
    """``texts`` (row, text, toxic) but for those that agree with another of their class in a minhash. Bounded by the sample."""
    keys = written(texts.select("row", "toxic", "text").mapInArrow(copy_keys, "row long, toxic int, a long, b long"), "toxic-keys")
    once = keys.groupBy("toxic", "a").agg(F.min(F.struct("row", "b")).alias("x")).groupBy("toxic", "x.b").agg(F.min("x.row").alias("one"))
    return texts.join(F.broadcast(once.select("one")), F.col("row") == F.col("one"), "left_semi")


def beyond(count: str, both: Column, share: Column) -> Column:
    """Whether a class's count is beyond what its share of both makes likely."""
    expected = both * share
    return F.col(count) > expected + Z * F.sqrt(expected) + 1


def discount(counts: DataFrame, n: Column) -> float:
    """The absolute discount from the counts of ones and twos."""
    ones, twos = counts.agg(F.count(F.when(n == 1, 1)), F.count(F.when(n == 2, 1))).first()
    return min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)


def fitted(texts: DataFrame) -> dict[str, np.ndarray | float]:
    """``texts``: text, toxic (0 or 1). Log ratios of the two models: of the words and bigrams that have counts of their own and of what their contexts leave,
    each sorted by key; ``rest``, that of all other words."""
    grams = texts.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(counted, ", ".join(f"{c} long" for c in COUNTED))
    grams = written(grams.groupBy("h", "w").agg(F.sum("t").alias("t"), F.sum("o").alias("o")), "toxic-grams")
    pairs, both = grams.where("h is not null"), F.col("t") + F.col("o")
    seen = lambda c: F.count(F.when(F.col("h").isNotNull() & (F.col(c) > 0), 1)).alias(f"n{c}")
    held = lambda c: F.coalesce(F.sum(F.when(F.col("h").isNull(), F.col(c))), F.lit(0)).alias(f"texts_{c}")
    words = grams.groupBy("w").agg(seen("t"), seen("o"), held("t"), held("o"))
    # A word is repeated if many texts hold it in many contexts.
    words = written(words.withColumns({"t": F.least("nt", "texts_t"), "o": F.least("no", "texts_o")}), "toxic-words")
    n_t, n_o, m_t, m_o = (float(x or 0) for x in words.agg(F.sum("nt"), F.sum("no"), F.sum("t"), F.sum("o")).first())
    every = max(n_t + n_o, 1.0)
    less = discount(words, F.col("nt") + F.col("no"))
    own = lambda n, total: F.greatest(F.col(n) - less, F.lit(0.0)) / max(total, 1.0)
    share_t = m_t / max(m_t + m_o, 1.0)
    words = words.withColumn("kept", beyond("t", both, F.lit(share_t)) | beyond("o", both, F.lit(1 - share_t))).withColumns({"pt": own("nt", n_t), "po": own("no", n_o)})
    rest_t, rest_o = (1 - float(x or 0) for x in words.where("kept").agg(F.sum("pt"), F.sum("po")).first())
    shared = (F.col("nt") + F.col("no")) / every
    words = words.withColumns({"pt": F.when(F.col("kept"), F.col("pt")).otherwise(0.0) + rest_t * shared, "po": F.when(F.col("kept"), F.col("po")).otherwise(0.0) + rest_o * shared})

    sums = pairs.groupBy("h").agg(F.sum("t").alias("ht"), F.sum("o").alias("ho"))
    all_t, all_o = (float(x or 0) for x in pairs.agg(F.sum("t"), F.sum("o")).first())
    share = lambda c, of: F.least(F.col(c) / (F.col("ht") + F.col("ho")), F.lit(min(1.0, NEAR * of / max(all_t + all_o, 1.0))))
    less_pairs = discount(pairs, both)
    met = pairs.hint("merge").join(sums.hint("merge"), "h").where(beyond("t", both, share("ht", all_t)) | beyond("o", both, share("ho", all_o)))
    top = lambda n, total: F.when(F.col(total) > 0, F.greatest(F.col(n) - less_pairs, F.lit(0.0)) / F.col(total)).otherwise(0.0)
    met = written(met.withColumns({"qt": top("t", "ht"), "qo": top("o", "ho")}), "toxic-pairs")
    contexts = met.groupBy("h").agg((1 - F.sum("qt")).alias("left_t"), (1 - F.sum("qo")).alias("left_o"))
    told = met.hint("merge").join(contexts.hint("merge"), "h").join(words.select("w", "pt", "po").hint("merge"), "w")
    ratio = lambda a, b: (F.log(a) - F.log(b)).alias("r")

    def pulled(df: DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = df.select(*keys, "r").toArrow()
        columns = [rows.column(k).to_numpy().view(np.uint64) for k in keys]
        key = columns[0] if len(keys) == 1 else pair_hash(*columns)
        order = np.argsort(key)
        return key[order], rows.column("r").to_numpy()[order].astype(np.float32)

    model = {"rest": math.log(rest_t / rest_o)}
    model["words"], model["word_ratio"] = pulled(words.where("kept").select("w", ratio(F.col("pt"), F.col("po"))), ["w"])
    model["pairs"], model["pair_ratio"] = pulled(told.select("h", "w", ratio(F.col("qt") + F.col("left_t") * F.col("pt"), F.col("qo") + F.col("left_o") * F.col("po"))), ["h", "w"])
    model["contexts"], model["context_ratio"] = pulled(contexts.select("h", ratio(F.col("left_t"), F.col("left_o"))), ["h"])
    return model


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.full(len(wanted), default, np.float32), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return np.where(found, values[at], np.float32(default)), found


def measurer(shared_model):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared_model.value
        for batch in batches:
            out = np.full(batch.num_rows, m["rest"])
            for i, w in tokens(batch):
                if len(w):
                    h = np.concatenate([[START], w[:-1]])
                    ratio, known = looked_up(m["pairs"], m["pair_ratio"], pair_hash(h, w), 0)
                    below = looked_up(m["contexts"], m["context_ratio"], h, 0)[0] + looked_up(m["words"], m["word_ratio"], w, m["rest"])[0]
                    out[i] = np.where(known, ratio, below).sum(dtype=np.float64) / len(w)
            kept = [k for k, x in enumerate(batch.schema.names) if x != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(out)], names=[*(batch.schema.names[k] for k in kept), "measure"])

    return measure


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """row (a hash of id and text), text, toxic, part (a number from 0 to 4) and weight (learning labels for each row taken) of at most
    ``per_class`` learning rows of each class."""
    learn = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    first = F.xxhash64("doc_id", F.lit("toxicity"))
    ids = None
    for c in (0, 1):
        own = learn.where(F.col("toxic") == c).orderBy(first, "doc_id").limit(per_class)
        ids = own if ids is None else ids.unionByName(own)
    # Two rows: what each class has in full.
    every = learn.groupBy(F.col("toxic").alias("c")).agg((F.count("*") / F.least(F.count("*"), F.lit(per_class))).alias("weight"))
    ids = ids.select(F.col("doc_id").alias("id"), "toxic", F.pmod(first, F.lit(5)).alias("part"))
    ids = written(ids.join(F.broadcast(every), F.col("toxic") == F.col("c")).drop("c"), "toxic-sample")
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select(F.xxhash64("doc_id", "text").alias("row"), "text", F.col("toxic").cast("int").alias("toxic"), "part", "weight")


def toxicity_scores(docs: DataFrame, labels: DataFrame, per_class: int = 15_000) -> DataFrame:
    """doc_id, text_hash, held_out, score, predicted of each row of ``docs``. ``labels``: doc_id, toxic."""
    sc = docs.sparkSession.sparkContext
    sample = written(labelled_sample(docs, labels, per_class), "toxic-texts")
    parts = {(r["toxic"], r["calibrates"]) for r in sample.select("toxic", (F.col("part") == 0).alias("calibrates")).distinct().collect()}
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    if len(parts) < 4:
        return keyed.select("doc_id", "text_hash", held_out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    model = sc.broadcast(fitted(without_copies(sample.where("part <> 0"))))
    unseen = written(sample.where("part = 0").select("toxic", "weight", "text").mapInArrow(measurer(model), "toxic int, weight double, measure double"), "toxic-curve")
    curve = LogisticRegression(labelCol="toxic", featuresCol="x", weightCol="weight", regParam=1e-6).fit(unseen.select("toxic", "weight", array_to_vector(F.array("measure")).alias("x")))
    a, b = float(curve.coefficients[0]), float(curve.intercept)
    score = 1 / (1 + F.exp(-(F.lit(a) * F.col("measure") + F.lit(b))))
    measured = keyed.mapInArrow(measurer(model), "doc_id long, text_hash long, measure double")
    return measured.select("doc_id", "text_hash", held_out, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, **kind) -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic; all their columns."""
    d, h = free_names(docs, 2)
    bad = toxicity_scores(docs, labels, **kind).where("predicted = 1").select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct()
    bad = written(bad, "toxic-rows")
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(d)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(h)), "left_anti")
