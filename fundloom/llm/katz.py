"""Language-model scores of a bigram Katz backoff model.

p(w)   = (c(w) + 0.1) / Z,  Z = N + 0.1 (V + 1): all known words and one place for unknown ones.
p(w|h) = d(r) r / (c(h) + 1)                     for a bigram seen r times; d(r) is Good-Turing's discount up to r = K, 1 beyond,
       = a(h) p(w)                               else, where
a(h)   = (1 + sum of r (1 - d(r))) / (c(h) + 1) / (1 - sum of p(w)), sums over the words seen after h.

So every context's probabilities add up to exactly 1; the one count added to each context keeps something for unseen words
also where all counts are above K. A text is its words and one end; its first word follows a start.

1. Words and bigrams that stand for a large share of a bucket's tokens (hot ones) are found, and counted exactly by sums of
   partial counts; there are at most ``MOST_HOT`` of either.
2. Tasks hash their texts into bigrams and send the distinct ones, with the texts that hold them, to the bucket of the word; those of
   hot words are dealt by the whole bigram, hot bigrams by the sender too. A bucket holds all occurrences of its other bigrams, so it
   counts and looks up in one go. What it holds follows its tokens alone, and the number of buckets follows the number of tokens.
3. A partitioned table keeps what comes of it: the n-gram counts, sums of each text that leave the discounts open, unseen bigrams,
   counts of counts.
4. Counts of counts give the discounts, sums over each context's bigrams the table of backoff weights, which unseen bigrams are joined with.

``trained`` returns the tables, ``evaluated`` scores any texts by them: each token's bigram is looked up, and where it has no count,
the weight of its context and the word's own count are.

Words are compared by 64-bit hash. Nulls and edge cases: a null text is empty (an end alone); a null ``doc_id`` is a training row;
repeated rows count and are scored each; without training rows all words are unknown; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundloom.llm import texthash
from fundloom.llm.shared import new_path, written

K = 5
#: The least and the largest number of tokens of which a word or bigram that stands for one is hot; hot ones are at most as many.
HOT, MOST_HOT = 1000, 20_000
START, END = np.uint64(1), np.uint64(2)
#: What a task gathers before it sends: tokens, and documents (they are numbered in 16 bits).
TOKENS, DOCS = 1_200_000, 30_000
#: A bucket's tokens (its task holds them in memory), and the least number of buckets.
BUCKET_TOKENS, LEAST_BUCKETS = 4_500_000, 16
SUBS = 16


def tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first text, tokens of some texts with their ends, how many each text has)."""
    for row, hashes, first in texthash.hashed_texts(texthash.column(batch, "text")):
        n = np.diff(first)
        out = np.insert(hashes, first[1:], END)
        yield row, out, n + 1


def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of over 1 in ``MOST_HOT`` of a task's training tokens with their counts; all tokens and training tokens (word null)."""
    words, every, total, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0
    for batch in batches:
        held = np.array(batch.column("held").to_pylist(), bool)
        for row, t, n in tokens(batch):
            train = t[~np.repeat(held[row : row + len(n)], n)]
            total, seen = total + len(t), seen + len(train)
            u, c = np.unique(train, return_counts=True)
            words, at = np.unique(np.concatenate([words, u]), return_inverse=True)
            every = np.bincount(at, np.concatenate([every, c])).astype(np.int64)
            # What is rare so far is let go: it can't come to more than was seen since.
            keep = every * MOST_HOT > seen // 2
            words, every = words[keep], every[keep]
    keep = every * MOST_HOT > seen
    yield pa.RecordBatch.from_arrays([pa.array([None, *words[keep].view(np.int64)], pa.int64()), pa.array([total, *every[keep]], pa.int64()), pa.array([seen, *np.zeros(keep.sum(), np.int64)], pa.int64())], names=["w", "n", "train"])


def contexts_of(w: np.ndarray) -> np.ndarray:
    """The word before each token; a start where a text begins. Tokens are those of whole texts."""
    h = np.concatenate([[START], w[:-1]])
    h[h == END] = START
    return h


def counter(hot):
    """Counts of the hot words (h null), and of the bigrams of two of them or of a start and one, in training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, every, pairs, upto, kept_pairs = hot.value, np.zeros(len(hot.value), np.int64), [], 0, np.zeros((3, 0), np.uint64)

        def merged() -> np.ndarray:
            x = np.concatenate([kept_pairs, *pairs], axis=1)
            order = np.lexsort((x[1], x[0]))
            x = x[:, order]
            first = np.flatnonzero(np.concatenate([[True], (x[:2, 1:] != x[:2, :-1]).any(axis=0)])) if x.shape[1] else np.zeros(0, np.int64)
            return np.stack([x[0][first], x[1][first], np.add.reduceat(x[2], first)]) if len(first) else kept_pairs

        for batch in batches:
            held = np.array(batch.column("held").to_pylist(), bool)
            for row, t, n in tokens(batch):
                t_held, h = np.repeat(held[row : row + len(n)], n), contexts_of(t)
                train, h = t[~t_held], h[~t_held]
                own = is_hot(train, keys)
                every += np.bincount(np.searchsorted(keys, train[own]), minlength=len(keys))
                both = own & (is_hot(h, keys) | (h == START))
                pairs.append(np.stack([h[both], train[both], np.ones(both.sum(), np.uint64)]))
                upto += int(both.sum())
                if upto > 2_000_000:
                    kept_pairs, pairs, upto = merged(), [], 0
        kept_pairs = merged()
        columns = [np.concatenate([keys, kept_pairs[1]]).view(np.int64), np.concatenate([every, kept_pairs[2].view(np.int64)])]
        h = pa.array([*([None] * len(keys)), *kept_pairs[0].view(np.int64).tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([h, *map(pa.array, columns)], names=["h", "w", "n"])

    return count


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return texthash.mixed(h * np.uint64(0x9FB21C651E98DF25) ^ texthash.mixed(w + np.uint64(0x51ED270B)))


def is_hot(w: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, w), len(hot) - 1)] == w if len(hot) else np.zeros(len(w), bool)


def route(h: np.ndarray, w: np.ndarray, hot: np.ndarray, hot_pairs: np.ndarray, salt: int = 0) -> np.ndarray:
    """Where a bigram goes: by its word, for hot words by all of it, for hot bigrams by the sender's ``salt`` too."""
    pair = pair_hash(h, w)
    spread = np.where(is_hot(pair, hot_pairs), texthash.mixed(pair + np.uint64(salt)), pair)
    return np.where(is_hot(w, hot), spread, texthash.mixed(w ^ np.uint64(0xABCDEF)))


SENT = "bucket int, first_row long, held array<boolean>, ids array<long>, w array<long>, pairs array<int>, h array<long>, times array<int>, docs array<short>"


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts) if parts else [], kind))


def sender(hot, hot_pairs, slots: list[int], most_tokens: int, most_docs: int):
    buckets = len(slots)

    def flush(held: list, ids: list, first_row: int, t: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
        w, n = np.concatenate(t), np.concatenate(n)
        h = contexts_of(w)
        at = np.arange(len(n), dtype=np.int16)
        docs = np.repeat(np.where(np.array(held, bool), -1 - at, at).astype(np.int16), n)  # below 0: held out
        r, k = route(h, w, hot.value, hot_pairs.value, first_row), pair_hash(h, w)
        order = np.lexsort((k, r))
        w, h, docs, r, k = w[order], h[order], docs[order], r[order], k[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])
        pair = np.flatnonzero(new)
        times = np.diff(np.append(pair, len(k)))
        r, w, h = r[pair], w[pair], h[pair]
        run = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (w[1:] != w[:-1])]))
        per_run = np.diff(np.append(run, len(r)))
        bucket = (r >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)  # rises with r
        cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        occ = np.append(pair, len(k))
        run_cut = np.searchsorted(run, cut)
        part = lambda x, c: [x[a:b] for a, b in zip(c[:-1], c[1:], strict=True)]
        # What a text is goes to one bucket alone.
        only = lambda x: [x if b == first_row % buckets else [] for b in range(buckets)]
        columns = [
            pa.array(slots, pa.int32()), pa.array(np.full(buckets, first_row)), pa.array(only(held), pa.list_(pa.bool_())), pa.array(only(ids), pa.list_(pa.int64())),
            lists(part(w[run].view(np.int64), run_cut), pa.int64()), lists(part(per_run.astype(np.int32), run_cut), pa.int32()), lists(part(h.view(np.int64), cut), pa.int64()),
            lists(part(times.astype(np.int32), cut), pa.int32()), lists(part(docs, occ[cut]), pa.int16()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "first_row", "held", "ids", "w", "pairs", "h", "times", "docs"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, t, n, first_row, size = [], [], [], [], 0, 0
        for batch in batches:
            rows, own_held, own_ids = batch.column("row").to_pylist(), batch.column("held").to_pylist(), batch.column("doc_id").to_pylist()
            for row, some, lengths in tokens(batch):
                if held and (size + len(some) > most_tokens or len(held) + len(lengths) > most_docs or rows[row] != first_row + len(held)):
                    yield flush(held, ids, first_row, t, n)
                    held, ids, t, n, size = [], [], [], [], 0
                for a in range(0, len(lengths), most_docs):  # a segment of very many empty texts
                    if held and a:
                        yield flush(held, ids, first_row, t, n)
                        held, ids, t, n, size = [], [], [], [], 0
                    b, upto = min(a + most_docs, len(lengths)), np.cumsum(np.append(0, lengths))
                    first_row = first_row if held else rows[row + a]
                    held, ids, size = held + own_held[row + a : row + b], ids + own_ids[row + a : row + b], size + int(upto[b] - upto[a])
                    t.append(some[upto[a] : upto[b]])
                    n.append(lengths[a:b])
        if held:
            yield flush(held, ids, first_row, t, n)

    return send


INTS = [f"i{k}" for k in range(1, K + 4)]
KEPT = "kind int, key long, other long, x1 double, x2 double, " + ", ".join(f"{c} int" for c in INTS) + ", before array<long>, times array<int>"
KEPT_SCHEMA = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("other", pa.int64()), ("x1", pa.float64()), ("x2", pa.float64()), *((c, pa.int32()) for c in INTS), ("before", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
DOC, UNSEEN, TOTALS, HEADER, NGRAMS = range(5)


def kept(kind: int, n: int, **columns) -> pa.RecordBatch:
    none = {f.name: pa.nulls(n, f.type) for f in KEPT_SCHEMA}
    given = {c: v if isinstance(v, pa.Array) else pa.array(v, KEPT_SCHEMA.field(c).type) for c, v in columns.items()}
    return pa.RecordBatch.from_pydict({**none, "kind": pa.array(np.full(n, kind, np.int32)), **given}, schema=KEPT_SCHEMA)


def summed(at: np.ndarray, n: int, weights=None) -> np.ndarray:
    return np.bincount(at, weights, n)


def reducer(hot, hot_counts, hot_pairs, hot_pair_counts):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, pair_keys, pair_counts = hot.value, hot_counts.value, hot_pairs.value, hot_pair_counts.value
        rows, subs, d = [], [[] for _ in range(SUBS)], 0
        for x in batches:
            column = lambda c, k, x=x: x.column(c).slice(k, 1).flatten().to_numpy(zero_copy_only=False)
            for k in range(x.num_rows):
                first = x.column("first_row")[k].as_py()
                w, h, times, docs = np.repeat(column("w", k).view(np.uint64), column("pairs", k)), column("h", k).view(np.uint64), column("times", k), column("docs", k)
                if len(w):
                    # Only the texts that have something here are numbered.
                    held, at = docs < 0, np.where(docs < 0, -1 - docs, docs)
                    here, number = np.unique(at, return_inverse=True)
                    rows.append(first + here.astype(np.int64))
                    signed = np.where(held, -1 - (d + number), d + number).astype(np.int32)
                    d += len(here)
                    sub = ((route(h, w, keys, pair_keys) >> np.uint64(16)) % np.uint64(SUBS)).astype(np.int8)
                    of = np.repeat(sub, times)
                    for s in range(SUBS):
                        subs[s].append((w[sub == s], h[sub == s], times[sub == s], signed[of == s]))
                ids = x.column("ids").slice(k, 1).flatten()
                if len(ids):
                    yield kept(HEADER, len(ids), key=np.arange(first, first + len(ids)), other=ids, i1=column("held", k).astype(np.int32))
            del x
        rows = np.concatenate([np.zeros(0, np.int64), *rows])
        sums, totals = {}, np.zeros(K + 3)

        def add(name: str, at: np.ndarray, weights=None) -> None:
            sums[name] = sums.get(name, 0) + summed(at, d, weights)

        for s in range(SUBS):
            w, h, times, docs = (np.concatenate([x[k] for x in subs[s]]) if subs[s] else np.zeros(0, np.uint64) for k in range(4))
            subs[s] = None
            if not len(w):
                continue
            held, docs = docs < 0, np.where(docs < 0, -1 - docs, docs)
            pair, one, group = np.unique(pair_hash(h, w), return_index=True, return_inverse=True)
            of = np.repeat(group, times)
            r = np.rint(summed(of, len(one), (~held).astype(np.float64))).astype(np.int64)
            hot_pair = is_hot(pair, pair_keys)
            if hot_pair.any():  # dealt over many buckets: their counts are known, and are told once, by the driver
                r[hot_pair] = pair_counts[np.searchsorted(pair_keys, pair[hot_pair])]
            u, at = np.unique(w[one], return_inverse=True)
            c = np.rint(summed(at, len(u), r)).astype(np.int64)
            hot_one = is_hot(u, keys)
            if hot_one.any():
                c[hot_one] = counts[np.searchsorted(keys, u[hot_one])]
            totals[0] += c[~hot_one].sum()
            totals[1] += (c[~hot_one] > 0).sum()
            totals[2:] += [(r == k).sum() for k in range(1, K + 2)]
            c = c[at]
            more = np.log10(c + 0.1)
            history = np.where(w[one] == END, 0.0, np.log10(c + 1.0))
            seen, big = r > 0, np.where(r > K, np.log10(np.maximum(r, 1)), 0.0)
            add("n", docs)
            add("known", docs, (c > 0)[of])
            add("base", docs, more[of])
            add("part", docs, (big - history + np.where(seen, 0.0, more))[of])
            for k in range(1, K + 1):
                add(f"r{k}", docs[r[of] == k])
            rest = ~seen[of]
            add("unseen", docs[rest])
            yield kept(UNSEEN, int(rest.sum()), key=rows[docs[rest]], other=h[one][of[rest]].view(np.int64))
            own = np.flatnonzero(seen & ~hot_pair)
            order = own[np.argsort(w[one][own], kind="stable")]
            run = np.flatnonzero(np.concatenate([[True], w[one][order][1:] != w[one][order][:-1]])) if len(order) else order
            by_word = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.append(run, len(order)), pa.int32()), pa.array(x, kind))  # noqa: E731, B023
            yield kept(NGRAMS, len(run), key=w[one][order][run].view(np.int64), x1=c[order][run].astype(np.float64), before=by_word(h[one][order].view(np.int64), pa.int64()), times=by_word(r[order].astype(np.int32), pa.int32()))
        if sums:
            ints = {f"i{k + 2}": sums[f"r{k}"].astype(np.int32) for k in range(1, K + 1)}
            yield kept(DOC, d, key=rows, x1=sums["base"], x2=sums["part"], i1=sums["n"].astype(np.int32), i2=np.rint(sums["known"]).astype(np.int32), **ints, i8=sums["unseen"].astype(np.int32))
        yield kept(TOTALS, 1, x1=totals[:1], x2=totals[1:2], **{f"i{k + 2}": totals[k + 1 : k + 2].astype(np.int32) for k in range(1, K + 2)})

    return reduce


def discounts(n: list[float]) -> list[float]:
    """Katz's discounts of counts 1..K from the counts of counts 1..K + 1; 1 where they are no use (few data)."""
    out = []
    common = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        good = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 1.0
        d = (good - common) / (1 - common) if common < 1 else 1.0
        out.append(d if 0 < d <= 1 else 1.0)
    return out


@dataclass
class Model:
    """Written tables: bigrams (w; before, times: arrays of the words before it and their counts), weights (h, weight: log10 of a(h) times c(h) + 1)."""

    bigrams: DataFrame
    weights: DataFrame
    train_tokens: int
    z: float
    starts: int
    discounts: list[float]


def keyed_rows(docs: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), "text")


def slots_of(spark: SparkSession, n: int) -> list[int]:
    """Numbers that hash partitioning deals to ``n`` partitions of their own, so that no task gets two buckets and another none."""
    tried = 20
    while True:
        slot = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))
        rows = spark.range(tried * n + 1000).groupBy(slot.alias("slot")).agg(F.min("id").alias("id")).collect()  # one for each bucket
        if len(rows) == n:
            return [r["id"] for r in rows]
        tried *= 2


def uint_column(rows: pa.Table, name: str) -> np.ndarray:
    return rows.column(name).to_numpy().view(np.uint64)


def trained(docs: DataFrame, most_tokens: int = TOKENS, most_docs: int = DOCS) -> tuple[Model, DataFrame]:
    """The model of the training rows of ``docs``, and the table of what its buckets say of the texts themselves."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    keyed = keyed_rows(docs)

    found = written(keyed.select("held", "text").mapInArrow(heavy, "w long, n long, train long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("train").alias("train")), "katz-heavy")
    every = found.where("w is null").first()
    total, train = (every["n"], every["train"]) if every else (0, 0)
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_TOKENS))
    one_in = min(max(HOT, 4 * buckets), MOST_HOT)
    # Counts of distinct words that add up to at most ``train`` and are each over a given part of it: at most ``one_in``.
    hot = np.sort(uint_column(found.where(F.col("w").isNotNull() & (F.col("n") * one_in > F.lit(train))).select("w").toArrow(), "w"))
    hot = sc.broadcast(hot)
    exact = keyed.select("held", "text").mapInArrow(counter(hot), "h long, w long, n long").groupBy("h", "w").agg(F.sum("n").alias("n"))
    exact = written(exact.where(F.col("h").isNull() | ((F.col("n") * one_in > F.lit(train)) & (F.col("n") > K + 1))), "katz-hot")
    words = exact.where("h is null").toArrow()
    hot_counts = sc.broadcast(words.column("n").to_numpy()[np.argsort(uint_column(words, "w"))])
    pairs = exact.where("h is not null").toArrow()
    named = pair_hash(uint_column(pairs, "h"), uint_column(pairs, "w"))
    order = np.argsort(named)
    hot_pairs, hot_pair_counts = sc.broadcast(named[order]), sc.broadcast(pairs.column("n").to_numpy()[order])

    path = new_path(spark, "katz")
    sent = keyed.mapInArrow(sender(hot, hot_pairs, slots_of(spark, buckets), most_tokens, most_docs), SENT)
    sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(reducer(hot, hot_counts, hot_pairs, hot_pair_counts), KEPT).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    tables = spark.read.schema(KEPT).parquet(path)
    of = lambda kind: tables.where(F.col("kind") == kind)

    sums = of(TOTALS).agg(F.sum("x1"), F.sum("x2"), *[F.sum(f"i{k + 2}") for k in range(1, K + 2)]).first()
    n, v, *of_counts = (float(x or 0) for x in sums)
    n, v = n + float(hot_counts.value.sum()), v + float((hot_counts.value > 0).sum())
    starts = of(HEADER).where("i1 = 0").count()
    d, z = discounts(of_counts), n + 0.1 * (v + 1)

    seen = of(NGRAMS).select(F.col("x1").alias("c"), F.explode(F.arrays_zip("before", "times")).alias("x")).select("c", F.col("x.before").alias("h"), F.col("x.times").alias("r"))
    taken = F.coalesce(F.get(F.array(*[F.lit(float(r * (1 - d[r - 1]))) for r in range(1, K + 1)]), F.col("r") - 1), F.lit(0.0))
    in_buckets = seen.select("h", taken.alias("lost"), (F.col("c") + 0.1).alias("q"))
    # Hot bigrams: the count of their word is known, and nothing is taken off theirs.
    in_hot = exact.where("h is not null").select("h", "w").join(exact.where("h is null").select("w", "n"), "w").select("h", F.lit(0.0).alias("lost"), (F.col("n") + 0.1).alias("q"))
    contexts = in_buckets.unionByName(in_hot).groupBy("h").agg(F.sum("lost").alias("lost"), F.sum("q").alias("q"))
    weights = written(contexts.select("h", F.log10((1 + F.col("lost")) / (1 - F.col("q") / F.lit(z))).alias("weight")), "katz-weights")
    in_hot = exact.where("h is not null").select("w", F.array("h").alias("before"), F.array(F.col("n").cast("int")).alias("times"))
    bigrams = of(NGRAMS).select(F.col("key").alias("w"), "before", "times").unionByName(in_hot)
    return Model(bigrams, weights, int(n), z, starts, d), tables


def katz_scores(docs: DataFrame, most_tokens: int = TOKENS, most_docs: int = DOCS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; training rows have crc32 mod 10 not 0."""
    model, tables = trained(docs, most_tokens, most_docs)
    of = lambda kind: tables.where(F.col("kind") == kind)
    unseen = of(UNSEEN).groupBy("key", "other").agg(F.count("*").alias("n"))
    none = lambda kind: F.lit(None).cast(kind)
    weight = F.coalesce("weight", F.lit(0.0))  # a context that was never seen leaves all to the words
    backed = unseen.hint("merge").join(model.weights, F.col("other") == F.col("h"), "left").select(F.col("key").alias("row"), none("long").alias("doc_id"), none("boolean").alias("held"), F.lit(0).alias("n"), F.lit(0).alias("known"), F.lit(0.0).alias("base"), (F.col("n") * weight).alias("score"))
    seen = sum((F.col(f"i{r + 2}") * math.log10(r * model.discounts[r - 1]) for r in range(1, K + 1)), F.col("x2"))
    log_z = math.log10(model.z)
    parts = of(DOC).select(F.col("key").alias("row"), none("long").alias("doc_id"), none("boolean").alias("held"), F.col("i1").alias("n"), F.col("i2").alias("known"), (F.col("x1") - F.col("i1") * log_z).alias("base"), (seen - F.col("i8") * log_z).alias("score"))
    # The start's own count: every training row has one.
    heads = of(HEADER).select(F.col("key").alias("row"), F.col("other").alias("doc_id"), (F.col("i1") == 1).alias("held"), F.lit(0).alias("n"), F.lit(0).alias("known"), F.lit(0.0).alias("base"), F.lit(-math.log10(model.starts + 1)).alias("score"))
    every = parts.unionByName(backed).unionByName(heads).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held").alias("held_out"), F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return every.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, h, w, times: the distinct bigrams of each text."""
    for batch in batches:
        rows = batch.column("row").to_numpy()
        for first, w, n in tokens(batch):
            at, h = np.repeat(rows[first : first + len(n)], n), contexts_of(w)
            order = np.lexsort((w, h, at))
            at, h, w = at[order], h[order], w[order]
            new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (h[1:] != h[:-1]) | (w[1:] != w[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(at[new]), pa.array(h[new].view(np.int64)), pa.array(w[new].view(np.int64)), pa.array(np.diff(np.append(new, len(w))))], names=["row", "h", "w", "times"])


def evaluated(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row of any ``docs`` by the tables of a trained model."""
    keyed = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "katz-texts")
    asked = written(keyed.select("row", "text").mapInArrow(spelled, "row long, h long, w long, times long"), "katz-asked")
    counts = model.bigrams.select("w", F.explode(F.arrays_zip("before", "times")).alias("x")).select("w", F.col("x.before").alias("h"), F.col("x.times").alias("r"))
    wanted = asked.select("h", "w").distinct()
    known = written(counts.join(wanted.hint("merge"), ["h", "w"], "left_semi"), "katz-known").withColumnsRenamed({"h": "h2", "w": "w2"})
    # A word's count is the sum over its contexts; a context's that of its word, a start's that of the training rows.
    needed = wanted.select("w").union(wanted.select("h")).distinct()
    words = written(model.bigrams.select("w", F.expr("aggregate(times, 0L, (a, x) -> a + x)").alias("c")).join(needed.hint("merge"), "w", "left_semi").groupBy("w").agg(F.sum("c").alias("c")), "katz-words")
    own = words.select(F.col("w").alias("w3"), F.col("c").alias("c_w"))
    before = words.select(F.col("w").alias("w4"), F.col("c").alias("c_h"))
    met = asked.join(known.hint("merge"), (F.col("h") == F.col("h2")) & (F.col("w") == F.col("w2")), "left").join(own.hint("merge"), F.col("w") == F.col("w3"), "left").join(before.hint("merge"), F.col("h") == F.col("w4"), "left")
    met = met.join(model.weights.withColumnRenamed("h", "h5").hint("merge"), F.col("h") == F.col("h5"), "left")
    r, history = F.col("r"), F.when(F.col("h") == int(START), F.lit(model.starts)).otherwise(F.coalesce("c_h", F.lit(0))) + 1
    d = F.coalesce(F.get(F.array(*map(F.lit, model.discounts)), r - 1), F.lit(1.0))
    log_p = F.when(r.isNotNull(), F.log10(d * r)).otherwise(F.coalesce("weight", F.lit(0.0)) + F.log10((F.coalesce("c_w", F.lit(0)) + 0.1) / F.lit(model.z))) - F.log10(history)
    sums = met.groupBy(F.col("row").alias("of")).agg(F.sum(F.col("times") * log_p).alias("score"))
    return keyed.select("row", "doc_id").join(sums, F.col("row") == F.col("of")).select("doc_id", "score")
