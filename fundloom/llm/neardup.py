"""Near-duplicate detection by MinHash with tensored banding.

Two small collections of ``GROUPS`` groups of ``ROWS`` minhashes each are evaluated (2 * 8 * 2 = 32 minhashes). Table (i, j)
is keyed by group i of the first collection together with group j of the second, which gives 8 * 8 = 64 tables of
4 minhashes a key, for the cost of 32 minhashes in place of 256. At a similarity of 0.85 a pair meets in no table with probability
7e-5, at 0.9 with 5e-6, at 0.80 with 6e-4.

1. Documents with equal shingle sets are one representative (its smallest doc_id).
2. Each bucket of a table has a hub, its member of the least rank (the one that shares the most minhashes with others; the same rank
   in all tables), found by a pre-aggregated minimum; members are paired with hubs only, never with each other.
3. Pairs that sizes and sketches allow are confirmed on the full shingle sets. Confirmed links give components.
4. In buckets that still hold several components, the members outside the largest are compared with those of other components:
   blocks of at most some ``BLOCK`` members meet in a task, which compares sketches (the ``LOW`` least shingles: the whole set of most
   texts) and names what must be confirmed. A pair is compared in the first table that it shares, whatever the size of the bucket;
   pairs inside a component (large groups of copies) are never compared, and of the links that one member surely has to one
   component, the best is named.

A set: distinct hashes of 5-word shingles (64 bits); with fewer words, the whole sequence as one; without words, empty and
linked with nothing. A null text has no words. Rows with a null doc_id link with nothing: component_id is null, kept true. Rows
that repeat a doc_id are one document with the links of all its texts; each row comes back with its own n_shingles. An
empty table gives an empty result. Other columns are ignored. Equal ranks are told apart by the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundloom.llm import texthash
from fundloom.llm.components import connected, relabelled
from fundloom.llm.shared import free_names, written

GROUPS, ROWS = 8, 2
#: Groups of all 16 that must agree before a pair with a hub is confirmed (such a pair at 0.85 has 11.6 on average); step 4 asks for none.
AGREE = 4
#: Least shingles of a text that stand for its set in step 4, and what an estimate from them may be off, in percent: 5 deviations at
#: 0.8 and above. Sets of up to ``LOW`` are compared whole.
LOW, SPARE = 512, 9
#: Members of a bucket that stand on either side of a task's comparison, on average.
BLOCK = 512
SEEDS = texthash.mixed(np.arange(1, 2 * GROUPS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
FACTORS = texthash.mixed(SEEDS) | np.uint64(1)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """The groups of both collections: each group's minhashes folded into one number."""
    least = np.full(len(SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 4096):
        x = (shingles[a : a + 4096, None] ^ SEEDS) * FACTORS
        x ^= x >> np.uint64(32)
        np.minimum(least, x.min(axis=0), out=least)
    rows = least.reshape(2 * GROUPS, ROWS)
    out = np.zeros(2 * GROUPS, np.uint64)
    for k in range(ROWS):
        out = texthash.mixed(out + rows[:, k])
    return out


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    for _, hashes, first in texthash.hashed_texts(texts):
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield np.unique(texthash.shingles(hashes[a:b], words))


SIGNED = "doc_id long, n long, f1 long, f2 long, groups array<long>"


def signer(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("groups", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, groups = [], [], [], []
            for s in shingle_sets(texthash.column(batch, "text"), words):
                n.append(len(s))
                one, two = fingerprints(s)
                f1.append(one)
                f2.append(two)
                groups.append(minhashes(s).view(np.int64) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(groups, pa.list_(pa.int64()))], schema=schema)

    return sign


FIRST = 0x2545F4914F6CDD1D


def fingerprints(s: np.ndarray) -> tuple[int, int]:
    """Two numbers that, with the size, name a set."""
    if not len(s):
        return 0, 0
    return int(np.add.reduce(s, dtype=np.uint64).view(np.int64)), int(np.add.reduce(texthash.mixed(s ^ np.uint64(FIRST)), dtype=np.uint64).view(np.int64))


def lowest(words: int):
    """Each text's set: its size and name, and its ``LOW`` least shingles (upper 31 bits, in order)."""

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, found = [], [], []
            for s in shingle_sets(texthash.column(batch, "text"), words):
                n.append(len(s))
                names.append(fingerprints(s))
                found.append((s[:LOW] >> np.uint64(33)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64()), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32()))], names=["f1", "f2", "n", "low"])

    return low


def confirmer(words: int, percent: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_text, hub_set = None, None, None
        for batch in batches:
            u, v = batch.column("u").to_numpy(), batch.column("v").to_numpy()
            texts, keep = texthash.column(batch, "text_v"), np.zeros(len(u), bool)
            for k, own in enumerate(shingle_sets(texthash.column(batch, "text_u"), words)):
                text = texts[k].as_py()
                if hub != v[k] or hub_text != text:
                    hub, hub_text, hub_set = v[k], text, next(shingle_sets(pa.array([text], pa.large_string()), words))
                both = len(np.intersect1d(own, hub_set, assume_unique=True))
                keep[k] = both > 0 and 100 * both >= percent * (len(own) + len(hub_set) - both)
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], schema=schema)

    return confirm


def confirmed(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose full sets are alike enough. Texts travel, as they are smaller than their sets."""
    texts = docs.select("doc_id", "text")
    left = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
    both = left.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
    return both.select("u", "v", "text_u", "text_v").mapInArrow(confirmer(words, percent), "u long, v long")


def sizes_fit(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def agreeing(a: str, b: str) -> Column:
    return F.expr(f"size(filter(zip_with({a}, {b}, (x, y) -> x = y), t -> t)) >= {AGREE}")


def with_sketches(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (u, v) that the sizes and the sketches of any of their texts allow."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("groups").alias(f"g_{x}"))
    joined = pairs.join(side("u"), "u").join(side("v"), "v")
    return joined.where(sizes_fit("n_u", "n_v", percent)).where(agreeing("g_u", "g_v")).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    signed = written(docs.select("doc_id", "text").mapInArrow(signer(words), SIGNED), "near-signed")
    named = signed.where("n > 0 and doc_id is not null")
    reps = named.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.any_value("groups").alias("groups")).withColumn("sid", set_id())
    reps = written(with_rank(written(reps, "near-sets")), "near-reps")

    keys = reps.select("rep", "sid", "n", "rank", F.expr(f"explode(flatten(transform(sequence(0, {GROUPS - 1}), i -> transform(sequence(0, {GROUPS - 1}), j -> named_struct('t', i * {GROUPS} + j, 'key', xxhash64(i, j, groups[i], groups[j + {GROUPS}]))))))").alias("k")).select("k.key", "k.t", "rep", "sid", "n", "rank")
    hubs = keys.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("rank", "rep", "n")).alias("hub")).where("size > 1").withColumnRenamed("key", "hub_key")
    members = written(keys.drop("rank").hint("merge").join(hubs.hint("merge"), F.col("key") == F.col("hub_key")).drop("hub_key", "size"), "near-members")
    tried = written(with_sketches(star(members.where("rep <> hub.rep"), percent), reps, percent), "near-pairs")
    # A document that has several texts is one node; its rows without words belong to it too.
    texts_of = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("f1", "f2", "n")).alias("a"), F.max(F.struct("f1", "f2", "n")).alias("b")).where("a <> b").select("doc_id")
    several = written(named.join(texts_of, "doc_id").join(reps, ["f1", "f2", "n"]).select("doc_id", "rep"), "near-several")
    edges = written(confirmed(docs, tried, words, percent).unionByName(several.select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))), "near-edges")
    labels = written(connected(edges), "near-labels")

    open_ = written(still_mixed(members, labels), "near-open")
    if not open_.isEmpty():
        ids = written(open_.select("rep").distinct(), "near-open-ids")
        texts = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("rep")).select("text")
        low = texts.mapInArrow(lowest(words), "f1 long, f2 long, n long, low array<int>").groupBy(set_id().alias("sid")).agg(F.any_value("low").alias("low"))
        named_pairs = written(cross_pairs(open_, reps, written(low, "near-low"), percent), "near-cross")
        more = written(named_pairs.join(tried, ["u", "v"], "left_anti"), "near-more-pairs")
        labels = written(relabelled(labels, written(confirmed(docs, more, words, percent), "near-edges")), "near-labels")

    of_doc = several.groupBy(F.col("doc_id").alias("d2")).agg(F.min("rep").alias("rep2"))
    told = signed.join(reps.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"], "left").join(of_doc, F.col("doc_id") == F.col("d2"), "left")
    told = told.withColumn("rep", F.coalesce("rep2", "rep")).join(labels, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("label", "rep", "doc_id"))
    return told.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def set_id() -> Column:
    return F.xxhash64("f1", "f2", "n")


def with_rank(reps: DataFrame) -> DataFrame:
    """``reps`` with a rank: the more documents share its minhash groups, the lower. The text that copies were made from shares
    most, and copies that are less like each other than the bound are still like that one."""
    groups = reps.select("rep", F.posexplode("groups").alias("g", "value"))
    shared = groups.groupBy(F.col("g").alias("g2"), F.col("value").alias("v2")).agg(F.count("*").alias("held")).where("held > 1")
    rank = groups.hint("merge").join(shared.hint("merge"), (F.col("g") == F.col("g2")) & (F.col("value") == F.col("v2"))).groupBy(F.col("rep").alias("r2")).agg((-F.sum("held")).alias("rank"))
    return reps.join(rank, F.col("rep") == F.col("r2"), "left").drop("r2").withColumn("rank", F.coalesce("rank", F.lit(0)))


def star(held: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (u > v) of a member with its bucket's hub, if their sizes fit."""
    fits = held.where(100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n"))
    return fits.select(F.greatest("rep", "hub.rep").alias("u"), F.least("rep", "hub.rep").alias("v")).distinct()


def still_mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, t, rep, sid, label of the buckets that hold more than one component."""
    held = members.select("key", "t", "rep", "sid").join(labels, F.col("rep") == F.col("node"), "left").select("key", "t", "rep", "sid", F.coalesce("label", "rep").alias("label"))
    mixed = held.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select(F.col("key").alias("mixed"))
    return held.join(mixed, F.col("key") == F.col("mixed")).drop("mixed")


def cross_pairs(open_: DataFrame, reps: DataFrame, low: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (u > v) of different components that share a bucket and may be alike. A bucket's minority (all but its largest
    component) is cut into blocks, so is the whole bucket, and each two blocks meet in one task."""
    largest = open_.groupBy("key", "label").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("largest"), F.sum("m").alias("size"), (F.sum("m") - F.max("m")).alias("minor"))
    cuts = largest.select(F.col("key").alias("of"), "largest", F.ceil(F.col("minor") / BLOCK).cast("int").alias("n_i"), F.ceil(F.col("size") / BLOCK).cast("int").alias("n_j"))
    held = open_.join(cuts, F.col("key") == F.col("of")).drop("of")
    dealt = lambda n, salt: F.pmod(F.xxhash64("sid", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["key", "t", "rep", "sid", "label", "largest"]
    minority = held.where("label <> largest").select(*own, F.lit(True).alias("minor"), dealt("n_i", 1).alias("i"), every("n_j").alias("j"))
    bucket = held.select(*own, F.lit(False).alias("minor"), every("n_i").alias("i"), dealt("n_j", 2).alias("j"))
    about = reps.select("sid", "n", "groups").join(low, "sid")
    sides = minority.unionByName(bucket).hint("merge").join(about.hint("merge"), "sid").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return sides.mapInArrow(comparer(percent), "u long, v long").distinct()


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """The runs of rows that agree in ``by``, which batches may cut."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pa.concat_batches([rest, batch])
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in by])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)
        rest = batch.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest


def common(values: np.ndarray, owner: np.ndarray, rows: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many values the rows x[k] and y[k] share, for each k, by bit maps over the values that several rows have."""
    _, at, n = np.unique(values, return_inverse=True, return_counts=True)
    several = n > 1
    column, keep = (np.cumsum(several) - 1)[at], several[at]
    column, owner, out = column[keep], owner[keep], np.zeros(len(x), np.int64)
    for a in range(0, int(several.sum()), 4096):
        here = (column >= a) & (column < a + 4096)
        bits = np.zeros((rows, 4096), bool)
        bits[owner[here], column[here] - a] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        packed = packed[:, packed.any(axis=0)]
        for k in range(0, len(x), 1 << 16):
            out[k : k + (1 << 16)] += np.bitwise_count(packed[x[k : k + (1 << 16)]] & packed[y[k : k + (1 << 16)]]).sum(axis=1, dtype=np.int64)
    return out


def comparer(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["key", "i", "j"]):
            minor = group.column("minor").to_numpy(zero_copy_only=False)
            m, b = np.flatnonzero(minor), np.flatnonzero(~minor)
            if not len(m) or not len(b):
                continue
            rep, sid, n, label = (group.column(c).to_numpy() for c in ("rep", "sid", "n", "label"))
            t, largest = group.column("t")[0].as_py(), group.column("largest")[0].as_py()
            g = group.column("groups").flatten().to_numpy().reshape(-1, 2 * GROUPS)
            fits = (label[m][:, None] != label[b]) & (100 * np.minimum(n[m][:, None], n[b]) >= percent * np.maximum(n[m][:, None], n[b])) & ((label[b] == largest) | (sid[m][:, None] < sid[b]))
            # The first table that a pair shares is that of its first equal groups.
            for upto in range(t // GROUPS):
                fits &= g[m, upto][:, None] != g[b, upto]
            for upto in range(GROUPS, GROUPS + t % GROUPS):
                fits &= g[m, upto][:, None] != g[b, upto]
            x, y = np.nonzero(fits)
            if not len(x):
                continue
            x, y = m[x], b[y]
            low = group.column("low")
            values, size = low.flatten().to_numpy().astype(np.int64), low.value_lengths().to_numpy().astype(np.int64)
            start = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(size)), size)
            both = common(values, owner, len(size), x, y)
            # Up to where either sketch reaches, it holds all of its set.
            reach = np.where(n > LOW, values[start + size - 1], 1 << 31)
            upto, keyed = np.minimum(reach[x], reach[y]), (owner << 32) + values
            held = lambda z: np.searchsorted(keyed, (z << 32) + upto, "right") - start[z]  # noqa: E731, B023
            union = held(x) + held(y) - both
            exact = (n[x] <= LOW) & (n[y] <= LOW)
            may = (both > 0) & (100 * both >= np.where(exact, percent, percent - SPARE) * union)
            sure = may & (exact | (100 * both >= (percent + SPARE) * union))
            order = np.flatnonzero(sure)
            order = order[np.argsort(-(both[order] / union[order]), kind="stable")]
            pair = np.stack([sid[x], label[y]])
            _, best = np.unique(pair[:, order], axis=1, return_index=True)
            known = {tuple(p) for p in pair[:, order[best]].T.tolist()}
            rest = [k for k in np.flatnonzero(may & ~sure) if (sid[x[k]], label[y[k]]) not in known]
            named = np.concatenate([order[best], np.array(rest, np.int64)]).astype(np.int64)
            u, v = rep[x[named]], rep[y[named]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    return compare


def without_near_duplicates(docs: DataFrame, **kind) -> DataFrame:
    """Rows of ``docs`` whose document stands for its group (rows of a repeated doc_id stay or go together); all columns."""
    (d,) = free_names(docs, 1)
    gone = near_duplicates(docs, **kind).where("not kept").select(F.col("doc_id").alias(d)).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(d), "left_anti")
