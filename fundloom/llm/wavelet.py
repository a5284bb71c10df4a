"""Token ids in wavelet-matrix files.

Texts are sorted by range of ``doc_id``, tokenised where they land, and written as shards, each one file in the shared folder. A shard is a wavelet matrix:
one bit-plane for each bit of the ids, highest first, ids ordered stably by each bit in turn before the next. Planes are cut into
blocks of ``BLOCK`` bits that are compressed one by one; the directory at the end has their places, the ones before each, the zeros of each
plane, and the documents' ids and ends. From the one file come a token at any place (one block a plane), the count of a token up to a
place (rank), the places of a token (select), and all ids in order (planes undone from the last to the first).

    blocks | directory (compressed) | directory's offset, length, crc32 | magic

Nulls and edge cases: a null text is empty, an empty one its end token alone; rows with a null ``doc_id`` come first; rows that repeat a
``doc_id`` stand side by side, by a hash of their texts, each with a start of its own; a document is never cut over shards; an empty
table gives no file and empty results; a token that a shard doesn't hold has count 0 there; other columns are ignored. A task that is run again
writes other files; only those that the written list names count. What reaches the driver is one number for each range of ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fundloom.llm.chunkids import encoder
from fundloom.llm.shared import new_path, written
from fundloom.llm.texthash import column
from fundloom.llm.warc import Opened

MAGIC = b"WVMXv1\r\n"
FOOT = struct.Struct("<QQI8s")
HEAD = struct.Struct("<QIQI")
#: Bits of a block, and ids of a shard at which it is closed.
BLOCK, SHARD = 1 << 17, 1_000_000
CODEC = "zstd"
#: Blocks that an opened shard keeps.
KEPT = 64


# --- one file --------------------------------------------------------------------------------------------------------


def packed_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of a shard: ``ids`` of all its documents in order."""
    n, planes = len(ids), max(1, int(ids.max(initial=0)).bit_length())
    out, at, offsets, ones, zeros = [], 0, [], [], []
    now = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    for b in range(planes - 1, -1, -1):
        bit = (now & now.dtype.type(1 << b)) != 0
        before = 0
        for k in range(0, n, BLOCK):
            own = bit[k : k + BLOCK]
            body = pa.compress(np.packbits(own).tobytes(), codec=CODEC, asbytes=True)
            offsets.append(at)
            ones.append(before)
            out.append(body)
            at += len(body)
            before += int(own.sum())
        zeros.append(n - before)
        now = np.concatenate([now[~bit], now[bit]])
    empty = [x is None for x in doc_ids]
    fields = [np.array(x, "<i8") for x in (zeros, [*offsets, at], ones, [x or 0 for x in doc_ids], empty, np.cumsum(lengths))]
    plain = HEAD.pack(n, planes, len(doc_ids), -(-n // BLOCK)) + b"".join(x.tobytes() for x in fields)
    directory = struct.pack("<Q", len(plain)) + pa.compress(plain, codec=CODEC, asbytes=True)
    return b"".join([*out, directory, FOOT.pack(at, len(directory), zlib.crc32(directory), MAGIC)])


class Shard:
    """A shard's file, of which blocks are read as they are needed. ``read`` takes offset and length."""

    def __init__(self, read, size: int):
        self.read, self.cache = read, OrderedDict()
        at, length, crc, magic = FOOT.unpack(read(size - FOOT.size, FOOT.size))
        directory = read(at, length)
        if magic != MAGIC or zlib.crc32(directory) != crc:
            raise ValueError("not a shard, or a damaged one")
        plain = pa.decompress(directory[8:], decompressed_size=struct.unpack("<Q", directory[:8])[0], codec=CODEC, asbytes=True)
        self.n, self.planes, docs, self.blocks = HEAD.unpack(plain[: HEAD.size])
        numbers, parts, k = np.frombuffer(plain, "<i8", offset=HEAD.size), [], 0
        for many in (self.planes, self.planes * self.blocks + 1, self.planes * self.blocks, docs, docs, docs):
            parts.append(numbers[k : k + many])
            k += many
        self.zeros, self.offsets, self.ones, ids, empty, self.ends = parts
        self.doc_ids = [None if e else int(x) for x, e in zip(ids, empty, strict=True)]

    def block(self, plane: int, k: int) -> np.ndarray:
        """Bits of a block as 0 and 1."""
        i = plane * self.blocks + k
        if i not in self.cache:
            bits = min(BLOCK, self.n - k * BLOCK)
            raw = pa.decompress(self.read(int(self.offsets[i]), int(self.offsets[i + 1] - self.offsets[i])), decompressed_size=-(-bits // 8), codec=CODEC, asbytes=True)
            self.cache[i] = np.unpackbits(np.frombuffer(raw, np.uint8), count=bits)
            if len(self.cache) > KEPT:
                self.cache.popitem(last=False)
        return self.cache[i]

    def ranks(self, plane: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones before each place (0 to n), and the bit there (0 at n)."""
        rank, bit = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        at_end = places == self.n
        rank[at_end] = self.n - self.zeros[plane]
        for k in np.unique(places[~at_end] // BLOCK):
            own = np.flatnonzero(~at_end & (places // BLOCK == k))
            bits, inner = self.block(plane, int(k)), places[own] - k * BLOCK
            bit[own] = bits[inner]
            rank[own] = self.ones[plane * self.blocks + k] + np.cumsum(bits, dtype=np.int64)[inner] - bit[own]
        return rank, bit

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at given places."""
        at, out = np.asarray(places, np.int64), np.zeros(len(places), np.int64)
        for plane in range(self.planes):
            rank, bit = self.ranks(plane, at)
            out = out << 1 | bit
            at = np.where(bit == 1, self.zeros[plane] + rank, at - rank)
        return out

    def spans(self, token: int, places: np.ndarray) -> np.ndarray:
        """Where places come to stand when all planes are walked as the token's bits say; from place 0, the start of its own span."""
        at = np.asarray(places, np.int64)
        for plane in range(self.planes):
            rank, _ = self.ranks(plane, at)
            at = self.zeros[plane] + rank if token >> (self.planes - 1 - plane) & 1 else at - rank
        return at

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often a token stands in [start, stop)."""
        if token < 0 or token >> self.planes:
            return 0
        a, b = self.spans(token, np.array([start, self.n if stop is None else stop]))
        return int(b - a)

    def occurrences(self, token: int) -> np.ndarray:
        """All places of a token, in order."""
        if token < 0 or token >> self.planes:
            return np.zeros(0, np.int64)
        a, b = self.spans(token, np.array([0, self.n]))
        at = np.arange(a, b)
        for plane in range(self.planes - 1, -1, -1):
            at = self.selected(plane, at - self.zeros[plane], 1) if token >> (self.planes - 1 - plane) & 1 else self.selected(plane, at, 0)
        return at

    def selected(self, plane: int, ranks: np.ndarray, bit: int) -> np.ndarray:
        """Places of the bits ``bit`` with given numbers (from 0) among their like."""
        own = self.ones[plane * self.blocks : (plane + 1) * self.blocks]
        before = own if bit else np.arange(self.blocks) * BLOCK - own
        block, out = np.searchsorted(before, ranks, "right") - 1, np.zeros(len(ranks), np.int64)
        for k in np.unique(block):
            here = block == k
            out[here] = k * BLOCK + np.flatnonzero(self.block(plane, int(k)) == bit)[ranks[here] - before[k]]
        return out

    def ids(self) -> np.ndarray:
        """All ids in order: planes undone from the last to the first."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for plane in range(self.planes - 1, -1, -1):
            bit = np.concatenate([self.block(plane, k) for k in range(self.blocks)]).view(bool) if self.n else np.zeros(0, bool)
            up = np.empty(self.n, kind)
            up[~bit] = now[: self.zeros[plane]]
            up[bit] = now[self.zeros[plane] :] | kind(1 << (self.planes - 1 - plane))
            now = up
        return now.astype(np.uint32)


# --- tables of shards ------------------------------------------------------------------------------------------------


LISTED = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("uri", pa.string()), ("tokens", pa.int64()), ("documents", pa.int64())])


def shard_writer(path: str, folder: str, end_id: int, shard_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, doc_ids, ids, held = TaskContext.get().partitionId(), [], [], [], 0

        def close() -> None:
            nonlocal doc_ids, ids, held
            uri = f"{folder}/{uuid.uuid4().hex}.wvm"
            filesystem, place = fs.FileSystem.from_uri(uri)
            filesystem.create_dir(place.rpartition("/")[0], recursive=True)
            with filesystem.open_output_stream(place) as out:
                out.write(packed_shard(np.concatenate(ids), doc_ids, [len(x) for x in ids]))
            rows.append((part, len(rows), uri, held, len(doc_ids)))
            doc_ids, ids, held = [], [], 0

        for batch in batches:
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), encoder(path).texts(column(batch, "text")), strict=True):
                own[-1] = end_id
                doc_ids.append(doc_id)
                ids.append(own)
                held += len(own)
                if held >= shard_tokens:
                    close()
        if doc_ids:
            close()
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(LISTED)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, LISTED, strict=True)], schema=LISTED)

    return write


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 1, shard_tokens: int = SHARD) -> DataFrame:
    """Write all texts into shards of the shared folder; part, shard, uri, tokens, documents and start (ids in all shards before) of each."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    # The hash parts rows of one id too, so an id that many rows share is no range of its own.
    dealt = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    writer = shard_writer(tokenizer_path, new_path(spark, "wavelet"), end_id, shard_tokens)
    shards = written(dealt.select("doc_id", "text").mapInArrow(writer, "part int, shard int, uri string, tokens long, documents long"), "wavelet-shards")
    # One number for each range of ids.
    starts, before = [], 0
    for part, n in sorted(tuple(r) for r in shards.groupBy("part").agg(F.sum("tokens")).collect()):
        starts.append((part, before))
        before += n
    own = F.sum("tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("tokens")
    at = spark.createDataFrame(starts, "p int, before long")
    return written(shards.withColumn("own", own).join(F.broadcast(at), F.col("part") == F.col("p")).select("part", "shard", "uri", "tokens", "documents", (F.col("own") + F.col("before")).alias("start")), "wavelet-listed")


def each_shard(shards: DataFrame, columns: list[str], work, kinds: str) -> DataFrame:
    """``work(shard, start, *values of columns)`` gives record batches for each listed shard. A shard is a few bytes in the list and megabytes of
    work, so the number of tasks is stated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, *rest in zip(*(batch.column(c).to_pylist() for c in ("uri", "start", *columns)), strict=True):
                with Opened(uri) as file:
                    yield from work(Shard(file.read, file.size), start, *rest)

    return shards.repartition(max(shards.sparkSession.sparkContext.defaultParallelism, shards.count() // 2), "uri").mapInArrow(run, kinds)


def read_documents(shards: DataFrame, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (, ids) of every document in the shards, from the files."""

    def told(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        ids = shard.ids().astype("<u4")
        begins = np.concatenate([[0], shard.ends[:-1]])
        own = [ids[a:z] for a, z in zip(begins, shard.ends, strict=True)]
        columns = {"doc_id": pa.array(shard.doc_ids, pa.int64()), "start": pa.array(begins + start, pa.int64()), "n_tokens": pa.array(shard.ends - begins, pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64())}
        if keep_ids:
            columns["ids"] = pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_pydict(columns)

    return each_shard(shards, [], told, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else ""))


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """token, n: how often each of a few tokens stands in all shards, by ranks alone."""

    def told(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.int32()), "n": pa.array([shard.count(t) for t in tokens], pa.int64())})

    return each_shard(shards, [], told, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """doc_id, place (in all shards) and offset (in its document) of each occurrence of a token, by select."""

    def told(shard: Shard, start: int) -> Iterator[pa.RecordBatch]:
        at = shard.occurrences(token)
        doc = np.searchsorted(shard.ends, at, "right")
        begins = np.concatenate([[0], shard.ends[:-1]])
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array([shard.doc_ids[k] for k in doc], pa.int64()), "place": pa.array(at + start, pa.int64()), "offset": pa.array(at - begins[doc], pa.int64())})

    return each_shard(shards, [], told, "doc_id long, place long, offset long")


def tokens_at(shards: DataFrame, places: DataFrame, bucket: int = SHARD) -> DataFrame:
    """place, token for each row of ``places`` (place: a place in all shards) that lies in a shard."""
    # A shard stands in all buckets of places that it reaches, so shards and places meet by bucket.
    reach = shards.select("uri", "start", "tokens", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("start") + F.col("tokens") - 1) / bucket))).alias("b"))
    asked = places.select("place").withColumn("k", F.floor(F.col("place") / bucket))
    met = asked.hint("merge").join(reach.hint("merge"), (F.col("k") == F.col("b")) & (F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("tokens")))
    # Places of a shard in pieces of bounded length.
    groups = met.groupBy("uri", "start", F.pmod(F.xxhash64("place"), F.lit(64)).alias("salt")).agg(F.collect_list("place").alias("places"))

    def told(shard: Shard, start: int, own: list[int]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"place": pa.array(own, pa.int64()), "token": pa.array(shard.access(np.array(own, np.int64) - start), pa.int32())})

    return each_shard(groups, ["places"], told, "place long, token int")
