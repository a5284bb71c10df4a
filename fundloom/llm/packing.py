"""Best-fit packing by length-histogram planning.

Texts are tokenised where they lie; a document longer than a sequence is cut. The lengths of all pieces are counted, and the
plan is made over those counts: best fit, longest first, for all pieces of a length at once. It has a few slots for each
length (ranks from-to, first sequence, pieces for each sequence, offset), so its size depends on the sequence
length alone. Pieces get ranks within their length, in salted parts with pre-counted starts, and join their slots.

Nulls and edge cases: a null text is empty; an empty document is its end token alone; rows with a null ``doc_id`` and rows
that repeat one are packed as documents of their own; a document of exactly the sequence length is whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fundloom.llm.shared import written
from fundloom.llm.texthash import column

END_ID = 0
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Chunks of these characters alone are taken apart here as the tokenizer does (letters, single digits, the rest); the apostrophe is
#: left out, as it takes letters with it. All other chunks go through the whole tokenizer.
PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
NOT_ASCII = [*range(0xDF, 0xF7), *range(0xF8, 0x100)]


class ChunkIds:
    """Token ids of white-space separated chunks, for the word-level tokenizer files (white space dropped, lower case).

    Such a tokenizer never joins across white space, so the ids of a text are those of its chunks in order. Up to ``MOST`` chunks and
    as many words are remembered; later ones are tokenised whenever they come.
    """

    MOST = 700_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if not all(t.content.startswith("<|") for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("special tokens that start otherwise than <|")
        # How the tokenizer writes the bytes of a letter, asked from itself.
        self.written = {k: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(k))[0][0] for k in NOT_ASCII}
        self.at: dict[bytes, int] = {}
        self.words: dict[str, list[int]] = {}
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def word(self, word: str) -> list[int]:
        found = self.words.get(word)
        if found is None:
            found = [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.translate(self.written))]
            if len(self.words) < self.MOST:
                self.words[word] = found
        return found

    def chunk(self, chunk: bytes) -> list[int]:
        text = chunk.decode()
        if b"<|" not in chunk and PLAIN.fullmatch(text):
            text = text.lower()
            return self.word(text) if text.isalpha() else [k for x in PARTS.findall(text) for k in self.word(x)]
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def __call__(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks in a row, and where each chunk's ids start (and the last end)."""
        at = np.fromiter(map(self.at.get, chunks, repeat(-1)), np.int64, len(chunks))
        flat, starts = self.flat, self.starts
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new: dict[bytes, int] = {}
            first = len(starts) - 1
            at[missing] = [new.setdefault(chunks[k], first + len(new)) for k in missing.tolist()]
            ids = [self.chunk(c) for c in new]
            flat = np.concatenate([flat, np.fromiter(chain.from_iterable(ids), np.uint32)])
            starts = np.concatenate([starts, starts[-1] + np.cumsum([len(x) for x in ids], dtype=np.int64)])
            if len(self.at) + len(new) <= self.MOST:
                self.at.update(new)
                self.flat, self.starts = flat, starts
        lengths = starts[at + 1] - starts[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return flat[np.arange(ends[-1]) + np.repeat(starts[at] - ends[:-1], lengths)], ends


def cutter(path: str, size: int, keep_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if keep_ids else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fundloom.llm.chunkids import encoder  # it is built on what stands here

        for batch in batches:
            doc_ids, rows = batch.column("doc_id").to_pylist(), []
            for doc_id, ids in zip(doc_ids, encoder(path).texts(column(batch, "text")), strict=True):
                ids[-1] = END_ID
                for k, a in enumerate(range(0, len(ids), size)):
                    own = ids[a : a + size].astype("<u4")
                    rows.append((doc_id, k, a, len(own), zlib.crc32(own.tobytes()), *([own.astype(np.int32)] if keep_ids else [])))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return cut


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, end rank, first sequence, pieces for each sequence, offset) of best fit, longest first.

    Sequences of equal filling are kept as runs. The fullest that has room takes as many pieces of a length as go in,
    just as best fit does piece by piece.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, how many)
    slots, sequences = [], 0

    def place(length: int, rank: int, left: int, run: tuple[int, int], space: int) -> int:
        first, n = run
        each = space // length
        full = min(n, left // each)
        if full:
            slots.append((length, rank, rank + full * each, first, each, size - space))
            room.setdefault(space - each * length, []).append((first, full))
        done, rest = full * each, left - full * each
        if full < n and 0 < rest < each:
            slots.append((length, rank + done, rank + left, first + full, rest, size - space))
            room.setdefault(space - rest * length, []).append((first + full, 1))
            done, full = left, full + 1
        if full < n:
            room.setdefault(space, []).append((first + full, n - full))
        return done

    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        for space in sorted(s for s in room if s >= length):
            runs = room.pop(space)
            while runs and rank < end:
                rank += place(length, rank, end - rank, runs.pop(0), space)
            if runs:
                room.setdefault(space, []).extend(runs)
            if rank == end:
                break
        if rank < end:
            n = -(-(end - rank) // (size // length))
            place(length, rank, end - rank, (sequences, n), size)
            sequences += n
        room.pop(0, None)
    return slots


def packed(docs: DataFrame, tokenizer_path: str, size: int = 2048, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset of every piece."""
    spark = docs.sparkSession
    fields = PIECE + (", ids array<int>" if keep_ids else "")
    pieces = written(docs.select("doc_id", "text").mapInArrow(cutter(tokenizer_path, size, keep_ids), fields), "pack-pieces")
    salts = max(64, pieces.count() // 2_000_000)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    by_salt = written(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "pack-counts")
    # At most ``size`` lengths.
    counts = {r["length"]: r["n"] for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    starts = by_salt.select(F.col("length").alias("l"), F.col("salt").alias("s"), (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(starts.hint("merge"), (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).withColumn("rank", F.col("own") + F.col("before"))
    slots = spark.createDataFrame(best_fit_plan(counts, size), "l2 long, first_rank long, end_rank long, first long, each long, at long")
    # Its size is bounded by the sequence length, whatever the number of documents.
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("l2")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    k = F.col("rank") - F.col("first_rank")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []), (F.col("first") + F.floor(k / F.col("each"))).alias("sequence_id"), (F.col("at") + F.pmod(k, F.col("each")) * F.col("length")).alias("offset"))
