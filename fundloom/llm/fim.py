"""Fill-in-the-middle examples by rotating blocks in place.

A text is cut at line ends into prefix, middle and suffix. Its bytes lie in one bytearray with a sentinel set before each
part (``<P>`` prefix ``<M>`` middle ``<S>`` suffix); neighbouring blocks are then exchanged by three reversals, with no second copy
of the text: middle and suffix for prefix-suffix-middle order (psm), all before the suffix and the suffix for suffix-prefix-middle
order (spm). The inverse finds the sentinels, turns the same blocks back and takes the sentinels out, which gives the text byte for byte.
A cut stands after a line end or at an end of the text, so no sentinel can arise or vanish at one.

Nulls and edge cases: a null text is empty; an empty text, one that holds a sentinel already, and one that the rate leaves out are
plain, that is unchanged; a null ``doc_id`` is drawn for as if its decimal form were empty; rows that repeat a ``doc_id`` are cut by the same
draws, each in its own lines; any part may be empty; an empty table gives an empty result; other columns are ignored. Rows are worked on
one by one where they lie: nothing is shuffled, and what a task holds is one batch and one text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fundloom.llm.texthash import column

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of text that a batch sent back to the JVM holds at most, but for one text.
SEND = 8 << 20


def reverse(v: np.ndarray, a: int, z: int) -> None:
    half = (z - a) // 2
    left = v[a : a + half].copy()
    v[a : a + half] = v[z - half : z][::-1]
    v[z - half : z] = left[::-1]


def rotate(text: bytearray, a: int, mid: int, z: int) -> None:
    """Exchange the blocks [a, mid) and [mid, z) of ``text`` in place."""
    v = np.frombuffer(text, np.uint8)
    reverse(v, a, mid)
    reverse(v, mid, z)
    reverse(v, a, z)


def line_ends(text: bytes) -> np.ndarray:
    """0, then where each line ends; a last line may lack its line end."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    last = [] if not text or text.endswith(b"\n") else [len(text)]
    return np.concatenate([[0], ends, last]).astype(np.int64)


def arranged(text: bytes, first: int, second: int, form: str) -> bytearray:
    """``text`` with its middle from ``first`` to ``second`` in the order of ``form``."""
    out = bytearray(text)
    out[second:second] = SUFFIX
    out[first:first] = MIDDLE
    out[:0] = PREFIX
    a, mid = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(out, 0 if form == "spm" else a, mid, len(out))
    return out


def rebuilt(output: bytes, form: str) -> bytes:
    """The text that ``arranged`` was given."""
    if form == "plain":
        return output
    out = bytearray(output)
    a, mid = (0, out.index(PREFIX)) if form == "spm" else (out.index(SUFFIX), out.index(MIDDLE))
    rotate(out, a, mid, len(out))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = out.index(mark)
        del out[at : at + len(mark)]
    return bytes(out)


def code_points(text: bytes) -> int:
    return int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())


def example(doc_id: int | None, text: bytes, seed: int, rate: int, spm: int) -> tuple:
    """n, form, prefix_chars, middle_chars, output."""
    ends = line_ends(text)
    n = len(ends) - 1
    h1, h2, h3, h4 = struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, second = (int(ends[k]) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, code_points(text[:first]), code_points(text[first:second]), bytes(arranged(text, first, second, form))


def sent(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows whose last field is a text, in batches of ``SEND`` bytes."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(schema)], schema=schema)

    for row in rows:
        if held and size + len(row[-1]) > SEND:
            yield batch()
            held, size = [], 0
        held.append(row)
        size += len(row[-1])
    if held:
        yield batch()


def texts_of(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """Each text of a column as bytes; null is empty."""
    for x in column(batch, name).cast(pa.large_binary()):
        yield x.as_py() or b""


EXAMPLE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def filled_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars, output of each row of ``docs``. ``rate`` of 100 texts are rearranged, of these ``spm`` of
    100 in suffix-prefix-middle order; the draws come from ``seed`` and ``doc_id`` alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text"), strict=True):
                yield doc_id, *example(doc_id, text, seed, rate, spm)

    kinds = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select("doc_id", "text").mapInArrow(lambda batches: sent(rows(batches), EXAMPLE), kinds)


def restored(examples: DataFrame) -> DataFrame:
    """All columns of ``examples`` and ``restored``, the text rebuilt from ``output`` and ``form`` alone."""
    names = [c for c in examples.columns if c not in ("output", "restored")]
    schema = pa.schema([*((f.name, f.type) for f in EXAMPLE if f.name in names), ("output", pa.string()), ("restored", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            others = zip(*(batch.column(f.name).to_pylist() for f in list(schema)[:-2]), strict=True)
            for rest, form, output in zip(others, batch.column("form").to_pylist(), texts_of(batch, "output"), strict=True):
                yield *rest, output, rebuilt(output, form)

    kinds = ", ".join(f"{c} {examples.schema[c].dataType.simpleString()}" for c in [*names, "output"])
    return examples.select(*names, "output").mapInArrow(lambda batches: sent(rows(batches), schema), f"{kinds}, restored string")
