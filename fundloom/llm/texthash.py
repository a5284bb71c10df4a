"""64-bit hashes of words and shingles of many texts at once, straight from an Arrow text column.

Words are runs without the six ASCII white-space characters, A-Z lowered. A word's hash is a polynomial of its bytes,
taken from running sums over the buffer, then mixed; null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For words without punctuation: all of ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
SEGMENT = 1 << 20
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (splitmix64's output step)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, SEGMENT + 1), base, U)
        p[0] = 1
        _powers[base] = np.multiply.accumulate(p)
    return _powers[base]


def hash_words(data: np.ndarray, starts: np.ndarray, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """data: lowered bytes; starts: where each text starts, then the end. Hashes, and each text's first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(starts), np.int64)
    space = between[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    inner = starts[(starts > 0) & (starts < n)]
    first[inner] = ~space[inner]
    last[inner - 1] = ~space[inner - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    upto = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(FACTOR, n)[:n], out=upto[1:])
    return mixed((upto[b] - upto[a]) * powers(INVERSE, n)[a]), np.searchsorted(a, starts)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    found = batch.column(name)
    return found.cast(pa.large_string()) if found.type != pa.large_string() else found


def hashed_texts(texts: pa.Array, between: np.ndarray = IS_SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the first text, word hashes, first word of each text and the end) for runs of texts of about a segment;
    a longer text stands alone and is hashed in segments cut at white space."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2] if len(texts) else None
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SEGMENT, "right")) - 1)
        a, z = int(offsets[row]), int(offsets[to])
        data = np.frombuffer(bytes(body[a:z]).translate(LOWER), np.uint8) if z > a else np.zeros(0, np.uint8)
        starts = offsets[row : to + 1] - a
        if len(data) <= 2 * SEGMENT:
            yield row, *hash_words(data, starts, between)
        else:
            found, at = [], 0
            while at < len(data):
                stop = min(at + SEGMENT, len(data))
                while stop < len(data) and not between[data[stop]]:
                    stop += 1
                found.append(hash_words(data[at:stop], np.array([0, stop - at]), between)[0])
                at = stop
            every = np.concatenate(found)
            yield row, every, np.array([0, len(every)])
        row = to


WEIGHTS = mixed(np.arange(1, 65, dtype=U))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order; with fewer words, of the whole sequence; none without words."""
    k = min(n, len(words))
    if not k:
        return words
    out = np.full(len(words) - k + 1, k, U)
    for j in range(k):
        out += words[j : len(words) - k + 1 + j] * WEIGHTS[j]
    return mixed(out)
