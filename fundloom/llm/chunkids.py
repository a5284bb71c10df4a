"""Token ids of many texts at once: chunks between white space are hashed where they lie and looked up in a table of arrays.

A tokenizer that drops white space never joins across it, so a text's ids are those of its chunks. A chunk is known by a 64-bit hash of its bytes and
length; its ids are computed once and kept, ``MOST`` chunks at most in some 40 bytes each, and later ones are computed whenever they come. Null and empty texts
have no chunks. Texts are taken in segments, long ones cut at white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from fundloom.llm.packing import ChunkIds
from fundloom.llm.texthash import IS_SPACE, SEGMENT, U, hash_words, mixed


class Slots:
    """Keys (64 bits, not 0) to numbers, by open addressing over arrays."""

    def __init__(self, bits: int = 16):
        self.n, self.keys, self.values = 0, np.zeros(1 << bits, U), np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for those that aren't there."""
        mask, out = U(len(self.keys) - 1), np.full(len(keys), -1, np.int64)
        at, todo = (keys & mask).astype(np.int64), np.arange(len(keys))
        while len(todo):
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (held != 0)
            at, todo = (at[on] + 1) & int(mask), todo[on]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that aren't there, each once."""
        while 2 * (self.n + len(keys)) > len(self.keys):
            old, held = (self.keys, self.values), self.keys != 0
            self.n, self.keys, self.values = 0, np.zeros(2 * len(old[0]), U), np.zeros(2 * len(old[0]), np.int32)
            self.add(old[0][held], old[1][held])
        self.n += len(keys)
        at = (keys & U(len(self.keys) - 1)).astype(np.int64)
        while len(keys):
            free = np.flatnonzero(self.keys[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            mine = free[first]
            self.keys[at[mine]], self.values[at[mine]] = keys[mine], values[mine]
            left = np.ones(len(keys), bool)
            left[mine] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) & (len(self.keys) - 1)


class HashedIds:
    MOST = 2_000_000

    def __init__(self, path: str):
        self.encode = ChunkIds(path)
        self.encode.MOST = 300_000
        self.slots, self.n, self.used = Slots(), 0, 0
        self.starts, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 17, np.uint16 if self.encode.tokenizer.get_vocab_size() < 1 << 16 else np.uint32)

    def kept(self, name: str, n: int) -> np.ndarray:
        """An array of room for ``n``, what it held still there."""
        held = getattr(self, name)
        if n > len(held):
            more = np.zeros(max(n, len(held) * 3 // 2), held.dtype)
            more[: len(held)] = held
            setattr(self, name, more)
        return getattr(self, name)

    def append(self, ids: list[list[int]]) -> np.ndarray:
        """Numbers of new entries for lists of ids."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        stops = self.used + np.cumsum(sizes)
        self.kept("flat", int(stops[-1]))[self.used : stops[-1]] = np.fromiter((k for x in ids for k in x), np.int64, int(sizes.sum()))
        self.kept("starts", self.n + len(ids) + 1)[self.n + 1 : self.n + len(ids) + 1] = stops
        numbers = np.arange(self.n, self.n + len(ids))
        self.n, self.used = self.n + len(ids), int(stops[-1])
        return numbers

    def segment(self, data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after the other in ``data`` from ``starts`` (and the end) on, and where each text's ids start and the last end."""
        raw = np.frombuffer(data, np.uint8)
        hashes, first = hash_words(raw, starts)
        space = IS_SPACE[raw]
        begin, end = ~space, ~space
        begin[1:] &= space[:-1]
        end[:-1] &= space[1:]
        inner = starts[(starts > 0) & (starts < len(raw))]
        begin[inner], end[inner - 1] = ~space[inner], ~space[inner - 1]
        a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
        keys = mixed(hashes ^ (b - a).astype(U) * U(0x9FB21C651E98DF25)) | U(1)
        at, before = self.slots.find(keys), (self.n, self.used)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, one, which = np.unique(keys[missing], return_index=True, return_inverse=True)
            numbers = self.append([self.encode.chunk(data[a[k] : b[k]]) for k in missing[one].tolist()])
            at[missing] = numbers[which]
        sizes = self.starts[at + 1] - self.starts[at]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(stops[-1]) + np.repeat(self.starts[at] - stops[:-1], sizes)]
        if len(missing):
            if self.slots.n + len(new) <= self.MOST:
                self.slots.add(new, numbers.astype(np.int32))
            else:  # room for these is used again
                self.n, self.used = before
        return ids, stops[first]

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a large string column, with room for one more at the end."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        row = 0
        while row < len(texts):
            to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SEGMENT, "right")) - 1)
            data = bytes(texts.buffers()[2][int(offsets[row]) : int(offsets[to])]) if offsets[to] > offsets[row] else b""
            if len(data) <= 2 * SEGMENT:
                ids, at = self.segment(data, offsets[row : to + 1] - offsets[row])
            else:
                parts, k = [], 0
                while k < len(data):
                    stop = min(k + SEGMENT, len(data))
                    while stop < len(data) and not IS_SPACE[data[stop]]:
                        stop += 1
                    parts.append(self.segment(data[k:stop], np.array([0, stop - k]))[0])
                    k = stop
                ids = np.concatenate(parts)
                at = np.array([0, len(ids)])
            for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = np.empty(z - a + 1, np.uint32)
                own[:-1] = ids[a:z]
                yield own
            row = to


@lru_cache(maxsize=1)
def encoder(path: str) -> HashedIds:
    """One a Python worker: what it knows of chunks goes from task to task."""
    return HashedIds(path)
