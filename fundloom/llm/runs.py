"""Periodic runs of words by recompression.

The words of many texts, as numbers with a number of its own between texts, are compressed in alternate rounds: a
block round replaces each stretch of one symbol by a symbol for (symbol, how often); a pair round splits the symbols in two
halves by a hash and replaces each neighbouring pair of a left and a right symbol. Equal stretches are parsed alike but for a few symbols
at their ends, and each round leaves about three quarters of the symbols, so the run-length grammar has a logarithmic number of levels and linear size.

Longest common extensions, forwards and backwards, are read from the grammar: two places climb while they stand at
the start of equal parents, and from the first difference go down again; a level costs a few steps, a block of
equal symbols one. Nothing else is built: no suffix array, no comparison of words one by one.

Candidates lie on a harmonic grid: a run of period p and of 2 p and ``least`` words has at least s = max(p, least - p) places that equal the
one p further, so one of them is a multiple of s; all multiples give n/s pairs of places for p, n log n in all. A pair's two extensions give the exact
ends of its stretch of period p. If that has a smaller period too it is found with the same ends, so of equal ends the least period stays.

Nulls and edge cases: a null text has no words; an empty text or one of fewer than ``least`` words has no run; rows with a null
``doc_id`` and rows that repeat one are worked on by themselves; a text of one word over and over is one run of period 1; overlapping runs of
different periods are all reported; an empty table gives an empty result; other columns are ignored. A task holds the
grammar of ``GATHER`` words or of one text, and candidates in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundloom.llm.fim import texts_of
from fundloom.llm.shared import let, words_of
from fundloom.llm.texthash import mixed

#: Words whose grammar is built together, and candidates that are looked at together.
GATHER, BLOCK = 1 << 18, 1 << 20


class Level:
    """Symbols of one round. ``parent``: each symbol's place one level up, ``child``: where each symbol's children start one level down."""

    def __init__(self, symbols: np.ndarray, child: np.ndarray | None):
        self.symbols, self.child = symbols, child
        self.parent = self.first = self.last = None
        self.blocks = False

    def raised(self, first: np.ndarray, blocks: bool) -> np.ndarray:
        """Note which symbols start a parent; where the parents' children start, and the end."""
        self.first, self.blocks = first, blocks
        self.parent = np.cumsum(first, dtype=np.int32) - 1
        self.last = np.concatenate([first[1:], [True]])
        return np.concatenate([np.flatnonzero(first), [len(first)]]).astype(np.int32)


def renamed(keys: np.ndarray, known: int) -> tuple[np.ndarray, int]:
    """Numbers from ``known`` on, equal for equal keys; how many numbers there are then."""
    names, at = np.unique(keys, return_inverse=True)
    return (at + known).astype(np.int32), known + len(names)


def grammar(words: np.ndarray) -> list[Level]:
    """Levels of the run-length grammar of ``words``, the words themselves first, until no symbol occurs twice."""
    levels, known, turn = [Level(words.astype(np.int32), None)], int(words.max()) + 1, 0
    while True:
        low = levels[-1]
        s = low.symbols
        first = np.ones(len(s), bool)
        if turn % 2 == 0:
            seen = np.zeros(known, bool)
            seen[s] = True
            if seen.sum() == len(s):
                return levels
            first[1:] = s[1:] != s[:-1]
            starts = low.raised(first, True)
            up, times = s[starts[:-1]], np.diff(starts)
            more = np.flatnonzero(times > 1)
            new = up.copy()
            new[more], known = renamed(up[more].astype(np.int64) << 32 | times[more], known)
        else:
            right = (mixed(s.astype(np.uint64) + np.uint64(turn << 40)) & np.uint64(1)).astype(bool)
            first[1:] = right[:-1] | ~right[1:]
            starts = low.raised(first, False)
            new = s[starts[:-1]].copy()
            pairs = np.flatnonzero(np.diff(starts) == 2)
            new[pairs], known = renamed(new[pairs].astype(np.int64) << 32 | s[starts[pairs] + 1], known)
        levels.append(Level(new, starts))
        turn += 1


def extended(levels: list[Level], x: np.ndarray, y: np.ndarray, way: int) -> np.ndarray:
    """How many words from ``x`` and ``y`` on agree, forwards (``way`` 1) or backwards (-1), both given places included. x <> y, and the
    words end on either side in a word that is nowhere else."""
    x0 = x
    x, y, level = x.astype(np.int64), y.astype(np.int64), np.zeros(len(x), np.int64)
    stopped = np.zeros(len(x), bool)
    # Up: each level's pairs step on until both stand at an end of a parent, or differ.
    for r, low in enumerate(levels):
        at = np.flatnonzero(~stopped & (level == r))
        top = low.parent is None
        while len(at):
            a, b = x[at], y[at]
            if not top:
                edge = low.first if way > 0 else low.last
                up = edge[a] & edge[b]
                going = at[up]
                x[going], y[going], level[going] = low.parent[a[up]], low.parent[b[up]], r + 1
                at, a, b = at[~up], a[~up], b[~up]
            same = low.symbols[a] == low.symbols[b]
            stopped[at[~same]] = True
            at, a, b = at[same], a[same], b[same]
            step = way * steps(levels, r, a, b, way)
            x[at], y[at] = a + step, b + step
    # Down: from the level of the difference to the words, on over what still agrees.
    for r in range(len(levels) - 1, -1, -1):
        at = np.flatnonzero(level == r)
        while len(at):
            a, b = x[at], y[at]
            same = levels[r].symbols[a] == levels[r].symbols[b]
            done = at[~same]
            if r:
                child = levels[r].child
                x[done], y[done] = (child[x[done]], child[y[done]]) if way > 0 else (child[x[done] + 1] - 1, child[y[done] + 1] - 1)
                level[done] = r - 1
            at, a, b = at[same], a[same], b[same]
            step = way * steps(levels, r, a, b, way)
            x[at], y[at] = a + step, b + step
    return way * (x - x0)


def steps(levels: list[Level], r: int, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray | int:
    """How far equal symbols can be passed at once: in a level of blocks to the nearer end of the two blocks."""
    low = levels[r]
    if not low.blocks:
        return 1
    starts = levels[r + 1].child
    if way > 0:
        return np.minimum(starts[low.parent[a] + 1] - a, starts[low.parent[b] + 1] - b)
    return np.minimum(a - starts[low.parent[a]], b - starts[low.parent[b]]) + 1


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``counts`` of things: which one each belongs to, and its number there."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def grid(starts: np.ndarray, sizes: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the candidates of texts that start at ``starts`` with ``sizes`` words, in blocks."""
    owner, k = spread(np.where(sizes >= least, sizes // 2, 0))
    period = k + 1
    step = np.maximum(period, least - period)
    many = (sizes[owner] - 1 - period) // step + 1
    upto = np.cumsum(many)
    a = 0
    while a < len(owner):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + BLOCK, "right")))
        which, m = spread(many[a:b])
        yield starts[owner[a:b]][which] + m * step[a:b][which], period[a:b][which]
        a = b


def runs_in(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """start, end, period (three rows) of all runs, by start, then period. ``words``: the texts, with a number of its own before each and after the last."""
    levels, found = None, []
    for i, p in grid(starts, sizes, least):
        may = words[i] == words[i + p]
        i, p = i[may], p[may]
        if len(i):
            levels = levels or grammar(words)
            end = i + p + extended(levels, i, i + p, 1)
            start = i + 1 - extended(levels, i, i + p, -1)
            good = end - start >= np.maximum(2 * p, least)
            found.append(np.unique(np.stack([start[good], end[good], p[good]]), axis=1))
    if not found:
        return np.zeros((3, 0), np.int64)
    every = np.unique(np.concatenate(found, axis=1), axis=1)
    new = np.ones(every.shape[1], bool)
    new[1:] = (every[:2, 1:] != every[:2, :-1]).any(axis=0)
    every = every[:, new]
    return every[:, np.lexsort((every[2], every[0]))]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and words of texts, ``GATHER`` words at a time; a longer text by itself."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text"), strict=True):
            words = text.split()
            if ids and held + len(words) > GATHER:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(doc_id)
            texts.append(words)
            held += len(words)
    if ids:
        yield ids, texts


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])


def finder(least: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in gathered(batches):
            numbers: dict[bytes, int] = {}
            sizes = np.array([len(t) for t in texts], np.int64)
            starts = 1 + np.cumsum(sizes + 1) - (sizes + 1)
            words = np.zeros(int(sizes.sum()) + len(texts) + 1, np.int64)
            for a, t in zip(starts, texts, strict=True):
                words[a : a + len(t)] = [numbers.setdefault(w, len(numbers)) for w in t]
            between = np.concatenate([starts - 1, [len(words) - 1]])
            words[between] = len(numbers) + np.arange(len(between))
            start, end, period = runs_in(words, starts, sizes, least)
            # Words after a run's first period, of any run, are dropped.
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, start + period, 1)
            np.add.at(edges, end, -1)
            kept = np.cumsum(edges) == 0
            owner = np.searchsorted(starts, start, "right") - 1
            bounds = np.searchsorted(owner, np.arange(len(ids) + 1))
            place = start - starts[owner]
            runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in (place, end - start, period)], fields=list(RUN)))
            collapsed = []
            for k, (a, t) in enumerate(zip(starts.tolist(), texts, strict=True)):
                whole = bounds[k] == bounds[k + 1]
                collapsed.append(b" ".join(t if whole else [w for w, keep in zip(t, kept[a : a + len(t)].tolist(), strict=True) if keep]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), runs, pa.array(collapsed, pa.binary()).cast(pa.string())], schema=FOUND)

    return find


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start, then period) and collapsed, the text with each run cut to its first period, for each row
    of ``docs``. A run has ``least`` words and two periods at least and can't be extended."""
    return docs.select("doc_id", "text").mapInArrow(finder(least), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in one document of ten by a checksum of its id, the words from some place on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def planted(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return let(F.struct(a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(w, lambda said, i: F.when(i < x["a"], said).otherwise(F.get(w, (x["a"] + F.pmod(i - x["a"], x["p"])).cast("int")))), " "))

    text = F.when((h % 10 == 0) & (F.size(words_of(F.col("text"))) > 0), let(words_of(F.col("text")), planted)).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run with its exponent, and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return told.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
