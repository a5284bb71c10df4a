import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fundloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, size):
    """Best fit, longest first, piece by piece: the number of sequences."""
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [(r, k) for k, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit)[1]] -= n
        else:
            room.append(size - n)
    return len(room)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit(seed):
    rnd = random.Random(seed)
    size = rnd.choice([16, 64, 100])
    lengths = [rnd.choice([rnd.randint(1, size), rnd.randint(1, 9), size // 3]) for _ in range(rnd.randint(1, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    held = defaultdict(list)
    for n, a, b, first, each, at in packing.best_fit_plan(counts, size):
        for r in range(a, b):
            held[first + (r - a) // each].append((at + (r - a) % each * n, n))
    assert sum(map(len, held.values())) == len(lengths)
    for x in held.values():
        x.sort()
        assert all(p[0] + p[1] == q[0] for p, q in zip(x, x[1:])) and x[0][0] == 0 and x[-1][0] + x[-1][1] <= size
    assert len(held) == one_by_one(lengths, size)


def test_packed(spark):
    rnd = random.Random(0)
    t = Tokenizer.from_file(PATH)
    odd = ["<|endoftext|> a<|endoftext|>b", "don't STOP\x1c x́ 1234 %%% été", "<|startoftext|>x Straße ÀÖÿ µm ªb º×÷ It's i'LL x'd' l.o.l ½ a1b2,,c''d ﬁ İI ǅ e\u0301 \u1e9e <|endoftext| |>", "日本語 テキスト", "a" * 3000, "", None, " \n", "é" * 40 + " " + "end"]
    texts = odd + [" ".join(rnd.choice(["Alpha", "beta,", "gamma's", "δ", "12"]) for _ in range(rnd.randint(1, 200))) for _ in range(120)]
    rows = [(i, x) for i, x in enumerate(texts)] + [(None, "x"), (3, texts[20]), (3, texts[20])]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as rank"), PATH, size=64, keep_ids=True).collect()
    docs, bins = defaultdict(dict), defaultdict(list)
    for r in got:
        docs[r["doc_id"]].setdefault(r["piece"], []).append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] and r["start"] == 64 * r["piece"]
    for i, x in enumerate(texts):
        if i != 3:
            ids = [k for p in sorted(docs[i]) for k in docs[i][p][0]["ids"]]
            assert ids == [*t.encode(x or "", add_special_tokens=False).ids, 0], x
    for x in bins.values():
        x.sort()
        assert x[0][0] == 0 and all(p[0] + p[1] == q[0] for p, q in zip(x, x[1:])) and sum(n for _, n in x) <= 64
    assert len(got) == sum(len(y) for x in docs.values() for y in x.values())
    assert len(bins) == one_by_one([r["length"] for r in got], 64)
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_cache_forgets(monkeypatch):
    monkeypatch.setattr(packing.ChunkIds, "MOST", 5)
    e, t = packing.ChunkIds(PATH), Tokenizer.from_file(PATH)
    for text in ("Éa ß. b-c d", "a b c d", "c d e f", "g h i j k l m n", "a"):
        assert e([c.encode() for c in text.split()])[0].tolist() == t.encode(text, add_special_tokens=False).ids
