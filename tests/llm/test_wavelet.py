"""Wavelet-matrix shards against plain arrays, and the files read back against the tokenizer."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fundloom.llm import chunkids, queries, wavelet

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n,top", [(1, 1), (7, 2), (1000, 300), (5000, 49_408), (4097, 5)])
def test_rank_select_access(n, top, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 256)
    monkeypatch.setattr(wavelet, "KEPT", 3)
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n) - 1, top - 1).astype(np.uint32)
    raw = wavelet.packed_shard(ids, [None, 5], [1, n - 1])
    s = wavelet.Shard(lambda a, k: raw[a : a + k], len(raw))
    assert (s.ids() == ids).all() and s.doc_ids == [None, 5] and s.ends.tolist() == [1, n]
    places = rng.integers(0, n, 200)
    assert (s.access(places) == ids[places]).all()
    for token in [*np.unique(ids)[:20].tolist(), top, 10**6, -1]:
        assert s.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist()
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert s.count(token) == (ids == token).sum() and s.count(token, a, b) == (ids[a:b] == token).sum()
    with pytest.raises(ValueError):
        wavelet.Shard(lambda a, k: (raw[:-1] + b"x")[a : a + k], len(raw))


def rows():
    rnd = random.Random(3)
    words = ["Alpha", "beta,", "gamma's", "δ", "12", "été", "\n", "日本"]
    out = [(i * 3 % 200, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 80)))) for i in range(200)]
    return [*out, (None, "x y"), (None, None), (300, None), (301, ""), (302, " \n"), (5, "again"), (5, "again"), (303, "long " * 20_000)]


def test_shards_of_documents(spark):
    t = Tokenizer.from_file(PATH)
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(5).selectExpr("*", "1 as start", "'x' as uri", "2 as h")
    shards = wavelet.write_shards(df, PATH, shard_tokens=500)
    assert shards.count() > 10 and shards.agg({"documents": "sum"}).first()[0] == len(rows())
    got = sorted(wavelet.read_documents(shards, keep_ids=True).collect(), key=lambda r: r["start"])
    want = sorted(([*t.encode(x or "", add_special_tokens=False).ids, 1] for _, x in rows()))
    assert sorted(list(r["ids"]) for r in got) == want
    assert [(-1 if r["doc_id"] is None else r["doc_id"]) for r in got] == sorted(-1 if i is None else i for i, _ in rows())
    every, at = [], 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
        every += r["ids"]
    every = np.array(every)
    common = int(np.bincount(every).argmax())
    counts = {r["token"]: r["n"] for r in wavelet.token_counts(shards, [1, common, 49_000]).collect()}
    assert counts == {k: int((every == k).sum()) for k in (1, common, 49_000)}
    found = wavelet.occurrences(shards, common).collect()
    assert sorted(r["place"] for r in found) == np.flatnonzero(every == common).tolist()
    begins = {r["start"]: r["doc_id"] for r in got}
    assert all(begins[r["place"] - r["offset"]] == r["doc_id"] for r in found)
    asked = random.Random(1).sample(range(len(every)), 300)
    looked = wavelet.tokens_at(shards, spark.createDataFrame([(x,) for x in [*asked, -1, len(every)]], "place long"), bucket=300).collect()
    assert sorted((r["place"], r["token"]) for r in looked) == sorted((x, int(every[x])) for x in asked)


def test_empty_table(spark):
    shards = wavelet.write_shards(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert wavelet.read_documents(shards).count() == 0 and wavelet.occurrences(shards, 3).count() == 0


def test_query(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t, at = Tokenizer.from_file(PATH), 0
    got = queries.QUERIES["op12_token_ids"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows())
    texts = {i: x for i, x in rows()}
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
        if r["doc_id"] not in (None, 5):
            ids = [*t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_hashed_chunks_against_the_tokenizer(monkeypatch):
    t, rnd = Tokenizer.from_file(PATH), random.Random(2)
    odd = ["<|endoftext|> a<|endoftext|>b", "don't STOP\x1c x́ 1234 %%% été", "It's i'LL l.o.l ½ a1b2,,c''d ﬁ İI ẞ <|startoftext|>", "日本語 テキスト", "a" * 3000, "", None, " \n", "\x0b a\x0cb "]
    texts = odd + [" ".join("".join(rnd.choice("abcdeß,.") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(0, 300))) for _ in range(80)] + ["long text " * 3000]
    column = pa.array(texts, pa.large_string())
    for most, segment in ((2_000_000, 1 << 20), (50, 700)):
        monkeypatch.setattr(chunkids.HashedIds, "MOST", most)
        monkeypatch.setattr(chunkids, "SEGMENT", segment)
        e = chunkids.HashedIds(PATH)
        for part in (column, column.slice(4, 60), column):
            got = [x[:-1].tolist() for x in e.texts(part)]
            assert got == [t.encode(x or "", add_special_tokens=False).ids for x in part.to_pylist()]
        assert e.slots.n <= most


def test_slots():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 1 << 63, 5000).astype(np.uint64) << np.uint64(8) | np.uint64(1))  # low bits alike
    s = chunkids.Slots(4)
    for k in range(0, len(keys), 700):
        s.add(keys[k : k + 700], np.arange(k, min(k + 700, len(keys)), dtype=np.int32))
    assert (s.find(keys) == np.arange(len(keys))).all() and (s.find(keys + np.uint64(1)) == -1).all()
