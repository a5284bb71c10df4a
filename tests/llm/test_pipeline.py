"""The pipeline's stages on planted cases."""

import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from fundloom.llm.shared import table


def test_stages_take_effect(spark, tmp_path):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, toxic = [], []
    for i in range(400):
        t = text(60).split()
        if i % 4 == 0:
            for _ in range(5):
                t.insert(rnd.randrange(len(t)), rnd.choice(["zorgon", "quux", "frumious"]))
            toxic.append(i)
        rows.append((i, " ".join(t)))
    clean = [r for r in rows if r[0] not in set(toxic)]
    passage = text(12)
    rows += [(1000 + k, clean[k][1] + (" x" if k % 2 else "")) for k in range(5)]  # copies
    rows += [(2000, text(40) + " " + passage.upper() + " " + text(10)), (2001, None), (2002, ""), (2003, text(30) + " password=hunter2hunter2 " + text(5))]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in set(toxic))) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = table(spark, d, "documents")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, d)
        assert left.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in left.collect()}
    assert len(set(toxic) & set(kept)) <= 5 and len({i for i, _ in clean} - set(kept)) <= 5
    assert not {1000 + k for k in range(5)} & set(kept) and 2000 not in kept
    assert kept[2001] is None and kept[2002] == "" and "hunter2" not in kept[2003] and "[REDACTED]" in kept[2003]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"]: r["length"] for r in pieces} == {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in kept.items()}


def test_near_copies_from_four_fifths_up_go(spark, tmp_path):
    words = [f"w{i}" for i in range(104)]  # 100 shingles; 2 changed words apart take 10: 90 of 110 are common
    copy = [*words[:30], "x", *words[31:60], "y", *words[61:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy)), (3, "quite another text of some words")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()) == [1, 3]


def test_nulls_repeats_clashing_columns_and_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text + " x"), (None, text), (None, None), (3, None), (4, ""), (5, "token=abcdefgh12 and more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "1L as n_chars", "2 as component_id", "3 as hash", "4 as measure", "5 as start", "6 as w")
    docs.limit(0).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, d)
        assert left.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    assert kept == sorted([(1, text), (1, text), (None, text), (None, None), (3, None), (4, ""), (5, "[REDACTED] and more")], key=str)
    assert corpus_pipeline.pack(spark, left, d).count() == 7
    assert corpus_pipeline.run(spark, d).count() == 0
