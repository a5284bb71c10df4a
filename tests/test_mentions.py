"""Aliases between word boundaries against a search for each."""

import random
import re

import pytest

from fundloom.operators import textjobs


def plain(docs, vocabulary):
    out = []
    for doc_id, text in docs:
        pos = {}
        for alias, canonical in sorted(vocabulary, key=lambda x: (-len(x[0]), x[0])):
            m = re.search(r"\b" + re.escape(alias) + r"\b", (text or "").lower()) if len(alias) >= 3 else None
            if m:
                pos.setdefault(canonical, m.start())
        out += [(doc_id, c, p) for c, p in pos.items()]
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [200_000, 3])
def test_mentions_against_search(spark, small):
    rnd = random.Random(4)
    words = ["at&t", "yahoo!", "j.p.", "morgan", "the", "of", "&", "--", "société", "générale", "x_y", "3m", "co", "u.s.", "bank", "(plc)"]
    phrase = lambda n: rnd.choice([" ", "  ", "-", "\n"]).join(rnd.choice(words) for _ in range(n))
    vocabulary = {(phrase(rnd.randint(1, 4)), rnd.randint(0, 30)) for _ in range(150)} | {("the " + phrase(10) + " bank", 77), ("the", 1), ("&&&", 2), ("co", 3), ("!!", 4), ("the bank of the u.s. & co -- morgan, the société générale of the yahoo!", 5)}
    docs = [(i, phrase(rnd.randint(0, 60)).title()) for i in range(120)] + [(900, None), (901, ""), (902, "a&&&b the"), (903, "THE Bank of the U.S. & Co -- Morgan, the Société Générale of the Yahoo!x"), (904, next(a for a, c in vocabulary if c == 77).upper())]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as w", "2 as alias", "'x' as parts")
    got = textjobs.detect_mentions(df, spark.createDataFrame(sorted(vocabulary), "alias string, canonical long"), small).collect()
    want = plain(docs, vocabulary)
    assert sorted(((r["doc_id"], r["canonical"], r["first_pos"]) for r in got), key=str) == want
    assert len(want) > 300 and {5, 77} <= {c for _, c, _ in want}
    assert textjobs.detect_mentions(df, spark.createDataFrame([], "alias string, canonical long")).count() == 0
