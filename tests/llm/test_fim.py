"""Rotated examples against plain joining of the parts, and exact round trips."""

import hashlib
import random
import re

import pytest

from fundloom.llm import fim, queries


def plain(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rnd = random.Random(4)
    out = [None, "", "\n", "\n\n\n", "no end", "a\nb", "has <P> in\nit", "<S", "<\n<S\n>P>\n<", "<M\n>", "é日本\n\r\nx y\x0b\n", "long " * 60_000 + "\nend"]
    return out + ["".join(rnd.choice(["a", "é", "𝄞", "\n", "<", "S>", "P", ">"]) for _ in range(rnd.randint(0, 40))) for _ in range(400)]


@pytest.mark.parametrize("seed,rate,spm", [(7, 100, 50), (3, 60, 0), (5, 90, 100)])
def test_examples_and_round_trip(spark, seed, rate, spm, monkeypatch):
    monkeypatch.setattr(fim, "SEND", 100)
    rows = list(enumerate(texts())) + [(None, "a\nb\n"), (3, "x\ny"), (3, "x\ny")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as output", "'y' as form", "2 as restored")
    got = fim.restored(fim.filled_in_middle(df, seed, rate, spm)).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["restored"]) for r in got) == sorted((-1 if i is None else i, t or "") for i, t in rows)
    told = sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")) for r in got), key=str)
    assert told == sorted(((i, *plain(i, t, seed, rate, spm)) for i, t in rows), key=str)
    assert fim.restored(fim.filled_in_middle(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_rotation_in_place():
    rnd = random.Random(1)
    for _ in range(300):
        b = bytearray(rnd.randbytes(rnd.randint(0, 30)))
        a, mid, z = sorted(rnd.randint(0, len(b)) for _ in range(3))
        want = b[:a] + b[mid:z] + b[a:mid] + b[z:]
        fim.rotate(b, a, mid, z)
        assert b == want


def test_query(spark, tmp_path):
    rows = list(enumerate(texts()))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_fill_in_middle"](spark, str(tmp_path)).collect()}
    for i, t in rows:
        n, form, p, m, out = plain(i, t)
        assert tuple(got[i][c] for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")) == (n, form, p, m, sha(out), sha(t or ""))
