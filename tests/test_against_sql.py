"""Queries against their SQL on rows that the test tables lack at the small scales."""

import os
from collections import Counter

import duckdb
import pytest

from fundloom import registry

SMALL = "/root/testdata/sf0.001"


def both(spark, folder, name, tables):
    """Rows of a query and of its SQL over the smallest tables, some of them replaced."""
    folder.mkdir(exist_ok=True)
    for f in os.listdir(SMALL):
        if f[:-8] not in tables:
            (folder / f).symlink_to(f"{SMALL}/{f}")
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(folder / f"{table}.parquet"))
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f[:-8]} as select * from '{folder}/{f}{'/*.parquet' if f[:-8] in tables else ''}'")
    want = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    return Counter(tuple(r[c] for c in columns) for r in registry.QUERIES[name](spark, str(folder)).collect()), Counter(want.fetchall())


def test_words_end_at_any_letter(spark, tmp_path):
    said = ["él dijo", "el dijo", "qué", "dijo que", "ñlos", "the", "The,", "other", "dassé", "das", "là", "le", "lé", "la_", None, ""]
    got, want = both(spark, tmp_path / "x", "tag_intent", {"conversations": ([(k, 0, "user", t) for k, t in enumerate(said)], "conv_id long, turn int, role string, text string")})
    assert got == want
    assert [r[2] for r in sorted(got)] == ["open", "spanish", "open", "spanish", "open", "english", "english", "open", "open", "german", "open", "french", "open", "open", "open", "open"]


def test_a_page_is_typed_by_its_name_too(spark, tmp_path):
    html = ["<html><p>none</p></html>", "<html><p>10-K</p></html>", "plain <b> text", None, "<html></html>"]
    rows = [(base + k, "u", h) for base in (100, 1497, 4970) for k, h in enumerate(html)]
    got, want = both(spark, tmp_path / "x", "scan_documents", {"pages": (rows, "page_id long, url string, html string")})
    assert got == want
    assert Counter(t for _, t, *_ in got.elements()) == {"text": 3, "10-K": 3, "497": 3}
