"""Packing against its recurrence, sections, ingest by delta."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.operators import chunking, ingest


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40))
def test_bounds_keep_units(sizes):
    target, overlap = 48, 8
    out = chunking.pack_bounds(sizes, target, overlap)
    assert sorted({i for a, b in out for i in range(a, b)}) == list(range(len(sizes)))
    for a, b in out:
        assert b - a == 1 or sum(sizes[a:b]) <= target
    for (a, b), (c, d) in zip(out, out[1:], strict=False):
        assert sum(sizes[c:b]) <= overlap and a <= c and b <= d


def test_standing_alone():
    assert chunking.pack_bounds([5, 45, 3, 3], 48, 8) == [(0, 1), (1, 2), (2, 4)]
    assert chunking.pack_bounds([], 48, 8) == []
    assert chunking.pack_bounds([30, 6, 20], 48, 8) == [(0, 2), (1, 3)]


def test_long_units():
    assert chunking.split_long("a b c. d e f g h. i", 4) == ["a b c.", "d e f g", "h.", "i"]
    assert [x[2] for x in chunking.pack("one two\n\n\n\n three ", target=10, overlap=2)] == ["one two\n\nthree"]


def test_chunk_records(spark):
    df = spark.createDataFrame([("s", "table", "big " * 99), ("s", "narrative", "x y\n\nz"), ("s", "narrative", None), ("s", "narrative", "")], "section string, content_type string, text string")
    got = chunking.chunk_records(df, target=10, overlap=2).select("content_type", "chunk_index", "n_tokens").collect()
    assert sorted(map(tuple, got)) == [("narrative", 0, 3), ("table", 0, 99)]


def test_sections(spark):
    rows = [("a", 0, "Text", "before"), ("a", 1, "TopSectionTitle", "Item 1. B"), ("a", 2, "Text", "one"), ("a", 3, "Table", "| t |"), ("a", 4, "Text", "Item 7. not a title"), ("a", 5, "Title", "sub"), ("a", 6, "TopSectionTitle", "Item 7 — M"), ("a", 7, "Text", "two"), ("a", 8, "TopSectionTitle", "Item 1. B"), ("a", 9, "Text", "three")]
    df = spark.createDataFrame(rows, "accession_number string, pos int, type string, element_text string")
    got = ingest.section_records(df, ("accession_number",)).orderBy("record_pos").select("section", "content_type", "text").collect()
    assert [tuple(r) for r in got] == [(None, "narrative", "before"), ("business", "table", "| t |"), ("business", "narrative", "one\n\nItem 7. not a title"), ("mdna", "narrative", "two"), ("business", "narrative", "three")]


def _filing(root, ticker, accession, text):
    d = root / "sec-edgar-filings" / ticker / "10-K" / accession
    d.mkdir(parents=True)
    (d / "full-submission.txt").write_text(text)


def _annual(body):
    return f"CONFORMED SUBMISSION TYPE:\t10-K\nCONFORMED PERIOD OF REPORT:\t20240131\n<DOCUMENT>\n<TYPE>10-K\n<TEXT>{body}</TEXT>\n</DOCUMENT>"


def test_delta(spark, tmp_path):
    root, corpus = tmp_path / "in", str(tmp_path / "corpus")
    _filing(root, "AAA", "0000000000-24-000001", _annual("<html><h2>Item 1. Business</h2><p>text one</p></html>"))
    _filing(root, "BBB", "0000000000-24-000002", _annual("<html><p>text two</p></html>"))
    assert ingest.chunk_corpus(spark, str(root), corpus) == {"processed": 2, "skipped": 0, "errors": 0}
    assert ingest.chunk_corpus(spark, str(root), corpus) == {"processed": 0, "skipped": 2, "errors": 0}
    _filing(root, "CCC", "0000000000-24-000003", _annual("<html><p>three</p></html>"))
    _filing(root, "DDD", "0000000000-24-000004", "nothing")
    assert ingest.chunk_corpus(spark, str(root), corpus) == {"processed": 1, "skipped": 2, "errors": 1}
    got = spark.read.parquet(corpus).orderBy("ticker").select("ticker", "section", "fiscal_year", "text").collect()
    assert [tuple(r) for r in got] == [("AAA", "business", 2024, "text one"), ("BBB", None, 2024, "text two"), ("CCC", None, 2024, "three")]
