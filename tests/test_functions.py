"""Scalar functions on hand-made rows: white space, tables, numbers, JSON, paths."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quarryline.functions import elements
from quarryline.functions import text as X


def _map(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_squeeze_is_pythons(spark):
    v = ["  A  b c\tLF\n d ", "", None, "x"]
    assert _map(spark, v, X.squeeze) == [None if x is None else " ".join(x.lower().split()) for x in v]


def test_slice_html(spark):
    v = ["<XBRL><?xml?><HTML><body>a</body></html></XBRL>", "  none  ", "<html>open", "<html>a</html> b </HTML> c"]
    assert _map(spark, v, X.slice_html) == ["<HTML><body>a</body></html>", "none", "<html>open", "<html>a</html> b </HTML>"]


def test_primary_document(spark):
    doc = lambda kind, body: f"<DOCUMENT>\n<TYPE>{kind}\n{body}\n</DOCUMENT>"
    text = lambda x: f"<TEXT><XBRL><html>{x}</html></XBRL></TEXT>"
    v = [doc("EX-99", text("no")) + doc("10-K", text("yes")), doc("10-K/A", text("no")), doc("10-K", "nothing"), ""]
    got = _map(spark, v, X.primary_document)
    assert [(r["html"], r["status"]) for r in got] == [("<html>yes</html>", "ok"), (None, "no_document"), (None, "no_text"), (None, "no_document")]


def test_item_section(spark):
    v = ["Item 1A. Risk", "ITEM 7 — MD&A", "item 8 : F", "PART I", "Item 99. x", "see Item 7. there", None]
    assert _map(spark, v, X.item_section) == ["risk_factors", "mdna", "financials", None, None, None, None]


def test_header_and_paths(spark):
    got = _map(spark, ["CONFORMED SUBMISSION TYPE:\t10-K\nCONFORMED PERIOD OF REPORT:\t20240131\n", "CONFORMED SUBMISSION TYPE: 10-K\n", ""], X.header_fields)
    assert [tuple(r) for r in got] == [("10-K", "20240131", 2024, "ok"), ("10-K", None, None, "missing_period_of_report"), (None, None, None, "missing_submission_type")]
    path = "/d/sec-edgar-filings/BRK-B/10-K/0000000000-24-000001/full-submission.txt"
    assert _map(spark, [path, "/x"], X.ticker_from_path) == ["BRK-B", None]
    assert _map(spark, [path], X.accession_from_path) == ["0000000000-24-000001"]
    assert _map(spark, ["0000000000-24-000001", "x"], X.valid_accession) == [True, False]
    assert _map(spark, [" brk.b ", "BRK/B", "Apple"], X.normalize_ticker) == ["BRK-B", "BRK-B", "APPLE"]


def test_fences(spark):
    assert _map(spark, ['```json\n{"a": 1}\n```', "{}", "``` \nx", "a ``` b"], X.strip_fences) == ['{"a": 1}', "{}", "x", "a ``` b"]


SCALE = {"thousand": 1e3, "million": 1e6, "billion": 1e9, "trillion": 1e12}


def _numbers(text):
    out = []
    for m in re.finditer(r"\d[\d,]*\.?\d*", text or ""):
        if re.match("10-[KQ]", text[m.start() : m.start() + 4]):
            continue
        tail = re.match(r"\s{0,11}(thousand|million|billion|trillion)", text[m.end() :].lower())
        out.append(float(m[0].replace(",", "")) * (SCALE[tail[1]] if tail else 1))
    return out


def test_numbers(spark):
    v = ["$(14,131) million", "$4.8B", "10-K of 2023", "3", "", None, "1.5 billion and 2 millions, 10-Q"]
    assert _map(spark, v, X.extract_numbers) == [_numbers(x) for x in v]


@pytest.mark.parametrize(("expected", "actual", "want"), [("$10 million", "about 10.05 million", True), ("100", "102", False), ("none", "1", False), ("0", "0.0", True), ("5", "", False)])
def test_numeric_match(spark, expected, actual, want):
    df = spark.createDataFrame([(expected, actual)], "e string, a string")
    assert df.select(X.numeric_match("e", "a")).first()[0] is want


def test_parse_action(spark):
    v = ['{"action_code": "lookup"}', '```json\n{"action_code": "compute"}\n```', "", '{"action', "[1]", "{}", '{"action_code": "dance"}', "{bad}", None]
    got = [(r["code"], r["status"]) for r in _map(spark, v, X.parse_action)]
    assert got == [("lookup", "ok"), ("compute", "ok"), (None, "empty"), (None, "invalid_json"), (None, "invalid_json"), (None, "missing_key"), (None, "out_of_taxonomy"), (None, "invalid_json"), (None, "empty")]


def test_first_filled(spark):
    df = spark.createDataFrame([("", None, "q"), ("f", "c", "q"), (None, "c", "q")], "a string, b string, q string")
    assert [r[0] for r in df.select(X.first_filled("a", "b", "q")).collect()] == ["q", "f", "c"]


def test_filters_are_whitelisted():
    with pytest.raises(ValueError, match="unknown"):
        X.equals_all({"a; drop": 1}, ("a",))


def test_elements():
    page = "<h2>Item 1A. Risk</h2><p>One &amp; two</p><p><b>Sub</b></p><table><tr><td>a</td><td>b</td></tr><tr><td>1</td></tr></table><script>x</script>tail"
    assert elements.elements(page) == [("TopSectionTitle", "Item 1A. Risk"), ("Text", "One & two"), ("Title", "Sub"), ("Table", "| a | b |\n| --- | --- |\n| 1 |  |"), ("Text", "tail")]
    assert elements.elements(None) == []
