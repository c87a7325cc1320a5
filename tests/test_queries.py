"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from quarryline.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def _rows(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.collect(), got.columns) == _rows(want.fetchall(), want.columns)


def test_flagship(spark):
    r = catalogue.flagship(spark, SF).collect()
    assert len(r) == 1 and r[0]["status"] == "ok" and r[0]["n_sources"] == len(r[0]["sources"])


def test_every_query_has_sql():
    """But for the approximate indexes, whose recall and reads test_scale.py holds to bounds."""
    assert set(catalogue.QUERIES) - set(catalogue.SQL) == {"ivf_topk_recall", "code_topk_recall", "graph_topk_recall"} and set(catalogue.SQL) <= set(catalogue.QUERIES)
