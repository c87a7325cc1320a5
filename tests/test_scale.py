"""Numbering, lexical search, joins over time, sketches, the neighbour graph and data sources against plain versions."""

from __future__ import annotations

import datetime as dt
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.operators import graph, lexical, numbering, sketches, temporal
from quarryline.plans import catalogue
from quarryline.sources import datasource
from quarryline.streaming import sessions

# --- numbering -------------------------------------------------------------------------------


def test_number_rows(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "a", "a", "a", "b"]), r.choice([None, 1, 2, 2, 2, r.randrange(50)])) for _ in range(400)] + [("a", 2)] * 200
    got = numbering.number_rows(spark.createDataFrame(rows, "g string, v int").repartition(6), ["v"], "g").collect()
    assert Counter((x["g"], x["v"]) for x in got) == Counter(rows)
    for g in {x[0] for x in rows}:
        own = sorted((x["pos"], x["v"]) for x in got if x["g"] == g)
        assert [p for p, _ in own] == list(range(len(own))) and all(x["n"] == len(own) for x in got if x["g"] == g)
        values = [(v is not None, v or 0) for _, v in own]
        assert values == sorted(values)
    empty = numbering.number_rows(spark.createDataFrame([], "g string, v int"), ["v"], "g")
    assert empty.count() == 0


def test_zip_rows(spark):
    a = spark.createDataFrame([(i, str(i)) for i in range(300)], "x int, s string").repartition(5)
    b = spark.createDataFrame([(i * 2,) for i in range(300)], "y int").repartition(3)
    assert all(r["y"] == 2 * r["x"] == 2 * r["pos"] for r in numbering.zip_rows(a, b, ["x"], ["y"]).collect())
    with pytest.raises(ValueError, match="300 rows on the left and 299"):
        numbering.zip_rows(a, b.filter("y > 0"), ["x"], ["y"])


# --- BM25 ------------------------------------------------------------------------------------


def _bm25(docs, queries, k):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    rows = [(d, Counter(words(t))) for d, t in docs]
    mean = sum(c.total() for _, c in rows) / len(rows)
    df = Counter(w for _, c in rows for w in c)
    out = []
    for q, text in queries:
        hits = []
        for d, c in rows:
            score = 0
            for w in set(words(text)) & set(c):
                idf = math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5))
                score += math.floor(idf * (c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean))) * 1_000_000 + 0.5)
            if score:
                hits.append((-score, d))
        out += [(q, d, -s / 1_000_000, i + 1) for i, (s, d) in enumerate(sorted(hits)[:k])]
    return sorted(out)


@pytest.mark.parametrize("near", [False, True])
def test_bm25_is_exact_with_skipped_ranges(spark, monkeypatch, near):
    """Small ranges and stripes; in the second case topics lie together, so that most ranges are skipped."""
    monkeypatch.setattr(lexical, "RANGE", 4)
    monkeypatch.setattr(lexical, "STRIPE", 3)
    r = random.Random(2)
    topic = lambda i: f"t{i // 10 if near else r.randrange(12)}w"
    docs = [(i, " ".join(["the", *(topic(i) + str(r.randrange(6)) for _ in range(r.randrange(1, 30)))])) for i in range(120)]
    docs += [(120, None), (121, ""), (122, "Émile, ÉMILE 3x"), (123, docs[5][1]), (124, docs[5][1])]
    queries = [(q, t) for q, t in docs if q % 20 == 0] + [(122, "émile"), (7, "nothing known"), (8, None)]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = spark.createDataFrame(queries, "query_id long, text string")
    got = sorted(tuple(x) for x in lexical.bm25_search(index, asked, 5).select("query_id", "doc_id", "score", "rank").collect())
    assert got == _bm25(docs, queries, 5)
    if near:
        terms = lexical.query_terms(index, asked)
        bounds = lexical.range_bounds(index, terms).filter("query_id = 20").orderBy(F.desc("bound")).collect()
        tenth = min(x[2] for x in got if x[0] == 20) * 1_000_000
        assert sum(b["bound"] >= tenth for b in bounds) < len(bounds) / 2


def test_index_is_kept(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 3} text") for i in range(9)], "doc_id long, text string")
    lexical.build_index(docs).save(str(tmp_path / "i"))
    asked = spark.createDataFrame([(0, "word1")], "query_id long, text string")
    hits = lexical.bm25_search(lexical.Index.load(spark, str(tmp_path / "i")), asked, 10).collect()
    assert [h["doc_id"] for h in hits] == [1, 4, 7]


def test_fused_ranks(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(0, 2, 1), (0, 3, 2)], "query_id long, doc_id long, rank int")
    got = lexical.fuse_ranks([a, b], 2).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(2, round(1 / 62 + 1 / 61, 9)), (1, round(1 / 61, 9))]


# --- joins over time -------------------------------------------------------------------------


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("width,keyed", [(None, False), (7, True)])
def test_overlap_join(spark, width, keyed):
    r = random.Random(3)

    def rows(n):
        out = []
        for i in range(n):
            s = r.choice([5, r.randrange(-500, 1000), r.randrange(1000)])
            e = s + r.choice([0, 1, 3, r.randrange(40), r.randrange(5000), -1])
            out.append((i, r.choice([None, s, s, s, s]), r.choice([None, e, e, e, e]), r.choice(["x", "x", "y", None])))
        return out + [(n, 5, 5, "x")] * 3

    a, b = rows(150), rows(170)
    left, right = spark.createDataFrame(a, "i long, s long, e long, k string"), spark.createDataFrame(b, "j long, s2 long, e2 long, k string" if keyed else "j long, s2 long, e2 long, k2 string")
    df = temporal.overlap_join(left, right, ("s", "e"), ("s2", "e2"), ["k"] if keyed else [], width)
    ok = lambda x: x[1] is not None and x[2] is not None and x[1] <= x[2]
    want = Counter((x[0], y[0]) for x in a for y in b if ok(x) and ok(y) and x[1] <= y[2] and y[1] <= x[2] and (not keyed or x[3] is not None and x[3] == y[3]))
    assert Counter((p["i"], p["j"]) for p in df.collect()) == want
    assert "NestedLoop" not in _plan(df) and "Cartesian" not in _plan(df)
    none = temporal.overlap_join(left.limit(0), right, ("s", "e"), ("s2", "e2"), ["k"] if keyed else [])
    assert none.count() == 0 and none.columns == df.columns


def test_ticks_keep_the_order(spark):
    at = [dt.datetime(1969, 12, 31, 23, 59, 59, 999_999), dt.datetime(1970, 1, 1), dt.datetime(2024, 2, 29, 12, 30, 1, 5)]
    df = spark.createDataFrame([(x, x, x.date()) for x in at], "a timestamp_ntz, b timestamp, c date")
    got = df.select(*(temporal.ticks(F.col(f.name), f.dataType) for f in df.schema.fields)).collect()
    zero = dt.datetime(1970, 1, 1)
    assert [r[0] for r in got] == [(x - zero) // dt.timedelta(microseconds=1) for x in at]
    assert [r[2] for r in got] == [(x.date() - zero.date()).days * 86_400_000_000 for x in at]
    with pytest.raises(TypeError):
        temporal.ticks(F.col("s"), spark.createDataFrame([("x",)], "s string").schema["s"].dataType)


@pytest.mark.parametrize("exact", [True, False])
def test_asof_join(spark, exact):
    """Few keys over many tasks, so that rows are handed over borders; ties, nulls, repeated rows, keys of one side only."""
    r = random.Random(4)
    a = [(i, r.choice([None, "p", "p", "p", "q", "only left"]), r.choice([None, r.randrange(300), r.randrange(300), r.randrange(300)])) for i in range(400)]
    b = [(i, r.choice([None, "p", "q", "only right"]), r.choice([None, r.randrange(300), r.randrange(300)])) for i in range(60)] + [(100, "p", 150), (101, "p", 150)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        left, right = spark.createDataFrame(a, "i long, k string, t long").repartition(4), spark.createDataFrame(b, "j long, k2 string, t2 long").repartition(3)
        got = {x["i"]: x["j"] for x in temporal.asof_join(left, right, "t", "t2", [("k", "k2")], exact, ["j"]).collect()}
        bare = temporal.asof_join(left, right.limit(0), "t", "t2", [("k", "k2")]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for i, k, t in a:
        ok = [(t2, j) for j, k2, t2 in b if None not in (k, t, k2, t2) and k == k2 and (t2 <= t if exact else t2 < t)]
        want[i] = max(ok)[1] if ok else None
    assert got == want and sum(v is not None for v in want.values()) > 100
    assert len(bare) == len(a) and all(x["j"] is None for x in bare)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 3)), max_size=6), max_size=6), st.integers(0, 5))
def test_sessions_merge_in_any_batches(batches, gap):
    held = []
    for b in batches:
        held = sessions.merge_sessions(held, [(t, float(v)) for t, v in b], gap)
    every = [(t, float(v)) for b in batches for t, v in b]
    assert held == sessions.merge_sessions([], every, gap)
    times = sorted(t for t, _ in every)
    assert len(held) == sum(i == 0 or t - times[i - 1] > gap for i, t in enumerate(times))


def test_late_rows_bridge_sessions_and_too_late_ones_are_dropped(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    at = lambda m: base + dt.timedelta(minutes=m)
    schema = spark.createDataFrame([], "u string, ts timestamp_ntz, v double").schema
    parts = [[("a", 0, 1.0), ("a", 20, 2.0), (None, 1, 4.0)], [("a", 10, 8.0)], [("b", 300, 1.0)], [("a", 5, 100.0)], [("b", 10_000, 0.0)]]
    for part in parts:
        spark.createDataFrame([(u, at(m), v) for u, m, v in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        sessions.run_sessions(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/state", "u", "ts", "v", 600, "1 hour")
    got = sorted((r["u"] or "", r["n"], r["total"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("", 1, 4.0), ("a", 3, 11.0), ("b", 1, 1.0)]  # 0, 10 and 20 are one session; the row at 5 came after the watermark


# --- sketches --------------------------------------------------------------------------------


def test_sketches_merge_to_the_one_pass_figures(spark):
    rows = spark.range(60_000).select((F.col("id") % 13).alias("day"), F.when(F.col("id") % 50 != 0, F.col("id") % 20_000).alias("v"))
    once, daily = sketches.distinct_registers(rows, [], F.col("v")), sketches.distinct_registers(rows, ["day"], F.col("v"))
    assert sorted(map(tuple, sketches.merge_registers(daily, []).collect())) == sorted(map(tuple, once.collect()))
    estimate = sketches.distinct_estimate(once, []).first()["estimate"]
    n = rows.agg(F.countDistinct("v")).first()[0]
    assert abs(estimate / n - 1) < 4 * 1.04 / 2 ** (sketches.BITS / 2)
    low, parts = sketches.set_sample(rows, [], F.col("v")), sketches.set_sample(rows, ["day"], F.col("v"))
    assert sorted(map(tuple, sketches.merge_samples(parts, []).collect())) == sorted(map(tuple, low.collect())) and low.count() == sketches.SAMPLE
    few = spark.createDataFrame([(1, None), (1, 5), (1, 5)], "day int, v long")
    assert abs(sketches.distinct_estimate(sketches.distinct_registers(few, ["day"], F.col("v")), ["day"]).first()["estimate"] - 1) < 0.01


def test_quantile_buckets_hold_their_accuracy(spark):
    r = random.Random(6)
    values = [r.choice([0.0, r.gauss(0, 1), -(10 ** r.uniform(-8, 8)), 10 ** r.uniform(-8, 8)]) for _ in range(3000)]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)] + [(0, None), (0, math.nan), (0, math.inf)], "day int, v double")
    merged = sketches.merge_buckets(sketches.quantile_buckets(df, ["day"], F.col("v")), [])
    shares = (0.0, 0.1, 0.5, 0.77, 0.999, 1.0)
    for row in sketches.quantile_estimate(merged, [], shares).collect():
        want = sorted(values)[math.floor(row["share"] * (len(values) - 1))]
        assert abs(row["estimate"] - want) <= sketches.ACCURACY * abs(want) + 1e-12


def test_set_sizes(spark):
    rows = spark.range(9000).select(F.explode(F.when(F.col("id") < 3000, F.array(F.lit("a"))).when(F.col("id") < 6000, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))).alias("s"), "id")
    sizes = sketches.set_sizes(sketches.set_sample(rows, ["s"], F.col("id")), F.col("s") == "a", F.col("s") == "b").first()
    for name, want in (("n_union", 9000), ("n_common", 3000), ("n_left_only", 3000)):
        assert abs(sizes[name] - want) < 0.15 * 9000


# --- vector indexes --------------------------------------------------------------------------


def test_recall_and_reads_of_the_indexes(spark, sf_dir):
    for name, reads in (("graph_topk_recall", 1 / 3), ("code_topk_recall", 0.5), ("ivf_topk_recall", 0.7)):
        row = catalogue.QUERIES[name](spark, sf_dir).first()
        assert row["recall"] >= 0.9 and row["read_share"] <= reads and row["n_exact"] == 10 * row["n_queries"], (name, row)


def test_graph_finds_what_it_doesnt_hold(spark):
    """Clusters, repeated vectors, null and zero ones; queries that are no rows."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 16)) * 2
    x = np.vstack([c + rng.standard_normal((60, 16)) for c in centres])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, x[0].tolist()), (1001, None), (1002, [0.0] * 16)]
    corpus = graph.saved(graph.unit_rows(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    queries = [(q, (centres[q % 12] + rng.standard_normal(16)).tolist()) for q in range(15)]
    asked = graph.unit_rows(spark.createDataFrame(queries, "vec_id long, embedding array<float>"))
    links = graph.build_graph(corpus)
    assert links.agg(F.max(F.size("links"))).first()[0] <= graph.DEGREE + graph.BACK + graph.FAR and corpus.count() == len(x) + 1
    hits, read = graph.graph_search(links, corpus, asked, 5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    right = 0
    for q, v in queries:
        best = np.argsort(-(unit @ np.array(v)))[:5].tolist()
        right += len({r["id"] for r in hits.filter(F.col("query_id") == q).collect()} & set(best))
    assert right >= 0.9 * 75 - 1 and read.count() < 15 * len(x) / 2


# --- data sources ----------------------------------------------------------------------------


def test_misses_count_once_whatever_happens(spark, tmp_path):
    datasource.register(spark)
    root = str(tmp_path / "log")
    rows = spark.createDataFrame([(1.0, "q", {"company": "A"}), (2.0, "é", None)], "ts double, query string, filters map<string,string>")
    rows.write.format("misses").mode("append").save(root)
    log = datasource._Log(root)
    twice = [log.write(iter(rows.collect())) for _ in range(2)]  # a task that ran again: the first try's file is in no commit
    log.publish(twice[1:], "stream-000000000007")
    log.publish([log.write(iter(rows.collect()))], "stream-000000000007")  # the batch replayed after a restart
    log.drop([log.write(iter(rows.collect()))])  # an aborted job
    got = sorted((r["ts"], r["query"], str(r["filters"])) for r in spark.read.format("misses").load(root).collect())
    assert got == sorted([(1.0, "q", "{'company': 'A'}"), (2.0, "é", "None")] * 2)
    assert spark.read.format("misses").load(str(tmp_path / "none")).count() == 0


def test_a_failing_write_leaves_nothing(spark, tmp_path):
    datasource.register(spark)
    root = str(tmp_path / "log")
    bad = spark.range(4).repartition(2).select(F.col("id").cast("double").alias("ts"), F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise("q").alias("query"), F.lit(None).cast("map<string,string>").alias("filters"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("misses").mode("append").save(root)
    assert spark.read.format("misses").load(root).count() == 0


def test_miss_stream(spark, tmp_path):
    datasource.register(spark)
    schema = "ts double, query string, filters map<string,string>"
    for n in (3, 2):
        spark.range(n).select(F.col("id").cast("double").alias("ts"), F.lit("q").alias("query"), F.lit(None).cast("map<string,string>").alias("filters")).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        stream.writeStream.format("misses").option("path", f"{tmp_path}/log").option("stream", "s").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.format("misses").load(f"{tmp_path}/log").count() == 5


def test_folders_of_submissions(spark, tmp_path):
    datasource.register(spark)
    root = tmp_path / "f"
    for i in range(5):
        p = root / f"T{i}" / "10-K" / str(i)
        p.mkdir(parents=True)
        (p / "full-submission.txt").write_bytes(b"caf\xc3\xa9 \xff" * i)
        (p / "other.txt").write_text("no")
    got = sorted(tuple(r) for r in spark.read.format("submissions").load(str(root)).collect())
    assert [g[1] for g in got] == ["café �" * i for i in range(5)] and all(g[0].endswith("full-submission.txt") for g in got)
    assert spark.read.format("submissions").load(str(tmp_path / "none")).count() == 0
    assert len(datasource._tasks(datasource._listed(str(root)))) == 1


# --- calculations ----------------------------------------------------------------------------


def test_calculations_and_what_stops_them(spark):
    facts = spark.createDataFrame(
        [("A", 2020, "revenue", 100.0, "USD"), ("A", 2021, "revenue", 150.0, "USD"), ("A", 2021, "revenue", 150.0, "USD"), ("A", 2022, "revenue", 0.0, "USD"), ("A", 2021, "staff", 3.0, "people"), ("A", 2023, "revenue", 9.0, "EUR"), ("B", 2021, "revenue", 1.0, "USD"), ("B", 2021, "revenue", 2.0, "USD"), ("B", 2020, "revenue", 2.0, None), ("A", 2019, "revenue", None, "USD")],
        "ticker string, fiscal_year int, concept string, value double, unit string",
    )
    asked = [
        (1, "growth", "A", ["revenue"], [2021], ("ok", 50.0, "%", "")), (2, "ratio", "A", ["revenue", "staff"], [2021], ("ok", 50.0, "USD/people", "")), (3, "difference", "A", ["revenue"], [2020, 2021], ("ok", 50.0, "USD", "")),
        (4, "sum", "A", ["revenue"], [2020, 2022], ("ok", 250.0, "USD", "")), (5, "growth", "A", ["revenue"], [2023], ("unit_mismatch", None, None, "")), (6, "difference", "A", ["revenue"], [2022, 2023], ("unit_mismatch", None, None, "")),
        (7, "growth", "A", ["revenue"], [2020], ("missing", None, None, "revenue 2019")), (8, "growth", "B", ["revenue"], [2021], ("ambiguous", None, None, "")), (9, "root", "A", ["revenue"], [2021], ("unknown_calculation", None, None, "")), (10, None, "A", [], [2021], ("unknown_calculation", None, None, "")),
        (11, "ratio", "A", ["revenue"], [2021], ("missing", None, None, "? 2021")), (12, "ratio", "A", ["staff", "revenue"], [2022], ("missing", None, None, "staff 2022")), (13, "average", "A", ["revenue"], [2020, 2021], ("ok", 125.0, "USD", "")), (14, "sum", "A", ["revenue"], [], ("missing", None, None, "")),
    ]
    df = spark.createDataFrame([a[:5] for a in asked], "query_id long, calculation string, company string, metrics array<string>, year_range array<int>")
    from quarryline.operators import compute

    got = {r["query_id"]: (r["status"], r["value"], r["unit"], r["missing"] or "") for r in compute.compute(df, facts).collect()}
    assert got == {a[0]: a[5] for a in asked}


def test_calculations_are_answered_in_the_run(spark):
    from quarryline.operators import pipeline
    from quarryline.providers import ExtractiveGenerator, HashedEmbedder

    facts = spark.createDataFrame([("EN", 2020, "revenue", 100.0, "USD"), ("EN", 2021, "revenue", 150.0, "USD")], "ticker string, fiscal_year int, concept string, value double, unit string")
    corpus = spark.createDataFrame([(1, "EN", 2021, "mdna", "Revenue rose.")], "vec_id long, ticker string, fiscal_year int, section string, text string")
    asked = spark.createDataFrame([(1, "Compute the growth of revenue of EN in 2021?"), (2, "Compute the growth of revenue of EN in 2009?"), (3, "What percent of EN in 2021?"), (4, "hello")], "query_id long, query string")
    found, _ = pipeline.answer_questions(asked, corpus, HashedEmbedder(16), ExtractiveGenerator(), facts=facts, concepts=["revenue"])
    got = {r["query_id"]: (r["action_code"], r["status"], r["text"]) for r in found.collect()}
    assert got[1] == ("compute", "ok", "growth of revenue of EN is 50.0000 %")
    assert got[2][:2] == ("compute", "declined") and "revenue 2008, revenue 2009" in got[2][2]
    assert got[3][:2] == ("compute", "clarify") and got[4][1] == "ok"
