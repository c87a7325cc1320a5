"""Datasets, evaluation, answers, vectors, sources and streams on small rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarryline import providers
from quarryline.operators import answers, dataset, evaluation, retrieval, vector
from quarryline.schemas import EVAL_CASE
from quarryline.sources import files
from quarryline.streaming import streams


def test_keep_first_and_overrides(spark):
    df = spark.createDataFrame([(1, "a", "Hi  There"), (2, "a", "hi there"), (3, "b", "hi there"), (4, "a", "x")], "pos int, code string, query string")
    assert sorted(r["pos"] for r in dataset.keep_first(df, ["code"], "query", "pos").collect()) == [1, 3, 4]
    over = spark.createDataFrame([("hi there", "b"), ("absent", "a")], "norm string, new_code string")
    got = {r["pos"]: (r["code"], r["override_applied"]) for r in dataset.apply_overrides(df, over, "query", "code").collect()}
    assert got == {1: ("b", True), 2: ("b", True), 3: ("b", False), 4: ("a", False)}
    assert [r["norm"] for r in dataset.unmatched_overrides(df, over).collect()] == ["absent"]


def test_keep_first_nulls_and_ties(spark):
    """A null group is a group; of equal orders one row stays; other columns may have any name or type."""
    rows = [(1, None, "x", {"a": 1}), (2, None, "X ", {"a": 2}), (3, None, None, None), (4, None, "", None), (5, "g", "t", None), (5, "g", "T", None), (5, "g", "t", None), (None, "h", "z", None), (9, "h", "z", None)]
    df = spark.createDataFrame(rows, "pos int, text_key string, query string, m map<string,int>")
    got = sorted((str(r["pos"]), str(r["text_key"])) for r in dataset.keep_first(df, ["text_key"], "query", "pos").collect())
    assert got == [("1", "None"), ("3", "None"), ("5", "g"), ("None", "h")]
    assert dataset.keep_first(df, ["text_key"], "query", "pos").columns == df.columns
    assert dataset.keep_first(df.limit(0), ["text_key"], "query", "pos").count() == 0


def test_overrides_of_one_text(spark):
    df = spark.createDataFrame([(1, "a", "hi", "n")], "pos int, code string, query string, norm string")
    over = spark.createDataFrame([("hi", "c"), ("hi", "b"), (None, "d")], "norm string, new_code string")
    assert [tuple(r) for r in dataset.apply_overrides(df, over, "query", "code").collect()] == [(1, "b", "hi", "n", True)]


def test_totals_are_told_from_null_groups(spark):
    df = spark.createDataFrame([(None, "a", True), (None, "a", False), ("g", "b", True)], "code string, query string, correct boolean")
    assert sorted((str(r["code"]), r["level"], r["n_rows"], r["n_unique"]) for r in dataset.duplicate_rates(df, "code", "query").collect()) == [("None", "group", 2, 1), ("None", "total", 3, 2), ("g", "group", 1, 1)]
    assert sorted((str(r["code"]), r["level"], r["n"]) for r in evaluation.correctness(df, "code").collect()) == [("None", "group", 2), ("None", "total", 3), ("g", "group", 1)]


def test_split_sizes(spark):
    df = spark.range(34).select(F.col("id"), F.when(F.col("id") < 3, "small").otherwise("big").alias("code"), F.col("id").cast("string").alias("input"))
    s = dataset.stratified_split(df, "code", "id")
    got = {(r["code"], r["split"]): r["count"] for r in s.groupBy("code", "split").count().collect()}
    assert got == {("small", "train"): 2, ("small", "test"): 1, ("big", "train"): 21, ("big", "val"): 4, ("big", "test"): 6}
    gates = dataset.split_gates(s, 34, ["big", "small", "none"], "code", "input")
    assert {r["check"]: r["issues"] for r in gates.collect()}["leakage"] == 0
    with pytest.raises(ValueError, match="min_per_class"):
        dataset.write_if_clean(s, gates, "/nowhere")


def test_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("PARSE_ERROR", "a"), ("b", None)], "truth string, predicted string")
    got = {r["code"]: (r["precision"], r["recall"], r["support"]) for r in evaluation.classification_report(df, ["a", "b", "c"]).collect()}
    assert got == {"a": (1.0, 0.5, 2), "b": (0.5, 1.0, 1), "c": (0.0, 0.0, 0)}
    raw = spark.createDataFrame([('{"action_code": "lookup"}', "lookup"), ("{", "lookup")], "raw_output string, truth string")
    assert [(r["status"], r["correct"]) for r in evaluation.score_outputs(raw, ("lookup",)).collect()] == [("ok", True), ("invalid_json", False)]


def test_answers(spark):
    q = spark.createDataFrame([("Should I buy AAPL?",), ("what can you do",), ("Thanks!",), ("What were earnings?",), ("AAPL and MSFT revenue",), ("AAPL margin 2023",), ("AAPL revenue 2023",), ("10-Q of AAPL",)], "q string")
    assert [r[0]["code"] for r in q.select(answers.route("q")).collect()] == ["decline", "meta", "smalltalk", "clarify", "research", "compute", "lookup", "decline"]
    d = spark.createDataFrame([(1, "lookup", None, "X", None), (2, "lookup", None, "Y", None), (3, "decline", "odd", None, None), (4, "dance", None, None, None), (5, "clarify", None, None, "Which?")], "query_id int, code string, reason string, company string, clarifying_question string")
    found = spark.createDataFrame([(1, "t", [("X", 2023, "mdna")])], "query_id int, answer_text string, sources array<struct<ticker:string,fiscal_year:int,section:string>>")
    got = {r["query_id"]: (r["status"], len(r["sources"])) for r in answers.answer(d, found).collect()}
    assert got == {1: ("ok", 1), 2: ("declined", 0), 3: ("declined", 0), 4: ("clarify", 0), 5: ("clarify", 0)}


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 1.0], 1), (4, None, 0), (5, [0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert [r["vec_id"] for r in vector.search(df, [1.0, 0.0], 2).collect()] == [1, 2]
    assert vector.search(df, [1.0, 0.0], 2, {"label": None}).count() == 0
    q = spark.createDataFrame([(7, [1.0, 0.1], 0), (8, [0.0, 1.0], None), (9, [1.0, 0.0], 5)], "query_id long, query_vec array<float>, label int")
    hits, misses = retrieval.retrieve(df, q, 3)
    assert [(r["query_id"], r["vec_id"]) for r in hits.orderBy("query_id", "rank").collect()] == [(7, 1), (7, 2), (8, 3), (8, 1), (8, 2)]
    assert [r["query_id"] for r in misses.collect()] == [9]
    cases = spark.createDataFrame([(7, 2), (9, 1)], "query_id long, expected long")
    assert tuple(retrieval.hit_mrr(retrieval.label_ranks(hits, cases)).first()) == (2, 1, 0.5, 0.25)
    terms = spark.createDataFrame([(1, "q", ("brk.b", 2023, "", "c"))], "query_id int, query string, params struct<company:string,year:int,fact_requested:string,concept:string>")
    assert tuple(retrieval.search_terms(terms).first()) == (1, "q", "c", "BRK-B", 2023)


def test_cells_find_neighbours(spark):
    """On vectors in clusters a few cells hold nearly all neighbours; a large cell is dealt to several tasks."""
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    queries = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    exact = {tuple(r) for r in vector.batched_search(df, queries, 10).select("query_id", "vec_id").collect()}
    fitted = vector.fit_cells(df, 32)
    for rows in (4096, 50):
        vector.CELL_ROWS = rows
        near = {tuple(r) for r in vector.cell_search(vector.index_cells(df, fitted), queries, fitted, 10, probes=4).select("query_id", "vec_id").collect()}
        assert len(near & exact) / len(exact) > 0.9
    vector.CELL_ROWS = 4096
    assert vector.cell_search(vector.index_cells(df.limit(0), fitted), queries, fitted, 10).count() == 0


def test_tables(spark, tmp_path):
    """CSV with quotes, line breaks and empty cells; the DDL of the chunk table; appends skip what is stored."""
    p = tmp_path / "a.csv"
    p.write_text('id,question\n1,"a ""quoted"" and\nbroken line"\n2, \n')
    assert [tuple(r) for r in files.read_csv(spark, str(p)).collect()] == [("1", 'a "quoted" and\nbroken line'), ("2", None)]
    files.create_chunk_table(spark, "chunks_test")
    files.create_chunk_table(spark, "chunks_test")
    fields = {f.name: f for f in spark.table("chunks_test").schema.fields}
    assert list(fields)[-2:] == ["ticker", "fiscal_year"] and fields["embedding"].dataType.simpleString() == "array<float>"
    spark.sql("DROP TABLE chunks_test")
    rows = spark.createDataFrame([("A", 2023, "a1", [1.0])], "ticker string, fiscal_year int, accession_number string, embedding array<float>")
    for n in (1, 1):
        files.append_vectors(rows, str(tmp_path / "v"))
        assert spark.read.parquet(str(tmp_path / "v")).count() == n


def test_store(spark, tmp_path):
    """Batched inserts and reads through the connector, against an embedded database if a driver for one is there."""
    from quarryline.sources import jdbc

    try:
        spark.sparkContext._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    except Exception:
        pytest.skip("no embedded database")
    store = jdbc.Store(f"jdbc:derby:{tmp_path}/db;create=true", "u", "p")
    df = spark.range(7).select("id", F.concat(F.lit("t"), "id").alias("name"))
    jdbc.append(df, store, "chunks", batch=2)
    jdbc.append(df.filter("id < 2"), store, "chunks", batch=2)
    assert jdbc.read(spark, store, "chunks").count() == 9


def test_files(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"code": "x", "query": "q"}\n\n  \n{"code": "y"}\n')
    assert files.read_jsonl(spark, [str(p), str(tmp_path / "none")], "code string, query string", skip_missing=True).count() == 2
    df = spark.createDataFrame([("e1", "q", "5", "numeric", ("T", 2023, "mdna", "a#0"), ("T", 2023), "lookup")], EVAL_CASE)
    assert files.reviewed_cases(files.review_rows(df)).collect() == df.collect()
    m = spark.createDataFrame([("q", {"ticker": "X"})], "query string, filters map<string,string>")
    for _ in range(2):
        files.append_misses(m, str(tmp_path / "miss"))
    assert spark.read.json(str(tmp_path / "miss")).count() == 2


def test_stream_delta(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    put = lambda lo, hi: spark.range(lo, hi).coalesce(1).write.mode("append").parquet(src)
    go = lambda: streams.delta_ingest(streams.file_stream(spark, src), out, state, "id")
    put(0, 10)
    go()
    go()
    put(5, 12)
    go()
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == list(range(12))


def test_providers(spark):
    df = spark.createDataFrame([("a b",), (None,)], "text string")
    got = providers.embed_column(df, providers.HashedEmbedder(16)).collect()
    assert abs(sum(x * x for x in got[0]["embedding"]) - 1) < 1e-5 and not any(got[1]["embedding"])
    assert providers.template_queries(spark, "lookup", ["A", "B"], ["cash"], 5).count() == 5
    assert providers.OverlapJudge().judge("", "a b", "a b c") and not providers.OverlapJudge().judge("", "", "")
