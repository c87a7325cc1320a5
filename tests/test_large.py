"""Steps that must not grow with the rows: no row through the driver, bounded tasks, and ties as SQL has them."""

from __future__ import annotations

import numpy as np

from quarryline.operators import vector


def test_batched_search_without_the_driver(spark, monkeypatch):
    """Several parts and blocks, keyed and open queries, nulls; the driver reads no query and the plan stays small."""
    monkeypatch.setattr(vector, "PART", 40)
    monkeypatch.setattr(vector, "BLOCK", 16)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 6))
    rows = [(i, [float(x) for x in v[i]] if i % 50 else None, i % 3 if i % 7 else None) for i in range(300)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    asked = [(1000 + i, [float(x) for x in rng.normal(size=6)], [0, 1, 2, None, 9][i % 5]) for i in range(90)]
    queries = spark.createDataFrame([*asked, (5000, None, 1)], "query_id long, query_vec array<double>, label int")
    monkeypatch.setattr(type(queries), "toLocalIterator", lambda *_, **__: 1 / 0)
    monkeypatch.setattr(type(queries), "collect", lambda *_: 1 / 0)
    out = vector.batched_search(corpus, queries, 4, "label")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") == 2
    monkeypatch.undo()
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for q, x, key in asked:
        s = unit @ (np.array(x) / np.linalg.norm(x))
        fit = [i for i, e, label in rows if e and (key is None or label == key)]
        if fit:
            want[q] = sorted(fit, key=lambda i: (-s[i], i))[:4]
    assert got == want


def test_same_question_looked_up_once(spark):
    """Each asker of a question gets its answer, and its miss; the model sees the question once."""
    from quarryline.operators import pipeline
    from quarryline.providers import Generator, HashedEmbedder

    class Counting(Generator):
        def __init__(self, calls) -> None:
            self.calls = calls

        def generate(self, query: str, context: str) -> str:
            self.calls += 1
            return "found"

    asked = spark.createDataFrame([(i, "What was EN revenue in 2001?" if i % 2 else "What was ZZ revenue in 2001?") for i in range(40)] + [(99, None)], "query_id long, query string")
    corpus = spark.createDataFrame([(1, "EN", 2001, "mdna", "revenue rose")], "vec_id long, ticker string, fiscal_year int, section string, text string")
    model = Counting(spark.sparkContext.accumulator(0))
    found, missed = pipeline.answer_questions(asked, corpus, HashedEmbedder(16), model)
    got = {r["query_id"]: r for r in found.collect()}
    assert model.calls.value == 1
    assert set(got) == {*range(40), 99} and all(got[i]["text"] == "found" and len(got[i]["sources"]) == 1 for i in range(1, 40, 2))
    assert sorted((r["query_id"], r["query"], r["filters"]["ticker"]) for r in missed.collect()) == [(i, "What was ZZ revenue in 2001?", "ZZ") for i in range(0, 40, 2)]


def test_scores_equal_when_rounded_rank_by_id(spark, tmp_path):
    """Scores that differ behind the sixth digit tie, as in the SQL, also at the edge of the k best."""
    import duckdb

    from quarryline.plans import catalogue

    rows = [(i, [1.0, 0.3 + (20 - i) * 1e-8, 0.1 * (i % 2)], 1) for i in range(20)] + [(40 + i, [1.0, 0.2, float(i)], 1) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("vec_topk_batched", "vec_topk_optional_filter", "context_block", "vec_rank_of_label"):
        out = catalogue.QUERIES[name](spark, str(tmp_path))
        want = duck.sql(catalogue.SQL[name])
        assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(want.fetchall()), name


def test_references_without_semicolon(spark, tmp_path):
    """What is cut off behind a reference's name stays text in html_to_text; the parser itself keeps to the standard."""
    import duckdb

    from quarryline.functions.elements import elements
    from quarryline.plans import catalogue

    pages = [(1, "<html><head><title>t</title></head><body><h1>a &amp;&amp; b&amp</h1><p>c&lt;d &ampx; &copy; & e</p></body></html>")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.sql(catalogue.SQL["html_to_text"])
    out = catalogue.QUERIES["html_to_text"](spark, str(tmp_path))
    assert [tuple(r) for r in out.select(*want.columns).collect()] == want.fetchall()
    assert [t for _, t in elements("<p>a&amp</p>")] == ["a&"]


def test_search_shuffles_no_posting_for_each_query(spark, monkeypatch):
    """A query costs a row for each part, not one for each posting that it meets; parts and blocks of several sizes agree."""
    from quarryline.operators import lexical

    rows = [(i, "the same words " + " ".join(f"w{(i * j) % 17}" for j in range(8))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = docs.filter("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    monkeypatch.setattr(lexical, "RANGE", 4)
    out = lexical.bm25_search(lexical.build_index(docs), asked, 5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "sum(" not in plan
    small = sorted(map(tuple, out.collect()))
    monkeypatch.setattr(lexical, "RANGE", 256)
    monkeypatch.setattr(lexical, "BLOCK", 7)
    assert small == sorted(map(tuple, lexical.bm25_search(lexical.build_index(docs), asked, 5).collect())) and len(small) == 100


def test_chunks_by_slices(spark, monkeypatch):
    """However many rows a batch has, few of them are Python objects at once."""
    import pyarrow as pa

    from quarryline.operators import chunking

    df, runs = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema, *_: runs.append(run))
    chunking.chunk_records(df, type_col=None, delimiter="\n", target=4, overlap=1)
    chunking.slice_texts(df, 2)
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(1000)), "text": ["a b\nc d"] * 1000})
    for run in runs:
        made = list(run(iter([whole])))
        assert len(made) > 4 and sorted(x for b in made for x in b.column("doc_id").to_pylist())[::2] == list(range(1000))


def test_intervals_are_cut_once(spark):
    """Long, short and early intervals give the pairs of a plain comparison; the join reads their nodes, it doesn't cut them again."""
    import random

    from quarryline.operators import temporal

    rnd = random.Random(4)
    spans = [(i, s := rnd.randrange(-3000, 3000), s + rnd.choice([0, 1, 7, 63, 64, 700, 5000])) for i in range(150)]
    left, right = spark.createDataFrame(spans[:70], "a long, s long, e long"), spark.createDataFrame(spans[70:], "b long, s2 long, e2 long")
    out = temporal.overlap_join(left, right, ("s", "e"), ("s2", "e2"), width=1)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 12_000
    assert sorted((r["a"], r["b"]) for r in out.collect()) == sorted((a, b) for a, s, e in spans[:70] for b, s2, e2 in spans[70:] if s <= e2 and s2 <= e)


def _filings(spark, n):
    body = "<DOCUMENT>\n<TYPE>10-K\n<TEXT><html><p>text</p></html></TEXT>\n</DOCUMENT>"
    head = "CONFORMED SUBMISSION TYPE:\t10-K\nCONFORMED PERIOD OF REPORT:\t20240131\n"
    return spark.createDataFrame([(f"/sec-edgar-filings/T{i % 3}/10-K/{i:010d}-24-{i:06d}/full-submission.txt", head + (body if i % 4 else "")) for i in range(n)], "path string, content string")


def test_corpus_run_reads_each_filing_once(spark, tmp_path, monkeypatch):
    """One pass over the files gives chunks, errors and the count of all; chunks of a company and year go to one small file."""
    from quarryline.operators import ingest

    df, seen = _filings(spark, 40).repartition(8), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    monkeypatch.setattr(ingest, "read_submissions", lambda *_: df.mapInArrow(counted, df.schema))
    want = ({"processed": 30, "skipped": 0, "errors": 10}, {"processed": 0, "skipped": 30, "errors": 10})
    for run, counts in enumerate(want, 1):
        assert ingest.chunk_corpus(spark, "", f"{tmp_path}/corpus") == counts
        assert seen.value == 40 * run
    assert len(spark.read.parquet(f"{tmp_path}/corpus").inputFiles()) == 3


def test_small_filings_in_many_tasks_and_few_batches(spark, monkeypatch, tmp_path):
    """Opening a file counts as bytes, rows of small files share a batch, and the patterns run once a filing."""
    from quarryline.operators import ingest
    from quarryline.sources import datasource

    datasource.register(spark)
    _filings(spark, 40).write.format("submissions").mode("append").save(str(tmp_path))
    listed = datasource._listed(str(tmp_path))
    monkeypatch.setattr(datasource, "TASK_BYTES", 1 << 20)
    assert len(listed) == 40 and len(datasource._tasks(listed)) > 4
    batches = list(datasource._read(str(tmp_path), datasource.Files(tuple(f.path for f in listed))))
    assert len(batches) == 1 and batches[0].num_rows == 40
    un = ingest.unwrap(spark.read.format("submissions").load(str(tmp_path))).filter("status = 'ok'")
    assert un._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1 and un.count() == 30


def test_each_pattern_of_unwrapping_runs_once(spark):
    """however many columns a pattern gives, a filing meets it once; letters that grow when they are lowered don't shift the page."""
    from pyspark.sql import functions as F

    from quarryline.functions import text as X
    from quarryline.operators import ingest

    plan = ingest.unwrap(_filings(spark, 8)).filter("status = 'ok'")._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(p) for p in ("<DOCUMENT>(", "<TEXT>.*,", "SUBMISSION TYPE", "PERIOD OF REPORT", "<html.*", "</html>, 0")] == [1] * 6
    cases = {"\u0130\u0130\u0130 <HTML>a\u0130</html> b</Html>c": "<HTML>a\u0130</html> b</Html>", "</html>x<html>": "", "\u00a0x <html> ": "x <html>", " y ": "y", "": "", None: None}
    got = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", X.slice_html(F.col("t")).alias("h")).orderBy("i").collect()
    assert [r["h"] for r in got] == list(cases.values())


def test_white_space_is_stripped_at_the_ends_only(spark):
    """no pattern runs over a whole text to trim it; all of Unicode's white space goes, nothing else does."""
    import sys

    from pyspark.sql import functions as F

    from quarryline.functions import text as X

    space = [chr(i) for i in range(sys.maxunicode) if not 0xD800 <= i < 0xE000 and (i == 0x85 or chr(i).isspace() and not 0x1C <= i <= 0x1F)]
    odd = ["\u200b", "\ufeff", "\x1c", "\x1f", "\u180e", "\U0001d4b3", "\u0301"]
    cases = [*(c + "a" + c + "b" + c * 2 for c in space), *(c + "a" + c for c in odd), "".join(space), "", "a", " a\n", None]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", "t", X.strip_space("t").alias("s"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("want"))
    assert len(space) == 25 and df.filter(~F.col("s").eqNullSafe(F.col("want"))).collect() == []
    assert [r["s"] for r in df.orderBy("i").collect()] == [*("a" + c + "b" for c in space), *(c + "a" + c for c in odd), "", "", "a", "a", None]
    assert "regexp" not in df.select(X.strip_space("t"))._jdf.queryExecution().analyzed().toString().splitlines()[0]


def test_stream_of_submissions_lists_once_a_batch(tmp_path, monkeypatch):
    """the listing that gave the last offset deals out its batch; a stream that goes on with nothing open lists nothing more."""
    import pickle

    from quarryline.sources import datasource

    paths = [f"{tmp_path}/{a}/10-K/{b}/{c}" for a in "vwxyz" for b in range(12) for c in ("full-submission.txt", "other.txt")]
    for p in (*paths, f"{tmp_path}/full-submission.txt"):
        datasource._put(*datasource.open_path(p), p.encode())
    want = {p for p in paths if p.endswith("n.txt")} | {f"{tmp_path}/full-submission.txt"}
    calls, listed = [], datasource._listed
    monkeypatch.setattr(datasource, "_listed", lambda root: calls.append(root) or listed(root))
    reader = datasource._StreamReader(str(tmp_path))
    end = reader.latestOffset()
    parts = pickle.loads(pickle.dumps(reader.partitions({"changed": 0}, end)))
    assert sorted(p for part in parts for p in part.paths) == sorted(want) and len(calls) == 1
    assert reader.partitions(end, end) == [] and len(calls) == 1
    again = datasource._StreamReader(str(tmp_path)).partitions({"changed": 0}, end)
    assert {p for part in again for p in part.paths} == want and len(calls) == 2
    many = datasource.Files(tuple(paths * 50))
    assert pickle.loads(pickle.dumps(many)) == many and len(pickle.dumps(many)) < sum(map(len, many.paths)) / 5


def test_sessions_of_many_keys_without_python(spark, tmp_path):
    """Sessions are windows of the engine, whatever files a part has, equal to plain code at the edge of the gap; no worker runs for each key."""
    import datetime as dt
    import random

    from pyspark.sql import functions as F

    from quarryline.streaming import sessions

    rnd = random.Random(8)
    rows = [(i, rnd.choice([1, 2, 3, None]), rnd.randrange(0, 4000) * 10, float(i)) for i in range(400)]
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, u, day + dt.timedelta(seconds=t), v) for i, u, t, v in rows], "event_id long, user_id long, ts timestamp_ntz, value double").repartition(5)
    out = sessions.sessions_in_two_runs(spark, df, "user_id", "ts", "value", 60, "60 days")
    got = sorted((r["user_id"] or 0, int((r["session_start"] - day).total_seconds()), int((r["session_end"] - day).total_seconds()), r["n"], r["total"]) for r in out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")}).collect())
    want = sorted((u or 0, *x) for u in (1, 2, 3, None) for x in sessions.merge_sessions([], [(t, v) for _, k, t, v in rows if k == u], 60))
    assert got == want
    df.write.parquet(f"{tmp_path}/in")
    plan = sessions.sessions(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "user_id", "ts", "value", 60, "1 hour")._jdf.queryExecution().logical().toString()
    assert "InPandas" not in plan


def test_search_task_holds_few_scores(spark, monkeypatch):
    """The largest part against the largest block: what a task holds is a small part of the scores, and its hits are right."""
    import tracemalloc

    import pyarrow as pa
    import pyarrow.compute
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    held = []
    real = PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda self, fn, schema: held.append(fn) or real(self, fn, schema))
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    vector.batched_search(df, df.toDF("query_id", "query_vec"), 40)
    rng = np.random.default_rng(1)
    rows, asked = (rng.normal(size=(n, 8)).astype(np.float32) for n in (vector.PART, 2048))
    lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 8).cast(pa.list_(pa.float32()))
    left = pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": lists(rows)})
    right = pa.table({"query_id": pa.array(range(len(asked)), pa.int64()), "query_vec": lists(asked)})
    tracemalloc.start()
    out = held[0](left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rows.astype(float), asked.astype(float))]
    for i in (0, 777, 2047):
        best = out.filter(pa.compute.equal(out.column("query_id"), i)).column("vec_id").to_pylist()
        assert best == np.argsort(-(unit[0] @ unit[1][i]), kind="stable")[:40].tolist()
