"""Smaller operators: quarantine, research plans, evaluation sets, settings, command line."""

from __future__ import annotations

import pytest

from quarryline import cli
from quarryline.operators import answers, chunking, dataset, evalset, ingest, retrieval
from quarryline.schemas import ACTION_CODES, CHUNK
from quarryline.sources.jdbc import Store


def test_quarantine(spark):
    df = spark.createDataFrame([("lookup",), ("PARSE_ERROR",), (None,)], "predicted_code string")
    kept, rest = dataset.quarantine(df, ACTION_CODES)
    assert kept.count() == 1 and rest.count() == 2


def test_messages(spark):
    row = spark.createDataFrame([("q",)], "q string").select(answers.chat_messages("q", "sys", [("u", "a")])).first()[0]
    assert [tuple(x) for x in row] == [("system", "sys"), ("user", "u"), ("assistant", "a"), ("user", "q")]


def test_research(spark):
    d = spark.createDataFrame([(1, (["aa", "B.B"], [2022, 2023], None))], "query_id long, params struct<companies:array<string>, year_range:array<int>, year:int>")
    plan = answers.research_plan(d)
    assert sorted(map(tuple, plan.collect())) == [(1, "AA", 2022), (1, "AA", 2023), (1, "B-B", 2022), (1, "B-B", 2023)]
    corpus = spark.createDataFrame([(i, t, y, [1.0, float(i)]) for i, (t, y) in enumerate([("AA", 2022), ("AA", 2022), ("AA", 2023), ("B-B", 2023), ("C", 2023)])], "vec_id long, ticker string, fiscal_year int, embedding array<float>")
    vec = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vec array<float>")
    got = retrieval.research(corpus, plan, vec, 1).select("ticker", "fiscal_year", "vec_id").collect()
    assert sorted(map(tuple, got)) == [("AA", 2022, 0), ("AA", 2023, 2), ("B-B", 2023, 3)]


def test_iterate(spark):
    """All rows, also of a plan with a shuffle whose files go when the query ends."""
    from quarryline.session import iterate

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        for _ in range(3):
            assert sorted(r["id"] for r in iterate(spark.range(50).repartition(5).groupBy("id").count().orderBy("id"))) == list(range(50))
    finally:
        spark.conf.set(name, before)
    assert [r["id"] for r in iterate(spark.range(3))] == [0, 1, 2] and list(iterate(spark.range(0))) == []


def test_near_year(spark):
    df = spark.createDataFrame([("20221231",), ("20240131",), ("20250201",), (None,)], "period_of_report string")
    assert df.filter(retrieval.near_fiscal_year(2023)).count() == 2


def test_eval_cases(spark):
    rows = [(t, "10-K", 2023, "20230101", f"{t}-1", "mdna", "narrative", f"revenue of {t} was {i} million " + "word " * 90, i, 95) for t in ("A", "B") for i in range(5)]
    rows.append(("A", "10-K", 2023, "20230101", "A-1", "exhibits", "narrative", "x", 9, 99))
    cases = evalset.eval_cases(spark.createDataFrame(rows, CHUNK), evalset.FirstNumberWriter(), 4).collect()
    assert sorted(r["source"]["ticker"] for r in cases) == ["A", "A", "B", "B"] and all(r["answer_type"] == "numeric" for r in cases)


def test_accessions(spark):
    at = "/f/sec-edgar-filings/A/10-K/{}/full-submission.txt"
    good = "0000000000-24-000001"
    df = spark.createDataFrame([(at.format(good), f"ACCESSION NUMBER:\t{good}\n"), (at.format(good), "none"), (at.format("x"), "ACCESSION NUMBER: x")], "path string, content string")
    assert ingest.accession_mismatches(df).count() == 2


def test_gap():
    assert chunking.additivity_gap("a b\n\nc") == 0
    assert chunking.additivity_gap("ab\n\nc", count=len) == 2


def test_settings():
    env = {"DB_HOST": "h", "DB_PORT": "1", "DB_NAME": "n", "DB_USER": "u", "DB_PASSWORD": "p"}
    s = Store.from_env(env)
    assert s.url == "jdbc:postgresql://h:1/n" and s.options("t")["batchsize"] == "500"
    with pytest.raises(ValueError, match="DB_HOST, DB_PASSWORD"):
        Store.from_env({k: v for k, v in env.items() if k not in ("DB_HOST", "DB_PASSWORD")})


def test_cli(capsys):
    assert cli.main(["queries"]) == 0 and "vec_topk_filtered" in capsys.readouterr().out


def _filing(n, ticker, words):
    items = "".join(f"<h2>Item {i}. Head</h2><p>{i} {ticker} {words} {n} million.</p>" for i in ("1", "1A", "7"))
    return f"ACCESSION NUMBER:\t0000000000-24-{n:06d}\nCONFORMED SUBMISSION TYPE:\t10-K\nCONFORMED PERIOD OF REPORT:\t20240131\n<DOCUMENT>\n<TYPE>10-K\n<TEXT><html><body>{items}</body></html></TEXT>\n</DOCUMENT>\n"


def test_cli_steps(spark, tmp_path, capsys):
    """All steps in turn: filings to chunks, vectors, cases, reports; queries to labels and splits."""
    import json

    go = lambda *a: cli.main([str(x) for x in a])
    for n, ticker in enumerate(("AA", "BB", "CC"), 1):
        f = tmp_path / f"in/sec-edgar-filings/{ticker}/10-K/0000000000-24-{n:06d}/full-submission.txt"
        f.parent.mkdir(parents=True)
        f.write_text(_filing(n, ticker, "revenue and word " * 30))
    root, corpus, vectors, cases = (tmp_path / x for x in ("in", "corpus", "vectors", "cases"))
    assert go("chunk", "--root", root, "--corpus", corpus) == 0 and "processed: 3" in capsys.readouterr().out
    assert go("chunk", "--root", root, "--corpus", corpus, "--quiet") == 0 and capsys.readouterr().out == ""
    assert go("embed", "--corpus", corpus, "--vectors", vectors) == 0 and spark.read.parquet(str(vectors)).filter("size(embedding) > 0").count() == 9
    assert go("health", "--vectors", vectors) == 0 and go("health", "--vectors", tmp_path / "none") == 1
    assert go("eval-set", "--corpus", corpus, "--out", cases, "--n", 6) == 0
    assert go("eval-retrieval", "--cases", cases, "--vectors", vectors, "--out", tmp_path / "r", "--k", 3) == 0
    got = json.loads(spark.read.text(str(tmp_path / "r/metrics")).first()[0])
    assert got["n"] == 6 and got["hits"] == 6 and got["hit_rate"] == 1.0 and 0 < got["mrr"] <= 1
    assert "| hit_rate | 1.0 |" in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "r/scorecard")).collect())
    assert go("eval-answers", "--cases", cases, "--vectors", vectors, "--out", tmp_path / "a") == 0
    assert spark.read.json(str(tmp_path / "a/cases")).count() == 6
    q = tmp_path / "q.jsonl"
    q.write_text("\n".join(json.dumps({"code": c, "query": f"{c if i % 9 else 'fail'} question {i}", "batch_id": i}) for c in ACTION_CODES for i in range(24) for _ in range(2)))
    step = {x: tmp_path / x for x in ("dedup", "label", "over", "splits")}
    assert go("dedup", "--queries", q, "--out", step["dedup"]) == 0 and spark.read.json(str(step["dedup"])).count() == 24 * len(ACTION_CODES)
    assert go("label", "--queries", step["dedup"], "--out", step["label"]) == 0 and spark.read.json(str(step["label"])).filter("predicted_code = 'PARSE_ERROR'").count() == 3 * len(ACTION_CODES)
    o = tmp_path / "o.jsonl"
    o.write_text(json.dumps({"norm": "fail question 9", "new_code": "meta"}))
    assert go("overrides", "--labels", step["label"], "--overrides", o, "--out", step["over"]) == 0 and spark.read.json(str(step["over"])).filter("override_applied").count() == len(ACTION_CODES)
    assert go("splits", "--labels", step["label"], "--out", step["splits"]) == 0
    assert spark.read.json(str(step["splits"])).groupBy("split").count().count() == 3
    assert go("splits", "--labels", step["over"], "--out", tmp_path / "no") == 1  # seven equal queries of one code leak
    out = tmp_path / "out.jsonl"
    out.write_text("\n".join(json.dumps({"query": "q", "raw_output": r, "truth": "lookup"}) for r in ('{"action_code": "lookup"}', "{", '{"action_code": "meta"}')))
    assert go("score", "--outputs", out, "--out", tmp_path / "s") == 0
    got = json.loads(spark.read.text(str(tmp_path / "s/metrics")).first()[0])
    assert got["accuracy"] == 0.333333 and got["statuses"] == {"ok": 2, "invalid_json": 1} and got["codes"]["lookup"]["recall"] == 0.5


def test_answers_end_to_end(spark):
    from quarryline.operators import pipeline
    from quarryline.providers import ExtractiveGenerator, HashedEmbedder

    corpus = spark.createDataFrame([(1, "AA", 2022, "mdna", "cash of 5 million"), (2, "AA", 2023, "mdna", "revenue of 7 million"), (3, "BB", 2023, None, "debt")], "vec_id long, ticker string, fiscal_year int, section string, text string")
    asked = spark.createDataFrame([(1, "What was AA revenue in 2023?"), (2, "What was ZZ revenue?"), (3, "hello"), (4, "What was the revenue of AA?"), (5, None)], "query_id long, query string")
    found, missed = pipeline.answer_questions(asked, corpus, HashedEmbedder(64), ExtractiveGenerator(), k=2)
    got = {r["query_id"]: (r["text"], r["status"], len(r["sources"])) for r in found.collect()}
    assert got[1] == ("revenue of 7 million [1]", "ok", 1) and got[2][1:] == ("declined", 0) and got[3][1] == "ok" and got[4][2] == 2 and len(got) == 5
    assert [(r["query_id"], r["filters"]) for r in missed.collect()] == [(2, {"ticker": "ZZ"})]


def test_server(spark):
    import json
    import threading
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    from quarryline.providers import ExtractiveGenerator, HashedEmbedder
    from quarryline.serve import server

    corpus = spark.createDataFrame([(2, "AA", 2023, "mdna", "revenue of 7 million")], "vec_id long, ticker string, fiscal_year int, section string, text string")
    s = server(corpus, HashedEmbedder(64), ExtractiveGenerator(), port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{s.server_port}"
    post = lambda body: json.loads(urlopen(Request(f"{at}/query", data=body)).read())
    assert json.loads(urlopen(f"{at}/health").read()) == {"status": "ok", "empty": False}
    assert post(b'{"query": "What was AA revenue in 2023?"}') == {"text": "revenue of 7 million [1]", "action_code": "lookup", "status": "ok", "sources": [{"ticker": "AA", "fiscal_year": 2023, "section": "mdna"}]}
    for body, status in ((b"{", 400), (b'{"query": 1}', 400), (b"{}", 400)):
        with pytest.raises(HTTPError) as e:
            post(body)
        assert e.value.code == status
    s.shutdown()


def test_bpe_counter(spark):
    """Counts and slices by tokens of a public vocabulary; the chunker measures joined text with it."""
    import os

    from quarryline.operators.tokens import BpeCounter

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    c = BpeCounter(path)
    text = "Hello world, this is a longer sentence. And 12345 more! " * 40
    assert c("Hello world") == 2 and "".join(c.slices(text, 7)) == text and all(c(x) <= 7 for x in c.slices(text, 7))
    df = spark.createDataFrame([(1, text + "\n\n" + "one two three. " * 90), (2, None)], "id long, text string")
    chunks = chunking.chunk_records(df, type_col=None, target=60, overlap=8, count=c, slices=c.slices).collect()
    assert len(chunks) > 5 and all(r["n_tokens"] <= 60 and r["n_tokens"] == c(r["text"]) for r in chunks)


def test_shared_folder(spark, monkeypatch):
    """A cluster without a shared folder is an error, not a folder of one machine."""
    from quarryline import session

    class Context:
        master, applicationId = "spark://x:7077", "none"

        class _conf:
            get = staticmethod(lambda _: None)

        def getConf(self):
            return self._conf

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        class O:
                            isEmpty = staticmethod(lambda: True)

                        return O

                return S

    class Fake:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Fake())
    assert session.shared_folder(spark)


def test_entry_without_operators(monkeypatch, capsys):
    """The engine's own queries stay if a library of the training-data operators is missing."""
    import builtins
    import importlib

    import __spark_entry__ as e

    real = builtins.__import__

    def no_llm(name, *a, **k):
        if name.startswith("quarryline.llm"):
            raise ImportError(name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", no_llm)
    importlib.reload(e)
    assert "ingest_chunks" in e.queries() and not any(n.startswith("op") for n in e.queries()) and "left out" in capsys.readouterr().err
