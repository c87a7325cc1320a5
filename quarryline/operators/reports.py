"""Evaluation runs and their reports: metrics as JSON, a scorecard, and a row for each case."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import evaluation, pipeline, retrieval
from quarryline.providers import Embedder, ExtractiveGenerator, Generator, embed_column
from quarryline.session import saved

#: Share of common words from which an answer counts as right where there is no model to judge it.
LEAST_OVERLAP = 0.5


def _chunks(vectors: DataFrame) -> DataFrame:
    """Chunks with the numbers that search and answers know them by."""
    strict = X.strict_chunk_id("accession_number", "section", "content_type", F.md5(F.col("text").cast("binary")), "chunk_index")
    return vectors.withColumn("vec_id", F.xxhash64(strict)).withColumn("chunk_id", X.chunk_id("accession_number", "chunk_index"))


def retrieval_eval(cases: DataFrame, vectors: DataFrame, embedder: Embedder, k: int = 5) -> tuple[DataFrame, dict[str, object]]:
    """(a row for each case: id, ticker, rank, hit; metrics): where the chunk that a case names comes within its company and year."""
    asked = cases.select(F.col("id").alias("query_id_text"), F.xxhash64("id").alias("query_id"), "question", "source", X.normalize_ticker("directive_params.company").alias("ticker"), F.col("directive_params.year").alias("fiscal_year"))
    chunks = _chunks(vectors)
    terms = saved(embed_column(asked.select("query_id", "question", "ticker", "fiscal_year"), embedder, "question", "query_vec"))
    hits = pipeline.found_for(terms, chunks, k)
    named = hits.join(chunks.select("vec_id", F.col("chunk_id").alias("found")), "vec_id")
    ranks = retrieval.label_ranks(named, asked.select("query_id", F.col("source.chunk_id").alias("expected")), "found")
    per = ranks.join(asked.select("query_id", "query_id_text", "source.ticker"), "query_id").select(F.col("query_id_text").alias("id"), "ticker", "rank", F.col("rank").isNotNull().alias("hit"))
    return per, {"k": k, **retrieval.hit_mrr(per).first().asDict()}


def answer_eval(cases: DataFrame, vectors: DataFrame, embedder: Embedder, generator: Generator | None = None, k: int = 5) -> tuple[DataFrame, dict[str, object]]:
    """(a row for each case: id, answer_type, status, expected, actual, correct; metrics): questions answered end to end.

    Numbers must match within the tolerance; texts are judged by the words they share.
    """
    asked = cases.select(F.xxhash64("id").alias("query_id"), F.col("question").alias("query"))
    found, _ = pipeline.answer_questions(asked, _chunks(vectors), embedder, generator or ExtractiveGenerator(), k)
    both = cases.withColumn("query_id", F.xxhash64("id")).join(found.select("query_id", F.col("text").alias("actual"), "status"), "query_id")
    near = evaluation.token_f1("expected_answer", "actual") >= LEAST_OVERLAP
    right = F.when(F.col("answer_type") == "numeric", X.numeric_match("expected_answer", "actual")).otherwise(near)
    per = both.select("id", "answer_type", "status", F.col("expected_answer").alias("expected"), F.left("actual", F.lit(120)).alias("actual"), right.alias("correct"))
    rates = {("all" if r["level"] == "total" else str(r["answer_type"])): r["accuracy"] for r in evaluation.correctness(per, "answer_type").collect()}  # a row for each type
    return per, {"n": per.count(), **{f"accuracy_{t}": v for t, v in sorted(rates.items())}}


def score_metrics(scored: DataFrame, codes: list[str]) -> dict[str, object]:
    """Accuracy over all, the tally of statuses, and precision, recall and F1 of each code."""
    status = {r["status"]: r["count"] for r in scored.groupBy("status").count().collect()}  # five at most
    report = {r["code"]: {c: r[c] for c in ("precision", "recall", "f1", "support")} for r in evaluation.classification_report(scored, codes).collect()}  # a row for each code
    n = sum(status.values())
    return {"n": n, "accuracy": round(scored.filter("correct").count() / n, 6) if n else 0.0, "statuses": status, "codes": report}


def markdown(title: str, metrics: dict[str, object]) -> str:
    """A scorecard: single metrics in one table, and a table for each group of them."""
    flat = {k: v for k, v in metrics.items() if not isinstance(v, dict)}
    lines = [f"# {title}", "", "| metric | value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in flat.items())]
    for name, group in metrics.items():
        if isinstance(group, dict):
            inner = next((list(v) for v in group.values() if isinstance(v, dict)), ["value"])
            lines += ["", f"## {name}", "", f"| {name} | {' | '.join(inner)} |", "| --- |" + " --- |" * len(inner)]
            lines += [f"| {k} | {' | '.join(str(v[c] if isinstance(v, dict) else v) for c in inner)} |" for k, v in group.items()]
    return "\n".join([*lines, ""])


def write(per: DataFrame, metrics: dict[str, object], title: str, folder: str) -> None:
    """``cases`` (JSON lines), ``metrics`` (JSON) and ``scorecard`` (Markdown) below ``folder``."""
    spark = per.sparkSession
    per.write.mode("overwrite").json(f"{folder}/cases")
    for name, text in (("metrics", json.dumps(metrics)), ("scorecard", markdown(title, metrics))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
