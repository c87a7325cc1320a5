"""Command line, one step of the engine each: ``spark-submit quarryline/cli.py STEP ...``; ``STEP --help`` names its options."""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarryline", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def step(name: str, text: str, *paths: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=text)
        for x in paths:
            c.add_argument(f"--{x}", required=True)
        return c

    c = step("chunk", "add the new filings under a folder to a corpus", "root", "corpus")
    c.add_argument("--force", action="store_true", help="build the corpus anew")
    c.add_argument("--quiet", action="store_true")
    step("embed", "give the chunks of a corpus vectors and add the new ones to a table of vectors", "corpus", "vectors").add_argument("--force", action="store_true")
    step("dedup", "keep the first of each repeated query within its code", "queries", "out")
    step("label", "label queries with the offline labeler and say which agree", "queries", "out")
    step("overrides", "apply a table of overrides (norm, new_code) to labels", "labels", "overrides", "out")
    c = step("splits", "write stratified splits, unless a gate fails", "labels", "out")
    c.add_argument("--instruction", default="Classify the query.")
    step("eval-set", "make evaluation cases of a corpus", "corpus", "out").add_argument("--n", type=int, default=40)
    c = step("eval-retrieval", "hit rate and MRR of evaluation cases over a table of vectors", "cases", "vectors", "out")
    c.add_argument("--k", type=int, default=5)
    step("eval-answers", "answer evaluation cases and judge the answers", "cases", "vectors", "out").add_argument("--k", type=int, default=5)
    step("score", "score raw model outputs (query, raw_output, truth)", "outputs", "out")
    step("health", "whether a table can be read", "vectors")
    sub.add_parser("queries", help="names of all queries")
    c = step("run", "run a query over a folder of tables and show its rows", "tables")
    c.add_argument("name")
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    from quarryline.plans.catalogue import QUERIES

    if a.command == "queries":
        print("\n".join(sorted(QUERIES)))
        return 0
    from pyspark.sql import functions as F

    from quarryline import schemas
    from quarryline.functions import text as X
    from quarryline.operators import dataset, evalset, evaluation, reports, retrieval
    from quarryline.providers import HashedEmbedder, JsonLabeler, embed_column, label_column
    from quarryline.session import local_session
    from quarryline.sources import files

    spark = local_session()
    began = time.monotonic()
    if a.command == "run":
        QUERIES[a.name](spark, a.tables).show(truncate=80)
    elif a.command == "chunk":
        from quarryline.operators.ingest import chunk_corpus

        done = chunk_corpus(spark, a.root, a.corpus, a.force)
        if not a.quiet:
            print(", ".join(f"{k}: {v}" for k, v in done.items()))
        return 1 if done["errors"] else 0
    elif a.command == "embed":
        files.append_vectors(embed_column(spark.read.parquet(a.corpus), HashedEmbedder()), a.vectors, a.force)
    elif a.command == "dedup":
        rows = files.read_jsonl(spark, a.queries, "code string, query string, batch_id int")
        files.write_jsonl(dataset.keep_first(rows, ["code"], "query", "batch_id"), a.out)
        dataset.duplicate_rates(rows, "code", "query").show()
    elif a.command == "label":
        rows = files.read_jsonl(spark, a.queries, "code string, query string, batch_id int")
        p = X.parse_action("raw_output")
        labelled = label_column(rows, JsonLabeler()).select("query", F.col("code").alias("intended_code"), F.coalesce(p.getField("code"), F.lit("PARSE_ERROR")).alias("predicted_code"), F.lit("{}").alias("params"), F.lit("").alias("reasoning"))
        files.write_jsonl(labelled.withColumn("agrees", F.col("intended_code") == F.col("predicted_code")), a.out)
    elif a.command == "overrides":
        labels, new = files.read_jsonl(spark, a.labels, schemas.LABELED), files.read_jsonl(spark, a.overrides, "norm string, new_code string")
        files.write_jsonl(dataset.apply_overrides(labels.drop("override_applied"), new), a.out)
        dataset.unmatched_overrides(labels, new).show()
    elif a.command == "splits":
        labels, _ = dataset.quarantine(files.read_jsonl(spark, a.labels, schemas.LABELED), schemas.ACTION_CODES)
        rows = dataset.stratified_split(labels.withColumn("key", F.md5(X.squeeze("query").cast("binary"))), "predicted_code", "key")
        gates = dataset.split_gates(rows, labels.count(), list(schemas.ACTION_CODES), "predicted_code", "key")
        record = dataset.instruction_record(rows, a.instruction, "query", "split")
        try:
            dataset.write_if_clean(record, gates, a.out)
        except ValueError as e:
            print(e)
            return 1
    elif a.command == "eval-set":
        files.write_jsonl(evalset.eval_cases(spark.read.parquet(a.corpus), evalset.FirstNumberWriter(), a.n), a.out)
    elif a.command in ("eval-retrieval", "eval-answers"):
        cases, vectors = files.read_jsonl(spark, a.cases, schemas.EVAL_CASE), spark.read.parquet(a.vectors)
        if a.command == "eval-retrieval":
            per, metrics = reports.retrieval_eval(cases, vectors, HashedEmbedder(), a.k)
        else:
            per, metrics = reports.answer_eval(cases, vectors, HashedEmbedder(), k=a.k)
        metrics["elapsed_s"] = round(time.monotonic() - began, 1)
        reports.write(per, metrics, a.command, a.out)
        print(metrics)
    elif a.command == "score":
        per = evaluation.score_outputs(files.read_jsonl(spark, a.outputs, "query string, raw_output string, truth string"), schemas.ACTION_CODES)
        metrics = reports.score_metrics(per, list(schemas.ACTION_CODES))
        reports.write(per, metrics, "score", a.out)
        print(metrics)
    elif a.command == "health":
        state = retrieval.health(spark.read.parquet(a.vectors)) if files.exists(spark, a.vectors) else {"status": "error", "reason": "no such table"}
        print(state)
        return 0 if state["status"] == "ok" else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
