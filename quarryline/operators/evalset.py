"""Evaluation sets from chunks: a stratified sample of dense ones, a question and an answer for each."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions import text as X
from quarryline.operators.chunking import dense
from quarryline.operators.dataset import stratified_sample
from quarryline.schemas import DENSE_SECTIONS, EVAL_CASE
from quarryline.session import ship


class QuestionWriter(ABC):
    @abstractmethod
    def write(self, passage: str) -> str:
        """JSON text with question, expected_answer and answer_type."""


class FirstNumberWriter(QuestionWriter):
    """Asks for the first number of a passage, or for its first words: an offline stand-in."""

    def write(self, passage: str) -> str:
        words = passage.split()
        number = next((w for w in words if any(c.isdigit() for c in w)), None)
        kind = "numeric" if number else "text"
        return json.dumps({"question": f"What does the passage on {' '.join(words[:5])} state?", "expected_answer": number or " ".join(words[:8]), "answer_type": kind})


def eval_cases(chunks: DataFrame, writer: QuestionWriter, n: int = 40, max_chars: int = 4000, least_tokens: int = 80, seed: int = 42) -> DataFrame:
    """Evaluation cases of about ``n`` dense chunks, spread over tickers; answers that are no JSON are left out."""
    keyed = dense(chunks, DENSE_SECTIONS, least_tokens).withColumn("chunk_id", X.chunk_id("accession_number", "chunk_index")).withColumn("key", F.md5(F.concat_ws("|", "chunk_id", "section", "text").cast("binary")))
    picked = stratified_sample(keyed, "ticker", "key", n, seed).withColumn("passage", F.left("text", F.lit(max_chars)))
    rows = picked.select("key", "passage", "ticker", "fiscal_year", "section", "chunk_id")
    ship(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [writer.write(p or "") for p in b.column("passage").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "ticker", "fiscal_year", "section", "chunk_id")), pa.array(raw, pa.string())], names=["key", "ticker", "fiscal_year", "section", "chunk_id", "raw"])

    out = rows.mapInArrow(run, "key string, ticker string, fiscal_year int, section string, chunk_id string, raw string")
    p = F.from_json(X.strip_fences("raw"), "question string, expected_answer string, answer_type string")
    source = F.struct("ticker", "fiscal_year", "section", "chunk_id").alias("source")
    params = F.struct(F.col("ticker").alias("company"), F.col("fiscal_year").alias("year")).alias("directive_params")
    made = out.withColumn("p", p).filter("p.question IS NOT NULL")
    return made.select(F.concat(F.lit("eval_"), F.left("key", F.lit(8))).alias("id"), "p.question", "p.expected_answer", "p.answer_type", source, params, F.lit("lookup_fact").alias("question_type")).to(T.StructType.fromDDL(EVAL_CASE))
