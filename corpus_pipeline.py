"""A training corpus from ``documents``: five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import decontaminate, minhash, quality_classifier, secret_scan, sentencepiece_codec
from quarryline.llm.common import Scratch, own_name, q, table

# Every stage: a null text counts as empty where it isn't said otherwise, rows are judged one by one (so repeated rows
# share their fate) but for near-duplicates, an empty table gives an empty one, further columns pass through whatever their names.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects (score below 0.5); without labels none goes."""
    model = quality_classifier.learn(docs, table(spark, sf_dir, "labels"))
    score = own_name(docs, "score")
    return quality_classifier.score_column(docs, model, score_col=score).filter(F.col(score) >= 0.5).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id in each class of near copies; another text of one id is a document of its own."""
    return minhash.first_of_class(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item; null texts stay."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put ``[kind]`` in place of every secret; ``n_chars`` follows, but for null texts."""
    n = F.coalesce(F.length("text").cast("long"), F.col("n_chars")).alias("n_chars")
    return secret_scan.redacted(docs).select(*(n if c == "n_chars" else F.col(q(c)) for c in docs.columns))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document; null and empty texts have none."""
    out = sentencepiece_codec.encode_column(docs, ids_col="token_ids")
    return out.select("doc_id", "lang", "source", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("secret scans", secrets),
    ("SentencePiece encoding", pieces),
]

#: SQL can express neither the fitted scores nor the sampled near-duplicate search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is a table of the shared folder until the next one is written."""
    docs, held = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        step = Scratch(spark)
        docs = step.table(stage(spark, docs, sf_dir))
        if held:
            held.drop()
        held = step
    return STAGES[-1][1](spark, docs, sf_dir)
