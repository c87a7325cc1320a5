"""Readers and writers: JSON lines, CSV, miss log, corpus table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.schemas import EVAL_CASE, MISS


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str | T.StructType, strict: bool = True, skip_missing: bool = False) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped.

    Malformed lines fail the read if ``strict``, else come as rows of
    ``_corrupt_record``.  ``skip_missing`` leaves out paths that are not there.
    """
    paths = [paths] if isinstance(paths, str) else paths
    if skip_missing:
        paths = [p for p in paths if exists(spark, p)]
        if not paths:
            return spark.createDataFrame([], schema)
    s = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    s = s if strict else T.StructType([*s.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(s).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(paths)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header, quotes and line breaks in cells; all columns strings, empty cells null."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.select(*(F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in df.columns))


def review_rows(cases: DataFrame) -> DataFrame:
    """Evaluation cases flattened for review, every row marked to keep."""
    return cases.select(F.lit("yes").alias("keep"), "id", "question", "expected_answer", "answer_type", "question_type", F.col("source.ticker").alias("src_ticker"), F.col("source.fiscal_year").alias("src_fiscal_year"), F.col("source.section").alias("src_section"), F.col("source.chunk_id").alias("src_chunk_id"))


def reviewed_cases(rows: DataFrame) -> DataFrame:
    """The kept rows of a review, nested again."""
    kept = rows.filter(F.lower(F.trim("keep")) == "yes")
    year = F.col("src_fiscal_year").cast("int")
    return kept.select(
        "id", "question", "expected_answer", "answer_type",
        F.struct(F.col("src_ticker").alias("ticker"), year.alias("fiscal_year"), F.col("src_section").alias("section"), F.col("src_chunk_id").alias("chunk_id")).alias("source"),
        F.struct(F.col("src_ticker").alias("company"), year.alias("year")).alias("directive_params"), "question_type",
    ).to(T.StructType.fromDDL(EVAL_CASE))


def append_misses(misses: DataFrame, path: str) -> None:
    """Append (query, filters) with the time of the write."""
    misses.select((F.unix_micros(F.current_timestamp()) / 1e6).alias("ts"), "query", "filters").to(T.StructType.fromDDL(MISS)).write.mode("append").json(path)


def append_vectors(chunks: DataFrame, path: str, force: bool = False) -> None:
    """Add embedded chunks whose accession is not stored yet; ``force`` replaces the table."""
    spark = chunks.sparkSession
    if not force and exists(spark, path):
        chunks = chunks.join(spark.read.parquet(path).select("accession_number").distinct(), "accession_number", "left_anti")
    chunks.write.mode("overwrite" if force else "append").partitionBy("ticker", "fiscal_year").parquet(path)


def create_chunk_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"""CREATE TABLE IF NOT EXISTS {name} (id BIGINT, filing_type STRING NOT NULL, period_of_report STRING, accession_number STRING NOT NULL, section STRING,
      content_type STRING NOT NULL, chunk_index INT NOT NULL, n_tokens INT NOT NULL, text STRING NOT NULL, embedding ARRAY<FLOAT>, ticker STRING NOT NULL, fiscal_year INT NOT NULL)
      USING parquet PARTITIONED BY (ticker, fiscal_year)""")
