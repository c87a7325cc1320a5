"""Queries through files: staged filings, incremental corpus runs, the miss log, vectors kept beside their chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import ingest
from quarryline.operators.numbering import zip_rows
from quarryline.plans.ingest import _ACC, _OK, _submissions
from quarryline.plans.registry import query, table
from quarryline.session import drop_at_exit, saved, shared_folder
from quarryline.sources import datasource, files


def _folder(spark: SparkSession, stem: str) -> str:
    path = f"{shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    drop_at_exit(spark, path)
    datasource.register(spark)
    return path


def _stage(submissions: DataFrame, folder: str) -> None:
    submissions.select("path", "content").write.format("submissions").mode("append").save(folder)


@query(f"SELECT {_ACC} AS accession_number, CASE WHEN doc_id % 9 = 1 THEN NULL ELSE 2000 + doc_id % 20 END::INT AS fiscal_year, CASE WHEN doc_id % 11 = 3 THEN 'no_ticker_in_path' WHEN doc_id % 9 = 0 THEN 'no_document' WHEN doc_id % 9 = 2 THEN 'no_text' WHEN doc_id % 9 = 1 THEN 'missing_period_of_report' ELSE 'ok' END AS status FROM documents")
def filing_folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of filings, a file each, read through the data source and unwrapped."""
    folder = _folder(spark, "filings")
    _stage(_submissions(spark, sf_dir), folder)
    return ingest.unwrap(spark.read.format("submissions").load(folder)).select("accession_number", "fiscal_year", "status")


@query(f"""WITH d AS (SELECT *, {_OK} AND regexp_matches(text, '[^\\s]') AS good, NOT ({_OK}) AS bad FROM documents)
SELECT 1 AS run, count(*) FILTER (good AND doc_id % 2 = 0) AS processed, count(*) FILTER (doc_id % 2 = 0 AND NOT bad AND NOT good) AS skipped, count(*) FILTER (bad AND doc_id % 2 = 0) AS errors FROM d
UNION ALL SELECT 2, count(*) FILTER (good AND doc_id % 2 = 1), count(*) FILTER (NOT bad AND NOT (good AND doc_id % 2 = 1)), count(*) FILTER (bad) FROM d
UNION ALL SELECT 3, 0, count(*) FILTER (NOT bad), count(*) FILTER (bad) FROM d""")
def corpus_delta_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over a growing folder: half of the filings, all of them, and all once more."""
    folder, subs = _folder(spark, "filings"), _submissions(spark, sf_dir)
    even = F.conv(F.substring(F.element_at(F.split("path", "/"), -2), -6, 6), 10, 10).cast("long") % 2 == 0
    listed = lambda spark, root: spark.read.format("submissions").load(root)  # noqa: E731  a folder for each file: one listing, no task for each
    out = []
    for run, part in ((1, subs.filter(even)), (2, subs.filter(~even)), (3, None)):
        if part is not None:
            _stage(part, folder)
        n = ingest.chunk_corpus(spark, folder, f"{folder}-corpus", read=listed)
        out.append((run, n["processed"], n["skipped"], n["errors"]))
    drop_at_exit(spark, f"{folder}-corpus")
    return spark.createDataFrame(out, "run int, processed long, skipped long, errors long")


@query(f"SELECT upper(lang) AS ticker, count(*) AS n FROM documents WHERE {_OK} GROUP BY ALL")
def stream_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings by company from a stream over a folder, stopped and gone on with when more files have come."""
    folder, subs = _folder(spark, "filings"), _submissions(spark, sf_dir)
    late = F.crc32(F.col("path").cast("binary")) % 3 == 0
    for part in (subs.filter(~late), subs.filter(late)):
        _stage(part, folder)
        found = ingest.unwrap(spark.readStream.format("submissions").load(folder)).select("ticker", "accession_number", "status")
        found.writeStream.format("parquet").option("path", f"{folder}-out").option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start().awaitTermination()
    for rest in ("out", "state"):
        drop_at_exit(spark, f"{folder}-{rest}")
    return spark.read.parquet(f"{folder}-out").filter("status = 'ok'").groupBy("ticker").agg(F.count("*").alias("n"))


@query("SELECT event_type AS query, 'u' || (user_id % 7)::VARCHAR AS company, 2 * count(*) AS n FROM events GROUP BY ALL")
def miss_log_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misses appended twice through the log's writer and counted from its commits."""
    folder = _folder(spark, "misses")
    misses = table(spark, sf_dir, "events").select((F.col("event_id") * 1.0).cast("double").alias("ts"), F.col("event_type").alias("query"), F.create_map(F.lit("company"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string"))).alias("filters"))
    for _ in range(2):
        misses.write.format("misses").mode("append").save(folder)
    return spark.read.format("misses").load(folder).groupBy("query", F.col("filters")["company"].alias("company")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents), v AS (SELECT doc_id AS other_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS pos FROM documents)
SELECT a.pos, doc_id, other_id, n_chars FROM a JOIN v USING (pos)""")
def zip_two_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row i of a file beside row i of another one that was written with other partitions and in another order."""
    docs = table(spark, sf_dir, "documents")
    left, right = saved(docs.select("doc_id").repartition(7)), saved(docs.select(F.col("doc_id").alias("other_id"), "n_chars").repartition(5))
    return zip_rows(left, right, ["doc_id"], ["n_chars", "other_id"])


@query("""SELECT upper(lang) AS ticker, (2000 + doc_id % 20)::INT AS fiscal_year, CASE WHEN (doc_id // 3) % 2 = 0 THEN 1 ELSE 2 END AS run, count(*) AS n FROM documents GROUP BY ALL""")
def vector_delta_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads of a vector table: the second brings all filings, those already stored with other text, and adds the others only."""
    folder = _folder(spark, "vectors")
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.upper("lang").alias("ticker"), (2000 + n % 20).cast("int").alias("fiscal_year"), F.format_string("%010d", F.floor(n / 3)).alias("accession_number"), "text", (F.floor(n / 3) % 2 == 0).alias("early"))
    files.append_vectors(rows.filter("early").drop("early").withColumn("run", F.lit(1)), f"{folder}/v")
    files.append_vectors(rows.drop("early").withColumns({"run": F.lit(2), "text": F.concat(F.lit("new "), "text")}), f"{folder}/v")
    return spark.read.parquet(f"{folder}/v").groupBy("ticker", "fiscal_year", "run").agg(F.count("*").alias("n"))
