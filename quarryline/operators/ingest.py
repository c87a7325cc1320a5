"""Filings to chunks: unwrap, parse, tag sections, pack; only filings not yet in the corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.functions.elements import explode_elements
from quarryline.operators.chunking import OVERLAP, TARGET, TokenCounter, chunk_records, word_count
from quarryline.session import release, saved
from quarryline.sources.files import exists

META = ("ticker", "filing_type", "fiscal_year", "period_of_report", "accession_number")


def read_submissions(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every submission under ``root``; fails if there are none."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "full-submission.txt").text(root, wholetext=True)
    df = df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")).filter(F.col("path").contains("/10-K/"))
    if df.isEmpty():
        raise ValueError(f"no submissions under {root}")
    return df


def unwrap(submissions: DataFrame) -> DataFrame:
    """META, html and status; a bad filing becomes a row with its error and never fails the job."""
    once = lambda c: F.explode(F.array(c))  # noqa: E731  a row of its own, so that no later column or filter runs the patterns again
    df = submissions.select("path", "content", once(X.first_document("content")).alias("first"))
    df = df.select("path", once(F.struct(X.header_fields("content").alias("head"), X.document_html(F.col("first")).alias("doc"))).alias("both"))
    df = df.select("path", "both.head", "both.doc")
    ticker = X.ticker_from_path("path")
    status = F.when(ticker.isNull(), "no_ticker_in_path").when(F.col("doc.status") != "ok", F.col("doc.status")).otherwise(F.col("head.status"))
    return df.select(ticker.alias("ticker"), "head.filing_type", "head.fiscal_year", "head.period_of_report", X.accession_from_path("path").alias("accession_number"), "doc.html", status.alias("status"))


def section_records(elements: DataFrame, keys: tuple[str, ...] = META, order_by: tuple[str, ...] = ("accession_number",)) -> DataFrame:
    """keys, record_pos, section, content_type, text from ordered elements (pos, type, element_text).

    A title that names an item opens a run and is consumed; its section holds
    until the next one.  The narrative of a run becomes one record behind the
    run's tables; a section met again opens a second record.
    """
    w = Window.partitionBy(*order_by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    clean = X.strip_space(X.plain_spaces("element_text"))
    df = elements.withColumn("t", clean)
    opens = F.when(F.col("type").isin("TopSectionTitle", "Title"), X.item_section("t"))
    df = df.withColumn("opens", opens).withColumn("run", F.sum(F.when(F.col("opens").isNotNull(), 1).otherwise(0)).over(w)).withColumn("section", F.last("opens", ignorenulls=True).over(w)).filter("opens IS NULL")
    # one row for each record by one aggregation: a table is a group of its own, the texts of a run are one
    table = F.col("type") == "Table"
    kept = df.filter("type = 'Table' OR type IN ('Text', 'Supplementary') AND t <> ''")
    kept = kept.withColumns({"slot": F.when(table, F.col("pos")), "piece": F.when(table, F.col("element_text")).otherwise(F.col("t"))})
    records = kept.groupBy(*keys, "run", "section", "slot").agg(F.expr("listagg(piece, '\n\n') WITHIN GROUP (ORDER BY pos)").alias("text"), F.min("pos").alias("at"))
    late = F.col("slot").isNull()
    place = Window.partitionBy(*order_by).orderBy("run", late, "at")
    return records.select(*keys, "section", F.when(late, "narrative").otherwise("table").alias("content_type"), "text", (F.row_number().over(place) - 1).alias("record_pos"))


def parsed(unwrapped: DataFrame) -> DataFrame:
    """Elements of the filings without an error, each parsed once."""
    html = F.when(F.col("status") == "ok", F.col("html"))
    return explode_elements(unwrapped.select(*META, html.alias("html")))


def chunk_filings(submissions: DataFrame, done: DataFrame | None = None, target: int = TARGET, overlap: int = OVERLAP, count: TokenCounter = word_count, sizes_for: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, errors) of the submissions whose accession is not in ``done``; the anti join comes before parsing."""
    return _chunks_and_errors(unwrap(_new(submissions, done)), target=target, overlap=overlap, count=count, sizes_for=sizes_for)


def _new(submissions: DataFrame, done: DataFrame | None) -> DataFrame:
    todo = submissions.withColumn("accession_number", X.accession_from_path("path"))
    return todo if done is None else todo.join(done.select("accession_number").distinct(), "accession_number", "left_anti")


def _chunks_and_errors(unwrapped: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    errors = unwrapped.filter("status <> 'ok'").select("ticker", "accession_number", "status")
    return chunk_records(section_records(parsed(unwrapped)), **options).drop("first_unit", "end_unit"), errors


def chunk_corpus(spark: SparkSession, root: str, corpus: str, force: bool = False, read: Callable[[SparkSession, str], DataFrame] | None = None, **options) -> dict[str, int]:
    """Append the new filings under ``root`` to the corpus table; counts of processed, skipped and failed ones.

    The state is the corpus itself, and a run commits as one job: a crash
    leaves no half of a filing behind.

    A run opens each file once: the pass that unwraps the new filings into a table counts all of them.  The chunks of a
    company and year go to few files, so that the next run has few to list; large ones are split.  ``read`` gives (path, content)
    of all files under ``root`` (``read_submissions`` by default).
    """
    seen = Observation()
    subs = (read or read_submissions)(spark, root).observe(seen, F.count("*").alias("n"))
    done = saved(spark.read.parquet(corpus).select("accession_number").distinct()) if exists(spark, corpus) and not force else None
    unwrapped = saved(unwrap(_new(subs, done)))
    chunks, errors = _chunks_and_errors(unwrapped, **options)
    before = done.count() if done is not None else 0
    chunks.hint("rebalance", "ticker", "fiscal_year").write.mode("overwrite" if force else "append").partitionBy("ticker", "fiscal_year").parquet(corpus)
    after = spark.read.parquet(corpus).select("accession_number").distinct().count()
    failed, total = errors.count(), seen.get["n"]
    for df in (unwrapped, *([done] if done is not None else [])):
        release(df)
    return {"processed": after - before, "skipped": total - failed - (after - before), "errors": failed}


def accession_mismatches(submissions: DataFrame) -> DataFrame:
    """path, accession_number and header_accession of filings whose folder and header disagree or are malformed."""
    head = F.nullif(F.regexp_extract(F.substring("content", 1, 4000), r"(?m)^ACCESSION NUMBER:\s*(\S+)", 1), F.lit(""))
    df = submissions.select("path", X.accession_from_path("path").alias("accession_number"), head.alias("header_accession"))
    return df.filter(~F.col("accession_number").eqNullSafe(F.col("header_accession")) | ~F.coalesce(X.valid_accession("accession_number"), F.lit(False)))
