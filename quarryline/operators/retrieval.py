"""Retrieval over directives: filters from parameters, top k, misses, evaluation ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators.vector import batched_search


def search_terms(directives: DataFrame) -> DataFrame:
    """query_id, query and params to the text to embed and the filters; null or empty values filter nothing."""
    company = F.nullif(F.col("params.company"), F.lit(""))
    return directives.select(
        "query_id", "query", X.first_filled("params.fact_requested", "params.concept", "query").alias("embed_text"),
        X.normalize_ticker(company).alias("ticker"), F.col("params.year").cast("int").alias("fiscal_year"),
    )


def retrieve(corpus: DataFrame, queries: DataFrame, k: int = 5, on: str = "label", id_col: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """(hits, misses): hits ranked per query, misses are the queries without any hit."""
    hits = batched_search(corpus, queries, k, on, id_col)
    return hits, queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")


def label_ranks(hits: DataFrame, cases: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """query_id, expected, rank: where the labelled row came, null if not among the hits."""
    named = hits.select("query_id", F.col(id_col).alias("expected"), "rank")
    found = named.join(cases.select("query_id", "expected"), ["query_id", "expected"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return cases.join(found, "query_id", "left").select("query_id", "expected", "rank")


def hit_mrr(ranks: DataFrame) -> DataFrame:
    """One row: n, hits, hit_rate and mrr; zeros for no cases."""
    hit = F.col("rank").isNotNull()
    return ranks.agg(
        F.count("*").alias("n"), F.count_if(hit).alias("hits"),
        F.round(F.coalesce(F.avg(hit.cast("int")), F.lit(0.0)), 6).alias("hit_rate"),
        F.round(F.coalesce(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), F.lit(0.0)), 6).alias("mrr"),
    )


def near_fiscal_year(year: int, slack: int = 1, period_col: str = "period_of_report"):
    """Filings whose period ends in the year or up to ``slack`` years beside it; a range the scan can use."""
    return F.col(period_col).between(f"{year - slack}0101", f"{year + slack}1231")


def research(corpus: DataFrame, plan: DataFrame, vectors: DataFrame, k: int = 3, id_col: str = "vec_id", key: str = "ticker") -> DataFrame:
    """The k best rows for every (query, company, year) of a research plan, with the parts of a query side by side.

    ``plan``: query_id, ticker, fiscal_year; ``vectors``: query_id, query_vec.  Each part is a query of its own
    against the rows of its company and year.
    """
    whole = F.concat_ws("|", F.col(key), F.col("fiscal_year").cast("string"))
    parts = plan.distinct().withColumn("part", whole).withColumn("part_id", F.xxhash64("query_id", "part"))
    asked = parts.join(vectors, "query_id").select(F.col("part_id").alias("query_id"), "query_vec", F.col("part").alias("__part"))
    hits = batched_search(corpus.withColumn("__part", whole), asked, k, "__part", id_col)
    return hits.withColumnRenamed("query_id", "part_id").join(parts, "part_id").select("query_id", key, "fiscal_year", id_col, "score", "rank")


def previews(hits: DataFrame, words: list[str], text_col: str = "text", chars: int = 200) -> DataFrame:
    """``hits`` with ``has_it``, whether the text holds any of ``words`` in any case, and ``preview``, its first characters on one line."""
    low = F.lower(text_col)
    has = [F.contains(low, F.lit(w.lower())) for w in words]
    found = F.coalesce(F.array_max(F.array(*has)), F.lit(False)) if has else F.lit(False)
    return hits.withColumn("has_it", found).withColumn("preview", F.translate(F.left(text_col, F.lit(chars)), "\n", " "))


def embedded_rows(corpus: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """One row: n_rows, and n_embedded with a vector."""
    return corpus.agg(F.count("*").alias("n_rows"), F.count(vec_col).alias("n_embedded"))


def health(corpus: DataFrame) -> dict[str, object]:
    """Whether the corpus can be read: status ``ok`` or ``error`` with the reason, and whether it has any rows."""
    try:
        return {"status": "ok", "empty": corpus.isEmpty()}
    except Exception as e:  # noqa: BLE001  any failure to read is what this reports
        return {"status": "error", "reason": str(e).splitlines()[0]}
