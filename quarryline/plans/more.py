"""Queries of the smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import answers, dataset, retrieval
from quarryline.plans.registry import query, table


@query("SELECT event_type, count(*) AS n FROM (SELECT CASE WHEN event_id % 9 = 0 THEN 'PARSE_ERROR' ELSE event_type END AS event_type FROM events) WHERE event_type IN ('click', 'view') GROUP BY event_type")
def quarantine_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 9 == 0, "PARSE_ERROR").otherwise(F.col("event_type")).alias("event_type"))
    return dataset.quarantine(labels, ("click", "view"), "event_type")[0].groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS period FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996")
def fiscal_year_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("period"))
    return o.filter(retrieval.near_fiscal_year(1995, 1, "period"))


@query("""WITH p AS (SELECT DISTINCT l.label, y.half FROM (VALUES (0), (1), (2)) l(label), (VALUES (0), (1)) y(half)), q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (SELECT p.label, p.half, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY p.label, p.half ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank
 FROM p JOIN embeddings e ON e.label = p.label AND e.vec_id % 2 = p.half, q)
SELECT label::VARCHAR AS ticker, half::INT AS fiscal_year, vec_id, score, rank::INT AS rank FROM s WHERE rank <= 3""")
def research_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question over three companies and two years: the three best rows of each."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("ticker"), (F.col("vec_id") % 2).cast("int").alias("fiscal_year"))
    plan = spark.createDataFrame([(0, str(a), b) for a in range(3) for b in range(2)], "query_id long, ticker string, fiscal_year int")
    vec = emb.orderBy("vec_id").limit(1).select(F.lit(0).cast("long").alias("query_id"), F.col("embedding").alias("query_vec"))
    hits = retrieval.research(emb, plan, vec, 3)
    return hits.select("ticker", "fiscal_year", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT lang, count(*) AS n_rows, count(DISTINCT trim(lower(text))) AS n_unique FROM documents GROUP BY lang")
def weak_duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates under the weaker normal form (case and ends only)."""
    per = table(spark, sf_dir, "documents").select("lang", F.md5(F.trim(F.lower("text")).cast("binary")).alias("k")).groupBy("lang", "k").count()
    return per.groupBy("lang").agg(F.sum("count").alias("n_rows"), F.count("*").alias("n_unique"))


@query("SELECT doc_id, length(regexp_replace(regexp_replace(f, '^```[^\\n]*\\n?', ''), '\\s*```\\s*$', '')) AS n FROM (SELECT doc_id, '```json' || chr(10) || lang || source || chr(10) || '```' AS f FROM documents)")
def strip_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), "lang", "source", F.lit("\n```"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(X.strip_fences(fenced)).cast("long").alias("n"))


@query("SELECT doc_id, 'system,user,assistant,user' AS roles, md5('Classify.' || chr(10) || 'one' || chr(10) || '{}' || chr(10) || text) AS contents_md5 FROM documents")
def prompt_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole prompt of each text: system text, a worked example, the text itself."""
    m = table(spark, sf_dir, "documents").select("doc_id", answers.chat_messages("text", "Classify.", [("one", "{}")]).alias("m"))
    part = lambda name: F.transform("m", lambda t: t[name])
    return m.select("doc_id", F.array_join(part("role"), ",").alias("roles"), F.md5(F.array_join(part("content"), "\n").cast("binary")).alias("contents_md5"))
