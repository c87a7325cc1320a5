"""Queries over ``embeddings``: search, ranks, retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import answers, graph, retrieval, vector
from quarryline.plans.registry import query, table
from quarryline.session import saved

_COS = "round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
_BATCH = f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
      FROM embeddings e JOIN q ON {{on}})"""


def _probe(spark: SparkSession, sf_dir: str):
    """The row of least id: its vector and label are the query."""
    row = table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding", "label").first()
    return (list(row[0]), row[1]) if row else ([0.0], None)


def _top(spark: SparkSession, sf_dir: str, filtered: bool, k: int = 5) -> DataFrame:
    vec, label = _probe(spark, sf_dir)
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    rounded = emb.withColumn("score", F.round(X.cosine("embedding", F.array(*(F.lit(float(x)) for x in vec))), 6))
    kept = rounded.filter(X.equals_all({"label": label} if filtered else {}, ("label",))).filter("embedding IS NOT NULL")
    return kept.select("vec_id", "label", "score").orderBy(F.desc("score"), "vec_id").limit(k)


_Q0 = "(SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) q"


@query(f"SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, {_Q0} WHERE e.label = q.label ORDER BY score DESC, e.vec_id LIMIT 5")
def vec_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, True)


@query(f"SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, {_Q0} ORDER BY score DESC, e.vec_id LIMIT 5")
def vec_topk_unfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir, False)


@query("SELECT 'declined' AS status, 'no matching filings in corpus' AS reason, 0::BIGINT AS n_hits WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE label = -1)")
def vec_topk_empty_decline(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = vector.search(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir)[0], 5, {"label": -1})
    return hits.agg(F.count("*").alias("n_hits")).filter("n_hits = 0").select(F.lit("declined").alias("status"), F.lit("no matching filings in corpus").alias("reason"), "n_hits")


def _batched(spark: SparkSession, sf_dir: str, k: int, on: str | None, optional: bool = False) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 40 == 0, F.col("label")) if optional else F.col("label")
    queries = emb.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), label.alias("label"))
    return vector.batched_search(emb, queries, k, on, digits=6)


@query(_BATCH.format(on="e.label = q.label") + " SELECT query_id, vec_id, score, rank::INT AS rank FROM s WHERE rank <= 5")
def vec_topk_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batched(spark, sf_dir, 5, "label")


@query(_BATCH.format(on="q.vec_id % 40 <> 0 OR e.label = q.label") + " SELECT query_id, vec_id, score, rank::INT AS rank FROM s WHERE rank <= 5")
def vec_topk_optional_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the queries filter by label, the others don't."""
    return _batched(spark, sf_dir, 5, "label", optional=True)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) < 1e-3 AS is_unit FROM embeddings")
def vec_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = X.norm("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(n, 6).alias("norm"), (F.abs(n - 1) < 1e-3).alias("is_unit"))


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases: every 20th row looks for the next id of its label's rows."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return emb.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") + 1).alias("expected"))


_RANKS = _BATCH.format(on="e.label = q.label") + ", r AS (SELECT q.vec_id AS query_id, q.vec_id + 1 AS expected, (SELECT min(rank) FROM s WHERE s.query_id = q.vec_id AND s.vec_id = q.vec_id + 1 AND rank <= 20) AS rank FROM q)"


@query(_RANKS + " SELECT query_id, expected, coalesce(rank, 0)::INT AS rank, rank IS NOT NULL AS found FROM r")
def vec_rank_of_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = retrieval.label_ranks(_batched(spark, sf_dir, 20, "label"), _expected(spark, sf_dir))
    return ranks.select("query_id", "expected", F.coalesce("rank", F.lit(0)).alias("rank"), F.col("rank").isNotNull().alias("found"))


@query(_RANKS + " SELECT count(*) AS n, count(rank) AS hits, round(coalesce(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1 END), 0), 6) AS hit_rate, round(coalesce(avg(coalesce(1.0::DOUBLE / rank, 0)), 0), 6) AS mrr FROM r")
def retrieval_hit_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hit_mrr(retrieval.label_ranks(_batched(spark, sf_dir, 20, "label"), _expected(spark, sf_dir)))


@query(f"""WITH s AS (SELECT e.vec_id, {_COS} AS full_score, round(list_cosine_similarity((e.embedding[1:32])::DOUBLE[], (q.embedding[1:32])::DOUBLE[]), 6) AS half_score FROM embeddings e, {_Q0}),
r AS (SELECT vec_id, row_number() OVER (ORDER BY full_score DESC, vec_id) AS full_rank, row_number() OVER (ORDER BY half_score DESC, vec_id) AS half_rank FROM s)
SELECT vec_id, full_rank::INT AS full_rank, half_rank::INT AS half_rank, (half_rank - full_rank)::INT AS delta FROM r WHERE full_rank <= 20 AND half_rank <= 20""")
def vec_rank_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks under two query vectors (whole and first half), for rows within both first 20."""
    vec, _ = _probe(spark, sf_dir)
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")

    def top(n: int, name: str) -> DataFrame:
        q = F.array(*(F.lit(float(x)) for x in vec[:n]))
        score = F.round(X.cosine(F.slice("embedding", 1, n), q), 6)
        best = emb.select(F.lit(0).alias("query_id"), "vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)
        return vector.ranked(best, 20).select("vec_id", F.col("rank").alias(name))

    return top(len(vec), "full_rank").join(top(min(32, len(vec)), "half_rank"), "vec_id").withColumn("delta", F.col("half_rank") - F.col("full_rank"))


@query("""WITH k AS (SELECT vec_id, label::VARCHAR || '#' || (vec_id % 10)::VARCHAR AS loose, label::VARCHAR || '|' || vec_id::VARCHAR AS strict FROM embeddings)
SELECT count(DISTINCT loose) AS n_loose, count(DISTINCT strict) AS n_strict, count(*) AS n_rows FROM k""")
def vec_dup_key_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows the loose chunk key and the strict one tell apart."""
    keys = table(spark, sf_dir, "embeddings").select(X.chunk_id(F.col("label").cast("string"), F.col("vec_id") % 10).alias("loose"), F.concat_ws("|", F.col("label").cast("string"), F.col("vec_id").cast("string")).alias("strict"))
    loose = keys.groupBy("loose").count().agg(F.count("*").alias("n_loose"))
    strict = keys.groupBy("strict").count().agg(F.count("*").alias("n_strict"), F.sum("count").alias("n_rows"))
    return strict.join(F.broadcast(loose)).select("n_loose", "n_strict", "n_rows")


def _recall(near: DataFrame, exact: DataFrame, read_share: Column) -> DataFrame:
    """How much of the exact result was found, and the share of the vectors' bytes that was read for a query."""
    both = exact.select("query_id", "vec_id").join(near.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_exact"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"), F.round(read_share, 4).alias("read_share"))


def _every_20th(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return emb, emb.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


# No SQL for the three indexes: what an approximate search finds isn't said by a statement.  Tests hold recall and reads to bounds.


@query()
def ivf_topk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the inverted file finds of the exact top 10, every 20th row as query.

    These vectors are alike in all directions, so that two thirds of the cells are needed; where there are clusters a tenth
    of them is enough (tests/test_pipelines.py).
    """
    emb, queries = _every_20th(spark, sf_dir)
    cells = max(1, int(emb.count() ** 0.5))
    centres = vector.fit_cells(emb, cells)
    probes = max(1, -(-cells * 2 // 3))
    near = vector.cell_search(vector.index_cells(emb, centres), queries, centres, 10, probes=probes)
    return _recall(near, vector.batched_search(emb, queries, 10), F.lit(probes / cells))


@query()
def code_topk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan of one byte a dimension, ranked by the vectors of its best, finds of the exact top 10."""
    emb, queries = _every_20th(spark, sf_dir)
    n = emb.count()
    return _recall(vector.code_search(vector.index_codes(emb), emb, queries, 10), vector.batched_search(emb, queries, 10), F.lit(0.25 + min(40, n) / max(n, 1)))


@query()
def graph_topk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk over the neighbour graph finds of the exact top 10, and how many of the vectors it reads."""
    emb, queries = _every_20th(spark, sf_dir)
    rows = saved(graph.unit_rows(emb))
    hits, read = graph.graph_search(graph.build_graph(rows), rows, graph.unit_rows(queries, "query_id", "query_vec"), 10)
    share = read.count() / max(queries.count() * rows.count(), 1)
    return _recall(hits.withColumnRenamed("id", "vec_id"), vector.batched_search(emb, queries, 10), F.lit(share))


@query(_BATCH.format(on="e.label = q.label") + """
SELECT query_id, string_agg('[' || rank::VARCHAR || '] LABEL' || q.label::VARCHAR || chr(10) || 'row ' || s.vec_id::VARCHAR, chr(10) || chr(10) ORDER BY rank) AS context FROM s JOIN q ON s.query_id = q.vec_id WHERE rank <= 3 GROUP BY query_id""")
def context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    hits = _batched(spark, sf_dir, 3, "label").join(emb.select("vec_id", "label"), "vec_id")
    shaped = hits.select("query_id", "rank", F.concat(F.lit("LABEL"), F.col("label").cast("string")).alias("head"), F.concat(F.lit("row "), F.col("vec_id").cast("string")).alias("text"))
    return answers.context_blocks(shaped)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered exact cosine top-k as an answer: status, sources and scores."""
    top = _top(spark, sf_dir, True)
    return top.agg(
        F.when(F.count("*") > 0, "ok").otherwise("declined").alias("status"), F.lit("lookup").alias("action_code"), F.count("*").alias("n_sources"),
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("by"), "vec_id", "label", "score"))).alias("sources"),
    )
