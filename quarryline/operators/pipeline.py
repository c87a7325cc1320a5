"""From a question to its answer in one run, over the operators of routing, retrieval and answers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators import answers, retrieval
from quarryline.operators.compute import computed_answers
from quarryline.operators.vector import batched_search
from quarryline.providers import Embedder, Generator, embed_column
from quarryline.session import saved, ship


def generate_column(df: DataFrame, generator: Generator, query_col: str = "query", context_col: str = "context", out_col: str = "answer_text") -> DataFrame:
    """``df`` with the generator's answer for each query and context; rows stay in their tasks."""
    ship(df.sparkSession)
    rest = df.drop(out_col)
    names = rest.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), f"`{out_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [generator.generate(q or "", c or "") for q, c in zip(b.column(query_col).to_pylist(), b.column(context_col).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(text, pa.string())], names=[*names, out_col])

    return rest.mapInArrow(run, schema)


def directives(questions: DataFrame) -> DataFrame:
    """query_id, query, code, reason, params, company, clarifying_question of (query_id, query), by the offline rules.

    The first company and the first year that a question names are its parameters.
    """
    words = F.regexp_extract_all("query", F.lit(answers.WORD), F.lit(0))
    named = lambda p: F.get(F.filter(words, lambda w: w.rlike(p)), F.lit(0))
    none = F.lit(None).cast("string")
    params = F.struct(named(answers.COMPANY).alias("company"), named(answers.YEAR).cast("int").alias("year"), none.alias("fact_requested"), none.alias("concept"))
    routed = questions.select("query_id", "query", answers.route("query").alias("r"), params.alias("params"))
    return routed.select("query_id", "query", "r.code", "r.reason", "params", "params.company", none.alias("clarifying_question"))


def found_for(terms: DataFrame, corpus: DataFrame, k: int = 5, id_col: str = "vec_id") -> DataFrame:
    """Hits (query_id, vec_id, score, rank) within the company, and the year if there is one, of each of ``terms`` (query_id, query_vec, ticker, fiscal_year).

    ``corpus`` has ticker, fiscal_year and embedding; a query without company searches all rows.
    """
    both = F.concat_ws("|", "ticker", F.col("fiscal_year").cast("string"))
    dated = terms.filter("ticker IS NOT NULL AND fiscal_year IS NOT NULL").select("query_id", "query_vec", both.alias("within"))
    open_ = terms.filter("ticker IS NULL OR fiscal_year IS NULL").select("query_id", "query_vec", F.col("ticker").alias("within"))
    hits = [batched_search(corpus.withColumn("within", key), q, k, "within", id_col) for q, key in ((dated, both), (open_, F.col("ticker")))]
    return hits[0].unionByName(hits[1])


def answer_questions(questions: DataFrame, corpus: DataFrame, embedder: Embedder, generator: Generator, k: int = 5, id_col: str = "vec_id", facts: DataFrame | None = None, concepts: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(answers, misses) of (query_id, query) over chunks (vec_id, ticker, fiscal_year, section, text; embedded here if they have no vectors).

    Answers: query_id, text, action_code, status, sources.  Misses: look-ups that found nothing, with their
    query and filters, as the miss log takes them.  A question that was asked many times is looked up and generated for once.  With ``facts`` (see ``compute``) calculations over ``concepts`` are answered, too.
    """
    same = saved(questions.groupBy("query").agg(F.min("query_id").alias("query_id")))
    asked = directives(same)
    lookups = asked.filter("code = 'lookup'")
    terms = saved(embed_column(retrieval.search_terms(lookups), embedder, "embed_text", "query_vec"))
    vectors = corpus if "embedding" in corpus.columns else saved(embed_column(corpus, embedder))
    hits = saved(found_for(terms, vectors, k, id_col))
    head = F.concat_ws(" ", "ticker", F.col("fiscal_year").cast("string"), "section")
    shaped = hits.join(vectors.select(id_col, "ticker", "fiscal_year", "section", "text", head.alias("head")), id_col)
    context = answers.context_blocks(shaped)
    source = F.struct("rank", "ticker", "fiscal_year", "section")
    sources = shaped.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(source)), lambda s: F.struct(s["ticker"].alias("ticker"), s["fiscal_year"].alias("fiscal_year"), s["section"].alias("section"))).alias("sources"))
    made = generate_column(context.join(lookups.select("query_id", "query"), "query_id"), generator)
    found = made.select("query_id", "answer_text").join(sources, "query_id")
    missed = lookups.join(found.select("query_id"), "query_id", "left_anti")
    filters = F.map_filter(F.create_map(F.lit("ticker"), F.col("company"), F.lit("fiscal_year"), F.col("params.year").cast("string")), lambda _, v: v.isNotNull())
    computed = computed_answers(asked, facts, list(concepts)) if facts is not None else None
    once = answers.answer(asked, found, computed).withColumnRenamed("query_id", "one")
    ids = same.select(F.col("query_id").alias("one"), F.col("query").alias("__query"))
    each = questions.select("query_id", "query").join(ids, F.col("query").eqNullSafe(F.col("__query"))).select("query_id", "query", "one")
    misses = missed.select(F.col("query_id").alias("one"), filters.alias("filters"))
    return each.join(once, "one").drop("one", "query"), each.join(misses, "one").select("query_id", "query", "filters")
