"""Approximate vector search over a neighbour graph, built and walked by joins.

The graph is a table of (id, links): at most ``DEGREE`` near rows, ``BACK`` that name the row as one of
theirs, and ``FAR`` taken by hash, which lead from one cluster to others.  It is built by NN-descent: rows start with neighbours from blocks along
random directions; then the neighbours of each row meet each other, as those of one
row are likely near.  Every step is a join, a bounded group for each row, and a ranking.

A search walks the graph for all queries at once.  A round takes the best rows not yet
expanded of each query, joins their links, scores those not seen, and keeps all scores.
It ends when no query has an unexpanded row among its ``beam`` best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.numbering import number_rows
from quarryline.operators.vector import ranked
from quarryline.session import saved, ship

DEGREE, BACK, FAR = 10, 1, 2
#: Near rows that are kept while the graph is built: more than in the end, or it wouldn't converge where vectors have no clusters.
POOL = 30
#: Rows of a starting block, starting directions, rows that every walk begins at.
BLOCK, STARTS, ENTRIES = 128, 2, 8


def unit_rows(corpus: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec) with vectors of length one; null and zero vectors are left out."""
    length = F.sqrt(F.aggregate(vec_col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return corpus.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: (x.cast("double") / length).cast("float")).alias("vec")).filter(F.col(vec_col).isNotNull() & (length > 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _meet(ids: np.ndarray, m: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, score) of the ``most`` nearest others of each row of a group."""
    s = m @ m.T
    s[ids[:, None] == ids[None]] = -np.inf
    most = min(most, len(ids) - 1)
    near = np.argpartition(-s, most - 1, axis=1)[:, :most] if most > 0 else np.zeros((len(ids), 0), int)
    score = np.take_along_axis(s, near, axis=1)
    ok = np.isfinite(score)
    return np.repeat(ids, near.shape[1])[ok.ravel()], ids[near][ok], score[ok].astype(np.float64)


def _near_in_groups(groups: DataFrame, most: int) -> DataFrame:
    """(id, other, score) of rows that share a group (members: id and vec); groups are bounded, scores inside them are one matrix product."""
    ship(groups.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_meet(m.values.field("id").to_numpy(), _matrix(m.values.field("vec")), most) for m in b.column("members")]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["id", "other", "score"])

    return groups.select("members").mapInArrow(run, "id long, other long, score double")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best others of each id; ranks are cut before the shuffle, so a row that very many name is no large group."""
    return ranked(pairs.groupBy("id", "other").agg(F.max("score").alias("score")), k, "id", "other").drop("rank")


def _start(rows: DataFrame, seed: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Near pairs inside blocks of rows that follow each other along a random direction."""
    rng = np.random.default_rng(seed)
    first = rows.select(F.size("vec").alias("n")).first()
    line = rng.standard_normal(first["n"] if first else 1)
    along = F.aggregate(F.zip_with("vec", F.array(*(F.lit(float(x)) for x in line)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    placed = number_rows(keep(rows.withColumn("along", along)), ["along"], keep=keep)
    groups = placed.groupBy(F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.collect_list(F.struct("id", "vec")).alias("members"))
    return _near_in_groups(groups, POOL)


def _named_by(near: DataFrame, k: int) -> DataFrame:
    """(id, other, score): the k nearest of the rows that name a row."""
    return ranked(near.select(F.col("other").alias("id"), F.col("id").alias("other"), "score"), k, "id", "other").drop("rank")


def _far(rows: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, other): rows at places that the id's hash picks."""
    placed = keep(number_rows(keep(rows.select("id")), ["id"], keep=keep))
    at = F.explode(F.array(*(F.pmod(F.xxhash64("id", F.lit(j)), F.col("n")) for j in range(FAR))))
    return placed.select("id", at.alias("pos")).join(placed.select("pos", F.col("id").alias("other")), "pos").filter("id <> other").select("id", "other")


def build_graph(rows: DataFrame, rounds: int = 3, keep: Callable[[DataFrame], DataFrame] = saved) -> DataFrame:
    """(id, links) over ``unit_rows``; ids are unique.  Vectors of one direction are neighbours like others; one row alone has no links."""
    near = keep(_best(reduce(DataFrame.unionAll, (_start(rows, s, keep) for s in range(STARTS))), POOL))
    for _ in range(rounds):
        members = keep(near.unionAll(_named_by(near, POOL)).select(F.col("id").alias("of"), F.col("other").alias("id")).distinct())
        groups = members.join(rows, "id").groupBy("of").agg(F.collect_list(F.struct("id", "vec")).alias("members"))  # 2 x POOL at most
        near = keep(_best(near.unionByName(_near_in_groups(groups, POOL)), POOL))
    near = keep(ranked(near, DEGREE, "id", "other").drop("rank"))
    links = near.unionByName(_named_by(near, BACK)).select("id", "other").unionAll(_far(rows, keep)).distinct()
    return keep(links.groupBy("id").agg(F.collect_list("other").alias("links")))


def _scored(pairs: DataFrame, rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, score) of (query_id, id) pairs."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.einsum("ij,ij->i", _matrix(b.column("vec")).astype(float), _matrix(b.column("query")).astype(float)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("id"), pa.array(score)], names=["query_id", "id", "score"])

    both = pairs.join(rows, "id").join(queries.select(F.col("id").alias("query_id"), F.col("vec").alias("query")), "query_id")
    return both.select("query_id", "id", "vec", "query").mapInArrow(run, "query_id long, id long, score double")


def graph_search(graph: DataFrame, rows: DataFrame, queries: DataFrame, k: int = 10, beam: int = 11, width: int = 3, rounds: int = 30, keep: Callable[[DataFrame], DataFrame] = saved) -> tuple[DataFrame, DataFrame]:
    """The k best found of each query (query_id, id, score, rank), and all (query_id, id, score) that were read for it.

    ``queries`` are ``unit_rows`` too.  ``beam`` trades reads for recall; ``rounds`` only ends a walk that
    would go on (each round expands ``width`` rows a query, so it needs about beam / width of them).
    """
    entries = rows.select("id").orderBy(F.xxhash64("id")).limit(ENTRIES)
    found = keep(_scored(queries.select(F.col("id").alias("query_id")).crossJoin(F.broadcast(entries)), rows, queries))
    done = None
    for _ in range(rounds):
        top = ranked(found, beam, "query_id", "id")
        if done is not None:
            top = top.join(done, ["query_id", "id"], "left_anti")
        ahead = keep(ranked(top.drop("rank"), width, "query_id", "id").select("query_id", "id"))
        if ahead.isEmpty():
            break
        done = ahead if done is None else done.unionAll(ahead)
        linked = ahead.join(graph, "id").select("query_id", F.explode("links").alias("id")).distinct()
        new = keep(_scored(linked.join(found, ["query_id", "id"], "left_anti"), rows, queries))
        found = found.unionAll(new)
    return ranked(found, k, "query_id", "id"), found
