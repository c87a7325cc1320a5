"""Operator 7: quality classifier.

Random Fourier features approximate a Gaussian kernel over document
statistics.  Each partition of the training rows sums its part of the normal
equations; the sums give ridge scores, and an isotonic fit on training rows
that the equations did not see turns them into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import Scratch, add_column, map_arrow, q, table
from quarryline.llm.docstats import COUNTS, document_stats, ratios, stats_of

FEATURES = 256
BANDWIDTH = 2.0
RIDGE = 1e-3
#: Fold that is never learned from.
HELD_OUT = "pmod(crc32(cast(doc_id AS string)), 3) = 1"
#: Bound of the labelled rows that are fitted; the rows of least hash are taken.
MAX_TRAIN_ROWS = 40_000
#: One of so many training rows calibrates.
CALIBRATE_PART = 4


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.mean, self.scale, self.omega, self.phase) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, omega: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Intercept and random Fourier features of standardised statistics."""
    z = np.clip((x - mean) / scale, -8, 8)
    return np.column_stack([np.ones(len(z)), np.sqrt(2.0 / len(phase)) * np.cos(z @ omega + phase)])


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and their non-decreasing levels."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, sum of scores
    for s, y in zip(score[order], label[order], strict=True):
        blocks.append([y, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], b, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + 0.5) / (b[1] + 1.0) if b[1] > 1 else b[0] for b in blocks])


def _features(b: pa.RecordBatch) -> np.ndarray:
    return ratios({k: b.column(k).to_numpy() for k in COUNTS})


def fit(rows: DataFrame, features: int = FEATURES, seed: int = 7) -> Model:
    """Fit on ``rows``: COUNTS, label int, calibrate boolean (bounded by the caller)."""
    dim = ratios({k: np.zeros(1) for k in COUNTS}).shape[1]
    rng = np.random.default_rng(seed)
    omega, phase = rng.normal(size=(dim, features)) / BANDWIDTH / np.sqrt(dim / 4), rng.uniform(0, 2 * np.pi, features)
    few = rows.repartition(8)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, dim))
        for b in batches:
            x = _features(b)
            total += np.stack([np.full(dim, float(len(x))), x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    n, s, ss = sum(np.frombuffer(r[0]).reshape(3, dim) for r in map_arrow(few, moments, "m binary").collect())
    n = np.maximum(n, 1)
    mean = s / n
    scale = np.sqrt(np.maximum(ss / n - mean**2, 1e-8))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = np.zeros((features + 1, features + 1)), np.zeros(features + 1)
        for b in batches:
            use = ~b.column("calibrate").to_numpy(zero_copy_only=False)
            z = fourier(_features(b)[use], mean, scale, omega, phase)
            a += z.T @ z
            c += z.T @ b.column("label").to_numpy(zero_copy_only=False)[use].astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], names=["a", "c"])

    parts = map_arrow(few, equations, "a binary, c binary").collect()  # 8 rows of (features + 1)**2 numbers
    a = sum(np.frombuffer(r[0]).reshape(features + 1, features + 1) for r in parts)
    c = sum(np.frombuffer(r[1]) for r in parts)
    weights = np.linalg.solve(a + RIDGE * max(a[0, 0], 1.0) * np.eye(features + 1), c)
    model = Model(mean, scale, omega, phase, weights, np.zeros(0), np.zeros(0))
    held = rows.filter("calibrate").toArrow()  # a CALIBRATE_PART of the bounded rows
    if held.num_rows == 0:
        held = rows.toArrow()
    if held.num_rows:
        x = ratios({k: held.column(k).to_numpy() for k in COUNTS})
        model.knots, model.levels = isotonic(model.raw(x), held.column("label").to_numpy().astype(float))
    return model


def marked_rows(labels: DataFrame, label_col: str, held_out: str, bound: int) -> DataFrame:
    """(doc_id, label) of about ``bound`` labelled rows outside the held-out fold at most, by least hash."""
    marked = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    marked = marked.filter(f"NOT ({held_out})")
    n = marked.count()
    share = min(1.0, bound / max(n, 1))
    pick = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    return marked.filter(pick < int(share * 1_000_003)) if share < 1 else marked


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: str = HELD_OUT, max_train_rows: int = MAX_TRAIN_ROWS) -> Model:
    """The model of ``labels.quality``; the labelled rows it learns from are bounded, and so is what is broadcast to find them."""
    marked = marked_rows(labels, "quality", held_out, max_train_rows)
    rows = docs.select(F.col(q(id_col)).cast("long").alias("doc_id"), F.col(q(text_col)).alias("text")).join(F.broadcast(marked), "doc_id")
    stats = document_stats(rows, "doc_id", "text", label=F.col("label")).withColumn("calibrate", F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(CALIBRATE_PART)) == 0)
    with Scratch(docs.sparkSession) as scratch:
        return fit(scratch.table(stats.select(*COUNTS, "label", "calibrate")))


def score_column(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of ``text_col`` as the last column.

    A column named ``score_col`` is replaced, others stay whatever their names.  Null and empty texts get the score of a
    text without words; rows are independent, so repeated ones get equal scores; an empty table gives an empty one.
    """
    return add_column(docs, score_col, "double", text_col, lambda texts: pa.array(model.score(ratios(stats_of(texts))), pa.float64()))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: str = HELD_OUT, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Learns ``labels.quality`` from rows outside ``held_out``.  Only counts of
    the text are features.  Null and empty texts get the score of a text
    without words.  Without labels every score is 0.5.  An id with several
    labels takes the largest.
    """
    model = learn(docs, labels, id_col, text_col, held_out, max_train_rows)
    scored = score_column(docs.select(F.col(q(id_col)).cast("long").alias("doc_id"), F.col(q(text_col)).alias("text")), model)
    return scored.select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; nulls, missing labels, repeated rows and an empty table as in ``quality_scores``."""
    return quality_scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels"))
