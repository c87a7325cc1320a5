"""Operator 4: language identification.

Multinomial naive Bayes over hashed character n-grams.  Spark sums the
n-gram counts of a bounded sample of rows for each language; the matrix of
log probabilities (``BUCKETS`` x languages) is broadcast in blocks of ``BLOCK``
languages, and a text's sparse counts are multiplied with them in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import Scratch, map_arrow, q, table
from quarryline.llm.textcore import mix

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.5
#: Bound of the rows that are learned from, for each language; the rows of least hash are taken.
MAX_ROWS_PER_LANG = 5_000
#: Languages of a block of the matrix: bounds what is broadcast at a time, not the number of languages.
BLOCK = 256
#: Code points that are hashed together, and numbers of the matrix that are gathered together.
SLICE, GATHERED = 1 << 18, 1 << 21


@dataclass
class Model:
    """Languages in order of name, log priors, and blocks of columns of the log probabilities (arrays, or broadcasts of them)."""

    langs: list[str]
    blocks: list
    prior: np.ndarray


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """How often each bucket occurs among the n-grams of a lower-cased text."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    total = np.zeros(BUCKETS, np.int64)
    for lo in range(0, len(cps), SLICE):
        part = cps[lo : lo + SLICE + max(ORDERS) - 1]
        h = np.zeros(len(part), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            m = len(part) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 :] + np.uint64(n)
            if n in ORDERS:
                total += np.bincount((mix(h[:SLICE]) >> np.uint64(49)).astype(np.int32), minlength=BUCKETS)
    return total


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, counts) of a partition, which holds all rows of its languages; a language at a time."""
    lang, total = None, np.zeros(BUCKETS)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["lang", "counts"])

    for b in batches:
        for x, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            if x != lang and lang is not None:
                yield row()
                total = np.zeros(BUCKETS)
            lang = x
            total += counts(t)
    if lang is not None:
        yield row()


def fit(train: DataFrame, max_rows_per_lang: int = MAX_ROWS_PER_LANG) -> Model:
    """``train``: doc_id, text, lang; null texts and languages teach nothing.  A language has ``max_rows_per_lang`` rows at most, about."""
    train = train.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    with Scratch(train.sparkSession) as scratch:
        sizes = scratch.table(train.groupBy("lang").agg(F.count("*").alias("n")))  # written first, so that Spark knows its size before it plans the join
        share = F.least(F.lit(1.0), max_rows_per_lang / F.col("n")) * 1_000_003
        n_langs = sizes.count()
        picked = train.join(sizes, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.floor(share)).select("lang", "text")
        parts = scratch.table(map_arrow(picked.repartition(max(4, n_langs // 4), "lang").sortWithinPartitions("lang"), _count, "lang string, counts binary"))
        sc = train.sparkSession.sparkContext
        number = {r["lang"]: r["n"] for r in sizes.toLocalIterator()}
        logs: dict[str, np.ndarray] = {}
        for r in parts.toLocalIterator():
            p = np.frombuffer(r["counts"], np.float32).astype(float) + SMOOTHING
            logs[r["lang"]] = np.log(p / p.sum()).astype(np.float32)
    langs = sorted(logs)
    model = Model(langs, [sc.broadcast(np.column_stack([logs[x] for x in langs[i : i + BLOCK]])) for i in range(0, len(langs), BLOCK)], np.zeros(0))
    n = np.array([number[x] for x in langs], float)
    model.prior = np.log(n / n.sum()) if len(n) else n
    return model


def scores(texts: list[str], model: Model) -> np.ndarray:
    """Posterior of each language, one row for each text."""
    total = np.tile(model.prior, (len(texts), 1))
    blocks = [b if isinstance(b, np.ndarray) else b.value for b in model.blocks]
    step = max(1, GATHERED // max((b.shape[1] for b in blocks), default=1))
    for i, t in enumerate(texts):
        c = counts(t)
        held = np.flatnonzero(c)
        own = c[held].astype(np.float64)
        at = 0
        for b in blocks:
            for lo in range(0, len(held), step):
                total[i, at : at + b.shape[1]] += own[lo : lo + step] @ b[held[lo : lo + step]]
            at += b.shape[1]
    e = np.exp(total - total.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows_per_lang: int = MAX_ROWS_PER_LANG) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score.

    A null text and one without a letter are ``und`` with score 0; so is every
    text if ``train`` is empty.  Ties go to the language first in order of
    name.  Texts are scored whole; an id may repeat.
    """
    m = fit(train, max_rows_per_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            known = [bool(m.langs) and has_letter(t) for t in texts]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            at = np.flatnonzero(known)
            if len(at):
                p = scores([texts[i] for i in at], m)
                for i, j in zip(at, p.argmax(1), strict=True):
                    lang[i] = m.langs[j]
                score[at] = p.max(1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    base = docs.select(F.col(q(id_col)).cast("long").alias("doc_id"), F.col(q(text_col)).cast("string").alias("text"))
    return map_arrow(base, run, "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; nulls, texts without a letter, repeated rows and an empty table as in ``identify``."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(F.expr("pmod(crc32(cast(doc_id AS string)), 3) = 1"), F.lit(False))
    out = identify(docs, docs.filter(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
