"""Interfaces of model-backed steps and offline stand-ins.

The stand-ins are our own and only make pipelines runnable without a model; real
models implement the same interfaces and run inside Arrow batches.
"""

from __future__ import annotations

import json
import time
import zlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarryline.session import ship


class Embedder(ABC):
    dimension: int

    @abstractmethod
    def embed(self, texts: list[str]) -> np.ndarray:
        """One unit vector for each text, in order."""


class Labeler(ABC):
    @abstractmethod
    def label(self, query: str) -> str:
        """Raw model output (JSON text) for a query."""


class Generator(ABC):
    @abstractmethod
    def generate(self, query: str, context: str) -> str:
        """Answer text from a context block."""


class Judge(ABC):
    @abstractmethod
    def judge(self, question: str, expected: str, actual: str) -> bool: ...


class JsonLabeler(Labeler):
    """The first word of a query as its code; the word ``fail`` raises, as a provider that is down does."""

    def label(self, query: str) -> str:
        code = (query.split() or [""])[0]
        if code == "fail":
            raise RuntimeError("no answer")
        return json.dumps({"action_code": code})


class HashedEmbedder(Embedder):
    """Signed hashes of character trigrams and words; the same text always gives the same vector."""

    def __init__(self, dimension: int = 256) -> None:
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            low = " ".join((t or "").lower().split())
            for g in (*(low[j : j + 3] for j in range(len(low) - 2)), *low.split()):
                h = zlib.crc32(g.encode())
                out[i, h % self.dimension] += 1.0 if h & 0x10000 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


class ExtractiveGenerator(Generator):
    """The first source's opening, with its number as citation."""

    def generate(self, query: str, context: str) -> str:
        head, _, body = context.partition("\n")
        return f"{body.strip()[:300]} [1]" if body.strip() else head


class OverlapJudge(Judge):
    """Right if the distinct words of answer and expectation overlap enough (F1)."""

    def __init__(self, least: float = 0.5) -> None:
        self.least = least

    def judge(self, question: str, expected: str, actual: str) -> bool:
        a, b = set(expected.lower().split()), set(actual.lower().split())
        return bool(a or b) and 2 * len(a & b) / (len(a) + len(b)) >= self.least


def embed_column(df: DataFrame, embedder: Embedder, text_col: str = "text", out_col: str = "embedding", slice_rows: int = 256) -> DataFrame:
    """``df`` with a vector for each text; rows go to the model in slices."""
    ship(df.sparkSession)
    rest = df.drop(out_col)
    names = rest.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), f"`{out_col}` array<float>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            v = np.concatenate([embedder.embed(texts[i : i + slice_rows]) for i in range(0, len(texts), slice_rows)]) if texts else np.zeros((0, embedder.dimension))
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * embedder.dimension, pa.int32()), pa.array(v.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), vec], names=[*names, out_col])

    return rest.mapInArrow(run, schema)


def label_column(df: DataFrame, labeler: Labeler, query_col: str = "query", out_col: str = "raw_output", retries: int = 1, wait: float = 2.0) -> DataFrame:
    """``df`` with the labeler's raw output; null after ``retries`` failed retries, so that one row never fails the job."""
    ship(df.sparkSession)
    rest = df.drop(out_col)
    names = rest.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields), f"`{out_col}` string"])

    def once(q: str) -> str | None:
        for attempt in range(retries + 1):
            try:
                return labeler.label(q)
            except Exception:  # noqa: BLE001  any provider error counts as a failed call
                if attempt < retries:
                    time.sleep(wait)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array([once(q or "") for q in b.column(query_col).to_pylist()], pa.string())], names=[*names, out_col])

    return rest.mapInArrow(run, schema)


def template_queries(spark, code: str, subjects: list[str], facts: list[str], n: int) -> DataFrame:
    """(code, query, batch_id): ``n`` queries of a code from templates; always ends."""
    from pyspark.sql import functions as F

    s, f = F.array(*map(F.lit, subjects)), F.array(*map(F.lit, facts))
    i = F.col("id")
    return spark.range(n).select(F.lit(code).alias("code"), F.format_string("What was %s of %s in fiscal %d?", F.get(f, (i % len(facts)).cast("int")), F.get(s, F.floor(i / len(facts)).cast("int") % len(subjects)), F.lit(2020) + i % 5).alias("query"), F.floor(i / 20).cast("int").alias("batch_id"))
