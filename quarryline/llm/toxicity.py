"""Operator 5: toxicity.

A weighted lexicon of word beginnings and short words is matched by Aho-Corasick over folded
text (homoglyphs and digit substitutions undone).  Hits inside exception
phrases do not count; the weights of the others are normalised by length and
a logistic curve turns them into a probability.  Lexicon, exceptions and
curve are learned from labelled rows.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import Scratch, map_arrow, q, table
from quarryline.llm.quality_classifier import marked_rows

#: Bound of the labelled rows that are learned from; the rows of least hash are taken.
MAX_TRAIN_ROWS = 20_000
#: Letters of a term: words of fewer than MIN_PREFIX are terms as a whole, longer terms are beginnings of words.
MIN_PREFIX, MAX_PREFIX = 4, 32
#: Toxic documents that must hold a term, and by how much (log odds) it must point to them.
MIN_DOCS = 5
MIN_LOG_ODDS = 2.5
#: Characters that look like Latin letters.
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁһӏвкмнтгαεορυνικτ", "aeopcyxijsdhlbkmhtraeopuvikt")
_LOOKALIKE = re.compile("[Ͱ-ϿЀ-ԯ！-～]")
_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
#: Digits and signs that stand for letters.
_SIGN = re.compile(r"[@$!](?=\w)")
_SIGNS = {"@": "a", "$": "s", "!": "i"}
_DIGITS = dict(zip(b"01345789", b"oieastbg", strict=True))
_FOLD = bytes(_DIGITS.get(i, i if 97 <= i <= 122 or i >= 128 or i in b"26" else 32) for i in range(256))


def fold(text: str | None) -> bytes:
    """Folded words between single spaces, with one at either end."""
    t = (text or "").lower()
    if not t.isascii() and _LOOKALIKE.search(t):
        t = t.translate(_WIDE).translate(HOMOGLYPHS)
    if "@" in t or "$" in t or "!" in t:
        t = _SIGN.sub(lambda m: _SIGNS[m[0]], t)
    words = t.encode().translate(_FOLD).split()
    return b" " + b" ".join(words) + b" " if words else b" "


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-3.0, 0.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            s = (" " + t).encode().decode("latin-1")
            a.add_word(s, (len(s), w))
        for e in self.exceptions:
            s = f" {e} ".encode().decode("latin-1")
            a.add_word(s, (len(s), None))
        a.make_automaton()
        return a


def hits(a: ahocorasick.Automaton, body: bytes) -> list[tuple[int, float]]:
    """(position, weight) of the lexicon's hits outside exception phrases; of several terms at a place the longest counts."""
    if not len(a):
        return []
    found: dict[int, float] = {}
    out_of: list[tuple[int, int]] = []
    for end, (size, w) in a.iter(body.decode("latin-1")):
        at = end - size + 1
        if w is None:
            out_of.append((at, end))
        else:
            found[at] = w
    if not out_of:
        return list(found.items())
    out_of.sort()
    starts, reach = [s for s, _ in out_of], list(itertools.accumulate((e for _, e in out_of), max))
    inside = lambda p: (i := bisect.bisect_right(starts, p)) > 0 and reach[i - 1] > p
    return [(p, w) for p, w in found.items() if not inside(p)]


def measures(a: ahocorasick.Automaton, body: bytes) -> tuple[float, float]:
    """Total weight, and weight for each hundred words."""
    total = sum(w for _, w in hits(a, body))
    return total, 100.0 * total / max(body.count(b" ") - 1, 20)


def curve_features(total: np.ndarray, rate: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(total)), np.log1p(total), np.log1p(rate)])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w * [0, 1, 1]
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.diag([1e-6, 1, 1])
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _prefixes(body: bytes) -> set[str]:
    words = set(body.decode().split())
    return {w[:n] for w in words for n in range(MIN_PREFIX, min(MAX_PREFIX, len(w)) + 1)} | {w + " " for w in words if len(w) < MIN_PREFIX}


def _prefix_counts(only: frozenset[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[str] = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                p = _prefixes(fold(t))
                c.update(p if only is None else p & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["term", "n"])

    return run


def log_odds(a: int, in_a: int, b: int, in_b: int) -> float:
    return float(np.log((a + 0.5) / (in_a - a + 0.5)) - np.log((b + 0.5) / (in_b - b + 0.5)))


def choose_terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Shortest word beginnings that point to toxic texts, each lengthened while it loses few of them, and short words (with a space behind)."""
    score = {t: log_odds(n, n_toxic, clean.get(t, 0), n_clean) for t, n in toxic.items()}
    longer: dict[str, list[str]] = {}
    for t in toxic:
        longer.setdefault(t[:-1], []).append(t)
    out: dict[str, float] = {}
    for t in sorted(toxic, key=lambda t: (len(t), t)):
        if score[t] < MIN_LOG_ODDS or any(t[:n] in out for n in range(MIN_PREFIX, len(t))):
            continue
        while more := [x for x in longer.get(t, ()) if toxic[x] >= 0.9 * toxic[t] and score[x] >= score[t] - 0.2]:
            t = max(more, key=lambda x: (toxic[x], x))
        out[t] = min(score[t], 8.0)
    return out


def _contexts(model: Model):
    """Pairs of neighbouring words around hits, with the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, c = model.automaton(), Counter()
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                body, own = fold(t), set()
                for p, _ in hits(a, body):
                    stop = body.index(b" ", p + 1)
                    if p:
                        own.add(body[body.rindex(b" ", 0, p) + 1 : stop].decode())
                    if stop + 1 < len(body):
                        own.add(body[p + 1 : body.index(b" ", stop + 1)].decode())
                c.update((x, y) for x in own)
        rows = list(c.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.int64())], names=["phrase", "label", "n"])

    return run


def _measure(model: Model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.automaton()
        for b in batches:
            m = [measures(a, fold(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array([x[0] for x in m], pa.float64()), pa.array([x[1] for x in m], pa.float64())], names=[*keep, "total", "rate"])

    return run


def fit(train: DataFrame) -> Model:
    """``train``: text, label int.  The caller bounds its rows, and with them lexicon, exceptions and what the driver gathers.

    Null texts are empty; with labels of one kind only every score is that kind's, with none a constant below the threshold.
    """
    with Scratch(train.sparkSession) as scratch:
        return _fit(scratch.table(train.repartition(12)), scratch)


def _fit(train: DataFrame, scratch: Scratch) -> Model:
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(curve=(-30.0 if not n_toxic else 30.0, 0.0, 0.0)) if n_toxic or n_clean else Model()

    def counted(label: int, only: frozenset[str] | None) -> dict[str, int]:
        parts = map_arrow(train.filter(F.col("label") == label).select("text"), _prefix_counts(only), "term string, n long")
        held = scratch.table(parts.groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= (MIN_DOCS if only is None else 1)))
        return {r["term"]: r["n"] for r in held.toLocalIterator()}

    toxic = counted(1, None)
    model = Model(choose_terms(toxic, counted(0, frozenset(toxic)), n_toxic, n_clean))
    if not model.terms:
        return Model(curve=(float(np.log(n_toxic / n_clean)), 0.0, 0.0))
    seen = map_arrow(train, _contexts(model), "phrase string, label int, n long").groupBy("phrase").pivot("label", [0, 1]).agg(F.sum("n"))
    seen = seen.select("phrase", F.coalesce("0", F.lit(0)).alias("clean"), F.coalesce("1", F.lit(0)).alias("toxic")).filter(f"clean >= 3 AND (clean + 0.5) / {n_clean} > (toxic + 0.5) / {n_toxic}")
    model.exceptions = sorted(r["phrase"] for r in scratch.table(seen.select("phrase")).toLocalIterator())
    m = map_arrow(train, _measure(model, ["label"]), "label int, total double, rate double").toArrow()
    model.curve = fit_curve(curve_features(m.column("total").to_numpy(), m.column("rate").to_numpy()), m.column("label").to_numpy().astype(float))
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score, total, rate.

    Null and empty texts have no hits and get the curve's value there.  Texts
    are matched whole; an id may repeat.  Other columns are ignored.
    """
    base = docs.select(F.col(q(id_col)).cast("long").alias("doc_id"), F.col(q(text_col)).cast("string").alias("text"))
    out = map_arrow(base, _measure(model, ["doc_id"]), "doc_id long, total double, rate double")
    w = model.curve
    return out.withColumn("score", 1 / (1 + F.exp(-(F.lit(w[0]) + w[1] * F.log1p("total") + w[2] * F.log1p("rate")))))


def training_rows(docs: DataFrame, labels: DataFrame, held_out: str, bound: int) -> DataFrame:
    """text and label of the bounded rows to learn from."""
    marked = marked_rows(labels, "toxic", held_out, bound)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marked), "doc_id").select("text", "label")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; nulls, empty texts, repeated rows and an empty table as in ``toxicity``."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = "pmod(crc32(cast(doc_id AS string)), 4) = 2"
    model = fit(training_rows(docs, labels, held_out, MAX_TRAIN_ROWS))
    return toxicity(docs, model).select("doc_id", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
