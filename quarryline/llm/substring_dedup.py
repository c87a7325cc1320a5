"""Operator 6: exact removal of repeated word windows.

Rabin-Karp hashes of every window of ``WINDOW`` words; windows that start
earlier elsewhere mark their words, and marked words merge into maximal
removal intervals.

Plan:

1. ``_sketch`` reads each text once.  Of every window it keeps the least hash
   of its ``GRAM``-word grams; equal windows have equal least grams, so a
   window can only repeat if its least gram does.  That leaves about one
   row for eight words to count.
2. Grams that occur twice are joined back to the documents that hold them.
   All but the first of exact copies are left out before: whatever they hold
   starts earlier in the first copy.
3. ``_windows`` hashes (96 bits) only the windows whose least gram repeats.
   Spark counts them and finds the least document of each, after a map-side
   aggregation, and the documents get that back by ``spread_join``, which
   deals the rows of a frequent gram, window or text to many tasks.
4. ``_remove`` merges the windows a document does not own, and its own later
   occurrences, into removal intervals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import Scratch, map_arrow, q, shared_table, spread_join, table
from quarryline.llm.textcore import WORD_BASE_2, ngram_hashes, sliding_min, text_chunks, word_bounds, word_hashes

WINDOW = 20
GRAM = 6
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _docs(col: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, bytes of its chunk, word starts, word ends, word hashes) of each text."""
    for lo, hi, data, off in text_chunks(col):
        starts, ends, at = word_bounds(data, off)
        h = word_hashes(data, starts, ends)
        for i in range(lo, hi):
            s = slice(at[i - lo], at[i - lo + 1])
            yield i, data, starts[s], ends[s], h[s]


def _least_grams(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All grams, and the least gram of each window."""
    gram = min(GRAM, window)
    grams = ngram_hashes(h, gram)
    return grams, sliding_min(grams, window - gram + 1)


def _sketch(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("n_words", pa.int64()), ("all_sha256", pa.string()), ("grams", pa.list_(pa.int64())), ("twice", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, shas, once, twice = [], [], [], []
            for _, data, starts, ends, h in _docs(b.column("text")):
                n_words.append(len(h))
                body = data[starts[0] : ends[-1]].tobytes() if len(h) else b""
                shas.append(hashlib.sha256(b" ".join(body.split())).hexdigest())
                grams, least = _least_grams(h, window)
                least = np.unique(least)
                order = np.sort(grams)
                many = np.searchsorted(order, least, side="right") - np.searchsorted(order, least, side="left") > 1
                least = least.view(np.int64)
                once.append(least[~many])
                twice.append(least[many])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("text_key"), pa.array(n_words, pa.int64()), pa.array(shas), pa.array(once, schema.field("grams").type), pa.array(twice, schema.field("twice").type)], schema=schema)

    return run


def _windows(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("h1", pa.list_(pa.int64())), ("h2", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, first, second = b.column("doc_id").to_pylist(), [], []
            for i, _, _, _, h in _docs(b.column("text")):
                at = _candidates(h, window, b.column("grams")[i].values.to_numpy(zero_copy_only=False))
                h1, h2 = _window_hashes(h, window)
                _, keep = np.unique(h1[at], return_index=True)
                first.append(h1[at][keep])
                second.append(h2[at][keep])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(first, schema.field("h1").type), pa.array(second, schema.field("h2").type)], schema=schema)

    return run


def _candidates(h: np.ndarray, window: int, grams: np.ndarray) -> np.ndarray:
    """Starts of the windows whose least gram is one of ``grams``."""
    _, least = _least_grams(h, window)
    known = np.sort(grams.view(np.uint64))
    if not len(known):
        return np.zeros(0, np.int64)
    return np.flatnonzero(known[np.minimum(np.searchsorted(known, least), len(known) - 1)] == least)


def _window_hashes(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    return ngram_hashes(h, window).view(np.int64), (ngram_hashes(h, window, WORD_BASE_2) >> np.uint64(33)).astype(np.int32)


def removed_words(h: np.ndarray, window: int, foreign: np.ndarray) -> np.ndarray:
    """Mask of the words to remove: of windows in ``foreign``, and of windows met before in the document itself."""
    h1, _ = _window_hashes(h, window)
    later = np.ones(len(h1), dtype=bool)
    later[np.unique(h1, return_index=True)[1]] = False
    if len(foreign):
        known = np.sort(foreign)
        later |= known[np.minimum(np.searchsorted(known, h1), len(known) - 1)] == h1
    edge = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(later)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge)[:-1] > 0


def intervals(mask: np.ndarray) -> np.ndarray:
    """Maximal runs of true, as flat pairs (first word, end word)."""
    return np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))


def _remove(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, shas, spans = [], [], []
            for i, data, starts, ends, h in _docs(b.column("text")):
                own = b.column("foreign")[i]
                mask = removed_words(h, window, own.values.to_numpy(zero_copy_only=False) if own.is_valid else np.zeros(0, np.int64))
                runs = intervals(mask)
                kept = intervals(~mask)
                parts = [b" ".join(data[starts[x] : ends[y - 1]].tobytes().split()) for x, y in zip(kept[::2], kept[1::2], strict=True)]
                n.append(int(mask.sum()))
                shas.append(hashlib.sha256(b" ".join(parts)).hexdigest())
                spans.append(runs.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(shas), pa.array(spans, schema.field("removed").type)], schema=schema)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, removed.

    ``removed`` holds flat pairs (first word, end word) of the maximal intervals
    taken out; a window's first occurrence (least id, then least start) stays.

    Null text has no words.  A text shorter than the window loses nothing.
    Repeated rows with one id and one text give equal rows.  An empty table
    gives an empty table.  Other columns are ignored.
    """
    base = docs.select(F.col(q(id_col)).cast("long").alias("doc_id"), F.col(q(text_col)).cast("string").alias("text"))
    base = base.withColumn("text_key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    with Scratch(docs.sparkSession) as scratch:
        sketch = scratch.table(map_arrow(base, _sketch(window), "doc_id long, text_key string, n_words long, all_sha256 string, grams array<long>, twice array<long>"))
        first = scratch.table(sketch.groupBy("text_key").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")))
        heads = sketch.filter(f"n_words >= {window}").dropDuplicates(["doc_id", "text_key"]).join(first.select("text_key", F.col("head").alias("doc_id")), ["doc_id", "text_key"], "left_semi")
        heads = scratch.table(heads.select("doc_id", "text_key", "grams", "twice"))
        rows = heads.select("doc_id", "text_key", F.explode("grams").alias("gram"), F.lit(1).alias("times")).unionAll(heads.select("doc_id", "text_key", F.explode("twice").alias("gram"), F.lit(2).alias("times")))
        again = scratch.table(rows.groupBy("gram").agg(F.sum("times").alias("times"), F.count("*").alias("n")).filter("times > 1").select("gram", "n"))
        wanted = spread_join(rows.select("doc_id", "text_key", "gram"), again.select("gram"), "gram", by="doc_id", sizes=again)
        wanted = scratch.table(wanted.groupBy("doc_id", "text_key").agg(F.collect_list("gram").alias("grams")))
        held = scratch.table(base.join(wanted, ["doc_id", "text_key"]))

        found = map_arrow(held.select("doc_id", "text", "grams"), _windows(window), "doc_id long, h1 array<long>, h2 array<int>")
        found = scratch.table(found.select("doc_id", F.inline(F.arrays_zip("h1", "h2"))).select("doc_id", F.struct("h1", "h2").alias("h")))
        owner = scratch.table(found.groupBy("h").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("owner < last").select("h", "owner", "n"))
        foreign = spread_join(found, owner.select("h", "owner"), "h", by="doc_id", sizes=owner).filter("doc_id > owner")
        foreign = scratch.table(foreign.groupBy("doc_id").agg(F.collect_list("h.h1").alias("foreign")))
        cut = map_arrow(held.select("doc_id", "text_key", "text").join(foreign, "doc_id", "left"), _remove(window), "doc_id long, text_key string, n_removed long, kept_sha256 string, removed array<int>")
        cut = scratch.table(cut.dropDuplicates(["doc_id", "text_key"]))

        copies = spread_join(sketch.select("doc_id", "text_key", "n_words", "all_sha256"), first.select("text_key", "head"), "text_key", by="doc_id", sizes=first.select("text_key", "n"))
        done = copies.join(cut, ["doc_id", "text_key"], "left")
        is_copy = (F.col("doc_id") > F.col("head")) & (F.col("n_words") >= window)
        return shared_table(
            done.select(
                "doc_id", "n_words",
                F.when(is_copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                F.when(is_copy, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
                F.when(is_copy, F.array(F.lit(0), F.col("n_words").cast("int"))).otherwise(F.coalesce("removed", F.array().cast("array<int>"))).alias("removed"),
            )
        )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; nulls, short texts, repeated rows and an empty table as in ``substring_dedup``."""
    return substring_dedup(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL_OP6 = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, s, md5(array_to_string(ws[s:s+19], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1))) AS s FROM t)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM w) WHERE n > 1),
p AS (SELECT DISTINCT doc_id, s + j AS pos FROM r, (SELECT unnest(range(0, 20)) AS j)),
g AS (SELECT doc_id, list(pos) AS gone FROM p GROUP BY doc_id)
SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(ws, ' ')
              ELSE coalesce((SELECT string_agg(ws[i], ' ' ORDER BY i) FROM (SELECT unnest(range(1, len(ws) + 1)) AS i) x WHERE NOT list_contains(gone, i)), '') END) AS kept_sha256
FROM t LEFT JOIN g ON t.doc_id = g.doc_id
"""
