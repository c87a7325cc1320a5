"""Statistics of whole texts that the quality operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import ddl, map_arrow, q
from quarryline.llm.textcore import ngram_hashes, text_chunks, word_bounds, word_hashes

#: Words of the windows in which repetition is counted.
REPEAT_WINDOW = 5
COUNTS = ("n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_stutter", "n_upper", "n_letters", "n_digits", "n_bang", "n_pipe", "n_marks", "n_wide")


def _lut(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, dtype=np.uint8)
    for a, b in ranges:
        t[a : b + 1] = 1
    return t


def _of(chars: str) -> np.ndarray:
    return _lut(*((ord(c), ord(c)) for c in chars))


_FIRST = _lut((0x00, 0x7F), (0xC0, 0xFF))
_WORD_FIRST = _FIRST & (1 - _lut((0x20, 0x20), (0x09, 0x0D)))
_CLASSES = {
    "n_chars": _FIRST,
    "word_chars": _WORD_FIRST,
    "n_symbols": _of("#*$%&|<>"),
    "n_upper": _lut((65, 90)),
    "n_letters": _lut((65, 90), (97, 122), (0xC0, 0xFF)),
    "n_digits": _lut((48, 57)),
    "n_bang": _of("!?"),
    "n_pipe": _of("|"),
    "n_marks": _of(".,;:"),
    "n_wide": _lut((0xC0, 0xFF)),
}


def _covered(gram: np.ndarray, n: int, width: int) -> int:
    """Words inside windows whose hash occurs at least twice."""
    order = np.argsort(gram, kind="stable")
    s = gram[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s), bool)
    twice[1:] = same
    twice[:-1] |= same
    at = order[twice]
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def stats_of(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts of every text of a column; null counts as empty."""
    out = {k: np.zeros(len(column), np.int64) for k in COUNTS}
    for lo, hi, data, off in text_chunks(column):
        for k, t in _CLASSES.items():
            sums = np.concatenate([[0], np.cumsum(t[data], dtype=np.int64)])
            out[k][lo:hi] = sums[off[1:]] - sums[off[:-1]]
        starts, ends, at = word_bounds(data, off)
        h = word_hashes(data, starts, ends)
        out["n_words"][lo:hi] = np.diff(at)
        raw = data.tobytes()
        for i in range(lo, hi):
            w = h[at[i - lo] : at[i - lo + 1]]
            if not len(w):
                continue
            out["n_distinct"][i] = len(np.unique(w))
            out["n_stutter"][i] = int((w[1:] == w[:-1]).sum())
            if len(w) > REPEAT_WINDOW:
                out["n_repeat_words"][i] = _covered(ngram_hashes(w, REPEAT_WINDOW), len(w), REPEAT_WINDOW)
            lines = [x for x in raw[off[i - lo] : off[i - lo + 1]].split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
            out["n_lines"][i] = len(lines)
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
    return out


def document_stats(docs: DataFrame, id_col: str, text_col: str, **keep: Column) -> DataFrame:
    """doc_id, the columns ``keep`` under their names here and COUNTS of every row; null counts as empty."""
    base = docs.select(F.col(q(id_col)).cast("long").alias("doc_id"), *(c.alias(n) for n, c in keep.items()), F.col(q(text_col)).cast("string").alias("text_in"))
    names = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = stats_of(b.column("text_in"))
            yield pa.RecordBatch.from_arrays([b.column(f) for f in names] + [pa.array(s[k]) for k in COUNTS], names=[*names, *COUNTS])

    return map_arrow(base, run, ddl(base.drop("text_in"), *(f"{k} long" for k in COUNTS)))


def ratios(c: dict[str, np.ndarray]) -> np.ndarray:
    """One row of scale-free features for each document."""
    chars, words = np.maximum(c["n_chars"], 1).astype(float), np.maximum(c["n_words"], 1).astype(float)
    letters, lines = np.maximum(c["n_letters"], 1).astype(float), np.maximum(c["n_lines"], 1).astype(float)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_upper"] / letters, c["n_digits"] / chars,
        c["n_bang"] / words, c["n_pipe"] / words, c["n_marks"] / words, c["n_wide"] / chars, c["n_distinct"] / words ** 0.9,
        c["n_stutter"] / words, c["n_repeat_words"] / words, c["n_dup_lines"] / lines, np.log1p(words / lines),
    ])
