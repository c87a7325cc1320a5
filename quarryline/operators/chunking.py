"""Greedy packing of units into chunks with overlap.

Packing is a fold with a small state over the units of one record, so it is
an Arrow stage without a shuffle: a record is one row and never meets another.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.session import ship

TARGET, OVERLAP = 480, 64
#: Rows whose texts are Python objects at once.
SLICE = 128
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
TokenCounter = Callable[[str], int]


def word_count(text: str) -> int:
    return len(text.split())


def word_slices(text: str, size: int) -> list[str]:
    """A text without sentence bounds, cut after every ``size`` words."""
    w = text.split()
    return [" ".join(w[i : i + size]) for i in range(0, len(w), size)]


def split_long(unit: str, target: int, count: TokenCounter = word_count, slices: Callable[[str, int], list[str]] = word_slices) -> list[str]:
    """Pieces of at most ``target`` tokens: the longest runs of whole sentences that fit, longer sentences cut by tokens."""
    parts = _SENTENCE.split(unit)
    sizes = [count(s) for s in parts]
    fits = (lambda a, b: sum(sizes[a:b]) <= target) if count is word_count else (lambda a, b: count(" ".join(parts[a:b])) <= target)
    out: list[str] = []
    first = 0
    while first < len(parts):
        end = first + 1
        if sizes[first] > target:
            out += slices(parts[first], target)
        else:
            while end < len(parts) and sizes[end] <= target and fits(first, end + 1):
                end += 1
            out.append(" ".join(parts[first:end]))
        first = end
    return [p for p in out if p]


def pack_bounds(sizes: list[int], target: int = TARGET, overlap: int = OVERLAP, joined: Callable[[int, int], int] | None = None) -> list[tuple[int, int]]:
    """(first, end) unit of each chunk.

    ``joined(a, b)`` is the size of units a..b-1 joined (default: the sum).  A
    unit over the budget ``target - overlap`` stands alone and cuts the
    overlap; a full buffer is emitted and leaves its longest tail of at most
    ``overlap`` tokens behind, to which the next unit is added unchecked.
    """
    size = joined or (lambda a, b: sum(sizes[a:b]))
    budget, out, first = target - overlap, [], 0
    for i, n in enumerate(sizes):
        if n > budget:
            out += [(first, i)] if first < i else []
            out.append((i, i + 1))
            first = i + 1
        elif first < i and size(first, i + 1) > budget:
            out.append((first, i))
            tail, first = 0, i
            while first > out[-1][0] and tail + sizes[first - 1] <= overlap:
                first -= 1
                tail += sizes[first]
    return out + ([(first, len(sizes))] if first < len(sizes) else [])


def pack(text: str, delimiter: str = "\n\n", target: int = TARGET, overlap: int = OVERLAP, count: TokenCounter = word_count, slices: Callable[[str, int], list[str]] = word_slices) -> list[tuple[int, int, str, int]]:
    """(first unit, end unit, text, tokens) of each chunk of a record."""
    units = []
    for p in text.split(delimiter):
        p = p.strip()
        if p:
            units += [p] if count(p) <= target else split_long(p, target, count, slices)
    sizes = [count(u) for u in units]
    joined = None if count is word_count else lambda a, b: count(delimiter.join(units[a:b]))
    return [(a, b, t, count(t)) for a, b in pack_bounds(sizes, target, overlap, joined) for t in [delimiter.join(units[a:b])]]


def chunk_records(records: DataFrame, text_col: str = "text", type_col: str | None = "content_type", delimiter: str = "\n\n", target: int = TARGET, overlap: int = OVERLAP, count: TokenCounter = word_count, sizes_for: dict[str, int] | None = None, size_col: str = "section", slices: Callable[[str, int], list[str]] = word_slices) -> DataFrame:
    """One row for each chunk: the record's columns with the chunk's text, then chunk_index, n_tokens, first_unit, end_unit.

    Rows of type ``table`` pass whole with index 0.  ``sizes_for`` sets another
    target for some values of ``size_col``.  Null texts have no chunks.
    """
    names = [c for c in records.columns if c != text_col]
    kinds = type_col if type_col in records.columns else None
    own = size_col if sizes_for and size_col in records.columns else None
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields if f.name != text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(lo, SLICE) for whole in batches for lo in range(0, whole.num_rows, SLICE)):
            at, cells = [], []
            kind = b.column(kinds).to_pylist() if kinds else [None] * b.num_rows
            group = b.column(own).to_pylist() if own else [None] * b.num_rows
            for i, text in enumerate(b.column(text_col).to_pylist()):
                if text is None:
                    continue
                rows = [(0, 1, text, count(text))] if kind[i] == "table" else pack(text, delimiter, (sizes_for or {}).get(group[i], target), overlap, count, slices)
                for j, r in enumerate(rows):
                    at.append(i)
                    cells.append((j, *r))
            take = pa.array(at, pa.int64())
            new = [pa.array([c[k] for c in cells], t) for k, t in ((3, pa.string()), (0, pa.int32()), (4, pa.int32()), (1, pa.int32()), (2, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(b.column(n).take(take) for n in names), *new], names=[*names, text_col, "chunk_index", "n_tokens", "first_unit", "end_unit"])

    ship(records.sparkSession)
    return records.mapInArrow(run, f"{fields}{', ' if fields else ''}`{text_col}` string, chunk_index int, n_tokens int, first_unit int, end_unit int")


def slice_texts(docs: DataFrame, size: int, text_col: str = "text", slices: Callable[[str, int], list[str]] = word_slices) -> DataFrame:
    """One row for each slice of ``size`` tokens of a text: the other columns, then the slice under ``text_col``, and piece; null and empty texts have none."""
    names = [c for c in docs.columns if c != text_col]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(lo, SLICE) for whole in batches for lo in range(0, whole.num_rows, SLICE)):
            cut = [slices(t, size) if t else [] for t in b.column(text_col).to_pylist()]
            at = pa.array([i for i, own in enumerate(cut) for _ in own], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(n).take(at) for n in names), pa.array([p for own in cut for p in own], pa.string()), pa.array([j for own in cut for j in range(len(own))], pa.int32())], names=[*names, text_col, "piece"])

    ship(docs.sparkSession)
    return docs.mapInArrow(run, f"{fields}, `{text_col}` string, piece int")


def size_stats(chunks: DataFrame, target: int = TARGET, *keys: str) -> DataFrame:
    return chunks.groupBy(*keys).agg(F.min("n_tokens").alias("min_tokens"), F.max("n_tokens").alias("max_tokens"), F.floor(F.avg("n_tokens")).cast("long").alias("mean_tokens"), F.count_if(F.col("n_tokens") > target).alias("n_over"), F.count("*").alias("n_chunks"))


def dense(chunks: DataFrame, sections: tuple[str, ...], least: int = 80, section_col: str = "section") -> DataFrame:
    """Chunks of these sections with enough tokens; both conditions reach the scan."""
    return chunks.filter(F.col(section_col).isin(*sections) & (F.col("n_tokens") >= least))


def additivity_gap(text: str, delimiter: str = "\n\n", count: TokenCounter = word_count) -> int:
    """Tokens of the whole beyond the sum of its parts: 0 for a counter that adds up across joins."""
    parts = [p.strip() for p in text.split(delimiter) if p.strip()]
    return count(delimiter.join(parts)) - sum(map(count, parts))
