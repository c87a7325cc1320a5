"""Operator 2: benchmark decontamination.

One Aho-Corasick automaton over the normalised benchmark texts scans each
document once; hits are word positions, which ``spans`` maps to code points of
the original text.

A window is ten consecutive words of an item.  The automaton holds seeds: runs of five
words of the items, chosen so that every window contains one, and the rarest ones
of the benchmark; a hit of a seed is followed to both sides in the item as far as the document
goes along, and counts if ten words or more agree.  Items of fewer words are
patterns themselves.  That finds what an automaton over all windows would find, with
about a tenth of its nodes.  Words are coded as two symbols, so that no node has many children.

The benchmark reaches executors in blocks of at most ``BLOCK_WORDS`` words, so what
is broadcast at a time and what a task holds is bounded however large it grows.  Each worker
builds a block's automaton once; if the blocks are more than it may keep, it gathers ``HELD_BYTES``
of text and takes the blocks in turn.  A row in gives a row out at any size.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import beside, map_arrow, q, table
from quarryline.session import iterate

WINDOW = 10
#: Words of a block, of the blocks whose automata a worker keeps, and bytes of text that meet the blocks in turn if there are more.
BLOCK_WORDS, KEPT_WORDS, HELD_BYTES = 500_000, 1_000_000, 32 << 20
#: Words of a text before it is lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
#: Code of the words that no item has.
_NONE = "\0\0"

Item = tuple[object, list[bytes]]


def normalise(text: str | None) -> list[bytes]:
    """Words: A-Z lower-cased, everything but ASCII letters, digits and non-ASCII characters parts them."""
    return (text or "").encode().translate(_TABLE).split()


def _seeds(rows: list[array], window: int) -> Iterator[tuple[int, int]]:
    """(row, first word) of seeds: of the runs of half a window inside each window, the one that is rarest in all rows."""
    size = window // 2
    grams = [[tuple(r[i : i + size]) for i in range(len(r) - size + 1)] for r in rows]
    count = Counter(g for own in grams for g in own)
    for j, own in enumerate(grams):
        n = np.array([count[g] for g in own])
        best = np.lib.stride_tricks.sliding_window_view(n, window - size + 1).argmin(axis=1)
        for i in np.unique(best + np.arange(len(best))).tolist():
            yield j, i


class Finder:
    """The automaton of a block of items (id, words), with what it needs to follow its hits."""

    def __init__(self, items: list[Item], window: int = WINDOW) -> None:
        self.window, self.size = window, window // 2
        at: dict[bytes, int] = {}
        rows = [(item, array("I", [at.setdefault(w, len(at)) for w in words])) for item, words in items if words]
        base = int(len(at) ** 0.5) + 1
        self.code = {w: chr(1 + i // base) + chr(0x800 + i % base) for w, i in at.items()} if base < 0x700 else {w: chr(1 + i // base) + chr(0x20000 + i % base) for w, i in at.items()}
        self.ids = at
        self.long = [(item, r) for item, r in rows if len(r) >= window]
        found: dict[tuple[int, ...], tuple[list, list]] = {}
        for item, r in rows:
            if len(r) < window:
                found.setdefault(tuple(r), ([], []))[0].append(item)
        for j, i in _seeds([r for _, r in self.long], window):
            found.setdefault(tuple(self.long[j][1][i : i + self.size]), ([], []))[1].append((j, i))
        codes = list(self.code.values())
        self.automaton = ahocorasick.Automaton()
        for key, (short, seeds) in found.items():
            self.automaton.add_word("".join([codes[i] for i in key]), (len(key), tuple(short), tuple(seeds)))
        if found:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(first word, end word) of what agrees with items, and the items."""
        hits: list[tuple[int, int]] = []
        items: set = set()
        if not words or not len(self.automaton):
            return hits, items
        get = self.code.get
        body = "".join([get(w, _NONE) for w in words])
        text: list[int] | None = None
        reached: dict[tuple[int, int], int] = {}  # how far an item has been followed along a diagonal
        for end, (n, short, seeds) in self.automaton.iter(body):
            stop = (end + 1) // 2
            if short:
                hits.append((stop - n, stop))
                items.update(short)
            for j, i in seeds:
                first = stop - n
                if reached.get((j, first - i), -1) >= stop:
                    continue
                if text is None:
                    text = [self.ids.get(w, -1) for w in words]
                item, row = self.long[j]
                a, b, x = first, stop, i
                while a and x and text[a - 1] == row[x - 1]:
                    a, x = a - 1, x - 1
                x = i + n
                while b < len(text) and x < len(row) and text[b] == row[x]:
                    b, x = b + 1, x + 1
                reached[j, first - i] = b
                if b - a >= self.window:
                    hits.append((a, b))
                    items.add(item)
        return hits, items


def united(hits: list[tuple[int, int]]) -> list[int]:
    """Flat pairs (first word, end word) of the maximal runs that the hits cover; hits that only touch make one run."""
    out: list[int] = []
    for a, b in sorted(hits):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def spans(text: str, runs: list[int]) -> list[int]:
    """Flat pairs (start, end) in code points of the original, of runs of words."""
    at = [m.span() for m in WORD.finditer(text)]
    return [x for a, b in zip(runs[::2], runs[1::2], strict=True) for x in (at[a][0], at[b - 1][1])]


def _blocks(items: Iterator[tuple[object, str]], window: int) -> Iterator[list[Item]]:
    """Items as words, in blocks of about ``BLOCK_WORDS``; a longer item goes in parts that share a window but one word."""
    block: list[Item] = []
    size = 0
    step = max(BLOCK_WORDS, 2 * window)
    for item, text in items:
        words = normalise(text)
        for i in range(0, max(1, len(words) - window + 1), step):
            part = words[i : i + step + window - 1]
            if block and size + len(part) > BLOCK_WORDS:
                yield block
                block, size = [], 0
            if part:
                block.append((item, part))
                size += len(part)
    if block:
        yield block


class Benchmark:
    """The blocks of a benchmark (item_id, text) as executors get them."""

    def __init__(self, items: DataFrame, window: int = WINDOW) -> None:
        sc = items.sparkSession.sparkContext
        rows = iterate(items.select("item_id", F.col("text").cast("string")).filter("text IS NOT NULL"))
        self.key, self.window, self.words, self.blocks = uuid.uuid4().hex, window, 0, []
        for block in _blocks((tuple(r) for r in rows), window):
            self.words += sum(len(w) for _, w in block)
            self.blocks.append(sc.broadcast(block))  # bounded by BLOCK_WORDS

    def finders(self) -> Iterator[Finder]:
        held = globals().setdefault("_FINDERS", {})
        for i, b in enumerate(self.blocks):
            if self.words > KEPT_WORDS:
                yield Finder(b.value, self.window)
                continue
            if (self.key, i) not in held:
                if any(key != self.key for key, _ in held):
                    held.clear()
                held[self.key, i] = Finder(b.value, self.window)
            yield held[self.key, i]

    def scanned(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, list[int], set]]]]:
        """Each batch with (words, runs, items) of its rows; the text is the last column."""
        group: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            group.append(b)
            size += b.column(b.num_columns - 1).nbytes
            if self.words <= KEPT_WORDS or size >= HELD_BYTES:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)

    def _group(self, group: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, list[int], set]]]]:
        texts = [b.column(b.num_columns - 1).to_pylist() for b in group]
        found = [[(0, [], set()) for _ in own] for own in texts]
        for k, finder in enumerate(self.finders()):
            for own, rows in zip(texts, found, strict=True):
                for i, t in enumerate(own):
                    words = normalise(t)
                    hits, items = finder.find(words)
                    rows[i] = (len(words), rows[i][1] + hits, rows[i][2] | items) if k else (len(words), hits, items)
        if not self.blocks:
            found = [[(len(normalise(t)), [], set()) for t in own] for own in texts]
        for b, rows in zip(group, found, strict=True):
            yield b, [(n, united(hits), items) for n, hits, items in rows]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs, spans, items.

    ``runs`` holds flat pairs (first word, end word) of hit words, ``spans``
    the same in code points, ``items`` the ids found, sorted as strings.
    A null text or item has no words; an item without words never hits; equal
    items all count; an empty benchmark hits nothing; repeated rows give equal rows;
    other columns are ignored.
    """
    bench = Benchmark(benchmark, window)
    base = docs.select(F.col(q(id_col)).cast("long").alias("doc_id"), F.col(q(text_col)).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.int32())), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in bench.scanned(batches):
            at = [spans(t, r) if r else [] for t, (_, r, _) in zip(b.column("text").to_pylist(), rows, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for n, _, _ in rows], pa.int64()), pa.array([r for _, r, _ in rows], schema.field("runs").type), pa.array(at, schema.field("spans").type), pa.array([sorted(map(str, x)) for _, _, x in rows], schema.field("items").type)], schema=schema)

    return map_arrow(base, run, "doc_id long, n_words long, runs array<int>, spans array<int>, items array<string>")


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with all their columns whatever the names; a null text stays."""
    bench = Benchmark(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in bench.scanned(batches):
            mask = pa.array([not x for _, _, x in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in b.columns[:-1]], names=b.schema.names[:-1])

    base, fields = beside(docs, text_col)
    return map_arrow(base, run, fields).toDF(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row; a null text has no words, an empty benchmark hits nothing, repeated rows give equal rows."""
    hits = benchmark_hits(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    n_hit = F.expr("aggregate(transform(runs, (x, i) -> IF(i % 2 = 0, -x, x)), 0L, (a, x) -> a + x)")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


SQL_OP2 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[s:s+least(len(ws), 10)-1], ' ') AS k FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, s, n, array_to_string(ws[s:s+n-1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
h AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.n = iw.n),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
