"""Operator 13: token ids in binary files, by word-aligned packing.

File format: a Parquet table whose rows are pages, in the order (shard, page).
A page holds whole documents: their ids and counts as lists, and all token ids
as one ``payload``:

    magic, version, block size, number of ids, blocks, words, escapes    (HEADER)
    first word of each block                                             (uint32)
    words                                                                (uint64)
    escapes                                                              (uint64)

A word has a selector in its upper four bits; the other 60 hold ``COUNTS[selector]``
values of ``WIDTHS[selector]`` bits, the first in the lowest.  Selector 0 is an
escape: the 60 bits say where in the escapes a value of more than 60 bits stands.  Every
``BLOCK`` ids begin a new word, so blocks are packed and unpacked side by side:
one numpy step packs the next word of all blocks, and one step for
each selector unpacks all its words.  A block's last word may have room for more than is left; the reader knows the number of ids.

Documents are dealt by ranges of their id, so the shards follow each other and a
shard's ids begin where the ones before it end.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.llm.common import map_arrow, q, table
from quarryline.session import drop_at_exit, saved, shared_folder

U = np.uint64
#: Values in a word and bits of each, by selector; the layout of the format.
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
#: Ids that are packed from a word of their own.
BLOCK = 256
MAGIC, VERSION = b"QLTI", 1
HEADER = struct.Struct("<4sIIQIIQ")
#: A page ends with the document that brings it to so many ids.
PAGE_IDS = 1 << 19
#: Path of the tokenizer, and the id that ends a document.
TOKENIZER = os.environ.get("QUARRYLINE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
END_ID = 0
#: What a worker remembers of units: so many, and so many characters.
CACHE_UNITS, CACHE_CHARS = 1_300_000, 20_000_000


def pack(ids: np.ndarray) -> bytes:
    """The payload of ids (any unsigned integers up to 64 bits)."""
    v = np.ascontiguousarray(ids, dtype=U)
    n = len(v)
    blocks = -(-n // BLOCK)
    escape = np.flatnonzero(v >> U(60))
    # the longest run that fits in a word at each place: wider selectors first, narrower ones hold more and take over
    place = np.arange(n, dtype=np.int32)
    end = np.minimum((place // BLOCK + 1) * BLOCK, n)
    choice = np.zeros(n, dtype=np.int8)
    taken = np.ones(n, dtype=np.int32)
    widest = int(v.max()) if n else 0
    widest, may = int(v.max()) if n else 0, place
    narrow = v.astype(np.uint32) if widest < 1 << 32 else v
    for s in range(len(COUNTS) - 1, 0, -1):
        if widest >> WIDTHS[s]:
            small = narrow < narrow.dtype.type(1 << WIDTHS[s])
            may = may[small[may]]  # what a narrower word can begin with, a wider one can
            if not len(may):
                break
            wide = np.zeros(n + 1, dtype=np.int32)  # how many of the values before a place are too wide
            np.cumsum(~small, out=wide[1:])
            stop = np.minimum(may + np.int32(COUNTS[s]), end[may])
            fits = wide[stop] == wide[may]
            choice[may[fits]] = s
            taken[may[fits]] = (stop - may)[fits]
        else:
            choice[:] = s
            taken = np.minimum(place + np.int32(COUNTS[s]), end) - place
    at = np.arange(blocks, dtype=np.int64) * BLOCK
    stops = np.minimum(at + BLOCK, n)
    firsts, owners = [], []
    live = np.arange(blocks)
    while len(live):
        firsts.append(at[live])
        owners.append(live)
        at[live] += taken[at[live]]
        live = live[at[live] < stops[live]]
    first = np.sort(np.concatenate(firsts)) if firsts else np.zeros(0, np.int64)
    words = choice[first].astype(U) << U(60)
    padded = np.concatenate([v, np.zeros(max(COUNTS), U)])
    kind = choice[first]
    for s in range(1, len(COUNTS)):
        of = np.flatnonzero(kind == s)
        if len(of):
            lanes = np.arange(COUNTS[s])
            got = padded[first[of, None] + lanes]
            got[lanes >= taken[first[of], None]] = 0
            words[of] |= np.bitwise_or.reduce(got << (lanes * WIDTHS[s]).astype(U), axis=1)
    words[kind == 0] |= np.searchsorted(escape, first[kind == 0]).astype(U)
    starts = np.searchsorted(first, np.arange(blocks, dtype=np.int64) * BLOCK).astype("<u4")
    head = HEADER.pack(MAGIC, VERSION, BLOCK, n, blocks, len(words), len(escape))
    return head + starts.tobytes() + words.astype("<u8").tobytes() + v[escape].astype("<u8").tobytes()


def unpack(payload: bytes, first: int = 0, end: int | None = None) -> np.ndarray:
    """Ids ``first`` up to ``end`` of a payload; only the blocks that hold them are read."""
    magic, version, size, n, blocks, n_words, n_escapes = HEADER.unpack_from(payload)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a page of token ids, or of another version")
    if len(payload) != HEADER.size + 4 * blocks + 8 * (n_words + n_escapes):
        raise ValueError("the page is cut short")
    end = n if end is None else min(end, n)
    if first >= end:
        return np.zeros(0, U)
    starts = np.append(np.frombuffer(payload, "<u4", blocks, HEADER.size).astype(np.int64), n_words)
    lo, hi = first // size, -(-end // size)
    words = np.frombuffer(payload, "<u8", n_words, HEADER.size + 4 * blocks)[starts[lo] : starts[hi]].astype(U)
    escapes = np.frombuffer(payload, "<u8", n_escapes, HEADER.size + 4 * blocks + 8 * n_words)
    kind = (words >> U(60)).astype(np.int64)
    if len(kind) and kind.max() >= len(COUNTS):
        raise ValueError("unknown selector")
    words &= U((1 << 60) - 1)
    counts = np.array(COUNTS)[kind]
    before = np.cumsum(counts) - counts
    own = starts[lo:hi] - starts[lo]  # each block's first word
    block = np.repeat(np.arange(hi - lo), np.diff(np.append(own, len(words))))
    # a block has room behind it for what its last word holds too many
    wide = size + max(COUNTS)
    at = before - before[own][block] + block * wide
    out = np.zeros((hi - lo) * wide, dtype=U)
    for s in range(len(COUNTS)):
        of = np.flatnonzero(kind == s)
        if s == 0:
            out[at[of]] = escapes[words[of].astype(np.int64)]
        elif len(of):
            lanes = np.arange(COUNTS[s])
            out[at[of, None] + lanes] = (words[of, None] >> (lanes * WIDTHS[s]).astype(U)) & U((1 << WIDTHS[s]) - 1)
    return out.reshape(hi - lo, wide)[:, :size].ravel()[first - lo * size : end - lo * size]


def _loose(part: str) -> bool:
    """Whether a part between single spaces may not stand for itself: what is next to it is more white space."""
    return not part or part[0].isspace() or part[-1].isspace() or "\u180e" in part


#: Where the pattern of a byte-level tokenizer always splits: around a line feed between characters that are no white space, and behind
#: a letter or digit that every version of Unicode knows, before a stop.
_INNER = re.compile(r"(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)|(?<=[0-9A-Za-zÀ-ÖØ-öø-ÿ])(?=[.,;:!?])")


_STOPS = frozenset(".,;:!?")
LOOSE = -1


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct unit once.

    A byte-level tokenizer without a normaliser splits a text before any single space between two characters that are no
    white space, whatever stands around them.  So the parts between such spaces are encoded by the library
    on their own (with the space before them, but for the first of a text) and put together; parts that begin or
    end with white space, or are empty, are joined to their neighbours first.  A part is cut further at ``_INNER``, so that a word
    and the same word before a stop are one unit.  Another kind of tokenizer gets whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre = told.get("pre_tokenizer") or {}
        plain = not any(re.search(r"[\s.,;:!?]", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in told.get("added_tokens") or [])
        cut = told.get("truncation") or told.get("padding")
        self.by_unit = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not told.get("normalizer") and told["model"]["type"] == "BPE" and not told["model"].get("dropout") and plain and not cut
        self.forget()

    def forget(self) -> None:
        self.parts: dict[str, int] = {}  # parts behind a space, by number; LOOSE if they don't stand for themselves
        self.units: dict[str, int] = {}  # other runs of text, by number
        self.flat, self.first, self.count, self.chars = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.new: list[str | list[int]] = []  # of the numbers not yet learned: a run for the library, or the numbers of its pieces

    def _library(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [e.ids for e in self.library.encode_batch_fast(units, add_special_tokens=False)]
        return np.array([i for r in rows for i in r], np.uint32), np.array([len(r) for r in rows], np.int64)

    def _add(self, text: str) -> int:
        """A new run's number; pieces of it that are runs themselves come first."""
        made: str | list[int] = text
        if text[-1:] in _STOPS or "\n" in text:
            pieces = _INNER.split(text)
            if len(pieces) > 1:
                made = [self._number(p) for p in pieces]
        self.new.append(made)
        self.chars += len(text)
        return len(self.count) + len(self.new) - 1

    def _part(self, part: str) -> int:
        """Number of a part behind a space."""
        x = self.parts.get(part)
        if x is None:
            x = self.parts[part] = LOOSE if _loose(part) else self._add(" " + part)
        return x

    def _number(self, text: str) -> int:
        """Number of any run of text that stands for itself."""
        if text[:1] == " " and (x := self._part(text[1:])) != LOOSE:
            return x
        x = self.units.get(text)
        if x is None:
            x = self.units[text] = self._add(text)
        return x

    def _joined_parts(self, parts: list[str]) -> list[int]:
        """Numbers of a text with loose parts, each joined to what is next to it."""
        out, run, before = [], [parts[0]], parts[0]
        for part in parts[1:]:
            if _loose(before) or _loose(part):
                run.append(part)
            else:
                out.append(" ".join(run))
                run = [part]
            before = part
        out.append(" ".join(run))
        return [self._number(" " + u if i else u) for i, u in enumerate(out) if i or u]

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none."""
        if not self.by_unit:
            flat, count = self._library([t or "" for t in (texts if isinstance(texts, list) else texts.to_pylist())])
            return np.split(flat, np.cumsum(count)[:-1])
        if len(self.count) > CACHE_UNITS or self.chars > CACHE_CHARS:
            self.forget()
        held = gc.isenabled()
        gc.disable()  # very many small objects, none in a cycle
        try:
            return self._by_parts(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        finally:
            if held:
                gc.enable()

    def _by_parts(self, texts: pa.Array) -> list[np.ndarray]:
        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        bounds = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        known = coded.dictionary.to_pylist()
        place = coded.indices.to_numpy()
        number = list(map(self.parts.get, known))
        for i, x in enumerate(number):
            if x is None:
                number[i] = self._part(known[i])
        numbers = np.array(number, np.int64)[place]
        loose = np.add.reduceat(numbers == LOOSE, bounds[:-1]) > 0 if len(bounds) > 1 else np.zeros(0, bool)
        rows = []
        for lo, hi, odd in zip(bounds[:-1].tolist(), bounds[1:].tolist(), loose.tolist(), strict=True):
            head = known[place[lo]]
            if hi - lo == 1:
                rows.append(np.array([self._number(head)] if head else [], np.int64))
            elif odd:
                rows.append(np.array(self._joined_parts([known[i] for i in place[lo:hi]]), np.int64))
            else:
                row = numbers[lo:hi]
                row[0] = self._number(head)
                rows.append(row)
        self._learn()
        every = np.concatenate([np.zeros(0, np.int64), *rows])
        ends = np.cumsum(np.append(0, self.count[every]))[np.cumsum([len(r) for r in rows])] if rows else []
        return np.split(self._joined(every), ends[:-1]) if rows else []

    def _joined(self, numbers: np.ndarray) -> np.ndarray:
        n = self.count[numbers]
        total = int(n.sum())
        return self.flat[np.arange(total) + np.repeat(self.first[numbers] - (np.cumsum(n) - n), n)] if total else np.zeros(0, np.uint32)

    def _learn(self) -> None:
        if not self.new:
            return
        alone = np.array([isinstance(x, str) for x in self.new])
        at = len(self.count) + np.flatnonzero(alone)
        flat, count = self._library([x for x in self.new if isinstance(x, str)])
        self.first = np.concatenate([self.first, np.zeros(len(alone), np.int64)])
        self.count = np.concatenate([self.count, np.zeros(len(alone), np.int64)])
        self.first[at], self.count[at] = len(self.flat) + np.cumsum(count) - count, count
        self.flat = np.concatenate([self.flat, flat])
        made = [x for x in self.new if not isinstance(x, str)]
        if made:
            at = len(self.count) - len(alone) + np.flatnonzero(~alone)
            pieces, sizes = np.array([i for x in made for i in x], np.int64), np.array([len(x) for x in made])
            count = np.add.reduceat(self.count[pieces], np.cumsum(sizes) - sizes)
            flat = self._joined(pieces)
            self.first[at], self.count[at] = len(self.flat) + np.cumsum(count) - count, count
            self.flat = np.concatenate([self.flat, flat])
        self.new = []


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


#: Bytes of texts that are encoded together; a longer text is on its own.
GROUP_BYTES = 4 << 20
_PAGE = pa.schema([("shard", pa.int64()), ("page", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("payload", pa.binary())])
_PAGE_DDL = "shard long, page long, before long, n_ids long, doc_ids array<long>, counts array<long>, payload binary"


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + GROUP_BYTES, side="right")) - 1)
        yield lo, hi
        lo = hi


def _pages(tokenizer: str, end_id: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents in order to pages; the shard is the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, page, before = TaskContext.get().partitionId(), 0, 0
        encoder = _encoder(tokenizer)
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal page, before, ids, docs, held
            row = {"shard": shard, "page": page, "before": before, "n_ids": held, "doc_ids": docs, "counts": [len(x) for x in ids], "payload": pack(np.concatenate(ids))}
            page, before, ids, docs, held = page + 1, before + held, [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_PAGE)

        for b in batches:
            names, texts = b.column("doc_id").to_pylist(), b.column("text")
            for lo, hi in _groups(texts):
                part = encoder.encode(texts[lo:hi])
                for name, x in zip(names[lo:hi], part, strict=True):
                    x = x if end_id is None else np.append(x, np.uint32(end_id))
                    docs.append(name)
                    ids.append(x)
                    held += len(x)
                    if held >= PAGE_IDS:
                        yield flush()
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int | None = END_ID) -> None:
    """Encode every text and write its ids as pages under ``path``, documents by ascending id.

    Null and empty texts have the end id alone (or no ids without one).  Texts of any length are
    encoded whole and stay in one page.  Null ids come first; rows of one id stand by their
    text's hash and then as the source lists them, each a document of its own.
    An empty table writes a table without pages.  Other columns are ignored.  Ids fit 32 bits.
    A task that runs again writes the same pages; Spark's committer publishes the files of a job at once.
    """
    rows = docs.select(F.col(q(id_col)).cast("long").alias("doc_id"), F.col(q(text_col)).cast("string").alias("text"))
    rows = rows.withColumns({"key": F.xxhash64("text"), "seq": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("key").asc(), F.col("seq").asc()]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    map_arrow(laid, _pages(tokenizer, end_id), _PAGE_DDL).write.option("compression", "uncompressed").parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Pages with ``start``, the number of ids before them.

    Only the shards' totals are summed up in order: one number a file.
    """
    pages = spark.read.parquet(path)
    totals = pages.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    totals = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    # a table of known size: one row a shard, which Spark broadcasts while it is small, so that the pages stay where they are
    return pages.join(saved(totals), "shard").withColumn("start", F.col("offset") + F.col("before"))


def _decoded(each: Callable[[np.ndarray], object], kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each document of the pages: doc_id, start, n_tokens, and ``each`` of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = unpack(row["payload"]).astype("<u4")
                counts = np.array(row["counts"], np.int64)
                at = np.cumsum(counts) - counts
                if int(counts.sum()) != len(ids):
                    raise ValueError("a page's counts don't add up to its ids")
                values = [each(ids[a : a + n]) for a, n in zip(at, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(at + row["start"]), pa.array(counts), pa.array(values, kind)], names=["doc_id", "start", "n_tokens", "made"])

    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document written under ``path``: doc_id, start (ids of all documents before it), n_tokens, ids (array<long>)."""
    return map_arrow(_placed(spark, path).select("doc_ids", "counts", "payload", "start"), _decoded(lambda x: x.astype(np.int64), pa.list_(pa.int64())), "doc_id long, start long, n_tokens long, made array<long>").withColumnRenamed("made", "ids")


def read_token_range(spark: SparkSession, path: str, first: int, end: int) -> DataFrame:
    """Ids ``first`` up to ``end`` of the whole sequence, in parts: start, ids; of a page only the blocks in the range are unpacked."""
    pages = _placed(spark, path).filter((F.col("start") < end) & (F.col("start") + F.col("n_ids") > first)).select("start", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                lo = max(first - row["start"], 0)
                ids = unpack(row["payload"], lo, max(end - row["start"], 0)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([row["start"] + lo]), pa.array([ids], pa.list_(pa.int64()))], names=["start", "ids"])

    return map_arrow(pages, run, "start long, ids array<long>")


def op13_token_files(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read back from the files; nulls and the rest as in ``write_token_files``."""
    path = f"{shared_folder(spark)}/quarryline-tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents", "doc_id", "text"), path, tokenizer=tokenizer)
    drop_at_exit(spark, path)
    pages = _placed(spark, path).select("doc_ids", "counts", "payload", "start")
    return map_arrow(pages, _decoded(lambda x: zlib.crc32(x.tobytes()), pa.int64()), "doc_id long, start long, n_tokens long, made long").withColumnRenamed("made", "ids_crc32")
