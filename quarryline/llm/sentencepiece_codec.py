"""Operator 3: SentencePiece encoding and decoding by suffix-array matching.

Texts fall into units that no piece crosses (a run of spaces with the word
behind it).  The distinct units of a batch are concatenated and their
suffixes sorted; every piece of the vocabulary finds its range of occurrences
by binary search, the occurrences become edges, edges are sorted by position,
and one relaxation over positions gives each unit's pieces.

The model merges by rank (BPE), so an edge is relaxed if its piece may follow
the piece that ends where it starts: two neighbours are right exactly if merging
them by rank would leave them apart, and a chain of right neighbours
is the model's own segmentation.  That test needs no search (``Vocabulary.apart``).
Characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import add_column, map_arrow, table
from quarryline.llm.textcore import mix

MODEL = os.environ.get("QUARRYLINE_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
#: Units and their characters whose pieces a worker remembers, at most.
CACHE_UNITS, CACHE_CHARS = 500_000, 1 << 23
#: Characters of new units that are indexed together, and of texts that are encoded together (a longer one stands alone).
BLOCK_CHARS, TEXT_CHARS = 1 << 18, 1 << 20
START, NONE = -2, -1


def _merge(text: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The parts of the last merge, if merging by rank leaves ``text`` whole."""
    parts, last = list(text), None
    while len(parts) > 1:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank), default=None)
        if best is None:
            return None
        i = best[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return last


class Vocabulary:
    """Pieces, their ranks, their last merges and the pairs that merge."""

    def __init__(self, pieces: list[str], scores: list[float], plain: list[bool], first_byte: int) -> None:
        self.size, self.first_byte = len(pieces), first_byte
        order = {s: i for i, s in enumerate(sorted({s for s, p in zip(scores, plain, strict=True) if p}, reverse=True))}
        rank = {p: order[s] for p, s, ok in zip(pieces, scores, plain, strict=True) if ok}
        at = {p: i for i, (p, ok) in enumerate(zip(pieces, plain, strict=True)) if ok}
        n = self.size
        self.rank = np.full(n + 1, -1, np.int64)
        self.left, self.right = np.arange(n + 1), np.arange(n + 1)
        self.usable = np.zeros(n, bool)
        pairs = []
        for p, i in at.items():
            if len(p) == 1:
                self.usable[i] = True
            else:
                split = _merge(p, rank)
                if split:
                    self.usable[i], self.rank[i] = True, rank[p]
                    self.left[i], self.right[i] = at[split[0]], at[split[1]]
            pairs += [(at[p[:k]] * (n + 1) + at[p[k:]], rank[p]) for k in range(1, len(p)) if p[:k] in at and p[k:] in at]
        pairs.sort()
        self.pair_key = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.pair_rank = np.array([r for _, r in pairs] or [0], np.int64)
        chars = sorted({c for p in at for c in p})
        self.code_of = np.array([0, *map(ord, chars)], np.uint32)
        self.breaks = "".join(c for c in "\n\t\r" if c not in chars)
        self.unit = re.compile(f"{SPACE}+[^{SPACE}{self.breaks}]*|[{self.breaks}]|[^{SPACE}{self.breaks}]+" if self.breaks else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        use = sorted((p, i) for p, i in at.items() if self.usable[i])
        self.ids = np.array([i for _, i in use], np.int64)
        self.lens = np.array([len(p) for p, _ in use], np.int64)
        self.width = int(self.lens.max()) if len(use) else 1
        self.length = np.ones(n + 1, np.int64)
        self.length[self.ids] = self.lens
        low = np.zeros((len(use), self.width), ">u2")
        high = np.full((len(use), self.width), 0xFFFF, ">u2")
        for r, (p, _) in enumerate(use):
            low[r, : len(p)] = high[r, : len(p)] = self.codes(np.array([ord(c) for c in p], np.uint32))
        self.low, self.high = (x.view(f"S{2 * self.width}").ravel() for x in (low, high))
        self.bytes_of = [bytes([i - first_byte]) if first_byte <= i < first_byte + 256 and first_byte > 0 else p.replace(SPACE, " ").encode() if ok else b"" for i, (p, ok) in enumerate(zip(pieces, plain, strict=True))]

    def codes(self, cps: np.ndarray) -> np.ndarray:
        """Dense codes of characters; 0 for those outside the vocabulary."""
        at = np.minimum(np.searchsorted(self.code_of[1:], cps) + 1, len(self.code_of) - 1)
        return np.where(self.code_of[at] == cps, at, 0).astype(np.uint16)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece ``b`` may follow ``a``: no merge across their border comes before the merges that made them."""
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 1 << 40, np.int64)
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a < self.size) & (b < self.size))
        while len(live):
            x, y = a[live], b[live]
            key = x * (self.size + 1) + y
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            ok[live] = ~((self.pair_key[at] == key) & (self.pair_rank[at] < limit[live]))
            rx, ry = self.rank[x], self.rank[y]
            first = rx > ry
            limit[live] = np.where(first, rx, ry + 1)
            a[live] = np.where(first, self.right[x], x)
            b[live] = np.where(first, y, self.left[y])
            live = live[ok[live] & (np.maximum(rx, ry) >= 0)]
        return ok


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at : at + size]
        at += size


def check_model(data: bytes) -> None:
    """Raise for models that this codec would encode otherwise than the library: it merges by rank over unchanged text."""
    # Numbers of fields and of the kind BPE in the file format of the models.
    trainer, normaliser, bpe = 2, 3, 2
    parts = {k: dict(_fields(v)) for k, v in _fields(data) if k in (trainer, normaliser)}
    if parts.get(trainer, {}).get(3, 1) != bpe:
        raise ValueError("the model isn't BPE")
    spec = parts.get(normaliser, {})
    if spec.get(2):
        raise ValueError("the model changes characters before it encodes")
    if not spec.get(3, 1) or spec.get(4, 1) or not spec.get(5, 1) or parts[trainer].get(24, 0):
        raise ValueError("the model treats spaces in another way: it must put one in front, keep all and escape them")


def load(path: str) -> Vocabulary:
    """The vocabulary of a model file (read on the driver; workers get the object); models of another kind are an error."""
    import sentencepiece

    with open(path, "rb") as f:
        check_model(f.read())
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
    first = next((i for i in range(n) if sp.is_byte(i)), -1)
    return Vocabulary([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], plain, first)


@lru_cache(maxsize=2)
def _loaded(path: str) -> Vocabulary:
    return load(path)


class Codec:
    """Encodes and decodes with a vocabulary; remembers the units it has met."""

    def __init__(self, vocabulary: Vocabulary, cache_units: int = CACHE_UNITS) -> None:
        self.v, self.cache_units = vocabulary, cache_units
        self.forget()
        self.known = np.full(1 << 20, -1, np.int64)
        self.answer = np.zeros(1 << 20, bool)

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.flat: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.count: list[np.ndarray] = [np.zeros(0, np.int64)]

    def units(self, text: str) -> list[str]:
        return self.v.unit.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``apart`` behind a table of recent answers."""
        key = a * (self.v.size + 1) + b
        slot = (mix(key.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        out = self.answer[slot]
        new = np.flatnonzero(self.known[slot] != key)
        if len(new):
            out[new] = self.v.apart(a[new], b[new])
            self.known[slot[new]], self.answer[slot[new]] = key[new], out[new]
            if len(np.unique(slot[new])) < len(new):  # two keys of one slot: keep what belongs together
                self.known[slot[new]] = -1
        return out

    def segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all units in turn, number of pieces of each); units are not empty."""
        v = self.v
        size = np.array([len(u) for u in units], np.int64)
        begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        cps = np.frombuffer("\0".join(units).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32)
        n = len(cps)
        unit_of = np.repeat(np.arange(len(units)), size + 1)
        codes = v.codes(cps)
        codes[begin + size] = 0
        # Suffix array, up to the longest piece.
        padded = np.zeros(n + v.width, ">u2")
        padded[:n] = codes
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, v.width)[:n]).view(f"S{2 * v.width}").ravel()
        order = np.argsort(suffixes)
        ranked = suffixes[order]
        # Range of occurrences of every piece.
        lo, hi = np.searchsorted(ranked, v.low, "left"), np.searchsorted(ranked, v.high, "right")
        count = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(count)), count)
        start = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        piece, length = v.ids[which], v.lens[which]
        # Characters that no piece has.
        own = np.ones(n, bool)
        own[begin + size] = False
        odd = np.flatnonzero((codes == 0) & own)
        start = np.concatenate([start, odd])
        piece, length = np.concatenate([piece, np.full(len(odd), v.size)]), np.concatenate([length, np.ones(len(odd), np.int64)])
        # Edges by position of their end inside the unit.
        end = start + length
        where = end - begin[unit_of[start]]
        by = np.argsort(where, kind="stable")
        start, piece, end, where = start[by], piece[by], end[by], where[by]
        last = np.full(n + 1, NONE, np.int64)
        last[begin] = START
        steps = np.searchsorted(where, np.arange(1, int(size.max()) + 2))
        for k in range(len(steps) - 1):
            s = slice(steps[k], steps[k + 1])
            before = last[start[s]]
            live = np.flatnonzero(before != NONE)
            if not len(live):
                continue
            before, t, e = before[live], piece[s][live], end[s][live]
            good = before == START
            more = np.flatnonzero(~good)
            if len(more):
                good[more] = self._apart(before[more], t[more])
            last[e[good]] = t[good]
        # Walk back from the ends, all units at once.
        at, alive = begin + size, np.arange(len(units))
        rows, got, tail = [], [], []
        while len(alive):
            t = last[at[alive]]
            rows.append(alive)
            got.append(t)
            tail.append(cps[at[alive] - 1])
            at[alive] -= v.length[t]
            alive = alive[at[alive] > begin[alive]]
        step = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        rows, got, tail = np.concatenate(rows), np.concatenate(got), np.concatenate(tail)
        by = np.lexsort((-step, rows))
        rows, got, tail = rows[by], got[by], tail[by]
        counts = np.bincount(rows, minlength=len(units))
        if (got == v.size).any():
            got, counts = self._bytes(got, tail, rows, len(units))
        return got.astype(np.int32), counts

    def _bytes(self, got: np.ndarray, chars: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces in place of the characters outside the vocabulary (``chars``: the last of each piece)."""
        odd = got == self.v.size
        if self.v.first_byte <= 0:
            return np.where(odd, 0, got), np.bincount(rows, minlength=n)
        cp = chars[odd].astype(np.int64)
        wide = np.ones(len(got), np.int64)
        wide[odd] = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
        out = np.repeat(got, wide)
        raw = "".join(map(chr, cp.tolist())).encode("utf-8", "surrogatepass")
        out[np.repeat(odd, wide)] = np.frombuffer(raw, np.uint8).astype(np.int64) + self.v.first_byte
        return out, np.bincount(rows, weights=wide, minlength=n).astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Piece ids of each text; none for null and empty texts."""
        out, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size >= TEXT_CHARS:
                out += self._encode(held)
                held, size = [], 0
        return out + self._encode(held)

    def _learn(self, new: list[str]) -> None:
        """Segment new units in blocks, and remember them."""
        ends = np.cumsum([len(u) + 1 for u in new])
        lo = 0
        while lo < len(new):
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + BLOCK_CHARS, "right")))
            flat, count = self.segment(new[lo:hi])
            self.flat.append(flat)
            self.count.append(count)
            lo = hi
        self.flat, self.count = [np.concatenate(self.flat)], [np.concatenate(self.count)]
        self.chars += int(ends[-1])

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.index) > self.cache_units or self.chars > CACHE_CHARS:
            self.forget()
        index, new = self.index, []
        rows = []
        for t in texts:
            row = []
            for u in self.units(t or ""):
                i = index.get(u)
                if i is None:
                    i = index[u] = len(index)
                    new.append(u)
                row.append(i)
            rows.append(np.array(row, np.int32))
        if new:
            self._learn(new)
        flat, count = self.flat[0], self.count[0]
        first = np.cumsum(count) - count
        out = []
        for r in rows:
            n = count[r]
            total = int(n.sum())
            out.append(flat[np.arange(total) + np.repeat(first[r] - (np.cumsum(n) - n), n)] if total else np.zeros(0, np.int32))
        return out

    def decode(self, ids: np.ndarray | list[int | None]) -> str:
        """Text of piece ids, without the space that encoding puts in front.

        Control pieces stand for nothing; an id outside the vocabulary, a null and bytes that are no UTF-8 give U+FFFD.
        """
        known = self.v.bytes_of
        text = b"".join([known[i] if i is not None and 0 <= i < len(known) else b"\xef\xbf\xbd" for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _codec(shared, key: str) -> Codec:
    """One codec for each worker process and model."""
    held = globals().setdefault("_CODECS", {})
    if key not in held:
        held.clear()
        held[key] = Codec(shared.value)
    return held[key]


def encode_column(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", model: str = MODEL) -> DataFrame:
    """``docs`` with the piece ids of ``text_col`` in ``ids_col`` (array<int>).

    Null and empty texts have no ids; texts of any length are encoded whole.  A
    column named ``ids_col`` is replaced, others stay whatever their names; rows
    are independent, so repeated ones give equal ids and an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_loaded(model))  # as large as the vocabulary

    def ids_of(texts: pa.Array) -> pa.Array:
        ids = _codec(shared, model).encode(texts.to_pylist())
        at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
        return pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32()))

    return add_column(docs, ids_col, "array<int>", text_col, ids_of)


def decode_column(docs: DataFrame, ids_col: str = "token_ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` with the text of ``ids_col`` in ``text_col``.

    Null and empty ids give an empty text; ids that the vocabulary doesn't have, and null ones, give U+FFFD.
    A column named ``text_col`` is replaced, others stay whatever their names; rows are independent.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_loaded(model))
    return add_column(docs, text_col, "string", ids_col, lambda ids: pa.array([_codec(shared, model).decode(x or []) for x in ids.to_pylist()], pa.string()), cast="array<int>")


def _digest(shared, model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, model)
        for b in batches:
            texts = b.column("text").to_pylist()
            ids = codec.encode(texts)
            fall = codec.v.first_byte
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([int(((x >= fall) & (x < fall + 256)).sum()) if fall > 0 else 0 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]),
                    pa.array([codec.decode(x) == (t or "").replace(SPACE, " ") for x, t in zip(ids, texts, strict=True)]),
                ],
                names=["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip"],
            )

    return run


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Every text encoded and decoded: doc_id, n_tokens, n_byte_tokens, ids_sha256 (of little-endian 32-bit ids), round_trip.

    Null and empty texts have no ids and come back as empty; repeated rows give equal rows, an empty table an empty one.
    """
    shared = spark.sparkContext.broadcast(_loaded(model))
    return map_arrow(table(spark, sf_dir, "documents", "doc_id", "text"), _digest(shared, model), "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean")
