"""Operator 10: near-duplicate classes.

Improved consistent weighted sampling (ICWS) over TF-IDF weighted shingles of
five words, banded, verified by weighted Jaccard similarity.

* A shingle's weight is its count in the text times ``sqrt(1 + log10(N / df))``, where
  df is the number of the N documents that hold it: an IDF damped so that copies in a large group, whose
  shared shingles are frequent for that very reason, stay near each other.  Documents are dealt to
  chunks by a hash; a chunk sends each of its shingles once, with a count, to
  the bucket of the shingle's upper bits, and the bucket sends the df of those in
  two or more documents back to the chunks that hold them.  Any other shingle
  has a df of 1.  A row is a packed run of shingles, so a shingle in every
  document costs no more than one entry a chunk, and copies within a chunk
  are hashed once.
* Whatever two documents share has a df of two or more.  So a text whose
  shingles of that kind carry less than ``similarity`` of its weight is near
  nothing, and only the others are sampled.
* Texts, not rows, are compared: a node is a text (by its MD5).  Each bucket of
  a band pairs its members with its least one (a star); the pairs that verify are contracted
  to classes.  In groups that still hold several classes, ``ROUNDS`` further members
  are each compared with all members of other classes, and classes are contracted again.  What
  is left in several classes is compared in cells: members outside a group's
  largest class meet all the others.  So rows grow with the members of a
  group, and by another factor only for what is not near the rest of its group.
* A candidate pair is skipped only if it has fewer equal samples than a pair at the
  similarity asked for has but once in 1 / MISS.
* Keys with very many rows (a text with copies, the centre of a star) are
  dealt to many tasks by ``spread_join``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import Scratch, map_arrow, own_name, q, shared_table, spread_join, table, tune
from quarryline.llm.textcore import U, mix, ngram_hashes, text_chunks, word_bounds, word_hashes
from quarryline.session import ship

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
SEED = 10
_TABLE_BITS = 18
#: Chance that a candidate pair just at the similarity asked for isn't compared exactly, as it has too few equal samples.
MISS = 1e-6
#: Members beside the least one that are compared with all of a group before its cells are.
ROUNDS = 1
#: Members and shingles that a cell takes from either side, about (a longer text stands alone).
CELL, CELL_SHINGLES = 128, 1 << 19
#: Shingles that are sampled together.
BLOCK_SHINGLES = 1 << 16
#: Characters of a chunk of documents and of the shingles of a bucket, about; there are at least PARTS of both.
PART_CHARS = 1 << 22
PARTS = 256


def _shingles(texts: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(sorted distinct shingles, their counts or None if all are one) of each text in turn."""
    for lo, hi, data, off in text_chunks(texts):
        starts, ends, at = word_bounds(data, off)
        words = word_hashes(data, starts, ends)
        grams = ngram_hashes(words, SHINGLE)
        for i in range(hi - lo):
            a, b = at[i], at[i + 1]
            if b - a < SHINGLE:
                yield (ngram_hashes(words[a:b], int(b - a)) if b > a else grams[:0]), None
                continue
            h = np.sort(grams[a : b - SHINGLE + 1])
            same = h[1:] == h[:-1]
            if not same.any():
                yield h, None
                continue
            new = np.flatnonzero(np.concatenate([[True], ~same]))
            yield h[new], np.diff(np.append(new, len(h)))


def _pack(h: np.ndarray) -> bytes:
    """Sorted shingles as bytes: differences, by place of the byte, so that the upper ones compress."""
    return np.diff(h, prepend=U(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, np.uint8).reshape(8, -1).T.copy().view(U).ravel(), dtype=U)


def _pack_counts(n: np.ndarray) -> bytes:
    return n.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack_counts(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()


def _lookup(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Position of each value in sorted ``known``, or -1."""
    if not len(known):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


def _firsts(keys: pa.ChunkedArray) -> tuple[np.ndarray, list[int]]:
    """Rows of the first of each key, and how often each occurs, in order of the rows."""
    seen: dict[bytes, int] = {}
    count = Counter(keys.to_pylist())
    for i, k in enumerate(keys.to_pylist()):
        seen.setdefault(k, i)
    return np.array(list(seen.values()), np.int64), [count[k] for k in seen]


def _chunk_counts(bits: int):
    """Shingles of a chunk of documents with the number of these that hold them, a row for each bucket."""

    def run(t: pa.Table) -> pa.Table:
        at, copies = _firsts(t.column("k"))
        held = [np.zeros(0, U)]
        for n, (h, _) in zip(copies, _shingles(t.column("text").take(pa.array(at))), strict=True):
            held += [h] * n
        s = np.sort(np.concatenate(held))
        at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        h, n = s[at], np.diff(np.append(at, len(s)))
        bucket = (h >> U(64 - bits)).astype(np.int64)
        at = np.flatnonzero(np.diff(bucket, prepend=-1))
        runs = [slice(a, b) for a, b in zip(at, np.append(at, len(h))[1:], strict=True)]
        counts = [b"" if n[s].max() == 1 else _pack_counts(n[s]) for s in runs]
        columns = [pa.array(bucket[at]), pa.array([t.column("chunk")[0].as_py()] * len(at), pa.int64()), pa.array([_pack(h[s]) for s in runs], pa.binary()), pa.array(counts, pa.binary())]
        return pa.table(columns, names=["bucket", "chunk", "h", "n"])

    return run


def _bucket_df(t: pa.Table) -> pa.Table:
    """For each chunk, those of its shingles that two or more documents hold, with their number in all documents."""
    runs = [(_unpack(h), _unpack_counts(n) if n else None) for h, n in zip(t.column("h").to_pylist(), t.column("n").to_pylist(), strict=True)]
    s = np.sort(np.concatenate([h for h, _ in runs]))
    known = np.unique(np.concatenate([s[1:][s[1:] == s[:-1]], *(h[n > 1] for h, n in runs if n is not None)]))
    df = np.zeros(len(known), np.int64)
    found = []
    for h, n in runs:
        at = _lookup(known, h)
        held = np.flatnonzero(at >= 0)
        df[at[held]] += 1 if n is None else n[held]  # a run has each shingle once
        found.append((h[held], at[held]))
    rows = [(c, _pack(h), _pack_counts(df[at])) for c, (h, at) in zip(t.column("chunk").to_pylist(), found, strict=True) if len(h)]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["chunk", "h", "df"])


def document_frequencies(base: DataFrame, chars: int) -> DataFrame:
    """(chunk, h, df): packed runs of the shingles of each chunk of ``base`` (chunk, k, text) that are in two or more documents."""
    bits = (max(PARTS, chars // PART_CHARS) - 1).bit_length()
    counts = base.select("chunk", "k", "text").groupBy("chunk").applyInArrow(_chunk_counts(bits), "bucket long, chunk long, h binary, n binary")
    return counts.groupBy("bucket").applyInArrow(_bucket_df, "chunk long, h binary, df binary")


def _known(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles of a chunk that are in two or more documents, and their number of documents."""
    h = np.concatenate([np.zeros(0, U), *(_unpack(x) for x in t.column("h").to_pylist())])
    df = np.concatenate([np.zeros(0, np.uint32), *(_unpack_counts(x) for x in t.column("df").to_pylist())])
    order = np.argsort(h)
    return h[order], df[order]


@lru_cache(maxsize=1)
def _random() -> np.ndarray:
    """r, 1 / r, ln c and beta of the sampling, a line for each slot of the table."""
    rng = np.random.default_rng(SEED)
    size = 1 << _TABLE_BITS
    r, c, beta = rng.gamma(2.0, 1.0, size), rng.gamma(2.0, 1.0, size), rng.uniform(0.0, 1.0, size)
    return np.column_stack([r, 1 / r, np.log(c), beta]).astype(np.float32)


def _sample_key(slot: np.ndarray, log_weight: np.ndarray) -> np.ndarray:
    """ln a of ICWS as sortable bits in the upper half of a word; equal bits stand for the same step t of one slot."""
    x = _random()[slot]
    r, beta = x[:, 0], x[:, 3]
    t = log_weight * x[:, 1]
    t += beta
    np.floor(t, out=t)
    t -= beta
    t += np.float32(1.0)
    t *= r
    value = x[:, 2] - t
    value += np.float32(256.0)
    return value.view(np.uint32).astype(U) << U(32)


@lru_cache(maxsize=1)
def _odd() -> np.ndarray:
    return mix(np.arange(1, BANDS * ROWS + 1, dtype=U)) | U(1)


def tf_idf(tf: np.ndarray | None, df: np.ndarray, n: int) -> np.ndarray:
    w = np.sqrt(1 + np.log10(n / df))
    return w if tf is None else w * tf


def signatures(h: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """BANDS * ROWS samples for each text; ``first``: where its shingles begin in ``h``; ``w``: their weights."""
    out = np.zeros((len(first), BANDS * ROWS), U)
    if not len(first):
        return out
    log_weight = np.log(w).astype(np.float32)
    low = U(0xFFFFFFFF)
    for k, a in enumerate(_odd()):
        p = h * a
        key = _sample_key((p >> U(64 - _TABLE_BITS)).astype(np.int64), log_weight)
        p >>= U(8)
        p &= low
        key |= p
        out[:, k] = np.minimum.reduceat(key, first)
    return out


def bands_of(s: np.ndarray) -> np.ndarray:
    """A key for each band of each line of samples; the band is part of it."""
    band = np.tile(mix(np.arange(BANDS, dtype=U)), (len(s), 1))
    for j in range(ROWS):
        band = mix(band + s[:, j::ROWS])
    return band.view(np.int64)


_SKETCH = "doc_id long, k binary, bands array<long>, samples binary, size int, h binary, tf binary, df binary"


def _sketch(n: int, similarity: float):
    """Every row, with samples and packed shingles for the first of a text in the chunk that may be near another."""
    kinds = {"bands": pa.list_(pa.int64()), "samples": pa.binary(), "size": pa.int32(), "h": pa.binary(), "tf": pa.binary(), "df": pa.binary()}

    def run(t: pa.Table, frequent: pa.Table) -> pa.Table:
        known, known_df = _known(frequent)
        out: dict[str, list] = {c: [None] * t.num_rows for c in kinds}
        block: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            first = np.cumsum([0, *(len(h) for _, h, _ in block)])[:-1]
            s = signatures(np.concatenate([h for _, h, _ in block]), np.concatenate([w for _, _, w in block]), first)
            small = (mix(s) & U(0xFFFFFFFF)).astype(np.uint32)
            for (i, _, _), own, few in zip(block, bands_of(s), small, strict=True):
                out["bands"][i], out["samples"][i] = own, few.tobytes()
            block.clear()

        at, _ = _firsts(t.column("k"))
        for i, (h, tf) in zip(at.tolist(), _shingles(t.column("text").take(pa.array(at))), strict=True):
            if not len(h):
                continue
            found = _lookup(known, h)
            shared = found >= 0
            df = np.ones(len(h), np.uint32)
            df[shared] = known_df[found[shared]]
            w = tf_idf(tf, df, n)
            if w[shared].sum() < (similarity - 1e-9) * w.sum():
                continue
            out["size"][i], out["h"][i], out["tf"][i], out["df"][i] = len(h), _pack(h), b"" if tf is None else _pack_counts(tf), _pack_counts(df)
            block.append((i, h, w))
            if sum(len(h) for _, h, _ in block) >= BLOCK_SHINGLES:
                flush()
        if block:
            flush()
        return pa.table([t.column("doc_id"), t.column("k"), *(pa.array(out[c], kind) for c, kind in kinds.items())], names=["doc_id", "k", *kinds])

    return run


def _vector(h: bytes, tf: bytes, df: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _unpack(h), tf_idf(_unpack_counts(tf) if tf else None, _unpack_counts(df), n)


def weighted_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """Sum of the lesser weights over the sum of the greater; shingles sorted and distinct."""
    at = _lookup(hb, ha)
    both = at >= 0
    least = np.minimum(wa[both], wb[at[both]]).sum()
    total = wa.sum() + wb.sum() - least
    return float(least / total) if total > 0 else 0.0


def _verify(n: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column("a"), b.column("b")
            held: dict[bytes, tuple] = {}  # centres of stars repeat
            good = []
            for i, x in enumerate(a.to_pylist()):
                if x not in held:
                    held = {x: _vector(*(b.column(f"{name}_a")[i].as_py() for name in ("h", "tf", "df")), n)}
                good.append(weighted_jaccard(*held[x], *_vector(*(b.column(f"{name}_b")[i].as_py() for name in ("h", "tf", "df")), n)) >= similarity)
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), c.filter(mask)], names=["a", "b"])

    return run


@lru_cache(maxsize=8)
def least_equal(similarity: float) -> int:
    """Equal samples that a pair needs to be compared: fewer have a chance of MISS at most at ``similarity`` or above."""
    k, chance = BANDS * ROWS, 0.0
    for m in range(k):
        chance += comb(k, m) * similarity**m * (1 - similarity) ** (k - m)
        if chance > MISS:
            return m
    return k


def _samples(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)


def _likely(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = pa.array((_samples(b.column("s_a")) == _samples(b.column("s_b"))).sum(1) >= least) if b.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])

    return run


def _pairs_of_cell(t: pa.Table, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of a cell (side 0 with side 1) that are in different classes and have enough equal samples."""
    s = _samples(t.column("samples"))
    _, cls = np.unique(np.array([x.hex() for x in t.column("class_k").to_pylist()]), return_inverse=True)
    side = t.column("side").to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for block in np.array_split(left, max(1, len(left) // 64)):
        same = np.zeros((len(block), len(right)), np.int32)
        for c in range(BANDS * ROWS):
            same += s[block, c][:, None] == s[right, c][None]
        x, y = np.nonzero((same >= least) & (cls[block][:, None] != cls[right][None]))
        yield block[x], right[y]


def _wanted_of_cell(least: int):
    """Members of a cell that have a pair to compare."""

    def run(t: pa.Table) -> pa.Table:
        at = np.unique(np.concatenate([np.zeros(0, np.int64), *(z for xy in _pairs_of_cell(t, least) for z in xy)]))
        return pa.table([t.column(c).take(pa.array(at)) for c in ("cell", "side", "k")], names=["cell", "side", "k"])

    return run


def _links_of_cell(n: int, similarity: float):
    """Links that join the classes of a cell: pairs of classes that a link already joins aren't compared again."""

    def run(t: pa.Table) -> pa.Table:
        ids, up = t.column("k").to_pylist(), {c: c for c in t.column("class_k").to_pylist()}
        cls = t.column("class_k").to_pylist()
        vec = lru_cache(maxsize=CELL)(lambda i: _vector(*(t.column(c)[i].as_py() for c in ("h", "tf", "df")), n))

        def top(x: bytes) -> bytes:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        links = []
        for xs, ys in _pairs_of_cell(t, least_equal(similarity)):
            for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                a, b = top(cls[x]), top(cls[y])
                if a != b and weighted_jaccard(*vec(x), *vec(y)) >= similarity:
                    up[a] = b
                    links.append((ids[x], ids[y]))
        return pa.table([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], names=["a", "b"])

    return run


def cells(members: DataFrame, scratch: Scratch, cell: int = CELL, shingles: int = CELL_SHINGLES) -> DataFrame:
    """``members`` (c, k, class_k, size, ...) dealt to cells, so that any two of one group ``c`` and different classes meet.

    Members outside the group's largest class are side 0 and meet all its members, which are
    side 1.  A cell takes about ``cell`` members and ``shingles`` shingles from either side.
    """
    per = members.groupBy("c", "class_k").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    whole = per.groupBy("c").agg(F.max(F.struct("n", "class_k", "s")).alias("most"), F.sum("n").alias("n"), F.sum("s").alias("s")).filter("n > most.n")
    parts = lambda n, s: F.greatest(F.ceil(n / cell), F.ceil(s / shingles), F.lit(1)).cast("int")
    plan = scratch.table(whole.select("c", F.col("most.class_k").alias("major"), parts(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s")).alias("few"), parts(F.col("n"), F.col("s")).alias("all")))
    dealt = spread_join(members, plan, "c", by="k")
    part = lambda m: F.pmod(F.xxhash64("k"), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    left = dealt.filter("class_k <> major").select("*", F.lit(0).alias("side"), part("few").alias("i"), every("all").alias("j"))
    right = dealt.select("*", F.lit(1).alias("side"), every("few").alias("i"), part("all").alias("j"))
    return left.unionByName(right).withColumn("cell", F.xxhash64("c", "i", "j")).drop("major", "few", "all", "i", "j", "c")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, class_id) of all nodes of ``edges`` (a, b): the least id that links reach.

    Rounds of hooking to the least neighbour, pointer jumping and contraction;
    the edges between different classes shrink at least by half of their nodes
    a round.  All steps are joins and aggregations over written tables; hubs are spread.
    """
    both = lambda e: e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = scratch.table(both(edges.filter("a <> b")).distinct())
    found = None
    while not e.isEmpty():
        hook = scratch.table(e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")))
        while True:
            jump = hook.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = scratch.table(spread_join(hook, jump, "p", by="a").select("a", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            hook = jumped.select("a", "p")
            if jumped.filter("moved").isEmpty():
                break
        to = lambda c: hook.select(F.col("a").alias(c), F.col("p").alias(f"{c}_p"))
        half = scratch.table(spread_join(e, to("a"), "a", by="b"))
        e = scratch.table(spread_join(half, to("b"), "b", by="a").select(F.col("a_p").alias("a"), F.col("b_p").alias("b")).filter("a <> b").distinct())
        if found is None:
            found = hook.select(F.col("a").alias("id"), F.col("p").alias("class_id"))
        else:
            found = scratch.table(spread_join(found, hook.select(F.col("a").alias("class_id"), "p"), "class_id", how="left", by="id").select("id", F.coalesce("p", "class_id").alias("class_id")))
    return found if found is not None else e.select(F.col("a").alias("id"), F.col("b").alias("class_id"))


def _links(heads: DataFrame, n: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(id, class_id) over texts: the classes that verified pairs of texts of one bucket join."""
    samples, vector = heads.select("k", "samples", "size"), heads.select("k", "h", "tf", "df")
    member = scratch.table(heads.select("k", F.explode("bands").alias("key")))
    bucket = scratch.table(member.groupBy("key").agg(F.min("k").alias("c"), F.max("k").alias("most")).filter("c < most").drop("most"))
    pairs = spread_join(member, bucket, "key", by="k").select("c", "k").distinct()
    groups = scratch.table(pairs.join(samples, "k"))

    def verified(star: DataFrame) -> DataFrame:
        """Links of the pairs (a, b, s_a, s_b) that are near."""
        likely = scratch.table(map_arrow(star.select("a", "b", "s_a", "s_b"), _likely(least_equal(similarity)), "a binary, b binary").distinct())
        side = lambda x: vector.select(F.col("k").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("h", "tf", "df")))
        rows = spread_join(likely, side("a"), "a", by="b").join(side("b"), "b")
        rows = rows.select("a", "b", *(f"{c}_{x}" for x in "ab" for c in ("h", "tf", "df")))
        return scratch.table(map_arrow(rows, _verify(n, similarity), "a binary, b binary"))

    def placed(classes: DataFrame) -> DataFrame:
        """Members with their class, of the groups that hold several."""
        named = classes.select(F.col("id").alias("k"), F.col("class_id").alias("class_k"))
        rows = scratch.table(groups.join(named, "k", "left").withColumn("class_k", F.coalesce("class_k", "k")))
        mixed = rows.groupBy("c").agg(F.min("class_k").alias("lo"), F.max("class_k").alias("hi")).filter("lo < hi").select("c")
        return scratch.table(spread_join(rows, mixed, "c", by="k"))

    centre = lambda rows, *more: rows.select("c", F.col("k").alias("a"), F.col("samples").alias("s_a"), *more)
    star = spread_join(scratch.table(groups.filter("k > c")), centre(groups.filter("k = c")), "c", by="k")
    links = verified(star.withColumnsRenamed({"k": "b", "samples": "s_b"}))
    classes = components(links, scratch)
    rest = placed(classes)
    for turn in range(ROUNDS):
        if rest.isEmpty():
            return classes
        other = rest.groupBy("c").agg(F.min(F.struct(F.xxhash64("class_k", F.lit(turn)).alias("by"), "class_k", "k", "samples")).alias("x"))
        picked = scratch.table(other.select("c", F.col("x.k").alias("a"), F.col("x.samples").alias("s_a"), F.col("x.class_k").alias("own")))
        star = spread_join(rest, picked, "c", by="k").filter("class_k <> own")
        links = links.unionAll(verified(star.withColumnsRenamed({"k": "b", "samples": "s_b"})))
        classes = components(links, scratch)
        rest = placed(classes)
    if rest.isEmpty():
        return classes
    dealt = cells(rest, scratch)
    wanted = scratch.table(dealt.groupBy("cell").applyInArrow(_wanted_of_cell(least_equal(similarity)), "cell long, side int, k binary").distinct())
    if wanted.isEmpty():
        return classes
    named = classes.select(F.col("id").alias("k"), F.col("class_id").alias("class_k"))
    held = spread_join(wanted, vector.join(samples.drop("size"), "k").join(named, "k", "left").withColumn("class_k", F.coalesce("class_k", "k")), "k", by="cell")
    more = scratch.table(held.groupBy("cell").applyInArrow(_links_of_cell(n, similarity), "a binary, b binary"))
    return components(links.unionAll(more), scratch)


def classes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, k, text_id, class_id, class_k.

    ``k`` is the MD5 of the text; ``class_id`` is the least id of the class and ``class_k`` the text it has
    (the least ``k`` of several).  See ``near_duplicates``.
    """
    spark = docs.sparkSession
    tune(spark)
    ship(spark)
    base = docs.select(F.col(q(id_col)).cast("long").alias("doc_id"), F.coalesce(F.col(q(text_col)).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("k", F.unhex(F.md5(F.col("text").cast("binary"))))
    n, chars = base.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    base = base.withColumn("chunk", F.pmod(F.xxhash64("k", "doc_id"), F.lit(max(PARTS, chars // PART_CHARS))))
    with Scratch(spark) as scratch:
        frequent = scratch.table(document_frequencies(base, chars))
        cogrouped = base.groupBy("chunk").cogroup(frequent.groupBy("chunk"))
        sketch = scratch.table(cogrouped.applyInArrow(_sketch(n, similarity), _SKETCH))
        rows = sketch.select("doc_id", "k")
        first = rows.groupBy("k").agg(F.min("doc_id").alias("text_id"))
        heads = scratch.table(sketch.filter("bands IS NOT NULL").drop("doc_id").dropDuplicates(["k"]))
        named = _links(heads, n, similarity, scratch).select(F.col("id").alias("k"), F.col("class_id").alias("class"))
        texts = scratch.table(first.join(named, "k", "left").withColumn("class", F.coalesce("class", "k")))
        kept = texts.groupBy("class").agg(F.min(F.struct(F.col("text_id").isNull().alias("none"), "text_id", "k")).alias("x"))
        kept = scratch.table(kept.select("class", F.col("x.text_id").alias("class_id"), F.col("x.k").alias("class_k")))
        texts = scratch.table(spread_join(texts, kept, "class", by="k").drop("class"))
        return shared_table(spread_join(rows, texts, "k", by="doc_id").select("doc_id", "k", "text_id", "class_id", "class_k"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_id, class_id.

    ``text_id`` is the least id with the same text and ``class_id`` the least
    id of the class: texts joined by chains of pairs whose weighted Jaccard
    similarity is ``similarity`` or more.  Null and wordless texts are equal
    to nothing but themselves (null to null and empty); texts of one to four words
    have one shingle.  Rows that repeat an id and text give equal rows; an id
    with two texts has a row for each, and each is in its own text's class; a null id counts
    as the greatest.  An empty table gives an empty table; other columns are ignored.
    """
    return classes_of(docs, id_col, text_col, similarity).select("doc_id", "text_id", "class_id")


def first_of_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the document of least id, with all columns.

    A document is an id with a text: rows that repeat both stay together, and
    another text of the same id is a document of its own.
    """
    key, other = own_name(docs, "text_md5"), own_name(docs, "text_md5_gone")
    gone = classes_of(docs, id_col, text_col, similarity).filter(~(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("k") == F.col("class_k"))))
    gone = gone.select(F.col("doc_id").alias(own_name(docs, "id_gone")), F.col("k").alias(other)).distinct()
    named = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col(q(text_col)).cast("string"), F.lit("")).cast("binary"))))
    same = (F.col(key) == F.col(other)) & F.col(q(id_col)).cast("long").eqNullSafe(F.col(own_name(docs, "id_gone")))
    return named.join(gone, same, "left_anti").drop(key)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text_id, class_id of every document; nulls, empty texts, repeated rows and an empty table as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


#: All pairs that share a shingle, by definition; classes by reachability.
SQL_OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS (SELECT t, min(doc_id) AS text_id, count(*) AS n FROM d GROUP BY t),
w AS (SELECT text_id, n, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM x),
s AS (SELECT text_id, k, count(*) AS tf, any_value(n) AS n FROM (SELECT text_id, n, array_to_string(ws[i:i + least(len(ws), {SHINGLE}) - 1], ' ') AS k FROM (SELECT text_id, n, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0)) GROUP BY text_id, k),
f AS (SELECT k, sum(n) AS df FROM s GROUP BY k),
v AS (SELECT text_id, s.k, tf * sqrt(1 + log10((SELECT count(*) FROM d)::DOUBLE / df)) AS w, df FROM s JOIN f ON s.k = f.k),
o AS (SELECT text_id, sum(w) AS w FROM v GROUP BY text_id),
p AS (SELECT a.text_id AS a, b.text_id AS b, sum(least(a.w, b.w)) AS least_w FROM v a JOIN v b ON a.k = b.k AND a.text_id < b.text_id WHERE a.df > 1 GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN o oa ON a = oa.text_id JOIN o ob ON b = ob.text_id WHERE least_w >= {SIMILARITY} * (oa.w + ob.w - least_w)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT text_id AS id, text_id AS root FROM x UNION SELECT r.id, u.b FROM r JOIN u ON r.root = u.a),
c AS (SELECT id, min(root) AS class_id FROM r GROUP BY id)
SELECT doc_id, text_id, class_id FROM d JOIN x ON d.t = x.t JOIN c ON x.text_id = c.id
"""
