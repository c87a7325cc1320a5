"""Operator 1: secret scans.

Patterns find assignments, access keys and long hexadecimal runs.  Values in
credential contexts that the patterns leave out are weighed by the number of
guesses an informed attacker needs: dynamic programming segments the value
into dictionary words, dates, repeats, keyboard walks and brute-force spans
at least total cost, and values of high cost are spans of kind ``guess``.

The dictionary ranks words by how often they occur: in the corpus itself (a
word count over all texts, without the values that stand in credential
contexts), and in a public tokenizer's vocabulary, whose pieces come in order of
their frequency in general text.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import sentencepiece_codec
from quarryline.llm.common import Scratch, add_column, map_arrow, q, table

KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which a value counts as a secret; more for values of one kind of character, which may be words or numbers.
MIN_LOG_GUESSES, MIN_LOG_GUESSES_ONE_KIND = 8.0, 14.0
MIN_VALUE = 6
#: Words of the corpus that the dictionary takes, the most frequent first: bounds what is broadcast.
DICTIONARY_WORDS = 50_000
#: Words that a task counts before it passes the counts on.
COUNTED_WORDS = 200_000
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Wider contexts: more names, more separators, any visible characters in the value.
CONTEXT = re.compile(r"""(?<![A-Za-z0-9])(?:[A-Za-z]+[_-])?(?:passwords?|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)["']?\x20{0,4}(?::=|=>|[:=]|\x20is\x20)\x20{0,4}(?:"([^"\s]+)"|'([^'\s]+)'|([^\s"',;]+))""", re.IGNORECASE | re.ASCII)
_HINTS = ("pass", "pwd", "secret", "token", "api", "key", "credential", "auth")
_ACCESS_HINT, _BASE_HINTS = "AKIA", ("passw", "secret", "token", "api")
_HEX_TABLE = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))
_HEX_RUN = b"\x01" * 16
#: Common words of passwords, the most common first.
WORDS = """password qwerty admin welcome login letmein monkey dragon master hello freedom whatever shadow sunshine princess football baseball
superman batman trustno secret token pass user test guest root default change changeme example sample love iloveyou jesus money
summer winter spring autumn monday friday january march april june july august october november december michael jordan daniel
ashley charlie thomas robert jennifer hunter ranger buster soccer hockey killer george andrew pepper ginger cookie cheese
computer internet server service system database mysql oracle postgres access account private public key apikey company
office home house family flower purple orange yellow green black white silver golden diamond tiger eagle star the and for you""".split()
#: Rows of a keyboard.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("01345$@7!", "oleassati")
DATES = (
    (4.6, re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])")),
    (4.6, re.compile(r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")),
    (4.6, re.compile(r"(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?\d\d")),
    (2.0, re.compile(r"(?:19|20)\d\d")),
)
WORD = re.compile(r"[^\W\d_]{3,24}")
LONGEST_WORD = 24
#: Longest block that counts as repeated, and starts of sub-runs of a run that are tried.
LONGEST_BLOCK, SUB_STARTS = 24, 16


#: Factor of each segment but the first.
_JOIN = math.log10(2)


def _neighbours() -> frozenset[tuple[str, str]]:
    """Ordered pairs of keys that lie beside each other, within a row or across two."""
    at = {c: (r, i + 0.5 * r) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
    return frozenset((a, b) for a, (r, x) in at.items() for b, (s, y) in at.items() if a != b and abs(r - s) <= 1 and abs(x - y) <= 1.01)


_NEXT = _neighbours()
#: How a run goes on, and how much it adds to the guesses: one character, consecutive ones, neighbours on a keyboard.
_LINKS = ((lambda x, y: x == y, 1.0), (lambda x, y: ord(y) - ord(x) == 1, 1.5), (lambda x, y: ord(x) - ord(y) == 1, 1.5), (lambda x, y: (x, y) in _NEXT, 2.0))


def ranks(*sources: list[str]) -> dict[str, int]:
    """Rank of each word (from 1): its best in any of the lists, which come in order of frequency."""
    out: dict[str, int] = {}
    for words in (WORDS, *sources):
        for i, w in enumerate(words, 1):
            if out.get(w, i) >= i:
                out[w] = i
    return out


@lru_cache(maxsize=2)
def vocabulary_words(model: str) -> list[str]:
    """Words that are whole pieces of a tokenizer's vocabulary, in its order."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return list(dict.fromkeys(p[1:].lower() for p in pieces if p.startswith(sentencepiece_codec.SPACE) and WORD.fullmatch(p[1:])))


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


def _runs(v: str, linked) -> list[tuple[int, int]]:
    """Maximal runs of three or more characters of which each is linked to the next."""
    out, start = [], 0
    for i in range(1, len(v) + 1):
        if i == len(v) or not linked(v[i - 1], v[i]):
            if i - start >= 3:
                out.append((start, i))
            start = i
    return out


def _blocks(v: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, unit) of the maximal stretches that repeat a block of ``unit`` characters at least twice."""
    for u in range(2, min(LONGEST_BLOCK, len(v) // 2) + 1):
        start = None
        for i in range(u, len(v) + 1):
            if i < len(v) and v[i] == v[i - u]:
                start = i - u if start is None else start
            elif start is not None:
                if i - start >= 2 * u:
                    yield start, i, u
                start = None


def log_guesses(value: str, known: dict[str, int] | None = None) -> float:
    """log10 of the guesses of the cheapest segmentation; 0 for an empty value.

    Edges are words (with capitals and look-alike digits), dates, runs of one
    character or of consecutive ones, keyboard walks, repeated blocks (the guesses of
    the block times the number of repeats), each anywhere, and single
    brute-force characters.  Parts of runs are edges too; of a long run those that start in its
    first ``SUB_STARTS`` places.  A further factor of two for each segment but the first
    stands for the order that a guesser has to find out.  Linear in the
    length but for runs, where each end has ``SUB_STARTS`` edges.
    """
    known = _FIXED if known is None else known
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    plain = low.translate(LEET)
    into: dict[int, list[tuple[int, float]]] = {}

    def edge(a: int, b: int, cost: float) -> None:
        into.setdefault(b, []).append((a, cost + (_JOIN if a else 0.0)))

    for a in range(n):
        for b in range(a + 3, min(n, a + LONGEST_WORD) + 1):
            rank = min(known.get(low[a:b], math.inf), known.get(plain[a:b], math.inf))
            if rank < math.inf:
                turned = sum(x != y for x, y in zip(value[a:b], plain[a:b], strict=True))
                edge(a, b, math.log10(rank + 1) + math.log10(2) * min(turned, 8))
        for cost, pattern in DATES if low[a].isdigit() else ():
            m = pattern.match(value, a)
            if m:
                edge(a, m.end(), cost)
    stretches = [(start, end, 0, math.log10(_alphabet(low[start])) + base * 0.3, 0.3 if base == 2.0 else 0.0) for linked, base in _LINKS for start, end in _runs(low, linked)]
    stretches += [(start, end, u, 0.0, 0.0) for start, end, u in _blocks(low)]
    stretches.sort()
    units: dict[str, float] = {}
    letters = 52 if low != value and value != value.upper() else 26
    best = [0.0] * (n + 1)
    open_, coming = [], 0
    for b in range(1, n + 1):
        while coming < len(stretches) and stretches[coming][0] < b:
            open_.append(stretches[coming])
            coming += 1
        if open_:
            open_ = [x for x in open_ if x[1] >= b]
        size = _alphabet(value[b - 1])
        cost = best[b - 1] + math.log10(letters if size == 26 else size)
        for a, c in into.get(b, ()):
            cost = min(cost, best[a] + c)
        for start, _, u, fixed, each in open_:
            if not u:
                for a in range(start, min(start + SUB_STARTS, b - 2)):
                    cost = min(cost, best[a] + fixed + math.log10(b - a) + each * (b - a) + (_JOIN if a else 0.0))
                continue
            a = start + (b - start) % u
            if b - a >= 2 * u:
                unit = value[a : a + u]
                if unit not in units:
                    units[unit] = log_guesses(unit, known)
                cost = min(cost, best[a] + units[unit] + math.log10((b - a) // u) + (_JOIN if a else 0.0))
        best[b] = cost
    return best[n]


_FIXED = ranks()


def enough(value: str, least: float = MIN_LOG_GUESSES) -> float:
    """The cost from which a value is a secret: more if it is all digits, or letters that are no mix of cases.

    So that a word of a language that the dictionary lacks, or a telephone number, is none.
    """
    inner = value[1:]
    one = value.isdigit() or value.isalpha() and (inner == inner.lower() or value == value.upper())
    return least + (MIN_LOG_GUESSES_ONE_KIND - MIN_LOG_GUESSES if one else 0.0)


def base_spans(text: str, known: dict[str, int] | None = None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, cost) of the patterns; the span is the whole match."""
    low, out = text.lower(), []
    if any(h in low for h in _BASE_HINTS):
        out += [(m.start(), m.end(), "assign", log_guesses(m[2], known)) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if _ACCESS_HINT in text:
        out += [(m.start(), m.end(), "access", log_guesses(m[0][4:], known)) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    if _HEX_RUN in text.encode().translate(_HEX_TABLE):
        out += [(m.start(), m.end(), "hex", log_guesses(m[0], known)) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _values(text: str) -> Iterator[tuple[int, int]]:
    """Where the values of credential contexts stand."""
    low = text.lower()
    if any(h in low for h in _HINTS):
        for m in CONTEXT.finditer(text):
            yield next(m.span(i) for i in (1, 2, 3) if m[i] is not None)


def guess_spans(text: str, base: list[tuple[int, int, str, float]], least: float = MIN_LOG_GUESSES, known: dict[str, int] | None = None) -> list[tuple[int, int, str, float]]:
    """Values in credential contexts, clear of the base spans, that cost ``least`` or more (see ``enough``)."""
    out = []
    starts, reach = [s[0] for s in base], list(itertools.accumulate((s[1] for s in base), max))
    for a, b in _values(text):
        before = bisect.bisect_left(starts, b)  # base spans that start before the value ends
        if b - a < MIN_VALUE or before and reach[before - 1] > a:
            continue
        cost = log_guesses(text[a:b], known)
        if cost >= enough(text[a:b], least):
            out.append((a, b, "guess", cost))
    return out


def scan(text: str | None, least: float = MIN_LOG_GUESSES, known: dict[str, int] | None = None) -> list[tuple[int, int, str, float]]:
    """All spans of a text by start, then kind; offsets are code points, ends exclusive."""
    if not text:
        return []
    base = base_spans(text, known)
    return sorted(base + guess_spans(text, base, least, known), key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """``text`` with ``[kind]`` for each span; of overlapping ones the first wins and hides them all."""
    parts, at = [], 0
    for start, end, kind, _ in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and how often they occur, values of credential contexts left out."""
    names = ["word", "n"]
    count: Counter[str] = Counter()
    for b in batches:
        for t in b.column("text").to_pylist():
            if not t:
                continue
            keep, at = [], 0
            for x, y in _values(t):
                if x >= at:
                    keep.append(t[at:x])
                at = max(at, y)
            count.update(WORD.findall(" ".join([*keep, t[at:]]).lower()))
            if len(count) > COUNTED_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=names)
                count.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=names)


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY_WORDS) -> list[str]:
    """The words of three letters and more that occur twice or more in the texts, the most frequent first (then by name).

    All texts are counted; the dictionary is bounded: of words that occur equally often all come or
    none, so that there are ``most`` at most.  What the driver gathers besides is a histogram of their numbers.
    """
    with Scratch(docs.sparkSession) as scratch:
        counted = map_arrow(docs.select(F.col(q(text_col)).cast("string").alias("text")), _counts, "word string, n long")
        counted = scratch.table(counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1").withColumn("size", F.floor(8 * F.log2("n")).cast("int")))
        least, held = 2, 0
        for size, n in sorted(map(tuple, counted.groupBy("size").count().collect()), reverse=True):  # 500 rows at most
            if held + n <= most:
                held += n
                continue
            least = 1 << 62
            for exact, m in sorted(map(tuple, counted.filter(F.col("size") == size).groupBy("n").count().collect()), reverse=True):  # a twelfth of the greatest of them at most
                if held + m > most:
                    break
                held, least = held + m, exact
            if least == 1 << 62:
                least = int(counted.filter(F.col("size") > size).agg(F.coalesce(F.min("n"), F.lit(1 << 62))).first()[0])
            break
        return [w for _, w in sorted((-r["n"], r["word"]) for r in counted.filter(F.col("n") >= least).select("word", "n").toLocalIterator())]


def dictionary(docs: DataFrame, text_col: str = "text", model: str = sentencepiece_codec.MODEL) -> dict[str, int]:
    """Ranks of words: common passwords, whole words of the tokenizer's vocabulary, frequent words of the corpus."""
    return ranks(vocabulary_words(model), corpus_words(docs, text_col))


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("log_guesses", pa.float64())]))


def secret_spans(docs: DataFrame, text_col: str = "text", spans_col: str = "spans", least: float = MIN_LOG_GUESSES, known: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with ``spans_col``: array<struct<start, end, kind, log_guesses>>.

    Null and empty texts have none.  Texts are scanned whole, rows one by one,
    so ties and repeated rows need no rule; an empty table gives an empty one.  A column of the name
    ``spans_col`` is replaced; other columns stay as they are, whatever their names.  ``known``: a
    dictionary (see ``dictionary``), learned from ``docs`` if there is none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs, text_col) if known is None else known)  # bounded by DICTIONARY_WORDS and the vocabulary

    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "end": b, "kind": k, "log_guesses": c} for a, b, k, c in scan(t, least, shared.value)] for t in texts.to_pylist()], _SPAN)

    return add_column(docs, spans_col, "array<struct<start:int,end:int,kind:string,log_guesses:double>>", text_col, spans)


def redacted(docs: DataFrame, text_col: str = "text", least: float = MIN_LOG_GUESSES, known: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with ``[kind]`` in place of every secret in ``text_col``; null stays null, columns keep their order and names."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs, text_col) if known is None else known)

    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([t and redact(t, scan(t, least, shared.value)) for t in texts.to_pylist()], pa.string())

    return add_column(docs, text_col, "string", text_col, clean).select(*(F.col(q(c)) for c in docs.columns))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row; a null or empty text has no spans, repeated rows give equal rows."""
    found = secret_spans(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "spans")
    show = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(show(base).cast("binary"), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"))
