"""Operator 8: main text of HTML pages.

A page is a sequence of words and tags.  Every token has a weight: the log
odds of standing inside the main text, counted over labelled pages, so words
of running text score above zero and most tags below.  One linear scan finds
the contiguous run of tokens with the largest sum; the words in it that score above zero are
the result.

A word's weight is that of the element it stands in.  Class names and ids are tokens
too: words under a name that labelled pages hardly ever have in their main text score
below zero, as do words in elements that the page itself calls menus, adverts, notices,
comments and the like, by tag or by name.  Such a name never counts for an element that holds
most of the page's words, since then it describes the layout.

Labelled pages are those whose markup says where the main text is (one
``main``, or else one ``article``); a bounded sample of them is counted.  On such a page words
outside that element score below zero, unless it holds little of the text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import Scratch, add_column, map_arrow, q, table

#: Bound of the pages that are counted; the pages of least hash are taken.
MAX_LABELLED_PAGES = 4_000
#: Pages that must have a class name before it has a weight, and the weight from which on its words aren't text.
MIN_PAGES, OUTSIDE = 3, -1.5
#: Share of a page's words that its one main element needs to be believed.
BELIEVED = 1 / 3
#: Words that an element needs to be the frame of a page, whatever it is called.
FRAME_WORDS = 50
#: Elements whose content is never text of the page.
RAW = "script|style|noscript|template|svg|textarea|iframe|object|canvas|title|select|math|xmp|noembed|noframes"
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({RAW})\b(?:[^>"']|"[^"]*"|'[^']*'){{0,1000}}+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'){0,1000}+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.DOTALL | re.IGNORECASE,
)
#: Elements and roles that hold no main text; a form or header may be the frame of a whole page.
BOILER = frozenset("nav footer aside menu button dialog label fieldset input option".split())
FRAMES = frozenset(("form", "header"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Words that end a class name or id of menus, adverts, notices and comments ...
KINDS = frozenset(
    """ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb
    breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice popup modal newsletter subscribe signup login share sharing social
    related recommended recommendations comment comments commentlist disqus respond reply replies widget toolbar pagination pager search""".split()
)
#: ... or begin one that ends in a word for a box, ...
BOXES = frozenset("box block wrapper wrap container area section list bar banner unit slot links link widget form buttons panel item items thread body text overlay dialog strip".split())
#: ... and those that turn the meaning round, or stand for a part of the main text.
NEGATIONS = frozenset("no not non without has have with is hide".split())
CONTENT = frozenset("article entry post story".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open paragraph, and those that a paragraph outside stays open in.
_ENDS_P = frozenset("p li h1 h2 h3 h4 h5 h6 article section div nav footer header ul ol table".split())
_SCOPE = frozenset("table object article div section".split())
ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_DIGITS = re.compile(r"\d+")
#: Weights while no labelled page is known: words for, tags against.
DEFAULT = {"word": 1.0, "boiler": -1.0}
DEFAULT_TAG = -0.3


def names_boilerplate(name: str) -> bool:
    """Whether a class name or id says that an element is no main text."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[0] in NEGATIONS:
        return False
    if words[-1] in KINDS:
        return not (words[-1] in ("header", "banner") and set(words[:-1]) & CONTENT)
    return words[0] in KINDS and words[0] != "header" and words[-1] in BOXES


@dataclass
class Element:
    """What a page says of an element: the one around it, its class names and ids, whether it is boilerplate for sure or by its name."""

    parent: int
    name: str
    names: list[str] = field(default_factory=list)
    firm: bool = False
    soft: bool = False


def _element(parent: int, name: str, attrs: str) -> Element | None:
    """The element, if anything of it matters beyond its tag."""
    e = Element(parent, name, firm=name in BOILER, soft=name in FRAMES)
    if attrs and name not in ("body", "html"):
        for m in ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                own = value.split()
                e.names += [_DIGITS.sub("", x).lower() for x in own]
                e.soft |= name not in ("article", "main") and any(map(names_boilerplate, own))
            else:
                e.firm |= key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and bool(re.search(r"display\s*:\s*none", value)) or key == "role" and value.lower() in ROLES
    return e if e.firm or e.soft or e.names or name in ("article", "main") else None


def parse(page: str) -> tuple[list[tuple[str, str, int]], list[Element]]:
    """(kind, text, element) of each token: kind ``word`` for text, ``br`` and tags by name, ``/name`` for ends; and the elements.

    A token's element is the innermost of those kept, or -1.  An end tag closes the innermost open element of
    its name; strays are tokens only.  Linear in the page, however deep it nests.
    """
    out: list[tuple[str, str, int]] = []
    elements: list[Element] = []
    stack: list[tuple[str, int]] = []
    open_names: Counter = Counter()
    paragraphs: list[int] = []
    scopes: list[int] = []

    def close(k: int) -> None:
        while len(stack) > k:
            open_names[stack.pop()[0]] -= 1
        for places in (paragraphs, scopes):
            while places and places[-1] >= k:
                places.pop()

    at = 0
    for m in TOKEN.finditer(page):
        own = stack[-1][1] if stack else -1
        if m.start() > at:
            out.append(("word", page[at : m.start()], own))
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        name, end, attrs = name.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        if end:
            out.append(("/" + name, "", own))
            if open_names[name] > 0:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
            continue
        if name in _ENDS_P and paragraphs and paragraphs[-1] > (scopes[-1] if scopes else -1):
            close(paragraphs[-1])  # a block ends an open paragraph and the formatting left open in it
            own = stack[-1][1] if stack else -1
        if name not in VOID and not attrs.rstrip().endswith("/"):
            e = _element(own, name, attrs)
            if e:
                own = len(elements)
                elements.append(e)
            if name == "p":
                paragraphs.append(len(stack))
            elif name in _SCOPE:
                scopes.append(len(stack))
            stack.append((name, own))
            open_names[name] += 1
        out.append((name, "", own))
    if at < len(page):
        out.append(("word", page[at:], stack[-1][1] if stack else -1))
    return out, elements


def _below(elements: list[Element], own: np.ndarray) -> np.ndarray:
    """Sum of ``own`` over each element and what stands in it."""
    total = own.copy()
    for i in range(len(elements) - 1, -1, -1):
        if elements[i].parent >= 0:
            total[elements[i].parent] += total[i]
    return total


def _within(elements: list[Element], which: set[int]) -> np.ndarray:
    """Whether each element is one of ``which`` or stands in one."""
    out = np.zeros(len(elements) + 1, bool)  # the last is for no element
    for i, e in enumerate(elements):
        out[i] = i in which or e.parent >= 0 and out[e.parent]
    return out


def _label(elements: list[Element]) -> int:
    """The one ``main``, or the one ``article`` of a page without any; -1 for none."""
    for name in ("main", "article"):
        found = [i for i, e in enumerate(elements) if e.name == name]
        if found:
            return found[0] if len(found) == 1 else -1
    return -1


def _words(seq: list[tuple[str, str, int]]) -> np.ndarray:
    return np.array([len(t.split()) if k == "word" else 0 for k, t, _ in seq], np.int64)


def boilerplate(elements: list[Element], words: np.ndarray, weights: dict[str, float]) -> np.ndarray:
    """Whether the words of each element are no text; ``words``: those directly in each.

    An element that is only called so, by its class names, and holds more than half of the words
    that aren't in sure boilerplate, is text (but not beside the page's one main element).
    """
    label = _label(elements)
    beside = ~_within(elements, {label}) if label >= 0 else np.zeros(len(elements) + 1, bool)
    while label >= 0:
        beside[label] = False
        label = elements[label].parent
    firm = _within(elements, {i for i, e in enumerate(elements) if e.firm})
    outside = np.where(firm[:-1], 0, words[:-1])
    total = int(outside.sum() + words[-1])
    below = _below(elements, outside)
    frame = (below >= FRAME_WORDS) & (2 * below > total) & ~beside[:-1]
    soft = {i for i, e in enumerate(elements) if (e.soft or any(weights.get("." + n, 0.0) <= OUTSIDE for n in e.names)) and not frame[i]}
    return firm | _within(elements, soft)


def _direct(seq: list[tuple[str, str, int]], n: np.ndarray, elements: list[Element]) -> np.ndarray:
    own = np.zeros(len(elements) + 1, np.int64)
    np.add.at(own, np.array([e for _, _, e in seq], np.int64), n)
    return own


def labelled_counts(page: str) -> Counter:
    """(token, inside) counts of a page that marks its main text; empty for others.  Names count the words below them, behind a dot."""
    seq, elements = parse(page)
    label = _label(elements)
    c: Counter = Counter()
    if label < 0:
        return c
    n = _words(seq)
    direct = _direct(seq, n, elements)
    bad = boilerplate(elements, direct, {})
    inside = _within(elements, {label})
    for (kind, _, e), k in zip(seq, n.tolist(), strict=True):
        c["boiler" if bad[e] and kind == "word" else "!" + kind if bad[e] else kind, bool(inside[e] and not bad[e])] += k if kind == "word" else 1
    within, whole = (_below(elements, np.where(x, direct, 0)[:-1]) for x in (inside & ~bad, np.ones(len(bad), bool)))
    for i, e in enumerate(elements):
        for name in set(e.names):
            c["." + name, True] += int(within[i])
            c["." + name, False] += int(whole[i] - within[i])
    return c


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds of each token, at most 6 either way; words stay above zero, tags and boilerplate below."""
    if not counts:
        return dict(DEFAULT)
    tags = {k: n for k, n in counts.items() if not k[0].startswith(".")}
    inside = sum(n for (_, y), n in tags.items() if y) + 1
    outside = sum(n for (_, y), n in tags.items() if not y) + 1
    out = {}
    for k in {k for k, _ in counts}:
        v = np.log((counts.get((k, True), 0) + 0.5) / inside) - np.log((counts.get((k, False), 0) + 0.5) / outside)
        out[k] = float(np.clip(v, -6, 6 if k == "word" or k.startswith(".") else -0.1))
    out["word"], out["boiler"] = max(out.get("word", 1.0), 0.5), min(out.get("boiler", -1.0), -1.0)
    return out


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """The contiguous run of largest sum, as (start, end); of several the first, and of those the longest start."""
    if not len(scores) or scores.max() <= 0:
        return 0, 0
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    least = np.minimum.accumulate(sums)
    gain = sums[1:] - least[:-1]
    end = int(np.argmax(gain)) + 1
    return int(np.flatnonzero(sums[:end] == least[end - 1])[0]), end


def extract(page: str | None, weights: dict[str, float]) -> str:
    """Main text of a page; empty if it has none."""
    if not page:
        return ""
    seq, elements = parse(page)
    n = _words(seq)
    direct = _direct(seq, n, elements)
    bad = boilerplate(elements, direct, weights)
    label = _label(elements)
    if label >= 0:
        inside = _within(elements, {label})
        good = np.where(bad, 0, direct)
        if good[inside].sum() >= BELIEVED * good.sum() and good[inside].sum():
            bad |= ~inside
    word, boiler = weights["word"], weights["boiler"]
    # Words under a name that labelled pages have inside their main text weigh more.
    each = np.full(len(elements) + 1, word)
    for i, e in enumerate(elements):
        each[i] = max([each[e.parent], *(weights.get("." + x, 0.0) for x in e.names)])
    each[bad] = boiler
    scores = np.array([each[e] * k if kind == "word" else weights.get("!" + kind if bad[e] else kind, DEFAULT_TAG) for (kind, _, e), k in zip(seq, n.tolist(), strict=True)])
    a, b = best_region(scores)
    # A region starts and ends with whole blocks.
    while 0 < a < len(seq) and (seq[a - 1][0] == "word" or seq[a - 1][0].lstrip("/") in INLINE) and not bad[seq[a - 1][2]]:
        a -= 1
    while b < len(seq) and (seq[b][0] == "word" or seq[b][0].lstrip("/") in INLINE) and not bad[seq[b][2]]:
        b += 1
    blocks, held = [], []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            blocks.append(text)
        held.clear()

    for kind, text, e in seq[a:b]:
        if kind == "word":
            if not bad[e]:
                held.append(text)
        elif kind == "br":
            held.append(" ")
        elif kind.lstrip("/") not in INLINE:
            flush()
    flush()
    return "\n".join(blocks)


def learn(pages: DataFrame, html_col: str = "html", max_pages: int = MAX_LABELLED_PAGES) -> dict[str, float]:
    """Weights from about ``max_pages`` pages at most, those whose other columns have the least hash; defaults if none is labelled."""
    n = pages.count()
    cut = int(1_000_003 * min(1.0, max_pages / max(n, 1)))
    keys = [F.col(q(c)) for c in pages.columns if c != html_col] or [F.col(q(html_col))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        on: Counter = Counter()
        for b in batches:
            for page in b.column("html").to_pylist():
                own = labelled_counts(page or "")
                c.update(own)
                on.update({k for k, _ in own})
        rows = list(c.items())
        yield pa.RecordBatch.from_arrays([pa.array([k for (k, _), _ in rows], pa.string()), pa.array([y for (_, y), _ in rows], pa.bool_()), pa.array([v for _, v in rows], pa.int64()), pa.array([on[k] for (k, _), _ in rows], pa.int64())], names=["token", "inside", "n", "pages"])

    some = pages.filter(F.pmod(F.xxhash64(*keys), F.lit(1_000_003)) < cut).select(F.col(q(html_col)).cast("string").alias("html"))
    counted = map_arrow(some, run, "token string, inside boolean, n long, pages long").groupBy("token", "inside").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"))
    with Scratch(pages.sparkSession) as scratch:
        held = scratch.table(counted.filter((F.col("pages") >= MIN_PAGES) | ~F.col("token").startswith(".")).select("token", "inside", "n"))
        return weights_of({(r["token"], r["inside"]): r["n"] for r in held.toLocalIterator()})


def main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """``pages`` with the main text in ``text_col``, the last column.

    Null, empty and textless pages give an empty text.  Without labelled
    pages default weights hold.  A column named ``text_col`` is replaced,
    others stay whatever their names; rows are independent, so repeated ones give equal texts, and an empty
    table gives an empty one.
    """
    w = learn(pages, html_col) if weights is None else weights
    return add_column(pages, text_col, "string", html_col, lambda html: pa.array([extract(p, w) for p in html.to_pylist()], pa.string()))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page; a null or empty page has an empty text, repeated rows give equal rows."""
    out = main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
