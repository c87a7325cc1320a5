"""HTML to ordered typed elements, tables as Markdown; the standard parser inside an Arrow stage."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from quarryline.session import ship

_BLOCK = {"p", "div", "li", "td", "th", "tr", "section", "article", "blockquote", "pre", "dd", "dt", "figcaption", "center"}
_SKIP = {"script", "style", "head", "title", "noscript", "template"}
_ITEM = re.compile(r"^\s*(?:item\s+\d+[a-c]?\s*[.\-–—:]|part\s+[ivx]+\b)", re.IGNORECASE)
_BOLD = {"b", "strong"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)?")


def markdown(rows: list[list[str]]) -> str:
    """A pipe table; the first row is the head and short rows are filled up."""
    rows = [r for r in rows if any(c for c in r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(c.replace("|", "\\|") for c in (*r, *[""] * (width - len(r)))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


class _Walker(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.held: list[str] = []
        self.bold_chars = self.chars = self.bold = self.skip = self.depth = 0
        self.heading = ""
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.held).replace(" ", " ").split())
        if text:
            all_bold = self.bold_chars >= self.chars > 0
            kind = "Title" if self.heading or all_bold or _ITEM.match(text) and len(text) < 200 and self.bold_chars else "Text"
            if kind == "Title" and _ITEM.match(text):
                kind = "TopSectionTitle"
            self.out.append((kind, text))
        self.held, self.bold_chars, self.chars = [], 0, 0

    def handle_starttag(self, tag: str, attrs) -> None:
        style = (dict(attrs).get("style") or "").replace(" ", "").lower() if tag == "span" else ""
        if tag in _SKIP:
            self.skip += 1
        elif tag == "table":
            if not self.depth:
                self.flush()
                self.rows = []
            self.depth += 1
        elif self.depth:
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th"):
                self.cell = []
        elif tag in _HEADINGS:
            self.flush()
            self.heading = tag
        elif tag in _BLOCK or tag == "br":
            self.flush()
        if tag in _BOLD or tag == "span" and ("font-weight:bold" in style or "font-weight:700" in style):
            self.bold += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth:
                text = markdown(self.rows)
                if text:
                    self.out.append(("Table", text))
        elif self.depth:
            if tag in ("td", "th") and self.cell is not None:
                if not self.rows:
                    self.rows.append([])
                self.rows[-1].append(" ".join("".join(self.cell).split()))
                self.cell = None
        elif tag in _HEADINGS:
            self.flush()
            self.heading = ""
        elif tag in _BLOCK:
            self.flush()
        if tag in _BOLD or tag == "span":
            self.bold = max(0, self.bold - 1)

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.depth:
            if self.cell is not None:
                self.cell.append(data)
            return
        self.held.append(data)
        n = len("".join(data.split()))
        self.chars += n
        self.bold_chars += n if self.bold else 0


def _closed(m: re.Match) -> str:
    """A character reference that is known and ends with a semicolon as it is; any other ampersand as text."""
    name = m.group(1)
    return m.group() if name and (name[0] == "#" or name in html5) else "&amp;" + (name or "")


def elements(html: str | None, closed: bool = False) -> list[tuple[str, str]]:
    """(type, text) in page order: TopSectionTitle, Title, Table or Text.

    As the standard has it, ``&amp`` without a semicolon is a reference, too; with ``closed`` it is text.
    """
    w = _Walker()
    w.feed(_REFERENCE.sub(_closed, html or "") if closed else html or "")
    w.close()
    w.flush()
    return w.out


def explode_elements(pages: DataFrame, html_col: str = "html", closed: bool = False) -> DataFrame:
    """One row for each element: the other columns of ``pages``, then pos, type, element_text; ``closed`` as in ``elements``."""
    names = [c for c in pages.columns if c != html_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != html_col), "pos int, type string, element_text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, pos, kind, text = [], [], [], []
            for i, page in enumerate(b.column(html_col).to_pylist()):
                for j, (k, t) in enumerate(elements(page, closed)):
                    rows.append(i)
                    pos.append(j)
                    kind.append(k)
                    text.append(t)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(n).take(at) for n in names), pa.array(pos, pa.int32()), pa.array(kind, pa.string()), pa.array(text, pa.string())], names=[*names, "pos", "type", "element_text"])

    ship(pages.sparkSession)
    return pages.mapInArrow(run, schema)
