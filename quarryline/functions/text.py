"""Scalar functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.schemas import ACTION_CODES, ITEM_SECTIONS, SCALES


#: Unicode white space, as ``(?U)\s`` has it.
_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(text: Column | str) -> Column:
    """Lower case, every run of Unicode white space one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(_c(text)), r"(?U)\s+", " "))


def strip_space(text: Column | str) -> Column:
    """Trim Unicode white space (``trim`` alone knows only U+0020)."""
    return F.btrim(_c(text), F.lit(_SPACE))


def plain_spaces(text: Column | str) -> Column:
    """No-break spaces become plain ones."""
    return F.translate(_c(text), "\u00a0", " ")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def slice_html(text: Column | str) -> Column:
    """From the first ``<html`` to the last ``</html>`` in any case; without both, the stripped text."""
    found = F.struct(_c(text).alias("t"), F.regexp_extract(_c(text), r"(?is)<html.*", 0).alias("rest"))
    whole = lambda f: F.struct(f["t"].alias("t"), f["rest"].alias("rest"), F.regexp_extract(f["rest"], r"(?is)\A.*</html>", 0).alias("html"))
    apart = lambda f: (f["rest"] == "") | ~f["t"].rlike("(?i)</html>")
    return _let(found, lambda f: _let(whole(f), lambda w: F.when(w["html"] != "", w["html"]).when(apart(w), strip_space(w["t"])).when(w["t"].isNotNull(), "")))


def primary_document(text: Column | str, doc_type: str = "10-K") -> Column:
    """struct<html, status>: the ``<TEXT>`` of the first document of exactly this type."""
    return document_html(first_document(text, doc_type))


def first_document(text: Column | str, doc_type: str = "10-K") -> Column:
    """What stands in the first document of exactly this type; null if there is none."""
    docs = F.regexp_extract_all(_c(text), F.lit(r"(?s)<DOCUMENT>(.*?)</DOCUMENT>"), F.lit(1))
    kind = lambda d: F.trim(F.regexp_extract(d, r"<TYPE>([^\r\n]*)", 1))
    return F.get(F.filter(docs, lambda d: kind(d) == doc_type), F.lit(0))


def document_html(first: Column) -> Column:
    """struct<html, status> of what ``first_document`` found."""

    def of(rest: Column) -> Column:
        has_text = rest.contains("</TEXT>")
        status = F.when(rest.isNull(), "no_document").when(~has_text, "no_text").otherwise("ok")
        body = F.regexp_extract(F.substring_index(rest, "</TEXT>", 1), r"(?s)\A<TEXT>(.*)", 1)
        return F.struct(F.when(has_text, slice_html(body)).alias("html"), status.alias("status"))

    return _let(F.regexp_extract(first, r"(?s)<TEXT>.*", 0), of)


def item_section(title: Column | str) -> Column:
    """Section of an item heading such as ``Item 7A.``; null for anything else."""
    number = F.regexp_extract(plain_spaces(title), r"(?iU)^\s*item\s+(\d+[a-c]?)\s*[.\-–—:]", 1)
    return F.element_at(F.create_map(*(F.lit(x) for kv in ITEM_SECTIONS.items() for x in kv)), F.lower(number))


def header_fields(text: Column | str) -> Column:
    """struct<filing_type, period_of_report, fiscal_year, status>; the status names the first field that is missing."""
    t = _c(text)
    kind = F.trim(F.regexp_extract(t, r"(?m)^CONFORMED SUBMISSION TYPE:\s*(.+)$", 1))
    period = F.regexp_extract(t, r"(?m)^CONFORMED PERIOD OF REPORT:\s*(\d{8})", 1)

    def of(h: Column) -> Column:
        status = F.when(h["kind"] == "", "missing_submission_type").when(h["period"] == "", "missing_period_of_report").otherwise("ok")
        day = F.nullif(h["period"], F.lit(""))
        return F.struct(F.nullif(h["kind"], F.lit("")).alias("filing_type"), day.alias("period_of_report"), F.substring(day, 1, 4).cast("int").alias("fiscal_year"), status.alias("status"))

    return _let(F.struct(kind.alias("kind"), period.alias("period")), of)


def ticker_from_path(path: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(path), r"sec-edgar-filings/([^/]+)/", 1), F.lit(""))


def accession_from_path(path: Column | str) -> Column:
    return F.try_element_at(F.split(_c(path), "/"), F.lit(-2))


def valid_accession(accession: Column | str) -> Column:
    return _c(accession).rlike(r"^\d{10}-\d{2}-\d{6}$")


def normalize_ticker(company: Column | str) -> Column:
    return F.translate(F.upper(strip_space(company)), "./", "--")


def strip_fences(text: Column | str) -> Column:
    """Take off an opening code fence with its line and a closing fence."""
    t = strip_space(text)
    opened = t.startswith("```")
    inner = F.regexp_replace(F.regexp_replace(t, r"(?s)^```[^\n]*\n?", ""), r"(?s)\s*```\s*$", "")
    return F.when(opened, strip_space(inner)).otherwise(t)


def count_tokens(text: Column | str) -> Column:
    """Words between white space: the default token count."""
    return F.regexp_count(_c(text), F.lit(r"[^ \t\n\r\f\x0B]+"))


def sentences(text: Column | str) -> Column:
    return F.split(_c(text), r"(?<=[.!?])\s+")


def paragraphs(text: Column | str, delimiter: str = "\n\n") -> Column:
    """Stripped parts between delimiters, without the empty ones."""
    return F.filter(F.transform(F.split(_c(text), delimiter), strip_space), lambda x: x != "")


def first_filled(*values: Column | str) -> Column:
    """The first value that is neither null nor empty; the last one as it is."""
    *some, last = map(_c, values)
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in some), last)


def extract_numbers(text: Column | str) -> Column:
    """All numbers in base units; form names are skipped, a scale word counts only right behind its number."""
    t, pattern = _c(text), F.lit(r"(?i)(\d[\d,]*\.?\d*)(-[KQ])?((?U)\s{0,11}(thousand|million|billion|trillion))?")
    part = lambda i: F.regexp_extract_all(t, pattern, F.lit(i))
    rows = F.arrays_zip(part(1).alias("n"), part(2).alias("form"), part(4).alias("scale"))
    scale = F.create_map(*(F.lit(x) for kv in SCALES.items() for x in kv))
    is_form = lambda r: (r["n"] == "10") & F.upper(r["form"]).isin("-K", "-Q")
    kept = F.filter(rows, lambda r: ~is_form(r))
    value = lambda r: F.regexp_replace(r["n"], ",", "").cast("double") * F.coalesce(F.try_element_at(scale, F.lower(r["scale"])), F.lit(1.0))
    return F.coalesce(F.transform(kept, value), F.array().cast("array<double>"))


def numeric_match(expected: Column | str, actual: Column | str, tolerance: float = 0.01) -> Column:
    """Whether any number of ``actual`` lies within the relative tolerance of the first of ``expected``."""
    target = F.get(extract_numbers(expected), F.lit(0))
    near = lambda x: F.when(target == 0, F.abs(x) < 1e-9).otherwise(F.abs(x - target) / F.abs(target) <= tolerance)
    return F.coalesce(F.exists(extract_numbers(actual), near), F.lit(False))


def chunk_id(accession: Column | str, index: Column | str) -> Column:
    """The loose key that evaluation uses; not unique within a filing."""
    return F.concat_ws("#", _c(accession), _c(index).cast("string"))


def strict_chunk_id(accession: Column | str, section: Column | str, content_type: Column | str, record: Column | str, index: Column | str) -> Column:
    return F.concat_ws("|", _c(accession), F.coalesce(_c(section), F.lit("")), _c(content_type), _c(record).cast("string"), _c(index).cast("string"))


def parse_action(raw: Column | str, codes: tuple[str, ...] = ACTION_CODES, key: str = "action_code") -> Column:
    """struct<code, status> of a model's output: the outermost braces, JSON, key, taxonomy."""
    t = F.coalesce(_c(raw), F.lit(""))
    body = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    parsed = F.try_parse_json(body)
    code = F.try_variant_get(parsed, f"$.{key}", "string")
    status = (
        F.when(strip_space(t) == "", "empty")
        .when((body == "") | parsed.isNull(), "invalid_json")
        .when(code.isNull(), "missing_key")
        .when(~code.isin(*codes), "out_of_taxonomy")
        .otherwise("ok")
    )
    return F.struct(F.when(status == "ok", code).alias("code"), status.alias("status"))


def cost(input_tokens: Column | str, output_tokens: Column | str, per_million_in: float = 3.0, per_million_out: float = 15.0) -> Column:
    return _c(input_tokens) / 1e6 * per_million_in + _c(output_tokens) / 1e6 * per_million_out


def equals_all(filters: dict[str, object], allowed: tuple[str, ...]) -> Column:
    """Conjunction of equalities over whitelisted columns; a null value matches nothing, no filter matches all."""
    bad = set(filters) - set(allowed)
    if bad:
        raise ValueError(f"unknown filter columns: {sorted(bad)}")
    return reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in filters.items()), F.lit(True))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two arrays, in double precision; null if either is zero."""
    x, y = (F.transform(_c(v), lambda e: e.cast("double")) for v in (a, b))
    add = lambda p, q: p + q
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), add)
    return F.try_divide(dot, norm(a) * norm(b))


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda e: e.cast("double") * e.cast("double")), F.lit(0.0), lambda p, q: p + q))
