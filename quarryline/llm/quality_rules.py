"""Operator 9: quality rules with risk-controlled thresholds.

Each rule rejects a document whose statistic exceeds a cutoff.  For every
stratum (the ``lang`` value) and rule, labelled rows tell how many good
documents each cutoff of a fixed grid would reject.  A cutoff may be used if
the exact (Clopper-Pearson) upper bound of its false-rejection rate stays
below ``alpha / rules``, at confidence ``1 - delta / tests``, where ``tests``
counts all pairs of stratum and rule (Bonferroni).  Within a pair cutoffs are
tested from the loosest on and the first failure ends it (fixed-sequence
testing), which needs no further correction.  So with probability ``1 - delta``
no stratum loses more than ``alpha`` of its good documents to the rules
together.  Of the cutoffs that hold, the loosest one that still catches
nearly all (``CATCH``) of the labelled junk that the strictest would is used; a
rule that catches none, and a stratum with too few labels, gets no cutoff.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import Scratch, q, shared_table, spread_join, table
from quarryline.llm.docstats import document_stats

#: Statistic of each rule, as SQL over the columns of ``document_stats``; all rise with junk.
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "pipes": "n_pipe / greatest(n_words, 1)",
    "bangs": "n_bang / greatest(n_words, 1)",
    "capitals": "n_upper / greatest(n_letters, 1)",
    "stutter": "n_stutter / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "lines": "n_dup_lines / greatest(n_lines, 1)",
    "digits": "n_digits / greatest(n_chars, 1)",
}
GRID = tuple(i / 40 for i in range(40))
ALPHA = 0.05
DELTA = 0.05
CATCH = 0.98


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 200_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1 + step * d) or 1e-300)
            c = (1 + step / c) or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def binomial_upper(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate under which at most ``k`` of ``n`` has probability ``delta``."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    while hi - lo > 1e-10:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(1 - mid, n - k, k + 1) > delta else (lo, mid)
    return hi


def choose_cutoffs(bins: dict[str, dict[int, tuple[int, int]]], tests: int, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, float]:
    """Cutoff of each rule that has one in a stratum; ``bins``: by rule and bin, the good and bad documents there.

    Bin ``b`` holds the documents whose statistic exceeds exactly the grid's first ``b`` points; ``tests``
    counts the pairs of stratum and rule that are tested in all.
    """
    out = {}
    for rule, own in bins.items():
        total = sum(g for g, _ in own.values())
        lost = caught = 0
        held: list[tuple[float, int]] = []
        for g in reversed(range(len(GRID))):
            good, bad = own.get(g + 1, (0, 0))
            lost, caught = lost + good, caught + bad
            if lost > alpha / len(RULES) * total or binomial_upper(lost, total, delta / tests) > alpha / len(RULES):
                break  # the bound is above the rate itself
            held.append((GRID[g], caught))
        if held and held[-1][1]:
            out[rule] = next(c for c, n in held if n >= CATCH * held[-1][1])
    return out


def _cutoffs(tests: int, alpha: float, delta: float):
    """A row for the stratum: its cutoff for each rule, null where there is none."""

    def run(t: pa.Table) -> pa.Table:
        bins: dict[str, dict[int, tuple[int, int]]] = {}
        for r in t.to_pylist():
            bins.setdefault(r["rule"], {})[r["bin"]] = (r["good"], r["bad"])
        cut = choose_cutoffs(bins, tests, alpha, delta)
        return pa.table([t.column("stratum").slice(0, 1), *(pa.array([cut.get(r)], pa.float64()) for r in RULES)], names=["stratum", *(f"cut_{r}" for r in RULES)])

    return run


def _bin(stat: Column) -> Column:
    """How many grid points a statistic exceeds (the grid is evenly spaced from 0)."""
    return F.greatest(F.lit(0), F.least(F.lit(len(GRID)), F.ceil(stat * 40))).cast("int")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, failed_rules, kept.

    Null text has no words and fails the base.  A null stratum is a stratum of
    its own.  Labels without a document, null labels and strata without labels
    certify nothing; with no labels at all only the base decides.  An id that
    is labelled more than once counts as good if any label says so.
    """
    stats = document_stats(docs, id_col, text_col, stratum=F.coalesce(F.col(q(stratum_col)).cast("string"), F.lit("\x00none")))
    with Scratch(docs.sparkSession) as scratch:
        stats = scratch.table(stats)
        label = labels.filter("quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("is_good"))
        held = stats.filter(~base_failed()).join(label, "doc_id")
        stacked = held.select("stratum", "is_good", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), _bin(F.expr(e)).alias("bin")) for r, e in RULES.items()))).alias("x"))
        tally = scratch.table(stacked.groupBy("stratum", "x.rule", "x.bin").agg(F.count_if(F.col("is_good") == 1).alias("good"), F.count_if(F.col("is_good") == 0).alias("bad")))
        tests = max(1, tally.select("stratum").distinct().count() * len(RULES))
        # A group is one stratum: a row for each rule and bin at most.
        cut = scratch.table(tally.groupBy("stratum").applyInArrow(_cutoffs(tests, alpha, delta), "stratum string, " + ", ".join(f"cut_{r} double" for r in RULES)))
        judged = spread_join(stats, cut, "stratum", how="left", by="doc_id")
        failed = F.array_compact(F.array(*(F.when(_bin(F.expr(e)) > F.round(F.col(f"cut_{r}") * 40).cast("int"), F.lit(r)) for r, e in RULES.items())))
        out = judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), failed.alias("failed_rules"))
        return shared_table(out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed, failed_rules, kept of every row; nulls, missing labels and an empty table as in ``quality_rules``."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels")
    return quality_rules(docs, labels).withColumn("failed_rules", F.array_join("failed_rules", ","))


def _sql() -> str:
    """The query in SQL: statistics from their definitions, cutoffs by exact binomial sums."""
    stats = {
        "symbols": "n_symbols / greatest(n_words, 1)", "pipes": "n_pipe / greatest(n_words, 1)", "bangs": "n_bang / greatest(n_words, 1)", "capitals": "n_upper / greatest(n_letters, 1)",
        "stutter": "n_stutter / greatest(n_words, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "lines": "n_dup_lines / greatest(n_lines, 1)", "digits": "n_digits / greatest(n_chars, 1)",
    }
    space, level = r"[\x20\x09-\x0D]", f"{ALPHA} / {len(RULES)}"
    chars = lambda keep: f"length(regexp_replace(text, '{keep}', '', 'g'))"
    bins = " UNION ALL ".join(f"SELECT doc_id, stratum, base_failed, {i} AS pos, '{r}' AS rule, greatest(0, least({len(GRID)}, ceil(({e})::DOUBLE * 40)))::INT AS bin FROM m" for i, (r, e) in enumerate(stats.items()))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, chr(0) || 'none') AS stratum, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{space}+'), lambda w: w <> '') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM (SELECT doc_id, i, md5(array_to_string(ws[i:i + 4], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM t WHERE len(ws) > 4))),
h AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g, (SELECT unnest(range(0, 5)) AS j) WHERE n > 1 GROUP BY doc_id),
n AS (SELECT t.doc_id, stratum, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars, {chars("[^#*$%&|<>]")}::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(h.n, 0)::BIGINT AS n_repeat_words,
  length(text) AS n_chars, len(ls) AS n_lines, {chars("[^|]")} AS n_pipe, {chars("[^!?]")} AS n_bang, {chars("[^A-Z]")} AS n_upper, {chars("[^0-9]")} AS n_digits, {chars("[^A-Za-z]")} + {chars(r"[\x00-\x7F]")} AS n_letters,
  CASE WHEN len(ws) > 1 THEN len(list_filter(list_zip(ws[1:len(ws) - 1], ws[2:len(ws)]), lambda z: z[1] = z[2])) ELSE 0 END AS n_stutter FROM t LEFT JOIN h ON t.doc_id = h.doc_id),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM n),
b AS ({bins}),
l AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
y AS (SELECT stratum, rule, bin, good FROM b JOIN l ON b.doc_id = l.doc_id WHERE NOT base_failed),
k AS (SELECT (count(DISTINCT stratum) * {len(RULES)})::DOUBLE AS tests FROM y),
z AS (SELECT stratum, rule, c, count(*) FILTER (good = 1) AS total, count(*) FILTER (good = 1 AND bin > c) AS lost, count(*) FILTER (good = 0 AND bin > c) AS caught FROM y, (SELECT unnest(range(0, {len(GRID)})) AS c) GROUP BY ALL),
q AS (SELECT z.*, lost < total AND lost <= {level}::DOUBLE * total AND list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(total + 1) - lgamma(i + 1) - lgamma(total - i + 1) + i * ln({level}::DOUBLE) + (total - i) * ln(1 - {level}::DOUBLE)))) <= {DELTA}::DOUBLE / tests AS holds FROM z, k),
o AS (SELECT stratum, rule, c, caught, max(caught) OVER (PARTITION BY stratum, rule) AS most FROM q WHERE holds),
x AS (SELECT stratum, rule, max(c) AS cut FROM o WHERE most > 0 AND caught >= {CATCH}::DOUBLE * most GROUP BY stratum, rule),
v AS (SELECT b.doc_id, string_agg(b.rule, ',' ORDER BY pos) AS failed_rules FROM b JOIN x ON b.stratum = x.stratum AND b.rule = x.rule AND bin > cut GROUP BY b.doc_id)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(failed_rules, '') AS failed_rules, NOT base_failed AND failed_rules IS NULL AS kept FROM m LEFT JOIN v ON m.doc_id = v.doc_id
"""


SQL_OP9 = _sql()
