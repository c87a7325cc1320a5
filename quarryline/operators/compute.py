"""Calculations over facts of filings: named formulas whose operands are looked up by joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators.answers import WORD

#: What each calculation needs: one concept in two years, two concepts in one, or one in all years of a range.
TWO_YEARS, TWO_CONCEPTS, MANY_YEARS = ("growth", "difference"), ("ratio",), ("sum", "average")
NAMES = (*TWO_YEARS, *TWO_CONCEPTS, *MANY_YEARS)


def calculation_params(query: Column, concepts: list[str]) -> Column:
    """struct<calculation, metrics> of a question: the first calculation and the concepts that it names, in its order."""
    words = F.transform(F.regexp_extract_all(query, F.lit(WORD), F.lit(0)), F.lower)
    known = lambda names: F.filter(words, lambda w: w.isin(*names))
    return F.struct(F.get(known(NAMES), F.lit(0)).alias("calculation"), F.array_distinct(known(concepts)).alias("metrics"))


def operands(questions: DataFrame) -> DataFrame:
    """A row for each value that a question needs: query_id, slot (0: first operand, 1: second), ticker, fiscal_year, concept.

    Questions: query_id, calculation, company, metrics, year_range (first and last year; the year before the only one is the first, where two are needed).
    """
    calc, last = F.col("calculation"), F.element_at("year_range", -1)
    first = F.when(F.size("year_range") > 1, F.get("year_range", F.lit(0))).otherwise(last - F.when(calc.isin(*TWO_YEARS), 1).otherwise(0))
    metric = lambda i: F.get("metrics", F.lit(i))
    one = lambda slot, year, concept: F.struct(F.lit(slot).alias("slot"), year.cast("int").alias("fiscal_year"), concept.alias("concept"))
    two_years = F.array(one(0, first, metric(0)), one(1, last, metric(0)))
    two_concepts = F.array(one(0, last, metric(0)), one(1, last, metric(1)))
    many = F.transform(F.sequence(F.least(first, last), F.greatest(first, last)), lambda y: one(0, y, metric(0)))
    needed = F.when(calc.isin(*TWO_YEARS), two_years).when(calc.isin(*TWO_CONCEPTS), two_concepts).when(calc.isin(*MANY_YEARS), many)
    return questions.filter(F.size("year_range") > 0).select("query_id", F.col("company").alias("ticker"), F.inline(needed))


def compute(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """query_id, status, value, unit, missing of every question, in one plan over ``facts`` (ticker, fiscal_year, concept, value, unit).

    Growth is in percent of the first year; a ratio of equal units has none.  Statuses: ``ok``; ``unknown_calculation``;
    ``missing`` (``missing`` lists the operands that no fact gives, or that no question names); ``ambiguous`` (facts of one key that differ); ``unit_mismatch``;
    ``undefined`` (a division by zero).  All but ``ok`` have no value.  Repeated equal facts count once.
    """
    once = facts.filter("value IS NOT NULL").groupBy("ticker", "fiscal_year", "concept").agg(F.min("value").alias("value"), F.min(F.coalesce("unit", F.lit(""))).alias("unit"), (F.countDistinct("value", F.coalesce("unit", F.lit(""))) > 1).alias("twice"))
    keys = ["ticker", "fiscal_year", "concept"]
    found = operands(questions).join(once, keys, "left")
    label = F.concat_ws(" ", F.coalesce("concept", F.lit("?")), F.col("fiscal_year").cast("string"))
    at = lambda slot, c: F.max(F.when(F.col("slot") == slot, F.col(c)))
    sums = found.groupBy("query_id").agg(
        at(0, "value").alias("a"), at(1, "value").alias("b"), at(0, "unit").alias("unit_a"), at(1, "unit").alias("unit_b"), F.sum("value").alias("total"), F.count("*").alias("n"),
        F.countDistinct("unit").alias("units"), F.coalesce(F.max("twice"), F.lit(False)).alias("twice"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("value").isNull(), label))), ", ").alias("missing"),
    )
    df = questions.select("query_id", "calculation").join(sums, "query_id", "left")
    calc = F.col("calculation")
    divisor = F.when(calc == "growth", F.col("a")).when(calc == "ratio", F.col("b"))
    status = (
        F.when(calc.isNull() | ~calc.isin(*NAMES), "unknown_calculation").when(F.col("n").isNull() | (F.col("missing") != ""), "missing").when(F.col("twice"), "ambiguous")
        .when((calc != "ratio") & (F.col("units") > 1), "unit_mismatch").when(divisor == 0, "undefined").otherwise("ok")
    )
    value = (
        F.when(calc == "growth", F.try_divide((F.col("b") - F.col("a")) * 100, F.abs("a"))).when(calc == "difference", F.col("b") - F.col("a"))
        .when(calc == "ratio", F.try_divide("a", "b")).when(calc == "sum", F.col("total")).when(calc == "average", F.try_divide("total", "n"))
    )
    unit = F.when(calc == "growth", "%").when((calc == "ratio") & (F.col("unit_a") == F.col("unit_b")), "").when(calc == "ratio", F.concat_ws("/", "unit_a", "unit_b")).otherwise(F.col("unit_a"))
    ok = F.col("status") == "ok"
    return df.withColumn("status", status).select("query_id", "status", F.when(ok, value).alias("value"), F.when(ok, unit).alias("unit"), F.when(F.col("status") == "missing", F.col("missing")).otherwise("").alias("missing"))


def computed_answers(asked: DataFrame, facts: DataFrame, concepts: list[str]) -> DataFrame:
    """(query_id, computed_text, computed_status) of routed questions (query_id, query, code, params): what the dispatch to answers takes."""
    params = calculation_params(F.col("query"), concepts)
    some = asked.filter("code = 'compute'").select("query_id", params["calculation"].alias("calculation"), F.col("params.company").alias("company"), params["metrics"].alias("metrics"), F.array_compact(F.array("params.year")).alias("year_range"))
    number = F.format_string("%.4f", "value")
    text = F.when(F.col("status") == "ok", F.concat_ws(" ", "calculation", F.lit("of"), F.array_join("metrics", " to "), F.lit("of"), "company", F.lit("is"), F.rtrim(F.concat_ws(" ", number, "unit"))))
    texts = {"missing": F.concat(F.lit("These figures are not in the corpus: "), F.col("missing"), F.lit(".")), "ambiguous": F.lit("The corpus holds different figures for this."), "unit_mismatch": F.lit("The figures are in different units."), "undefined": F.lit("That would divide by zero.")}
    other = reduce(lambda c, k: c.when(F.col("status") == k, texts[k]), texts, text)
    status = F.when(F.col("status") == "ok", "ok").when(F.col("status") == "unknown_calculation", "clarify").otherwise("declined")
    both = compute(some, facts).join(some.select("query_id", "calculation", "metrics", "company"), "query_id")
    return both.select("query_id", other.otherwise(F.lit("Growth, difference, ratio, sum or average: which one is meant?")).alias("computed_text"), status.alias("computed_status"))
