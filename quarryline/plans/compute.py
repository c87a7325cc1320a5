"""Calculations over facts made of the orders: revenue and orders of a market segment in a year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import compute
from quarryline.plans.registry import query, table

_FACTS = """f AS (SELECT left(c_mktsegment, 2) AS ticker, year(o_orderdate)::INT AS fiscal_year, round(sum(o_totalprice), 2) AS revenue, count(*)::DOUBLE AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
n AS (SELECT ticker, fiscal_year, 'revenue' AS concept, revenue AS value FROM f UNION ALL SELECT ticker, fiscal_year, 'orders', orders FROM f)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sums = both.groupBy(F.left("c_mktsegment", F.lit(2)).alias("ticker"), F.year("o_orderdate").alias("fiscal_year")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").cast("double").alias("orders"))
    one = lambda name, unit: F.struct(F.lit(name).alias("concept"), F.col(name).alias("value"), F.lit(unit).alias("unit"))
    return sums.select("ticker", "fiscal_year", F.inline(F.array(one("revenue", "USD"), one("orders", "orders"))))


@query(f"""WITH {_FACTS}, q AS (SELECT c_custkey AS query_id, left(c_mktsegment, 2) AS ticker, (['growth', 'difference', 'ratio', 'sum', 'average', 'root'])[c_custkey % 6 + 1] AS calc, CASE WHEN c_custkey % 6 IN (2, 4) THEN 'orders' ELSE 'revenue' END AS m, (1994 + c_custkey % 9)::INT AS y FROM customer),
a AS (SELECT q.*, n0.value AS v0, n1.value AS v1, r.value AS vr, s.total, s.k FROM q LEFT JOIN n n0 ON n0.ticker = q.ticker AND n0.fiscal_year = q.y - 1 AND n0.concept = 'revenue' LEFT JOIN n n1 ON n1.ticker = q.ticker AND n1.fiscal_year = q.y AND n1.concept = q.m LEFT JOIN n r ON r.ticker = q.ticker AND r.fiscal_year = q.y AND r.concept = 'revenue'
 LEFT JOIN (SELECT q.query_id, sum(value) AS total, count(*) AS k FROM q JOIN n ON n.ticker = q.ticker AND n.concept = q.m AND n.fiscal_year BETWEEN q.y - 2 AND q.y GROUP BY ALL) s USING (query_id)),
t AS (SELECT *, CASE WHEN calc = 'root' THEN 'unknown_calculation' WHEN calc IN ('growth', 'difference') AND (v0 IS NULL OR v1 IS NULL) OR calc = 'ratio' AND v1 IS NULL OR calc IN ('sum', 'average') AND coalesce(k, 0) < 3 THEN 'missing' ELSE 'ok' END AS status FROM a)
SELECT query_id, status, CASE WHEN status = 'ok' THEN round(CASE calc WHEN 'growth' THEN (v1 - v0) * 100 / abs(v0) WHEN 'difference' THEN v1 - v0 WHEN 'ratio' THEN v1 / vr WHEN 'sum' THEN total ELSE total / k END, 4) END AS value,
 CASE WHEN status = 'ok' THEN CASE calc WHEN 'growth' THEN '%' WHEN 'ratio' THEN 'orders/USD' WHEN 'average' THEN 'orders' ELSE 'USD' END END AS unit FROM t""")
def compute_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth, difference, ratio, sum and average for each customer's segment, in one plan; years at the edges have no facts."""
    n, kind = F.col("c_custkey"), F.col("c_custkey") % 6
    calc = F.get(F.array(*map(F.lit, ("growth", "difference", "ratio", "sum", "average", "root"))), kind.cast("int"))
    year = (1994 + n % 9).cast("int")
    years = F.when(kind < 2, F.array(year - 1, year)).when(kind.isin(3, 4), F.array(year - 2, year)).otherwise(F.array(year))
    metrics = F.when(kind == 2, F.array(F.lit("orders"), F.lit("revenue"))).when(kind == 4, F.array(F.lit("orders"))).otherwise(F.array(F.lit("revenue")))
    asked = table(spark, sf_dir, "customer").select(n.alias("query_id"), calc.alias("calculation"), F.left("c_mktsegment", F.lit(2)).alias("company"), metrics.alias("metrics"), years.alias("year_range"))
    return compute.compute(asked, _facts(spark, sf_dir)).select("query_id", "status", F.round("value", 4).alias("value"), "unit")
