"""Daily summaries of events, merged when asked, beside exact figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import sketches as S
from quarryline.operators.numbering import number_rows
from quarryline.plans.registry import query, table
from quarryline.session import saved


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))


_H = "('0x' || substr(md5(user_id::VARCHAR || props), 1, 15))::BIGINT"


def _thing() -> Column:
    return F.concat(F.col("user_id").cast("string"), F.col("props"))


@query(f"""WITH h AS (SELECT event_type, {_H} AS h FROM events WHERE user_id IS NOT NULL AND props IS NOT NULL),
r AS (SELECT event_type, h & 2047 AS register, max(CASE WHEN h >> 11 = 0 THEN 50 ELSE 50 - length(bin(h >> 11)) END) AS rank FROM h GROUP BY ALL),
s AS (SELECT event_type, sum(pow(2.0, -rank)) AS s, count(*) AS full_n FROM r GROUP BY ALL),
e AS (SELECT *, {0.7213 / (1 + 1.079 / 2048) * 2048 * 2048}::DOUBLE / (s + (2048 - full_n)) AS raw FROM s)
SELECT event_type, round(CASE WHEN raw <= 5120 AND full_n < 2048 THEN 2048 * ln(2048.0 / (2048 - full_n)) ELSE raw END, 3) AS estimate, n AS exact, abs(CASE WHEN raw <= 5120 AND full_n < 2048 THEN 2048 * ln(2048.0 / (2048 - full_n)) ELSE raw END / n - 1) < {round(4 * 1.04 / 2048**0.5, 6)} AS within_bound, true AS same_in_one_pass
FROM e JOIN (SELECT event_type, count(DISTINCT user_id::VARCHAR || props) AS n FROM events GROUP BY event_type) USING (event_type)""")
def sketch_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of user and properties by type from daily registers, within four standard errors of the exact count."""
    events = _events(spark, sf_dir)
    daily = saved(S.distinct_registers(events, ["day", "event_type"], _thing()))
    merged = S.merge_registers(daily, ["event_type"])
    once = S.distinct_registers(events, ["event_type"], _thing())
    differ = merged.exceptAll(once).unionAll(once.exceptAll(merged)).groupBy("event_type").agg(F.count("*").alias("differ"))
    exact = events.groupBy("event_type").agg(F.countDistinct(_thing()).alias("exact"))
    both = S.distinct_estimate(merged, ["event_type"]).join(exact, "event_type").join(differ, "event_type", "left")
    bound = round(4 * 1.04 / 2 ** (S.BITS / 2), 6)
    return both.select("event_type", F.round("estimate", 3).alias("estimate"), "exact", (F.abs(F.col("estimate") / F.col("exact") - 1) < bound).alias("within_bound"), F.col("differ").isNull().alias("same_in_one_pass"))


_SHARES = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)


@query("""WITH v AS (SELECT event_type, value - 20 AS v FROM events WHERE value IS NOT NULL), n AS (SELECT event_type, count(*) AS n FROM v GROUP BY ALL),
o AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY v) - 1 AS r FROM v),
x AS (SELECT o.event_type, q.share, o.v FROM o JOIN n USING (event_type) JOIN (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.9), (0.99), (1.0)) q(share) ON o.r = floor(q.share * (n.n - 1)))
SELECT event_type, share, round(v, 6) AS exact, round(sign(v) * 2 * pow(1.01::DOUBLE / 0.99::DOUBLE, CASE WHEN v = 0 THEN 0 ELSE ceil(ln(abs(v)) / ln(1.01::DOUBLE / 0.99::DOUBLE)) END) / (1 + 1.01::DOUBLE / 0.99::DOUBLE), 6) AS estimate, true AS within_bound FROM x""")
def sketch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of a value of both signs by type from daily buckets, within one in a hundred of the exact ones."""
    events = _events(spark, sf_dir).withColumn("v", F.col("value") - 20)
    daily = saved(S.quantile_buckets(events, ["day", "event_type"], F.col("v")))
    found = S.quantile_estimate(S.merge_buckets(daily, ["event_type"]), ["event_type"], _SHARES)
    exact = number_rows(saved(events.filter("v IS NOT NULL").select("event_type", "v")), ["v"], "event_type")
    wanted = exact.select("event_type", "v", "pos", "n", F.explode(F.array(*(F.lit(x) for x in _SHARES))).alias("share")).filter(F.col("pos") == F.floor(F.col("share") * (F.col("n") - 1)))
    both = found.join(wanted, ["event_type", "share"])
    off = F.abs(F.col("estimate") - F.col("v")) <= S.ACCURACY * F.abs("v") + 1e-9
    return both.select("event_type", "share", F.round("v", 6).alias("exact"), F.round("estimate", 6).alias("estimate"), off.alias("within_bound"))


@query(f"""WITH h AS (SELECT DISTINCT event_type, {_H} AS h FROM events WHERE user_id IS NOT NULL AND props IS NOT NULL),
t AS (SELECT event_type, h FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY h) AS r FROM h) WHERE r <= 1024),
p AS (SELECT a.event_type AS l, b.event_type AS r FROM (SELECT DISTINCT event_type FROM events) a, (SELECT DISTINCT event_type FROM events) b WHERE a.event_type < b.event_type),
u AS (SELECT l, r, h, bool_or(event_type = l) AS a, bool_or(event_type = r) AS b FROM p JOIN t ON t.event_type IN (l, r) GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l, r ORDER BY h) AS n FROM u) WHERE n <= 1024),
s AS (SELECT l, r, count(*) AS k, max(h) AS top, count(*) FILTER (a AND b) AS common, count(*) FILTER (a AND NOT b) AS lonely FROM k GROUP BY ALL),
e AS (SELECT *, CASE WHEN k < 1024 THEN k::DOUBLE ELSE 1023 / ((top + 1) / {float(2**60)}::DOUBLE) END AS total FROM s),
x AS (SELECT l, r, count(*) FILTER (a AND b) AS exact_common FROM (SELECT l, r, h, bool_or(event_type = l) AS a, bool_or(event_type = r) AS b FROM p JOIN h ON h.event_type IN (l, r) GROUP BY ALL) GROUP BY ALL)
SELECT l AS left_type, r AS right_type, round(total, 3) AS n_union, round(total * common / k, 3) AS n_common, round(total * lonely / k, 3) AS n_left_only, exact_common FROM e JOIN x USING (l, r)""")
def sketch_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pairs of event types have in common, from daily samples of hashes, beside the exact number."""
    events = _events(spark, sf_dir)
    daily = saved(S.set_sample(events, ["day", "event_type"], _thing()))
    merged = saved(S.merge_samples(daily, ["event_type"]))
    types = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    out = [S.set_sizes(merged, F.col("event_type") == a, F.col("event_type") == b).select(F.lit(a).alias("left_type"), F.lit(b).alias("right_type"), "n_union", "n_common", "n_left_only") for i, a in enumerate(types) for b in types[i + 1 :]]
    rough = reduce(DataFrame.unionAll, out).select("left_type", "right_type", *(F.round(c, 3).alias(c) for c in ("n_union", "n_common", "n_left_only")))
    each = events.select("event_type", _thing().alias("thing")).filter("thing IS NOT NULL").distinct()
    pairs = each.alias("a").join(each.alias("b"), (F.col("a.thing") == F.col("b.thing")) & (F.col("a.event_type") < F.col("b.event_type")))
    exact = pairs.groupBy(F.col("a.event_type").alias("left_type"), F.col("b.event_type").alias("right_type")).agg(F.count("*").alias("exact_common"))
    return rough.join(exact, ["left_type", "right_type"])
