"""Queries over time: overlapping intervals, as-of joins, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import temporal
from quarryline.plans.registry import query, table
from quarryline.streaming import sessions


@query("""WITH o AS (SELECT o_orderkey, o_orderdate AS open_at, o_orderdate + to_days((o_orderkey % 4)::INT) AS open_to, o_orderkey % 25 AS dock FROM orders),
l AS (SELECT l_orderkey, l_linenumber, l_shipdate AS ship_at, l_shipdate + to_days(CASE WHEN l_orderkey % 500 = 0 THEN 700 ELSE l_linenumber % 3 END::INT) AS ship_to, l_suppkey % 25 AS dock FROM lineitem)
SELECT o_orderkey, l_orderkey, l_linenumber, o.dock, date_diff('day', greatest(open_at, ship_at), least(open_to, ship_to))::INT AS days FROM o JOIN l ON o.dock = l.dock AND open_at <= ship_to AND ship_at <= open_to""")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are open while lines are under way at the same dock; some lines take two years."""
    days = lambda n: F.make_dt_interval(n)
    # days of each end as numbers, once a row: a pair only subtracts (a later time has no earlier day, so the order is kept)
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("open_at"), (F.col("o_orderdate") + days((F.col("o_orderkey") % 4).cast("int"))).alias("open_to"), (F.col("o_orderkey") % 25).alias("dock"))
    n = F.when(F.col("l_orderkey") % 500 == 0, 700).otherwise(F.col("l_linenumber") % 3)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("ship_at"), (F.col("l_shipdate") + days(n.cast("int"))).alias("ship_to"), (F.col("l_suppkey") % 25).alias("dock"))
    o, li = (t.withColumns({f"{c}_day": day(c) for c in t.columns if c.endswith(("_at", "_to"))}) for t in (o, li))
    pairs = temporal.overlap_join(o, li, ("open_at", "open_to"), ("ship_at", "ship_to"), ["dock"])
    both = F.least("open_to_day", "ship_to_day") - F.greatest("open_at_day", "ship_at_day")
    return pairs.select("o_orderkey", "l_orderkey", "l_linenumber", "dock", both.alias("days"))


#: Orders with their time moved into that of the events, some without a key or a time, several a moment.
_MOVED = "TIMESTAMP '2024-01-01' + to_days((o_orderkey % 30)::INT)"


@query(f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 89 = 0 THEN date_trunc('day', ts) WHEN event_id % 83 <> 0 THEN ts END AS ts FROM events),
o AS (SELECT o_custkey, moved, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM (SELECT *, {_MOVED} AS moved FROM orders WHERE o_orderkey % 7 <> 0) GROUP BY ALL)
SELECT e.event_id, o.o_orderkey, o.o_totalprice, o.moved AS order_at FROM e ASOF LEFT JOIN o ON e.user_id = o.o_custkey AND e.ts >= o.moved""")
def asof_events_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each event's user up to the event; nulls in keys and times, ties in both tables."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 97 != 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 89 == 0, F.date_trunc("day", "ts").cast("timestamp_ntz")).when(F.col("event_id") % 83 != 0, F.col("ts")).alias("ts"))
    moved = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("o_orderkey") % 30).cast("int"))
    rows = table(spark, sf_dir, "orders")
    o = rows.select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"), "o_orderkey", "o_totalprice", moved.alias("order_at"))
    return temporal.asof_join(e, o, "ts", "order_at", [("user_id", "o_custkey")], order=["o_orderkey"]).select("event_id", "o_orderkey", "o_totalprice", "order_at")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 3600 SECONDS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users by a stream with keyed state, stopped and started again half-way."""
    out = sessions.sessions_in_two_runs(spark, table(spark, sf_dir, "events"), "user_id", "ts", "value", 3600, "60 days")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n", F.round("total", 4).alias("total"))
