"""Mergeable summaries: distinct counts, quantiles and sets, stored by day and key and merged when asked.

All three are plain tables that merge by an aggregation which combines before the shuffle, so a merged
summary equals, value for value, the one built from all rows in one pass, in any grouping and order.

* distinct: ``2 ** BITS`` registers, each the largest number of leading zeros (plus one) of the hashes that fall to it;
  merge by maximum.  Standard error 1.04 / sqrt(2 ** BITS).
* quantiles: counts of log-spaced buckets; merge by sum.  A quantile is off by at most ``ACCURACY`` of its value.
* sets: the ``SAMPLE`` least distinct hashes; merge by the least of both.  Sizes of unions, intersections and differences
  come from the share of the sample that lies in them.

A stored summary holds a row for each day, key and register, bucket or hash: bounded whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BITS, BITS, SAMPLE = 60, 11, 1024
ACCURACY = 0.01
_GAMMA = (1 + ACCURACY) / (1 - ACCURACY)


def hash60(value: Column) -> Column:
    """60 bits of the MD5 of a value's text; null stays null."""
    return F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


# --- distinct counts -------------------------------------------------------------------------


def distinct_registers(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """(keys, register, rank) of the non-null values."""
    hashed = rows.select(*keys, hash60(value).alias("h")).filter("h IS NOT NULL")
    rest = F.shiftright("h", BITS)
    rank = F.when(rest == 0, HASH_BITS - BITS + 1).otherwise(HASH_BITS - BITS + 1 - F.length(F.bin(rest)))
    return hashed.select(*keys, F.col("h").bitwiseAND(2**BITS - 1).cast("int").alias("register"), rank.alias("rank")).groupBy(*keys, "register").agg(F.max("rank").alias("rank"))


def merge_registers(registers: DataFrame, keys: Sequence[str]) -> DataFrame:
    return registers.groupBy(*keys, "register").agg(F.max("rank").alias("rank"))


def distinct_estimate(registers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, estimate); where registers are empty and the count is small, from the number of empty ones."""
    m = 2**BITS
    sums = registers.groupBy(*keys).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count("*").alias("full"))
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.col("s") + (m - F.col("full")))
    small = (raw <= 2.5 * m) & (F.col("full") < m)
    return sums.select(*keys, F.when(small, m * F.log(F.lit(float(m)) / (m - F.col("full")))).otherwise(raw).alias("estimate"))


# --- quantiles -------------------------------------------------------------------------------


def quantile_buckets(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """(keys, sign, bucket, n) of the non-null, finite values."""
    v = rows.select(*keys, value.cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')")
    bucket = F.when(F.col("v") == 0, 0).otherwise(F.ceil(F.log(F.abs("v")) / math.log(_GAMMA))).cast("int")
    return v.select(*keys, F.signum("v").cast("int").alias("sign"), bucket.alias("bucket")).groupBy(*keys, "sign", "bucket").agg(F.count("*").alias("n"))


def merge_buckets(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    return buckets.groupBy(*keys, "sign", "bucket").agg(F.sum("n").alias("n"))


def quantile_estimate(buckets: DataFrame, keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(keys, share, estimate): the value at rank floor(share * (n - 1)), within ``ACCURACY`` of it."""
    by = Window.partitionBy(*keys)
    order = [F.col("sign"), F.col("sign") * F.col("bucket")]  # a summary's buckets are few
    upto = buckets.withColumn("upto", F.sum("n").over(by.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(by))
    asked = upto.withColumn("share", F.explode(F.array(*(F.lit(float(s)) for s in shares))))
    rank = F.floor(F.col("share") * (F.col("all") - 1))
    hit = asked.filter((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank))
    return hit.select(*keys, "share", (F.col("sign") * 2 * F.pow(F.lit(_GAMMA), F.col("bucket")) / (1 + _GAMMA)).alias("estimate"))


# --- sets ------------------------------------------------------------------------------------


def set_sample(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """(keys, h): the least ``SAMPLE`` distinct hashes of the non-null values."""
    return merge_samples(rows.select(*keys, hash60(value).alias("h")).filter("h IS NOT NULL"), keys)


def merge_samples(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranks are cut in every task before the shuffle, so a large group isn't gathered."""
    w = Window.partitionBy(*keys).orderBy("h")
    return samples.select(*keys, "h").distinct().withColumn("r", F.row_number().over(w)).filter(F.col("r") <= SAMPLE).drop("r")


def set_sizes(samples: DataFrame, left: Column, right: Column) -> DataFrame:
    """One row: estimated sizes of the union, the intersection and what only the left has, of two sets of a merged table.

    ``left`` and ``right`` are conditions that pick a set's rows.
    """
    both = samples.groupBy("h").agg(F.max(left).alias("a"), F.max(right).alias("b")).filter("a OR b")
    low = both.orderBy("h").limit(SAMPLE)
    sums = low.agg(F.count("*").alias("k"), F.max("h").alias("top"), F.count(F.when(F.col("a") & F.col("b"), 1)).alias("common"), F.count(F.when(F.col("a") & ~F.col("b"), 1)).alias("only"))
    total = F.when(F.col("k") < SAMPLE, F.col("k").cast("double")).otherwise((SAMPLE - 1) / ((F.col("top") + 1) / F.lit(float(2**HASH_BITS))))
    return sums.select(total.alias("n_union"), (total * F.col("common") / F.greatest("k", F.lit(1))).alias("n_common"), (total * F.col("only") / F.greatest("k", F.lit(1))).alias("n_left_only"))
