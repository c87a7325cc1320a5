"""Joins over time: overlapping intervals, and the latest earlier row (as-of)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.session import saved, ship

#: Children of a node, and levels over the finest bins, of the tree that intervals are cut by.
FAN, LEVELS = 8, 16
#: A node with more than one of so many points, or of the pairs to compare, is hot, so there are fewer hot nodes than twice this.
HOT = 1000
#: Pairs that a task of the join compares, about, and most tasks of it.
PAIRS, TASKS = 1 << 23, 4096


def ticks(at: Column, kind: T.DataType) -> Column:
    """Micro-seconds of a time, the number itself of an integer; the order is kept."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(at)
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        day = F.unix_date(at.cast("date")).cast("long") * 86_400_000_000
        if isinstance(kind, T.DateType):
            return day
        second = F.date_part(F.lit("SECOND"), at)
        return day + F.hour(at).cast("long") * 3_600_000_000 + F.minute(at).cast("long") * 60_000_000 + (second * 1_000_000).cast("long")
    if isinstance(kind, T.IntegralType):
        return at.cast("long")
    raise TypeError(f"intervals are of times, dates or integers, not {kind.simpleString()}")


def _pieces(spans: DataFrame) -> DataFrame:
    """``spans`` with a row for each node (level, node) of the tree that makes up its bins ``first`` to ``last``: at each level what whole parents leave over.

    Every bin in between lies in exactly one of them, and there are at most 2 x (FAN - 1) at a level.  A span has rows
    only for levels whose nodes aren't wider than itself, so that most take one or two; each is whole-number arithmetic.
    """
    length = F.col("last") - F.col("first") + 1
    top = sum((F.when(length >= FAN**level, 1).otherwise(0) for level in range(1, LEVELS)), F.lit(0))
    each = spans.withColumn("level", F.explode(F.sequence(F.lit(0), top)))
    shift = lambda level: (level * (FAN.bit_length() - 1)).cast("int")

    def bounds(level: Column) -> tuple[Column, Column]:
        """First node that begins inside, and the one behind the last that ends inside."""
        down = lambda c: F.call_function("shiftright", c, shift(level))
        return -down(-F.col("first")), down(F.col("last") + 1)

    (lo, hi), (up_lo, up_hi) = bounds(F.col("level")), bounds(F.col("level") + 1)
    each = each.withColumns({"lo": lo, "hi": hi, "up_lo": up_lo, "up_hi": up_hi}).filter("lo < hi")
    inner = (F.col("up_lo") < F.col("up_hi")) & (F.col("level") < LEVELS - 1)
    run = lambda a, b: F.when(a < b, F.sequence(a, F.greatest(b - 1, a))).otherwise(F.array().cast("array<long>"))
    nodes = F.when(inner, F.concat(run(F.col("lo"), F.col("up_lo") * FAN), run(F.col("up_hi") * FAN, F.col("hi")))).otherwise(run(F.col("lo"), F.col("hi")))
    return each.select(*spans.columns, "level", F.explode(nodes).alias("node"))


def _contained(points: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of points (row, bin, keys) and spans (row, first, last, keys) whose bin lies in the span: (point, span).

    A point meets a span in one node only, so a pair comes out once.  Points of a hot node are dealt
    by a salt, which the node's spans repeat.  There are as many tasks as the pairs need.
    """
    levels = saved(_pieces(spans.select(F.struct("*").alias("span"), "first", "last", *keys)).drop("first", "last"))
    used = sorted(r["level"] for r in levels.select("level").distinct().collect())  # at most LEVELS rows
    if not used:
        return points.sparkSession.createDataFrame([], T.StructType([*points.select(F.struct("*").alias("point")).schema, *levels.select("span").schema]))
    own = F.array(*(F.struct(F.lit(x).alias("level"), F.floor(F.col("bin") / F.lit(FAN**x)).cast("long").alias("node")) for x in used))
    at = points.select(F.struct("*").alias("point"), *keys, F.inline(own))
    spans = levels
    on = ["level", "node", *keys]
    # points and spans of each node: a join's work is its pairs, which Spark can't tell from the bytes it shuffles
    sizes = saved(at.groupBy(*on).agg(F.count("*").alias("n")).join(spans.groupBy(*on).agg(F.count("*").cast("double").alias("m")), on))
    n, pairs = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0.0))).first()
    each, share = max(64, n // HOT), max(1 << 16, pairs / HOT)
    split = F.greatest(F.ceil(F.col("n") / each), F.least(F.ceil(F.col("n") * F.col("m") / share), F.col("n")))
    hot = F.broadcast(sizes.select(*on, F.least(split, F.lit(HOT)).cast("int").alias("ways")).filter("ways > 1"))
    tasks = min(max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs // PAIRS)), TASKS)
    ways = F.coalesce("ways", F.lit(1))
    at = at.join(hot, on, "left").withColumn("salt", F.pmod(F.xxhash64("point"), ways).cast("int")).drop("ways")
    spans = spans.join(hot, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), ways - 1))).drop("ways")
    at, spans = (t.repartition(tasks, *on, "salt") for t in (at, spans))
    return at.join(spans, [*on, "salt"]).select("point", "span")


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], on: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Pairs of rows whose closed intervals share a moment, and whose ``on`` columns are equal; all columns of both.

    Of two intervals that overlap, the one that begins later begins inside the other (on a tie: the left one).
    So there are two joins of points with intervals.  An interval is cut to nodes of a tree of bins, a
    few for each level whatever its length, and a point has one node a level; both meet by
    equality, so that no task compares a time with all others.  ``width`` is that of the finest bins, in micro-seconds or units;
    by default the median length of the intervals.

    Null ends or keys match nothing, as do intervals that end before they begin.  Repeated rows give repeated pairs.  Names
    other than those of ``on`` may be in one table only.
    """
    shared = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    assert shared == {c.lower() for c in on}, "a column name is in both tables"

    def sided(df: DataFrame, span: tuple[str, str]) -> DataFrame:
        start, end = (ticks(F.col(c), df.schema[c].dataType) for c in span)
        rows = df.select(F.struct(*df.columns).alias("row"), start.alias("start"), end.alias("end"), *(F.col(c).alias(f"key{i}") for i, c in enumerate(on)))
        return saved(rows.filter("start <= end").dropna(subset=[f"key{i}" for i in range(len(on))] or None))

    a, b = sided(left, left_span), sided(right, right_span)
    if width is None:
        width = a.select("start", "end").union(b.select("start", "end")).agg(F.percentile_approx(F.col("end") - F.col("start"), 0.5)).first()[0]
    width = F.lit(max(int(width or 0), 1))
    keys = [f"key{i}" for i in range(len(on))]

    def binned(at: str) -> Column:
        return F.floor(F.col(at) / width).cast("long")

    def half(points: DataFrame, spans: DataFrame, strict: bool) -> DataFrame:
        p = points.select("row", "start", *keys, binned("start").alias("bin"))
        s = spans.select("row", "start", "end", *keys, binned("start").alias("first"), binned("end").alias("last"))
        later = F.col("point.start") > F.col("span.start") if strict else F.col("point.start") >= F.col("span.start")
        return _contained(p, s, keys).filter(later & (F.col("point.start") <= F.col("span.end")))

    pairs = half(a, b, False).select(F.col("point.row").alias("l"), F.col("span.row").alias("r"))
    pairs = pairs.unionAll(half(b, a, True).select(F.col("span.row").alias("l"), F.col("point.row").alias("r")))
    return pairs.select("l.*", *(F.col(f"r.{c}") for c in right.columns if c.lower() not in shared))


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[tuple[str, str]] = (), exact: bool = True, order: Sequence[str] = (), keep: Callable[[DataFrame], DataFrame] = saved) -> DataFrame:
    """Every row of ``left`` with the columns of the latest row of ``right`` that isn't later, nulls where there is none.

    ``by`` names pairs of columns that must be equal.  ``exact`` says whether a row of the same time counts.
    Of several right rows of one time the last by ``order`` is taken.

    Both tables are dealt by ranges of (key, time), so that the rows of one key, or of one time, fill as many tasks
    as they need.  A task carries its last right row along; a second pass over one row a task
    says what each task's first key inherits from the tasks before it.  Keys are told apart by 64-bit hashes of neighbours.

    Null keys and times match nothing, left rows with them stay.  An empty side is fine.  Column names may be in one table only.
    """
    assert not {c.lower() for c in left.columns} & {c.lower() for c in right.columns}, "a column name is in both tables"
    spark = left.sparkSession
    ship(spark)
    right_type = T.StructType([T.StructField(f.name, f.dataType, True) for f in right.schema.fields])
    blank = F.lit(None).cast(right_type)
    key_l = F.struct(*(F.col(a).alias(f"k{i}") for i, (a, _) in enumerate(by)), F.lit(0).alias("k"))
    key_r = F.struct(*(F.col(b).alias(f"k{i}") for i, (_, b) in enumerate(by)), F.lit(0).alias("k"))
    known_l = F.lit(True)
    for c in [left_on, *(a for a, _ in by)]:
        known_l = known_l & F.col(c).isNotNull()
    ranks = F.struct(*(F.col(c) for c in order), F.lit(0).alias("z"))
    no_rank = F.lit(None).cast(right.select(ranks.alias("x")).schema["x"].dataType)
    # at one time: right rows before the left ones if they count, else behind them
    mine, theirs = (1, 0) if exact else (0, 1)
    a = left.filter(known_l).select(key_l.alias("key"), F.col(left_on).alias("time"), F.lit(mine).alias("side"), no_rank.alias("by_order"), F.struct(*left.columns).alias("l"), blank.alias("r"))
    known_r = F.lit(True)
    for c in [right_on, *(b for _, b in by)]:
        known_r = known_r & F.col(c).isNotNull()
    b = right.filter(known_r).select(key_r.alias("key"), F.col(right_on).alias("time"), F.lit(theirs).alias("side"), ranks.alias("by_order"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("l"), F.struct(*right.columns).cast(right_type).alias("r"))
    rows = a.unionByName(b).withColumn("seq", F.monotonically_increasing_id())
    keys = ["key", "time", "side", "by_order", "seq"]
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.xxhash64("key").alias("key_hash"), F.col("side") == mine, "l", "r").toDF("key_hash", "is_left", "l", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, key, last, last_key = TaskContext.get().partitionId(), None, None, None, None
        names = ["part", "open", "first", "last_key", "l", "r"]
        for b in batches:
            if not b.num_rows:
                continue
            hashes, is_left = b.column("key_hash").to_pylist(), b.column("is_left").to_pylist()
            first = hashes[0] if first is None else first
            left_at, source, opened, latest = [], [], [], None if last is None else 0  # 0: the row carried along; i + 1: row i
            for i, (h, mine) in enumerate(zip(hashes, is_left, strict=True)):
                if mine:
                    known = last_key == h and latest is not None
                    left_at.append(i)
                    source.append(latest if known else None)
                    opened.append(not known and h == first)
                else:
                    last_key, latest = h, i + 1
            theirs = pa.concat_arrays([last if last is not None else pa.nulls(1, b.column("r").type), b.column("r")])
            if left_at:
                n = len(left_at)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(opened), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), b.column("l").take(pa.array(left_at)), theirs.take(pa.array(source, pa.int64()))], names=names)
            if latest:
                last = theirs.take(pa.array([latest]))
            kind = b.schema
        if first is not None:
            tail = last if last is not None else pa.nulls(1, kind.field("r").type)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([None], pa.bool_()), pa.array([first]), pa.array([last_key], pa.int64()), pa.nulls(1, kind.field("l").type), tail], names=names)

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("open", T.BooleanType()), T.StructField("first", T.LongType()), T.StructField("last_key", T.LongType()), T.StructField("l", laid.schema["l"].dataType), T.StructField("r", right_type)])
    done = keep(laid.mapInArrow(run, schema))
    # a row for each task: what its first key inherits
    tasks = done.filter("open IS NULL").select("part", "first", "last_key", F.struct("last_key", "r").alias("tail"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    handed = tasks.withColumn("from", F.last(F.when(F.col("last_key").isNotNull(), F.col("tail")), ignorenulls=True).over(earlier))
    handed = handed.filter(F.col("from.last_key") == F.col("first")).select("part", F.lit(True).alias("open"), F.col("from.r").alias("handed"))
    rows = done.filter("open IS NOT NULL").join(F.broadcast(handed), ["part", "open"], "left").select("l", F.coalesce("r", "handed").alias("r"))
    out = rows.select("l.*", *(F.col(f"r.{c}") for c in right.columns))
    rest = left.filter(~F.coalesce(known_l, F.lit(False)))
    return out.unionByName(rest.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields)))
