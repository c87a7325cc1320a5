"""Row numbers over a whole table, without gathering it in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import saved

_BITS = 33  # a row's place inside its partition, as ``monotonically_increasing_id`` has it


def number_rows(df: DataFrame, order: Sequence[str | Column], group: str | None = None, keep: Callable[[DataFrame], DataFrame] = saved, pos: str = "pos", count: str = "n") -> DataFrame:
    """``df`` with ``pos`` (0, 1, ... by ``order``) and ``count``, the number of rows; inside each value of ``group`` if one is named.

    Rows are dealt by ranges of (group, order, place in the source), so that neither a large group nor a
    value that many rows share makes a large task.  Each task numbers its own
    rows; a row for each range and group says how many come before.  ``keep`` writes a table and reads it back.

    Nulls come first and a null group is a group; rows that are equal in ``order`` are numbered as the source lists
    them; an empty table stays empty.  ``df`` should be a written table or a plain scan, as it is read twice (once for a sample of the keys).
    """
    names = {c.lower() for c in df.columns}
    assert not names & {pos.lower(), count.lower(), "_seq", "_at", "_part", "_grp"}, "a column has the name of one that is added"
    rows = df.withColumn("_seq", F.monotonically_increasing_id()).withColumn("_grp", F.col(group) if group else F.lit(0))
    keys = [F.col(k).asc_nulls_first() if isinstance(k, str) else k for k in (["_grp"] if group else []) + [*order, "_seq"]]
    laid = keep(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_seq").withColumn("_at", F.monotonically_increasing_id()))
    laid = laid.withColumn("_part", F.shiftright("_at", _BITS))
    parts = laid.groupBy("_grp", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    every = Window.partitionBy("_grp")
    before = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = keep(parts.select("_grp", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(every).alias("_total")))
    on = F.col("l._grp").eqNullSafe(F.col("r._grp")) & (F.col("l._part") == F.col("r._part"))
    both = laid.alias("l").join(parts.alias("r"), on)
    return both.select(*(F.col(f"l.{_quoted(c)}") for c in df.columns), (F.col("l._at") + F.col("r._shift")).alias(pos), F.col("r._total").alias(count))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def zip_rows(left: DataFrame, right: DataFrame, left_order: Sequence[str | Column] = (), right_order: Sequence[str | Column] = (), keep: Callable[[DataFrame], DataFrame] = saved) -> DataFrame:
    """Row i of ``left`` beside row i of ``right``, with ``pos``; a ``ValueError`` if their lengths differ.

    Without an order a table counts as its files list it (file by file in the order of Spark's splits).
    Both are numbered by ranges and joined on the number, which spreads evenly however the two are
    partitioned.  A column name may be in one of them only.
    """
    assert not {c.lower() for c in left.columns} & {c.lower() for c in right.columns}, "both tables have a column of one name"
    a, b = (keep(number_rows(t, o, keep=keep, count="n_rows")) for t, o in ((left, left_order), (right, right_order)))
    n, m = (t.agg(F.coalesce(F.max("n_rows"), F.lit(0)).alias("n")).first()["n"] for t in (a, b))
    if n != m:
        raise ValueError(f"{n} rows on the left and {m} on the right")
    return a.drop("n_rows").join(b.drop("n_rows"), "pos")
