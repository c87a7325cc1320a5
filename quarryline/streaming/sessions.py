"""Sessions of a keyed event stream, with late rows and state that ends by itself: Spark's session windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.session import drop_at_exit, shared_folder

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merge_sessions(held: list[tuple], rows: list[tuple[int, float]], gap: int) -> list[tuple]:
    """Open sessions (start, end, n, total) after further events (time, value): what lies within ``gap`` is one session.

    An event may join two sessions that were apart until it came.
    """
    out: list[list] = []
    for start, end, n, total in sorted(held + [(t, t, 1, v) for t, v in rows]):
        if out and start - out[-1][1] <= gap:
            last = out[-1]
            last[1], last[2], last[3] = max(last[1], end), last[2] + n, last[3] + total
        else:
            out.append([start, end, n, total])
    return [tuple(x) for x in out]


def sessions(events: DataFrame, key: str, ts: str, value: str, gap_seconds: int, late: str) -> DataFrame:
    """A row for each session that is over: key, session_start, session_end, n, total of ``value``; append mode.

    A stream's events that lie at most ``gap_seconds`` apart are one session (``merge_sessions`` says the same in plain code).  Rows may come up to ``late`` behind the
    latest time seen and still join or bridge sessions; later ones are dropped once the watermark has passed them by the gap.  A session comes out
    once the watermark has passed its end by the gap, and its state is gone then.  State is a row for each open session.

    Null keys are a key of their own; null times are dropped; a null value counts as nothing in ``total``.
    """
    rows = events.filter(F.col(ts).isNotNull()).select(key, F.col(ts).cast("timestamp").alias(ts), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value_")).withWatermark(ts, late)
    found = rows.groupBy(F.session_window(ts, f"{gap_seconds} seconds").alias("session_"), key)
    return found.agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("n"), F.sum("value_").alias("total")).drop("session_")


def run_sessions(spark: SparkSession, path: str, schema: T.StructType, out: str, checkpoint: str, key: str, ts: str, value: str, gap_seconds: int, late: str, files: int | None = 1) -> None:
    """Sessions of the Parquet files under ``path``, ``files`` of them a batch (None: all that are new), appended to ``out``; goes on from ``checkpoint`` when called again."""
    old = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        source = spark.readStream.schema(schema)
        events = (source.option("maxFilesPerTrigger", str(files)) if files else source).parquet(path)
        stream = sessions(events, key, ts, value, gap_seconds, late)
        stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, old)


def sessions_in_two_runs(spark: SparkSession, events: DataFrame, key: str, ts: str, value: str, gap_seconds: int, late: str) -> DataFrame:
    """Sessions of a table that arrives in parts, a restart in between: all sessions that are over by the end.

    Even ids come first, odd ones in a second run from the checkpoint, so that most rows of the second run are
    late ones which bridge sessions of the first.  A last row with a null key, far ahead, moves the watermark past all sessions.
    """
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = events.select("event_id", key, ts, value)
    ahead = rows.agg(F.max(ts).alias(ts)).select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast(rows.schema[key].dataType).alias(key), (F.col(ts) + F.expr("INTERVAL 3650 DAYS")).alias(ts), F.lit(0.0).alias(value))
    for part in (rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), ahead):
        part.write.mode("append").parquet(f"{base}/in")
        drop_at_exit(spark, base)
        run_sessions(spark, f"{base}/in", rows.schema, f"{base}/out", f"{base}/state", key, ts, value, gap_seconds, late, files=None)
    return spark.read.parquet(f"{base}/out")
