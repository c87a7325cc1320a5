"""Incremental runs: delta ingest and demand counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.session import shared_folder


#: Folders of the target that keys are dealt to by hash.
KEY_FOLDERS = 256


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Files of a Parquet table as a stream; the schema comes from the table if none is given."""
    anywhere = f"{path[:-1]}[{path[-1]}]"  # a pattern may name a single file, a plain path only a folder
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).parquet(anywhere)


def delta_ingest(source: DataFrame, target: str, checkpoint: str, key: str) -> None:
    """Append the rows of new files whose key is not in ``target``; run again after more files came.

    The checkpoint remembers files, the anti join makes a repeated batch and
    a key that comes in a second file harmless.  The target is partitioned by the hash of the key (column ``key_folder``),
    and a batch reads the keys of its own folders only.  Of rows that repeat a key in one batch one stays.
    """
    spark = source.sparkSession
    from quarryline.sources.files import exists

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key]).withColumn("key_folder", F.pmod(F.xxhash64(key), F.lit(KEY_FOLDERS)).cast("int"))
        if exists(spark, target):
            own = [r[0] for r in fresh.select("key_folder").distinct().collect()]  # KEY_FOLDERS numbers at most
            fresh = fresh.join(spark.read.parquet(target).filter(F.col("key_folder").isin(own)).select(key), key, "left_anti")
        fresh.repartition("key_folder").write.mode("append").partitionBy("key_folder").parquet(target)

    source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def demand_counts(events: DataFrame, ts: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by window and key, with a watermark that bounds the state."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")


def run_to_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and read the last result."""
    spark = stream.sparkSession
    folder = _folder(spark)
    keep = lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")
    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def ingest_twice(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Delta ingest of a table, run two times over the same files: the second adds nothing."""
    folder = _folder(spark)
    for _ in range(2):
        delta_ingest(file_stream(spark, path), f"{folder}/out", f"{folder}/state", key)
    return spark.read.parquet(f"{folder}/out").drop("key_folder")
