"""Session settings and the shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run.

    The sources go through Spark's own file server, once for an application.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="quarryline-src-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for tables between steps (``spark.checkpoint.dir``).

    A session that runs in one process (a ``local`` master) may leave it unset and gets a temporary
    folder; on a cluster the executors don't share such a folder, so there it is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        held = sc._jsc.sc().getCheckpointDir()
        folder = held.get() if not held.isEmpty() else None
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if sc.applicationId not in _OWN:
            _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="quarryline-")
        folder = _OWN[sc.applicationId]
    return folder.rstrip("/")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that Spark knows; none there is fine."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back; the table goes when the application's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quarryline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_exit(spark, path)
    return spark.read.parquet(path)


def release(df: DataFrame) -> None:
    """Remove the folder of a table from ``saved`` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.rsplit("/", 1)[1].startswith("quarryline-"):
            drop_folder(df.sparkSession, path)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark remove a query's shuffle files when its action ends, not when the driver happens to collect garbage; it stays set."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def iterate(df: DataFrame) -> Iterator[Row]:
    """Rows of ``df`` one by one, so that the driver never holds them all.

    A plan with an exchange is written to the shared folder first: where Spark removes the shuffle files of a query when
    its action ends, ``toLocalIterator`` counts as ended as soon as it begins to return rows, and what it still has to read is gone.
    """
    spark = df.sparkSession
    if "Exchange" not in df._jdf.queryExecution().executedPlan().toString():
        yield from df.toLocalIterator()
        return
    path = f"{shared_folder(spark)}/quarryline-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield from spark.read.parquet(path).toLocalIterator()
    finally:
        drop_folder(spark, path)


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "quarryline") -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
