"""Helpers that the operators share: tables, Arrow stages, the shared folder, joins on frequent keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.session import drop_folder, shared_folder, ship

#: Rows and bytes of an Arrow batch: bound what a Python worker holds at once.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
#: A key is frequent if it has more than one of so many rows; so there are fewer frequent keys than this.
FREQUENT = 1000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the test data; with ``columns`` only these."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def tune(spark: SparkSession) -> None:
    """Session settings that the operators need, documented in the README; they stay set, as results are evaluated later.

    They bound the Arrow batches (values that are lower already stay) and drop each query's
    shuffle files when it has ended.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(name)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    tune(df.sparkSession)
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def own_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    held = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in held:
        name += "_"
    return name


def q(name: str) -> str:
    """A column name as Spark SQL reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def ddl(df: DataFrame, *more: str) -> str:
    """Schema of ``df`` and further fields, as DDL."""
    return ", ".join([*(f"{q(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields), *more])


def beside(df: DataFrame, source: str, cast: str = "string") -> tuple[DataFrame, str]:
    """Columns c0, c1, ... of ``df`` and behind them ``source``; and the DDL of the former.

    Arrow stages get columns by such names, so that no name of the caller's can clash or needs quoting.
    """
    base = df.select(*(F.col(q(c)).alias(f"c{i}") for i, c in enumerate(df.columns)), F.col(q(source)).cast(cast).alias("source"))
    return base, ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields))


def add_column(df: DataFrame, name: str, kind: str, source: str, fn: Callable[[pa.Array], pa.Array], cast: str = "string") -> DataFrame:
    """``df`` with ``fn`` of the column ``source`` as its last column ``name``; a column of that name is replaced."""
    base, fields = beside(df, source, cast)
    names = [c for c in df.columns if c.lower() != name.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fn(b.column(b.num_columns - 1))], names=[*b.schema.names[:-1], "made"])

    out = map_arrow(base, run, f"{fields}, made {kind}" if fields else f"made {kind}")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns) if c in names), F.col("made").alias(name))


def shared_table(df: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back; a ``scratch`` removes it in the end."""
    spark = df.sparkSession
    path = f"{scratch.path if scratch else shared_folder(spark)}/quarryline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


class Scratch:
    """Tables that an operator needs on its way: a folder of the shared one, removed when the block ends.

    What the operator returns must not read them any more, so it is a ``shared_table`` of its own.
    What a driver iterates over (``toLocalIterator``) is such a table too: the shuffle files that a plan would
    still need may go as soon as its action has begun to return rows.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, f"{shared_folder(spark)}/quarryline-{uuid.uuid4().hex}"

    def table(self, df: DataFrame) -> DataFrame:
        return shared_table(df, self)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def drop(self) -> None:
        drop_folder(self.spark, self.path)


def spread_join(rows: DataFrame, small: DataFrame, key: str, how: str = "inner", by: str | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to ``small``, which has a key once; the rows of a frequent key are dealt to many tasks.

    A key is frequent if it has more than one ``FREQUENT``-th of the rows; keys are counted by aggregation, which
    combines before the shuffle, and the list of frequent ones is broadcast: it has fewer than ``FREQUENT`` entries
    whatever the size of ``rows``.  Their rows get a salt (by the hash of ``by``, or of
    all columns), and their row of ``small`` is repeated for each salt.  ``rows`` is a written table, as it is counted first,
    unless ``sizes`` (key, n), a written table, has the counts.
    """
    total = rows.count() if sizes is None else sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    each = max(64, total // FREQUENT)
    salt, ways = (own_name(rows, own_name(small, x)) for x in ("salt", "ways"))
    counted = rows.groupBy(key).agg(F.count("*").alias(ways)) if sizes is None else sizes.select(key, F.col("n").alias(ways))
    hot = F.broadcast(counted.filter(F.col(ways) > each).select(key, F.least(F.ceil(F.col(ways) / each), F.lit(FREQUENT)).cast("int").alias(ways)))
    spread = F.pmod(F.xxhash64(*([by] if by else [F.col(q(c)) for c in rows.columns])), F.coalesce(F.col(ways), F.lit(1))).cast("int")
    left = rows.join(hot, key, "left").withColumn(salt, spread).drop(ways)
    right = small.join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(ways), F.lit(1)) - 1))).drop(ways)
    return left.join(right, [key, salt], how).drop(salt)
