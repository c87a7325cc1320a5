"""A relational store as source and sink, by Spark's JDBC connector."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

REQUIRED = ("DB_HOST", "DB_PORT", "DB_NAME", "DB_USER", "DB_PASSWORD")


@dataclass(frozen=True)
class Store:
    url: str
    user: str
    password: str

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, kind: str = "postgresql") -> Store:
        """Settings from the environment; names all that are missing."""
        missing = [k for k in REQUIRED if not env.get(k)]
        if missing:
            raise ValueError(f"missing settings: {', '.join(missing)}")
        host, port, name, user, password = (env[k] for k in REQUIRED)
        return cls(f"jdbc:{kind}://{host}:{port}/{name}", user, password)

    def options(self, table: str, batch: int = 500) -> dict[str, str]:
        return {"url": self.url, "user": self.user, "password": self.password, "dbtable": table, "batchsize": str(batch)}


def read(spark: SparkSession, store: Store, table: str) -> DataFrame:
    return spark.read.format("jdbc").options(**store.options(table)).load()


def append(df: DataFrame, store: Store, table: str, batch: int = 500) -> None:
    """Insert in batches; each task commits its own rows."""
    df.write.format("jdbc").options(**store.options(table, batch)).mode("append").save()
