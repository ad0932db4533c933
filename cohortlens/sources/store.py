"""Committed batches of Parquet tables under one folder.

A batch writes its tables under ``<root>/<table>/batch=<name>`` and then one commit record.  Only
committed batches are read, so a batch that died half-way has no effect and is written again under
the same name.  A name that is committed already is not written twice.  One writer at a time.

The folder is any path that Spark writes to; on a cluster driver and executors must share it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RECORD = "n bigint, batch string, weeks array<string>"


@dataclass(frozen=True)
class Commit:
    n: int
    batch: str
    weeks: tuple[str, ...]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def commits(self) -> list[Commit]:
        """All commits, oldest first (one small record a batch)."""
        if not self._exists(f"{self.root}/commits"):
            return []
        rows = self.spark.read.schema(RECORD).json(f"{self.root}/commits/*").where("n is not null").collect()
        return sorted((Commit(r["n"], r["batch"], tuple(r["weeks"] or ())) for r in rows), key=lambda c: c.n)

    def has(self, batch: str) -> bool:
        return any(c.batch == batch for c in self.commits())

    def write(self, table: str, batch: str, df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """Write a table of a batch (again, if it was not committed) and read it back."""
        path = f"{self.root}/{table}/batch={batch}"
        # a folder's rows come together, those of a large one in several files of about the advisory size
        rows = df.hint("rebalance", *by) if by else df
        rows.write.mode("overwrite").partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def commit(self, batch: str, weeks=()) -> Commit:
        n = max((c.n for c in self.commits()), default=0) + 1
        record = self.spark.createDataFrame([(n, batch, [str(w) for w in weeks])], RECORD)
        record.coalesce(1).write.json(f"{self.root}/commits/{n:08d}-{uuid.uuid4().hex}")
        return Commit(n, batch, tuple(str(w) for w in weeks))

    def read(self, table: str, schema: T.StructType, batches: list[str]) -> DataFrame:
        """Rows of the named batches, with their ``batch``."""
        schema = T.StructType([*schema.fields, T.StructField("batch", T.StringType())])
        paths = [f"{self.root}/{table}/batch={b}" for b in batches]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths)
