"""Batches that write several tables at once, each row once however often a batch is tried.

An attempt writes every table's rows under the batch's number and a name of its own, and at last one small commit file that
names the attempt, put in place by a rename that fails where it is already there. Readers take the rows of named attempts
alone: a batch killed between two tables shows nothing, one tried again shows once, and of two attempts at one time one wins.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BatchStore:
    """Tables of one folder that change together; any file system of Spark whose rename is atomic."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self, batch: int) -> bool:
        path, store = self._path(f"_commits/{batch}.json")
        return store.exists(path)

    def write(self, batch: int, tables: dict[str, DataFrame]) -> bool:
        """Writes the batch; False, and nothing is written, if it is there already."""
        if self.committed(batch):
            return False
        attempt = uuid.uuid4().hex
        for name, rows in tables.items():
            rows.write.parquet(f"{self.folder}/{name}/batch={batch}/attempt={attempt}")
        draft, store = self._path(f"_drafts/{attempt}.json")
        final, _ = self._path(f"_commits/{batch}.json")
        store.mkdirs(draft.getParent())
        store.mkdirs(final.getParent())
        out = store.create(draft, True)
        out.write(bytearray(json.dumps({"batch": batch, "attempt": attempt, "tables": sorted(tables)}).encode()))
        out.close()
        if store.exists(final):  # some stores' rename replaces
            return False
        return bool(store.rename(draft, final))

    def commits(self) -> DataFrame:
        """batch, attempt and tables of every committed batch."""
        path, store = self._path("_commits")
        schema = "batch long, attempt string, tables array<string>"
        return self.spark.read.schema(schema).json(path.toString()) if store.exists(path) else self.spark.createDataFrame([], schema)

    def read(self, name: str, schema: str) -> DataFrame:
        """A table's rows (``schema``) with their batch; rows of attempts that weren't committed aren't read."""
        path, store = self._path(name)
        if not store.exists(path):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        rows = self.spark.read.schema(f"{schema}, batch long, attempt string").parquet(path.toString())
        mine = self.commits().where(F.array_contains("tables", name)).select("batch", "attempt")
        return rows.join(F.broadcast(mine), ["batch", "attempt"], "left_semi").drop("attempt")  # a row of two words for each batch
