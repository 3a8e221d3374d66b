"""Tables written between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``. Where that is unset a temporary one, in local mode alone: on a
    cluster its tables would be spread over the executors' own disks, so that raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lakeweave-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """``df`` written once to the shared folder (a folder for each value of ``by``) and read back: cuts the lineage, and
    later jobs don't redo the work."""
    path = shared_dir(df.sparkSession, name)
    writer = df.write.options(compression="zstd", **options)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
