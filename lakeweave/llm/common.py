"""What the corpus operators share: where tables are written between jobs, and how whole texts reach Python."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package

#: Code points that part words: the six ASCII white-space characters.
SPACES = " \t\n\x0b\f\r"
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``. Where that is unset a temporary one, in local mode alone: on a
    cluster its tables would be spread over the executors' own disks, so that raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lakeweave-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, and later jobs don't redo the work."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``written``, with the folder, for ``discarded``."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discarded(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores after it until no column has it (whatever the case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Readies a session for Python over texts: the code is on the executors, and Arrow batches are held to ``size``
    bytes, so that very long texts can't fill a worker's memory."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def crc_remainder(column, n: int):
    """crc32 of the id written as text, modulo ``n``: the folds of the labelled queries."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)


#: Ids up to this number (about 16 MB) are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't among ``ids`` (doc_id); rows without an id stay."""
    gone = written(ids.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["_gone"], "left_anti")


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving memory back when its task ends: Spark keeps Python workers, idle ones too, beside the JVM."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            hashing = sys.modules.get(f"{__package__}.kneser_ney")
            if hashing:
                hashing.forget()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except OSError:  # another C library
                pass

    return task
