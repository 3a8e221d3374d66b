"""Structured Streaming twins: windowed counts with late data, idle sessions, keyed rate limits, latest state.

Event time is watermarked by ten minutes; later rows are dropped from closed windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship_package

WATERMARK = "10 minutes"


def read(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream over the Parquet files of a path, with ``ts`` as an event time."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a pattern may match one file; a plain path must be a folder
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(rows: DataFrame, size: str, slide: str | None, *keys: str) -> DataFrame:
    """Counts and totals by window and keys; tumbling without a slide."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.withWatermark("ts", WATERMARK).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def idle_sessions(rows: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    return rows.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def token_bucket(rows: DataFrame, key: str, capacity: float, per_second: float) -> DataFrame:
    """Admitted and refused rows of each key and batch; the bucket is state, dropped once event time has filled it up again."""
    ship_package(rows.sparkSession)
    full_ms, seconds = int(1000 * capacity / per_second) + 1, 1 / per_second

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, at = state.get if state.exists else (capacity, None)
        admitted = refused = 0
        # a key's rows may come in several frames, whose times overlap
        for now in np.sort(np.concatenate([frame["at"].to_numpy() for frame in frames])).tolist():
            tokens = min(capacity, tokens + (now - at) / seconds) if at is not None else capacity
            at = now
            if tokens >= 1:
                tokens, admitted = tokens - 1, admitted + 1
            else:
                refused += 1
        state.update((tokens, at))
        state.setTimeoutTimestamp(max(int(at * 1000), state.getCurrentWatermarkMs()) + full_ms)
        yield pd.DataFrame({key: [k[0]], "admitted": [admitted], "refused": [refused]})

    timed = rows.withWatermark("ts", WATERMARK).select(key, "ts", (F.unix_micros("ts") / 1e6).alias("at"))
    kind = rows.schema[key].dataType.simpleString()
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, admitted long, refused long", "tokens double, at double", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, folder: str, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and reads back what it wrote; the folder holds its checkpoint too."""
    path, spark = f"{folder}/{name}", stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
