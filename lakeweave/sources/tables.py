"""Scans: Parquet tables by name, files by pattern, and the checks that a table's contract asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes a file scan accepts.
ALLOWED_SUFFIXES = ("md", "markdown", "txt", "json", "yaml", "yml", "csv", "xml", "html", "htm", "pdf", "docx", "doc", "rtf", "odt")
#: Leading bytes (hex) of known file types.
MAGIC_BYTES = {"25504446": "application/pdf", "504B0304": "application/zip", "D0CF11E0": "application/msword"}
#: Media types by suffix.
MEDIA_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "html": "text/html",
    "htm": "text/html",
    "md": "text/markdown",
    "txt": "text/plain",
    "csv": "text/csv",
    "json": "application/json",
    "xml": "application/xml",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suffix(path: Column) -> Column:
    """Lower-case file suffix without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def is_inside(path: Column, base: str) -> Column:
    """True if a path lies under ``base`` and doesn't climb out of it."""
    return path.startswith(base.rstrip("/") + "/") & ~path.rlike(r"(^|/)\.\.(/|$)")


def scan_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, name, suffix, size, modified and content of the files that match a glob and have an allowed suffix."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime", "content")
    return named.withColumn("suffix", suffix(F.col("name"))).where(F.col("suffix").isin(*ALLOWED_SUFFIXES))


def media_type(name: Column, content: Column) -> Column:
    """By suffix, else by the leading bytes, else plain bytes."""
    by_suffix = F.create_map(*(F.lit(x) for pair in MEDIA_TYPES.items() for x in pair))
    by_magic = F.create_map(*(F.lit(x) for pair in MAGIC_BYTES.items() for x in pair))
    return F.coalesce(F.try_element_at(by_suffix, suffix(name)), F.try_element_at(by_magic, F.hex(F.substring(content, 1, 4))), F.lit("application/octet-stream"))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where valid (a leading byte-order mark dropped), else Latin-1."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "^﻿", "")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand on more than one row, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` itself; raises if a key repeats."""
    worst = duplicates(df, *keys).limit(1).collect()
    if worst:
        raise ValueError(f"{keys} isn't unique: {worst[0].asDict()}")
    return df


def merge(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert as a projection: incoming rows replace current ones of equal key; incoming must be unique by key."""
    return current.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)
