"""Files into documents, chunks and vectors: upload checks, file requests, conversion, chunking, idempotent storing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector
from ..sources.tables import ALLOWED_SUFFIXES, suffix
from . import chunking, convert
from .jobs import outcome

#: Fixed value: bytes of the largest upload (500 MB).
LARGEST_UPLOAD = 500 * 1024 * 1024
VECTOR_SIZE = 64


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def upload_problem(path: Column, size: Column) -> Column:
    """Why an upload is refused: its name, its suffix or its size; null if it is taken."""
    name = base_name(path)
    bad = path.isNull() | name.isin("", ".", "..") | ~name.rlike(r'^[^\x00-\x1f/\\:*?"<>|]+$')
    return F.when(bad, "name").when(~suffix(name).isin(*ALLOWED_SUFFIXES), "suffix").when(size.isNull() | (size <= 0) | (size > LARGEST_UPLOAD), "size")


def upload_rows(uploads: DataFrame) -> dict[str, DataFrame]:
    """The rows that completed uploads (upload, space, path, size) add: a file, its first version, a document and a job."""
    ok = uploads.where(upload_problem(F.col("path"), F.col("size")).isNull())
    return {
        "files": ok.select("upload", "space", base_name(F.col("path")).alias("name"), "size"),
        "versions": ok.select("upload", F.lit(1).alias("version"), "path"),
        "documents": ok.select("upload", "space", base_name(F.col("path")).alias("title"), F.lit("pending").alias("status")),
        "jobs": ok.select("upload", F.lit("queued").alias("status")),
    }


def requested_pattern(request: Column) -> Column:
    """The file pattern that a request in words asks for: Markdown or text files by their names, else a pattern in it."""
    low = F.lower(request)
    named = F.regexp_extract(request, r"(\*+\.[a-zA-Z0-9]+|\*+)", 1)
    own = F.when(named == "", "*").when(named.contains("**") | named.contains("."), named).otherwise(F.concat(F.lit("*."), F.ltrim(named, F.lit("*"))))
    return F.when(low.rlike(r"\*?\.?md|markdown|文档"), "*.md").when(low.rlike(r"\.txt|text|文本"), "*.txt").otherwise(own)


def documents(files: DataFrame) -> DataFrame:
    """Of scanned files (path, name, suffix, content): method, title, text, its hash, characters and estimated tokens."""
    read = convert.file_texts(files)
    t = F.col("text")
    return read.select("path", "method", tx.title(t).alias("title"), "text", tx.content_hash(t).alias("hash"), F.length(t).cast("long").alias("n_chars"), tx.estimated_tokens(t).alias("tokens"))


def embedded_chunks(docs: DataFrame, key: str, text: str, strategy: str | Column = "section_pack", dimensions: int = VECTOR_SIZE) -> DataFrame:
    """Chunks that aren't blank, each with a hashed bag of words as its vector."""
    chunks = chunking.chunk(docs, key, text, strategy).where(F.regexp_replace("content", r"\s+", "") != "")
    words = F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return chunks.withColumn("embedding", vector.hashed_words(words, dimensions))


def replaced(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows after storing those of some documents anew: all earlier rows of these documents go, so a retry changes nothing."""
    return current.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def ingested(files: DataFrame, graph_failed: Column | None = None) -> dict[str, DataFrame]:
    """Files taken in: documents with their outcome (no chunks: failed; the graph part alone failed: partial), and chunks."""
    docs = documents(files)
    chunks = embedded_chunks(docs.where("text IS NOT NULL"), "path", "text")
    number = chunks.groupBy("path").agg(F.count(F.lit(1)).alias("chunks"))
    done = docs.join(number, "path", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    return {"documents": done.withColumn("status", outcome(F.col("chunks"), graph_failed if graph_failed is not None else F.lit(False))), "chunks": chunks}


def state(writes: DataFrame, scope: str, key: str, order: list[str]) -> DataFrame:
    """The last value of each key of a scope: a store of small JSON documents as a table of writes."""
    return writes.groupBy(scope, key).agg(F.max_by("value", F.struct(*order)).alias("value"))


def jobs_with_documents(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    return jobs.join(docs, "document")


def next_step(steps: DataFrame, entities: DataFrame, entity: str, index: str) -> DataFrame:
    """Of each entity the index that its next step gets: one more than its last, 0 for the first."""
    last = steps.groupBy(entity).agg(F.max(index).alias("_last"))
    return entities.join(last, entity, "left").select(entity, (F.coalesce("_last", F.lit(-1)) + 1).alias("next"))


def appended(log: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A log after appending rows: those whose key it has already are left out, and of rows with one key the first counts."""
    first = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return log.unionByName(first.join(log.select(key), key, "left_anti"))
