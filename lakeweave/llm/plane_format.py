"""Token ids on disk as shuffled planes: fixed-size blocks of ids, transposed into byte or bit planes, each plane
compressed with zstandard, and a chunk index at the end of the file.

File layout (little-endian)::

    b"LWPL" version:u16 planes:u16 block:u32
    chunk 0 plane 0 | chunk 0 plane 1 | ... | chunk c plane p        compressed planes
    zstd(int64 doc ids) zstd(uint8 doc id is null) zstd(int64 lengths)
    index: u64 end of each plane, in the order written; then u64 ends of the three document arrays
    u64 n_chunks, u64 n_docs, u64 n_ids, u64 index offset, b"LWPE"

A shard holds a range of documents in ascending id order. Tasks write to the shared folder under a name of their own
attempt, so a task that runs again leaves the committed shards alone; the manifest rows that Spark keeps name the
shards that count. Null texts are empty documents (the end id alone); rows with equal ids are kept, in text-hash order;
null ids sort first; an empty table gives no shards.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, tidied, written

MAGIC, END = b"LWPL", b"LWPE"
HEAD, FOOT = struct.Struct("<4sHHI"), struct.Struct("<QQQQ4s")
#: Shards that one reading task goes through, one after another.
SHARDS_TO_TASK = 4
MANIFEST = "shard int, path string, n_docs long, n_ids long"


def shuffle_block(ids: np.ndarray, planes: int) -> list[bytes]:
    """The planes of one block of uint32 ids: 4 byte planes, or 32 bit planes."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [np.ascontiguousarray(octets[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def unshuffle_block(parts: list[bytes], n: int) -> np.ndarray:
    if len(parts) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)).view("<u4").ravel()
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in parts], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


class ShardWriter:
    """Streams documents into one shard; holds one block of ids and the documents' lengths."""

    def __init__(self, out, block: int = 1 << 16, planes: int = 4, level: int = 3):
        import zstandard

        self.out, self.block, self.planes = out, block, planes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.waiting: list[bytes] = []
        self.held = self.n_ids = self.n_chunks = 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.ends: list[int] = []
        self.at = HEAD.size
        out.write(HEAD.pack(MAGIC, 1, planes, block))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids) // 4
        if self.held >= 8 * self.block:
            self._flush(last=False)

    def _put(self, data: bytes) -> None:
        data = self.zstd.compress(data)
        self.out.write(data)
        self.at += len(data)
        self.ends.append(self.at)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        whole = len(ids) if last else len(ids) // self.block * self.block
        for k in range(0, whole, self.block):
            for plane in shuffle_block(ids[k : min(k + self.block, whole)], self.planes):
                self._put(plane)
            self.n_chunks += 1
        self.n_ids += whole
        self.waiting, self.held = [ids[whole:].tobytes()], len(ids) - whole

    def close(self) -> None:
        self._flush(last=True)
        for data in (np.array([i or 0 for i in self.ids], "<i8"), np.array([i is None for i in self.ids], np.uint8), np.array(self.lengths, "<i8")):
            self._put(data.tobytes())
        self.out.write(np.array(self.ends, "<u8").tobytes())
        self.out.write(FOOT.pack(self.n_chunks, len(self.ids), self.n_ids, self.at, END))


def read_shard(src) -> Iterator[tuple[int | None, bytes]]:
    """(doc id, ids as little-endian uint32 bytes) of each document of a shard, holding one chunk and one document."""
    import zstandard

    unzip = zstandard.ZstdDecompressor().decompress
    src.seek(0, 2)
    size = src.tell()
    src.seek(size - FOOT.size)
    n_chunks, n_docs, n_ids, index, end = FOOT.unpack(src.read(FOOT.size))
    src.seek(0)
    magic, version, planes, block = HEAD.unpack(src.read(HEAD.size))
    if (magic, version, end) != (MAGIC, 1, END):
        raise ValueError("not a plane shard")
    src.seek(index)
    ends = [HEAD.size, *np.frombuffer(src.read(8 * (n_chunks * planes + 3)), "<u8").tolist()]

    def part(k: int) -> bytes:
        src.seek(ends[k])
        return unzip(src.read(ends[k + 1] - ends[k]))

    first = n_chunks * planes
    doc_ids, nulls, lengths = (np.frombuffer(part(first + k), t).tolist() for k, t in enumerate(("<i8", np.uint8, "<i8")))
    held, chunk = b"", 0
    for doc_id, null, length in zip(doc_ids, nulls, lengths, strict=True):
        parts = [held]
        have = len(held)
        while have < 4 * length:
            n = min(block, n_ids - chunk * block)
            parts.append(unshuffle_block([part(chunk * planes + k) for k in range(planes)], n).tobytes())
            have += 4 * n
            chunk += 1
        held = b"".join(parts) if len(parts) > 1 else held
        yield None if null else doc_id, held[: 4 * length]
        held = held[4 * length :]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, block: int = 1 << 16, planes: int = 4, path: str | None = None) -> DataFrame:
    """Encodes ``doc_id, text`` and writes shards in ascending doc_id order; returns the manifest with each shard's start."""
    spark = docs.sparkSession
    small_batches(spark)
    base = path or shared_dir(spark, "planes")
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        from .tokens import encoder

        import pyarrow as pa

        encode, writer, out, move = encoder(tokenizer).encode, None, None, None
        task = TaskContext.get()
        for batch in batches:
            if writer is None and batch.num_rows:
                files, folder = _filesystem(base)
                files.create_dir(folder, recursive=True)
                name = f"shard-{task.partitionId():06d}-{uuid.uuid4().hex[:8]}.lwp"
                out = files.open_output_stream(f"{folder}/{name}")
                writer, move = ShardWriter(out, block, planes), name
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            row = {"shard": [task.partitionId()], "path": [f"{base}/{move}"], "n_docs": [len(writer.ids)], "n_ids": [writer.n_ids]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ("doc_id", F.xxhash64("text"))
    manifest = written(ordered.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidied(write), MANIFEST), "planes-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, read from the shards of a manifest, a task for every few shards."""

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                files, name = _filesystem(path)
                rows, size = [], 0
                with files.open_input_file(name) as src:
                    for doc_id, ids in read_shard(src):
                        rows.append((doc_id, start, len(ids) // 4, ids))
                        start, size = start + len(ids) // 4, size + len(ids)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    shards = manifest.select("path", "start")
    return shards.repartition(max(1, -(-manifest.count() // SHARDS_TO_TASK))).mapInArrow(tidied(read), "doc_id long, start long, n_tokens long, ids binary")
