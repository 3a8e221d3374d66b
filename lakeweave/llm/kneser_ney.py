"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped to score.

Training is two passes over the texts. The first counts frequent first words over all of them: a task reports the words
with over half the share that counts as hot, so none that is hot over all tasks is missed. In the second, each task counts
its word pairs and sends them, sorted, to shards by the first word's hash. The pairs of a hot word (over a quarter of a
mean shard) are parted by the second word into as many parts as it has quarters, so no shard grows with one word. A shard
adds its pairs up, writes them as a model file (sorted 64-bit pair hashes with their counts), and passes on what it knows
of each word: N1, N2 and N3+ of it as a context, its count and how many different words it follows. A second exchange by
word adds these up and writes the word files.

Scoring is a map over documents: a worker looks up a batch's distinct words and pairs in sorted order, shard by shard. A
model file is mapped into memory when it is first needed and stays mapped for the rest of the task, ``KEPT_FILES`` at
most. Through the driver pass totals, the hot words, and four bytes for each file.

Tokens are the ASCII-lower-cased words of a text and one end token. Null texts are empty (one end token). Repeated
rows count and are scored once for each row. With no training text every token has probability 1 / (V + 1) = 1.
"""

from __future__ import annotations

import io
import math
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, tidied, written

#: Text bytes to a shard of pairs, and to a shard of words.
PAIR_SHARD, WORD_SHARD = 16 << 20, 64 << 20
#: A first word is hot with over this part of a mean shard's pairs.
HOT_PART = 0.25
#: Model files that a task keeps mapped, and bytes of those that it had to fetch because their store can't be mapped.
KEPT_FILES, FETCHED = 4096, 256 << 20
#: Pairs that a task holds before it adds them up.
HELD = 2_000_000

START, END = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
#: Hashes of words kept between batches: none, as each batch's distinct words are hashed once.
_known: dict[bytes, int] = {}


def _hashes(words: np.ndarray) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.tolist()), np.uint64, len(words))


def forget() -> None:
    """Drops the mapped files that a worker keeps for a task."""
    _open_files.clear()


def coded(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: each word's number among the batch's distinct words, the hashes of those, and the number of
    words of each text."""
    raw = np.frombuffer(b" ".join([t or b"" for t in texts]).lower() + b" ", np.uint8)
    space = _SPACE[raw]
    gaps = np.flatnonzero(space)
    letters = gaps - np.arange(len(gaps))  # before each white-space byte
    ends = np.diff(letters, prepend=0) > 0
    offsets = np.concatenate((np.zeros(1, np.int64), letters[ends]))
    past = np.cumsum(np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts)))
    n = np.diff(np.cumsum(ends)[np.searchsorted(gaps, past - 1)], prepend=0)
    words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw[~space])]).dictionary_encode()
    return words.indices.to_numpy(), _hashes(words.dictionary.to_numpy(zero_copy_only=False)), n


def pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (v ^ (v >> np.uint64(31))) * _MIX + w
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: each token's context hash, its hash, and the number of tokens of each text."""
    codes, hashes, n = coded(texts)
    n = n + 1
    ends = np.cumsum(n) - 1
    w = np.empty(int(n.sum()), np.uint64)
    here = np.ones(len(w), bool)
    here[ends] = False
    w[here] = hashes[codes]
    w[ends] = END
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[ends - n + 1] = START
    return v, w, n


def by_shard(shard: np.ndarray, shards: int) -> list[np.ndarray]:
    """Rows of each shard that has any, in their order."""
    if not len(shard):
        return []
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(shard[order])) + 1)


@dataclass(frozen=True)
class Dealing:
    """Which shard a pair and a word belong to. ``hot``: first words, sorted, that are dealt in ``parts`` each."""

    pair_shards: int
    word_shards: int
    hot: np.ndarray
    parts: np.ndarray

    def of_pairs(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        key = v >> np.uint64(20)
        if len(self.hot) and len(v):
            at = np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)
            rows = np.flatnonzero(self.hot[at] == v)
            part = (pair_hash(v[rows], w[rows]) >> np.uint64(20)) % self.parts[at[rows]]
            key[rows] += part * np.uint64(0x9E3779B97F4A7)
        return (key % np.uint64(self.pair_shards)).astype(np.int32)

    def of_words(self, w: np.ndarray) -> np.ndarray:
        return ((w >> np.uint64(8)) % np.uint64(self.word_shards)).astype(np.int32)


def _added(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of several key columns, sorted and distinct, with their values (rows x k) added up."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys, value = [k[order] for k in keys], values[order] if isinstance(values, np.ndarray) else values
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(value, at, axis=0) if len(at) else value


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; integers as planes of bytes, so that small counts cost little."""
    import zstandard

    out, squeeze = io.BytesIO(), zstandard.ZstdCompressor(level=1).compress
    for a in arrays:
        octets = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T if len(a) else np.zeros((a.dtype.itemsize, 0), np.uint8)
        data = squeeze(np.ascontiguousarray(octets).ravel())
        out.write(len(data).to_bytes(8, "little") + len(a).to_bytes(8, "little") + a.dtype.str.encode().ljust(4) + data)
    return out.getvalue()


def _unpacked(data: bytes) -> list[np.ndarray]:
    import zstandard

    out, at = [], 0
    while at < len(data):
        size, n, kind = int.from_bytes(data[at : at + 8], "little"), int.from_bytes(data[at + 8 : at + 16], "little"), np.dtype(data[at + 16 : at + 20].decode().strip())
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at + 20 : at + 20 + size]), np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).ravel() if n else np.zeros(0, kind))
        at += 20 + size
    return out


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint32) if not len(a) or a.max() < 1 << 32 else a.astype(np.uint64)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _file(folder: str, kind: str, shard: int, mark: int) -> str:
    return f"{folder}/{kind}-{shard:06d}-{mark:08x}.bin"


def _save(folder: str, kind: str, shard: int, *arrays: np.ndarray) -> int:
    """Writes arrays one after another, each behind a 64-byte line with its type and length. Returns the mark in the file's
    name, new for each attempt of a task."""
    files, path = _filesystem(folder)
    files.create_dir(path, recursive=True)
    mark = uuid.uuid4().int & 0x7FFFFFFF
    with files.open_output_stream(_file(path, kind, shard, mark)) as out:
        for a in arrays:
            out.write(f"{a.dtype.str} {len(a)}".encode().ljust(64))
            out.write(a.tobytes())
            out.write(b"\0" * (-a.nbytes % 64))
    return mark


#: A task's open model files: their arrays and how many bytes were fetched for them; the latest used come last.
_open_files: OrderedDict[str, tuple[list[np.ndarray], int]] = OrderedDict()


def _mapped(path: str) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped (a file of a store that can't be mapped is read as a whole)."""
    from pyarrow import fs

    if path in _open_files:
        _open_files.move_to_end(path)
        return _open_files[path][0]
    files, name = _filesystem(path)
    if isinstance(files, fs.LocalFileSystem):
        data, fetched = np.memmap(name, np.uint8, "r"), 0
    else:
        with files.open_input_stream(name) as src:
            data = np.frombuffer(src.read(), np.uint8)
        fetched = len(data)
    out, at = [], 0
    while at < len(data):
        kind, n = data[at : at + 64].tobytes().split()
        size = int(n) * np.dtype(kind.decode()).itemsize
        out.append(data[at + 64 : at + 64 + size].view(kind.decode()))
        at += 64 + size + -size % 64
    while _open_files and (len(_open_files) >= KEPT_FILES or fetched + sum(f for _, f in _open_files.values()) > FETCHED):
        _open_files.popitem(last=False)
    _open_files[path] = out, fetched
    return out


def _look_up(keys: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Index of each sorted query among sorted keys; -1 where absent."""
    if not len(keys):
        return np.full(len(queries), -1)
    at = np.searchsorted(keys, queries)
    at[at == len(keys)] = 0
    return np.where(keys[at] == queries, at, -1)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's D1, D2, D3+ from counts of counts n1..n4; 0.5, 0.75 and 0.9 where one of those is zero."""
    if min(n) <= 0:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k) for k in (1, 2, 3))


def _discounted(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return count - np.array([0.0, *d])[np.minimum(count, 3).astype(np.int64)]


@dataclass(frozen=True)
class Model:
    dealing: Dealing
    folder: str
    pair_marks: np.ndarray  # by shard, what the file's name ends in; -1: no file
    word_marks: np.ndarray
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    n_tokens: int
    n_texts: int
    n_words: int
    n_pairs: int
    word_rest: float  # D1 n1 + D2 n2 + D3 n3+ over words

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Looks a batch of texts up in the mapped files."""

    def __init__(self, model: Model):
        self.m = model

    def _arrays(self, kind: str, shard: int) -> list[np.ndarray] | None:
        mark = int((self.m.pair_marks if kind == "pairs" else self.m.word_marks)[shard])
        return _mapped(_file(self.m.folder, kind, shard, mark)) if mark >= 0 else None

    def _words(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, number of words it follows, and context mass of each word of a sorted array."""
        out = np.zeros((3, len(w)))
        shard = self.m.dealing.of_words(w)
        for rows in by_shard(shard, self.m.dealing.word_shards):
            found = self._arrays("words", int(shard[rows[0]]))
            if found:
                keys, *columns = found
                at = _look_up(keys, w[rows])
                rows, at = rows[at >= 0], at[at >= 0]
                for i, c in enumerate(columns):
                    out[i, rows] = c[at]
        return out[0], out[1], out[2]

    def _pairs(self, v: np.ndarray, w: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Count of each pair, in the order of sorted keys."""
        shard, out = self.m.dealing.of_pairs(v, w), np.zeros(len(v))
        for rows in by_shard(shard, self.m.dealing.pair_shards):
            found = self._arrays("pairs", int(shard[rows[0]]))
            if found:
                keys, counts, large, large_counts = found
                at = _look_up(keys, key[rows])
                rows, at = rows[at >= 0], at[at >= 0]
                got = counts[at].astype(np.float64)
                if (big := np.flatnonzero(got == 255)).size:
                    got[big] = large_counts[np.searchsorted(large, key[rows[big]])]
                out[rows] = got
        return out

    def score(self, texts: list[bytes | None]) -> dict[str, np.ndarray]:
        m = self.m
        v, w, n = tokens(texts)
        # all is looked up and reckoned once for each distinct pair; return_index would have a slower sort
        key, back = np.unique(pair_hash(v, w), return_inverse=True)
        one = np.empty(len(key), np.int64)
        one[back] = np.arange(len(w))  # a token of each pair
        v, w = v[one], w[one]
        both, inverse = np.unique(np.concatenate((w, v)), return_inverse=True)
        wi, vi = inverse[: len(w)], inverse[len(w) :]
        count, follows, mass = self._words(both)
        unseen = 1.0 / (m.n_words + 1)
        total = max(m.n_pairs, 1)
        rest = m.word_rest / total if m.n_pairs else 1.0
        p1 = (np.maximum(_discounted(follows, m.word_discounts), 0) / total + rest * unseen)[wi]
        seen = self._pairs(v, w, key)
        context = np.where(both == START, float(m.n_texts), count)[vi]
        known = context > 0
        safe = np.where(known, context, 1.0)
        p = np.where(known, (np.maximum(_discounted(seen, m.pair_discounts), 0) + mass[vi] * p1) / safe, p1)
        at = np.cumsum(n) - n
        base = np.log10((count + 0.1) / (m.n_tokens + 0.1 * (m.n_words + 1)))[wi]
        return {"n_tokens": n, "n_known": np.add.reduceat((count > 0)[wi][back].astype(np.int64), at), "base_score": np.add.reduceat(base[back], at), "score": np.add.reduceat(np.log10(p)[back], at)}


def _hot_words(texts: DataFrame, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """First words that have over ``HOT_PART`` of a mean shard's pairs, sorted, and the parts to deal each in."""
    share = HOT_PART / shards

    def often(batches):
        words, numbers, total = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            found, n = np.unique(tokens(batch.column("text").cast(pa.binary()).to_pylist())[0], return_counts=True)
            words.append(found)
            numbers.append(n)
            total += int(n.sum())
            if len(words) == 16:
                (found,), n = _added([np.concatenate(words)], np.concatenate(numbers)[:, None])
                words, numbers = [found], [n[:, 0]]
        if words:
            (found,), n = _added([np.concatenate(words)], np.concatenate(numbers)[:, None])
            rows = np.flatnonzero(n[:, 0] > share / 2 * total)
            out = [np.append(found[rows].view(np.int64), 0), np.append(n[rows, 0], total), np.append(np.zeros(len(rows), bool), True)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["word", "n", "all"])

    found = texts.mapInArrow(tidied(often), "word long, n long, all boolean").groupBy("word", "all").agg(F.sum("n").alias("n"))
    found = written(found, "first-words")
    total = found.where("all").agg(F.sum("n")).first()[0] or 0
    hot = found.where(~F.col("all") & (F.col("n") > share / 2 * total)).select("word", "n").orderBy("word").collect()
    word = np.array([r["word"] for r in hot], np.int64).view(np.uint64)
    parts = np.ceil((np.array([r["n"] for r in hot], np.float64) / max(total, 1) + share / 2) / share).astype(np.uint64)
    order = np.argsort(word)
    return word[order], np.maximum(parts[order], 1)


def train(docs: DataFrame) -> Model:
    """A model of every text of ``docs`` (column ``text``)."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_dir(spark, "kneser-ney")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(16, math.ceil(size / PAIR_SHARD))
    dealing = Dealing(shards, max(4, math.ceil(size / WORD_SHARD)), *_hot_words(texts, shards))

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        number, n_texts = 0, 0

        def add(rows):
            v, w, c = (np.concatenate(x) for x in zip(*rows, strict=True))
            key = pair_hash(v, w)
            order = np.argsort(key)
            key = key[order]
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            return v[order[at]], w[order[at]], np.add.reduceat(c[order], at)

        def out():
            v, w, c = add(held)
            shard, bits = dealing.of_pairs(v, w), np.uint64(max(shards - 1, 1).bit_length())
            # by shard, and in it by all of the first word's hash but its last bits
            order = np.argsort(shard.astype(np.uint64) << (np.uint64(64) - bits) | v >> bits)
            v, w, c, shard = v[order], w[order], c[order], shard[order]
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(v)]
            rows = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                new = np.concatenate(([True], v[a + 1 : b] != v[a : b - 1]))
                at = np.flatnonzero(new)
                rows.append((int(shard[a]), _packed(v[a:b][at], np.diff(np.append(at, b - a)).astype(np.uint32), w[a:b], _narrow(c[a:b]))))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary()), strict=True)], names=["shard", "block"])

        for batch in batches:
            values = batch.column("text").cast(pa.binary()).to_pylist()
            if not values:
                continue
            v, w, _ = tokens(values)
            held.append((v, w, np.ones(len(v), np.int64)))
            number += len(v)
            if number > HELD:
                held[:] = [add(held)]
                number = len(held[0][0])
                if number > 0.7 * HELD:
                    yield out()
                    held.clear()
                    number = 0
        if held:
            yield out()

    def merge_pairs(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = key[0].as_py()
        vs, ws, cs = [], [], []
        for batch in batches:
            for block in batch.column("block").to_pylist():
                v, n, w, c = _unpacked(block)
                vs.append(np.repeat(v, n))
                ws.append(w)
                cs.append(c.astype(np.int64))
        v, w, c = np.concatenate(vs), np.concatenate(ws), np.concatenate(cs)
        vs = ws = cs = None
        k = pair_hash(v, w)
        order = np.argsort(k)
        k = k[order]
        at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        c = np.add.reduceat(c[order], at)
        v, w, k = v[order[at]], w[order[at]], k[at]
        large = c >= 255
        mark = _save(folder, "pairs", shard, k, np.minimum(c, 255).astype(np.uint8), k[large], c[large].astype(np.uint64))
        # of each word: N1, N2, N3+ as a context; its count and the number of words before it
        word, inverse = np.unique(np.concatenate((v, w)), return_inverse=True)
        before, after = inverse[: len(v)], inverse[len(v) :]
        sums = [np.bincount(before[x], minlength=len(word)) for x in (c == 1, c == 2, c > 2)]
        # a sum of counts is exact in a double up to 2^53
        sums += [np.bincount(after, c, len(word)).astype(np.int64), np.bincount(after, minlength=len(word))]
        to = dealing.of_words(word)
        n = [int((c == i).sum()) for i in (1, 2, 3, 4)]
        rows = [(shard, mark, n, len(c), int(c.sum()), int(c[v == START].sum()), None, None)]
        for mine in by_shard(to, dealing.word_shards):
            rows.append((None, None, None, 0, 0, 0, int(to[mine[0]]), _packed(word[mine], *(_narrow(x[mine]) for x in sums))))
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in MERGED.split(", ")])

    blocks = texts.mapInArrow(tidied(count), "shard int, block binary")
    merged = written(blocks.repartition(shards, "shard").groupBy("shard").applyInArrow(merge_pairs, MERGED), "kneser-ney-words")
    heads = merged.where("mark IS NOT NULL")
    sums = heads.agg(*(F.sum(F.col("counts")[i]) for i in range(4)), F.sum("n_pairs"), F.sum("n_tokens"), F.sum("n_texts")).first()
    *ns, n_pairs, n_tokens, n_texts = (int(x or 0) for x in sums)
    pair_d = discounts(ns)

    def merge_words(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = key[0].as_py()
        parts = [_unpacked(b) for batch in batches for b in batch.column("block").to_pylist()]
        word = np.concatenate([p[0] for p in parts])
        value = np.stack([np.concatenate([p[i].astype(np.int64) for p in parts]) for i in range(1, 6)], axis=1)
        (word,), value = _added([word], value)
        mass = value[:, :3] @ np.array(pair_d)
        count, follows = value[:, 3], value[:, 4]
        mark = _save(folder, "words", shard, word, _narrow(count), _narrow(follows), mass)
        n = [int((follows == i).sum()) for i in (1, 2, 3, 4)]
        row = {"shard": [shard], "mark": [mark], "counts": [[*n, int((follows > 2).sum())]], "n_words": [int((count > 0).sum())]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("mark", pa.int64()), ("counts", pa.list_(pa.int64())), ("n_words", pa.int64())]))

    words = merged.where("block IS NOT NULL").select("word_shard", "block")
    word_heads = written(words.repartition(dealing.word_shards, "word_shard").groupBy("word_shard").applyInArrow(merge_words, "shard int, mark long, counts array<long>, n_words long"), "kneser-ney-heads")
    sums = word_heads.agg(*(F.sum(F.col("counts")[i]) for i in range(5)), F.sum("n_words")).first()
    *n1, n_words = (int(x or 0) for x in sums)
    word_d = discounts(n1[:4])

    def marks(rows: DataFrame, number: int) -> np.ndarray:
        out = np.full(number, -1, np.int32)
        for r in rows.select("shard", "mark").toLocalIterator():
            out[r["shard"]] = r["mark"]
        return out

    return Model(
        dealing,
        folder,
        marks(heads, dealing.pair_shards),
        marks(word_heads, dealing.word_shards),
        pair_d,
        word_d,
        n_tokens=n_tokens,
        n_texts=n_texts,
        n_words=n_words,
        n_pairs=n_pairs,
        word_rest=word_d[0] * n1[0] + word_d[1] * n1[1] + word_d[2] * n1[4],
    )


MERGED = "shard int, mark long, counts array<long>, n_pairs long, n_tokens long, n_texts long, word_shard int, block binary"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and perplexity of every row, from the mapped model."""
    small_batches(docs.sparkSession)

    def run(batches):
        scorer = None
        for batch in batches:
            if not batch.num_rows:
                continue
            scorer = scorer or model.scorer()
            got = scorer.score(batch.column("text").cast(pa.binary()).to_pylist())
            perplexity = 10.0 ** (-got["score"] / got["n_tokens"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(got[k]) for k in ("n_tokens", "n_known", "base_score", "score")), pa.array(perplexity)], names=["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(tidied(run), "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def held_out_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """Trains on the rows for which ``held_out`` is false and scores every row; where it is null (a null id), a row counts
    as not held out."""
    held_out = F.coalesce(held_out, F.lit(False))
    model = train(docs.where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
