"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on what survives.

A run is a stretch of consecutive words with smallest period q and length of at least max(``shortest``, 2 q) that no
neighbouring word extends keeping period q. Its words repeat at distance q over an overlap of length - q words, which is at
least k = ceil(``shortest`` / 2) and at least q. So each of its words lies in a k-gram that occurs again in the text: words
outside repeated k-grams are masked, and a run lies whole in one stretch of unmasked words. Main-Lorentz (divide and
conquer; common extensions about each middle by prefix functions) finds all repetitions of such a stretch in O(n log n).

Words are cut at the six ASCII white-space characters; equality is by bytes. A null or empty text has no words, no run and
an empty collapsed text. A document's work is one task's; texts reach Python in batches held by bytes. Ids aren't read:
null and repeated ones keep their rows, and other columns, whatever their names, aren't touched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import small_batches, tidied

Run = tuple[int, int, int]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


def least_overlap(shortest: int) -> int:
    """The least of max(``shortest``, 2 q) - q over all periods q: how many words of a run at least occur again."""
    return (shortest + 1) // 2


def unmasked(words: list[bytes], shortest: int) -> list[tuple[int, int]]:
    """Stretches (from, to) of at least ``shortest`` words that repeated k-grams cover. Grams are compared by hash: a
    chance collision leaves a stretch too many, never one too few."""
    k, n = least_overlap(shortest), len(words)
    if n < shortest:
        return []
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    grams = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        grams = (grams ^ (grams >> np.uint64(29))) * _MIX + ids[j : n - k + 1 + j]
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return []
    repeated = np.zeros(n - k + 1, np.bool_)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    at = np.flatnonzero(repeated)
    cut = np.flatnonzero(np.diff(at) > k)  # a gram further on than k words doesn't touch the one before
    starts, ends = np.concatenate((at[:1], at[cut + 1])), np.concatenate((at[cut], at[-1:])) + k
    return [(lo, hi) for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True) if hi - lo >= shortest]


def _prefixes(s: list[int]) -> list[int]:
    """At each place, how many words from there equal the sequence's first ones (0 at the first)."""
    n, left, right = len(s), 0, 0
    out = [0] * n
    for i in range(1, n):
        k = 0
        if i < right:
            k = out[i - left]
            if k < right - i:
                out[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        out[i] = k
        if k:
            left, right = i, i + k
    return out


def repetitions(s: list[int], shortest: int) -> list[Run]:
    """All runs of a sequence of numbers (none of them negative): start, length, period."""
    least: dict[tuple[int, int], int] = {}
    todo = [(0, len(s))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < shortest:
            continue
        mid = (lo + hi) // 2
        todo += [(lo, mid), (mid, hi)]
        for start, end, period in _about(s, lo, mid, hi):
            # one that goes on beyond this part is found whole where the part's edge is the middle
            if end - start < shortest or (start == lo and lo and s[lo - 1] == s[lo - 1 + period]) or (end == hi and hi < len(s) and s[hi] == s[hi - period]):
                continue
            if least.get((start, end), period) >= period:
                least[start, end] = period
    return sorted(((start, end - start, period) for (start, end), period in least.items()), key=lambda r: (r[0], r[2]))


def _about(s: list[int], lo: int, mid: int, hi: int) -> list[Run]:
    """(start, end, period) of the repetitions of s[lo:hi] that hold the middle and a period's length on one side of it."""
    left, right, whole = s[lo:mid], s[mid:hi], s[lo:hi]
    back = left[::-1]
    n, m = len(left), len(right)
    out = []
    ahead, behind = _prefixes(right), _prefixes([*back, -1, *whole[::-1]])
    for p in range(1, m + 1):  # s[mid:] against s[mid + p:]
        before, after = behind[n + 1 + m - p], ahead[p] if p < m else 0
        if before + after >= p:
            out.append((mid - before, mid + p + after, p))
    ahead, behind = _prefixes([*right, -1, *whole]), _prefixes(back)
    for p in range(1, n + 1):  # s[mid - p:] against s[mid:]
        before, after = behind[p] if p < n else 0, ahead[m + 1 + n - p]
        if before + after >= p:
            out.append((mid - p - before, mid + after, p))
    return out


def word_runs(words: list[bytes], shortest: int = 12) -> list[Run]:
    """The runs of a text's words, by start, then period."""
    out = []
    for lo, hi in unmasked(words, shortest):
        ids: dict[bytes, int] = {}
        out += [(lo + start, length, period) for start, length, period in repetitions([ids.setdefault(w, len(ids)) for w in words[lo:hi]], shortest)]
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that some run holds after its first period, joined by a space."""
    if not runs:
        return b" ".join(words)
    kept = [True] * len(words)
    for start, length, period in runs:
        kept[start + period : start + length] = [False] * (length - period)
    return b" ".join([w for w, k in zip(words, kept, strict=True) if k])


def _mapped(docs: DataFrame, schema: StructType, shortest: int, make) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            words = [(t or b"").split() for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(make(batch, words, [word_runs(w, shortest) for w in words]), names=schema.fieldNames())

    return docs.mapInArrow(tidied(run), schema)


def find_runs(docs: DataFrame, shortest: int = 12) -> DataFrame:
    """doc_id, n_words (int), runs (structs of start, length and period by start, then period) and collapsed (the text's
    UTF-8 bytes) of every row of ``docs``."""
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = StructType([plain.schema["doc_id"], StructField("n_words", IntegerType()), StructField("runs", ArrayType(_RUN)), StructField("collapsed", BinaryType())])
    arrow = pa.list_(pa.struct([(c, pa.int64()) for c in _RUN.fieldNames()]))

    def make(batch, words, runs):
        named = pa.array([[dict(zip(_RUN.fieldNames(), r, strict=True)) for r in found] for found in runs], arrow)
        texts = pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.binary())
        return [batch.column(0), pa.array([len(w) for w in words], pa.int32()), named, texts]

    return _mapped(plain, schema, shortest, make)


def collapsed_documents(docs: DataFrame, shortest: int = 12) -> DataFrame:
    """``docs`` with all columns; a text that holds runs is replaced by its collapsed form, any other stays as it is."""
    others = [c for c in docs.columns if c.lower() != "text"]
    plain = docs.select(*(F.col(f"`{c}`") for c in others), F.col("text").cast("string").alias("text"))
    schema = StructType([*plain.schema.fields[:-1], StructField("text", BinaryType())])

    def make(batch, words, runs):
        old = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
        return [*batch.columns[:-1], pa.array([collapsed(w, r) if r else t for t, w, r in zip(old, words, runs, strict=True)], pa.binary())]

    return _mapped(plain, schema, shortest, make).withColumn("text", F.col("text").cast("string")).select(*(F.col(f"`{c}`") for c in docs.columns))
