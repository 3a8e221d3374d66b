"""Best-fit packing of documents into fixed-length sequences after a Martello-Toth dominance reduction.

Only the histogram of piece lengths (at most ``capacity`` rows) reaches the driver. The plan over it is a list of bin
patterns with multiplicities: sets of up to three pieces that provably dominate every alternative are fixed first, in
bulk; best fit (longest first) places the rest. A piece finds its bin from its length and its rank among the pieces of
that length. Ranks come from counts by (task, length), so no length class, however common, meets in one task.

Null texts are empty documents (their end id alone); repeated rows are packed once for each row; an empty table packs
into no sequences.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, tidied, written

PIECES = "doc_id long, piece int, start long, length long, ids binary, task int, place long"


@dataclass
class Group:
    """``count`` bins alike: ``items`` holds (length, copies) in the order they lie in a bin."""

    count: int
    items: list[tuple[int, int]] = field(default_factory=list)

    def used(self) -> int:
        return sum(n * k for n, k in self.items)


def _take(lengths: list[int], counts: dict[int, int], group: dict[int, int], times: int) -> None:
    for n, k in group.items():
        counts[n] -= k * times
        if not counts[n]:
            del counts[n]
            lengths.pop(bisect.bisect_left(lengths, n))


def _largest(lengths: list[int], counts: dict[int, int], room: int, taken: dict[int, int]) -> int:
    """The longest piece of at most ``room`` that is left besides ``taken``; 0 if none."""
    k = bisect.bisect_right(lengths, room) - 1
    while k >= 0 and counts[lengths[k]] <= taken.get(lengths[k], 0):
        k -= 1
    return lengths[k] if k >= 0 else 0


def _smallest(lengths: list[int], counts: dict[int, int], taken: dict[int, int], many: int) -> list[int]:
    out: list[int] = []
    for n in lengths:
        out += [n] * min(many - len(out), counts[n] - taken.get(n, 0))
        if len(out) == many:
            break
    return out


def _best_second(lengths: list[int], counts: dict[int, int], room: int, taken: dict[int, int]) -> tuple[int, int]:
    """Over pairs x >= y of what is left with x + y <= room: the largest y, and the largest sum."""
    left = [n for n in lengths if n <= room and counts[n] > taken.get(n, 0)]
    most, total, k = 0, 0, len(left) - 1
    for i, y in enumerate(left):
        while k >= 0 and left[k] + y > room:
            k -= 1
        if k < i or (k == i and counts[y] - taken.get(y, 0) < 2):
            break
        most, total = y, max(total, y + left[k])
    return most, total


def dominating(j: int, lengths: list[int], counts: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """A set with the piece ``j`` that dominates every feasible set with ``j``, if one of up to three pieces does."""
    taken, room = {j: 1}, capacity - j
    a = _largest(lengths, counts, room, taken)
    if not a:
        return (j,)
    if a == room:
        return (j, a)
    low = _smallest(lengths, counts, taken, 3)
    if len(low) < 2 or low[0] + low[1] > room:
        return (j, a)  # one more piece fits at most, and none is longer
    if len(low) == 3 and sum(low) <= room:
        return None
    most, total = _best_second(lengths, counts, room, taken)
    if total <= a:
        return (j, a)  # any two that fit, fit in a's place
    taken = dict(taken)
    taken[a] = taken.get(a, 0) + 1
    b = _largest(lengths, counts, room - a, taken)
    return (j, a, b) if b and b >= most else None


def reduce_instance(histogram: dict[int, int], capacity: int) -> tuple[list[Group], dict[int, int]]:
    """Fixed groups, and the histogram of what is left; repeated until nothing more is fixed."""
    counts = {n: c for n, c in histogram.items() if c}
    lengths, fixed, changed = sorted(counts), [], True
    while changed and counts:
        changed = False
        for j in sorted(counts, reverse=True):
            while counts.get(j):
                found = dominating(j, lengths, counts, capacity)
                if not found:
                    break
                need: dict[int, int] = {}
                for n in found:
                    need[n] = need.get(n, 0) + 1
                # what is left holds no feasible set that wasn't there before, so the same set dominates while its pieces last
                times = min(counts[n] // k for n, k in need.items())
                _take(lengths, counts, need, times)
                fixed.append(Group(times, sorted(need.items(), reverse=True)))
                changed = True
    return fixed, counts


def best_fit(counts: dict[int, int], capacity: int) -> list[Group]:
    """Best fit, longest first, over a histogram: equal bins are handled as one group."""
    rooms: list[int] = []
    groups: dict[int, list[Group]] = {}
    done: list[Group] = []

    def put(group: Group) -> None:
        room = capacity - group.used()
        if not room:
            done.append(group)
            return
        if room not in groups:
            bisect.insort(rooms, room)
        groups.setdefault(room, []).append(group)

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            k = bisect.bisect_left(rooms, n)
            if k == len(rooms):
                per = capacity // n
                if left >= per:
                    put(Group(left // per, [(n, per)]))
                if left % per:
                    put(Group(1, [(n, left % per)]))
                break
            room = rooms[k]
            group = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(k)
            per = room // n
            full = min(group.count, left // per)
            if full:
                put(Group(full, [*group.items, (n, per)]))
            left -= full * per
            rest = group.count - full
            if rest and left:
                put(Group(1, [*group.items, (n, left)]))
                rest, left = rest - 1, 0
            if rest:
                put(Group(rest, group.items))
    return done + [g for same in groups.values() for g in same]


@dataclass
class Slots:
    """Of one length: from rank ``first[i]`` on, ``copies[i]`` ranks lie in each bin from ``bin[i]`` on, at ``offset[i]``."""

    first: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)


def plan(histogram: dict[int, int], capacity: int) -> tuple[dict[int, Slots], int]:
    """Slots by length, and the number of bins."""
    fixed, rest = reduce_instance(histogram, capacity)
    slots: dict[int, Slots] = {}
    ranks: dict[int, int] = {}
    at = 0
    for group in fixed + best_fit(rest, capacity):
        offset = 0
        for n, copies in group.items:
            s = slots.setdefault(n, Slots())
            s.first.append(ranks.get(n, 0))
            s.bin.append(at)
            s.copies.append(copies)
            s.offset.append(offset)
            ranks[n] = ranks.get(n, 0) + copies * group.count
            offset += n * copies
        at += group.count
    return slots, at


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of the encoded documents with their ids, the task that made them and their place in its length class."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        import pyarrow as pa

        from .tokens import encoder

        encode, task, seen = encoder(tokenizer).encode, TaskContext.get().partitionId(), [0] * (capacity + 1)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        names = [c.split()[0] for c in PIECES.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").cast(pa.binary()).to_pylist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc_id, piece, at // 4, n, part, task, seen[n]))
                    seen[n] += 1
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(tidied(cut), PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece with its ids (little-endian unsigned 32-bit), their crc32, its sequence and its place there.

    Columns: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset.
    """
    pieces = written(cut_documents(docs, tokenizer, capacity, end_id).withColumn("ids_crc32", F.crc32("ids")), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    histogram = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan(histogram, capacity)
    found = {n: tuple(np.array(x, np.int64) for x in (s.first, s.bin, s.copies, s.offset)) for n, s in slots.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), np.int64)
        n, r = length.to_numpy(), rank.to_numpy()
        order = np.argsort(n, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(n[order])) + 1):
            if len(rows):
                first, bins, copies, offset = found[int(n[rows[0]])]
                k = np.searchsorted(first, r[rows], side="right") - 1
                past = r[rows] - first[k]
                out[rows, 0] = bins[k] + past // copies[k]
                out[rows, 1] = offset[k] + past % copies[k] * n[rows]
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    ranked = pieces.join(starts.select("length", "task", "before"), ["length", "task"])
    put = ranked.withColumn("put", placed("length", F.col("before") + F.col("place")))
    return put.select("doc_id", "piece", "start", "length", "ids", "ids_crc32", F.col("put.sequence_id"), F.col("put.offset"))
