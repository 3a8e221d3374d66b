"""Benchmark decontamination: CGK random-walk embeddings, bit-sampling LSH, exact edit verification.

Texts and benchmark items are word sequences; a document is contaminated by an item if some stretch of it is within
``rate * words`` word edits of the item. A CGK walk reads a sequence from a start and, at each step, moves on by a random
bit of the word it reads, so words that agree pull two walks together again: small edit distance becomes small Hamming
distance of the words read. A repetition samples a few steps of the walk as its key; walks of one repetition share all
random bits.

Windows start at anchors: of each quarter of an item, the words that fewest items have. A document window starts wherever
it has an anchor word, whatever follows. In every second repetition a window is item-sized: its walk goes on to the item's
end, in steps of the greatest power of two; in the others it has ``SHORT`` steps, for items with many edits on one side.
Repetitions are added until, on edits drawn anew each time, the lower bound of recall reaches the target: edits at the
full rate, of all kinds, half of the trials over the whole item and a quarter each in its first and its last half. If
``most`` repetitions don't suffice, every item is tried in each part; those ever missed are held against every text as a
whole, exactly, and more of them until fresh trials on the others reach the target. Each candidate is verified by exact word edit distance, so no stretch beyond the limit is reported.

The benchmark is read in blocks of ``ITEMS`` items, each held against all documents. Null or empty texts and items match
nothing; repeated rows are each reported, and each kept or dropped by its own text; items with the same id are separate
items, and one without an id is an item too; an empty benchmark leaves every document clean. Case is folded for A-Z.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidied
from .kneser_ney import coded, pair_hash, tokens

ITEMS = 20_000
#: Anchors of each quarter of an item.
ANCHORS = 2
#: Steps of a short window, and how many steps after the first a key samples.
SHORT, SAMPLED = 8, 3
#: Words of candidate stretches looked up at once.
LOOKED_UP = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAD = np.uint64(0x5851F42D4C957F2D)


def _moves(words: np.ndarray, repetition: int, step: int) -> np.ndarray:
    """The random bit of each word at one step of one repetition: whether a walk moves on."""
    x = (words + np.uint64(((repetition << 20) + step + 1) * int(_MIX) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(40)).astype(np.int64) & 1


def walk(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, repetition: int, steps: np.ndarray):
    """Steps of the walks from ``starts``: yields (step, walks still going, word read by each, its place); a walk past its
    end reads the pad word. Walk ``i`` makes ``steps[i]`` steps."""
    going = np.arange(len(starts))
    at = starts.copy()
    for step in range(int(steps.max(initial=0))):
        more = steps[going] > step
        if not more.all():
            going, at = going[more], at[more]
        inside = at < ends[going]
        read = np.where(inside, words[np.where(inside, at, 0)], _PAD)
        yield step, going, read, at
        at = at + np.where(inside, _moves(read, repetition, step), 1)


def _sampled(repetition: int, steps: int) -> list[int]:
    """The steps that a repetition's key has in a window of ``steps``; the first always."""
    rng = np.random.default_rng([repetition, steps])
    return [0, *sorted(rng.choice(np.arange(1, steps), min(SAMPLED, steps - 1), replace=False).tolist())]


def _window_keys(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, repetition: int, steps: np.ndarray, sizes: list[int]) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Of each window size: the walks that go so far and their keys. Also how many steps of each walk were inside."""
    sampled = {s: set(_sampled(repetition, s)) for s in sizes}
    hashes = {s: np.full(len(starts), np.uint64(repetition * 4096 + s.bit_length())) for s in sizes}
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    inside = np.zeros(len(starts), np.int64)
    for step, going, read, at in walk(words, starts, ends, repetition, steps):
        inside[going] += at < ends[going]
        for s in sizes:
            if step in sampled[s]:
                h = hashes[s][going]
                hashes[s][going] = (h ^ (h >> np.uint64(29))) * _MIX + read
            if step == s - 1:
                h = hashes[s][going]
                out[s] = (going, h ^ (h >> np.uint64(32)))
    return out, inside


@dataclass
class Index:
    """Keys of a block of items. ``entries``: (item, anchor offset) of each key; ``reach``: of each anchor word, the most
    steps of a window of it; ``sizes``: window sizes of each repetition; ``scanned``: items held exactly to every text;
    ``words``: hashes of each item's number with each of its words."""

    ids: list[int]
    items: list[np.ndarray]
    limits: list[int]
    anchors: np.ndarray
    reach: np.ndarray
    sizes: list[list[int]]
    keys: np.ndarray
    entries: np.ndarray
    scanned: list[int]
    words: np.ndarray


def _anchors(items: list[np.ndarray]) -> np.ndarray:
    """(item, offset) of every anchor."""
    found, number = np.unique(np.concatenate([np.unique(i) for i in items]), return_counts=True)
    out = []
    for k, words in enumerate(items):
        common = number[np.searchsorted(found, words)]
        for quarter in np.array_split(np.arange(len(words)), 4):
            out += [(k, int(a)) for a in quarter[np.argsort(common[quarter], kind="stable")[:ANCHORS]]]
    return np.array(out, np.int64)


def _item_words(items: list[np.ndarray]) -> np.ndarray:
    return np.unique(pair_hash(np.repeat(np.arange(len(items), dtype=np.uint64), [len(i) for i in items]), np.concatenate(items)))


def _power(n: np.ndarray) -> np.ndarray:
    """The greatest power of two up to each number (1 at least)."""
    return np.int64(1) << np.maximum(np.floor(np.log2(np.maximum(n, 1) + 0.5)), 0).astype(np.int64)


def _item_keys(items: list[np.ndarray], where: np.ndarray, repetition: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchored window of the items in one repetition: its key and its size."""
    length = np.array([len(i) for i in items])
    first = np.cumsum(length) - length
    words, starts, ends = np.concatenate(items), first[where[:, 0]] + where[:, 1], (first + length)[where[:, 0]]
    most = np.full(len(starts), SHORT) if repetition % 2 else 4 * (ends - starts) + SHORT
    # an item's last words are too few for many steps; how many a walk makes inside, it tells by itself
    _, inside = _window_keys(words, starts, ends, repetition, most, [])
    size = np.minimum(_power(inside), SHORT if repetition % 2 else 1 << 40)
    keys = np.zeros(len(starts), np.uint64)
    for s, (going, found) in _window_keys(words, starts, ends, repetition, size, sorted(set(size.tolist())))[0].items():
        mine = size[going] == s
        keys[going[mine]] = found[mine]
    return keys, size


def _edited(words: np.ndarray, edits: int, part: int, rng: np.random.Generator) -> np.ndarray:
    """The words after so many random edits: anywhere (part 0), in the first half (1) or in the last (2)."""
    out = words.tolist()
    for _ in range(edits):
        low, high = (0, len(out)) if part == 0 else (0, (len(out) + 1) // 2) if part == 1 else (len(out) // 2, len(out))
        at, kind, new = int(rng.integers(low, max(high, low + 1))), int(rng.integers(3)), int(rng.integers(1 << 63))
        if kind == 0:
            out.insert(at, new)
        elif kind == 1 or len(out) == 1:
            out[at] = new
        else:
            del out[at]
    return np.array(out, np.uint64)


#: Parts of an item that a trial edits: the whole, its first and its last half.
PARTS = (0, 0, 1, 2)


def _missed(index: Index, picked: np.ndarray, parts: np.ndarray, rng: np.random.Generator) -> list[int]:
    """The items of those trials (an item and a part each) in which an edited copy of the item between other words isn't a
    candidate."""
    noise = lambda: rng.integers(1 << 63, size=20, dtype=np.uint64)
    out = []
    for low in range(0, len(picked), 4000):
        some = picked[low : low + 4000].tolist()
        copies = [np.concatenate((noise(), _edited(index.items[k], index.limits[k], part, rng), noise())) for k, part in zip(some, parts[low : low + 4000].tolist(), strict=True)]
        sizes = np.array([len(c) for c in copies])
        item, place = _candidates(index, np.concatenate(copies), sizes)
        text = np.searchsorted(np.cumsum(sizes), np.clip(place, 0, None), side="right")
        met = {t for t, k in zip(text.tolist(), item.tolist(), strict=True) if t < len(some) and k == some[t]}
        out += [k for t, k in enumerate(some) if t not in met]
    return out


def _reached(missed: int, trials: int, recall: float) -> bool:
    """Whether the lower 95 % bound of recall is at the target."""
    met = 1 - missed / trials
    return met - 1.65 * math.sqrt(max(met * (1 - met), 1 / trials) / trials) >= recall


def _hold_the_rest(index: Index, recall: float, trials: int, each: int, rng: np.random.Generator) -> None:
    """Puts among the items held exactly: every item missed in any of ``each`` trials on each part, and what fresh trials
    on the others miss, until these reach the target or none are left."""
    every = np.repeat(np.arange(len(index.items)), 3 * each)
    held = set(_missed(index, every, np.tile([0, 1, 2], len(index.items) * each), rng))
    while len(held) < len(index.items):
        rest = np.array([k for k in range(len(index.items)) if k not in held])
        missed = _missed(index, rng.choice(rest, trials), np.resize(PARTS, trials), rng)
        held |= set(missed)
        if _reached(len(missed), trials, recall):
            break
        if not missed:  # a target that so many trials can't show
            held = set(range(len(index.items)))
    index.scanned = sorted(held)


def build_index(ids: list[int | None], items: list[np.ndarray], rate: float, recall: float, most: int = 32, trials: int = 4000, each: int = 12) -> Index:
    """Adds repetitions, two at a time, until fresh trials reach ``recall``; beyond ``most`` the rest is held exactly."""
    where, limits = _anchors(items), [math.floor(rate * len(i)) for i in items]
    anchor_words = np.array([items[k][a] for k, a in where.tolist()], np.uint64)
    words = np.unique(anchor_words)
    index = Index(ids, items, limits, words, np.ones(len(words), np.int64), [], np.zeros(0, np.uint64), np.zeros((0, 2), np.int32), [], _item_words(items))
    rng = np.random.default_rng(3)
    while True:
        keys, entries = [index.keys], [index.entries]
        for repetition in (len(index.sizes), len(index.sizes) + 1):
            found, size = _item_keys(items, where, repetition)
            keys.append(found)
            entries.append(where.astype(np.int32))
            index.sizes.append(sorted(set(size.tolist())))
            np.maximum.at(index.reach, np.searchsorted(words, anchor_words), size)
        index.keys, index.entries = np.concatenate(keys), np.concatenate(entries)
        order = np.argsort(index.keys, kind="stable")
        index.keys, index.entries = index.keys[order], index.entries[order]
        missed = _missed(index, rng.integers(len(items), size=trials), np.resize(PARTS, trials), rng)
        if _reached(len(missed), trials, recall):
            return index
        if len(index.sizes) >= most:
            _hold_the_rest(index, recall, trials, each, rng)
            return index


def _candidates(index: Index, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items and the places in ``words`` where they would begin, that share a key, over texts laid end to end; distinct."""
    at = pc.index_in(pa.array(words), value_set=pa.array(index.anchors)).fill_null(-1).to_numpy()
    starts = np.flatnonzero(at >= 0)
    ends = np.cumsum(sizes)
    stop, reach = ends[np.searchsorted(ends, starts, side="right")], index.reach[at[starts]]
    items, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r, window in enumerate(index.sizes if len(starts) else []):
        steps = np.minimum(reach, max(window))
        for s, (going, keys) in _window_keys(words, starts, stop, r, steps, window)[0].items():
            low, high = np.searchsorted(index.keys, keys), np.searchsorted(index.keys, keys, side="right")
            n = high - low
            if hit := int(n.sum()):
                entry = index.entries[np.arange(hit) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
                items.append(entry[:, 0].astype(np.int64))
                places.append(np.repeat(starts[going], n) - entry[:, 1])
    both = np.unique(np.stack((np.concatenate(items), np.concatenate(places))), axis=1)
    return both[0], both[1]


def _stretches(index: Index, words: np.ndarray, sizes: np.ndarray) -> zip:
    """(item, text, first word, end word) of the candidates' stretches that hold all but the limit of the item's words; an
    item with less isn't within the limit."""
    item, place = _candidates(index, words, sizes)
    ends = np.cumsum(sizes)
    length, limit = np.array([len(i) for i in index.items])[item], np.array(index.limits)[item]
    # a candidate may begin in one text and reach into the next
    text = np.searchsorted(ends, np.maximum(place, 0), side="right")
    other = np.minimum(np.searchsorted(ends, np.minimum(place + limit, len(words) - 1), side="right"), len(ends) - 1)
    rows = np.concatenate((np.arange(len(item)), np.flatnonzero(other != text)))
    text = np.concatenate((text, other[other != text]))
    item, place, length, limit = item[rows], place[rows], length[rows], limit[rows]
    low, high = np.maximum(place - limit, ends[text] - sizes[text]), np.minimum(place + length + limit, ends[text])
    rows = np.flatnonzero(high > low)
    item, text, low, high, least = item[rows], text[rows], low[rows], high[rows], (length - limit)[rows]
    kept, known = np.zeros(len(rows), bool), pa.array(index.words)
    piece = np.cumsum(high - low) // LOOKED_UP
    for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(piece)) + 1) if len(rows) else []:
        n = (high - low)[part]
        first = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(low[part] - first, n)
        held = pc.is_in(pa.array(pair_hash(np.repeat(item[part], n).astype(np.uint64), words[at])), value_set=known)
        kept[part] = np.add.reduceat(held.to_numpy(zero_copy_only=False), first, dtype=np.int64) >= least[part]
    return zip(*(x[kept].tolist() for x in (item, text, low, high)), strict=True)


def edit_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the text, and where the first such stretch ends."""
    places = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for k, word in enumerate(item.tolist(), 1):
        new = np.empty_like(row)
        new[0] = k
        new[1:] = np.minimum(row[:-1] + (text != np.uint64(word)), row[1:] + 1)
        row = np.minimum.accumulate(new - places) + places
    end = int(np.argmin(row))
    return int(row[end]), end


def matches(index: Index, texts: list[bytes | None]) -> list[tuple[int, int, int, int, int]]:
    """(text, item id, distance, first word, end word) of the best stretch of each item that a text holds."""
    codes, hashes, sizes = coded(texts)
    words = hashes[codes]
    if not len(words):
        return []
    ends = np.cumsum(sizes)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for item, text, low, high in _stretches(index, words, sizes):
        first = index.items[item]
        distance, end = edit_match(first, words[low:high])
        if distance <= index.limits[item]:
            _, length = edit_match(first[::-1], words[low : low + end][::-1])
            start = low + end - length - int(ends[text] - sizes[text])
            this = (distance, start, low + end - int(ends[text] - sizes[text]))
            best[text, item] = min(best.get((text, item), this), this)
    for text, (stop, size) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
        for item in index.scanned if size else ():
            distance, end = edit_match(index.items[item], words[stop - size : stop])
            if distance <= index.limits[item]:
                _, length = edit_match(index.items[item][::-1], words[stop - size : stop - size + end][::-1])
                best[text, item] = min(best.get((text, item), (distance, end - length, end)), (distance, end - length, end))
    return [(text, index.ids[item], *found) for (text, item), found in sorted(best.items())]


def _indexes(benchmark: DataFrame, rate: float, recall: float):
    """An index of each block of items."""
    ids, items = [], []
    for row in benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        words = tokens([row["text"].encode()])[1][:-1]
        if len(words):
            ids.append(row["item_id"])
            items.append(words)
        if len(items) == ITEMS:
            yield build_index(ids, items, rate, recall)
            ids, items = [], []
    if items:
        yield build_index(ids, items, rate, recall)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, recall: float = 0.99) -> DataFrame:
    """doc_id, item_id, distance, start_word, end_word: the best stretch for each document and item within the rate."""
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spec = "doc_id long, item_id long, distance int, start_word long, end_word long"
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())

    def held_against(index: Index) -> DataFrame:
        def run(batches):
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[t], *rest) for t, *rest in matches(index, batch.column("text").cast(pa.binary()).to_pylist())] if ids else []
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in spec.split(", ")])

        return plain.mapInArrow(tidied(run), spec)

    out = None
    for index in _indexes(benchmark, rate, recall):
        found = held_against(index)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], spec) if out is None else out


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, recall: float = 0.99) -> DataFrame:
    """The rows of ``docs`` whose own text holds no item, with all their columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def without(index: Index) -> DataFrame:
        def run(batches):
            for batch in batches:
                hit = {t for t, *_ in matches(index, batch.column(at).cast(pa.binary()).to_pylist())} if batch.num_rows else set()
                yield batch.filter(pa.array([t not in hit for t in range(batch.num_rows)], pa.bool_()))

        return docs.mapInArrow(tidied(run), docs.schema)

    for index in _indexes(benchmark, rate, recall):
        docs = without(index)
    return docs
