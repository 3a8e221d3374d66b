"""Jaccard self-join of documents on word n-grams: MinHash bands for candidates, full n-gram sets to verify.

1. Each document's set of word 5-grams gives a set key, and one hash for each band of its MinHash signature. Bands and
   rows are chosen so that a pair at the threshold is met with the target recall.
2. Documents with equal sets are one text class. Classes that share a band hash are joined to the least of their bucket
   (stars, not pairs), and the components of those edges hold every candidate pair.
3. Only classes in components of two or more are read again, by the rows with their least id whose set key, computed
   anew, is theirs: an id may stand on several texts, or be null. A component of at most ``BLOCK`` classes meets in one
   block. A larger one meets as a whole, in blocks of ``BLOCK`` by ``BLOCK``, or bucket by bucket, whichever takes fewer
   blocks: texts that only hang together through chains of chance collisions needn't all meet. A pair that shares several
   buckets is counted in the one of its first band; buckets of the same classes are one. A block counts the links of each
   class by products of membership matrices and passes on one row for each class: its links there and the least class that
   it hangs together with. No pair leaves a task.
4. Components of those rows give the class ids.

A text of fewer than five words has one n-gram, all its words; an empty or null text has none, links to nothing and is
its own class. Case is folded for A-Z. Repeated rows are documents of one class. Links count linked documents, equal
texts among them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import free_name, small_batches, tidied, without_ids, written
from .components import connected_components
from .kneser_ney import tokens

BLOCK = 256
#: Candidate rows up to this number (about 300 bytes each at most) are broadcast to the texts; more are joined by shuffle.
BROADCAST_ROWS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows for which ``recall`` at the threshold needs at most ``most`` hashes."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1) if threshold < 1 else (1, 1)
    for rows in range(2, 17):
        met = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - met)) if met < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def ngram_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit n-gram hashes of each text."""
    _, w, m = tokens(texts)
    out = []
    for start, stop in zip((np.cumsum(m) - m).tolist(), (np.cumsum(m) - 1).tolist(), strict=True):
        words = w[start:stop]
        size = min(n, len(words))
        h = np.full(max(len(words) - size + 1, 0) if size else 0, np.uint64(size))
        for k in range(size):
            h = (h ^ (h >> np.uint64(31))) * _MIX + words[k : k + len(h)]
        out.append(np.unique((h ^ (h >> np.uint64(29))) * _MIX))
    return out


def _set_key(grams: np.ndarray) -> int | None:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).view(np.int64)) if len(grams) else None


def _band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A row of band hashes (int64) for each set; sets must not be empty."""
    flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    odd = np.random.default_rng(11).integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sets), np.uint64(b))
        for r in range(rows):
            h = (h ^ (h >> np.uint64(30))) * _MIX + np.minimum.reduceat(flat * odd[b * rows + r], at)
        out[:, b] = h ^ (h >> np.uint64(32))
    return out.view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, set_key (null: no n-gram), n_grams, bands of every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sets = ngram_sets(batch.column("text").cast(pa.binary()).to_pylist(), n) if batch.num_rows else []
            full = [k for k, s in enumerate(sets) if len(s)]
            hashes: list = [None] * len(sets)
            if full:
                for k, row in zip(full, _band_hashes([sets[k] for k in full], bands, rows).tolist(), strict=True):
                    hashes[k] = row
            columns = [batch.column("doc_id"), pa.array([_set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "set_key", "n_grams", "bands"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(tidied(run), "doc_id long, set_key long, n_grams long, bands array<long>")


def _candidates(classes: DataFrame) -> DataFrame:
    """(node, root) of the components of band collisions: stars to the least class of each bucket."""
    met = classes.select("set_key", F.posexplode("bands").alias("band", "hash"))
    buckets = met.groupBy("band", "hash").agg(F.min("set_key").alias("least"), F.max("set_key").alias("most")).where("least <> most")
    stars = met.join(buckets.select("band", "hash", "least"), ["band", "hash"]).where("set_key <> least")
    return connected_components(stars.select(F.col("set_key").alias("u"), F.col("least").alias("v")).distinct())


def _links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix: whether the Jaccard similarity of two sets is at least ``threshold``."""
    sizes = np.array([len(s) for s in sets])
    owner, grams = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    grams, column, n = np.unique(grams, return_inverse=True, return_counts=True)
    shared = n[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 1 << 14
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (first, first + width))
        has = np.zeros((len(sets), min(width, int(column[-1]) + 1 - first)), np.float32)
        has[owner[a:b], column[a:b] - first] = 1
        both += has @ has.T
    linked = both >= np.float64(threshold) * (sizes[:, None] + sizes[None, :] - both.astype(np.float64)) - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    """The least index that each index hangs together with."""
    root = np.arange(len(linked))
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root)))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _keyed(docs: DataFrame, n: int, once: bool = False, name: str = "set_key") -> DataFrame:
    """``docs`` with the set key of each row (column ``name``); with ``once``, a task passes on one row of each (doc_id, set_key)."""
    small_batches(docs.sparkSession)

    def run(batches):
        seen = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [_set_key(s) for s in ngram_sets(batch.column("text").cast(pa.binary()).to_pylist(), n)]
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, name])
            if once:
                pairs = list(zip(batch.column("doc_id").to_pylist(), keys, strict=True))
                new = [pair not in seen and not seen.add(pair) for pair in pairs]
                out = out.filter(pa.array(new, pa.bool_()))
            yield out

    return docs.mapInArrow(tidied(run), StructType([*docs.schema.fields, StructField(name, LongType())]))


def _verified(blocks: DataFrame, threshold: float, n: int) -> DataFrame:
    """From rows sorted by block: of each class of a block, its links there and its root there."""
    key = ("comp", "band", "hash", "one", "two")

    def run(batches):
        held: dict[int, tuple] = {}

        def finish(band: int):
            pairs = sorted(zip(held, ngram_sets([x[3] for x in held.values()], n), strict=True), key=lambda x: x[0])
            keys = [k for k, _ in pairs]
            copies, side = np.array([held[k][0] for k in keys]), np.array([held[k][1] for k in keys])
            linked = _links([s for _, s in pairs], threshold)
            if (side == 1).any():
                linked &= side[:, None] != side[None, :]
            for earlier in np.array([held[k][2][: max(band, 0)] for k in keys], np.int64).T:
                linked &= earlier[:, None] != earlier[None, :]  # counted in the bucket of that band
            roots = [keys[r] for r in _roots(linked)]
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(roots), pa.array(linked @ copies), pa.array(linked.sum(axis=1))], names=["set_key", "root", "n_links", "n_text_links"])

        at = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*key, "set_key", "copies", "side", "bands")]
            for *block, set_key, copies, side, bands, text in zip(*columns, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if block != at:
                    if held:
                        yield finish(at[1])
                    held.clear()
                    at = block
                held.setdefault(set_key, (copies, side, bands or [], text))  # a class may be there from several rows
        if held:
            yield finish(at[1])

    return blocks.mapInArrow(tidied(run), "set_key long, root long, n_links long, n_text_links long")


def _groups(member: DataFrame, classes: DataFrame) -> DataFrame:
    """Which classes meet: set_key, comp, band (-1: the whole component), hash, parts, bands (null for whole components)."""
    parts = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    large = written(member.groupBy("comp").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BLOCK), "large-components")
    whole = F.lit(-1).alias("band"), F.lit(0).cast("long").alias("hash")
    number = large.count()
    sized = member.join(F.broadcast(large) if number <= BROADCAST_ROWS else large, "comp", "left")
    if not number:
        return sized.select("set_key", "comp", *whole, F.lit(1).alias("parts"), F.lit(None).cast("array<bigint>").alias("bands"))
    met = sized.where("size IS NOT NULL").select("set_key", "comp").join(classes.select("set_key", "bands"), "set_key")
    met = written(met.select("set_key", "comp", "bands", F.posexplode("bands").alias("band", "hash")), "bucket-rows")
    buckets = met.groupBy("comp", "band", "hash").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("set_key")).alias("x"), F.sum(F.xxhash64("set_key", F.lit(1)) % 1_000_000_007).alias("y")).where("size > 1")
    first = buckets.groupBy("comp", "size", "x", "y").agg(F.min_by(F.struct("band", "hash"), "band").alias("b")).select("comp", "b.band", "b.hash", parts.alias("parts"))
    first = written(first, "buckets")
    cost = first.groupBy("comp").agg(F.sum(F.col("parts").cast("double") * F.col("parts")).alias("cost"))
    split = written(large.join(cost, "comp").where(F.col("cost") < parts.cast("double") * parts).select("comp"), "split-components")
    in_buckets = met.join(first.join(split, "comp", "left_semi"), ["comp", "band", "hash"]).select("set_key", "comp", "band", "hash", "parts", "bands")
    rest = sized.join(split, "comp", "left_anti").select("set_key", "comp", *whole, F.coalesce(parts, F.lit(1)).alias("parts"), F.lit(None).cast("array<bigint>").alias("bands"))
    return rest.unionByName(in_buckets)


def _joined(docs: DataFrame, threshold: float, n: int, recall: float) -> DataFrame:
    """What ``jaccard_join`` returns, and of every row its set_key and head (whether its class of equal sets is the one
    that stands for all that hang together: it has the least doc_id, then the least set_key)."""
    bands, rows = choose_bands(threshold, recall)
    signed = written(signatures(docs, n, bands, rows), "signatures")
    classes = signed.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    classes = written(classes, "text-classes")
    tree = _candidates(classes)
    member = tree.select(F.col("node").alias("set_key"), F.col("root").alias("comp")).unionByName(tree.select(F.col("root").alias("set_key"), F.col("root").alias("comp")).distinct())
    # a class's part of its group is a hash of it: no window over a group is needed
    found = _groups(member, classes).join(classes.select("set_key", "rep", "copies"), "set_key").withColumn("part", F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int"))
    found = written(found, "candidates")
    keep = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    few = found.count() <= BROADCAST_ROWS
    reps = found.select(F.col("rep").alias("doc_id")).distinct()
    read = keep.join(F.broadcast(reps) if few else reps, keep["doc_id"].eqNullSafe(reps["doc_id"]), "left_semi")
    read = _keyed(read, n, once=True)
    texts = read.join(F.broadcast(found) if few else found, (read["set_key"] == found["set_key"]) & read["doc_id"].eqNullSafe(found["rep"])).drop(read["set_key"])
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    group = ("comp", "band", "hash", "one", "two")
    paired = texts.select("comp", "band", "hash", "part", "set_key", "copies", "bands", "text", other)
    blocks = paired.withColumns({"one": F.least("part", "other"), "two": F.greatest("part", "other"), "side": (F.col("part") > F.col("other")).cast("int")}).drop("part", "other")
    blocks = blocks.repartition(*group).sortWithinPartitions(*group)
    links = written(_verified(blocks, threshold, n), "links")
    tree = connected_components(links.select(F.col("set_key").alias("u"), F.col("root").alias("v")))
    counted = links.groupBy("set_key").agg(F.sum("n_links").alias("n_links"), F.sum("n_text_links").alias("n_text_links"))
    rooted = classes.select("set_key", "rep", "copies").join(tree.withColumnRenamed("node", "set_key"), "set_key", "left").join(counted, "set_key", "left")
    rooted = rooted.select("set_key", "rep", "copies", F.coalesce("root", "set_key").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"))
    rooted = written(rooted, "rooted")
    first = F.min_by("set_key", F.struct(F.col("rep").isNull(), "rep", "set_key"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("class_id"), first.alias("head"))
    known = rooted.join(least, "root").select("set_key", "class_id", (F.col("set_key") == F.col("head")).alias("head"), (F.col("n_links") + F.col("copies") - 1).alias("n_links"), "n_text_links")
    return signed.select("doc_id", "set_key", "n_grams").join(known, "set_key", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("n_text_links", F.lit(0).cast("long")).alias("n_text_links"), "n_grams", "set_key", "head"
    )


def jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999) -> DataFrame:
    """Of every row: doc_id, class_id (the least doc_id of all documents that hang together by links), n_links (linked
    documents), n_text_links (linked different texts), n_grams."""
    return _joined(docs, threshold, n, recall).drop("set_key", "head")


def one_of_each(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999) -> DataFrame:
    """The rows of ``docs`` whose document is the least of its class, one row for each; all columns kept."""
    joined = _joined(docs, threshold, n, recall)
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    odd = written(odd.select(F.col("doc_id").alias("_odd")), "odd-ids")
    if odd.isEmpty():
        return without_ids(docs, joined.where("class_id <> doc_id").select("doc_id"))
    # null ids and ids on several rows don't say which row is meant: those rows are told apart by set key as well
    once = without_ids(docs.join(odd, docs["doc_id"].eqNullSafe(odd["_odd"]), "left_anti"), joined.where("class_id <> doc_id").select("doc_id"))
    heads = joined.where("head AND doc_id <=> class_id").select(F.col("doc_id").alias("_rep"), F.col("set_key").alias("_head"))
    heads = written(heads.join(odd, F.col("_rep").eqNullSafe(F.col("_odd")), "left_semi").distinct(), "heads")
    name = free_name("set_key", docs.columns)
    several = _keyed(docs.join(odd, docs["doc_id"].eqNullSafe(odd["_odd"]), "left_semi"), n, name=name)
    key = several[name]
    stay = several.join(heads, (key == heads["_head"]) & several["doc_id"].cast("long").eqNullSafe(heads["_rep"]), "left_semi").unionByName(several.where(key.isNull()))
    # an empty text is its own class: only rows with the same id and text are one
    alone = F.when(F.col(name).isNull(), F.col("text"))
    row = F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.coalesce("text", F.lit("")))
    return once.unionByName(stay.groupBy(F.col("doc_id").alias("a"), F.col(name).alias("b"), alone.alias("c")).agg(row.alias("d")).select("d.*"))
