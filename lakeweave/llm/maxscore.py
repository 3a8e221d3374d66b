"""Exact top-k search by inner product with MaxScore over sharded postings.

A term is a dimension; its posting list holds every vector's integer component there. Lists are kept by shard, each with
the greatest and least component, so a shard bounds what a query's term can add to any of its vectors.

1. Vectors are dealt into shards of term-major postings, written once. A row is named by its shard and its place there.
2. The rows asked for become blocks of queries, in passes of at most ``PASS_BYTES``, the only thing that is broadcast.
3. One shard gives every query its first floor: the k-th best score there, under which nothing can be among the best.
4. For each shard and query, terms are put in order of their bounds. The longest run of least terms whose bounds sum to
   less than the floor is non-essential: a vector that scores in none of the others can't be competitive. Essential
   postings are traversed for all vectors; the others are probed, greatest bound first, for vectors whose partial score and
   remaining bounds still reach the floor. The floor rises with the k best that the task has seen.
5. A task passes on its k best of each query; the shards' lists are merged by rank.

What is shuffled grows with tasks and queries. Ties go to the smaller id, then to either row. Rows with a null id, a null
vector, or a null or non-finite component take no part, neither as queries nor as candidates. Vectors of different lengths
are multiplied over the dimensions that both have; an empty one scores 0. A repeated row is a row: of two rows with one id,
each is a candidate of the other. A score beyond a long counts as the nearest long. An empty table has no results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import shared_dir, small_batches, tidied, written

#: Components in a shard and in a block of queries: 8,192 and 1,024 vectors of 64 dimensions.
SHARD_CELLS, BLOCK_CELLS = 1 << 19, 1 << 16
#: Bytes of queries (8 a component) that a pass may broadcast: 32,768 queries of 64 dimensions.
PASS_BYTES = 1 << 24
#: Terms probed between two looks at what is still competitive.
PROBED = 8
NONE = np.iinfo(np.int64).min

_SHARD = StructType([StructField("lane", IntegerType()), StructField("shard", LongType()), StructField("n", IntegerType()), StructField("dims", IntegerType()), StructField("kind", IntegerType())] + [StructField(c, BinaryType()) for c in ("ids", "asked", "postings", "bounds")])
_BLOCK = StructType([StructField("lane", IntegerType()), StructField("pass", IntegerType()), StructField("block", LongType())] + [StructField(c, BinaryType()) for c in ("query_ids", "shards", "places", "sizes", "weights", "floors")])
_MET = _BLOCK.fieldNames() + ["shard", "n", "dims", "kind", "ids", "postings", "bounds"]
_KINDS = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<f8"))


def _rows(arrow: pa.RecordBatch, schema: StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(arrow, names=schema.fieldNames())


def _written(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, for rows of about a megabyte: few of them in a row group, as a scan decodes a group at a time."""
    path = shared_dir(df.sparkSession, name)
    df.write.options(**{"compression": "zstd", "parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "4"}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _kept(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """ids, asked and integer components (as doubles) of the rows that take part."""
    column = batch.column(2)
    if batch.num_rows and not batch.column(0).null_count and not column.null_count and not column.flatten().null_count:
        lengths = column.value_lengths().to_numpy()
        if (lengths == lengths[0]).all():  # the usual case: one matrix
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lengths), lengths[0])
            with np.errstate(over="ignore", invalid="ignore"):
                w = np.floor(scale * x)
            whole = np.isfinite(x).all(axis=1) & np.isfinite(w).all(axis=1)
            return batch.column(0).to_numpy()[whole], batch.column(1).to_numpy(zero_copy_only=False)[whole], list(w[whole])
    ids, asked, vectors = [], [], []
    for key, wanted, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
        if key is None or not vector.is_valid or vector.values.null_count:
            continue
        x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(over="ignore"):
            w = np.floor(scale * x)
        if np.isfinite(x).all() and np.isfinite(w).all():
            ids.append(key)
            asked.append(bool(wanted))
            vectors.append(w)
    return np.array(ids, np.int64), np.array(asked, np.bool_), vectors


def shards(vectors: DataFrame, asked: Column, item: str, column: str, scale: float) -> DataFrame:
    """The vectors as written shards of term-major postings; ``asked`` marks the queries among them."""
    small_batches(vectors.sparkSession)

    def deal(batches):
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[int, bool, np.ndarray]] = []
        cells = 0

        def shard() -> pa.RecordBatch:
            dims = max(len(v) for _, _, v in held)
            if all(len(v) == dims for _, _, v in held):
                postings = np.array([v for _, _, v in held]).T
            else:
                postings = np.zeros((dims, len(held)))
                for k, (_, _, v) in enumerate(held):
                    postings[: len(v), k] = v
            most = np.abs(postings).max(initial=0)
            kind = 0 if most < 1 << 15 else 1 if most < 1 << 31 else 2
            bounds = np.stack((postings.max(axis=1), postings.min(axis=1))) if dims else np.zeros((2, 0))
            packed = [np.array([k for k, _, _ in held], "<i8"), np.array([a for _, a, _ in held], np.bool_), np.ascontiguousarray(postings, _KINDS[kind]), bounds.astype("<f8")]
            numbers = [pa.array([0], pa.int32()), pa.array([base + n], pa.int64()), *(pa.array([x], pa.int32()) for x in (len(held), dims, kind))]
            return _rows(numbers + [pa.array([x.tobytes()], pa.binary()) for x in packed], _SHARD)

        for batch in batches:
            for row in zip(*_kept(batch, scale), strict=True):
                held.append(row)
                cells = max(cells, len(row[2]) * len(held), len(held))
                if cells >= SHARD_CELLS:
                    yield shard()
                    held, cells, n = [], 0, n + 1
        if held:
            yield shard()

    plain = vectors.select(F.col(item).cast("long"), F.coalesce(asked, F.lit(False)), F.col(column).cast("array<double>"))
    return _written(plain.mapInArrow(tidied(deal), _SHARD), "shards")


def _postings(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["postings"], _KINDS[row["kind"]]).reshape(row["dims"], row["n"])


def query_blocks(dealt: DataFrame) -> tuple[DataFrame, int]:
    """The rows asked for, in written blocks that carry their pass; and the number of passes."""
    single = StructType([StructField("query_id", LongType()), StructField("shard", LongType()), StructField("place", IntegerType()), StructField("weights", BinaryType())])

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                places = np.flatnonzero(np.frombuffer(row["asked"], np.bool_))
                if len(places):
                    ids, postings = _postings(row)
                    weights = np.ascontiguousarray(postings[:, places].T, "<f8")
                    yield _rows([pa.array(ids[places]), pa.array([row["shard"]] * len(places), pa.int64()), pa.array(places.astype(np.int32)), pa.array([w.tobytes() for w in weights], pa.binary())], single)

    def block(batches):
        from pyspark import TaskContext

        number, count, held, cells = TaskContext.get().partitionId(), 0, [], 0

        def filled() -> pa.RecordBatch:
            packed = [np.array([r[c] for r in held], t) for c, t in (("query_id", "<i8"), ("shard", "<i8"), ("place", "<i4"))]
            packed.append(np.array([len(r["weights"]) // 8 for r in held], "<i4"))
            columns = [pa.array([x.tobytes()], pa.binary()) for x in packed] + [pa.array([b"".join(r["weights"] for r in held)], pa.binary()), pa.array([b""], pa.binary())]
            return _rows([pa.array([0], pa.int32()), pa.array([number], pa.int32()), pa.array([(number << 32) + count], pa.int64()), *columns], _BLOCK)

        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                cells += max(1, len(row["weights"]) // 8)
                if cells >= BLOCK_CELLS:
                    yield filled()
                    held, cells, count = [], 0, count + 1
        if held:
            yield filled()

    singles = written(dealt.mapInArrow(tidied(ask), single), "asked")
    n = singles.count()
    dims = dealt.agg(F.coalesce(F.max("dims"), F.lit(1))).first()[0]
    passes = -(-n * 8 * max(dims, 1) // PASS_BYTES)
    return _written(singles.repartition(max(passes, 1)).mapInArrow(tidied(block), _BLOCK), "blocks"), passes


class _Block:
    """A block of queries and the best that this task has seen of each."""

    def __init__(self, row: dict, k: int):
        sizes = np.frombuffer(row["sizes"], "<i4")
        self.ids, self.shards, self.places = np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["shards"], "<i8"), np.frombuffer(row["places"], "<i4")
        self.weights = np.zeros((len(sizes), int(sizes.max(initial=0))))
        flat, at = np.frombuffer(row["weights"], "<f8"), 0
        for k_, size in enumerate(sizes.tolist()):
            self.weights[k_, :size] = flat[at : at + size]
            at += size
        self.k, n = k, len(sizes)
        self.norm = float(np.sqrt(np.square(self.weights).sum(axis=1)).max(initial=0))
        self.floors = np.frombuffer(row["floors"], "<i8") if row["floors"] else np.full(n, NONE)
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.found: list[np.ndarray] = [np.zeros(0, np.int64)] * n

    def floor(self, q: int) -> int:
        seen = self.scores[q]
        return max(int(self.floors[q]), int(seen[-1]) if len(seen) == self.k else NONE)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:  # all that reach the k-th score; ties are parted by id below
            near = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[near], ids[near]
        scores, ids = np.concatenate((self.scores[q], scores)), np.concatenate((self.found[q], ids))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[q], self.found[q] = scores[order], ids[order]

    def meet(self, shard: int, ids: np.ndarray, postings: np.ndarray, bounds: np.ndarray) -> None:
        dims = min(self.weights.shape[1], len(postings))
        weights, rows = self.weights[:, :dims], postings[:dims]
        # any sum over some of the terms is at most the product of the norms: below 2**24 exact in single precision
        norm = self.norm * float(np.sqrt(np.square(rows, dtype=np.float64).sum(axis=0)).max(initial=0))
        if norm >= 2**52:
            return self._meet_exactly(shard, ids, weights, rows)
        number = np.float32 if norm < 2**23 else np.float64
        weights, rows = weights.astype(number), rows.astype(number)
        upper = np.maximum(np.maximum(self.weights[:, :dims] * bounds[0, :dims], self.weights[:, :dims] * bounds[1, :dims]), 0)
        order = np.argsort(upper, axis=1, kind="stable")
        reach = np.cumsum(np.take_along_axis(upper, order, axis=1), axis=1)
        for q in range(len(self.ids)):
            got = competitive(weights[q], rows, order[q], reach[q], self.floor(q))
            if got is None:
                continue
            alive, scores = got
            if self.shards[q] == shard:
                other = alive != self.places[q]
                alive, scores = alive[other], scores[other]
            if len(alive):
                self.add(q, scores.astype(np.int64), ids[alive])

    def _meet_exactly(self, shard: int, ids: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> None:
        """For components so large that doubles can't hold the sums: whole numbers of any size, all terms essential."""
        whole = np.array([[int(x) for x in row] for row in rows.tolist()], object).reshape(rows.shape)
        for q in range(len(self.ids)):
            scores = np.zeros(len(ids), object)
            for d, w in enumerate(weights[q].tolist()):
                scores = scores + int(w) * whole[d]
            kept = np.array([k for k in range(len(ids)) if self.shards[q] != shard or k != self.places[q]], np.int64)
            self.add(q, np.array([min(max(s, NONE + 1), -(NONE + 1)) for s in scores[kept]], np.int64), ids[kept])


def competitive(weights: np.ndarray, rows: np.ndarray, order: np.ndarray, reach: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Places and whole scores of the shard's vectors that reach the floor; None if none can.

    ``order`` lists the terms by rising bound, ``reach`` is the running sum of those bounds.
    """
    spare = int(np.searchsorted(reach, floor, "left"))  # terms whose bounds sum to less than the floor
    if len(order) and spare == len(order):
        return None
    if not len(order) and floor > 0:
        return None
    essential = order[spare:]
    scores = weights[essential] @ rows[essential]
    if not spare:
        alive = np.flatnonzero(scores >= floor)
        return alive, scores[alive]
    alive = np.flatnonzero(scores >= floor - reach[spare - 1])
    scores = scores[alive]
    while spare and len(alive):
        least = max(spare - PROBED, 0)
        terms = order[least:spare]
        scores = scores + weights[terms] @ rows[np.ix_(terms, alive)]
        still = scores >= floor - (reach[least - 1] if least else 0)
        alive, scores, spare = alive[still], scores[still], least
    return alive, scores


def _met(batches, k: int):
    """The blocks of a task after they have met all of its shards."""
    blocks: dict[int, _Block] = {}
    rows: dict[int, dict] = {}
    last, opened = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] not in blocks:
                blocks[row["block"]] = _Block(row, k)
                rows[row["block"]] = {c: row[c] for c in _BLOCK.fieldNames()}
            if row["shard"] != last:
                last, opened = row["shard"], (*_postings(row), np.frombuffer(row["bounds"], "<f8").reshape(2, row["dims"]))
            blocks[row["block"]].meet(row["shard"], *opened)
    return blocks, rows


def _with_floors(blocks: DataFrame, dealt: DataFrame, k: int) -> DataFrame:
    """The blocks with each query's k-th best score in one shard, the largest: each block meets that shard alone."""
    first = dealt.orderBy(F.desc("n"), "shard").limit(1)

    def run(batches):
        met, rows = _met(batches, k)
        for key, block in met.items():
            floors = np.array([block.floor(q) for q in range(len(block.ids))], "<i8")
            row = rows[key] | {"floors": floors.tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema=to_arrow_schema(_BLOCK))

    return _written(blocks.join(F.broadcast(first), "lane").select(*_MET).mapInArrow(tidied(run), _BLOCK), "floors")


def search(vectors: DataFrame, asked: Column, k: int, item: str = "vec_id", column: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """Of every row of ``vectors`` for which ``asked`` is true, its ``k`` best other rows by integer inner product of
    floor(``scale`` * component): query_id, rank (int, from 1), ``item``, score (long)."""
    spark = vectors.sparkSession
    spec = f"query_id long, query_shard long, query_place int, `{item}` long, score long"
    dealt = shards(vectors, asked, item, column, scale)
    blocks, passes = query_blocks(dealt)
    if not passes:
        return spark.createDataFrame([], f"query_id long, rank int, `{item}` long, score long")
    blocks = _with_floors(blocks, dealt, k)

    def run(batches):
        for block in _met(batches, k)[0].values():
            n = [len(s) for s in block.scores]
            columns = [np.repeat(block.ids, n), np.repeat(block.shards, n), np.repeat(block.places, n), np.concatenate(block.found), np.concatenate(block.scores)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "query_shard", "query_place", item, "score"])

    folder = shared_dir(spark, "best")
    for number in range(passes):
        met = dealt.join(F.broadcast(blocks.where(F.col("pass") == number)), "lane").select(*_MET)
        met.mapInArrow(tidied(run), spec).write.mode("append").option("compression", "zstd").parquet(folder)
    best = spark.read.schema(spec).parquet(folder)
    order = Window.partitionBy("query_shard", "query_place").orderBy(F.desc("score"), item)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", item, "score")
