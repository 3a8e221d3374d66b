"""An inverted file over vectors: every vector filed under its nearest cells, probes by join, exact scores.

Cells are spherical k-means centroids, fitted on at most ``SAMPLE`` vectors (those with the least hash of their id). All
vectors are filed, each under its ``copies`` nearest cells, as blocks of at most ``BLOCK`` vectors in a table partitioned by
cell; a cell with many vectors is spread over files. A search sends each query to its ``probes`` nearest cells and scores
it against every vector there, block by block, so no pair leaves a task but a block's best ``k``. Passes go by cell: each
reads the partitions of its own cells alone and broadcasts at most ``PASS_ROWS`` queries.

``probes`` is chosen by measured recall: for a bounded sample of queries the exact search says in which cell each true
neighbour lies, and the fewest cells that reach the target (by the lower 95 % bound) are probed. With all cells the search
is exact. Null vectors and ids take no part; a vector of length 0 has score 0 with all; ids are unique.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from ..sources.shared import shared_dir, written
from .retrieval import STRIPE, _matrix, _unit, nearest, ranked

SAMPLE, BLOCK, PASS_ROWS = 16_384, 2_048, 65_536
_FILED = "cell int, id long, vector array<double>"
_BLOCKS = "cell int, n int, ids binary, vectors binary"


@dataclass
class Index:
    """The blocks (cell, n, ids, vectors), the centroids, and how many cells a search probes."""

    blocks: DataFrame
    centroids: np.ndarray
    copies: int
    probes: int


def fit_cells(items: DataFrame, cells: int, item: str, column: str, rounds: int = 12) -> np.ndarray:
    """Unit centroids of at most ``cells`` cells, from a bounded sample."""
    sample = items.where(F.col(column).isNotNull() & F.col(item).isNotNull()).orderBy(F.xxhash64(item), item).limit(SAMPLE)
    rows = _unit(np.array([r[0] for r in sample.select(F.col(column).cast("array<double>")).collect()], np.float64))
    _, first = np.unique(rows.round(9), axis=0, return_index=True)
    centroids = rows[np.sort(first)[:cells]]
    for _ in range(rounds):
        own = np.argmax(rows @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        filled = np.bincount(own, minlength=len(centroids)) > 0
        centroids = np.where(filled[:, None], _unit(sums), centroids)
    return centroids


def _nearest_cells(vectors: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(-np.round(vectors @ centroids.T, 12), axis=1, kind="stable")[:, :n]


def _filed(rows: DataFrame, key: str, column: str, centroids: np.ndarray, n: int) -> DataFrame:
    """A row for each vector and each of its ``n`` nearest cells, written."""
    ship_package(rows.sparkSession)
    plain = rows.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long"), F.col(column).cast("array<double>"))

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, STRIPE):
                part = batch.slice(first, STRIPE)
                cells = _nearest_cells(_unit(_matrix(part.column(1))), centroids, n)
                at = pa.array(np.repeat(np.arange(part.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), part.column(0).take(at), part.column(1).take(at)], names=["cell", "id", "vector"])

    return written(plain.mapInArrow(run, _FILED), "filed")


def _in_blocks(filed: DataFrame, sizes: dict[int, int], size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors of one cell; cells are dealt over tasks by ``size`` rows, so none fills a task."""
    parts = filed.sparkSession.createDataFrame([(c, max(1, -(-n // size))) for c, n in sizes.items()], "cell int, parts long")
    dealt = filed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))

    def run(batches):
        held, cell = [], None

        def block():
            ids, vectors = np.array([i for i, _ in held], "<i8"), np.array([v for _, v in held], "<f8")
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([len(held)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], names=["cell", "n", "ids", "vectors"])

        for batch in batches:
            for c, i, v in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and (c != cell or len(held) == size):
                    yield block()
                    held = []
                cell = c
                held.append((i, v))
        if held:
            yield block()

    return dealt.repartition("cell", "part").sortWithinPartitions("cell", "part").select("cell", "id", "vector").mapInArrow(run, _BLOCKS)


def _sizes(filed: DataFrame) -> dict[int, int]:
    """Rows of each cell: as many entries as cells."""
    return {r["cell"]: r["count"] for r in filed.groupBy("cell").count().collect()}


def build(items: DataFrame, cells: int | None = None, copies: int = 2, target: float = 0.95, k: int = 10, item: str = "vec_id", column: str = "embedding") -> Index:
    """Files every vector and measures how many cells a search must probe for the target recall.

    ``cells``: by default the square root of the number of vectors, 1,024 at most.
    """
    if cells is None:
        cells = max(1, min(1024, math.isqrt(items.count())))
    centroids = fit_cells(items, cells, item, column)
    filed = _filed(items, item, column, centroids, copies)
    blocks = written(_in_blocks(filed, _sizes(filed), BLOCK), "index", by="cell", **{"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "4"})
    return Index(blocks, centroids, copies, _probes(items, centroids, copies, target, k, item, column))


def _probes(items: DataFrame, centroids: np.ndarray, copies: int, target: float, k: int, item: str, column: str, sample: int = 256) -> int:
    """The fewest cells whose recall on a sample of queries reaches the target by its lower 95 % bound."""
    asked = items.where(F.col(column).isNotNull() & F.col(item).isNotNull()).orderBy(F.xxhash64(item, F.lit(7)), item).limit(sample).select(F.col(item).alias("_query"), F.col(column).alias("_asked"))
    true = nearest(items, asked.withColumnRenamed("_asked", column), k, item, "_query", column)
    pairs = true.join(items.select(item, F.col(column).cast("array<double>").alias("_found")), item).join(asked, "_query").select("_asked", "_found").collect()
    if not pairs:
        return len(centroids)
    order = _nearest_cells(_unit(np.array([p["_asked"] for p in pairs], np.float64)), centroids, len(centroids))
    own = _nearest_cells(_unit(np.array([p["_found"] for p in pairs], np.float64)), centroids, copies)
    first = np.min([np.argmax(order == own[:, [c]], axis=1) for c in range(own.shape[1])], axis=0)
    n = len(pairs)
    for probes in range(1, len(centroids) + 1):
        recall = float(np.mean(first < probes))
        if recall - 1.645 * math.sqrt(recall * (1 - recall) / n) >= target:
            return probes
    return len(centroids)


def _passes(sizes: dict[int, int]) -> list[tuple[list[int], int, int]]:
    """(cells, part, of parts): cells in order, of at most ``PASS_ROWS`` queries together; a cell with more is cut in parts."""
    out, cells, held = [], [], 0
    for cell, n in sorted(sizes.items()):
        if n > PASS_ROWS:
            parts = -(-n // PASS_ROWS)
            out += [([cell], part, parts) for part in range(parts)]
            continue
        if held + n > PASS_ROWS:
            out.append((cells, 0, 1))
            cells, held = [], 0
        cells, held = [*cells, cell], held + n
    return [*out, (cells, 0, 1)] if cells else out


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, item: str = "vec_id", query: str = "query_id", column: str = "embedding") -> DataFrame:
    """query, item, score (cosine, to 9 places), rank of each query's best ``k`` in the cells it probes; not its own id."""
    spark = queries.sparkSession
    filed = _filed(queries, query, column, index.centroids, probes or index.probes)
    spec = f"{query} long, {item} long, score double"

    def run(batches):
        for batch in batches:
            for k_row in range(batch.num_rows):  # a row holds two blocks: one at a time
                row = batch.slice(k_row, 1).to_pylist()[0]
                ids, asked = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["asked_ids"], "<i8")
                rows, own = (_unit(np.frombuffer(row[c], "<f8").reshape(len(i), -1)) for c, i in (("vectors", ids), ("asked", asked)))
                scores = np.round(own @ rows.T, 9)
                scores[asked[:, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                best = np.take_along_axis(scores, order, axis=1)
                q, at = np.nonzero(best > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(ids[order[q, at]]), pa.array(best[q, at])], names=[query, item, "score"])

    folder = shared_dir(spark, "found")
    spark.createDataFrame([], spec).write.parquet(folder)
    for cells, part, parts in _passes(_sizes(filed)):
        mine = filed.where(F.col("cell").isin(cells)).where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(parts)) == part)
        asked = _in_blocks(mine, dict.fromkeys(cells, 1), 512).select("cell", F.col("ids").alias("asked_ids"), F.col("vectors").alias("asked"))
        probed = index.blocks.where(F.col("cell").isin(cells))  # by partition: other cells aren't read
        probed.join(F.broadcast(asked), "cell").mapInArrow(run, spec).write.mode("append").parquet(folder)
    once = spark.read.schema(spec).parquet(folder).groupBy(query, item).agg(F.max("score").alias("score"))  # a vector filed in two probed cells is met twice
    return ranked(once, "score", item, by=query).where(F.col("rank") <= k)


def recall(found: DataFrame, true: DataFrame, query: str = "query_id", item: str = "vec_id") -> DataFrame:
    """Of each query in ``true``: the share of its items that were found."""
    hit = true.select(query, item).join(found.select(query, item, F.lit(1).alias("_hit")), [query, item], "left")
    return hit.groupBy(query).agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))


def relevant_documents(index: Index, queries: DataFrame, chunks: DataFrame, n_documents: int, most_chunks: int = 50, item: str = "vec_id", query: str = "query_id", document: str = "doc_id", column: str = "embedding") -> DataFrame:
    """Of each query: the documents of its best ``most_chunks`` chunks (``chunks``: item, document), by their best chunk."""
    best = search(index, queries, most_chunks, item=item, query=query, column=column).join(chunks.select(item, document), item)
    return ranked(best.groupBy(query, document).agg(F.max("score").alias("score")), "score", document, by=query).where(F.col("rank") <= n_documents)
