"""Connected components by alternating large and small stars, as joins and grouped minima.

Each round writes its edges to the shared folder and deletes those of the round before. A node with very many neighbours is no special case: its least
neighbour is a partial aggregate, and sending that to its neighbours is an equi-join that can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, written_at


def _large_star(edges: DataFrame) -> tuple[DataFrame, str]:
    """Each node's larger neighbours are joined to the least of the node and its neighbours. Also the folder of those."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the join exchanges two plain tables: a node with very many edges can then be split
    least, path = written_at(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), path


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are joined to the least of those."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges ``u, v`` (longs) but the roots; the root is a component's least node."""
    spark = edges.sparkSession
    edges, path = written_at(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        large, used = _large_star(edges)
        before, old = mark, path
        edges, path = written_at(_small_star(large), "edges")
        discarded(spark, used)
        discarded(spark, old)
        mark = _mark(edges)
        if before == mark:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
