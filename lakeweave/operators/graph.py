"""Property graphs as vertex and edge tables: neighbourhoods, paths, merges, community counts, network value.

Traversals are bounded loops of equi-joins. Each hop keeps one row for each pair of source and reached vertex (or each
simple path where paths are asked for), so a hop is one shuffle on the frontier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


#: Ids of vertices that point on to none, up to this number (about 16 MB), are broadcast.
BROADCAST_SINKS = 1_000_000


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    rest = [c for c in edges.columns if c not in (src, dst)]
    return edges.unionByName(edges.select(F.col(dst).alias(src), F.col(src).alias(dst), *rest)).distinct()


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, node, hop): the least number of steps, up to ``hops``, from each seed (column ``seed``)."""
    reached = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    frontier = reached
    for hop in range(1, hops + 1):
        step = frontier.join(edges.select("src", "dst"), F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = step.join(reached.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.unionByName(frontier)
    return reached


def hop_score(hop: Column) -> Column:
    return 1.0 / (hop + 1)


def simple_paths(edges: DataFrame, seeds: DataFrame, hops: int, least_confidence: float = 0.0) -> DataFrame:
    """Every path without a repeated node of up to ``hops`` edges: (seed, node, depth, path, confidence).

    The check for repeats is by path, so diamonds give a path each and cycles end.
    """
    usable = edges.where(F.col("confidence") >= least_confidence).select("src", "dst", F.col("confidence").alias("_c"))
    frontier = seeds.select("seed", F.col("seed").alias("node"), F.array("seed").alias("path"), F.lit(1.0).alias("confidence"))
    out = None
    for depth in range(1, hops + 1):
        step = frontier.join(usable, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        frontier = step.select("seed", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), (F.col("confidence") * F.col("_c")).alias("confidence"))
        found = frontier.withColumn("depth", F.lit(depth))
        out = found if out is None else out.unionByName(found)
    return out


def paths_to_type(paths: DataFrame, vertices: DataFrame, kind: str) -> DataFrame:
    """Paths that end at a vertex of a kind, scored 1 / (edges + 1)."""
    ends = vertices.where(F.col("kind") == kind).select(F.col("id").alias("node"))
    return paths.join(ends, "node", "left_semi").withColumn("score", 1.0 / (F.col("depth") + 1))


def merge_entities(entities: DataFrame) -> DataFrame:
    """Entities by lower-cased name: labels united and sorted, first description by position, latest attributes win."""
    key = F.lower(F.trim("name"))
    grouped = entities.groupBy(key.alias("key")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"),
        F.min_by("description", F.when(F.col("description").isNotNull(), F.col("position"))).alias("description"),
        F.count(F.lit(1)).alias("n"),
    )
    return grouped


def relax_cardinality(relations: DataFrame) -> DataFrame:
    """Relations of one source and name with several targets are many-valued."""
    n = relations.groupBy("src", "name").agg(F.countDistinct("dst").alias("targets"))
    return relations.join(n, ["src", "name"]).withColumn("cardinality", F.when(F.col("targets") > 1, "many").otherwise("one"))


def network_value(links: DataFrame, asset: str, entity: str) -> DataFrame:
    """Entities of an asset times 10 times scarcity, 1 / (1 + 0.1 * assets that share its entities)."""
    pairs = links.select(asset, entity).distinct()
    shared = pairs.join(pairs.groupBy(entity).agg(F.count(F.lit(1)).alias("_holders")), entity)
    out = shared.groupBy(asset).agg(F.count(F.lit(1)).alias("entities"), F.sum(F.col("_holders") - 1).alias("shared"))
    return out.withColumn("value", F.col("entities") * 10 / (1 + 0.1 * F.col("shared")))


def statistics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    a = vertices.groupBy(F.lit("vertex").alias("what"), "kind").agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(edges.groupBy(F.lit("edge").alias("what"), "kind").agg(F.count(F.lit(1)).alias("n")))


def live_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among the vertices."""
    ids = vertices.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


def detach(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges without the vertices in ``gone`` (id)."""
    v = vertices.join(gone, "id", "left_anti")
    e = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return v, e.select(edges.columns)


def merge_vertices(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by id: the first creation time stays, other columns are the incoming ones (labels are united)."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return both.groupBy("id").agg(F.min("created_at").alias("created_at"), F.max_by("name", F.struct("_new", "created_at")).alias("name"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"))


def topology(edges: DataFrame) -> DataFrame:
    """Degree and clustering coefficient of every vertex of an undirected simple graph.

    Triangles are counted once, from edges directed by degree: no vertex has more than about the square root of twice
    the edges pointing on, so hubs don't square. A vertex sends the list of those it points on to, as far as they are
    higher, to each of them, and what both lists hold are triangles: no wedge is a row. Vertices that point on to none
    are left out of that where they are few (``BROADCAST_SINKS``). Edges, degrees and lists are written, as each is read
    again. Ids that are whole numbers take the least room.
    """
    ends = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    once = written(ends.distinct(), "edges")
    degree = written(once.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    ranked = once.join(degree.select(F.col("id").alias("a"), F.col("degree").alias("_da")), "a").join(degree.select(F.col("id").alias("b"), F.col("degree").alias("_db")), "b")
    low, high = F.struct(F.col("_da").alias("degree"), F.col("a").alias("id")), F.struct(F.col("_db").alias("degree"), F.col("b").alias("id"))
    up = ranked.select(F.least(low, high).alias("low"), F.greatest(low, high).alias("high")).select(F.col("low.id").alias("src"), "high")
    ahead = written(up.groupBy("src").agg(F.array_sort(F.collect_list("high")).alias("ahead")), "ahead")
    # what lies after a vertex in the list is higher than it
    rest = F.expr("transform(slice(ahead, k + 2, size(ahead)), x -> x.id)")
    sent = ahead.select("src", "ahead", F.posexplode("ahead").alias("k", "via")).where("k + 1 < size(ahead)").select("src", F.col("via.id").alias("via"), "ahead", "k")
    sinks = written(degree.select(F.col("id").alias("via")).join(ahead.select(F.col("src").alias("via")), "via", "left_anti"), "sinks")
    if sinks.count() <= BROADCAST_SINKS:
        sent = sent.join(F.broadcast(sinks), "via", "left_anti")
    sent = sent.select("src", "via", rest.alias("rest"))
    lists = ahead.select(F.col("src").alias("via"), F.transform("ahead", lambda x: x["id"]).alias("own"))
    met = sent.join(lists, "via").select("src", "via", F.array_intersect("rest", "own").alias("third")).where("size(third) > 0")
    n = F.size("third").cast("long")
    parts = F.concat(F.array(F.struct(F.col("src").alias("id"), n.alias("n")), F.struct(F.col("via").alias("id"), n.alias("n"))), F.transform("third", lambda x: F.struct(x.alias("id"), F.lit(1).cast("long").alias("n"))))
    corners = met.select(F.inline(parts)).groupBy("id").agg(F.sum("n").alias("triangles"))
    out = degree.join(corners, "id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return out.withColumn("clustering", F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def latest_register(events: DataFrame, asset: str, seq: str, payload: str) -> DataFrame:
    w = Window.partitionBy(asset).orderBy(F.desc(seq))
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(asset, payload)
