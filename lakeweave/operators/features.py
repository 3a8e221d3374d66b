"""Feature encoding and one graph layer: one-hot and time features, z-scores, mean aggregation, link scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector


def one_hot(value: Column, kinds: list[str]) -> Column:
    return F.array(*(F.when(value == k, 1.0).otherwise(0.0) for k in kinds))


def time_features(ts: Column) -> Column:
    """Sine and cosine of month, day and hour."""
    parts = [(F.month(ts) - 1) / 12, (F.dayofmonth(ts) - 1) / 31, F.hour(ts) / 24]
    return F.array(*(f(2 * math.pi * p) for p in parts for f in (F.sin, F.cos)))


def node_features(rows: DataFrame, kind: str, kinds: list[str], numbers: list[str], ts: str) -> DataFrame:
    return rows.withColumn("features", F.concat(one_hot(F.col(kind), kinds), F.array(*(F.col(c).cast("double") for c in numbers)), time_features(F.col(ts))))


def z_scores(rows: DataFrame, *columns: str) -> DataFrame:
    """Each column less its mean over its population deviation; a constant column becomes 0. One row of statistics is broadcast."""
    stats = rows.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    out = rows.crossJoin(F.broadcast(stats))
    for c in columns:
        spread = F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
        out = out.withColumn(f"{c}_z", (F.col(c) - F.col(f"_m_{c}")) / spread)
    return out.drop(*(f"_{k}_{c}" for c in columns for k in "ms"))


def inverse_z_scores(rows: DataFrame, stats: DataFrame, *columns: str) -> DataFrame:
    """Columns ``c_z`` turned back to values by one row of statistics (``mean_c``, ``std_c``)."""
    out = rows.crossJoin(F.broadcast(stats))
    return out.withColumns({c: F.col(f"{c}_z") * F.col(f"std_{c}") + F.col(f"mean_{c}") for c in columns}).drop(*stats.columns)


def normal_statistics(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: ``mean_c`` and ``std_c`` (1 for a constant column) of each column."""
    spread = lambda c: F.stddev_pop(c)
    return rows.agg(*(F.avg(c).alias(f"mean_{c}") for c in columns), *(F.when(spread(c) == 0, 1.0).otherwise(spread(c)).alias(f"std_{c}") for c in columns))


def edge_time(created: Column, used: Column, as_of: str) -> Column:
    """Age in years (3 at most), recency of use (1 now, 0 after a year), and sine and cosine of the age; 0 where unknown."""
    days = lambda ts: F.floor((F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(ts.cast("timestamp"))) / 86400)
    age = F.when(created.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(3.0), days(created) / 365)))
    recency = F.when(used.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - days(used) / 365)))
    return F.array(age, recency, F.sin(2 * math.pi * age), F.cos(2 * math.pi * age))


def edge_features(kind: Column, kinds: list[str], weight: Column, strength: Column, confidence: Column, frequency: Column, time: Column) -> Column:
    """One-hot kind (the last place for others), four weights held to 0..1, and the time features."""
    last = ~F.coalesce(kind.isin(*kinds[:-1]), F.lit(False))
    hot = F.array(*(F.when(kind == k, 1.0).otherwise(0.0) for k in kinds[:-1]), F.when(last, 1.0).otherwise(0.0))
    held = lambda c, default: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.cast("double"), F.lit(default))))
    return F.concat(hot, F.array(held(weight, 1.0), held(strength, 0.5), held(confidence, 0.5), held(frequency / 100, 0.01)), time)


def edge_embeddings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of each edge (src, dst, features): its ends' vectors and its own features, one after another."""
    a, b = nodes.select(F.col("id").alias("src"), F.col("x").alias("_a")), nodes.select(F.col("id").alias("dst"), F.col("x").alias("_b"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", F.concat("_a", "_b", "features").alias("x"))


def contrastive_loss(triples: DataFrame, anchor: str, positive: str, negative: str, temperature: float = 0.5) -> DataFrame:
    """Mean InfoNCE loss of (anchor, positive, negative) vectors: cross entropy of the positive's cosine against the negative's."""
    p, n = vector.cosine(F.col(anchor), F.col(positive)) / temperature, vector.cosine(F.col(anchor), F.col(negative)) / temperature
    return triples.agg(F.avg(F.log1p(F.exp(n - p))).alias("loss"), F.count(F.lit(1)).alias("triples"))


def contrastive_triples(nodes: DataFrame, label: str = "label", seed: int = 0) -> DataFrame:
    """For every node an anchor, a positive (the next node of its label in hash order, the first after the last) and a
    negative (the node with the same place in another label's order). Labels with one node give none.

    Places come from ranks within labels; the two lookups are equi-joins on (label, place).
    """
    w = Window.partitionBy(label).orderBy(F.xxhash64("id", F.lit(seed)), "id")
    placed = nodes.withColumn("_k", F.row_number().over(w) - 1)
    sizes = placed.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    labels = sizes.withColumn("_l", F.row_number().over(Window.orderBy(label)) - 1)
    after = labels.select((F.pmod(F.col("_l") - 1, F.lit(labels.count()))).alias("_l"), F.col(label).alias("_other"), F.col("_n").alias("_m"))
    known = placed.join(F.broadcast(labels.join(after, "_l")), label).where("_n > 1")
    asked = known.select(F.col("id").alias("anchor"), F.col("x").alias("anchor_x"), F.col(label), "_other", ((F.col("_k") + 1) % F.col("_n")).alias("_p"), (F.col("_k") % F.col("_m")).alias("_q"))
    pos = placed.select(F.col(label), F.col("_k").alias("_p"), F.col("id").alias("positive"), F.col("x").alias("positive_x"))
    neg = placed.select(F.col(label).alias("_other"), F.col("_k").alias("_q"), F.col("id").alias("negative"), F.col("x").alias("negative_x"))
    return asked.join(pos, [label, "_p"]).join(neg, ["_other", "_q"]).select("anchor", "positive", "negative", "anchor_x", "positive_x", "negative_x")


def heads(nodes: DataFrame, weights: dict[str, list[list[float]]]) -> DataFrame:
    """Linear heads over node vectors: of each name, one output for each row of weights."""
    dot = lambda w: vector.dot(F.col("x"), F.array(*map(F.lit, w)))
    return nodes.withColumns({name: F.array(*(dot(w) for w in rows)) for name, rows in weights.items()})


def multi_task_loss(rows: DataFrame, regression: dict[str, tuple[str, str]], classes: dict[str, tuple[str, str]], task_weights: dict[str, float]) -> DataFrame:
    """Weighted sum of mean squared errors (prediction, target) and of cross entropies (logits, class number), and each."""
    losses = {name: F.avg((F.col(p) - F.col(y)) ** 2) for name, (p, y) in regression.items()}
    for name, (logits, y) in classes.items():
        total = F.log(F.aggregate(F.transform(logits, F.exp), F.lit(0.0), lambda s, v: s + v))
        losses[name] = F.avg(total - F.get(F.col(logits), F.col(y)))
    out = rows.agg(*(c.alias(n) for n, c in losses.items()))
    weighted = F.lit(0.0)
    for n in losses:
        weighted = weighted + task_weights.get(n, 1.0) * F.col(n)
    return out.withColumn("loss", weighted)


def masked_features(nodes: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Vectors with a share of their places set to 0, chosen by hash."""
    keep = lambda i: F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(1_000_000)) / 1e6 >= share
    return nodes.withColumn("x", F.transform("x", lambda v, i: F.when(keep(i), v).otherwise(0.0)))


def sage_layer(nodes: DataFrame, edges: DataFrame, dimensions: int, own: float = 0.6, near: float = 0.4) -> DataFrame:
    """One mean-aggregation layer with fixed weights: relu(own * x + near * mean of the in-neighbours), length 1.

    Neighbours are summed by dimension with partial aggregates, so a node with very many is no special case.
    """
    sent = edges.join(nodes.select(F.col("id").alias("src"), "x"), "src")
    means = sent.groupBy(F.col("dst").alias("id")).agg(F.array(*(F.avg(F.col("x")[k]) for k in range(dimensions))).alias("_near"))
    joined = nodes.join(means, "id", "left").withColumn("_near", F.coalesce("_near", F.array_repeat(F.lit(0.0), dimensions)))
    mixed = joined.withColumn("_h", F.zip_with("x", "_near", lambda a, b: F.greatest(F.lit(0.0), own * a + near * b)))
    length = mixed.withColumn("_n", vector.norm(F.col("_h")))
    return length.select("id", F.when(F.col("_n") > 0, F.transform("_h", lambda v: v / F.col("_n"))).otherwise(F.col("_h")).alias("x"))


def link_scores(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cosine + 1) / 2 of the two ends of candidate edges."""
    a = nodes.select(F.col("id").alias("src"), F.col("x").alias("_a"))
    b = nodes.select(F.col("id").alias("dst"), F.col("x").alias("_b"))
    return candidates.join(a, "src").join(b, "dst").select("src", "dst", ((vector.cosine(F.col("_a"), F.col("_b")) + 1) / 2).alias("score"))


def split(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Adds ``side`` (train or validation) by a hash of the key: equal on every run and every number of partitions."""
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) / 1e6
    return rows.withColumn("side", F.when(u < share, "train").otherwise("validation"))


def dropped_edges(edges: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Edges left after dropping a share of them by hash."""
    return edges.where(F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1_000_000)) / 1e6 >= share)


def collated(graphs: DataFrame, graph: str, size: str) -> DataFrame:
    """Graphs (one row each, with their number of nodes) with the first node number of each in one batch of all. Offsets
    come from running sums over graph rows, which are few next to nodes."""
    before = Window.orderBy(graph).rowsBetween(Window.unboundedPreceding, -1)
    return graphs.withColumn("first_node", F.coalesce(F.sum(size).over(before), F.lit(0)))


def embedded(asked: DataFrame, nodes: DataFrame, dimensions: int) -> DataFrame:
    """The vector of each asked node (id); zeros where it has none."""
    return asked.join(nodes.select("id", "x"), "id", "left").withColumn("x", F.coalesce("x", F.array_repeat(F.lit(0.0), dimensions)))


def value_features(nodes: DataFrame, topology: DataFrame) -> DataFrame:
    """Network value of a node from its vector and its place: 0.4 of its length in percent, 30 of its degree's share of the
    greatest and 30 of its clustering; 100 at most. One row, the greatest degree, is broadcast."""
    top = topology.agg(F.max("degree").alias("_top"))
    out = nodes.join(topology, "id", "left").crossJoin(F.broadcast(top))
    degree = F.coalesce("degree", F.lit(0)) / F.greatest(F.coalesce("_top", F.lit(0)), F.lit(1))
    value = 0.4 * F.least(vector.norm(F.col("x")) * 100, F.lit(100.0)) + 30 * degree + 30 * F.coalesce("clustering", F.lit(0.0))
    return out.select("id", F.least(F.lit(100.0), value).alias("value"))


def trained_links(pairs: DataFrame, features: str = "x", label: str = "label", steps: int = 40, penalty: float = 0.01):
    """A link predictor: logistic regression by Spark ML on edge features, stopped early when steps no longer help."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    ready = pairs.select(array_to_vector(F.col(features)).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=steps, regParam=penalty, tol=1e-6).fit(ready)


def validation_loss(model, pairs: DataFrame, features: str = "x", label: str = "label") -> DataFrame:
    """Mean log loss and accuracy of a trained predictor on other pairs."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    out = model.transform(pairs.withColumn("features", array_to_vector(F.col(features))))
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), vector_to_array("probability")[1]))
    y = F.col(label).cast("double")
    return out.agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("loss"), F.avg(((p >= 0.5).cast("double") == y).cast("double")).alias("accuracy"))
