"""Concurrent edits: conflicts by vector clock, their resolution, field-wise merges, presence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clock


def conflicts(operations: DataFrame, resource: str, unique: str, when: str, within_s: int = 3600) -> DataFrame:
    """Pairs of concurrent operations on one resource that lie within ``within_s`` seconds, earlier id first.

    The time limit bounds the pairs: operations meet by resource and time bin. Clocks of one actor, as most are, meet once
    a pair, by actor and number; maps are compared only for pairs with another clock, if there is any.
    """
    number = F.map_values("clock")[0].cast("long")
    rows = operations.select(
        resource, F.col(unique).alias("_id"), F.unix_seconds(F.col(when).cast("timestamp")).alias("_t"), "clock",
        F.coalesce((F.size("clock") == 1) & number.isNotNull(), F.lit(False)).alias("_one"), F.map_keys("clock")[0].alias("_actor"), number.alias("_n"),
    )
    single, other = rows.where("_one").drop("clock", "_one"), rows.where("NOT _one")
    found = _single_conflicts(single, resource, within_s)
    if not other.isEmpty():
        found = found.unionByName(_map_conflicts(other, rows, resource, within_s)).unionByName(_map_conflicts(rows.where("_one"), other, resource, within_s))
    return found.select(resource, "first_id", "second_id")


def _single_conflicts(rows: DataFrame, resource: str, within_s: int) -> DataFrame:
    """Among clocks of one actor: an operation meets those of its own bin, of half the time limit, and of the next two.
    Bins are dealt over all cores by number: by their bytes, which are few for their pairs, a few tasks would get them all."""
    spark = rows.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = F.floor(F.col("_t") * 2 / within_s)
    a = rows.withColumn("_bin", own).repartition(tasks, resource, "_bin")
    ahead = rows.select(resource, *(F.col(c).alias(f"{c}2") for c in ("_id", "_t", "_actor", "_n")), F.explode(F.array(*map(F.lit, range(3)))).alias("_ahead"))
    b = ahead.withColumn("_bin", F.floor(F.col("_t2") * 2 / within_s) - F.col("_ahead")).repartition(tasks, resource, "_bin")
    once = F.when(F.col("_ahead") == 0, F.col("_id") < F.col("_id2")).otherwise(F.col("_id") != F.col("_id2"))
    apart = F.when(F.col("_actor") == F.col("_actor2"), F.col("_n") == F.col("_n2")).otherwise((F.col("_n") <= 0) == (F.col("_n2") <= 0))
    near = a.join(b, [resource, "_bin"]).where((F.abs(F.col("_t") - F.col("_t2")) <= within_s) & once & apart)
    return near.select(resource, F.least("_id", "_id2").alias("first_id"), F.greatest("_id", "_id2").alias("second_id"))


def _map_conflicts(first: DataFrame, second: DataFrame, resource: str, within_s: int) -> DataFrame:
    """Between operations of two tables, the first one's earlier by id, with any clocks."""
    bin_of = lambda t: F.floor(t / within_s)
    a = first.select(resource, F.col("_id").alias("first_id"), F.col("_t").alias("_t1"), F.col("clock").alias("_c1"))
    b = second.select(resource, F.col("_id").alias("second_id"), F.col("_t").alias("_t2"), F.col("clock").alias("_c2"))
    a = a.withColumn("_bin", F.explode(F.array(bin_of(F.col("_t1")) - 1, bin_of(F.col("_t1")), bin_of(F.col("_t1")) + 1)))
    b = b.withColumn("_bin", bin_of(F.col("_t2")))
    near = a.join(b, [resource, "_bin"]).where((F.col("first_id") < F.col("second_id")) & (F.abs(F.col("_t1") - F.col("_t2")) <= within_s))
    return near.where(clock.compare(F.col("_c1"), F.col("_c2")) == 0).select(resource, "first_id", "second_id")


def resolve(operations: DataFrame, resource: str, order: list[str], payload: str, how: str = "last") -> DataFrame:
    """The winning payload of each resource: the last or the first write."""
    pick = F.max_by if how == "last" else F.min_by
    return operations.groupBy(resource).agg(pick(payload, F.struct(*order)).alias(payload))


def merged_fields(a: Column, b: Column) -> Column:
    """Two maps as one; null where they give a key different values."""
    clash = F.exists(F.map_keys(a), lambda k: F.map_contains_key(b, k) & (a[k] != F.try_element_at(b, k)))
    return F.when(~clash, F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, y)))


def presence(events: DataFrame, resource: str, user: str, order: list[str], kind: str) -> DataFrame:
    """Users present on each resource: those whose last join or leave is a join."""
    moves = events.where(F.col(kind).isin("join", "leave"))
    last = moves.groupBy(resource, user).agg(F.max_by(kind, F.struct(*order)).alias("_last"))
    return last.where("_last = 'join'").groupBy(resource).agg(F.array_sort(F.collect_list(user)).alias("users"), F.count(F.lit(1)).alias("n"))
