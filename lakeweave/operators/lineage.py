"""Lineage: hash chains, their verification, impact reports; and multi-factor asset prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import literal_map

# Price factors.
BASE_PRICES = {"medical": 10000.0, "financial": 8000.0, "behavioral": 5000.0, "location": 3000.0, "demographic": 2000.0, "generic": 1000.0}
RIGHTS_WEIGHTS = {"usage": 0.3, "analysis": 0.5, "derivative": 0.8, "sub-license": 1.0, "view": 0.3, "download": 0.5}
SENSITIVITY_FACTORS = {"low": 1.0, "medium": 0.9, "high": 0.7, "critical": 0.5}
COMPUTATION_SHARES = {"raw": 0.0, "differential_privacy": 0.1, "tee": 0.3, "federated": 0.5, "mpc": 1.0}


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object of strings with sorted keys and no blanks; values need no escapes."""
    parts: list[Column] = []
    for k, name in enumerate(sorted(fields)):
        parts += [F.lit(("," if k else "{") + f'"{name}":"'), F.coalesce(fields[name].cast("string"), F.lit("")), F.lit('"')]
    return F.concat(*parts, F.lit("}"))


def chain(steps: DataFrame, entity: str, order: list[str], content: Column) -> DataFrame:
    """Adds step_index, parent_hash and hash: each step's hash covers its content and the hash before it.

    The fold runs over the sorted steps of one entity (a bounded processing chain), all in one row.
    """
    packed = F.array_sort(F.collect_list(F.struct(*order, content.alias("_content"))))
    rows = steps.groupBy(entity).agg(packed.alias("_steps"))
    hashes = F.aggregate("_steps", F.array(F.lit("0")), lambda acc, s: F.concat(acc, F.array(F.sha2(F.concat(F.element_at(acc, -1), F.lit("|"), s["_content"]), 256))))
    out = rows.withColumn("_hashes", hashes).select(entity, F.posexplode("_steps").alias("step_index", "_step"), "_hashes")
    return out.select(entity, "step_index", *(F.col(f"_step.{o}").alias(o) for o in order), F.col("_hashes")[F.col("step_index")].alias("parent_hash"), F.col("_hashes")[F.col("step_index") + 1].alias("hash"), F.col("_step._content").alias("content"))


def verify(chained: DataFrame, entity: str) -> DataFrame:
    """Of each entity: steps, whether every hash covers its content and its parent is the step before."""
    w = Window.partitionBy(entity).orderBy("step_index")
    linked = F.col("parent_hash") == F.coalesce(F.lag("hash").over(w), F.lit("0"))
    right = F.col("hash") == F.sha2(F.concat("parent_hash", F.lit("|"), "content"), 256)
    return chained.withColumn("_ok", linked & right).groupBy(entity).agg(F.count(F.lit(1)).alias("steps"), F.bool_and("_ok").alias("intact"))


def impact(paths: DataFrame) -> DataFrame:
    """Of each seed: affected nodes, critical paths (confidence 0.8 or more), mean confidence, risk and its label."""
    out = paths.groupBy("seed").agg(F.countDistinct("node").alias("affected"), F.count_if(F.col("confidence") >= 0.8).alias("critical"), F.avg("confidence").alias("mean_confidence"))
    risk = 0.3 * F.least(F.col("affected") / 100, F.lit(1.0)) + 0.4 * F.least(F.col("critical") / 10, F.lit(1.0)) + 0.3 * (1 - F.col("mean_confidence"))
    out = out.withColumn("risk", risk)
    return out.withColumn("label", F.when(F.col("risk") > 0.7, "high").when(F.col("risk") > 0.3, "medium").otherwise("low"))


def base_value(kind: Column, records: Column, size_bytes: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(BASE_PRICES), kind), F.lit(1000.0)) * F.least(F.lit(2.0), 1 + records / 1e5) * F.least(F.lit(1.5), 1 + size_bytes / 1e9 / 10)


def rights_factor(rights: Column) -> Column:
    """1 plus the weight of each right; 0.1 for unknown ones."""
    weights = literal_map(RIGHTS_WEIGHTS)
    return F.aggregate(F.transform(rights, lambda r: F.coalesce(F.try_element_at(weights, r), F.lit(0.1))), F.lit(1.0), lambda s, x: s + x)


def quality_factor(quality: Column) -> Column:
    return 0.5 + 1.5 * quality


def lineage_factor(intact: Column, depth: Column, confidence: Column) -> Column:
    return F.when(depth == 0, 0.9).when(~intact, 0.7).when((depth >= 3) & (confidence >= 0.8), 1.05).otherwise(1.0)


def price(base: Column, quality: Column, scarcity: Column, lineage: Column, rights: Column, market: Column, sensitivity: Column, computation: Column) -> Column:
    """The product of all factors, plus the computation's share of the base value."""
    factor = F.coalesce(F.try_element_at(literal_map(SENSITIVITY_FACTORS), sensitivity), F.lit(0.7))
    share = F.coalesce(F.try_element_at(literal_map(COMPUTATION_SHARES), computation), F.lit(0.0))
    return base * quality_factor(quality) * scarcity * lineage * rights_factor(rights) * market * factor + base * share


def price_range(p: Column) -> Column:
    return F.struct((0.8 * p).alias("low"), F.greatest(F.lit(1.0), F.bround(p)).alias("recommended"), (1.3 * p).alias("high"))


def automatic_price(n_chars: Column, nodes: Column, edges: Column) -> Column:
    """20, one for each 180 characters (120 at most), 1.5 a node and 1.2 an edge of its graph; 5 to 500."""
    return F.greatest(F.lit(5.0), F.least(F.lit(500.0), 20.0 + F.least(n_chars / 180.0, F.lit(120.0)) + nodes * 1.5 + edges * 1.2))


def strategy(position: Column) -> Column:
    """(strategy, adjustment) by market position: leaders ask a premium, followers compete, others penetrate."""
    leads, follows = position == "leader", position == "follower"
    return F.struct(F.when(leads, "premium").when(follows, "competitive").otherwise("penetration").alias("strategy"), F.when(leads, 1.2).when(follows, 1.0).otherwise(0.85).alias("adjustment"))


def network_label(value: Column) -> Column:
    return F.when(value >= 50, "high").when(value >= 20, "medium").otherwise("low")


def parent_hashes(chained: DataFrame, entity: str, sources: DataFrame) -> DataFrame:
    """Of each source entity: the hash of its latest step (``0`` where it has none)."""
    last = chained.groupBy(entity).agg(F.max_by("hash", "step_index").alias("parent_hash"))
    return sources.join(last, entity, "left").withColumn("parent_hash", F.coalesce("parent_hash", F.lit("0")))


def purged(lineage: DataFrame, ts: str, as_of: str, days: int) -> tuple[DataFrame, DataFrame]:
    """(kept, gone): rows by whether they are older than ``days`` at ``as_of``. A dry run counts the second."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    old = F.coalesce(F.col(ts) < cutoff, F.lit(False))
    return lineage.where(~old), lineage.where(old)


def kinds_since(lineage: DataFrame, kind: str, ts: str, as_of: str, days: int) -> DataFrame:
    """Steps of each kind of entity over the ``days`` days that end at ``as_of``."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return lineage.where((F.col(ts) > end - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) <= end)).groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def stored_or_profiled(stored: DataFrame, profiled: DataFrame, key: str, metric: str, default: float = 0.5) -> DataFrame:
    """A metric of each asset: the stored one, else the profiled one, else ``default``."""
    other = profiled.select(key, F.col(metric).alias("_p"))
    return stored.join(other, key, "left").select(key, F.coalesce(metric, "_p", F.lit(default)).alias(metric))
