"""Governed access: policies, group-size enforcement, watermarks, anonymisation, protocol choice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import literal_map


@dataclass(frozen=True)
class Policy:
    """``most_rows`` 0: any number, but aggregates only."""

    most_rows: int
    aggregates_only: bool
    least_group: int
    watermark: str
    operations: tuple[str, ...] = ("SELECT",)


# Access policies.
POLICIES = {
    "read_only": Policy(100, False, 1, "visible"),
    "analytics": Policy(0, True, 5, "invisible"),
    "derived_work": Policy(1_000, False, 1, "fingerprint"),
    "full_access": Policy(10_000, False, 1, "none", ("SELECT", "INSERT", "UPDATE", "DELETE")),
    "exclusive": Policy(100_000, False, 1, "none", ("SELECT", "INSERT", "UPDATE", "DELETE")),
}


class AccessDenied(Exception):
    pass


def first_rows(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """The first rows by ``order`` and then by all columns that can be ordered: the same ones on every run."""
    rest = [f.name for f in rows.schema.fields if f.name not in order and "map<" not in f.dataType.simpleString()]
    return rows.orderBy(*(F.col(f"`{c}`") for c in (*order, *rest))).limit(most)


def governed_aggregate(rows: DataFrame, keys: list[str], aggregates: dict[str, Column], policy: str) -> DataFrame:
    """Aggregates by key; groups below the policy's least size are left out."""
    rules = POLICIES.get(policy, POLICIES["read_only"])
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), *(c.alias(n) for n, c in aggregates.items()))
    out = out.where(F.col("_size") >= rules.least_group).drop("_size")
    return first_rows(out, rules.most_rows, *keys) if rules.most_rows else out


def watermark(rows: DataFrame, kind: str, transaction: str, buyer: int, as_of: str, unique: str) -> DataFrame:
    """visible: a struct on each row; invisible: a number from the buyer and the row's key; fingerprint: one hash."""
    if kind == "visible":
        return rows.withColumn("_watermark", F.struct(F.lit(transaction).alias("transaction"), F.lit(buyer).alias("buyer"), F.lit(as_of).alias("at")))
    if kind == "invisible":
        return rows.withColumn("_wm", F.lit(buyer % 100) + F.pmod(F.col(unique).cast("long"), F.lit(1_000_003)))
    if kind == "fingerprint":
        return rows.withColumn("_fingerprint", F.substring(F.sha2(F.lit(f"{transaction}:{buyer}:{as_of}"), 256), 1, 16))
    return rows


def pseudonymize(rows: DataFrame, *fields: str) -> DataFrame:
    return rows.withColumns({f: F.concat(F.lit("PSEUDO_"), F.substring(F.sha2(F.col(f).cast("string"), 256), 1, 12)) for f in fields})


def k_anonymize(rows: DataFrame, quasi: dict[str, Column], k: int) -> DataFrame:
    """Quasi-identifiers replaced by their general forms; rows of groups below ``k`` are suppressed.

    The groups are counted and joined back: no group, however large, meets in one task.
    """
    general = rows.withColumns(quasi)
    sizes = general.groupBy(*quasi).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= k)
    return general.join(sizes, list(quasi), "left_semi")


def decade(age: Column) -> Column:
    return F.concat((F.floor(age / 10) * 10).cast("string"), F.lit("s"))


def laplace(value: Column, epsilon: float, sensitivity: float = 1.0, seed: int = 0, *key: Column) -> Column:
    """The value with Laplace noise of scale sensitivity / epsilon, by the inverse distribution function.

    The draw comes from a hash of ``key`` (what tells rows apart; the value itself if none) and ``seed``: a row gets the
    same noise on every run and every number of partitions, so that repeating a query reveals nothing more. The seed must
    stay secret.
    """
    u = (F.shiftrightunsigned(F.xxhash64(*(key or (value,)), F.lit(seed)), 11) + 0.5) / float(1 << 53) - 0.5
    return value - (sensitivity / epsilon) * F.signum(u) * F.log(1 - 2 * F.abs(u))


# Scores of computation methods (privacy, precision, cost, trust; 0 to 1) and what a sensitivity allows.
METHODS = {"raw": (0.0, 1.0, 1.0, 0.4), "differential_privacy": (0.2, 0.7, 0.8, 0.7), "tee": (0.4, 0.95, 0.6, 0.7), "federated": (0.6, 0.85, 0.4, 0.7), "mpc": (0.8, 0.9, 0.0, 1.0)}
ALLOWED = {"low": ("raw", "differential_privacy", "tee", "federated", "mpc"), "medium": ("differential_privacy", "tee", "federated", "mpc"), "high": ("tee", "federated", "mpc"), "critical": ("mpc", "tee")}
EPSILON = {"critical": 0.1, "high": 0.5, "medium": 1.0, "low": 2.0}


def protocol_scores(spark: SparkSession) -> DataFrame:
    """Every allowed method of every sensitivity with its score: 0.4 privacy, 0.3 precision, 0.2 cost, 0.1 trust."""
    rows = [(s, m, *METHODS[m]) for s, methods in ALLOWED.items() for m in methods]
    table = spark.createDataFrame(rows, "sensitivity string, method string, privacy double, precision double, cost double, trust double")
    return table.select("sensitivity", "method", (0.4 * F.col("privacy") + 0.3 * F.col("precision") + 0.2 * F.col("cost") + 0.1 * F.col("trust")).alias("score"))


def best_protocol(scores: DataFrame) -> DataFrame:
    return scores.groupBy("sensitivity").agg(F.max_by("method", F.struct("score", "method")).alias("method"), F.max("score").alias("score"))


def epsilon(sensitivity: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(EPSILON), sensitivity), F.lit(1.0))


def has_right(grants: DataFrame, right: str, as_of: str) -> DataFrame:
    """(buyer, asset) pairs with an active grant that holds the right at a time."""
    t = F.lit(as_of).cast("timestamp_ntz")
    live = grants.where((F.col("status") == "active") & (F.col("valid_from") <= t) & (F.col("valid_until") >= t))
    return live.where(F.array_contains("rights", right)).select("buyer", "asset").distinct()
