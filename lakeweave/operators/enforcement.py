"""Rules over single accesses and prices: compliance with a grant, anomaly flags, what is done about them, price risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import DAILY, HOURLY, LARGE_BYTES

SUSPICIOUS = ("select *", "limit 1000000")
LEVELS = ("low", "medium", "high", "critical")


def compliance(accesses: DataFrame, grants: DataFrame) -> DataFrame:
    """``accesses`` (transaction, purpose, method, query, ts) with ``violations`` of their grant's terms.

    ``grants``: transaction (unique), purposes, grant_method, valid_until, aggregate_only (null counts as true).
    """
    both = accesses.join(grants.withColumn("_known", F.lit(True)), "transaction", "left")
    known = F.col("_known").isNotNull()
    query = F.lower("query")
    rules = F.array(
        F.when(~known, "transaction_not_found"),
        F.when(known & ~F.coalesce(F.array_contains("purposes", F.col("purpose")), F.lit(False)), "unauthorized_purpose"),
        F.when(known & ~F.col("method").eqNullSafe(F.col("grant_method")), "unauthorized_computation_method"),
        F.when(known & (F.col("ts") > F.col("valid_until")), "expired_access"),
        F.when(known & F.coalesce("aggregate_only", F.lit(True)) & ~query.contains("group by") & ~query.contains("count"), "aggregation_required"),
    )
    status = F.when(~known, "unknown").when(F.size("violations") > 0, "violated").otherwise("compliant")
    return both.withColumn("violations", F.array_compact(rules)).withColumn("compliance", status).select(*accesses.columns, "violations", "compliance")


def anomaly_flags(frequency: Column, query: Column, size_bytes: Column, violations: Column, gap_s: Column, growth: Column) -> Column:
    """Sorted distinct flags of one access, from its pattern, its query, its size and its violations."""
    q = F.lower(query)
    flags = F.array(
        F.when(frequency > 0.8, "EXCESSIVE_ACCESS"),
        F.when(q.contains(SUSPICIOUS[0]) | q.contains(SUSPICIOUS[1]), "SUSPICIOUS_QUERY_PATTERN"),
        F.when(size_bytes > LARGE_BYTES, "EXCESSIVE_OUTPUT"),
        F.when(F.array_contains(violations, "unauthorized_purpose"), "UNAUTHORIZED_PURPOSE"),
        F.when(F.array_contains(violations, "expired_access"), "TIME_VIOLATION"),
        F.when(gap_s < 5, "rapid_access"),
        F.when(growth > 10, "output_size_surge"),
    )
    return F.array_sort(F.array_distinct(F.array_compact(flags)))


def response(risk: Column, severity: Column) -> Column:
    """What is done: suspension on a high or critical violation, throttling above a risk of 0.8, an alert above 0.7."""
    return F.when(severity.isin("high", "critical"), "suspend").when(risk > 0.8, "throttle").when(risk > 0.7, "alert").otherwise("none")


def next_status(status: Column, action: Column) -> Column:
    """A grant's status after an action; a revoked one stays revoked."""
    return F.when(status == "revoked", status).when(action == "revoke", "revoked").when(action == "suspend", "suspended").otherwise(status)


def within_limits(in_hour: Column, in_day: Column) -> Column:
    return (in_hour <= HOURLY) & (in_day <= DAILY)


def price_findings(price: Column, low: Column, high: Column, market: Column, variation: Column) -> Column:
    """Findings (name, level) on a price: against its estimate, its market, its recent swings and an absolute bound."""
    def finding(when: Column, name: str, level: str) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("name"), F.lit(LEVELS.index(level)).alias("level")))

    return F.array_compact(
        F.array(
            finding(price < low * 0.5, "below_estimate", "high"),
            finding(price > high * 2, "above_estimate", "medium"),
            finding((market > 0) & (price / market > 2), "above_market", "medium"),
            finding((market > 0) & (price / market < 0.5), "below_market", "medium"),
            finding(variation > 0.5, "volatile", "medium"),
            finding(price > 1_000_000, "very_large", "high"),
        )
    )


def overall_level(findings: Column) -> Column:
    """The highest level among findings; low if there are none."""
    worst = F.coalesce(F.array_max(F.transform(findings, lambda f: f["level"])), F.lit(0))
    return F.element_at(F.array(*map(F.lit, LEVELS)), worst + 1)


def settlement(final: Column, target: Column, budget: Column) -> Column:
    """Whether a deal can be settled: not over the budget, and reviewed if over 20% above the target."""
    return F.when(final > budget, "rejected").when(final > target * 1.2, "review").otherwise("approved")


def sensitivity(kind: Column, has_pii: Column, fields: Column) -> Column:
    """A level from the kind of data, whether it holds personal data (medium at least) and secret fields (high at least)."""
    by_kind = F.when(kind.isin("medical", "health"), 3).when(kind.isin("financial", "banking"), 2).when(kind.isin("personal", "behavioral"), 1).otherwise(0)
    secret = F.exists(fields, lambda f: F.lower(f).rlike("password|secret|token|credit_card"))
    level = F.greatest(by_kind, F.when(has_pii, 1).otherwise(0), F.when(secret, 2).otherwise(0))
    return F.element_at(F.array(*map(F.lit, LEVELS)), level + 1)


def identifier_columns(rows: DataFrame) -> dict[str, list[str]]:
    """Direct identifiers and quasi-identifiers among the columns, by their names."""
    direct, quasi = ("name", "email", "phone", "ssn", "id_number"), ("age", "zip", "gender", "birth", "city")
    return {"direct": [c for c in rows.columns if any(w in c.lower() for w in direct)], "quasi": [c for c in rows.columns if any(w in c.lower() for w in quasi)]}
