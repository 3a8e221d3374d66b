"""Access audit: reports, activity, access patterns, risk scores, reviews of two periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOURLY, DAILY, LARGE_BYTES, LARGE_ROWS = 100, 500, 100 * 1024 * 1024, 10_000


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.7, "critical").when(score >= 0.5, "high").when(score >= 0.3, "medium").otherwise("low")


def action_risk(critical: Column, high: Column, failed: Column, anonymous: Column, ts: Column) -> Column:
    """0.5 or 0.3 for the action, 0.2 for failure, 0.3 for no user, 0.1 outside 6 to 22 h; 1 at most."""
    score = F.when(critical, 0.5).when(high, 0.3).otherwise(0.0) + F.when(failed, 0.2).otherwise(0.0) + F.when(anonymous, 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), score + F.when((F.hour(ts) < 6) | (F.hour(ts) >= 22), 0.1).otherwise(0.0))


def report(access: DataFrame, key: str, fingerprint: str, risk: str) -> DataFrame:
    """Accesses, different queries, mean risk (none counts as 0), accesses over 0.7, and the compliance label."""
    r = F.coalesce(F.col(risk), F.lit(0.0))
    out = access.groupBy(key).agg(F.count(F.lit(1)).alias("accesses"), F.countDistinct(fingerprint).alias("different_queries"), F.round(F.avg(r), 9).alias("mean_risk"), F.count_if(r > 0.7).alias("high_risk"))
    return out.withColumn("status", F.when(F.col("high_risk") == 0, "compliant").when(F.col("high_risk") <= 2, "minor_issues").otherwise("non_compliant"))


def activity(events: DataFrame, key: str, failed: Column, risk: Column) -> DataFrame:
    out = events.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failures"), F.count_if(risk >= 0.5).alias("risky"))
    return out.withColumn("label", F.when(F.col("risky") > 5, "high").when(F.col("risky") > 0, "medium").otherwise("low"))


def access_pattern(events: DataFrame, key: str, ts: str, size: str, unique: str) -> DataFrame:
    """For every access: how many in the last hour and the last 24 hours, the gap to the one before, and growth in size.

    The hourly figure is held against the hourly limit, the daily against the daily one.
    """
    seconds = F.unix_seconds(F.col(ts).cast("timestamp"))
    timed = events.withColumn("_s", seconds)
    frame = lambda s: Window.partitionBy(key).orderBy("_s").rangeBetween(-s, 0)
    order = Window.partitionBy(key).orderBy(ts, unique)
    before = F.lag("_s").over(order)
    out = timed.withColumn("in_hour", F.count(F.lit(1)).over(frame(3600))).withColumn("in_day", F.count(F.lit(1)).over(frame(86400)))
    out = out.withColumn("gap_s", F.col("_s") - before).withColumn("growth", F.col(size) / F.lag(size).over(order))
    return out.withColumn("frequency", F.greatest(F.least(F.col("in_hour") / HOURLY, F.lit(1.0)), F.least(F.col("in_day") / DAILY, F.lit(1.0)))).drop("_s")


def rapid(events: DataFrame, key: str, ts: str, unique: str, kind: Column, seconds: float) -> DataFrame:
    """Pairs of successive events of one kind less than ``seconds`` apart."""
    order = Window.partitionBy(key).orderBy(ts, unique)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    both = events.where(kind).withColumn("gap_s", (at - F.lag(at).over(order)) / 1e6)
    return both.where(F.col("gap_s") < seconds)


def two_periods(events: DataFrame, key: str, ts: str, value: str, as_of: str, first_days: int, second_days: int) -> DataFrame:
    """Means over two adjoining periods that end at ``as_of``, and their difference."""
    end = F.lit(as_of).cast("timestamp_ntz")
    middle, start = end - F.expr(f"INTERVAL {second_days} DAYS"), end - F.expr(f"INTERVAL {first_days + second_days} DAYS")
    t = F.col(ts)
    out = events.where((t > start) & (t <= end)).groupBy(key).agg(F.avg(F.when(t <= middle, F.col(value))).alias("before"), F.avg(F.when(t > middle, F.col(value))).alias("after"))
    return out.select(key, F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), F.round(F.col("after") - F.col("before"), 6).alias("change"))


def query_complexity(query: Column) -> Column:
    """Joins 0.1 each (0.3 at most), sub-selects 0.15 each (0.3 at most), aggregate words 0.05 each, 0.1 over 1,000 characters."""
    q = F.lower(query)
    count = lambda word: (F.length(q) - F.length(F.replace(q, F.lit(word), F.lit("")))) / len(word)
    score = F.least(F.lit(0.3), count("join") * 0.1) + F.least(F.lit(0.3), F.greatest(count("select") - 1, F.lit(0.0)) * 0.15)
    for word in ("sum", "count", "avg", "max", "min", "group by"):
        score = score + F.when(F.contains(q, F.lit(word)), 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), score + F.when(F.length(query) > 1000, 0.1).otherwise(0.0))


def fingerprint(query: Column) -> Column:
    """Equal for queries that differ in case and white space alone."""
    return F.substring(F.sha2(F.lower(F.regexp_replace(query, r"\s+", "")), 256), 1, 32)


def access_risk(frequency: Column, size_bytes: Column, rows: Column, violations: Column, anomalies: Column) -> Column:
    score = 0.3 * frequency + 0.2 * F.least(size_bytes / LARGE_BYTES, F.lit(1.0)) + 0.1 * F.least(rows / LARGE_ROWS, F.lit(1.0))
    return F.least(F.lit(1.0), score + F.least(F.lit(0.4), 0.2 * violations) + 0.1 * anomalies)


def approval(price: Column, budget: Column, trust: Column, first: Column) -> Column:
    """Ordered rules: over budget, first deal, high price, low trust; else automatic."""
    return F.when(price > budget, "over_budget").when(first, "first_transaction").when(price > 10_000, "high_price").when(trust < 0.5, "low_trust").otherwise("automatic")


def anonymized_level(sensitivity: Column) -> Column:
    levels = {"low": "L1", "medium": "L2", "high": "L3", "critical": "L4"}
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in levels.items() for x in pair)), sensitivity)


def since(rows: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows of the ``days`` days that end at ``as_of``."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return rows.where((F.col(ts) > end - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) <= end))


def log_page(logs: DataFrame, order: list[str], limit: int | None = None, offset: int = 0, least_risk: float | None = None, start: str | None = None, end: str | None = None, ts: str = "ts", risk: str = "risk", **equal) -> DataFrame:
    """Audit rows by any of: columns equal to a value (``user_id=7``; None is no condition), least risk, time from ``start``
    up to ``end``; newest first by ``order``, a page of ``limit`` rows after ``offset``."""
    out = logs
    for column, value in equal.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    if least_risk is not None:
        out = out.where(F.col(risk) >= least_risk)
    if start is not None:
        out = out.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    out = out.orderBy(*(F.desc(c) for c in order)).offset(offset)
    return out if limit is None else out.limit(limit)


def severities(violations: DataFrame, key: str, severity: str = "severity") -> DataFrame:
    """Violations of each key in all and by severity; unknown severities count in the total alone."""
    return violations.groupBy(key).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(severity) == s).alias(s) for s in ("critical", "high", "medium", "low")))


def summary(access: DataFrame, violations: DataFrame, key: str, fingerprint: str, risk: str) -> DataFrame:
    """Of each key: accesses, different queries, mean risk (3 places), accesses over 0.7, violations, and the pattern."""
    r = F.coalesce(F.col(risk), F.lit(0.0))
    out = access.groupBy(key).agg(F.count(F.lit(1)).alias("accesses"), F.countDistinct(fingerprint).alias("different_queries"), F.round(F.avg(r), 9).alias("_mean"), F.count_if(r > 0.7).alias("high_risk"))
    out = out.join(violations.groupBy(key).agg(F.count(F.lit(1)).alias("violations")), key, "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    pattern = F.when(F.col("_mean") > 0.6, "anomalous").when((F.col("_mean") > 0.3) | (F.col("accesses") > 500), "suspicious").otherwise("normal")
    return out.withColumn("pattern", pattern).withColumn("mean_risk", F.round(F.col("_mean") + 1e-9, 3)).withColumn("level", risk_level(F.col("_mean"))).drop("_mean")


def assessed(summaries: DataFrame) -> DataFrame:
    """Risk factors of summaries, and the state they ask for: suspended, monitored or active."""
    factors = F.array_compact(F.array(F.when(F.col("high_risk") > 0, "high_risk_access"), F.when(F.col("violations") > 0, "policy_violation"), F.when(F.col("accesses") > 100, "frequent_access")))
    state = F.when((F.col("level") == "critical") | (F.col("violations") > 5), "suspended").when((F.col("level") == "high") | (F.col("violations") > 0), "monitored").otherwise("active")
    return summaries.withColumn("factors", factors).withColumn("state", state)


def histogram(summaries: DataFrame) -> DataFrame:
    """How many keys have each risk level, with their violations and high-risk accesses."""
    return summaries.groupBy("level").agg(F.count(F.lit(1)).alias("keys"), F.sum("violations").alias("violations"), F.sum("high_risk").alias("high_risk"))


def integrity_hash(*fields: Column) -> Column:
    """SHA-256 of an audit row's fields, which can be computed again from the row: no clock is part of it."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields)), 256)
