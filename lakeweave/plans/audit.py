"""Queries over ``events`` as an access log: errors are failures, values are result sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import audit
from ..sources.tables import table

AS_OF = "2024-01-31 00:00:00"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    risk = audit.action_risk(kind == "error", kind == "purchase", kind == "error", F.col("user_id") % 10 == 0, F.col("ts"))
    return e.withColumn("risk", risk)


def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("event_id", F.round("risk", 6).alias("risk"), audit.risk_level(F.col("risk") + 1e-9).alias("level"))


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.report(_log(spark, sf_dir), "user_id", "props", "risk")


def user_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.activity(_log(spark, sf_dir), "user_id", F.col("event_type") == "error", F.col("risk"))


def access_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.access_pattern(table(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id")
    return out.select("event_id", "in_hour", "in_day", F.round("frequency", 6).alias("frequency"), F.col("gap_s").cast("long").alias("gap_s"))


def rapid_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.rapid(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.lit(True), 600)
    return out.select("event_id", F.round("gap_s", 3).alias("gap_s"))


def front_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type").isin("click", "purchase")
    return audit.rapid(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", kind, 3600).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def busy_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n > 60")


def risk_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.two_periods(_log(spark, sf_dir), "user_id", "ts", "risk", AS_OF, 15, 15)


def risk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's risks are added up in the order of their events: sums of tenths differ in the last place by their order,
    and means that lie on a level's bound would change sides with the partitions."""
    so_far = Window.partitionBy("user_id").orderBy("event_id", "ts", "risk").rowsBetween(Window.unboundedPreceding, 0)
    added = _log(spark, sf_dir).select("user_id", F.sum("risk").over(so_far).alias("total"), F.count("risk").over(so_far).alias("n"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id", "ts", "risk")).alias("k"))
    per_user = added.groupBy("user_id").agg((F.max_by("total", "k") / F.max_by("n", "k")).alias("mean"))
    return per_user.groupBy(audit.risk_level(F.col("mean")).alias("level")).agg(F.count(F.lit(1)).alias("users"))


def security_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).where("risk >= 0.699999").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id")


def session_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions closed by 30 idle minutes."""
    sessions = table(spark, sf_dir, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "30 minutes").alias("w"))
    return sessions.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_seconds("w.start").alias("first_s"), "n")


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice") / 10
    out = audit.approval(price, F.lit(40_000.0), (F.col("o_custkey") % 10) / 10, F.col("o_orderkey") % 13 == 0)
    return table(spark, sf_dir, "orders").groupBy(out.alias("rule")).agg(F.count(F.lit(1)).alias("n"))


def query_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity and fingerprint of statements built from region names."""
    q = F.concat(F.lit("SELECT sum(x) FROM "), F.col("r_name"), F.lit(" JOIN b ON 1=1 WHERE y IN (SELECT y FROM c) GROUP BY z"))
    return table(spark, sf_dir, "region").select("r_regionkey", F.round(audit.query_complexity(q), 6).alias("complexity"), audit.fingerprint(q).alias("fingerprint"))


QUERIES = {f.__name__: f for f in (risk_score, audit_report, user_activity, access_pattern, rapid_access, front_running, busy_users, risk_trend, risk_histogram, security_anomalies, session_idle, approvals, query_scores)}

_RISK = """(CASE event_type WHEN 'error' THEN 0.5::DOUBLE WHEN 'purchase' THEN 0.3::DOUBLE ELSE 0::DOUBLE END + CASE WHEN event_type = 'error' THEN 0.2::DOUBLE ELSE 0::DOUBLE END
+ CASE WHEN user_id % 10 = 0 THEN 0.3::DOUBLE ELSE 0::DOUBLE END + CASE WHEN hour(ts) < 6 OR hour(ts) >= 22 THEN 0.1::DOUBLE ELSE 0::DOUBLE END)"""
_LOG = f"(SELECT *, least(1::DOUBLE, {_RISK}) AS risk FROM events)"
_LEVEL = "CASE WHEN {0} >= 0.7 THEN 'critical' WHEN {0} >= 0.5 THEN 'high' WHEN {0} >= 0.3 THEN 'medium' ELSE 'low' END"
_GAPS = "SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap_s FROM events"
ORACLE_SQL = {
    "risk_score": f"SELECT event_id, round(risk, 6) AS risk, {_LEVEL.format('(risk + 1e-9)')} AS level FROM {_LOG}",
    "audit_report": f"""
WITH g AS (SELECT user_id, count(*) AS accesses, count(DISTINCT props) AS different_queries, round(avg(risk), 9) AS mean_risk, CAST(count(*) FILTER (risk > 0.7) AS BIGINT) AS high_risk FROM {_LOG} GROUP BY 1)
SELECT *, CASE WHEN high_risk = 0 THEN 'compliant' WHEN high_risk <= 2 THEN 'minor_issues' ELSE 'non_compliant' END AS status FROM g""",
    "user_activity": f"""
WITH g AS (SELECT user_id, count(*) AS total, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS failures, CAST(count(*) FILTER (risk >= 0.5) AS BIGINT) AS risky FROM {_LOG} GROUP BY 1)
SELECT *, CASE WHEN risky > 5 THEN 'high' WHEN risky > 0 THEN 'medium' ELSE 'low' END AS label FROM g""",
    "access_pattern": """
WITH t AS (SELECT event_id, user_id, ts, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS s FROM events),
w AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_hour,
count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS in_day,
s - lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_s FROM t)
SELECT event_id, in_hour, in_day, round(greatest(least(in_hour / 100, 1), least(in_day / 500, 1)), 6) AS frequency, gap_s FROM w""",
    "rapid_access": f"SELECT event_id, round(gap_s, 3) AS gap_s FROM ({_GAPS}) WHERE gap_s < 600",
    "front_running": f"SELECT user_id, count(*) AS n FROM ({_GAPS} WHERE event_type IN ('click', 'purchase')) WHERE gap_s < 3600 GROUP BY 1",
    "busy_users": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 60",
    "risk_trend": f"""
WITH g AS (SELECT user_id, avg(risk) FILTER (ts <= TIMESTAMP '{AS_OF}' - INTERVAL 15 DAY) AS b, avg(risk) FILTER (ts > TIMESTAMP '{AS_OF}' - INTERVAL 15 DAY) AS a
FROM {_LOG} WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND ts <= TIMESTAMP '{AS_OF}' GROUP BY 1)
SELECT user_id, round(b, 6) AS before, round(a, 6) AS after, round(a - b, 6) AS change FROM g""",
    "risk_histogram": f"WITH m AS (SELECT avg(risk) AS m FROM {_LOG} GROUP BY user_id) SELECT {_LEVEL.format('m')} AS level, count(*) AS users FROM m GROUP BY 1",
    "security_anomalies": f"SELECT event_id, user_id FROM {_LOG} WHERE risk >= 0.699999 ORDER BY ts DESC, event_id DESC LIMIT 100",
    "session_idle": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, CAST(floor(epoch_us(min(ts)) / 1e6) AS BIGINT) AS first_s, count(*) AS n FROM s GROUP BY user_id, k""",
    "approvals": """
SELECT CASE WHEN o_totalprice / 10 > 40000 THEN 'over_budget' WHEN o_orderkey % 13 = 0 THEN 'first_transaction' WHEN o_totalprice / 10 > 10000 THEN 'high_price'
WHEN (o_custkey % 10) / 10 < 0.5 THEN 'low_trust' ELSE 'automatic' END AS rule, count(*) AS n FROM orders GROUP BY 1""",
    "query_scores": """
WITH q AS (SELECT r_regionkey, 'SELECT sum(x) FROM ' || r_name || ' JOIN b ON 1=1 WHERE y IN (SELECT y FROM c) GROUP BY z' AS q FROM region)
SELECT r_regionkey, round(0.1 + 0.15 + 0.05 + 0.05, 6)::DOUBLE AS complexity, substr(sha256(lower(regexp_replace(q, '\\s+', '', 'g'))), 1, 32) AS fingerprint FROM q""",
}
