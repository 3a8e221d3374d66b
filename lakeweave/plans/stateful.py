"""Queries with state: rate limits, breakers, auctions, sessions, clocks and conversation memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import stateful
from ..sources.tables import table


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", stateful.seconds("ts").alias("at"))


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stateful.token_bucket(_timed(spark, sf_dir), "user_id", ["at", "event_id"], "at", 2.0, 1 / 36000)
    return out.select("event_id", "allowed", F.round("tokens", 6).alias("tokens"))


def rate_limit_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.sliding_window(_timed(spark, sf_dir), "user_id", ["at", "event_id"], "at", 2, 86400.0).select("event_id", "allowed")


def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _timed(spark, sf_dir).withColumn("failed", F.col("event_type") == "error")
    return stateful.circuit_breaker(rows, "user_id", ["at", "event_id"], "at", "failed", 2, 2, 86400.0).select("event_id", "allowed", "state")


def adaptive_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.adaptive_rate(_timed(spark, sf_dir), "user_id", ["at", "event_id"], "value").select("event_id", F.round("rate", 6).alias("rate"))


def ledger_debits(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("event_type") == "purchase", -3).otherwise(1)
    rows = _timed(spark, sf_dir).withColumn("cents", (F.round(F.col("value") * 100) * sign).cast("long"))
    return stateful.debits(rows, "user_id", ["at", "event_id"], "cents", 10_000).select("event_id", "accepted", "balance")


def auction_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    bids = _timed(spark, sf_dir).withColumn("session", F.col("event_id") % 40)
    return stateful.auction(bids, "session", ["at", "event_id"], "value", "user_id")


def negotiation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for pair in {"view": "OFFER", "click": "COUNTER", "signup": "MESSAGE", "error": "WITHDRAW", "purchase": "ACCEPT"}.items() for x in pair))
    events = _timed(spark, sf_dir).withColumn("session", F.col("event_id") % 3000).withColumn("kind", kinds[F.col("event_type")])
    return stateful.negotiation(events, "session", ["at", "event_id"], "kind", "value")


def memory_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.recent_messages(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


def memory_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.context(table(spark, sf_dir, "conversations"), "conv_id", "text", 500)


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of a conversation in turn order."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["role"]), ",").alias("roles"))


def _clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("clock"))


def clock_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _clocks(spark, sf_dir)
    b = a.select((F.col("user_id") - 1).alias("user_id"), F.col("clock").alias("other"))
    merged = a.join(b, "user_id").select("user_id", F.explode(clock.merge(F.col("clock"), F.col("other"))).alias("actor", "n"))
    return merged


def clock_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _clocks(spark, sf_dir)
    more = a.withColumn("other", clock.increment(F.col("clock"), F.lit("view")))
    return more.select("user_id", clock.compare(F.col("clock"), F.col("other")).alias("before"), clock.compare(F.col("other"), F.col("clock")).alias("after"), clock.causality(F.col("clock"), F.col("clock")).alias("same"))


NOW = 1706659200.0  # 2024-01-31 00:00:00


def bucket_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = stateful.token_bucket(_timed(spark, sf_dir), "user_id", ["at", "event_id"], "at", 2.0, 1 / 360000)
    return stateful.bucket_now(folded, "user_id", ["at", "event_id"], "at", NOW, 2.0, 1 / 360000).select("user_id", F.round("tokens", 6).alias("tokens"))


def window_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = stateful.sliding_window(_timed(spark, sf_dir), "user_id", ["at", "event_id"], "at", 2, 864000.0)
    return stateful.window_now(folded, "user_id", "at", NOW, 864000.0)


def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _timed(spark, sf_dir).withColumn("failed", F.col("event_type") == "error")
    folded = stateful.circuit_breaker(rows, "user_id", ["at", "event_id"], "at", "failed", 2, 2, 864000.0)
    return stateful.breaker_now(folded, "user_id", ["at", "event_id"], "at", NOW, 864000.0).select("user_id", "state", F.round("retry_s", 3).alias("retry_s"))


def request_throttles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a few actors; windows of ten days, throttles of five and ten."""
    rows = _timed(spark, sf_dir).withColumn("kind", F.when(F.col("user_id") % 3 == 0, "offer").when(F.col("user_id") % 3 == 1, "bid").otherwise("other")).withColumn("bad", F.col("event_type") == "error")
    out = stateful.throttled(rows, "user_id", ["at", "event_id"], "at", "kind", "bad", None, 864000.0, 432000.0, 864000.0)
    return out.select("event_id", "allowed", "reason")


QUERIES = {f.__name__: f for f in (token_bucket, rate_limit_sliding, circuit_breaker, adaptive_rate, ledger_debits, auction_state, negotiation_fold, bucket_states, window_states, breaker_states, request_throttles, memory_recent, memory_context, trajectory, clock_merge, clock_compare)}

_CLOCKS = "c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)"
_TIMED = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"
_SHUT = "name <> 'open' OR e.sec - since >= 86400"
_SHUT_LONG = "name <> 'open' OR e.sec - since >= 864000"
ORACLE_SQL = {
    "token_bucket": f"""
WITH RECURSIVE {_TIMED}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BOOLEAN AS allowed, 2::DOUBLE AS tokens, NULL::DOUBLE AS sec FROM e UNION ALL
SELECT user_id, i, event_id, t >= 1, t - (t >= 1)::INT, sec FROM (SELECT f.user_id, e.i, e.event_id, e.sec, CASE WHEN f.sec IS NULL THEN 2::DOUBLE ELSE least(2::DOUBLE, f.tokens + (e.sec - f.sec) / 36000) END AS t FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT event_id, allowed, round(tokens, 6) AS tokens FROM f WHERE i > 0""",
    "rate_limit_sliding": f"""
WITH RECURSIVE {_TIMED}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BOOLEAN AS allowed, []::DOUBLE[] AS log FROM e UNION ALL
SELECT user_id, i, event_id, len(l) < 2, CASE WHEN len(l) < 2 THEN list_append(l, sec) ELSE l END FROM (SELECT f.user_id, e.i, e.event_id, e.sec, list_filter(f.log, lambda x: x > e.sec - 86400) AS l FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT event_id, allowed FROM f WHERE i > 0""",
    "circuit_breaker": f"""
WITH RECURSIVE {_TIMED}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BOOLEAN AS allowed, 'closed' AS name, 0 AS bad, 0 AS good, 0::DOUBLE AS since FROM e UNION ALL
SELECT user_id, i, event_id, n <> 'open', CASE WHEN n <> 'open' AND failed AND (n = 'half_open' OR bad + 1 >= 2) THEN 'open' WHEN n = 'half_open' AND NOT failed AND g + 1 >= 2 THEN 'closed' ELSE n END,
CASE WHEN n = 'open' THEN bad WHEN NOT failed THEN 0 WHEN n = 'half_open' OR bad + 1 >= 2 THEN 0 ELSE bad + 1 END, CASE WHEN n <> 'open' AND NOT failed THEN g + 1 ELSE g END, CASE WHEN n <> 'open' AND failed AND (n = 'half_open' OR bad + 1 >= 2) THEN sec ELSE since END
FROM (SELECT f.user_id, e.i, e.event_id, e.sec, e.event_type = 'error' AS failed, bad, since, CASE WHEN {_SHUT} THEN CASE WHEN name = 'open' THEN 'half_open' ELSE name END ELSE 'open' END AS n, CASE WHEN name = 'open' AND e.sec - since >= 86400 THEN 0 ELSE good END AS g FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT event_id, allowed, name AS state FROM f WHERE i > 0""",
    "bucket_states": f"""
WITH RECURSIVE {_TIMED}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BOOLEAN AS allowed, 2::DOUBLE AS tokens, NULL::DOUBLE AS sec FROM e UNION ALL
SELECT user_id, i, event_id, t >= 1, t - (t >= 1)::INT, sec FROM (SELECT f.user_id, e.i, e.event_id, e.sec, CASE WHEN f.sec IS NULL THEN 2::DOUBLE ELSE least(2::DOUBLE, f.tokens + (e.sec - f.sec) / 360000) END AS t FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT user_id, round(least(2, arg_max(tokens, i) + ({NOW} - max(sec)) / 360000), 6) AS tokens FROM f WHERE i > 0 GROUP BY 1""",
    "window_states": f"""
WITH RECURSIVE {_TIMED}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BOOLEAN AS allowed, []::DOUBLE[] AS log FROM e UNION ALL
SELECT user_id, i, event_id, len(l) < 2, CASE WHEN len(l) < 2 THEN list_append(l, sec) ELSE l END FROM (SELECT f.user_id, e.i, e.event_id, e.sec, list_filter(f.log, lambda x: x > e.sec - 864000) AS l FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT f.user_id, count_if(allowed AND e.sec > {NOW} - 864000 AND e.sec <= {NOW})::BIGINT AS used FROM f JOIN e USING (event_id) WHERE f.i > 0 GROUP BY 1""",
    "breaker_states": f"""
WITH RECURSIVE {_TIMED}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BOOLEAN AS allowed, 'closed' AS name, 0 AS bad, 0 AS good, 0::DOUBLE AS since FROM e UNION ALL
SELECT user_id, i, event_id, n <> 'open', CASE WHEN n <> 'open' AND failed AND (n = 'half_open' OR bad + 1 >= 2) THEN 'open' WHEN n = 'half_open' AND NOT failed AND g + 1 >= 2 THEN 'closed' ELSE n END,
CASE WHEN n = 'open' THEN bad WHEN NOT failed THEN 0 WHEN n = 'half_open' OR bad + 1 >= 2 THEN 0 ELSE bad + 1 END, CASE WHEN n <> 'open' AND NOT failed THEN g + 1 ELSE g END, CASE WHEN n <> 'open' AND failed AND (n = 'half_open' OR bad + 1 >= 2) THEN sec ELSE since END
FROM (SELECT f.user_id, e.i, e.event_id, e.sec, e.event_type = 'error' AS failed, bad, since, CASE WHEN {_SHUT_LONG} THEN CASE WHEN name = 'open' THEN 'half_open' ELSE name END ELSE 'open' END AS n, CASE WHEN name = 'open' AND e.sec - since >= 864000 THEN 0 ELSE good END AS g FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
, l AS (SELECT user_id, arg_max(name, i) AS state, arg_max(since, i) AS since FROM f WHERE i > 0 GROUP BY 1) SELECT user_id, state, round(CASE WHEN state = 'open' THEN greatest(0, since + 864000 - {NOW}) END, 3) AS retry_s FROM l""",
    "request_throttles": f"""
WITH RECURSIVE {_TIMED}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BOOLEAN AS allowed, NULL::VARCHAR AS reason, '-inf'::DOUBLE AS start, 0 AS n, 0 AS bad, '-inf'::DOUBLE AS until FROM e UNION ALL
SELECT user_id, i, event_id, r IS NULL, r, start, CASE WHEN r IS NULL AND most < 1000000 THEN n + 1 ELSE n END, CASE WHEN r IS NULL AND most < 1000000 AND b THEN bad + 1 ELSE bad END, CASE r WHEN 'rate' THEN sec + 432000 WHEN 'conflicts' THEN sec + 864000 ELSE until END
FROM (SELECT *, CASE WHEN most = 1000000 THEN NULL WHEN sec < until THEN 'throttled' WHEN n >= most THEN 'rate' WHEN bad >= most_bad THEN 'conflicts' END AS r FROM (
SELECT f.user_id, e.i, e.event_id, e.sec, e.event_type = 'error' AS b, until, CASE WHEN new THEN e.sec ELSE start END AS start, CASE WHEN new THEN 0 ELSE n END AS n, CASE WHEN new THEN 0 ELSE bad END AS bad, most, most_bad
FROM (SELECT e.*, [5, 10, 1000000][e.user_id % 3 + 1] AS most, [3, 5, 0][e.user_id % 3 + 1] AS most_bad FROM e) e JOIN (SELECT * FROM f) f ON e.user_id = f.user_id AND e.i = f.i + 1, LATERAL (SELECT e.sec >= until AND e.sec - start >= 864000 AND most < 1000000 AS new))))
SELECT event_id, allowed, reason FROM f WHERE i > 0""",
    "adaptive_rate": f"""
WITH RECURSIVE {_TIMED}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, 100::DOUBLE AS rate FROM e UNION ALL
SELECT f.user_id, e.i, e.event_id, least(1000::DOUBLE, greatest(10::DOUBLE, rate * CASE WHEN e.value > 70 THEN 0.9::DOUBLE ELSE 1.1::DOUBLE END)) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1) SELECT event_id, round(rate, 6) AS rate FROM f WHERE i > 0""",
    "ledger_debits": f"""
WITH RECURSIVE {_TIMED}, f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::BOOLEAN AS accepted, 10000::BIGINT AS balance FROM e UNION ALL
SELECT user_id, i, event_id, balance + c >= 0, balance + CASE WHEN balance + c >= 0 THEN c ELSE 0 END FROM (SELECT f.user_id, e.i, e.event_id, balance, CAST(round(e.value * 100) AS BIGINT) * CASE WHEN e.event_type = 'purchase' THEN -3 ELSE 1 END AS c FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT event_id, accepted, balance FROM f WHERE i > 0""",
    "auction_state": """
WITH b AS (SELECT event_id % 40 AS session, value, user_id, value > coalesce(max(value) OVER (PARTITION BY event_id % 40 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) AS up FROM events)
SELECT session, count(*) AS bids, CAST(sum(up::INT) AS BIGINT) AS raises, max(value) AS highest, max_by(user_id, value) FILTER (up) AS winner FROM b GROUP BY 1""",
    "negotiation_fold": """
WITH e AS (SELECT event_id % 3000 AS session, ts, event_id, value, CASE event_type WHEN 'view' THEN 'OFFER' WHEN 'click' THEN 'COUNTER' WHEN 'signup' THEN 'MESSAGE' WHEN 'error' THEN 'WITHDRAW' ELSE 'ACCEPT' END AS kind FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS k FROM e),
g AS (SELECT session, CAST(count(*) FILTER (kind IN ('OFFER', 'COUNTER')) AS BIGINT) AS offers, max_by(value, k) FILTER (kind IN ('OFFER', 'COUNTER')) AS last_price,
max_by(kind, k) FILTER (kind IN ('ACCEPT', 'WITHDRAW')) AS ended_by, count(*) AS version FROM r GROUP BY 1)
SELECT *, CASE WHEN ended_by = 'ACCEPT' THEN 'accepted' WHEN ended_by IS NOT NULL THEN 'closed' WHEN offers > 0 THEN 'negotiating' ELSE 'open' END AS status FROM g""",
    "memory_recent": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "memory_context": "SELECT conv_id, count(*) AS messages, CAST(sum(length(text) // 2) AS BIGINT) AS tokens, sum(length(text) // 2) > 500 AS overflow FROM conversations GROUP BY 1",
    "trajectory": "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1",
    "clock_merge": f"""WITH {_CLOCKS}, p AS (SELECT user_id, event_type, n FROM c WHERE user_id + 1 IN (SELECT user_id FROM c) UNION ALL SELECT user_id - 1, event_type, n FROM c WHERE user_id - 1 IN (SELECT user_id FROM c))
SELECT user_id, event_type AS actor, max(n) AS n FROM p GROUP BY 1, 2""",
    "clock_compare": f"WITH {_CLOCKS} SELECT DISTINCT user_id, -1 AS before, 1 AS after, 'concurrent' AS same FROM c",
}
