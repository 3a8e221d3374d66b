"""Queries over ``events`` as metered usage: event type is the feature, value the cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import usage
from ..sources.tables import table

AS_OF = "2024-01-31 00:00:00"


def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(usage.in_period(F.col("ts"), AS_OF, 30))
    return usage.summary(events.withColumn("bucket", (F.col("user_id") % 7).cast("string")), "event_type", "bucket", "value")


def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.daily(table(spark, sf_dir, "events"), "ts", "value", "user_id")


def usage_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.recent(table(spark, sf_dir, "events"), F.col("user_id") == 7, "ts", "event_id", 20).select("event_id", "event_type", "value")


def usage_feature_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = (F.col("user_id") == 7) & (F.col("event_type") == "click")
    return usage.recent(table(spark, sf_dir, "events"), who, "ts", "event_id", 20).select("event_id", "value")


def cost_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("gpt-4", "qwen-max", "deepseek", "unknown")))
    rows = table(spark, sf_dir, "events").select("event_id", F.element_at(names, (F.col("user_id") % 4 + 1).cast("int")).alias("model"), F.floor("value").alias("prompt_tokens"), F.lit(100).alias("completion_tokens"))
    costed = usage.with_cost(rows, usage.price_table(spark))
    return costed.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


def price_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.price_table(spark)


QUERIES = {
    "agg_usage_daily": usage_daily,
    "agg_usage_summary": usage_summary,
    "agg_usage_recent": usage_recent,
    "agg_usage_feature_recent": usage_feature_recent,
    "cost_enrich": cost_enrich,
    "price_catalog": price_catalog,
}

_PRICES = ", ".join(f"('{m}', {p}, {c})" for m, (p, c) in usage.MODEL_PRICES.items())

ORACLE_SQL = {
    "agg_usage_daily": "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "agg_usage_summary": f"""
WITH e AS (SELECT event_type, CAST(user_id % 7 AS VARCHAR) AS bucket, value FROM events WHERE ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND TIMESTAMP '{AS_OF}')
SELECT 'all' AS level, '' AS key, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM e
UNION ALL SELECT 'feature', event_type, count(*), round(sum(value), 4), round(avg(value), 4) FROM e GROUP BY event_type
UNION ALL SELECT 'model', bucket, count(*), round(sum(value), 4), round(avg(value), 4) FROM e GROUP BY bucket""",
    "agg_usage_recent": "SELECT event_id, event_type, value FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 20",
    "agg_usage_feature_recent": "SELECT event_id, value FROM events WHERE user_id = 7 AND event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 20",
    "cost_enrich": f"""
WITH p(model, pp, cp) AS (VALUES {_PRICES}),
e AS (SELECT ['gpt-4', 'qwen-max', 'deepseek', 'unknown'][user_id % 4 + 1] AS model, floor(value) AS pt FROM events)
SELECT e.model, count(*) AS n, round(sum(coalesce(pt / 1000 * pp + 100 / 1000.0 * cp, 0)), 6) AS cost FROM e LEFT JOIN p USING (model) GROUP BY 1""",
    "price_catalog": f"SELECT model, CAST(pp AS DOUBLE) AS prompt_price, CAST(cp AS DOUBLE) AS completion_price FROM (VALUES {_PRICES}) t(model, pp, cp)",
}
