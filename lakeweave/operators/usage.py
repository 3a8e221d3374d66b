"""Usage metering: summaries by period, day, feature and model; prices and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Prices for 1,000 tokens (prompt, completion).
MODEL_PRICES = {
    "deepseek": (0.00014, 0.00028),
    "gpt-4": (0.03, 0.06),
    "gpt-4-turbo": (0.01, 0.03),
    "gpt-3.5-turbo": (0.0005, 0.0015),
    "qwen-turbo": (0.0005, 0.001),
    "qwen-plus": (0.001, 0.002),
    "qwen-max": (0.003, 0.006),
}


def in_period(ts: Column, as_of: str, days: int) -> Column:
    """Within the ``days`` days up to ``as_of`` (both ends included)."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return (ts >= end - F.expr(f"INTERVAL {int(days)} DAYS")) & (ts <= end)


def summary(usage: DataFrame, feature: str, model: str, value: str) -> DataFrame:
    """One scan for the totals, by feature and by model: (level, key, n, total, mean)."""
    rows = usage.select(F.col(feature).alias("feature"), F.col(model).alias("model"), F.col(value).alias("value"))
    cubed = rows.groupingSets([[], [F.col("feature")], [F.col("model")]], F.col("feature"), F.col("model")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.grouping_id().alias("g")
    )
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "feature").otherwise("model")
    return cubed.select(level.alias("level"), F.coalesce("feature", F.col("model").cast("string"), F.lit("")).alias("key"), "n", F.round("total", 4).alias("total"), F.round("mean", 4).alias("mean"))


def daily(usage: DataFrame, ts: str, value: str, *keys: str) -> DataFrame:
    return usage.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))


def recent(usage: DataFrame, who: Column, ts: str, unique: str, limit: int) -> DataFrame:
    """The newest rows of one user: a top-k, not a sort of everything."""
    return usage.where(who).orderBy(F.desc(ts), F.desc(unique)).limit(limit)


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, p, c) for m, (p, c) in MODEL_PRICES.items()], "model string, prompt_price double, completion_price double")


def with_cost(usage: DataFrame, prices: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """Adds ``cost``: by the price table, else by the defaults, else nothing. Price tables are small by contract (one row a model)."""
    out = usage.join(F.broadcast(prices), "model", "left")
    p, c = F.col("prompt_price"), F.col("completion_price")
    if defaults is not None:
        renamed = defaults.select("model", F.col("prompt_price").alias("_p"), F.col("completion_price").alias("_c"))
        out = out.join(F.broadcast(renamed), "model", "left")
        p, c = F.coalesce(p, "_p"), F.coalesce(c, "_c")
    cost = F.coalesce(F.col("prompt_tokens") / 1000 * p + F.col("completion_tokens") / 1000 * c, F.lit(0.0))
    return out.withColumn("cost", cost).drop("prompt_price", "completion_price", "_p", "_c")
