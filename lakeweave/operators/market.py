"""Market analytics over transactions and assets: overviews, trends, ranks, personas, price risk, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money


def overview(transactions: DataFrame, category: str, price: str) -> DataFrame:
    """Number, mean, least and greatest price by category."""
    p = F.col(price)
    return transactions.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 4).alias("mean_price"), F.min(p).alias("min_price"), F.max(p).alias("max_price"))


def trend(transactions: DataFrame, ts: str, price: str, as_of: str, days: int, *keys: str) -> DataFrame:
    """Daily slope of the price over a period by least squares, and its label."""
    end = F.lit(as_of).cast("timestamp_ntz")
    rows = transactions.where((F.col(ts) >= end - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col(ts) <= end))
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("double")
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(price).alias("mean"), F.regr_slope(F.col(price), day).alias("slope"))
    share = F.col("slope") * days / F.col("mean")
    label = F.when(share > 0.05, "rising").when(share < -0.05, "falling").otherwise("stable")
    return out.select(*keys, "n", F.round("mean", 4).alias("mean_price"), F.round("slope", 4).alias("slope"), label.alias("trend"))


def competition_rank(assets: DataFrame, kind: str, price: str, quality: str) -> DataFrame:
    """Percentile of price and quality within a kind (share of strictly lower ones, times 100), and the position."""

    def percentile(column: str) -> Column:
        w = Window.partitionBy(kind).orderBy(column)
        return (F.rank().over(w) - 1) / F.count(F.lit(1)).over(Window.partitionBy(kind)) * 100

    out = assets.withColumn("price_percentile", percentile(price)).withColumn("quality_percentile", percentile(quality))
    position = F.when((F.col("quality_percentile") >= 75) & (F.col("price_percentile") >= 50), "leader").when(F.col("quality_percentile") >= 50, "follower").otherwise("niche")
    return out.withColumn("position", position)


def scarcity(n_same: Column) -> Column:
    return F.when(n_same <= 1, 2.0).when(n_same <= 5, 1.5).when(n_same <= 20, 1.2).otherwise(1.0)


def volatility(prices: DataFrame, key: str, price: str, order: list[Column], last: int = 10) -> DataFrame:
    """Population coefficient of variation of the last prices of each key; over 0.5 is volatile."""
    w = Window.partitionBy(key).orderBy(*order)
    newest = prices.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    out = newest.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.stddev_pop(price) / F.avg(price)).alias("cv"))
    return out.select(key, "n", F.round("cv", 6).alias("cv"), (F.col("cv") > 0.5).alias("volatile"))


def personas(orders: DataFrame, buyer: str, price: str) -> DataFrame:
    """Segment by total, sensitivity by mean price, of each buyer."""
    out = orders.groupBy(buyer).agg(F.count(F.lit(1)).alias("n"), F.sum(price).alias("total"), F.avg(price).alias("mean"))
    segment = F.when(F.col("total") > 10000, "high_value").when(F.col("total") > 1000, "regular").otherwise("new")
    sensitivity = F.when(F.col("mean") > 500, "low").when(F.col("mean") > 100, "medium").otherwise("high")
    return out.select(buyer, "n", F.round("total", 2).alias("total"), F.round("mean", 5).alias("mean"), segment.alias("segment"), sensitivity.alias("price_sensitivity"))


def similar_buyers(orders: DataFrame, buyer: str, price: str, who: int, limit: int) -> DataFrame:
    """Buyers of the same segment as one buyer, most orders first."""
    all_of_them = personas(orders, buyer, price)
    segment = all_of_them.where(F.col(buyer) == who).select(F.col("segment").alias("_segment"))  # one row
    same = all_of_them.join(F.broadcast(segment), F.col("segment") == F.col("_segment")).where(F.col(buyer) != who)
    return same.orderBy(F.desc("n"), buyer).limit(limit).select(buyer, "n", "segment")


def running_balance(ledger: DataFrame, account: str, delta: str, order: list[str]) -> DataFrame:
    """Balance before and after each entry of an account."""
    w = Window.partitionBy(account).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    after = F.sum(delta).over(w)
    return ledger.withColumn("balance_after", after).withColumn("balance_before", F.col("balance_after") - F.col(delta))


def with_fees(orders: DataFrame, cents: str) -> DataFrame:
    return orders.withColumn("fee_cents", money.fee(F.col(cents))).withColumn("income_cents", F.col(cents) - F.col("fee_cents"))


def price_risk(price: Column, low: Column, high: Column, market: Column) -> Column:
    """Highest of: far below the range, far above it, off the market mean, over the absolute limit (ordinals 0 to 2)."""
    by_range = F.when(price < 0.5 * low, 2).when(price > 2 * high, 1).otherwise(0)
    ratio = price / market
    by_market = F.when((ratio > 2) | (ratio < 0.5), 1).otherwise(0)
    return F.greatest(by_range, F.coalesce(by_market, F.lit(0)), F.when(price > 1_000_000, 2).otherwise(0))
