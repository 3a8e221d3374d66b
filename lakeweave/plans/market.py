"""Queries over ``orders``, ``lineitem`` and ``part`` as transactions, listings and assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money
from ..operators import market
from ..sources.tables import table

AS_OF = "2001-12-01 00:00:00"


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return items.join(parts, "l_partkey")


def market_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.overview(_sales(spark, sf_dir), "p_brand", "l_extendedprice")


def market_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.trend(_sales(spark, sf_dir), "l_shipdate", "l_extendedprice", AS_OF, 365, "p_brand")


def market_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '2001-01-01 00:00:00'").select("o_orderkey")
    sold = _sales(spark, sf_dir).join(recent, F.col("l_orderkey") == F.col("o_orderkey"))
    return market.overview(sold, "p_brand", "l_extendedprice")


def competition_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = market.competition_rank(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size"), "p_brand", "p_retailprice", "p_size")
    return ranked.select("p_partkey", F.round("price_percentile", 6).alias("price_percentile"), F.round("quality_percentile", 6).alias("quality_percentile"), "position")


def price_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return market.volatility(items, "l_partkey", "l_extendedprice", [F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_extendedprice"), F.desc("l_suppkey")])


def buyer_persona(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.personas(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice")


def similar_buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.similar_buyers(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", 1, 10)


def scarcity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "part").groupBy("p_brand", "p_type", "p_size").agg(F.count(F.lit(1)).alias("n"))
    return kinds.withColumn("multiplier", market.scarcity(F.col("n")))


def wallet_running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", money.to_cents(F.col("o_totalprice")).alias("cents"))
    return market.running_balance(ledger, "o_custkey", "cents", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


def order_fees(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", money.to_cents(F.col("o_totalprice")).alias("cents"))
    return market.with_fees(orders, "cents")


def reprice_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("buys"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), money.to_cents(F.col("p_retailprice")).alias("cents"), (F.col("p_size") % 10).alias("views"))
    demand = 2 * F.coalesce("buys", F.lit(0)) + 0.15 * F.col("views")
    return parts.join(sold, "l_partkey", "left").select("l_partkey", "cents", money.repriced(F.col("cents"), demand / 6).alias("new_cents"))


def yield_accrual(spark: SparkSession, sf_dir: str) -> DataFrame:
    balances = table(spark, sf_dir, "supplier").select("s_suppkey", money.to_cents(F.col("s_acctbal")).alias("cents"))
    names = F.array(*map(F.lit, sorted(money.YIELD_RATES)))
    rates = F.create_map(*(F.lit(x) for pair in money.YIELD_RATES.items() for x in pair))
    chosen = balances.withColumn("strategy", F.element_at(names, (F.col("s_suppkey") % 3 + 1).cast("int")))
    return chosen.withColumn("yield_cents", money.simple_interest(F.col("cents"), rates[F.col("strategy")], F.lit(30)))


def top_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").orderBy(F.desc("p_size"), F.desc("p_retailprice"), "p_partkey").limit(5).select("p_partkey", "p_size", "p_retailprice")


def transaction_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(40).limit(20).select("o_orderkey", "o_totalprice")


def active_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional conjuncts: brand and a price range in cents, newest (highest key) first, one page."""
    price = money.to_cents(F.col("p_retailprice"))
    return table(spark, sf_dir, "part").where((F.col("p_brand") == "Brand#11") & price.between(90000, 120000)).orderBy(F.desc("p_partkey")).limit(50).select("p_partkey", price.alias("cents"))


def buyer_latest20(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    newest = table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).where("n <= 20")
    return newest.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))


def price_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("market"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    p = F.col("p_retailprice")
    risk = market.price_risk(p, F.lit(1200.0), F.lit(600.0), F.col("market"))
    return parts.join(items, "l_partkey", "left").select("l_partkey", risk.alias("risk"))


QUERIES = {f.__name__: f for f in (market_overview, market_trend, market_analytics, competition_rank, price_volatility, buyer_persona, similar_buyers, scarcity, wallet_running_balance, order_fees, reprice_listings, yield_accrual, top_assets, transaction_page, active_listings, buyer_latest20, price_risk)}

_OVERVIEW = "SELECT p_brand, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_price, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price FROM lineitem JOIN part ON l_partkey = p_partkey"
_PERSONA = """SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a,
CASE WHEN sum(o_totalprice) > 10000 THEN 'high_value' WHEN sum(o_totalprice) > 1000 THEN 'regular' ELSE 'new' END AS segment FROM orders GROUP BY 1"""
ORACLE_SQL = {
    "market_overview": f"{_OVERVIEW} GROUP BY 1",
    "market_trend": f"""
WITH s AS (SELECT p_brand, l_extendedprice AS p, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS d FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_shipdate BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY AND TIMESTAMP '{AS_OF}'),
g AS (SELECT p_brand, count(*) AS n, avg(p) AS m, regr_slope(p, d) AS k FROM s GROUP BY 1)
SELECT p_brand, n, round(m, 4) AS mean_price, round(k, 4) AS slope, CASE WHEN k * 365 / m > 0.05 THEN 'rising' WHEN k * 365 / m < -0.05 THEN 'falling' ELSE 'stable' END AS trend FROM g""",
    "market_analytics": f"{_OVERVIEW} JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1",
    "competition_rank": """
WITH r AS (SELECT p_partkey, (rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1) / count(*) OVER (PARTITION BY p_brand) * 100.0 AS p,
(rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1) / count(*) OVER (PARTITION BY p_brand) * 100.0 AS q FROM part)
SELECT p_partkey, round(p, 6) AS price_percentile, round(q, 6) AS quality_percentile, CASE WHEN q >= 75 AND p >= 50 THEN 'leader' WHEN q >= 50 THEN 'follower' ELSE 'niche' END AS position FROM r""",
    "price_volatility": """
WITH n AS (SELECT l_partkey, l_extendedprice AS p, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_suppkey DESC) AS k FROM lineitem)
SELECT l_partkey, count(*) AS n, round(stddev_pop(p) / avg(p), 6) AS cv, stddev_pop(p) / avg(p) > 0.5 AS volatile FROM n WHERE k <= 10 GROUP BY 1""",
    "buyer_persona": f"SELECT o_custkey, n, round(s, 2) AS total, round(a, 5) AS mean, segment, CASE WHEN a > 500 THEN 'low' WHEN a > 100 THEN 'medium' ELSE 'high' END AS price_sensitivity FROM ({_PERSONA})",
    "similar_buyers": f"WITH p AS ({_PERSONA}) SELECT o_custkey, n, segment FROM p WHERE segment = (SELECT segment FROM p WHERE o_custkey = 1) AND o_custkey <> 1 ORDER BY n DESC, o_custkey LIMIT 10",
    "scarcity": "SELECT p_brand, p_type, p_size, count(*) AS n, CASE WHEN count(*) <= 1 THEN 2.0::DOUBLE WHEN count(*) <= 5 THEN 1.5 WHEN count(*) <= 20 THEN 1.2 ELSE 1.0 END AS multiplier FROM part GROUP BY 1, 2, 3",
    "wallet_running_balance": """
WITH c AS (SELECT o_orderkey, o_custkey, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
b AS (SELECT *, CAST(sum(cents) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance_after FROM c)
SELECT o_orderkey, o_custkey, cents, balance_after, balance_after - cents AS balance_before FROM b""",
    "order_fees": "WITH c AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) SELECT o_orderkey, cents, cents * 5 // 100 AS fee_cents, cents - cents * 5 // 100 AS income_cents FROM c",
    "reprice_listings": """
WITH s AS (SELECT l_partkey, count(*) AS buys FROM lineitem GROUP BY 1),
p AS (SELECT p_partkey AS l_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS cents, (2 * coalesce(buys, 0) + 0.15::DOUBLE * (p_size % 10)) / 6 AS demand FROM part LEFT JOIN s ON l_partkey = p_partkey)
SELECT l_partkey, cents, greatest(1, CAST(trunc(cents * CASE WHEN demand >= 10 THEN 1.03::DOUBLE WHEN demand <= 2 THEN 0.99::DOUBLE ELSE 1.0::DOUBLE END) AS BIGINT)) AS new_cents FROM p""",
    "yield_accrual": """
WITH b AS (SELECT s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) AS cents, ['aggressive', 'balanced', 'conservative'][s_suppkey % 3 + 1] AS strategy FROM supplier)
SELECT s_suppkey, cents, strategy, CASE WHEN cents > 0 THEN CAST(trunc(cents * CASE strategy WHEN 'aggressive' THEN 0.15::DOUBLE WHEN 'balanced' THEN 0.08::DOUBLE ELSE 0.03::DOUBLE END * 30 / 365) AS BIGINT) ELSE 0 END AS yield_cents FROM b""",
    "top_assets": "SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 5",
    "transaction_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40",
    "active_listings": "SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part WHERE p_brand = 'Brand#11' AND CAST(round(p_retailprice * 100) AS BIGINT) BETWEEN 90000 AND 120000 ORDER BY p_partkey DESC LIMIT 50",
    "buyer_latest20": """SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spent FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 20 GROUP BY 1""",
    "price_risk": """
WITH m AS (SELECT l_partkey, avg(l_extendedprice / l_quantity) AS market FROM lineitem GROUP BY 1)
SELECT p_partkey AS l_partkey, greatest(CASE WHEN p_retailprice < 600 THEN 2 WHEN p_retailprice > 1200 THEN 1 ELSE 0 END,
CASE WHEN p_retailprice / market > 2 OR p_retailprice / market < 0.5 THEN 1 ELSE 0 END, CASE WHEN p_retailprice > 1000000 THEN 2 ELSE 0 END) AS risk FROM part LEFT JOIN m ON l_partkey = p_partkey""",
}
