"""Queries over ``customer`` and ``orders`` under access policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance
from ..operators import governed_sql as sql
from ..sources.tables import table

AS_OF = "2001-12-01 00:00:00"


def governed_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = {"customer": sql.Relation(table(spark, sf_dir, "customer"), ("c_custkey",))}
    return sql.governed_sql(spark, "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_mktsegment", "read_only", relations)


def governed_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that rest on five customers and five orders at least; the limit within the query doesn't matter."""
    relations = {"customer": sql.Relation(table(spark, sf_dir, "customer"), ("c_custkey",)), "orders": sql.Relation(table(spark, sf_dir, "orders"), ("o_orderkey",))}
    query = """WITH joined AS (SELECT c_nationkey, c_mktsegment, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey)
    SELECT c_nationkey, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM joined GROUP BY c_nationkey, c_mktsegment"""
    return sql.governed_sql(spark, query, "analytics", relations)


def governed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of the nations that a buyer holds live grants on, counted by segment."""
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    grants = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("asset"), F.lit(7).alias("buyer"), F.when(F.col("n_nationkey") % 3 == 0, "active").otherwise("revoked").alias("status"), day("2000-01-01").alias("valid_from"), F.when(F.col("n_nationkey") % 2 == 0, day("2002-01-01")).otherwise(day("2001-01-01")).alias("valid_until"))
    relations = {"customer": sql.Relation(table(spark, sf_dir, "customer"), ("c_custkey",), "c_nationkey")}
    return sql.governed_sql(spark, "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment", "analytics", relations, grants, 7, AS_OF)


def governed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return governance.governed_aggregate(rows, ["c_nationkey", "c_mktsegment"], {"total": F.round(F.sum("c_acctbal"), 2)}, "analytics")


def pseudonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.pseudonymize(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_name")


def k_anonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    quasi = {"c_acctbal": governance.decade(F.col("c_acctbal") / 100), "c_nationkey": F.floor(F.col("c_nationkey") / 5)}
    return governance.k_anonymize(rows, quasi, 20)


def watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey")
    marked = governance.watermark(rows, "invisible", "t1", 4711, AS_OF, "s_suppkey")
    return governance.watermark(marked, "fingerprint", "t1", 4711, AS_OF, "s_suppkey")


def laplace_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", governance.laplace(F.col("c_acctbal"), 0.5, 1.0, 42, F.col("c_custkey")).alias("noisy"))


def rights_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    grants = o.select(
        F.col("o_custkey").alias("buyer"), (F.col("o_orderkey") % 50).alias("asset"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("expired").alias("status"),
        F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("INTERVAL 1000 DAYS")).alias("valid_until"),
        F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("view"), F.lit("derivative"))).otherwise(F.array(F.lit("view"))).alias("rights"),
    )
    return governance.has_right(grants, "derivative", AS_OF)


def protocol_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = governance.best_protocol(governance.protocol_scores(spark))
    return best.select("sensitivity", "method", F.round("score", 6).alias("score"), governance.epsilon(F.col("sensitivity")).alias("epsilon"))


QUERIES = {f.__name__: f for f in (governed_sql, governed_analytics, governed_rows, governed_groups, pseudonymize, k_anonymize, watermark, laplace_noise, rights_check, protocol_choice)}

ORACLE_SQL = {
    "governed_sql": "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1 LIMIT 100",
    "governed_analytics": """SELECT c_nationkey, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey
GROUP BY 1, 2 HAVING count(DISTINCT c_custkey) >= 5 AND count(DISTINCT o_orderkey) >= 5""",
    "governed_rows": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey % 6 = 0 GROUP BY 1 HAVING count(*) >= 5",
    "governed_groups": "SELECT c_nationkey, c_mktsegment, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1, 2 HAVING count(*) >= 5",
    "pseudonymize": "SELECT c_custkey, 'PSEUDO_' || left(sha256(c_name), 12) AS c_name, c_mktsegment FROM customer",
    "k_anonymize": """
WITH g AS (SELECT c_custkey, CAST(floor(c_nationkey / 5) AS BIGINT) AS c_nationkey, CAST(CAST(floor(c_acctbal / 100 / 10) * 10 AS BIGINT) AS VARCHAR) || 's' AS c_acctbal, c_mktsegment FROM customer)
SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY c_nationkey, c_acctbal) >= 20""",
    "watermark": f"SELECT s_suppkey, 4711 % 100 + s_suppkey % 1000003 AS _wm, left(sha256('t1:4711:{AS_OF}'), 16) AS _fingerprint FROM supplier",
    "rights_check": f"""SELECT DISTINCT o_custkey AS buyer, o_orderkey % 50 AS asset FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '{AS_OF}'
AND o_orderdate + INTERVAL 1000 DAY >= TIMESTAMP '{AS_OF}' AND o_orderkey % 3 = 0""",
    "protocol_choice": """SELECT * FROM (VALUES ('low', 'mpc', 0.69::DOUBLE, 2.0::DOUBLE), ('medium', 'mpc', 0.69, 1.0), ('high', 'mpc', 0.69, 0.5), ('critical', 'mpc', 0.69, 0.1)) t(sensitivity, method, score, epsilon)""",
}
