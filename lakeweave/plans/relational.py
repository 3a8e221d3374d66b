"""Relational completeness: every join kind, grouping sets, set operations, windows, as-of and range joins, DML as projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins
from ..sources import tables
from ..sources.tables import table


def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    return s.join(c, F.col("s_nationkey") == F.col("c_nationkey"), "full").select(F.coalesce("s_nationkey", "c_nationkey").alias("nation"), "suppliers", "customers")


def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view of the same user at or before each purchase."""
    e = table(spark, sf_dir, "events")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    viewed = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return joins.as_of(bought, viewed, ["user_id"], "ts", "view_id").select("event_id", "view_id")


def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors within the hour after a signup of the same user."""
    e = table(spark, sf_dir, "events")
    start = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("start_ts"), F.col("event_id").alias("signup_id"))
    point = e.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("error_id"))
    return joins.within(start, point, ["user_id"], "start_ts", "ts", 3600).select("signup_id", "error_id")


def group_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").rollup("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))


def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).union(table(spark, sf_dir, "customer").select("c_nationkey")).distinct()


def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")))


def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf_dir, "orders").select("o_custkey"))


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type."""
    return joins.first_of(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def latest_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("ts").alias("last_ts"))


def window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("c_nationkey", "c_custkey", "rn")


def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming balances replace those of equal key; others are kept."""
    now = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    incoming = now.where("s_suppkey % 3 = 0").select((F.col("s_suppkey") + 50).alias("s_suppkey"), F.lit(1.0).alias("s_acctbal"))
    return tables.merge(now, incoming, ["s_suppkey"])


def prefix_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder's new path in all its descendants' paths."""
    path = F.concat(F.lit("/a/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey"))
    old, new = "/a/Brand#11/", "/b/first/"
    return table(spark, sf_dir, "part").select("p_partkey", F.when(path.startswith(old), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(path).alias("path"))


def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation and customer as a tree: children of each folder and their number of files."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    leaves = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("files"))
    return n.join(leaves, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("children"), F.sum(F.coalesce("files", F.lit(0))).alias("files"))


def role_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by role against the role's rights, a small literal table."""
    matrix = spark.createDataFrame([("owner", "read"), ("owner", "write"), ("owner", "delete"), ("owner", "share"), ("admin", "read"), ("admin", "write"), ("admin", "share"), ("editor", "read"), ("editor", "write"), ("viewer", "read")], "role string, permission string")
    roles = F.array(*map(F.lit, ("owner", "admin", "editor", "viewer")))
    members = table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(roles, F.col("n_nationkey") % 4 + 1).alias("role"))
    return members.join(F.broadcast(matrix), "role").groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("permission") == "write").alias("can_write"))


QUERIES = {f.__name__: f for f in (join_semi, join_anti, join_left, join_full, join_asof, join_interval, group_cube, group_rollup, set_union, set_intersect, set_except, dedup_first, latest_of, window_rank, merge_upsert, prefix_rename, tree_children, role_permissions)}

ORACLE_SQL = {
    "join_semi": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "join_full": """SELECT coalesce(s_nationkey, c_nationkey) AS nation, suppliers, customers FROM (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1)
FULL JOIN (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON s_nationkey = c_nationkey""",
    "join_asof": """
WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT p.event_id, v.view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    "join_interval": """SELECT s.event_id AS signup_id, p.event_id AS error_id FROM events s JOIN events p ON s.user_id = p.user_id AND p.ts >= s.ts AND p.ts <= s.ts + INTERVAL 1 HOUR
WHERE s.event_type = 'signup' AND p.event_type = 'error'""",
    "group_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (1, 2)",
    "group_rollup": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ROLLUP (1, 2)",
    "set_union": "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer",
    "set_intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT s_suppkey FROM supplier",
    "set_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "dedup_first": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1",
    "latest_of": "SELECT user_id, event_type AS last_type, ts AS last_ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "window_rank": "SELECT c_nationkey, c_custkey, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3",
    "merge_upsert": """
WITH i AS (SELECT s_suppkey + 50 AS s_suppkey, 1.0::DOUBLE AS s_acctbal FROM supplier WHERE s_suppkey % 3 = 0)
SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM i) UNION ALL SELECT * FROM i""",
    "prefix_rename": "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN '/b/first/' || p_partkey ELSE '/a/' || p_brand || '/' || p_partkey END AS path FROM part",
    "tree_children": """SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS children, CAST(sum(coalesce(files, 0)) AS BIGINT) AS files FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS files FROM customer GROUP BY 1) ON n_nationkey = c_nationkey GROUP BY 1""",
    "role_permissions": """
WITH m(role, permission) AS (VALUES ('owner','read'),('owner','write'),('owner','delete'),('owner','share'),('admin','read'),('admin','write'),('admin','share'),('editor','read'),('editor','write'),('viewer','read')),
r AS (SELECT n_nationkey, ['owner','admin','editor','viewer'][n_nationkey % 4 + 1] AS role FROM nation)
SELECT n_nationkey, count(*) AS n, bool_or(permission = 'write') AS can_write FROM r JOIN m USING (role) GROUP BY 1""",
}
