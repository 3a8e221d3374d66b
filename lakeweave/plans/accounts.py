"""Queries over orders, events, parts and conversations about buyers, memories, jobs and assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accounts, audit, features, graph, stateful, trading
from ..sources.tables import table
from .features import _links, _nodes

AS_OF = "2001-12-01 00:00:00"


def _pick(index, *values):
    return F.element_at(F.array(*(v if not isinstance(v, (str, int, float)) else F.lit(v) for v in values)), (index % len(values) + 1).cast("int"))


def wallet_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", (F.round(F.col("o_totalprice") * 100) * F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)).cast("long").alias("cents"))
    out = accounts.transaction_history(o, "o_custkey", ["o_orderdate", "o_orderkey"], "cents", 5, 2)
    return out.select("o_custkey", "o_orderkey", *(F.round(c, 2).alias(c) for c in ("amount", "balance_before", "balance_after")))


def buyer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = accounts.buyer_profiles(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")
    return out.withColumn("total_spent", F.round("total_spent", 2))


def asset_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("on_sale", F.col("p_partkey") % 3 > 0)
    return accounts.recommendations(parts, "p_partkey", "p_name", "p_size", "p_retailprice")


def access_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 5 > 0, F.floor("value")).alias("rows"), "props", "ts")
    return accounts.usage_stats(e, "user_id", "rows", "props", "ts").withColumn("last_access", F.unix_micros(F.col("last_access").cast("timestamp")))


def quality_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "lang", F.when(F.col("doc_id") % 7 > 0, F.col("n_chars")).alias("n_chars"), F.when(F.col("doc_id") % 5 > 0, F.col("text")).otherwise(" ").alias("text"))
    out = accounts.quality_profile(d, "source", ["lang", "n_chars", "text"])
    return out.select("source", *(F.round(c, 6).alias(c) for c in ("completeness", "accuracy", "timeliness", "consistency", "uniqueness")))


def recorded_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select("event_id", (F.col("user_id") % 40).alias("transaction"), _pick(k, "research", "sale", "test").alias("purpose"), _pick(k, "tee", "raw").alias("method"), _pick(k, "SELECT  a FROM t", "select * from t", "SELECT count(*) FROM t JOIN u GROUP BY a").alias("query"),
                    F.col("ts"), (k % 13 * 10_000_000).alias("size_bytes"), (k % 5000).alias("rows"), (k % 10 / 10).alias("frequency"), (k % 20).alias("gap_s"), (k % 14).alias("growth"))
    grants = e.where("user_id < 30").select((F.col("user_id") % 40).alias("transaction")).distinct().select("transaction", F.array(F.lit("research"), F.lit("test")).alias("purposes"), F.lit("tee").alias("grant_method"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz").alias("valid_until"), (F.col("transaction") % 2 == 0).alias("aggregate_only"))
    out = accounts.recorded_accesses(rows, grants)
    return out.select("event_id", "fingerprint", F.round("complexity", 6).alias("complexity"), "compliance", F.array_join("violations", ",").alias("violations"), F.array_join("flags", ",").alias("flags"), F.round("risk", 6).alias("risk"), "response")


def advised_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    risk = F.when(F.col("event_type") == "error", 0.9).when(F.col("event_type") == "purchase", 0.5).otherwise((F.col("event_id") % 4) / 10)
    s = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(risk), 9).alias("risk"), F.count_if((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0)).alias("violations"))
    return accounts.with_recommendations(s, "n", "risk", "violations").select("user_id", "violations", F.array_join("advice", "; ").alias("advice"))


def last_day_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses and violations of the last day of events, by user."""
    e = table(spark, sf_dir, "events")
    day = audit.since(e, "ts", "2024-01-31 00:00:00", 1)
    return day.groupBy("user_id").agg(F.count(F.lit(1)).alias("accesses"), F.count_if(F.col("event_type") == "error").alias("violations"))


def adaptive_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", stateful.seconds("ts").alias("at"))
    return accounts.adaptive_window(e, "user_id", ["at", "event_id"], "at", "value", 3, 86400.0 * 5, 2, 6).select("event_id", "allowed", "limit")


def added_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    writes = table(spark, sf_dir, "conversations").select(F.concat_ws("-", c, "turn").alias("memory"), c.alias("user"), F.when(F.col("turn") < 4, F.col("text")).alias("content"), F.when(F.col("turn") % 2 == 0, "preference").alias("kind"), F.when(c % 3 == 0, F.col("turn") % 10).alias("importance"), F.when(c % 4 == 0, F.lit(AS_OF).cast("timestamp_ntz")).alias("expires_at"))
    out = accounts.new_memories(writes, "memory", "user", "content")
    return out.select("memory", "kind", "importance", F.col("expires_at").isNotNull().alias("expires"), F.size("embedding").alias("places"), F.try_element_at("context", F.lit("embedding_model")).alias("model"))


def graph_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each node its vector's length, its place in the graph and its network value, in one row."""
    nodes, topology = _nodes(spark, sf_dir), graph.topology(_links(spark, sf_dir))
    value = features.value_features(nodes, topology.select("id", "degree", "clustering"))
    out = nodes.select("id", F.round(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)), 5).alias("length")).join(topology, "id", "left").join(value, "id")
    return out.select("id", "length", "degree", "triangles", F.round("clustering", 6).alias("clustering"), F.round("value", 4).alias("value"))


def loaded_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    t = o.select(F.col("o_orderkey").alias("transaction"), F.col("o_custkey").alias("buyer"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("closed").alias("status"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderdate") + F.expr("INTERVAL 1 YEAR")).alias("valid_until"))
    asked = o.select(F.col("o_orderkey").alias("transaction"), (F.col("o_custkey") - F.col("o_orderkey") % 2).alias("buyer"))
    return accounts.loaded_transactions(asked, t, AS_OF).select("transaction", "buyer")


def negotiated_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items bought at an agreed price of two thirds, cut to whole cents."""
    agreed = F.col("l_extendedprice").cast("decimal(15,2)") * 2 / 3
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("buyer"), F.col("l_partkey").alias("listing"), (F.col("l_partkey") % 97).alias("seller"), accounts.negotiated_cents(agreed).alias("cents"), "l_orderkey", "l_linenumber")
    out = trading.purchases(rows, ["l_orderkey", "l_linenumber", "listing", "cents"], 2**60)
    return out.where("status = 'bought'").groupBy("buyer").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


def holding_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    first = li.groupBy(F.col("l_suppkey").alias("buyer"), F.col("l_partkey").alias("listing")).agg(F.min("l_orderkey").alias("order"), F.min("l_shipdate").alias("purchased_at"))
    listings = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("listing"), F.col("p_name").alias("title"), (F.col("p_partkey") % 97).alias("seller"))
    return accounts.orders_of_holdings(first, listings).select("buyer", "order", "listing", "title", "seller")


def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    jobs = d.where("doc_id % 3 > 0").select(F.col("doc_id").alias("job"), _pick(F.col("doc_id"), "queued", "running", "done").alias("status"))
    queue = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("job"), _pick(F.col("doc_id"), "STARTED", "SUCCESS").alias("state"))
    return accounts.job_status(d.select(F.col("doc_id").alias("job")), jobs, queue)


def anonymization_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as samples whose fields differ: some have a name, some an age and a location."""
    k = F.col("c_custkey")
    sample = F.to_json(F.struct(F.when(k % 2 == 0, F.col("c_name")).alias("name"), F.when(k % 3 == 0, F.col("c_acctbal")).alias("age"), F.when(k % 5 > 0, F.col("c_nationkey")).alias("location"), F.col("c_mktsegment").alias("segment")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", sample.alias("sample"))
    out = accounts.anonymization_needs(rows, _pick(k, "low", "medium", "high", "critical"), F.json_object_keys("sample"))
    return out.select("c_custkey", "level", F.array_join("factors", ",").alias("factors"))


def trade_mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as goals; a buyer's first order is a first transaction."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    first = o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("_first"))
    goals = o.join(first, "o_custkey").select("o_orderkey", (F.col("o_totalprice") / 20).alias("target_price"), _pick(k, "auto", "auction", "direct", "negotiation").alias("preferred"), (k == F.col("_first")).alias("first"), _pick(k, "low", "low", "low", "low", "high").alias("risk_level"), (k % 11 == 0).alias("review"))
    return accounts.mechanisms(goals).select("o_orderkey", "mechanism", "approval", "downgraded")


def merged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks of their conversation, small ones merged."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    out = turns.select("conv_id", accounts.merged_small(F.transform("turns", lambda t: t["text"])).alias("chunks"))
    return out.select("conv_id", F.size("chunks").alias("chunks"), F.array_join(F.transform("chunks", lambda c: F.length(c).cast("string")), ",").alias("sizes"))


QUERIES = {f.__name__: f for f in (
    wallet_history, buyer_profiles, asset_recommendations, access_usage, quality_profiles, recorded_accesses, advised_audits, last_day_metrics, adaptive_window,
    added_memories, graph_features, loaded_transactions, negotiated_purchases, holding_orders, job_status, anonymization_needs, trade_mechanisms, merged_chunks,
)}

_LINKS = "l AS (SELECT DISTINCT vec_id AS src, unnest([(vec_id * 7 + 1) % (SELECT count(*) FROM embeddings), (vec_id * 3 + 2) % (SELECT count(*) FROM embeddings)]) AS dst FROM embeddings)"
ORACLE_SQL = {
    "wallet_history": """
WITH m AS (SELECT o_custkey, o_orderkey, o_orderdate, (round(o_totalprice * 100) * CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END)::BIGINT AS c FROM orders),
w AS (SELECT *, sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM m)
SELECT o_custkey, o_orderkey, round(c / 100, 2) AS amount, round((s - c) / 100, 2) AS balance_before, round(s / 100, 2) AS balance_after FROM w WHERE n > 2 AND n <= 7""",
    "buyer_profiles": "SELECT o_custkey, count(*) AS total_count, round(sum(o_totalprice), 2) AS total_spent, 0.8::DOUBLE AS reputation FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 20 GROUP BY 1",
    "asset_recommendations": "SELECT p_partkey AS asset, p_name AS name, p_size AS relevance, p_retailprice AS price, 'high quality' AS reason FROM part WHERE p_partkey % 3 > 0 ORDER BY p_size DESC, p_partkey LIMIT 10",
    "access_usage": "SELECT user_id, count(*) AS total_accesses, sum(CASE WHEN event_id % 5 > 0 THEN floor(value) ELSE 0 END)::BIGINT AS total_rows, count(DISTINCT props) AS unique_queries, epoch_us(max(ts)) AS last_access FROM events GROUP BY 1",
    "quality_profiles": """
WITH d AS (SELECT source, lang, CASE WHEN doc_id % 7 > 0 THEN n_chars END AS c, CASE WHEN doc_id % 5 > 0 THEN text ELSE ' ' END AS t FROM documents),
m AS (SELECT *, (coalesce(trim(lang), '') <> '')::INT AS a, (c IS NOT NULL)::INT AS b, (coalesce(trim(t, ' '), '') <> '')::INT AS e FROM d),
s AS (SELECT source, max(k) AS most FROM (SELECT source, a, b, e, count(*) AS k FROM m GROUP BY ALL) GROUP BY 1),
u AS (SELECT source, count(*) AS n, sum(a + b + e) AS filled, count(DISTINCT (lang, c, t)) AS d FROM m GROUP BY 1)
SELECT source, round(filled / (n * 3), 6) AS completeness, 0.8::DOUBLE AS accuracy, 0.9::DOUBLE AS timeliness, round(most / n, 6) AS consistency, round(d / n, 6) AS uniqueness FROM u JOIN s USING (source)""",
    "advised_audits": """
WITH s AS (SELECT user_id, count(*) AS n, round(avg(CASE WHEN event_type = 'error' THEN 0.9::DOUBLE WHEN event_type = 'purchase' THEN 0.5::DOUBLE ELSE (event_id % 4) / 10.0::DOUBLE END), 9) AS risk, count_if(event_type = 'error' AND event_id % 5 = 0)::BIGINT AS violations FROM events GROUP BY 1)
SELECT user_id, violations, concat_ws('; ', CASE WHEN risk > 0.5 THEN 'review the access policy' END, CASE WHEN violations > 0 THEN 'handle ' || violations || ' violations' END, CASE WHEN n > 1000 THEN 'check for misuse' END) AS advice FROM s""",
    "last_day_metrics": "SELECT user_id, count(*) AS accesses, count_if(event_type = 'error')::BIGINT AS violations FROM events WHERE ts >= TIMESTAMP '2024-01-30' AND ts <= TIMESTAMP '2024-01-31' GROUP BY 1",
    "added_memories": """
SELECT conv_id || '-' || turn AS memory, CASE WHEN turn % 2 = 0 THEN 'preference' ELSE 'fact' END AS kind, CASE WHEN conv_id % 3 = 0 THEN turn % 10 ELSE 5 END::INT AS importance, conv_id % 4 = 0 AS expires,
CASE WHEN turn < 4 AND regexp_matches(text, '[\\p{L}\\p{N}]') THEN 64 END::INT AS places, CASE WHEN turn < 4 AND regexp_matches(text, '[\\p{L}\\p{N}]') THEN 'hashed-words' END AS model FROM conversations""",
    "graph_features": f"""
WITH {_LINKS}, e AS (SELECT src AS a, dst AS b FROM l WHERE src <> dst UNION SELECT dst, src FROM l WHERE src <> dst), d AS (SELECT a AS id, count(*) AS degree FROM e GROUP BY 1),
t AS (SELECT x.a AS id, count(*) // 2 AS triangles FROM e x JOIN e y ON y.a = x.b JOIN e z ON z.a = y.b AND z.b = x.a GROUP BY 1),
n AS (SELECT vec_id AS id, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS len FROM embeddings),
f AS (SELECT id, len, degree, CASE WHEN degree IS NOT NULL THEN coalesce(triangles, 0) END AS triangles, CASE WHEN degree IS NULL THEN NULL WHEN degree > 1 THEN 2 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END AS c FROM n LEFT JOIN d USING (id) LEFT JOIN t USING (id))
SELECT id, round(len, 5) AS length, degree, triangles, round(c, 6) AS clustering, round(least(100, 0.4::DOUBLE * least(len * 100, 100) + 30 * coalesce(degree, 0) / greatest((SELECT max(degree) FROM d), 1) + 30 * coalesce(c, 0)), 4) AS value FROM f""",
    "loaded_transactions": f"SELECT o_orderkey AS transaction, o_custkey AS buyer FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0 AND (o_orderkey % 4 = 0 OR o_orderdate + INTERVAL 1 YEAR >= TIMESTAMP '{AS_OF}')",
    "negotiated_purchases": """
WITH r AS (SELECT l_suppkey AS buyer, l_partkey AS listing, floor(round(l_extendedprice::DECIMAL(15, 2) * 100)::BIGINT * 2 / 3)::BIGINT AS cents, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) AS k FROM lineitem WHERE l_suppkey <> l_partkey % 97)
SELECT buyer, count(*) AS n, sum(cents)::BIGINT AS cents FROM r WHERE k = 1 GROUP BY 1""",
    "holding_orders": "SELECT l_suppkey AS buyer, min(l_orderkey) AS order, l_partkey AS listing, p_name AS title, 'seller-' || left(sha256((p_partkey % 97)::VARCHAR), 8) AS seller FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, l_partkey, p_name, p_partkey",
    "job_status": """SELECT doc_id AS job, CASE WHEN doc_id % 3 > 0 THEN ['queued', 'running', 'done'][doc_id % 3 + 1] END AS status, CASE WHEN doc_id % 3 > 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'STARTED' ELSE 'PENDING' END END AS queue_status,
CASE WHEN doc_id % 3 = 0 THEN 'not found' END AS error FROM documents""",
    "anonymization_needs": """
SELECT c_custkey, ['L1', 'L2', 'L3', 'L4'][c_custkey % 4 + 1] AS level, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'direct identifiers' END, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 > 0 THEN 'several quasi-identifiers' END) AS factors FROM customer""",
    "trade_mechanisms": """
WITH f AS (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY 1)
SELECT o_orderkey, 'direct' AS mechanism, o_orderkey % 11 = 0 OR o_totalprice / 20 > 10000 OR o_orderkey = k OR o_orderkey % 5 = 4 AS approval, o_orderkey % 4 IN (1, 3) AS downgraded FROM orders JOIN f USING (o_custkey)""",
    "merged_chunks": """
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, length(coalesce(text, '')) AS n FROM conversations),
r AS (SELECT conv_id, k, [n] AS sizes FROM t WHERE k = 1 UNION ALL SELECT t.conv_id, t.k, CASE WHEN sizes[-1] < 400 THEN list_append(sizes[:len(sizes) - 1], sizes[-1] + 1 + n) ELSE list_append(sizes, n) END FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1)
SELECT conv_id, len(sizes)::INT AS chunks, array_to_string(sizes, ',') AS sizes FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1""",
}
