"""Queries on permissions, trading, memory, communities, jobs and enforcement, built from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prompting
from ..functions import sql as sql_functions
from ..operators import access, communities, enforcement, jobs, memory, trading
from ..sources.tables import table

AS_OF = "2024-01-31 00:00:00"


def _pick(index, *values):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def permission_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    requests = c.select(F.col("c_custkey").alias("request"), (F.col("c_custkey") % 50).alias("user"), F.col("c_nationkey").alias("space"), F.lit("file").alias("kind"), (F.col("c_custkey") % 20).alias("resource"), _pick(F.col("c_custkey"), "read", "write", "delete", "share").alias("permission"))
    key = F.col("s_suppkey")
    entries = s.select((key % 50).alias("user"), F.lit("file").alias("kind"), (key % 20).alias("resource"), F.when(key % 2 == 0, F.array(F.lit("read"))).otherwise(F.array(F.lit("read"), F.lit("write"))).alias("permissions"), F.when(key % 3 == 0, F.lit("2000-01-01").cast("timestamp_ntz")).alias("expires_at"), (key % 7 == 0).alias("is_public"))
    k = F.col("n_nationkey")
    members = n.select(k.alias("space"), (k * 2 % 50).cast("long").alias("user"), _pick(k, "owner", "admin", "editor", "viewer").alias("role"), F.when(k % 5 == 0, "inactive").otherwise("active").alias("status"), F.when(k % 6 == 0, F.array(F.lit("*"))).alias("permissions"))
    return access.decide(requests, entries, members, AS_OF).select("request", "allowed", "by")


def derivative_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    wanted = o.select((F.col("o_custkey") % 100).alias("user"), (F.col("o_orderkey") % 50).alias("asset")).distinct()
    assets = p.select(F.col("p_partkey").alias("asset"), (F.col("p_partkey") % 100).alias("owner"))
    rights = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("view"), F.lit("derivative_right"))).otherwise(F.array(F.lit("view")))
    grants = o.select((F.col("o_custkey") % 100).alias("user"), (F.col("o_orderkey") % 50).alias("asset"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("closed").alias("status"), F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("INTERVAL 2 YEARS")).alias("valid_until"), rights.alias("rights"))
    return access.derivative_violations(wanted, assets, grants, "2000-01-01 00:00:00")


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("buyer"), F.col("l_partkey").alias("listing"), (F.col("l_partkey") % 97).alias("seller"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), "l_orderkey", "l_linenumber")
    return trading.purchases(rows, ["l_orderkey", "l_linenumber", "listing", "cents"], 100_000_000)


def purchase_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _settled(spark, sf_dir).select("l_orderkey", "l_linenumber", "buyer", "listing", "seller", "cents", "status", "balance")


def purchase_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trading.ledger(_settled(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


def listing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trading.listing_stats(_settled(spark, sf_dir))


def wallet_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trading.wallet_stats(_settled(spark, sf_dir))


def transfer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net movement of each account over order values passed from customer to customer."""
    moves = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("src"), (F.col("o_orderkey") % 100).alias("dst"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return trading.transfers(moves).groupBy("account").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


def version_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 4).alias("expected"))
    return trading.compare_and_append(e, "user_id", ["ts", "event_id"], "expected")


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    expires = F.when(F.col("event_id") % 2 == 1, F.col("ts") + F.expr("INTERVAL 10 DAYS"))
    return e.select(F.col("event_id").alias("memory"), "user_id", F.col("event_type").alias("kind"), (F.col("event_id") % 10 + 1).alias("importance"), expires.alias("expires_at"), "ts", "value")


def preference_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    writes = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("key"), "ts", "event_id", "value", (F.col("event_id") % 10 / 10).alias("confidence"))
    out = memory.preferences(writes, ["user_id", "key"], ["ts", "event_id"])
    return out.withColumn("confidence", F.round(F.col("confidence") + 1e-9, 6))  # sums of halves end on ties


def live_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.live_memories(_memories(spark, sf_dir), AS_OF, "click", 5).select("memory", "importance")


def memory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.memory_summary(_memories(spark, sf_dir)).withColumn("importance", F.round("importance", 6))


def memory_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    sessions = c.select(F.col("conv_id").alias("session")).distinct().select("session", (F.col("session") % 20).alias("user"), F.when(F.col("session") % 3 == 0, "active").otherwise("archived").alias("status"))
    return memory.session_stats(sessions, c.select(F.col("conv_id").alias("session")))


def workflow_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _memories(spark, sf_dir).select(F.col("user_id").alias("task"), F.col("kind").alias("step"), F.col("value").alias("result"), "ts", F.col("memory").alias("event_id"), "expires_at")
    kept = memory.checkpoints(steps, ["ts", "event_id"], AS_OF)
    return memory.restored(kept, ["ts", "event_id"]).select("task", F.array_join("steps", ",").alias("steps"), F.round(F.try_element_at("results", F.lit("click")), 6).alias("click"))


def checkpoint_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.checkpoint_stats(_memories(spark, sf_dir).withColumnRenamed("user_id", "task"), AS_OF)


def community_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("community"))
    episodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("episode"), F.col("c_nationkey").alias("community"))
    entities = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("community"))
    return communities.community_stats(c, episodes, entities)


def entity_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("dst"), F.col("l_returnflag").alias("fact")).distinct()
    return communities.facts_of(links).groupBy("entity", "direction").agg(F.count(F.lit(1)).alias("n"))


def query_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    asked = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    queries = asked.select(F.col("c_custkey").alias("query"), F.concat(F.lit("Offers for "), F.col("c_mktsegment"), F.lit(" in "), F.initcap("n_name"), F.lit("?")).alias("text"))
    return communities.entities_in_queries(queries, n.select(F.col("n_nationkey").alias("entity"), F.col("n_name").alias("name")))


def entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents of their nation; nations stand in a ring; those of a region are asked for."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") + 1) % 25).alias("b"))
    links = n.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(n.select("b", "a"))
    asked = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("entity"))
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document"), F.col("c_nationkey").alias("entity"))
    return communities.by_entities(docs, links, asked, 2).select("document", "hop", F.round("score", 6).alias("score"))


def blended_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    vectors = p.where("p_partkey % 2 = 0").select("p_partkey", (F.col("p_size") / 50).alias("score"))
    graph = p.where("p_partkey % 3 = 0").select("p_partkey", (F.col("p_partkey") % 10 / 10).alias("score"))
    return communities.blended(vectors, graph, "p_partkey", 0.3).withColumn("score", F.round("score", 6))


def event_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("actor"), F.lit("event").alias("kind"), "ts", "event_id")
    _, edges = communities.event_graph(e, ["ts", "event_id"])
    return edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def relation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.format_string('{"edges": [{"source": " %s ", "target": "region %d", "name": "lies_in", "fact": "f", "confidence": 0.5}, {"src": "x", "dst": "y"}]}', F.col("n_name"), F.col("n_regionkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.inline(communities.relation_rows(answer)))


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = _pick(F.col("event_id"), "start", "finish", "fail", "cancel", "requeue")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", action.alias("action"))
    return jobs.replayed(e, "user_id", ["ts", "event_id"], "action")


def space_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("space", F.col("user_id") % 10)
    return jobs.space_report(e, "space", "ts", AS_OF, 7)


def policy_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    asked = _pick(F.col("event_id"), "SELECT * FROM t", "SELECT count(*) FROM t", "SELECT k, sum(v) FROM t GROUP BY k")
    accesses = e.select("event_id", F.col("user_id").alias("transaction"), F.col("event_type").alias("purpose"), _pick(F.col("event_id"), "mpc", "tee").alias("method"), asked.alias("query"), "ts", "value")
    grants = e.where("user_id % 5 <> 0").select(F.col("user_id").alias("transaction")).distinct()
    t = F.col("transaction")
    grants = grants.select("transaction", F.array(F.lit("view"), F.lit("click")).alias("purposes"), F.lit("mpc").alias("grant_method"), F.lit("2024-01-20").cast("timestamp_ntz").alias("valid_until"), F.when(t % 2 == 0, F.lit(False)).alias("aggregate_only"))
    out = enforcement.compliance(accesses, grants)
    flags = enforcement.anomaly_flags(F.lit(0.0), F.col("query"), F.lit(0), F.col("violations"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    return out.select("event_id", F.array_join("violations", ",").alias("violations"), "compliance", F.array_join(flags, ",").alias("flags"))


def price_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    market = p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("market"))
    price = F.col("p_retailprice") * _pick(F.col("p_partkey"), 1.0, 3.0, 0.2)
    found = enforcement.price_findings(price, F.col("p_retailprice") * 0.8, F.col("p_retailprice") * 1.3, F.col("market"), F.lit(None).cast("double"))
    rows = p.join(market, "p_brand").select("p_partkey", found.alias("f"))
    return rows.select("p_partkey", enforcement.overall_level(F.col("f")).alias("level"), F.array_contains(F.transform("f", lambda x: x["name"]), "below_estimate").alias("below"))


def sensitivity_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    fields = F.when(k % 3 == 0, F.array(F.lit("Password_hash"))).otherwise(F.array(F.lit("age")))
    return table(spark, sf_dir, "nation").select("n_nationkey", enforcement.sensitivity(_pick(k, "medical", "banking", "personal", "other"), k % 2 == 0, fields).alias("level"))


def context_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    block = prompting.context_block(F.col("turn"), F.col("role"), F.lit(None).cast("string"), F.col("turn") / 8, F.col("text"), F.lit("note"))
    return c.select("conv_id", F.col("turn").alias("t"), block.alias("b")).groupBy("conv_id").agg(F.md5(prompting.context_text(F.col("t"), F.col("b"))).alias("hash"))


def rerank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("p_size") > 25, F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", prompting.rerank_text(F.col("p_name"), part, F.col("p_brand"), F.lit(""), F.array(F.lit("vector"), F.lit("graph"))).alias("text"))


def compact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(prompting.compact(F.col("text"), 200)).alias("hash"))


def redacted_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.format_string('{"id": %d, "user": {"Email_1": "a@b.c", "n": [{"token": 12}]}, "note": "email"}', F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", prompting.redacted_json(payload).alias("payload"))


def sql_functions_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql_functions.register(spark)
    c = table(spark, sf_dir, "customer")
    return c.selectExpr("c_custkey", "lw_fee(c_custkey * 77) AS fee", "lw_risk_level(c_custkey % 10 / 10D) AS level", "lw_masked(c_name, 3) AS masked", "lw_pseudonym(c_name) AS pseudonym", "round(lw_cosine(array(1D, c_custkey), array(c_custkey, 2D)), 6) AS cosine")


def sql_aggregate_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql_functions.register(spark)
    out = spark.sql("SELECT p_brand, lw_geometric_mean(p_retailprice) AS mean FROM {p} GROUP BY p_brand", p=table(spark, sf_dir, "part"))
    return out.select("p_brand", F.round("mean", 6).alias("mean"))


def table_function_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql_functions.register(spark)
    chunks = spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL lw_chunks(d.text) c", docs=table(spark, sf_dir, "documents"))
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("end_char").alias("last"))


QUERIES = {
    f.__name__: f
    for f in (
        permission_decisions, derivative_violations, purchase_status, purchase_ledger, listing_stats, wallet_stats, transfer_rows, version_appends, preference_upserts, live_memories, memory_summary,
        memory_sessions, workflow_restored, checkpoint_stats, community_stats, entity_facts, query_entities, entity_documents, blended_scores, event_graph, relation_answers, job_states, space_report,
        policy_compliance, price_levels, sensitivity_levels, context_texts, rerank_texts, compact_texts, redacted_payloads, sql_functions_used, sql_aggregate_used, table_function_chunks,
    )
}

_M = "m AS (SELECT event_id AS memory, user_id, event_type AS kind, event_id % 10 + 1 AS importance, CASE WHEN event_id % 2 = 1 THEN ts + INTERVAL 10 DAY END AS expires_at, ts, value FROM events)"
_LIVE = f"(expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}')"

_SETTLED = """RECURSIVE r AS (SELECT l_suppkey AS buyer, l_partkey AS listing, l_partkey % 97 AS seller, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS i FROM lineitem),
f AS (SELECT DISTINCT buyer, 0::BIGINT AS i, NULL::BIGINT AS l_orderkey, NULL::INT AS l_linenumber, NULL::BIGINT AS listing, NULL::BIGINT AS seller, NULL::BIGINT AS cents, NULL::VARCHAR AS status, 100000000::BIGINT AS balance, []::BIGINT[] AS held FROM r UNION ALL
SELECT buyer, i, l_orderkey, l_linenumber, listing, seller, cents, s, balance - CASE WHEN s = 'bought' THEN cents ELSE 0 END, CASE WHEN s = 'bought' THEN list_append(held, listing) ELSE held END FROM (
SELECT f.buyer, r.i, r.l_orderkey, r.l_linenumber, r.listing, r.seller, r.cents, balance, held, CASE WHEN f.buyer = r.seller THEN 'own' WHEN list_contains(held, r.listing) THEN 'held' WHEN r.cents > balance THEN 'short' ELSE 'bought' END AS s FROM f JOIN r ON r.buyer = f.buyer AND r.i = f.i + 1)),
p AS (SELECT * FROM f WHERE i > 0), b AS (SELECT *, CAST(trunc(cents * 5 / 100) AS BIGINT) AS fee FROM p WHERE status = 'bought')"""
_REPLAY = """RECURSIVE e AS (SELECT event_id, user_id, ts, ['start', 'finish', 'fail', 'cancel', 'requeue'][event_id % 5 + 1] AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, NULL::VARCHAR AS action, NULL::BOOLEAN AS admitted, 'queued' AS state FROM e UNION ALL
SELECT user_id, i, event_id, ts, action, nxt IS NOT NULL, coalesce(nxt, state) FROM (SELECT f.user_id, e.i, e.event_id, e.ts, e.action, state, CASE WHEN e.action = 'start' AND state IN ('queued', 'pending') THEN 'processing' WHEN e.action = 'finish' AND state = 'processing' THEN 'succeeded'
WHEN e.action = 'fail' AND state IN ('pending', 'queued', 'processing') THEN 'failed' WHEN e.action = 'cancel' AND state IN ('pending', 'queued', 'processing') THEN 'cancelled' WHEN e.action = 'requeue' AND state IN ('failed', 'cancelled') THEN 'queued' END AS nxt FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))"""
ORACLE_SQL = {
    "sql_aggregate_used": "SELECT p_brand, round(exp(avg(ln(p_retailprice))), 6) AS mean FROM part GROUP BY 1",
    "purchase_status": f"WITH {_SETTLED} SELECT l_orderkey, l_linenumber, buyer, listing, seller, cents, status, balance FROM p",
    "purchase_ledger": f"WITH {_SETTLED} SELECT kind, count(*) AS n, CAST(sum(c) AS BIGINT) AS cents FROM (SELECT 'purchase' AS kind, -cents AS c FROM b UNION ALL SELECT 'sale', cents - fee FROM b UNION ALL SELECT 'fee', fee FROM b) GROUP BY 1",
    "listing_stats": f"WITH {_SETTLED} SELECT listing, count_if(status = 'bought')::BIGINT AS purchases, CAST(sum(CASE WHEN status = 'bought' THEN cents ELSE 0 END) AS BIGINT) AS revenue FROM p GROUP BY 1",
    "wallet_stats": f"""WITH {_SETTLED} SELECT account, CAST(sum(x) AS BIGINT) AS purchases, CAST(sum(y) AS BIGINT) AS sales, CAST(sum(s) AS BIGINT) AS spent, CAST(sum(c) AS BIGINT) AS income
FROM (SELECT buyer AS account, 1 AS x, 0 AS y, cents AS s, 0 AS c FROM b UNION ALL SELECT seller, 0, 1, 0, cents - fee FROM b) GROUP BY 1""",
    "version_appends": """
WITH RECURSIVE e AS (SELECT event_id, user_id, ts, event_id % 4 AS expected, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, NULL::BIGINT AS expected, NULL::BOOLEAN AS accepted, 0::BIGINT AS version FROM e UNION ALL
SELECT f.user_id, e.i, e.event_id, e.ts, e.expected, e.expected = version, version + (e.expected = version)::INT FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT event_id, user_id, ts, expected, accepted, version FROM f WHERE i > 0""",
    "job_states": f"WITH {_REPLAY} SELECT event_id, user_id, ts, action, admitted, state FROM f WHERE i > 0",
    "permission_decisions": f"""
WITH r AS (SELECT c_custkey AS request, c_custkey % 50 AS u, c_nationkey AS space, c_custkey % 20 AS res, ['read', 'write', 'delete', 'share'][c_custkey % 4 + 1] AS p FROM customer),
e AS (SELECT s_suppkey % 50 AS u, s_suppkey % 20 AS res, CASE WHEN s_suppkey % 2 = 0 THEN ['read'] ELSE ['read', 'write'] END AS ps, s_suppkey % 7 = 0 AS pub FROM supplier WHERE s_suppkey % 3 <> 0),
m AS (SELECT n_nationkey AS space, n_nationkey * 2 % 50 AS u, n_nationkey % 4 AS role, n_nationkey % 6 = 0 AS allp FROM nation WHERE n_nationkey % 5 <> 0),
x AS (SELECT request, EXISTS (SELECT 1 FROM e WHERE e.u = r.u AND e.res = r.res AND list_contains(ps, p)) AS a,
EXISTS (SELECT 1 FROM m WHERE m.space = r.space AND m.u = r.u AND (allp OR role <= 1 OR (role = 2 AND p IN ('read', 'write')) OR p = 'read')) AS b,
EXISTS (SELECT 1 FROM e WHERE pub AND e.res = r.res AND list_contains(ps, p)) AS c FROM r)
SELECT request, a OR b OR c AS allowed, CASE WHEN a THEN 'entry' WHEN b THEN 'role' WHEN c THEN 'public' END AS by FROM x""",
    "derivative_violations": """
SELECT DISTINCT o_custkey % 100 AS user, o_orderkey % 50 AS asset FROM orders w WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = w.o_orderkey % 50 AND p_partkey % 100 = w.o_custkey % 100)
AND NOT EXISTS (SELECT 1 FROM orders g WHERE g.o_custkey % 100 = w.o_custkey % 100 AND g.o_orderkey % 50 = w.o_orderkey % 50 AND g.o_orderstatus = 'O' AND g.o_orderkey % 3 = 0
AND g.o_orderdate <= TIMESTAMP '2000-01-01' AND g.o_orderdate + INTERVAL 2 YEAR >= TIMESTAMP '2000-01-01')""",
    "transfer_rows": """
WITH t AS (SELECT o_custkey % 100 AS s, o_orderkey % 100 AS d, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders), u AS (SELECT s AS account, -c AS c FROM t WHERE s <> d AND c > 0 UNION ALL SELECT d, c FROM t WHERE s <> d AND c > 0)
SELECT account, count(*) AS n, CAST(sum(c) AS BIGINT) AS cents FROM u GROUP BY 1""",
    "preference_upserts": """
WITH w AS (SELECT user_id, event_type AS key, value, event_id % 10 / 10.0::DOUBLE AS c, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS b, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)
SELECT user_id, key, max(CASE WHEN b = 1 THEN value END) AS value, round(sum(c * pow(0.5, CASE WHEN b = n THEN b - 1 ELSE b END)) + 1e-9::DOUBLE, 6) AS confidence, count(*) AS writes FROM w GROUP BY 1, 2""",
    "live_memories": f"WITH {_M} SELECT memory, importance FROM m WHERE kind = 'click' AND importance >= 5 AND {_LIVE}",
    "memory_summary": f"WITH {_M} SELECT kind, count(*) AS n, round(avg(importance), 6) AS importance FROM m GROUP BY ROLLUP (kind)",
    "memory_sessions": "SELECT conv_id % 20 AS user, count(DISTINCT conv_id) AS sessions, count(DISTINCT CASE WHEN conv_id % 3 = 0 THEN conv_id END) AS active, count(*) AS messages FROM conversations GROUP BY 1",
    "workflow_restored": f"""
WITH {_M}, l AS (SELECT user_id AS task, kind, arg_max(value, (ts, memory)) AS r, max((ts, memory)) AS o FROM m WHERE {_LIVE} GROUP BY 1, 2)
SELECT task, string_agg(kind, ',' ORDER BY o) AS steps, round(max(CASE WHEN kind = 'click' THEN r END), 6) AS click FROM l GROUP BY 1""",
    "checkpoint_stats": f"WITH {_M} SELECT count(*) AS steps, count(CASE WHEN NOT {_LIVE} THEN 1 END) AS expired, count(DISTINCT user_id) AS tasks FROM m",
    "community_stats": "SELECT n_nationkey AS community, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS episodes, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS entities FROM nation",
    "entity_facts": """
WITH l AS (SELECT DISTINCT 'p' || l_partkey AS s, 's' || l_suppkey AS d, l_returnflag FROM lineitem) SELECT s AS entity, 'outgoing' AS direction, count(*) AS n FROM l GROUP BY 1 UNION ALL SELECT d, 'incoming', count(*) FROM l GROUP BY 1""",
    "query_entities": """
SELECT c_custkey AS query, b.n_nationkey AS entity FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON contains(' offers for ' || lower(c_mktsegment) || ' in ' || regexp_replace(lower(a.n_name), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || regexp_replace(lower(b.n_name), '[^a-z0-9]+', ' ', 'g') || ' ')""",
    "entity_documents": """
WITH d AS (SELECT c_custkey AS document, min(least(abs(c_nationkey - n_nationkey), 25 - abs(c_nationkey - n_nationkey))) AS hop FROM customer, nation WHERE n_regionkey = 1 GROUP BY 1)
SELECT document, hop, round(CASE WHEN hop = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (hop + 1) END, 6) AS score FROM d WHERE hop <= 2""",
    "blended_scores": "SELECT p_partkey, round(0.7::DOUBLE * (p_size / 50.0::DOUBLE) + CASE WHEN p_partkey % 3 = 0 THEN 0.3::DOUBLE * (p_partkey % 10 / 10.0::DOUBLE) ELSE 0 END, 6) AS score FROM part WHERE p_partkey % 2 = 0",
    "event_graph": "SELECT src, dst, count(*) AS n FROM (SELECT event_type AS src, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) GROUP BY 1, 2",
    "relation_answers": "SELECT n_nationkey, trim(n_name) AS source, 'region ' || n_regionkey AS target, 'LIES_IN' AS name, 'f' AS fact, 0.5::DOUBLE AS confidence FROM nation",
    "space_report": f"""
WITH a AS (SELECT user_id % 10 AS space, date_diff('day', CAST(ts AS DATE), DATE '{AS_OF[:10]}') AS age FROM events)
SELECT space, count(CASE WHEN age BETWEEN 0 AND 6 THEN 1 END) AS now, count(CASE WHEN age BETWEEN 7 AND 13 THEN 1 END) AS before FROM a GROUP BY 1""",
    "policy_compliance": """
WITH v AS (SELECT event_id, user_id % 5 = 0 AS unknown, event_type NOT IN ('view', 'click') AS p, event_id % 2 = 1 AS m, ts > TIMESTAMP '2024-01-20' AS x, event_id % 3 = 0 AS star, user_id % 2 = 1 AS agg FROM events),
l AS (SELECT event_id, unknown, star, CASE WHEN unknown THEN ['transaction_not_found'] ELSE list_filter([CASE WHEN p THEN 'unauthorized_purpose' END, CASE WHEN m THEN 'unauthorized_computation_method' END, CASE WHEN x THEN 'expired_access' END, CASE WHEN agg AND star THEN 'aggregation_required' END], lambda z: z IS NOT NULL) END AS vs FROM v)
SELECT event_id, array_to_string(vs, ',') AS violations, CASE WHEN unknown THEN 'unknown' WHEN len(vs) > 0 THEN 'violated' ELSE 'compliant' END AS compliance,
array_to_string(list_filter([CASE WHEN star THEN 'SUSPICIOUS_QUERY_PATTERN' END, CASE WHEN list_contains(vs, 'expired_access') THEN 'TIME_VIOLATION' END, CASE WHEN list_contains(vs, 'unauthorized_purpose') THEN 'UNAUTHORIZED_PURPOSE' END], lambda z: z IS NOT NULL), ',') AS flags FROM l""",
    "price_levels": """
WITH p AS (SELECT p_partkey, p_partkey % 3 AS k, p_retailprice * [1.0, 3.0, 0.2][p_partkey % 3 + 1]::DOUBLE AS price, avg(p_retailprice) OVER (PARTITION BY p_brand) AS market FROM part)
SELECT p_partkey, CASE WHEN k = 2 THEN 'high' WHEN k = 1 OR price / market > 2 OR price / market < 0.5 THEN 'medium' ELSE 'low' END AS level, k = 2 AS below FROM p""",
    "sensitivity_levels": """
SELECT n_nationkey, ['low', 'medium', 'high', 'critical'][greatest([3, 2, 1, 0][n_nationkey % 4 + 1], CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END, CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 0 END) + 1] AS level FROM nation""",
    "context_texts": """
WITH b AS (SELECT conv_id, turn, printf('[%d] %s | section=- | score=%.4f', turn, role, turn / 8.0::DOUBLE) || chr(10) || text || CASE WHEN contains(text, 'note') THEN '' ELSE chr(10) || 'Evidence: note' END AS b FROM conversations WHERE turn <= 12)
SELECT conv_id, md5(string_agg(b, chr(10) || chr(10) ORDER BY turn)) AS hash FROM b GROUP BY 1""",
    "rerank_texts": "SELECT p_partkey, 'Document: ' || p_name || CASE WHEN p_size > 25 THEN chr(10) || 'Section: ' || p_type ELSE '' END || chr(10) || 'Body:' || chr(10) || p_brand || chr(10) || 'Channels: vector, graph' AS text FROM part",
    "redacted_payloads": """SELECT event_id, '{"id": ' || event_id || ', "user": {"Email_1": "***REDACTED***", "n": [{"token": "***REDACTED***"}]}, "note": "email"}' AS payload FROM events""",
    "sql_functions_used": """
SELECT c_custkey, c_custkey * 77 * 5 // 100 AS fee, CASE WHEN c_custkey % 10 >= 7 THEN 'critical' WHEN c_custkey % 10 >= 5 THEN 'high' WHEN c_custkey % 10 >= 3 THEN 'medium' ELSE 'low' END AS level,
left(c_name, 3) || repeat('*', length(c_name) - 6) || right(c_name, 3) AS masked, 'PSEUDO_' || left(sha256(c_name), 12) AS pseudonym, round(3.0::DOUBLE * c_custkey / (sqrt(1 + c_custkey * c_custkey) * sqrt(c_custkey * c_custkey + 4)), 6) AS cosine FROM customer""",
}
