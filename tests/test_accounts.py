"""Rows about buyers, memories, jobs and assets: hand-made cases and plain folds."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lakeweave.operators import accounts


def test_adaptive_window_is_one_fold(spark):
    rng, rows, at = random.Random(2), [], 0.0
    for i in range(400):
        at += rng.choice([0.0, 1.0, 5.0, 40.0])
        rows.append((i, i % 3, at, rng.choice([10.0, 71.0, 90.0])))
    got = {r["id"]: (r["allowed"], r["limit"]) for r in accounts.adaptive_window(spark.createDataFrame(rows, "id long, key long, at double, load double"), "key", ["at", "id"], "at", "load", 4, 30.0, 2, 8).collect()}
    state = {k: (4, []) for k in range(3)}
    for i, key, now, load in rows:
        limit, log = state[key]
        limit = max(2, min(8, int(limit * (0.9 if load > 70 else 1.1))))
        log = [t for t in log if t > now - 30.0]
        allowed = len(log) < limit
        state[key] = (limit, [*log, now] if allowed else log)
        assert got[i] == (allowed, limit)


def test_recorded_accesses(spark):
    spec = "transaction string, purpose string, method string, query string, ts timestamp, size_bytes long, rows long, frequency double, gap_s double, growth double"
    t = lambda day: f"2025-01-{day:02} 10:00:00"
    rows = [("a", "research", "tee", "SELECT count(*) FROM x", t(2), 10, 5, 0.1, 100.0, 1.0), ("a", "sale", "tee", "select * from X", t(20), 10**9, 5, 0.9, 1.0, 20.0), ("none", "research", "tee", "SELECT 1", t(2), 1, 1, 0.1, 100.0, 1.0)]
    accesses = spark.createDataFrame([(*r[:4], None, *r[5:]) for r in rows], spec).drop("ts").join(spark.createDataFrame([(r[3], r[4]) for r in rows], "query string, t string"), "query").withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    grants = spark.createDataFrame([("a", ["research"], "tee", t(10), True)], "transaction string, purposes array<string>, grant_method string, until string, aggregate_only boolean").withColumn("valid_until", F.col("until").cast("timestamp")).drop("until")
    got = {(r["transaction"], r["purpose"]): r for r in accounts.recorded_accesses(accesses, grants).collect()}
    calm, wild, unknown = got["a", "research"], got["a", "sale"], got["none", "research"]
    assert calm["compliance"] == "compliant" and calm["flags"] == [] and calm["response"] == "none" and calm["risk"] < 0.3
    assert wild["compliance"] == "violated" and wild["violations"] == ["unauthorized_purpose", "expired_access", "aggregation_required"] and wild["response"] == "suspend"
    assert {"EXCESSIVE_ACCESS", "SUSPICIOUS_QUERY_PATTERN", "EXCESSIVE_OUTPUT", "UNAUTHORIZED_PURPOSE", "TIME_VIOLATION", "rapid_access", "output_size_surge"} == set(wild["flags"])
    assert unknown["compliance"] == "unknown" and unknown["violations"] == ["transaction_not_found"]
    assert len(calm["fingerprint"]) == 32 and wild["fingerprint"] != calm["fingerprint"] and calm["complexity"] > 0


def test_small_pieces(spark):
    rows = spark.createDataFrame([(1, ["a" * 10, "b" * 400, "c", "d"]), (2, []), (3, ["x"])], "id int, chunks array<string>")
    got = {r["id"]: r["c"] for r in rows.select("id", accounts.merged_small(F.col("chunks")).alias("c")).collect()}
    assert got == {1: ["a" * 10 + "\n" + "b" * 400, "c\nd"], 2: [], 3: ["x"]}
    prices = spark.createDataFrame([(1.239,), (19.99,), (0.0,), (None,)], "p double").select(accounts.negotiated_cents(F.col("p")).alias("c"))
    assert [r["c"] for r in prices.collect()] == [123, 1999, 0, None]
    memories = spark.createDataFrame([(1, 9, "some words", None, None, None), (2, 9, None, "note", 7, None)], "memory int, user int, content string, kind string, importance int, expires_at timestamp")
    one, two = accounts.new_memories(memories, "memory", "user", "content").orderBy("memory").collect()
    assert (one["kind"], one["importance"], len(one["embedding"]), one["context"]) == ("fact", 5, 64, {"embedding_model": "hashed-words"})
    assert (two["kind"], two["importance"], two["embedding"], two["context"]) == ("note", 7, None, {})
