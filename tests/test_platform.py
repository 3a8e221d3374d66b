"""Folds and texts without a SQL form, against plain Python; unusual rows of the permission, memory and graph operators."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lakeweave.functions import prompting
from lakeweave.operators import access, chunking, communities, enforcement, jobs, memory, trading
from lakeweave.plans import platform
from lakeweave.sources.tables import table


def test_purchases_fold_as_a_loop(spark, sf_dir):
    rows = [r.asDict() for r in platform.purchase_status(spark, sf_dir).collect()]
    balance, held = {}, {}
    for r in sorted(rows, key=lambda r: (r["l_orderkey"], r["l_linenumber"])):
        b = r["buyer"]
        balance.setdefault(b, 100_000_000)
        mine = held.setdefault(b, set())
        if b == r["seller"]:
            want = "own"
        elif r["listing"] in mine:
            want = "held"
        elif r["cents"] > balance[b]:
            want = "short"
        else:
            want = "bought"
            mine.add(r["listing"])
            balance[b] -= r["cents"]
        assert (r["status"], r["balance"]) == (want, balance[b])
    ledger = {r["kind"]: r for r in platform.purchase_ledger(spark, sf_dir).collect()}
    bought = [r for r in rows if r["status"] == "bought"]
    assert {k: r["n"] for k, r in ledger.items()} == dict.fromkeys(("purchase", "sale", "fee"), len(bought))
    assert sum(r["cents"] for r in ledger.values()) == 0
    stats = platform.wallet_stats(spark, sf_dir).agg(F.sum("purchases"), F.sum("sales"), F.sum("spent")).first()
    assert tuple(stats) == (len(bought), len(bought), -ledger["purchase"]["cents"])
    assert platform.listing_stats(spark, sf_dir).agg(F.sum("revenue")).first()[0] == -ledger["purchase"]["cents"]


def test_versions_and_job_states_fold_as_loops(spark, sf_dir):
    version = {}
    for r in sorted(platform.version_appends(spark, sf_dir).collect(), key=lambda r: (r["user_id"], r["ts"], r["event_id"])):
        now = version.get(r["user_id"], 0)
        ok = r["expected"] == now
        version[r["user_id"]] = now + ok
        assert (r["accepted"], r["version"]) == (ok, now + ok)
    state = {}
    for r in sorted(platform.job_states(spark, sf_dir).collect(), key=lambda r: (r["user_id"], r["ts"], r["event_id"])):
        before, after = jobs.TRANSITIONS[r["action"]]
        now = state.get(r["user_id"], "queued")
        ok = now in before
        state[r["user_id"]] = after if ok else now
        assert (r["admitted"], r["state"]) == (ok, state[r["user_id"]])


def test_next_state_agrees_with_the_fold(spark):
    row = spark.range(1).select(jobs.next_state(F.lit("failed"), F.lit("requeue")).alias("a"), jobs.next_state(F.lit("succeeded"), F.lit("cancel")).alias("b"), jobs.outcome(F.lit(3), F.lit(True)).alias("c")).first()
    assert tuple(row) == ("queued", None, "partial_success")


def test_permissions_change_only_through_admins(spark):
    entries = spark.createDataFrame([(1, 5, "file", 9, ["read"])], "entry int, user int, kind string, resource int, permissions array<string>")
    admins = spark.createDataFrame([(7, "file", 9)], "user int, kind string, resource int")
    wanted = spark.createDataFrame([(2, 6, "file", 9, ["read"], 7), (3, 8, "file", 9, ["read"], 6)], "entry int, user int, kind string, resource int, permissions array<string>, granted_by int")
    assert sorted(r["entry"] for r in access.granted(entries, wanted, admins).collect()) == [1, 2]
    gone = spark.createDataFrame([(1, "file", 9, 6)], "entry int, kind string, resource int, revoked_by int")
    assert access.revoked(entries, gone, admins).count() == 1
    assert access.revoked(entries, gone.withColumn("revoked_by", F.lit(7)), admins).count() == 0


def test_members_are_updated_inserted_and_deactivated(spark):
    members = spark.createDataFrame([(1, 1, "viewer", "inactive", None)], "space int, user int, role string, status string, permissions array<string>")
    added = spark.createDataFrame([(1, 1, "editor"), (1, 2, "admin")], "space int, user int, role string")
    out = {r["user"]: (r["role"], r["status"]) for r in access.with_members(members, added).collect()}
    assert out == {1: ("editor", "inactive"), 2: ("admin", "active")}
    left = access.without_members(access.with_members(members, added), added.where("user = 2"))
    assert {r["user"]: r["status"] for r in left.collect()} == {1: "inactive", 2: "inactive"}


def test_memory_changes_cleaning_and_recall(spark):
    m = spark.createDataFrame([(1, 9), (2, 2), (3, 5)], "memory int, importance int")
    d = spark.createDataFrame([(1, 4), (2, -1), (2, -5)], "memory int, delta int")
    assert {r[0]: r[1] for r in memory.changed_importance(m, d).collect()} == {1: 10, 2: 1, 3: 5}
    s = spark.createDataFrame([(1, "archived", "2024-01-01"), (2, "active", "2024-01-01"), (3, "archived", "2024-03-01")], "session int, status string, d string").withColumn("last_message_at", F.col("d").cast("timestamp_ntz"))
    left, said = memory.without_old_sessions(s, s.select("session"), "2024-03-05", 30)
    assert {r["session"] for r in left.collect()} == {2, 3} == {r["session"] for r in said.collect()}
    layer = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.9)], "s int, text string, score double")
    got = memory.recalled({"short": layer, "long": layer.withColumn("text", F.upper("text"))}, "s", 3).orderBy("place").collect()
    assert [(r["text"], r["layer"]) for r in got] == [("b", "short"), ("a", "short"), ("B", "long")]
    touches = spark.createDataFrame([(1, 0.0), (1, 5.0), (1, 20.0)], "s int, at double")
    assert [r["alive"] for r in memory.expiry(touches, "s", ["at"], "at", 10).orderBy("at").collect()] == [False, True, False]


def test_compact_cuts_at_a_sentence(spark):
    text = "One.  Two\t\tthree.\r\n\r\n\r\n\r\nFour five six. Seven eight nine"
    row = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(prompting.compact(F.col("t"), 40).alias("c")).collect()
    assert [r["c"] for r in row[1:]] == [None, ""]
    assert row[0]["c"].endswith("...") and "  " not in row[0]["c"] and "\n\n\n" not in row[0]["c"]


def test_redacted_payload_stays_json(spark):
    payload = json.dumps({"a": {"API_KEY": 'x"y', "b": [{"phone": None, "n": 1}]}, "text": "email: no"})
    got = json.loads(spark.createDataFrame([(payload,)], "p string").select(prompting.redacted_json(F.col("p"))).first()[0])
    assert got == {"a": {"API_KEY": "***REDACTED***", "b": [{"phone": "***REDACTED***", "n": 1}]}, "text": "email: no"}


def test_prompt_keeps_the_last_turns(spark):
    turns = [(f"q{i}", f"a{i}" if i % 2 else None) for i in range(6)]
    df = spark.createDataFrame([("why", "ctx", turns), ("why", "ctx", [])], "q string, c string, t array<struct<question:string,answer:string>>")
    full, bare = (r[0] for r in df.select(prompting.prompt(F.col("q"), F.col("c"), F.col("t"))).collect())
    assert "q1" not in full and "User: q2\nUser: q3\nAssistant: a3" in full and full.endswith("Question: why\nAnswer:")
    assert "User:" not in bare


def test_edges_keep_their_first_creation_time(spark):
    old = spark.createDataFrame([(1, 2, "f", 10)], "src int, dst int, fact string, created_at int")
    new = spark.createDataFrame([(1, 2, "g", 20), (3, 4, "h", 20)], "src int, dst int, fact string, created_at int")
    got = {(r["src"], r["dst"]): (r["fact"], r["created_at"]) for r in communities.upsert_edges(old, new, ["src", "dst"]).collect()}
    assert got == {(1, 2): ("g", 10), (3, 4): ("h", 20)}


def test_actions_follow_severity_and_risk(spark):
    rows = spark.createDataFrame([(0.9, "high"), (0.9, "low"), (0.75, None), (0.1, None)], "r double, s string")
    assert [r[0] for r in rows.select(enforcement.response(F.col("r"), F.col("s"))).collect()] == ["suspend", "throttle", "alert", "none"]
    assert enforcement.identifier_columns(rows.selectExpr("r AS birth_year", "s AS email")) == {"direct": ["email"], "quasi": ["birth_year"]}


def test_table_function_cuts_as_the_operator_does(spark, sf_dir):
    got = {r["doc_id"]: (r["n"], r["last"]) for r in platform.table_function_chunks(spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    want = {k: (len(c), c[-1][1]) for k, t in texts.items() if (c := chunking.sliding(t or ""))}
    assert got == want
