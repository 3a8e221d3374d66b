"""Queries on grades, audits, rights, event stores, prices, knowledge graphs and service records, from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grading
from ..functions.text import MARKDOWN_PATTERNS
from ..operators import audit, eventstore, knowledge, lineage, records, rights
from ..sources.tables import table

AS_OF = "2024-01-31 00:00:00"


def _pick(index, *values):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


# grades


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dressed as Markdown, by id: headings, lists, a table, code, a link."""
    k = F.col("doc_id")
    parts = [(2, "# Head\n\n## Next\n\n### More\n\n"), (3, "- a\n- b\n\n"), (5, "|a|b|\n|-|-|\n\n"), (7, "```\nx\n```\n\n"), (11, "[l](u)\n\n")]
    text = F.concat(*(F.when(k % n == 0, s).otherwise("") for n, s in parts), "text")
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def conversion_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    scores = _marked(spark, sf_dir).select("doc_id", F.round(grading.content_score(text), 6).alias("content"), F.round(grading.structure_score(text), 6).alias("structure"), grading.overall_score(text).alias("score"))
    return scores.select("doc_id", "content", "structure", F.round("score", 6).alias("score"), grading.grade(F.col("score")).alias("grade"))


def review_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 4 == 0, " ").otherwise("t")
    return _marked(spark, sf_dir).select("doc_id", F.array_join(grading.missing_parts(F.col("text"), title), ",").alias("missing"))


# audits


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = F.when(F.col("event_type") == "error", 0.9).when(F.col("event_type") == "purchase", 0.5).otherwise((F.col("event_id") % 4) / 10)
    return table(spark, sf_dir, "events").withColumn("risk", risk)


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'error' AND event_id % 5 = 0").select("user_id", "ts", _pick(F.col("event_id"), "critical", "high", "medium", "low", "other", "low", "high").alias("severity"))


def audit_log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = audit.log_page(_log(spark, sf_dir), ["ts", "event_id"], 50, 10, 0.5, "2024-01-05 00:00:00", "2024-01-25 00:00:00", event_type="error", user_id=None)
    return page.select("event_id", "user_id", "risk")


def violation_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.severities(audit.since(_violations(spark, sf_dir), "ts", AS_OF, 30), "user_id")


def access_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.summary(audit.since(_log(spark, sf_dir), "ts", AS_OF, 30), audit.since(_violations(spark, sf_dir), "ts", AS_OF, 30), "user_id", "props", "risk")


def risk_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.assessed(audit.summary(audit.since(_log(spark, sf_dir), "ts", AS_OF, 7), audit.since(_violations(spark, sf_dir), "ts", AS_OF, 7), "user_id", "props", "risk"))
    return out.select("user_id", "mean_risk", "level", F.array_join("factors", ",").alias("factors"), "state")


def batch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.histogram(access_summaries(spark, sf_dir))


def integrity_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", audit.integrity_hash(F.col("event_id"), F.col("event_type"), F.col("user_id"), F.lit(None)).alias("hash"))


# rights


def access_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select("c_custkey", _pick(k, "read_only", "analytics", "derived_work", "full_access", "exclusive", "odd").alias("right"), _pick(k, "query", "download", "export", "api", "select", "x", "api").alias("access"), _pick(k, "select", "INSERT", "Select", "delete").alias("operation"))
    return rights.access_rows(asked, "right", "access").withColumn("may_write", rights.may_write(F.col("right"), F.col("operation"))).select("c_custkey", "allowed", "reason", "may_write")


def anonymized_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    quasi = {"c_nationkey": F.floor(F.col("c_nationkey") / 5)}
    parts = [rights.anonymized(rows.where(F.col("c_custkey") % 3 == k), f"L{k + 1}", ["c_name"], quasi, 10).withColumn("level", F.lit(f"L{k + 1}")) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def protocol_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", _pick(k, "mpc", "tee", "federated", "differential_privacy", "raw", "none").alias("method"), _pick(k, "low", "medium", "high", "critical").alias("sensitivity"))
    m, s = F.col("method"), F.col("sensitivity")
    terms = rights.constraints(m, s)
    share = rights.buyer_share(m)
    return rows.select("n_nationkey", F.get_json_object(terms, "$.epsilon").cast("double").alias("epsilon"), F.get_json_object(terms, "$.protocol").alias("protocol"), F.get_json_object(terms, "$.min_clients").cast("int").alias("min_clients"), rights.verification(m).alias("verification"), share.alias("buyer"), F.round(1 - share, 6).alias("seller"))


def protocol_simple_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    asked = table(spark, sf_dir, "nation").select("n_nationkey", _pick(k, "low", "medium", "high", "critical").alias("sensitivity"), _pick(k, "exact", "high", "any").alias("precision"))
    return rights.simple_scores(asked, "sensitivity", "precision").select("n_nationkey", "method", "score")


def standard_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(_pick(k, "Patient ", "a health ", "consumer ", ""), F.col("p_name")).alias("record"), F.when(k % 3 == 0, F.array(F.lit("email"), F.lit("size"))).otherwise(F.array(F.lit("size"))).alias("fields"))
    out = [F.array_join(rights.findings(F.col("record"), F.col("fields"), s), ",").alias(s.lower()) for s in rights.STANDARD_WORDS]
    return p.select("p_partkey", *out)


def asset_chain_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return rights.asset_registrations(p, "p_brand", "p_partkey", lineage.canonical_json({"name": F.col("p_name"), "type": F.col("p_type")}))


def rights_negotiations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for pair in {"view": "OFFER", "click": "COUNTER", "signup": "GRANT", "error": "REVOKE", "purchase": "OTHER"}.items() for x in pair))
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 900).alias("session"), "ts", "event_id", kinds[F.col("event_type")].alias("kind"), "value", F.concat(F.lit("r"), F.col("user_id") % 3).alias("rights"))
    return rights.rights_states(e, "session", ["ts", "event_id"], "kind", "value", "rights").drop("rights")


# event stores


def _sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("session", F.col("event_id") % 60)
    return eventstore.sequenced(e, "session", "user_id", ["ts", "event_id"])


def event_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*(F.lit(x) for pair in {"view": "OFFER", "click": "COUNTER", "signup": "INITIATE", "error": "BOGUS", "purchase": "BID"}.items() for x in pair))
    e = table(spark, sf_dir, "events").select("event_id", kind[F.col("event_type")].alias("kind"), F.when(F.col("event_id") % 9 > 0, F.col("value") - 5).alias("price"))
    return eventstore.checked(e, "kind", "price").select("event_id", "problem")


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _sequenced(spark, sf_dir)
    return out.select("event_id", "sequence", F.col("clock")[F.col("user_id").cast("string")].alias("own"))


def events_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventstore.in_range(_sequenced(spark, sf_dir), 3, 20, ["view", "click"]).select("session", "sequence", "event_id")


def next_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eventstore.next_sequence(_sequenced(spark, sf_dir), "session")


def state_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = eventstore.snapshots(_sequenced(spark, sf_dir), "session", F.col("value"), 10)
    return out.select("session", "version", F.round("total", 4).alias("total"), "last")


def states_from_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _sequenced(spark, sf_dir)
    out = eventstore.replayed(e, eventstore.snapshots(e, "session", F.col("value"), 10), "session", F.col("value"))
    return out.select("session", "version", F.round("total", 4).alias("total"), "last", "replayed")


def priority_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", (F.col("event_id") % 40).alias("session"), (F.col("user_id") % 10).alias("priority"))
    return eventstore.executed_bids(e, "session", F.to_date("ts"), "priority", ["ts", "event_id"], "value", "user_id").select("event_id", "place", "winning", "highest")


def request_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("kind", _pick(F.col("event_id"), "bid", "offer", "message"))
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return eventstore.rejections(e, "user_id", "kind", seconds, F.col("event_type") == "error", 86_400).select("event_id", "requests", "rejections")


def slow_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = eventstore.slow_share(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") > 50)
    return out.select("event_id", "calls", "slow_calls", "opens")


def state_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = eventstore.recent_history(_sequenced(spark, sf_dir), "session", ["event_id"])
    return out.select("session", F.get_json_object("state", "$.version").cast("int").alias("version"), F.get_json_object("state", "$.history[0].event_id").cast("long").alias("oldest"))


# prices and lineage


def automatic_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(lineage.automatic_price(F.length("text"), F.col("doc_id") % 50, F.col("doc_id") % 90), 6).alias("price"))


def price_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part leads its brand with the highest price, follows within a tenth of it."""
    p = table(spark, sf_dir, "part")
    top = p.groupBy("p_brand").agg(F.max("p_retailprice").alias("top"))
    position = F.when(F.col("p_retailprice") == F.col("top"), "leader").when(F.col("p_retailprice") >= 0.9 * F.col("top"), "follower").otherwise("niche")
    s = lineage.strategy(position)
    return p.join(top, "p_brand").select("p_partkey", s["strategy"].alias("strategy"), s["adjustment"].alias("adjustment"), lineage.network_label(F.col("p_size") * 1.5).alias("network"))


def lineage_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    chained = lineage.chain(steps, "l_orderkey", ["l_linenumber"], lineage.canonical_json({"part": F.col("l_partkey")}))
    sources = table(spark, sf_dir, "orders").select("o_orderkey").withColumnRenamed("o_orderkey", "l_orderkey")
    return lineage.parent_hashes(chained, "l_orderkey", sources)


def lineage_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kept, gone = lineage.purged(o, "o_orderdate", "2001-12-01 00:00:00", 1000)
    return kept.agg(F.count(F.lit(1)).alias("kept")).crossJoin(gone.agg(F.count(F.lit(1)).alias("gone")))


def lineage_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.kinds_since(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "2001-12-01 00:00:00", 900)


def quality_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    stored = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") / 50).alias("quality"))
    profiled = p.where("p_partkey % 2 = 0").select("p_partkey", (F.col("p_size") / 100).alias("quality"))
    return lineage.stored_or_profiled(stored, profiled, "p_partkey", "quality").withColumn("quality", F.round("quality", 6))


# knowledge graphs


def relations_put_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = _pick(k, "HEADQUARTERS_IN", "PRODUCES", "OWNS", "LEADS", "PART_OF")
    q = F.when(k % 4 == 0, F.create_map(F.lit("confidence"), F.lit("0.7"), F.lit("polarity"), F.lit("-1"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("source"), F.col("o_orderstatus").alias("target"), name.alias("name"), q.alias("qualifiers"), F.when(k % 6 == 0, 0.9).alias("confidence"), F.lit(None).cast("int").alias("polarity"), F.lit("one").alias("cardinality"))
    return knowledge.put_right(rows).select("o_orderkey", "confidence", "polarity", "cardinality")


def edge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", knowledge.edge_key(F.col("n_name"), F.col("n_regionkey").cast("string"), F.lit("IN"), F.concat(F.lit("  "), F.col("n_name"), F.lit(" "))).alias("key"))


def merged_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    rows = n.select("n_nationkey", F.col("n_name").alias("name"), F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("kept")).alias("attributes"))
    found = n.where("n_nationkey % 2 = 0").select(F.concat(F.lit(" "), F.lower("n_name")).alias("name"), F.create_map(F.lit("a"), F.lit("new"), F.lit("c"), F.col("n_regionkey").cast("string")).alias("attributes"))
    out = knowledge.with_attributes(rows, found, "name")
    return out.select("n_nationkey", *(F.try_element_at("attributes", F.lit(k)).alias(k) for k in "abc"))


def linked_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = knowledge.linked_entities(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")
    return out.select("l_partkey", F.array_join("entities", ",").alias("entities"))


def edited_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    edges = c.where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("edge"), F.lit("a").alias("src"), F.lit("b").alias("dst"), F.lit("old").alias("relation"), F.col("c_name").alias("description"))
    k = F.col("o_custkey")
    edits = table(spark, sf_dir, "orders").select(k.alias("edge"), F.col("o_orderkey").alias("at"), _pick(F.col("o_orderkey"), "create", "update", "delete").alias("action"), F.lit("a").alias("src"), F.lit("b").alias("dst"), F.when(k % 2 == 0, "new").alias("relation"), F.lit(None).cast("string").alias("description"))
    return knowledge.edited(edges, edits, "edge", "at").select("edge", "relation", "description")


def graph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("label"))
    entities = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("label"))
    edges = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    nodes, kept = knowledge.view(docs, entities, edges)
    degree = kept.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("edges"))
    return nodes.join(degree, "id", "left").select("id", "label", "kind", F.coalesce("edges", F.lit(0)).alias("edges"))


def flat_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.create_map(F.lit("Region Key"), F.col("n_regionkey").cast("string"), F.lit("name"), F.col("n_name")).alias("p"))
    return knowledge.flat_properties(n, "n_nationkey", "p")


# records


def asset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.newest(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), "o_orderdate", "o_orderkey", limit=40, offset=20).select("o_orderkey", "o_custkey")


def operation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.newest_of(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 7).select("user_id", "event_id", "rank")


def document_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    out = records.previews(d, F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("Doc "), "doc_id")), "text")
    return out.select("doc_id", "title", F.sha2("preview", 256).alias("hash"))


def owner_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.from_payload(table(spark, sf_dir, "events"), "props", {"owner": "k", "missing": "nope"})
    return out.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.count("missing").alias("missing"))


def new_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("seller", F.lit("x"))
    rows = records.listing_rows(d, F.col("text"), F.col("text"), (F.col("doc_id") % 700) / 0.9 - 5)
    out = records.public_listing(rows)
    return out.select("doc_id", F.length("title").alias("title_chars"), F.length("summary").alias("summary_chars"), F.length("excerpt").alias("excerpt_chars"), "cents", "credits")


def download_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    holdings = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(2).cast("long").alias("downloads"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz").alias("last_access"))
    out = records.access_counts(holdings, table(spark, sf_dir, "events").where("event_type = 'click'"), "user_id", "ts")
    return out.select("user_id", "downloads", F.unix_micros(F.col("last_access").cast("timestamp")).alias("last_us"))


def rights_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.grants(table(spark, sf_dir, "orders"), "o_orderdate", (F.col("o_orderkey") % 400).cast("int"))
    return out.select("o_orderkey", F.date_diff("valid_until", "valid_from").alias("days"), records.negotiated_cents(F.col("o_totalprice") / 7).alias("cents"))


def yield_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("balanced").alias("strategy"), F.lit(True).alias("enabled"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", "growth").when(F.col("event_type") == "view", "safe").alias("strategy"), F.when(F.col("event_type") == "error", F.lit(False)).alias("enabled"))
    return records.settings_after(current, e, "user_id", "event_id", "strategy", "enabled")


def episode_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    gone = c.where("conv_id % 7 = 0").select("conv_id")
    return records.sessions_after(records.without_sessions(c, gone, "conv_id"), "conv_id", ["turn"], "role")


def preferences_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("theme").alias("key"))
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.lit("theme").alias("key"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('"'), "s_name", F.lit('"'))).otherwise(F.col("s_suppkey").cast("string")).alias("value"))
    return records.preference(asked, known, ["user_id", "key"], "light").select("user_id", "value")


def user_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    prefs = table(spark, sf_dir, "events").where("event_type IN ('view', 'click')").select("user_id", F.col("event_type").alias("kind"))
    memories = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("memory"), F.col("value").alias("importance"))
    out = records.profile(users, prefs, memories, "user_id", 3)
    return out.select("user_id", F.try_element_at("preferences", F.lit("view")).alias("views"), F.array_join("memories", ",").alias("memories"))


def prompt_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return records.layers(c.where("turn >= 3"), c.where("turn < 5"), "conv_id", "turn", 4)


def exported_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.exported(table(spark, sf_dir, "documents").select("source", "doc_id", "lang"), "source")
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min(F.get_json_object("document", "$.doc_id").cast("long")).alias("first_doc"))


def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.older_than(table(spark, sf_dir, "events"), "ts", AS_OF, 20).select("event_id")


def folder_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    parent = F.when(F.col("n_regionkey") > 0, F.concat(F.lit("/r"), "n_regionkey", F.when(F.col("n_nationkey") % 2 == 0, "/").otherwise("")))
    return n.select("n_nationkey", records.child_path(parent, F.col("n_name")).alias("path"))


def days_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    end = F.lit(AS_OF).cast("timestamp_ntz")
    return e.select("event_id", F.round(records.elapsed_days(F.col("ts"), end), 6).alias("days"), records.snowflake(F.col("ts"), F.col("user_id"), F.col("event_id")).alias("snowflake"))


def record_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    m = F.when(F.col("event_id") % 4 == 3, F.create_map(F.lit("k"), F.lit("v"))).otherwise(F.create_map(F.lit("k"), F.lit("v"), F.lit("x"), F.lit("v")))
    return records.same_keys_share(e.select("event_id", m.alias("m")), "m", "event_id").select(F.round("consistency", 6).alias("consistency"))


def asset_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.clusters(table(spark, sf_dir, "part"), "p_type", "p_partkey")


def collaboration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits by kind, and how many users were active over seven days."""
    e = table(spark, sf_dir, "events")
    active = audit.since(e, "ts", AS_OF, 7).groupBy("event_type").agg(F.countDistinct("user_id").alias("active"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).join(active, "event_type", "left").withColumn("active", F.coalesce("active", F.lit(0)))


QUERIES = {f.__name__: f for f in (
    conversion_grades, review_completeness, audit_log_page, violation_severities, access_summaries, risk_assessments, batch_audit, integrity_hashes,
    access_decisions, anonymized_customers, protocol_terms, protocol_simple_scores, standard_findings, asset_chain_heads, rights_negotiations,
    event_checks, event_sequences, events_in_range, next_sequences, state_snapshots, states_from_snapshots, priority_bids, request_rejections,
    slow_calls, state_documents, automatic_prices, price_strategies, lineage_parents, lineage_purge, lineage_kinds, quality_by_source,
    relations_put_right, edge_keys, merged_attributes, linked_suppliers, edited_edges, graph_view, flat_properties, asset_page, operation_history,
    document_previews, owner_assets, new_listings, download_counts, rights_grants, yield_settings, episode_sessions, preferences_asked,
    user_profiles, prompt_layers, exported_documents, stale_files, folder_paths, days_and_ids, record_consistency, asset_clusters, collaboration_stats,
)}

_END = f"TIMESTAMP '{AS_OF}'"
_MARKED = r"""m AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN e'# Head\n\n## Next\n\n### More\n\n' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN e'- a\n- b\n\n' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN e'|a|b|\n|-|-|\n\n' ELSE '' END
|| CASE WHEN doc_id % 7 = 0 THEN e'```\nx\n```\n\n' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN e'[l](u)\n\n' ELSE '' END || text AS t FROM documents)"""
_LOG = "l AS (SELECT *, CASE event_type WHEN 'error' THEN 0.9::DOUBLE WHEN 'purchase' THEN 0.5::DOUBLE ELSE event_id % 4 / 10::DOUBLE END AS risk FROM events)"
_VIOLATIONS = "v AS (SELECT user_id, ts, ['critical', 'high', 'medium', 'low', 'other', 'low', 'high'][event_id % 7 + 1] AS severity FROM events WHERE event_type = 'error' AND event_id % 5 = 0)"
_SEQUENCED = "q AS (SELECT *, event_id % 60 AS session, row_number() OVER (PARTITION BY event_id % 60 ORDER BY ts, event_id) AS sequence, row_number() OVER (PARTITION BY event_id % 60, user_id ORDER BY ts, event_id) AS own FROM events)"
_MARKDOWN = " OR ".join(f"regexp_matches(t, '{p}')" for p in MARKDOWN_PATTERNS)
_LEVEL = "CASE WHEN {0} >= 0.7 THEN 'critical' WHEN {0} >= 0.5 THEN 'high' WHEN {0} >= 0.3 THEN 'medium' ELSE 'low' END"


def _summaries(days: int) -> str:
    window = f"ts > {_END} - INTERVAL {days} DAYS AND ts <= {_END}"
    return f"""{_LOG}, {_VIOLATIONS}, a AS (SELECT user_id, count(*) AS accesses, count(DISTINCT props) AS different_queries, round(avg(risk), 9) AS m, count_if(risk > 0.7)::BIGINT AS high_risk FROM l WHERE {window} GROUP BY 1),
n AS (SELECT user_id, count(*) AS c FROM v WHERE {window} GROUP BY 1),
s AS (SELECT user_id, accesses, different_queries, high_risk, coalesce(c, 0) AS violations, CASE WHEN m > 0.6 THEN 'anomalous' WHEN m > 0.3 OR accesses > 500 THEN 'suspicious' ELSE 'normal' END AS pattern, round(m + 1e-9, 3) AS mean_risk, {_LEVEL.format('m')} AS level FROM a LEFT JOIN n USING (user_id))"""


ORACLE_SQL = {
    "conversion_grades": rf"""
WITH {_MARKED}, x AS (SELECT doc_id, regexp_replace(t, '^\s+|\s+$', '', 'g') AS b, t, list_transform(string_split(t, chr(10)), lambda z: trim(z)) AS ls FROM m),
y AS (SELECT doc_id, t, CASE WHEN length(b) = 0 THEN 0 ELSE least(length(b) / 1000 * 0.4::DOUBLE, 0.6) + least(len(list_filter(string_split(t, chr(10) || chr(10)), lambda z: regexp_matches(z, '\S'))) / 3 * 0.4::DOUBLE, 0.4) END AS content,
least(len(list_filter(ls, lambda z: regexp_matches(z, '^#{{1,6}}\s+'))) * 0.1::DOUBLE, 0.3) + least(len(list_filter(ls, lambda z: regexp_matches(z, '^[-*+]\s+|^\d+\.\s+'))) * 0.1::DOUBLE, 0.2)
+ CASE WHEN len(list_filter(ls, lambda z: regexp_matches(z, '^\|.+\|$'))) > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN len(regexp_extract_all(t, '```')) // 2 > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(t, '\[[^\]]+\]\([^)]+\)') THEN 0.15::DOUBLE ELSE 0 END AS s,
len(regexp_extract_all(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]')) / greatest(length(t), 1) AS odd,
CASE WHEN len(regexp_extract_all(t, '```')) % 2 = 0 THEN 0.3::DOUBLE ELSE 0 END + 0.2::DOUBLE + CASE WHEN regexp_matches(t, '(?m)^\|.+\|$') THEN 0.2::DOUBLE ELSE 0.15::DOUBLE END + CASE WHEN regexp_matches(t, '(?m)^#{{1,6}}\s+') THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(t, '(?m)^[-*+]\s+|^\d+\.\s+') THEN 0.15::DOUBLE ELSE 0 END AS syntax FROM x),
z AS (SELECT doc_id, t, content, CASE WHEN s = 0 THEN 0.5 ELSE least(s, 1) END AS structure, 0.2::DOUBLE * CASE WHEN odd < 0.005 THEN 1 WHEN odd < 0.01 THEN 0.8 WHEN odd < 0.05 THEN 0.5 ELSE 0 END + 0.3::DOUBLE * syntax + 0.2::DOUBLE * content AS part FROM y),
o AS (SELECT doc_id, content, structure, CASE WHEN {_MARKDOWN} THEN least(1, part + 0.3::DOUBLE * structure + 0.1::DOUBLE) ELSE part + 0.3::DOUBLE * structure END AS score FROM z)
SELECT doc_id, round(content, 6) AS content, round(structure, 6) AS structure, round(o.score, 6) AS score, CASE WHEN round(o.score, 9) >= 0.95 THEN 'S' WHEN round(o.score, 9) >= 0.85 THEN 'A' WHEN round(o.score, 9) >= 0.7 THEN 'B' WHEN round(o.score, 9) >= 0.5 THEN 'C' ELSE 'D' END AS grade FROM o""",
    "review_completeness": rf"""WITH {_MARKED} SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 4 = 0 THEN 'title' END, CASE WHEN NOT regexp_matches(t, '(?m)^#{{1,6}}\s+\S') THEN 'heading' END], lambda x: x IS NOT NULL), ',') AS missing FROM m""",
    "audit_log_page": f"WITH {_LOG} SELECT event_id, user_id, risk FROM l WHERE event_type = 'error' AND risk >= 0.5 AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 10",
    "violation_severities": f"WITH {_VIOLATIONS} SELECT user_id, count(*) AS total, {', '.join(f'''count_if(severity = '{s}')::BIGINT AS {s}''' for s in ('critical', 'high', 'medium', 'low'))} FROM v WHERE ts > {_END} - INTERVAL 30 DAYS AND ts <= {_END} GROUP BY 1",
    "access_summaries": f"WITH {_summaries(30)} SELECT * FROM s",
    "risk_assessments": f"""WITH {_summaries(7)} SELECT user_id, mean_risk, level, array_to_string(list_filter([CASE WHEN high_risk > 0 THEN 'high_risk_access' END, CASE WHEN violations > 0 THEN 'policy_violation' END, CASE WHEN accesses > 100 THEN 'frequent_access' END], lambda x: x IS NOT NULL), ',') AS factors,
CASE WHEN level = 'critical' OR violations > 5 THEN 'suspended' WHEN level = 'high' OR violations > 0 THEN 'monitored' ELSE 'active' END AS state FROM s""",
    "batch_audit": f"WITH {_summaries(30)} SELECT level, count(*) AS keys, sum(violations)::BIGINT AS violations, sum(high_risk)::BIGINT AS high_risk FROM s GROUP BY 1",
    "integrity_hashes": "SELECT event_id, sha256(event_id || '|' || event_type || '|' || user_id || '|') AS hash FROM events",
    "access_decisions": """
WITH r AS (SELECT c_custkey, ['read_only', 'analytics', 'derived_work', 'full_access', 'exclusive', 'odd'][c_custkey % 6 + 1] AS r, ['query', 'download', 'export', 'api', 'select', 'x', 'api'][c_custkey % 7 + 1] AS a, ['select', 'INSERT', 'Select', 'delete'][c_custkey % 4 + 1] AS o FROM customer),
k AS (SELECT *, CASE a WHEN 'download' THEN r IN ('derived_work', 'full_access', 'exclusive') WHEN 'export' THEN r IN ('full_access', 'exclusive') WHEN 'api' THEN r IN ('analytics', 'derived_work', 'full_access', 'exclusive') ELSE true END AS ok FROM r)
SELECT c_custkey, ok AS allowed, CASE WHEN NOT ok THEN 'right doesn''t allow ' || a END AS reason, upper(o) = 'SELECT' OR r IN ('full_access', 'exclusive') AS may_write FROM k""",
    "anonymized_customers": """
WITH g AS (SELECT c_nationkey // 5 AS n FROM customer WHERE c_custkey % 3 = 2 GROUP BY 1 HAVING count(*) >= 10)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'PSEUDO_' || left(sha256(c_name), 12) ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 2 THEN c_nationkey // 5 ELSE c_nationkey END::BIGINT AS c_nationkey, 'L' || (c_custkey % 3 + 1) AS level
FROM customer WHERE c_custkey % 3 <> 2 OR c_nationkey // 5 IN (SELECT n FROM g)""",
    "protocol_terms": """
WITH r AS (SELECT n_nationkey, ['mpc', 'tee', 'federated', 'differential_privacy', 'raw', 'none'][n_nationkey % 6 + 1] AS m, n_nationkey % 4 AS s FROM nation)
SELECT n_nationkey, CASE WHEN m = 'differential_privacy' THEN [2.0, 1.0, 0.5, 0.1][s + 1]::DOUBLE END AS epsilon, CASE WHEN m = 'mpc' THEN 'SPDZ' END AS protocol, CASE WHEN m = 'federated' THEN 3::INT END AS min_clients,
CASE m WHEN 'tee' THEN 'tee_attestation' WHEN 'mpc' THEN 'protocol_verification' WHEN 'federated' THEN 'secure_aggregation_audit' WHEN 'differential_privacy' THEN 'noise_verification' WHEN 'raw' THEN 'comprehensive_audit' ELSE 'third_party_audit' END AS verification,
CASE WHEN m IN ('mpc', 'federated') THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS buyer, CASE WHEN m IN ('mpc', 'federated') THEN 0.2::DOUBLE ELSE 0.3::DOUBLE END AS seller FROM r""",
    "protocol_simple_scores": """
SELECT n_nationkey, method, (CASE WHEN n_nationkey % 4 >= 2 AND method IN ('mpc', 'federated') THEN 50 ELSE 0 END + CASE WHEN n_nationkey % 3 = 0 AND method IN ('mpc', 'tee') THEN 30 ELSE 0 END + points)::INT AS score
FROM nation, (VALUES ('mpc', 0), ('tee', 20), ('federated', 10), ('differential_privacy', 30)) AS t(method, points)""",
    "standard_findings": """
WITH r AS (SELECT p_partkey, lower(['Patient ', 'a health ', 'consumer ', ''][p_partkey % 4 + 1] || p_name) AS t FROM part)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'direct_identifiers' END, CASE WHEN regexp_matches(t, 'health|biometric|genetic') THEN 'sensitive_personal_data' END], lambda x: x IS NOT NULL), ',') AS gdpr,
CASE WHEN regexp_matches(t, 'diagnosis|treatment|patient|medical_record') THEN 'protected_health_information' ELSE '' END AS hipaa, CASE WHEN regexp_matches(t, 'consumer|california') THEN 'consumer_data' ELSE '' END AS ccpa FROM r""",
    "asset_chain_heads": """SELECT p_partkey AS asset, p_brand AS owner, 'DATA_ASSET_REGISTER' AS event_type, sha256('0|{"name":"' || p_name || '","type":"' || p_type || '"}') AS chain_hash FROM part""",
    "rights_negotiations": """
WITH RECURSIVE e AS (SELECT event_id % 900 AS session, value, CASE event_type WHEN 'view' THEN 'O' WHEN 'click' THEN 'C' WHEN 'signup' THEN 'G' WHEN 'error' THEN 'R' ELSE 'X' END AS k, row_number() OVER (PARTITION BY event_id % 900 ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT DISTINCT session, 0::BIGINT AS i, 'none' AS state, NULL::DOUBLE AS price, 0 AS rounds, 0 AS ignored FROM e UNION ALL
SELECT f.session, e.i, CASE WHEN k = 'O' AND state IN ('none', 'offered', 'countered') THEN 'offered' WHEN k = 'C' AND state IN ('offered', 'countered') THEN 'countered' WHEN k = 'G' AND state IN ('offered', 'countered') THEN 'granted' WHEN k = 'R' AND state = 'granted' THEN 'revoked' ELSE state END,
CASE WHEN (k = 'O' AND state IN ('none', 'offered', 'countered')) OR (k = 'C' AND state IN ('offered', 'countered')) THEN value ELSE price END,
rounds + CASE WHEN (k = 'O' AND state IN ('none', 'offered', 'countered')) OR (k = 'C' AND state IN ('offered', 'countered')) THEN 1 ELSE 0 END,
ignored + CASE WHEN (k = 'O' AND state IN ('none', 'offered', 'countered')) OR (k IN ('C', 'G') AND state IN ('offered', 'countered')) OR (k = 'R' AND state = 'granted') THEN 0 ELSE 1 END
FROM f JOIN e ON e.session = f.session AND e.i = f.i + 1)
SELECT session, state, price, rounds, ignored FROM f QUALIFY row_number() OVER (PARTITION BY session ORDER BY i DESC) = 1""",
    "event_checks": """
WITH k AS (SELECT event_id, event_type, CASE WHEN event_id % 9 > 0 THEN value - 5 END AS p FROM events)
SELECT event_id, CASE WHEN event_type = 'error' THEN 'unknown_type' WHEN event_type IN ('view', 'click', 'purchase') AND (p IS NULL OR p < 0) THEN 'invalid_payload' END AS problem FROM k""",
    "event_sequences": f"WITH {_SEQUENCED} SELECT event_id, sequence::INT AS sequence, own::INT AS own FROM q",
    "events_in_range": f"WITH {_SEQUENCED} SELECT session, sequence::INT AS sequence, event_id FROM q WHERE sequence BETWEEN 3 AND 20 AND event_type IN ('view', 'click')",
    "next_sequences": f"WITH {_SEQUENCED} SELECT session, (max(sequence) + 1)::INT AS next FROM q GROUP BY 1",
    "state_snapshots": f"WITH {_SEQUENCED}, s AS (SELECT session, sequence, sum(value) OVER (PARTITION BY session ORDER BY sequence) AS t, value FROM q) SELECT session, sequence::INT AS version, round(t, 4) AS total, value AS last FROM s WHERE sequence % 10 = 0",
    "states_from_snapshots": f"WITH {_SEQUENCED} SELECT session, max(sequence)::BIGINT AS version, round(sum(value), 4) AS total, arg_max(value, sequence) AS last, (max(sequence) % 10)::BIGINT AS replayed FROM q GROUP BY 1",
    "priority_bids": """
SELECT event_id, row_number() OVER w::INT AS place, value > coalesce(max(value) OVER (PARTITION BY event_id % 40 ORDER BY CAST(ts AS DATE), user_id % 10 DESC, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) AS winning, max(value) OVER w AS highest
FROM events WINDOW w AS (PARTITION BY event_id % 40 ORDER BY CAST(ts AS DATE), user_id % 10 DESC, ts, event_id)""",
    "request_rejections": """
WITH k AS (SELECT event_id, user_id, event_id % 3 AS k, event_type, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS s FROM events)
SELECT event_id, count(*) OVER w AS requests, count(*) FILTER (event_type = 'error') OVER w AS rejections FROM k WINDOW w AS (PARTITION BY user_id, k ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)""",
    "slow_calls": """
WITH k AS (SELECT event_id, count(*) OVER w AS calls, count(*) FILTER (value > 50) OVER w AS slow_calls FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT *, calls > 10 AND slow_calls >= 0.5 * calls AS opens FROM k""",
    "state_documents": f"WITH {_SEQUENCED}, m AS (SELECT session, max(sequence) AS v FROM q GROUP BY 1) SELECT m.session, v::INT AS version, event_id AS oldest FROM m JOIN q ON q.session = m.session AND q.sequence = greatest(1, v - 4)",
    "automatic_prices": "SELECT doc_id, round(greatest(5, least(500, 20 + least(length(text) / 180, 120) + doc_id % 50 * 1.5::DOUBLE + doc_id % 90 * 1.2::DOUBLE)), 6) AS price FROM documents",
    "price_strategies": """
WITH p AS (SELECT p_partkey, p_size, p_retailprice AS x, max(p_retailprice) OVER (PARTITION BY p_brand) AS t FROM part)
SELECT p_partkey, CASE WHEN x = t THEN 'premium' WHEN x >= 0.9::DOUBLE * t THEN 'competitive' ELSE 'penetration' END AS strategy, CASE WHEN x = t THEN 1.2::DOUBLE WHEN x >= 0.9::DOUBLE * t THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END AS adjustment,
CASE WHEN p_size * 1.5 >= 50 THEN 'high' WHEN p_size * 1.5 >= 20 THEN 'medium' ELSE 'low' END AS network FROM p""",
    "lineage_parents": """
WITH RECURSIVE s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, '{"part":"' || l_partkey || '"}') AS i, '{"part":"' || l_partkey || '"}' AS c FROM lineitem),
h AS (SELECT l_orderkey, 0::BIGINT AS i, '0' AS h FROM (SELECT DISTINCT l_orderkey FROM lineitem) UNION ALL SELECT s.l_orderkey, s.i, sha256(h || '|' || c) FROM h JOIN s ON s.l_orderkey = h.l_orderkey AND s.i = h.i + 1),
l AS (SELECT l_orderkey, arg_max(h, i) AS h FROM h GROUP BY 1) SELECT o_orderkey AS l_orderkey, coalesce(h, '0') AS parent_hash FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
    "lineage_purge": "SELECT count_if(o_orderdate >= TIMESTAMP '2001-12-01' - INTERVAL 1000 DAYS)::BIGINT AS kept, count_if(o_orderdate < TIMESTAMP '2001-12-01' - INTERVAL 1000 DAYS)::BIGINT AS gone FROM orders",
    "lineage_kinds": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate > TIMESTAMP '2001-12-01' - INTERVAL 900 DAYS AND o_orderdate <= TIMESTAMP '2001-12-01' GROUP BY 1",
    "quality_by_source": "SELECT p_partkey, round(CASE WHEN p_partkey % 3 = 0 THEN p_size / 50 WHEN p_partkey % 2 = 0 THEN p_size / 100 ELSE 0.5::DOUBLE END, 6) AS quality FROM part",
    "relations_put_right": """
WITH r AS (SELECT o_orderkey, o_custkey, o_orderstatus AS t, o_orderkey % 5 AS n, CASE WHEN o_orderkey % 6 = 0 THEN 0.9::DOUBLE WHEN o_orderkey % 4 = 0 THEN 0.7::DOUBLE END AS confidence, CASE WHEN o_orderkey % 4 = 0 THEN -1 END AS polarity FROM orders),
m AS (SELECT *, min(t) OVER (PARTITION BY o_custkey, n) <> max(t) OVER (PARTITION BY o_custkey, n) AS several FROM r)
SELECT o_orderkey, confidence, polarity::INT AS polarity, CASE WHEN n IN (1, 4) OR polarity < 0 OR (several AND n <> 0) THEN NULL ELSE 'one' END AS cardinality FROM m""",
    "edge_keys": "SELECT n_nationkey, n_name || '::' || n_regionkey || '::IN::' || sha256(lower(n_name)) AS key FROM nation",
    "merged_attributes": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS a, 'kept' AS b, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey::VARCHAR END AS c FROM nation",
    "linked_suppliers": "SELECT l_partkey, array_to_string(list_transform(list_sort(list_distinct(list(l_suppkey))), lambda x: x::VARCHAR), ',') AS entities FROM lineitem GROUP BY 1",
    "edited_edges": """
WITH d AS (SELECT o_custkey AS edge, arg_max(['create', 'update', 'delete'][o_orderkey % 3 + 1], o_orderkey) AS a FROM orders GROUP BY 1), e AS (SELECT c_custkey AS edge, c_name FROM customer WHERE c_custkey % 3 > 0)
SELECT edge, CASE WHEN a IS NOT NULL AND edge % 2 = 0 THEN 'new' WHEN c_name IS NOT NULL THEN 'old' END AS relation, c_name AS description FROM e FULL JOIN d USING (edge) WHERE a IS NULL OR (a <> 'delete' AND (c_name IS NOT NULL OR a = 'create'))""",
    "graph_view": """
WITH n AS (SELECT 's' || s_suppkey AS id, s_name AS label, 'document' AS kind FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_name, 'entity' FROM nation WHERE n_nationkey < 20),
e AS (SELECT 'n' || s_nationkey AS id, count(*) AS c FROM supplier WHERE s_nationkey < 20 GROUP BY 1) SELECT id, label, kind, coalesce(c, 0) AS edges FROM n LEFT JOIN e USING (id)""",
    "flat_properties": "SELECT n_nationkey, 'region_key' AS name, n_regionkey::VARCHAR AS value FROM nation UNION ALL SELECT n_nationkey, 'name', n_name FROM nation",
    "asset_page": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40 OFFSET 20",
    "operation_history": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS rank FROM events QUALIFY rank <= 7",
    "document_previews": "SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN 'Doc ' || doc_id ELSE 'Untitled' END AS title, sha256(substring(coalesce(text, ''), 1, 1200)) AS hash FROM documents",
    "owner_assets": "SELECT json_extract_string(props, '$.k') AS owner, count(*) AS n, 0::BIGINT AS missing FROM events GROUP BY 1",
    "new_listings": """
WITH p AS (SELECT doc_id, length(text) AS n, CAST(round(greatest(0.05::DOUBLE, least(500, doc_id % 700 / 0.9::DOUBLE - 5)) * 100) AS BIGINT) AS cents FROM documents)
SELECT doc_id, least(n, 255)::INT AS title_chars, least(n, 600)::INT AS summary_chars, least(n, 300)::INT AS excerpt_chars, cents, cents / 100 AS credits FROM p""",
    "download_counts": """
WITH a AS (SELECT user_id, count(*) AS n, max(ts) AS t FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT c_custkey AS user_id, 2 + coalesce(n, 0) AS downloads, epoch_us(greatest(TIMESTAMP '2024-01-15', coalesce(t, TIMESTAMP '2024-01-15'))) AS last_us FROM customer LEFT JOIN a ON user_id = c_custkey""",
    "rights_grants": "SELECT o_orderkey, (o_orderkey % 400)::INT AS days, CAST(floor(o_totalprice / 7 * 100 + 1e-9) AS BIGINT) AS cents FROM orders",
    "yield_settings": """
WITH s AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events WHERE event_type IN ('click', 'view') GROUP BY 1), f AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
SELECT c_custkey AS user_id, CASE t WHEN 'click' THEN 'growth' WHEN 'view' THEN 'safe' ELSE 'balanced' END AS strategy, f.user_id IS NULL AS enabled FROM customer LEFT JOIN s ON s.user_id = c_custkey LEFT JOIN f ON f.user_id = c_custkey""",
    "episode_sessions": "SELECT conv_id, count(*) AS messages, count_if(role = 'system')::BIGINT AS events, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations WHERE conv_id % 7 <> 0 GROUP BY 1",
    "preferences_asked": "SELECT c_custkey AS user_id, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE s_suppkey::VARCHAR END, 'light') AS value FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
    "user_profiles": """
WITH u AS (SELECT user_id, nullif(count_if(event_type = 'view'), 0)::BIGINT AS views FROM events GROUP BY 1), m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events WHERE event_type = 'purchase')
SELECT user_id, views, s AS memories FROM u LEFT JOIN (SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY k) AS s FROM m WHERE k <= 3 GROUP BY 1) USING (user_id)""",
    "prompt_layers": """
WITH l AS (SELECT conv_id, turn, CASE WHEN turn >= 3 THEN 0 ELSE 1 END::INT AS layer, row_number() OVER (PARTITION BY conv_id ORDER BY turn < 3, turn DESC) AS k FROM conversations)
SELECT conv_id, turn, layer, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS place FROM l WHERE k <= 4""",
    "exported_documents": "SELECT source, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "stale_files": f"SELECT event_id FROM events WHERE ts < {_END} - INTERVAL 20 DAYS",
    "folder_paths": "SELECT n_nationkey, CASE WHEN n_regionkey > 0 THEN '/r' || n_regionkey || '/' ELSE '/' END || n_name AS path FROM nation",
    "days_and_ids": f"SELECT event_id, round((epoch_us({_END}) - epoch_us(ts)) / 86400000000, 6) AS days, ((epoch_us(ts) // 1000 - 1704067200000) << 22) | ((user_id % 1024) << 12) | (event_id % 4096) AS snowflake FROM events",
    "record_consistency": "SELECT round(count_if((event_id % 4 = 3) = (SELECT min(event_id) % 4 = 3 FROM events)) / count(*), 6) AS consistency FROM events",
    "asset_clusters": "SELECT p_type, count(*) AS size, min(p_partkey) AS first_member, max(p_partkey) AS last_member FROM part GROUP BY 1",
    "collaboration_stats": f"""
WITH a AS (SELECT event_type, count(DISTINCT user_id) AS c FROM events WHERE ts > {_END} - INTERVAL 7 DAYS AND ts <= {_END} GROUP BY 1)
SELECT event_type, n, coalesce(c, 0) AS active FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) LEFT JOIN a USING (event_type)""",
}
