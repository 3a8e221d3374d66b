"""Queries over chunkers, feature encoders, one graph layer, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chunking, features, sage
from ..sources.shared import shared_dir, written
from ..sources.tables import table
from ..streaming import events as stream
from ..streaming import sessions

TYPES = ["click", "error", "purchase", "signup", "view"]


def node_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.node_features(table(spark, sf_dir, "events"), "event_type", TYPES, ["value"], "ts")
    return out.select("event_id", F.posexplode("features").alias("k", "x")).groupBy("k").agg(F.round(F.avg("x"), 6).alias("mean"))


def zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.z_scores(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice").select("p_partkey", F.round("p_size_z", 6).alias("p_size_z"), F.round("p_retailprice_z", 6).alias("p_retailprice_z"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("src"))
    ids = ids.crossJoin(F.broadcast(ids.agg(F.count(F.lit(1)).alias("n"))))
    return ids.select("src", F.explode(F.array((F.col("src") * 7 + 1) % F.col("n"), (F.col("src") * 3 + 2) % F.col("n"))).alias("dst")).where("src <> dst").distinct()


def sage_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.sage_layer(_nodes(spark, sf_dir), _links(spark, sf_dir), 64)
    return out.select("id", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


def link_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.link_scores(_links(spark, sf_dir), _nodes(spark, sf_dir))
    return out.select("src", "dst", F.round("score", 6).alias("score"))


def train_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.split(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 0.8)


def chunk_section_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(table(spark, sf_dir, "documents"), "doc_id", "text", "section_pack")


def chunk_fixed_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(table(spark, sf_dir, "documents"), "doc_id", "text", "fixed_overlap")


def chunk_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(table(spark, sf_dir, "documents"), "doc_id", "text", "sliding")


def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans for a model's context; that they cover the text, and how long the longest is."""
    out = chunking.chunk(table(spark, sf_dir, "documents"), "doc_id", "text", "recursive")
    return out.groupBy("doc_id").agg(F.max("stop").alias("last"), (F.max(F.col("stop") - F.col("start")) <= 3000).alias("held"))


def chunk_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents and their turns as chunks."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.concat(F.when(F.col("turn") % 3 == 0, "- ").otherwise(""), "text"))
    out = chunking.breaks(turns, "conv_id", "turn", "text")
    return out.select("conv_id", "chunks", "breaks", "whole", "good", F.round("score", 6).alias("score"))


def chunk_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chunks = chunking.chunk(docs, "doc_id", "text", chunking.strategy(F.col("text")))
    return chunking.quality(chunks)


def _folder(spark: SparkSession) -> str:
    return shared_dir(spark, "stream")


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream.read(spark, f"{sf_dir}/events.parquet")
    out = stream.run_to_table(stream.windowed(rows, "1 day", None, "event_type"), _folder(spark), "windows", "complete")
    return out.select(F.unix_seconds("start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream.read(spark, f"{sf_dir}/events.parquet")
    out = stream.run_to_table(stream.windowed(rows, "2 days", "1 day", "event_type"), _folder(spark), "sliding", "complete")
    return out.select(F.unix_seconds("start").alias("start_s"), "event_type", "n")


def stream_idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream.read(spark, f"{sf_dir}/events.parquet")
    out = stream.run_to_table(stream.idle_sessions(rows, "user_id", "6 hours"), _folder(spark), "sessions", "complete")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n")


def stream_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files are one micro-batch: rows of a later one, older than the watermark of the first, would be dropped."""
    rows = stream.read(spark, f"{sf_dir}/events.parquet", 100_000)
    out = stream.run_to_table(stream.token_bucket(rows, "user_id", 2.0, 1 / 36000), _folder(spark), "buckets")
    return out.groupBy("user_id").agg(F.sum("admitted").alias("admitted"), F.sum("refused").alias("refused"))


def stream_recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of their user's session: the newest twenty, gone six hours after the last."""
    rows = stream.read(spark, f"{sf_dir}/events.parquet", 100_000).select("user_id", F.col("event_id").alias("id"), "ts", F.col("event_type").alias("text"))
    out = sessions.run_in_batches(sessions.recent_messages(rows, "user_id", 20, 21600.0), _folder(spark), "messages")
    return sessions.latest(out, "user_id").select("user_id", "n", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), "tokens", "expired")


def stream_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits of a resource of five users, each the child of its user's edit before: the edits that the watermark
    has passed, with their user's count in the clock and the number of edits they conflict with."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id")
    edits = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 5).alias("resource"), F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("ts"), F.array_compact(F.array(F.lag("event_id").over(before))).alias("parents"))
    held = written(edits, "edits")
    rows = spark.readStream.schema(held.schema).option("maxFilesPerTrigger", 100_000).parquet(held.inputFiles()[0].rsplit("/", 1)[0])
    out = sessions.run_in_batches(sessions.live_operations(rows, "resource", 21600.0, ids=False), _folder(spark), "operations")
    own = F.try_element_at(F.from_json("clock", "map<string,long>"), F.col("user"))
    return out.select("resource", "id", own.alias("sequence"), "conflicts")


def graphsage_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of all nodes by two layers with weights drawn by a seed (held against NumPy in the tests)."""
    weights = sage.initial_weights(64, 16, 8, 2, seed=1)
    out = sage.forward(_nodes(spark, sf_dir), _links(spark, sf_dir), weights, 2)
    return out.select("id", F.transform("x", lambda v: F.round(v, 6)).alias("x"))


def graphsage_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One embedding for each label, pooled by attention over its nodes."""
    members = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("graph"))
    out = sage.forward(_nodes(spark, sf_dir), _links(spark, sf_dir), sage.initial_weights(64, 16, 8, 2, seed=1), 2, members)
    return out.select("graph", F.transform("x", lambda v: F.round(v, 6)).alias("x"))


def graphsage_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses by epoch of a model that learns the nodes' labels; a fifth of them, by hash, judges it."""
    settings = sage.Settings(hidden=16, fan_out=4, classes=10, epochs=6, rate=0.05)
    targets = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array(F.pmod(F.col("label"), F.lit(10)).cast("double")).alias("y"))
    rows = sage.examples(_nodes(spark, sf_dir), _links(spark, sf_dir), features.split(targets, "id", 0.8), 64, settings)
    losses = sage.history(spark, sage.train(rows, 64, settings, shared_dir(spark, "sage")))
    return losses.select("epoch", F.round("train_loss", 6).alias("train_loss"), F.round("validation_loss", 6).alias("validation_loss"))


def html_to_text_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without scripts, styles and tags, white space collapsed."""
    bare = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"\s+", " ")).alias("text"))


QUERIES = {f.__name__: f for f in (node_features, zscore, sage_layer, link_score, train_split, chunk_section_pack, chunk_fixed_overlap, chunk_sliding, chunk_routed, stream_window_counts, stream_sliding_counts, stream_idle_sessions, chunk_recursive, chunk_breaks, stream_token_bucket, stream_recent_messages, stream_operations, graphsage_embeddings, graphsage_pooled, graphsage_training, html_to_text_parser)}

_COS = "(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))))"
_LINKS = "l AS (SELECT DISTINCT vec_id AS src, unnest([(vec_id * 7 + 1) % (SELECT count(*) FROM embeddings), (vec_id * 3 + 2) % (SELECT count(*) FROM embeddings)]) AS dst FROM embeddings)"
ORACLE_SQL = {
    "chunk_recursive": "SELECT doc_id, length(text) AS last, true AS held FROM documents WHERE regexp_matches(text, '\\S')",
    "chunk_breaks": r"""
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '- ' ELSE '' END || text AS t FROM conversations), n AS (SELECT *, lead(t) OVER (PARTITION BY conv_id ORDER BY turn) AS after, right(t, 1) IN ('。', '！', '？', '.', '!', '?', '；', ';') AS w FROM c),
s AS (SELECT conv_id, count(*) AS chunks, count(after) AS breaks, count_if(after IS NOT NULL AND w)::BIGINT AS whole, count_if(after IS NOT NULL AND length(t) > 0 AND (w OR regexp_matches(after, '^(\n\n| .|#{1,4} |[-*+] |[1-5]\. )')))::BIGINT AS good, coalesce(stddev_pop(length(t)), 0) AS d FROM n GROUP BY 1)
SELECT conv_id, chunks, breaks, whole, good, round(0.3::DOUBLE * greatest(0, 1 - d / 1000) + 0.4::DOUBLE * CASE WHEN breaks = 0 THEN 1 ELSE good / breaks END + 0.3::DOUBLE * CASE WHEN breaks = 0 THEN 1 ELSE whole / breaks END, 6) AS score FROM s""",
    "stream_recent_messages": """
WITH m AS (SELECT user_id, event_id, ts, length(event_type) AS c, row_number() OVER w AS k, lag(ts) OVER w - ts AS pause FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)),
g AS (SELECT *, max(coalesce(pause, INTERVAL 0 SECONDS)) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS longest FROM m), l AS (SELECT max(ts) - INTERVAL 10 MINUTES AS passed FROM events),
s AS (SELECT user_id, max(ts) + INTERVAL 6 HOURS <= passed AS expired, count_if(k <= 20 AND longest <= INTERVAL 6 HOURS) AS n, string_agg(CASE WHEN k <= 20 AND longest <= INTERVAL 6 HOURS THEN event_id::VARCHAR END, ',' ORDER BY ts, event_id) AS ids,
    sum(CASE WHEN k <= 20 AND longest <= INTERVAL 6 HOURS THEN c ELSE 0 END) // 2 AS tokens FROM g, l GROUP BY user_id, passed)
SELECT user_id, CASE WHEN expired THEN 0 ELSE n END::BIGINT AS n, CASE WHEN expired THEN '' ELSE ids END AS ids, CASE WHEN expired THEN 0 ELSE tokens END::BIGINT AS tokens, expired FROM s""",
    "stream_operations": """
WITH e AS (SELECT user_id // 5 AS resource, event_id, user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id // 5 ORDER BY ts, event_id) > INTERVAL 6 HOURS AS new FROM events),
c AS (SELECT *, sum(coalesce(new, true)::INT) OVER (PARTITION BY resource ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS chain FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY resource, chain ORDER BY ts, event_id) AS k, row_number() OVER (PARTITION BY resource, chain, user_id ORDER BY ts, event_id) AS own FROM c)
SELECT resource, event_id AS id, own + 1 AS sequence, (k - own)::INT AS conflicts FROM r WHERE ts < (SELECT max(ts) - INTERVAL 10 MINUTES FROM events)""",
    "stream_sliding_counts": "SELECT epoch(d - INTERVAL (k) DAY)::BIGINT AS start_s, event_type, count(*) AS n FROM (SELECT date_trunc('day', ts) AS d, event_type, unnest([0, 1]) AS k FROM events) GROUP BY 1, 2",
    "stream_idle_sessions": """
WITH g AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOURS AS new FROM events), s AS (SELECT user_id, ts, sum(coalesce(new, true)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_token_bucket": """
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events), f AS (SELECT DISTINCT user_id, 0::BIGINT AS i, NULL::BOOLEAN AS ok, 2::DOUBLE AS tokens, NULL::DOUBLE AS sec FROM e UNION ALL
SELECT user_id, i, t >= 1, t - (t >= 1)::INT, sec FROM (SELECT f.user_id, e.i, e.sec, CASE WHEN f.sec IS NULL THEN 2::DOUBLE ELSE least(2::DOUBLE, f.tokens + (e.sec - f.sec) / 36000) END AS t FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT user_id, count_if(ok)::BIGINT AS admitted, count_if(NOT ok)::BIGINT AS refused FROM f WHERE i > 0 GROUP BY 1""",
    "node_features": f"""
WITH p AS (SELECT [{', '.join(f"(event_type = '{t}')::INT::DOUBLE" for t in TYPES)}, value,
{', '.join(f'{f}(2 * pi() * {p})' for p in ('(month(ts) - 1) / 12', '(day(ts) - 1) / 31', 'hour(ts) / 24') for f in ('sin', 'cos'))}] AS x FROM events),
u AS (SELECT unnest(range(0, 12)) AS k, unnest(x) AS x FROM p) SELECT CAST(k AS INTEGER) AS k, round(avg(x), 6) AS mean FROM u GROUP BY 1""",
    "zscore": "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size_z, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS p_retailprice_z FROM part",
    "link_score": f"WITH {_LINKS} SELECT src, dst, round(({_COS} + 1) / 2, 6) AS score FROM l JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst WHERE src <> dst",
    "sage_layer": f"""
WITH {_LINKS}, s AS (SELECT dst, k, avg(x) AS m FROM (SELECT dst, unnest(range(1, 65)) AS k, unnest(embedding)::DOUBLE AS x FROM l JOIN embeddings ON vec_id = src WHERE src <> dst) GROUP BY 1, 2),
n AS (SELECT vec_id, unnest(range(1, 65)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
h AS (SELECT vec_id, greatest(0, 0.6::DOUBLE * x + 0.4::DOUBLE * coalesce(m, 0)) AS h FROM n LEFT JOIN s ON dst = vec_id AND s.k = n.k)
SELECT vec_id AS id, round(sum(h) / sqrt(sum(h * h)), 6) AS total FROM h GROUP BY 1""",
    "stream_window_counts": "SELECT epoch(date_trunc('day', ts))::BIGINT AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "html_to_text_parser": """SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages""",
}
