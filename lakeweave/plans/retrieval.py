"""Queries over ``embeddings``: vector search, fusion and metrics; equal labels are relevant.

The query set is every vector whose id is divisible by 100, against all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector
from ..operators import retrieval, vector_index
from ..sources.tables import table

KEY = ["query_id", "vec_id"]


def _asked(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))


def _nearest(spark: SparkSession, sf_dir: str, k: int, dimensions: int | None = None) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    if dimensions:
        e = e.withColumn("embedding", F.slice("embedding", 1, dimensions))
    return retrieval.nearest(e, _asked(e), k)


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two candidate lists: by whole vectors, and as a stand-in for the graph channel by their first 16 dimensions."""
    return _nearest(spark, sf_dir, 30), _nearest(spark, sf_dir, 24, 16)


def _labelled(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with ``hit``: whether the item has the query's label."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    asked = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    return rows.join(labels, "vec_id").join(asked, "query_id").withColumn("hit", (F.col("label") == F.col("query_label")).cast("int"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(_nearest(spark, sf_dir, 10), spark, sf_dir).select("query_id", "vec_id", "label", "rank", F.round("score", 6).alias("score"), retrieval.confidence(F.col("score")).alias("confidence"))


def doc_best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _labelled(_nearest(spark, sf_dir, 100), spark, sf_dir)
    return retrieval.best_per_document(found, "label", 5).select("query_id", "label", F.round("score", 6).alias("score"))


def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, 10).where("score >= 0.2").select("query_id", "vec_id", F.round("score", 4).alias("score"))


def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.reciprocal_rank_fusion(*_lists(spark, sf_dir), KEY).select(*KEY, F.round("score", 9).alias("score"))


def weighted_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.weighted_fusion(*_lists(spark, sf_dir), KEY).select(*KEY, F.round("score", 6).alias("score"))


def minmax_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.min_max_fusion(*_lists(spark, sf_dir), KEY).select(*KEY, F.round("score", 6).alias("score"))


def hybrid_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hybrid_merge(*_lists(spark, sf_dir), KEY, 12).select(*KEY, "rank", F.round("score", 6).alias("score"))


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    number = e.groupBy(F.col("label").alias("query_label")).agg((F.count(F.lit(1)) - 1).alias("relevant"))
    totals = _asked(e).select("query_id", "query_label").join(number, "query_label").select("query_id", "relevant")
    out = retrieval.metrics(_labelled(_nearest(spark, sf_dir, 10), spark, sf_dir), totals, "query_id", 10)
    return out.select("query_id", *(F.round(c, 6).alias(c) for c in ("recall", "ndcg", "mrr", "map")), "hit")


def retrieval_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.overall_confidence(_nearest(spark, sf_dir, 10), "query_id")


def retrieval_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks: eight of a document; some without a chunk number, some with odd scores."""
    chunk = F.when(F.col("vec_id") % 5 > 0, F.col("vec_id") % 8)
    score = F.when(F.col("vec_id") % 7 == 0, F.lit(1.5)).when(F.col("vec_id") % 11 == 0, F.lit(None)).otherwise(F.col("score"))
    rows = _nearest(spark, sf_dir, 10).select("query_id", F.floor(F.col("vec_id") / 8).alias("doc"), chunk.alias("chunk"), score.alias("score"))
    return retrieval.candidates(rows, "vector", "doc", "chunk").select("query_id", "candidate", "chunk_index", "score", "confidence")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("chunk"), F.length("text").alias("n_chars"))


def candidates_by_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to turns of conversations; every fourth one's turn is negative, some aren't there."""
    v = F.col("vec_id")
    refs = _nearest(spark, sf_dir, 10).select("query_id", v.alias("doc"), F.when(v % 4 == 0, -1).otherwise(v % 6).cast("int").alias("chunk"), "score")
    return retrieval.hydrated(refs, _chunks(spark, sf_dir), "doc", "chunk").select("query_id", "doc", "chunk", "n_chars")


def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a remote model: distinct references, hydrated, by their own score."""
    v = F.col("vec_id")
    refs = _nearest(spark, sf_dir, 20).select("query_id", F.floor(v / 2).alias("doc"), F.lit(1).alias("chunk"), "score")
    return retrieval.reranked(refs, _chunks(spark, sf_dir), "doc", "chunk", 5).select("query_id", "doc", "rank", F.round("score", 6).alias("score"))


def fusion_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _lists(spark, sf_dir)
    relevant = _labelled(a.select(*KEY).unionByName(b.select(*KEY)).distinct(), spark, sf_dir).where("hit = 1")
    return retrieval.overlap(a, b, relevant, "query_id", "vec_id", 10)


def graph_hop_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By whole vectors, hops by id as a stand-in; what has the query's label among the first 24 is relevant."""
    b = _labelled(_nearest(spark, sf_dir, 24), spark, sf_dir).withColumn("hop", F.col("vec_id") % 3 + 1)
    out = retrieval.hop_metrics(b.where("rank <= 12"), b.where("hit = 1"), "query_id", "vec_id")
    return out.select("query_id", F.round("recall", 6).alias("recall"), "hit", F.round("mrr", 6).alias("mrr"), F.round("mean_hops", 6).alias("mean_hops"), "least_hops")


def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found by the inverted file, with exact scores; most of them, not all (see ``indexed_recall``)."""
    e = table(spark, sf_dir, "embeddings")
    return vector_index.search(vector_index.build(e, target=0.99), _asked(e), 10).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def indexed_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors filed, and whether the mean recall at ten of all queries, against the exact search, is 0.95 or more."""
    e = table(spark, sf_dir, "embeddings")
    index = vector_index.build(e, target=0.99)
    filed = index.blocks.agg((F.sum("n") / index.copies).cast("long").alias("filed"))
    recall = vector_index.recall(vector_index.search(index, _asked(e), 10), _nearest(spark, sf_dir, 10))
    return recall.agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.95).alias("reached")).join(filed)


def indexed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents (eight vectors each) nearest to each query by their best chunk: every cell is probed, so the
    search is exact."""
    e = table(spark, sf_dir, "embeddings")
    index = vector_index.build(e, cells=8, copies=1, target=1.0)
    chunks = e.select("vec_id", F.floor(F.col("vec_id") / 8).alias("doc_id"))
    index.probes = len(index.centroids)
    return vector_index.relevant_documents(index, _asked(e), chunks, 5).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


def search_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.latency(table(spark, sf_dir, "events"), F.col("value"), "event_type")
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "p99")))


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector length by label, and how many dimensions vectors have most often."""
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(vector.norm(F.col("embedding"))), 6).alias("norm"), F.mode(F.size("embedding")).alias("dimensions"))


QUERIES = {f.__name__: f for f in (
    vector_topk, doc_best_chunk, memory_search, rrf, weighted_fuse, minmax_fuse, hybrid_fuse, retrieval_metrics, retrieval_confidence,
    retrieval_candidates, candidates_by_refs, rerank_fallback, fusion_overlap, graph_hop_metrics, indexed_topk, indexed_recall, indexed_documents, search_latency, label_centroids,
)}


def _found(name: str, k: int, dimensions: int = 64) -> str:
    """The ``k`` nearest by the first dimensions: query_id, vec_id, label, rel, score, rank."""
    a, b = f"e.embedding[1:{dimensions}]", f"q.embedding[1:{dimensions}]"
    length = "sqrt(list_sum(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE)))"
    cosine = f"list_sum(list_transform(range(1, {dimensions + 1}), lambda i: e.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)) / ({length.format(a)} * {length.format(b)})"
    return f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
SELECT q.vec_id AS query_id, e.vec_id, e.label, e.label = q.label AS rel, round({cosine}, 9) AS score FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id) QUALIFY rank <= {k})"""


_LISTS = f"WITH {_found('a', 30)}, {_found('b', 24, 16)}"
_LABEL = "CASE WHEN {0} >= 0.7 THEN 'high' WHEN {0} >= 0.4 THEN 'medium' ELSE 'low' END"
ORACLE_SQL = {
    "vector_topk": f"WITH {_found('a', 10)} SELECT query_id, vec_id, label, rank, round(score, 6) AS score, {_LABEL.format('a.score')} AS confidence FROM a",
    "doc_best_chunk": f"WITH {_found('a', 100)}, m AS (SELECT query_id, label, max(score) AS x FROM a GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY x DESC, label) <= 5) SELECT query_id, label, round(x, 6) AS score FROM m",
    "memory_search": f"WITH {_found('a', 10)} SELECT query_id, vec_id, round(a.score, 4) AS score FROM a WHERE a.score >= 0.2",
    "rrf": f"{_LISTS} SELECT query_id, vec_id, round(sum(x), 9) AS score FROM (SELECT query_id, vec_id, 0.6::DOUBLE / (60 + rank) AS x FROM a UNION ALL SELECT query_id, vec_id, 0.4::DOUBLE / (60 + rank) FROM b) GROUP BY 1, 2",
    "weighted_fuse": f"{_LISTS} SELECT query_id, vec_id, round(0.6::DOUBLE * coalesce(a.score, 0) + 0.4::DOUBLE * coalesce(b.score, 0), 6) AS score FROM a FULL JOIN b USING (query_id, vec_id)",
    "minmax_fuse": f"""{_LISTS}, x AS (SELECT query_id, vec_id, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS v FROM a WINDOW w AS (PARTITION BY query_id)),
y AS (SELECT query_id, vec_id, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS v FROM b WINDOW w AS (PARTITION BY query_id))
SELECT query_id, vec_id, round(0.6::DOUBLE * coalesce(x.v, 0) + 0.4::DOUBLE * coalesce(y.v, 0), 6) AS score FROM x FULL JOIN y USING (query_id, vec_id)""",
    "hybrid_fuse": f"""{_LISTS}, m AS (SELECT query_id, vec_id, least(1::DOUBLE, 0.6::DOUBLE * (coalesce(a.score, 0) + coalesce(b.score, 0) * 0.9::DOUBLE) / (CASE WHEN a.rank IS NULL THEN 0 ELSE 1.0::DOUBLE END + CASE WHEN b.rank IS NULL THEN 0 ELSE 0.9::DOUBLE END)
+ 0.4::DOUBLE * least(12 * (coalesce(1.0::DOUBLE / (20 + a.rank), 0) + coalesce(1.0::DOUBLE / (20 + b.rank), 0)), 1::DOUBLE) + CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 0.08::DOUBLE ELSE 0 END) AS x FROM a FULL JOIN b USING (query_id, vec_id))
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, vec_id) AS rank, round(x, 6) AS score FROM m QUALIFY rank <= 12""",
    "retrieval_metrics": f"""
WITH {_found('r', 10)}, h AS (SELECT *, sum(rel::INT) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS so_far FROM r),
f AS (SELECT query_id, sum(rel::INT) AS hits, sum(rel::INT / log2(rank + 1)) AS dcg, coalesce(max(CASE WHEN rel THEN 1.0::DOUBLE / rank END), 0) AS mrr, sum(CASE WHEN rel THEN so_far / rank ELSE 0 END) AS ps FROM h GROUP BY 1),
n AS (SELECT q.vec_id AS query_id, count(*) AS relevant FROM embeddings q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1)
SELECT query_id, round(hits / relevant, 6) AS recall, round(dcg / list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 6) AS ndcg, round(mrr, 6) AS mrr, round(ps / relevant, 6) AS map, (hits > 0)::INT AS hit FROM n JOIN f USING (query_id)""",
    "retrieval_confidence": f"WITH {_found('a', 10)} SELECT query_id, {_LABEL.format('max(a.score)')} AS confidence FROM a GROUP BY 1",
    "retrieval_candidates": f"""WITH {_found('a', 10)}, c AS (SELECT query_id, vec_id // 8 AS d, CASE WHEN vec_id % 5 > 0 THEN vec_id % 8 ELSE 0 END::INT AS chunk_index,
round(CASE WHEN vec_id % 7 = 0 THEN 1 WHEN vec_id % 11 = 0 THEN 0 ELSE greatest(0, least(1, a.score)) END, 6) AS s FROM a)
SELECT query_id, 'vector:' || d || ':' || chunk_index AS candidate, chunk_index, s AS score, {_LABEL.format('s')} AS confidence FROM c""",
    "candidates_by_refs": f"WITH {_found('a', 10)} SELECT query_id, vec_id AS doc, turn AS chunk, length(text) AS n_chars FROM a JOIN conversations ON conv_id = vec_id AND turn = vec_id % 6 WHERE vec_id % 4 <> 0",
    "rerank_fallback": f"""WITH {_found('a', 20)}, c AS (SELECT query_id, vec_id // 2 AS doc, max(score) AS x FROM a GROUP BY 1, 2)
SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, doc) AS rank, round(x, 6) AS score FROM c JOIN conversations ON conv_id = doc AND turn = 1 QUALIFY rank <= 5""",
    "fusion_overlap": f"""{_LISTS}, x AS (SELECT query_id, vec_id, a.rank IS NOT NULL AS i, b.rank IS NOT NULL AS j, coalesce(a.rel, b.rel) AS rel FROM (FROM a WHERE rank <= 10) a FULL JOIN (FROM b WHERE rank <= 10) b USING (query_id, vec_id))
SELECT query_id, count_if(i AND j)::BIGINT AS both, count_if(i AND NOT j)::BIGINT AS first_alone, count_if(j AND NOT i)::BIGINT AS second_alone, count_if(i AND rel)::BIGINT AS first_hits, count_if(j AND rel)::BIGINT AS second_hits, count_if(rel)::BIGINT AS hits FROM x GROUP BY 1""",
    "graph_hop_metrics": f"""WITH {_found('b', 24)}
SELECT query_id, round(count_if(rank <= 12) / count(*), 6) AS recall, (count_if(rank <= 12) > 0)::INT AS hit, round(coalesce(max(CASE WHEN rank <= 12 THEN 1.0::DOUBLE / rank END), 0), 6) AS mrr,
round(avg(CASE WHEN rank <= 12 THEN vec_id % 3 + 1 END), 6) AS mean_hops, min(CASE WHEN rank <= 12 THEN vec_id % 3 + 1 END) AS least_hops FROM b WHERE rel GROUP BY 1""",
    "indexed_recall": "SELECT count_if(vec_id % 100 = 0)::BIGINT AS queries, true AS reached, count(*) AS filed FROM embeddings",
    "indexed_documents": f"""WITH {_found('a', 50)}, d AS (SELECT query_id, vec_id // 8 AS doc_id, max(score) AS s FROM a GROUP BY 1, 2)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank, round(s, 6) AS score FROM d QUALIFY rank <= 5""",
    "search_latency": "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "label_centroids": "SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS norm, 64::INT AS dimensions FROM embeddings GROUP BY 1",
}
