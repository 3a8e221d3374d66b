"""Queries over ``documents`` and ``pages``: normalising, redaction, reviews, profiles, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import convert
from ..sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def redact_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tx.redacted(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(out, 256).alias("hash"), (out != F.col("text")).alias("changed"))


def redact_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.listing_text(F.col("text"), 120).alias("summary"))


def review_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, flags = tx.review_quality(F.col("text")), tx.review_flags(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", q.alias("quality"), F.array_join(flags, ",").alias("flags"), tx.review_verdict(q, F.size(flags)).alias("verdict"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.content_hash(tx.normalized_markdown(F.col("text"))).alias("hash"))


def duplicate_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _docs(spark, sf_dir).select("doc_id", tx.content_hash(F.col("text")).alias("hash"))
    return hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.estimated_tokens(F.col("text")).alias("tokens"))


def markdown_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.looks_like_markdown(F.col("text")).alias("markdown"), tx.title(F.col("text"), 80).alias("title"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(tx.without_tags(F.col("html"))).cast("long").alias("n_chars"))


def mask_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", tx.masked(F.col("c_name")).alias("masked"), tx.pseudonym(F.col("c_custkey")).alias("alias"))


def safe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.safe_filename(F.concat(F.lit(" a/b:"), F.col("p_name"), F.lit("?.txt")), 20).alias("name"))


def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness over all cells, uniqueness of rows, weighted quality, of the documents table."""
    d = table(spark, sf_dir, "documents")
    cells = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0) for c in d.columns]
    filled = cells[0]
    for c in cells[1:]:
        filled = filled + c
    one = d.agg((F.sum(filled) / (F.count(F.lit(1)) * len(cells))).alias("completeness"), (F.countDistinct("text") / F.count(F.lit(1))).alias("uniqueness"))
    total = tx.weighted_quality(F.col("completeness"), F.lit(0.8), F.lit(0.9), F.lit(1.0), F.col("uniqueness"))
    return one.select(F.round("completeness", 6).alias("completeness"), F.round("uniqueness", 6).alias("uniqueness"), F.round(total, 6).alias("quality"))


def conversion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _docs(spark, sf_dir).select(F.round(tx.cleanliness(F.col("text")), 2).alias("clean"), F.round(tx.syntax_score(F.col("text")), 2).alias("syntax"))
    return scored.groupBy("clean", "syntax").agg(F.count(F.lit(1)).alias("n"))


def similar_pairs_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share word trigrams with a benchmark item, and how similar the pair is: an inverted index, no pairs beyond those that share one."""
    b = table(spark, sf_dir, "benchmark").select("item_id", tx.shingles(F.col("text")).alias("s"))
    d = _docs(spark, sf_dir).select("doc_id", tx.shingles(F.col("text")).alias("s"))
    items = b.select("item_id", F.size("s").alias("n_item"), F.explode("s").alias("g"))
    docs = d.select("doc_id", F.size("s").alias("n_doc"), F.explode("s").alias("g"))
    shared = docs.join(items, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("both"), F.first("n_item").alias("n_item"), F.first("n_doc").alias("n_doc"))
    return shared.select("doc_id", "item_id", F.round(F.col("both") / (F.col("n_item") + F.col("n_doc") - F.col("both")), 6).alias("jaccard"))


def chunk_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).agg(F.round(F.avg(F.length("text")), 4).alias("mean"), F.round(F.stddev_samp(F.length("text")), 4).alias("std"), F.min(F.length("text")).cast("long").alias("least"), F.max(F.length("text")).cast("long").alias("most"))


def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert.converted(table(spark, sf_dir, "pages"), "page_id", "html", "html")


QUERIES = {f.__name__: f for f in (html_markdown, redact_pii, redact_listing, review_checks, content_hash, duplicate_contents, token_estimate, markdown_detect, html_text, mask_names, safe_filenames, quality_profile, conversion_scores, similar_pairs_jaccard, chunk_text_stats)}


def _sql_redacted(column: str, patterns: dict[str, str], label: str) -> str:
    for name, p in patterns.items():
        flags, p = ("gi", p[4:]) if p.startswith("(?i)") else ("g", p)
        column = f"regexp_replace({column}, '{p}', '{label.format(name)}', '{flags}')"
    return column


_MD = " OR ".join(f"regexp_matches(left(text, 4000), '{p}')" for p in tx.MARKDOWN_PATTERNS)
_SHINGLES = "(SELECT {0}, list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM (SELECT {0}, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM {1}))"
ORACLE_SQL = {
    "conversion_scores": r"""
WITH s AS (SELECT len(regexp_extract_all(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]')) / greatest(length(text), 1) AS c, round(CASE WHEN len(regexp_extract_all(text, '```')) % 2 = 0 THEN 0.3::DOUBLE ELSE 0 END + 0.2::DOUBLE + CASE WHEN regexp_matches(text, '(?m)^\|.+\|$') THEN 0.2::DOUBLE ELSE 0.15::DOUBLE END
+ CASE WHEN regexp_matches(text, '(?m)^#{1,6}\s+') THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(text, '(?m)^[-*+]\s+|^\d+\.\s+') THEN 0.15::DOUBLE ELSE 0 END, 2) AS syntax FROM documents)
SELECT CASE WHEN c < 0.005 THEN 1.0::DOUBLE WHEN c < 0.01 THEN 0.8::DOUBLE WHEN c < 0.05 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS clean, syntax, count(*) AS n FROM s GROUP BY 1, 2""",
    "redact_pii": f"WITH r AS (SELECT doc_id, text, {_sql_redacted('text', tx.SENSITIVE, '[{}_REDACTED]')} AS t FROM documents) SELECT doc_id, sha256(t) AS hash, t <> text AS changed FROM r",
    "review_checks": """
WITH f AS (SELECT doc_id, 1.0::DOUBLE - 0.25::DOUBLE * ((length(text) < 100)::INT + (len(regexp_extract_all(text, '[ \\n\\t\\r]')) / length(text) > 0.3)::INT) AS quality,
array_to_string(list_filter([CASE WHEN regexp_matches(text, '\\b\\d{3}-\\d{2}-\\d{4}\\b') THEN 'ssn' END,
CASE WHEN regexp_matches(text, '(?i)\\b(?:sk|api|token|secret)[-_a-z0-9]{12,}\\b') THEN 'api_key' END,
CASE WHEN regexp_matches(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b') THEN 'email' END,
CASE WHEN regexp_matches(text, '\\b(?:\\+?\\d[\\d\\-\\s]{8,}\\d)\\b') THEN 'phone' END], lambda x: x IS NOT NULL), ',') AS flags FROM documents)
SELECT *, CASE WHEN quality >= 0.5 AND flags = '' THEN 'approved' ELSE 'manual_review' END AS verdict FROM f""",
    "content_hash": "SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '(?m)[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS hash FROM documents",
    "duplicate_contents": "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "token_estimate": "SELECT doc_id, CAST(trunc(len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) / 1.5 + len(regexp_extract_all(text, '[a-zA-Z]')) / 4 + (length(text) - len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}a-zA-Z]'))) / 2) AS INTEGER) AS tokens FROM documents",
    "markdown_detect": f"""SELECT doc_id, {_MD} AS markdown, left(CASE WHEN regexp_matches(text, '(?m)^#{{1,6}}\\s+(.+?)\\s*$') THEN regexp_extract(text, '(?m)^#{{1,6}}\\s+(.+?)\\s*$', 1)
ELSE coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1], '') END, 80) AS title FROM documents""",
    "html_text": "SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n_chars FROM pages",
    "mask_names": "SELECT c_custkey, left(c_name, 3) || repeat('*', length(c_name) - 6) || right(c_name, 3) AS masked, 'seller-' || left(sha256(CAST(c_custkey AS VARCHAR)), 10) AS alias FROM customer",
    "safe_filenames": "WITH n AS (SELECT p_partkey, 'a_b_' || p_name || '_.txt' AS s FROM part) SELECT p_partkey, CASE WHEN length(s) <= 20 THEN s ELSE left(s, length(s) - 4)[1:16] || '.txt' END AS name FROM n",
    "quality_profile": """
WITH q AS (SELECT sum((doc_id IS NOT NULL)::INT + (coalesce(text, '') <> '')::INT + (coalesce(lang, '') <> '')::INT + (coalesce(source, '') <> '')::INT + (n_chars IS NOT NULL)::INT) / (5 * count(*)) AS c,
count(DISTINCT text) / count(*) AS u FROM documents)
SELECT round(c, 6) AS completeness, round(u, 6) AS uniqueness, round(0.25::DOUBLE * c + 0.3::DOUBLE * 0.8 + 0.2::DOUBLE * 0.9 + 0.15 + 0.1::DOUBLE * u, 6) AS quality FROM q""",
    "similar_pairs_jaccard": f"""
WITH b AS {_SHINGLES.format('item_id', 'benchmark')}, d AS {_SHINGLES.format('doc_id', 'documents')},
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM d), y AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM b)
SELECT doc_id, item_id, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS jaccard FROM x JOIN y USING (g) GROUP BY 1, 2""",
    "chunk_text_stats": "SELECT round(avg(length(text)), 4) AS mean, round(stddev_samp(length(text)), 4) AS std, min(length(text)) AS least, max(length(text)) AS most FROM documents",
}
