"""The registered queries of this subpackage: thin digests over the operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extract, importance_resampling, kneser_ney, maxscore, ngram_join, packing, periodic_runs, plane_format, quality_classifier, quality_rules, toxicity, url_filter
from .common import WORD_BREAK, crc_remainder, table


def tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.scored(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit(url_filter.seed_urls(spark))
    return model.judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op8_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = plane_format.write_tokens(table(spark, sf_dir, "documents"), tokenizer(), end_id=2)
    return plane_format.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer()).drop("ids")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.held_out_scores(table(spark, sf_dir, "documents"), crc_remainder(F.col("doc_id"), 10) == 0)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_remainder(F.col("doc_id"), 4) == 2
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality_classifier.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts (by a hash h of the id, h % 10 = 0) go on from some word with repetitions
    of a period: word i >= a becomes word a + (i - a) % p. A null id leaves its text as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", WORD_BREAK), "")
    cut = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumns({"g": F.floor(h / 10), "words": F.when(h % 10 == 0, words)})
    n = F.size("words")
    a = F.when(n > 0, (F.col("g") % n).cast("int"))
    placed = cut.withColumn("a", a).withColumn("p", F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("int") + 1)
    left = n - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), left)), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("best.less"), F.col("best.period")
    return out.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_kneser_ney": op1_kneser_ney,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_toxicity": op6_toxicity,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op7_quality_rules": op7_quality_rules,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_url_filter": op10_url_filter,
    "op2_html_extraction": op2_html_extraction,
    "op8_plane_tokens": op8_plane_tokens,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op11_maxscore_topk": op11_maxscore_topk,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL = {
    "op7_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
w AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 6, 1))) AS i, ws FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda x: x = upper(x) AND x <> lower(x)))::BIGINT AS n_caps_words,
    len(regexp_extract_all(t, '!'))::BIGINT AS n_exclaims,
    coalesce(len(list_filter(range(1, len(ws)), lambda j: ws[j] = ws[j + 1])), 0)::BIGINT AS n_same_next
    FROM d LEFT JOIN c USING (doc_id)),
f AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 2 * n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 16 ELSE 0 END
    + CASE WHEN n_words > 0 AND 2 * n_caps_words > n_words THEN 32 ELSE 0 END + CASE WHEN 4 * n_exclaims > n_words THEN 64 ELSE 0 END
    + CASE WHEN 4 * n_same_next > n_words THEN 128 ELSE 0 END)::BIGINT AS failures FROM m)
SELECT *, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept FROM f
""",
    "op11_maxscore_topk": """
WITH v AS (SELECT row_number() OVER () AS at, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.at AS query_at, q.vec_id AS query_id, v.vec_id,
    coalesce(list_sum(list_transform(range(1, least(len(q.w), len(v.w)) + 1), lambda i: q.w[i] * v.w[i])), 0)::BIGINT AS score
    FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.at <> v.at)
SELECT query_id, row_number() OVER (PARTITION BY query_at ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 10
""",
    "op13_importance_resampling": r"""
WITH RECURSIVE r(i, c, k) AS (SELECT x, x, 0 FROM (SELECT unnest(range(256))::BIGINT AS x)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM r WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM r WHERE k = 8),
f AS (SELECT 0 AS src, row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
    UNION ALL SELECT 1, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
w AS (SELECT src, row_no, unnest(ws) AS word FROM f),
h AS (SELECT word, list_transform(range(1, len(hx), 2), lambda i: ('0x' || hx[i:i + 1])::BIGINT) AS bytes FROM (SELECT word, hex(word) AS hx FROM w GROUP BY word)),
b AS (SELECT word, xor(list_reduce([4294967295] || bytes, lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, tab),
n AS (SELECT src, row_no, bucket FROM w JOIN b USING (word)),
c AS (SELECT bucket, count_if(src = 0) AS s, count_if(src = 1) AS t FROM n GROUP BY 1),
a AS (SELECT sum(s)::BIGINT AS all_s, sum(t)::BIGINT AS all_t FROM c),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + 10000))::DOUBLE / ((s + 1) * (all_t + 10000))::DOUBLE))::BIGINT AS gain FROM c, a),
m AS (SELECT row_no, sum(gain)::BIGINT AS total FROM n JOIN g USING (bucket) WHERE src = 0 GROUP BY 1),
d AS (SELECT row_no, doc_id, len(ws)::BIGINT AS n_features, CASE WHEN len(ws) = 0 THEN 0 ELSE floor(total::DOUBLE / len(ws)) END::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS u FROM f LEFT JOIN m USING (row_no) WHERE src = 0),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END::BIGINT AS rank FROM o
""",
}
