"""Importance resampling towards a target corpus by hashed word n-grams, scored without exploding a document.

1. Higher-order functions make each document's array of buckets, written once.
2. Bucket counts of corpus and target are summed: at most ``buckets`` rows of each leave the shuffle.
3. A bucket's gain is floor(1000 ln) of its smoothed share in the target over that in the corpus. The gains are one literal
   array; a document's weight is the floored mean of the gains that an aggregate over its buckets looks up there.
4. A Gumbel noise from a hash of the id is added; the highest scores are a sample without replacement. Scores are whole
   numbers of a bounded range, so a count by score (some 100,000 rows at most) gives the score at which the draw ends.
   Documents from there on are sorted by range and numbered from the counts of the partitions before.

All of it is DataFrame functions. A null or empty text has no words, weight 0, and isn't drawn. A null id is hashed as an
empty one and comes last among equal scores. Repeated rows are documents each; an empty target, corpus or both give gains of
the smoothing alone. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Code points outside words, once A-Z are lower-cased.
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, all else as it is; empty for null."""
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BREAKS), "")


def feature_buckets(found: Column, longest: int, buckets: int) -> Column:
    """The bucket of every run of 1 to ``longest`` words (joined by one space): crc32 of its bytes, modulo ``buckets``."""

    def bucket(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % buckets).cast("int")

    def runs(n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(found) - (n - 1), F.lit(1))), lambda i: i + (n - 1) <= F.size(found))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(found, i, n), " ")))

    single = F.transform(found, bucket)
    return F.concat(single, *(runs(n) for n in range(2, longest + 1))) if longest > 1 else single


def bucketed(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """doc_id, n_words and buckets of every row, written."""
    plain = docs.select("doc_id", words(F.col("text").cast("string")).alias("words"))
    if longest > 1:
        plain = written(plain, "words")  # read by each run of a lambda: a column of a scan, not an expression
    return written(plain.select("doc_id", F.size("words").cast("long").alias("n_words"), feature_buckets(F.col("words"), longest, buckets).alias("buckets")), "buckets")


def bucket_counts(rows: DataFrame, buckets: int) -> list[int]:
    """How many features fall in each bucket."""
    out = [0] * buckets
    for row in rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect():
        out[row["bucket"]] = row["count"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln(((t + 1) (S + n)) / ((s + 1) (T + n)))) of each of the n buckets."""
    n, all_corpus, all_target = len(corpus), sum(corpus), sum(target)
    return [math.floor(1000 * math.log(float((t + 1) * (all_corpus + n)) / float((s + 1) * (all_target + n)))) for s, t in zip(corpus, target, strict=True)]


def weight(buckets: Column, gain: list[int]) -> Column:
    """The floored mean of the gains of an array of buckets; 0 if it is empty."""
    literal = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal
    total = F.aggregate(buckets, F.lit(0).cast("long"), lambda s, b: s + F.element_at(literal, b + 1))
    return F.floor(total / F.greatest(F.size(buckets), F.lit(1)))  # sums are far below 2**53: the double's floor is exact


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 Gumbel) drawn by the first 32 bits of a hash of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank`` (long, from 1) over a total order: sorted by range, each partition from the sum of those before."""
    held = written(rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    sizes = held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row for each partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before"))
    placed = held.withColumn("part", part).join(F.broadcast(starts), "part")
    return placed.withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("at", "part", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank (all but the id long) of every row of ``docs``.

    Of the N documents of at least ``least_words`` words, the floor(``percent`` N / 100) of the highest scores are drawn and
    ranked; other rows have a null rank.
    """
    held = bucketed(docs, longest, buckets)
    wanted = target.select(feature_buckets(words(F.col("text").cast("string")), 1, buckets).alias("buckets")) if longest == 1 else bucketed(target.withColumn("doc_id", F.lit(None).cast("long")), longest, buckets)
    gain = gains(bucket_counts(held, buckets), bucket_counts(wanted, buckets))
    weighed = held.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight(F.col("buckets"), gain).alias("weight"))
    scored = written(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")

    able = F.col("n_words") >= least_words
    counts = sorted(((r["score"], r["count"]) for r in scored.where(able).groupBy("score").count().collect()), reverse=True)
    draw, cut, above = percent * sum(n for _, n in counts) // 100, None, 0
    for score, n in counts:
        if above >= draw:
            break
        cut, above = score, above + n
    none = F.lit(None).cast("long")
    if cut is None:
        return scored.select("doc_id", "n_features", "weight", "score", none.alias("rank"))
    near = able & (F.col("score") >= cut)
    ranked = numbered(scored.where(near), F.desc("score"), F.asc_nulls_last("doc_id"))
    drawn = ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.where(~near).select("doc_id", "n_features", "weight", "score", none.alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all columns; ids must be unique and not null for this."""
    drawn = resample(docs, target, **how).where("rank IS NOT NULL").select("doc_id")
    return docs.join(drawn, "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
