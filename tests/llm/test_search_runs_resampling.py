"""Exact search, periodic runs and importance resampling, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeweave.llm import importance_resampling, maxscore, periodic_runs
from lakeweave.llm.queries import QUERIES, with_planted_runs

# exact top-k search


def search_by_hand(rows, k):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(kept):
        if i % 100 == 0:
            scored = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=False)))), j) for other, (j, v) in enumerate(kept) if other != at)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def searched(spark, rows, k=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"shard": F.lit("x"), "query_id": F.lit(0), "lane": F.lit(None)})
    return sorted(tuple(r) for r in maxscore.search(df, F.col("vec_id") % 100 == 0, k).collect())


def vectors(seed, n, dims, hot=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    rows = [(i, (centres[i % 5] + rng.normal(size=dims)).tolist()) for i in range(n)]
    same = rng.normal(size=dims).tolist()
    return [(i, same if i % 3 == 0 and i < hot else v) for i, v in rows]


@pytest.mark.parametrize("cells", [64, 1 << 19])
def test_search_matches_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(maxscore, "SHARD_CELLS", cells * 8)
    monkeypatch.setattr(maxscore, "BLOCK_CELLS", cells)
    monkeypatch.setattr(maxscore, "PASS_BYTES", cells * 8)
    rows = vectors(3, 700, 16, hot=400)
    rows += [(700, [1.5] * 16), (700, [1.5] * 16), (800, [0.0] * 16), (801, [])]
    assert searched(spark, rows) == search_by_hand([(i, None if v is None else np.float32(v).tolist()) for i, v in rows], 10)


def test_search_on_odd_rows(spark):
    rows = [(0, [0.5, -0.5]), (100, [0.5, 0.25, 1.0]), (200, None), (300, [1.0, None]), (400, [1.0, math.nan]), (500, [math.inf, 1.0]), (None, [1.0, 1.0]),
            (600, []), (1, [0.5, -0.5]), (2, [3e30, 1.0]), (700, [3e30, -2e30]), (-100, [-1.0])]
    assert searched(spark, rows, 3) == search_by_hand([(i, None if v is None else np.array(v, np.float32).tolist()) if v is None or None not in v else (i, v) for i, v in rows], 3)
    assert searched(spark, []) == []
    assert searched(spark, [(1, [1.0])]) == []
    assert searched(spark, [(100, [1.0])]) == []


def test_terms_under_the_floor_are_not_traversed():
    rows, weights = np.array([[9.0, 0.0, 1.0], [0.0, 4.0, 0.0], [1.0, 1.0, 1.0]]), np.array([1.0, 1.0, 1.0])
    order, reach = np.array([2, 1, 0]), np.array([1.0, 5.0, 14.0])
    alive, scores = maxscore.competitive(weights, rows, order, reach, 6)
    assert alive.tolist() == [0] and scores.tolist() == [10.0]
    assert maxscore.competitive(weights, rows, order, reach, 15) is None
    poisoned = rows.copy()
    poisoned[1:, 1:] = np.nan  # postings of non-essential terms are read for competitive vectors alone
    assert maxscore.competitive(weights, poisoned, order, reach, 6)[1].tolist() == [10.0]


# periodic runs


def runs_by_hand(words, shortest=12):
    """Every maximal stretch of each period by direct comparison; of one stretch the smallest period."""
    n, least = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, 2 * q):
                least.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((i, j - i, q) for (i, j), q in least.items()), key=lambda r: (r[0], r[2]))


def collapsed_by_hand(words, runs):
    gone = {k for start, length, q in runs for k in range(start + q, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 6)), max_size=8), st.sampled_from([4, 5, 12]))
def test_runs_match_brute_force(parts, shortest):
    words = [w.encode() for part, times in parts for w in part * times]
    assert periodic_runs.word_runs(words, shortest) == runs_by_hand(words, shortest)


def test_runs_of_special_words():
    a, b = ["a"], ["b"]
    while len(b) < 400:  # a Fibonacci word has the most runs
        a, b = b, b + a
    for words in (b, ["x"] * 1000, [str(i) for i in range(500)] * 2, [str(i % 7) for i in range(300)] + ["y"] + [str(i % 14) for i in range(300)]):
        assert periodic_runs.word_runs([w.encode() for w in words]) == runs_by_hand(words)


def test_repeated_passages_that_are_no_runs_are_masked_or_searched():
    passage = [f"p{i}" for i in range(40)]
    words = [w.encode() for w in [f"u{i}" for i in range(30)] + passage + [f"v{i}" for i in range(60)] + passage]
    assert periodic_runs.unmasked(words, 12) == [(30, 70), (130, 170)]
    assert periodic_runs.word_runs(words) == []
    assert periodic_runs.least_overlap(12) == min(max(12, 2 * q) - q for q in range(1, 50))
    assert periodic_runs.least_overlap(5) == min(max(5, 2 * q) - q for q in range(1, 50))


def texts_with_runs():
    rng = random.Random(8)
    texts = [None, "", " \n\t ", "one", "a b c", "x " * 4000, "é ß 同 " * 30, "Tail \u00a0 kept\x0bwhole\x0c" * 15]
    for _ in range(150):
        part = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 15))]
        texts.append(rng.choice([" ", "  ", "\n"]).join([rng.choice("xyz") for _ in range(rng.randrange(30))] + part * rng.randrange(1, 5) + [rng.choice("xyz") for _ in range(rng.randrange(20))]))
    return texts + texts[-3:]


def test_periodic_runs_query_matches_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts_with_runs())] + [(None, "a b " * 12), (7, "again " * 14), (-30, "w " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "words": F.lit("x"), "a": F.lit(2)}).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = runs_by_hand(words)
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(runs), start, length, period, runs and 1000 * length // period or None, digest("".join(f"{s},{x},{q}\n" for s, x, q in runs)), digest(collapsed_by_hand(words, runs))))
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for _, t in got.dtypes} == {"bigint", "string"}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert with_planted_runs(spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)).count() == 0


def test_collapsed_documents_keep_columns_and_texts_without_runs(spark):
    docs = spark.createDataFrame([(1, "kept  as\nis", "s"), (2, "p q " * 8 + "end", None), (None, None, "t")], "doc_id long, text string, runs string")
    out = periodic_runs.collapsed_documents(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "kept  as\nis", "s"), (2, "p q end", None), (None, None, "t")], key=repr)
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


# importance resampling


def resampled_by_hand(docs, target, longest=1, least=20, seed=2024):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    s, t = Counter(b for _, x in docs for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    rows = []
    for at, (doc_id, text) in enumerate(docs):
        n_words, found = features(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((at, doc_id, n_words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[2] >= least), key=lambda r: (-r[5], r[1] is None, r[1] or 0))
    rank = {r[0]: k for k, r in enumerate(able[: 10 * len(able) // 100], 1)}
    return sorted([(r[1], r[3], r[4], r[5], rank.get(r[0])) for r in rows], key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["Der", "the", "of", "ÉTÉ", "x9", "don't", "日本語", "A-b", "zig", "zag"]) for _ in range(rng.randrange(60))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(n, None), (n + 1, ""), (None, "some words " * 12), (None, "some words " * 12), (3, "many " * 5000), (5, "!!! --- \n")]


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_matches_brute_force(spark, longest):
    rows, target = corpus(4, 300), ["the of THE été", "Zig zag zig", None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"buckets": F.lit("x"), "rank": F.lit(0), "score": F.lit(None)})
    got = importance_resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert sorted(map(tuple, got.collect()), key=repr) == resampled_by_hand(rows, target, longest)


def test_resampling_of_empty_tables_and_short_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, "c " * 30)], "doc_id long, text string")
    assert importance_resampling.resample(none, some.select("text")).count() == 0
    assert sorted(map(tuple, importance_resampling.resample(some, none.select("text")).collect()), key=repr) == resampled_by_hand([(1, "a b"), (2, "c " * 30)], [])


def test_equal_scores_are_drawn_by_id(spark, monkeypatch):
    monkeypatch.setattr(importance_resampling, "noise", lambda doc_id, seed: F.lit(0).cast("long"))
    docs = spark.range(100, 0, -1).select(F.col("id").alias("doc_id"), F.lit("w " * 25).alias("text")).repartition(7)
    got = importance_resampling.resample(docs, docs.select("text")).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [(r["doc_id"], r["rank"]) for r in got] == [(k, k) for k in range(1, 11)]
    assert importance_resampling.drawn_documents(docs, docs.select("text")).count() == 10
