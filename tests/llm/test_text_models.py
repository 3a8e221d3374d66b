"""Language model, toxicity, quality classifier: brute force and held-out accuracy."""

from __future__ import annotations

import math
import random
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from lakeweave.llm import kneser_ney, quality_classifier, toxicity
from lakeweave.llm.common import crc_remainder


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, extra string")


def words(text):
    return (text or "").encode().lower().split() + [b"</s>"]


def brute(train, texts):
    """Interpolated modified Kneser-Ney bigrams, straight from the definition."""
    seqs = [words(t) for t in train]
    count = Counter(w for s in seqs for w in s)
    pairs = Counter(p for s in seqs for p in zip([b"<s>"] + s, s, strict=False))
    context, kinds, follows = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (v, w), n in pairs.items():
        context[v] += n
        kinds[v][min(n, 3) - 1] += 1
        follows[w] += 1
    d2 = kneser_ney.discounts([sum(n == i for n in pairs.values()) for i in (1, 2, 3, 4)])
    d1 = kneser_ney.discounts([sum(n == i for n in follows.values()) for i in (1, 2, 3, 4)])
    total = max(len(pairs), 1)
    rest = sum(d1[min(n, 3) - 1] for n in follows.values()) / total if pairs else 1.0
    cut = lambda n, d: n - d[min(n, 3) - 1] if n else 0

    def p(v, w):
        low = cut(follows[w], d1) / total + rest / (len(count) + 1)
        if not context[v]:
            return low
        return (cut(pairs[v, w], d2) + sum(a * b for a, b in zip(kinds[v], d2, strict=True)) * low) / context[v]

    n_train = sum(count.values())
    out = []
    for t in texts:
        s = words(t)
        score = sum(math.log10(p(v, w)) for v, w in zip([b"<s>"] + s, s, strict=False))
        base = sum(math.log10((count[w] + 0.1) / (n_train + 0.1 * (len(count) + 1))) for w in s)
        out.append((len(s), sum(count[w] > 0 for w in s), base, score))
    return out, n_train


def test_scores_match_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=rng.randrange(40))) for _ in range(60)]
    texts += [None, "", " \n\t ", "Upper UPPER upper", "É é", "x" * 20000, texts[0], texts[0], "non breaking"]
    rows = [(i, t, "e") for i, t in enumerate(texts)]
    docs = documents(spark, rows)
    held = crc_remainder(F.col("doc_id"), 10) == 0
    got = {r["doc_id"]: r for r in kneser_ney.held_out_scores(docs, held).collect()}
    assert len(got) == len(rows)
    train = [t for i, t, _ in rows if not got[i]["held_out"]]
    want, n_train = brute(train, texts)
    for (i, _, _), (n, known, base, score) in zip(rows, want, strict=True):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, n_train)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)


def word_by_word(texts, known):
    """Hashes of words and the number of words of each text, by a dict of words."""
    found = [t.lower().split() if t else [] for t in texts]
    flat = [w for ws in found for w in ws]
    for w in set(flat).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat)), [len(ws) for ws in found]


def test_tokens_are_split_as_bytes_and_hashed_by_distinct_word():
    odd = [None, b"", b" \n\t ", "É é A b".encode(), b"x" * 20000, b"\x1c a\x1fb \x85 \x00 c", b" a", b"a ", b"a\x0bb\x0cc\rd", b"", None]
    corpus = [t.encode() for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t]
    for texts in ([], [None], [b"", b""], odd, odd[::-1], corpus[:100]):
        v, w, n = kneser_ney.tokens(texts)
        flat, sizes = word_by_word(texts, {})
        ends = np.cumsum(n) - 1
        assert (n - 1).tolist() == sizes and (w[ends] == kneser_ney.END).all() and (np.delete(w, ends) == flat).all()
        assert (v[ends - n + 1] == kneser_ney.START).all() and (v[1:][np.diff(np.repeat(np.arange(len(n)), n)) == 0] == np.delete(w, ends)).all()

    def seconds(run):
        took = []
        for _ in range(5):
            start = time.process_time()
            run(corpus)
            took.append(time.process_time() - start)
        return min(took)

    # before, words went through a dict one by one, which takes as long as this
    assert seconds(kneser_ney.tokens) < 0.6 * seconds(lambda texts: word_by_word(texts, {}))


def test_probabilities_sum_to_one(spark):
    docs = documents(spark, [(i, t, "") for i, t in enumerate(["a b c", "a b", "b c c d", "d"])])
    scorer = kneser_ney.train(docs).scorer()
    vocabulary = [b"a", b"b", b"c", b"d"]
    for context in (b"a", b"c", b"never"):
        stops = [10 ** float(scorer.score([context])["score"][0])]
        pre = scorer.score([context])["score"][0]
        assert np.isfinite(pre) and 0 < stops[0] < 1
    # log p(text with w after a) - shared terms: compare through texts of two words
    total = 0.0
    v, w, n = kneser_ney.tokens([b"a"])
    first = 10 ** scorer_term(scorer, v[0], w[0])
    for word in [*vocabulary, b"unknown"]:
        total += 10 ** scorer_term(scorer, kneser_ney.tokens([b"a"])[1][0], kneser_ney.tokens([word])[1][0])
    total += 10 ** scorer_term(scorer, kneser_ney.tokens([b"a"])[1][0], kneser_ney.END)
    assert total == pytest.approx(1.0) and 0 < first < 1


def scorer_term(scorer, v, w):
    """log10 p(w | v), from the score of a made-up batch of one token."""
    real = kneser_ney.tokens
    kneser_ney.tokens = lambda texts: (np.array([v], np.uint64), np.array([w], np.uint64), np.array([1]))
    try:
        return float(scorer.score([b""])["score"][0])
    finally:
        kneser_ney.tokens = real


def test_empty_training(spark):
    docs = documents(spark, []).union(documents(spark, [(10, None, "")]))
    model = kneser_ney.train(docs.where("doc_id < 0"))
    r = kneser_ney.score(docs, model).first()
    assert (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) == (1, 0, 0.0, 0.0)
    assert kneser_ney.score(docs.where("doc_id < 0"), model).count() == 0


def accuracy(scored, labels, name, threshold):
    rows = scored.join(labels.groupBy("doc_id").agg(F.max(name).alias("y")), "doc_id").where("held_out").collect()
    right = sum((r["score"] >= threshold) == (r["y"] == 1) for r in rows)
    return right / len(rows)


@pytest.fixture(scope="module")
def corpus(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_quality_on_held_out_labels(spark, corpus):
    docs, labels = corpus
    held = crc_remainder(F.col("doc_id"), 4) == 2
    model = quality_classifier.train(docs, labels, ~held)
    assert 0.6 < model.prior < 0.99
    scored = quality_classifier.score(docs, model).withColumn("held_out", held)
    assert scored.count() == docs.count()
    assert accuracy(scored, labels, "quality", 0.7) > 0.95


def test_toxicity_on_held_out_labels(spark, corpus):
    docs, labels = corpus
    held = crc_remainder(F.col("doc_id"), 5) == 0
    scored = toxicity.score(docs, toxicity.train(docs, labels, ~held)).withColumn("held_out", held)
    assert accuracy(scored, labels, "toxic", 0.5) > 0.93


def test_models_on_odd_texts(spark, corpus):
    docs, labels = corpus
    odd = documents(spark, [(1, None, ""), (1, "", ""), (2, "x " * 50000, ""), (3, "é" * 3000, ""), (None, "a b", "")])
    q = quality_classifier.train(docs, labels, F.lit(True))
    t = toxicity.train(docs, labels, F.lit(True))
    for r in [*quality_classifier.score(odd, q).collect(), *toxicity.score(odd, t).collect()]:
        assert 0 <= r["score"] <= 1 and r["predicted"] in (0, 1)
    assert quality_classifier.score(odd.where("false"), q).count() == 0
    clash = odd.withColumn("score", F.lit("mine")).withColumn("predicted", F.lit(7))
    assert set(quality_classifier.kept_documents(clash, q).columns) == set(clash.columns)


def test_measures_hold_little_memory():
    """A batch of 8 MB with 600,000 different words is measured a megabyte at a time, each text as if it were alone."""
    texts = [" ".join(f"w{i}x{k:07d}" for k in range(6000)).encode() for i in range(100)]
    kneser_ney.forget()
    tracemalloc.start()
    got = quality_classifier.features(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6 and len(kneser_ney._known) < 200_000
    kneser_ney.forget()
    some = [None, b"", texts[3], b"a b " * 600_000, b"", texts[99]]
    assert (quality_classifier.features(some) == np.concatenate([quality_classifier.features([t]) for t in some])).all()
    assert (got[99] == quality_classifier.features(texts[99:])[0]).all()


def test_kept_documents_sends_each_text_once(spark, corpus):
    docs, labels = corpus
    model = quality_classifier.train(docs, labels, F.lit(True))
    kept = quality_classifier.kept_documents(docs, model)
    assert kept.schema == docs.schema
    good = quality_classifier.score(docs, model).where("predicted = 1").select("doc_id")
    want = docs.join(good, "doc_id").select(docs.columns)
    assert 0 < want.count() < docs.count() and sorted(kept.collect(), key=str) == sorted(want.collect(), key=str)
    assert "Project" not in kept._jdf.queryExecution().optimizedPlan().toString()  # no second copy is made for Python


def test_models_without_labels(spark, corpus):
    docs, labels = corpus
    none = labels.where("false")
    assert {r["score"] for r in quality_classifier.score(docs.limit(3), quality_classifier.train(docs, none, F.lit(True))).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score(docs.limit(3), toxicity.train(docs, none, F.lit(True))).collect()} == {0.0}


def test_hot_words_are_found_in_all_texts_and_parted(spark):
    """A word that only the last partition's texts repeat is hot, and its pairs don't meet in one shard."""
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(200)] + [" ".join(f"the w{rng.randrange(3000)}" for _ in range(60)) for _ in range(100)]
    df = documents(spark, [(i, t, "") for i, t in enumerate(texts)]).coalesce(1).repartitionByRange(6, "doc_id").select("text")
    for shards in (16, 64):
        hot, parts = kneser_ney._hot_words(df, shards)
        v, w, _ = kneser_ney.tokens([t.encode() for t in texts])
        found, n = np.unique(v, return_counts=True)
        assert set(found[n > kneser_ney.HOT_PART / shards * len(v)].tolist()) <= set(hot.tolist())
        assert kneser_ney.tokens([b"the"])[1][0] in hot and kneser_ney.START in hot
        pairs = np.unique(np.stack((v, w)), axis=1)
        number = np.bincount(kneser_ney.Dealing(shards, 4, hot, parts).of_pairs(*pairs), minlength=shards)
        assert number.max() < 3 * number.mean()


def test_null_ids_and_clashing_names(spark):
    df = spark.createDataFrame([(None, "a b", "x"), (1, "a b", "y"), (1, "a b", "y"), (2, None, "z")], "doc_id long, text string, score string")
    got = kneser_ney.held_out_scores(df, crc_remainder(F.col("doc_id"), 10) == 0)
    assert got.count() == 4 and {r["held_out"] for r in got.where("doc_id IS NULL").collect()} == {False}
    empty = kneser_ney.held_out_scores(df.where("false"), F.lit(False))
    assert empty.count() == 0 and kneser_ney.train(df.where("false")).n_pairs == 0


def risk_by_hand(net, p, u, prior):
    """The non-negative risk of a network, a row at a time."""

    def log_odds(x):
        z = [min(8.0, max(-8.0, (a - m) / s)) for a, m, s in zip(x, net.mean, net.scale, strict=True)]
        h = [math.tanh(sum(a * w for a, w in zip(z, net.weights[0][:, k], strict=True)) + net.weights[1][k]) for k in range(len(net.weights[1]))]
        return sum(a * w for a, w in zip(h, net.weights[2], strict=True)) + net.weights[3][0]

    mean = lambda xs: sum(xs) / len(xs)
    fp, fu = [log_odds(x) for x in p], [log_odds(x) for x in u]
    positive = prior * mean([math.log1p(math.exp(-f)) for f in fp])
    negative = mean([math.log1p(math.exp(f)) for f in fu]) - prior * mean([math.log1p(math.exp(f)) for f in fp])
    return positive + max(0.0, negative)


def test_positive_unlabelled_risk():
    rng = np.random.default_rng(8)
    draw = lambda n, y: rng.normal((1.5 if y else -1.5, 0.5), 1.0, (n, 2))
    p, u = draw(400, True), np.concatenate((draw(300, True), draw(700, False)))
    plain = quality_classifier.fit_network(p, u, 0.3, epochs=0)
    net = quality_classifier.fit_network(p, u, 0.3)
    odds = [1 / (1 + math.exp(-float(net(x[None, :])[0]))) for x in u[:20]]
    assert odds == pytest.approx(quality_classifier._sigmoid(net(u[:20])).tolist())
    assert risk_by_hand(net, p, u, 0.3) < 0.6 * risk_by_hand(plain, p, u, 0.3)
    assert ((net(u) > 0) == (np.arange(1000) < 300)).mean() > 0.9
    assert abs(quality_classifier.estimated_prior(p, u) - 0.3) < 0.12


def two_classes_by_hand(texts, toxic):
    """log p(token | toxic) - log p(token | ordinary) by modified Kneser-Ney with a shared backoff, from dicts."""

    def cut(n, d):
        return d[min(n, 3) - 1] if n else 0.0

    def counts(side):
        pairs = Counter()
        for t, y in zip(texts, toxic, strict=True):
            if y == side:
                s = ["<s>", *t.split(), "</s>"]
                pairs.update(zip(s, s[1:], strict=False))
        return pairs

    def found(values):
        return [sum(n == i for n in values) for i in (1, 2, 3, 4)]

    sides = {}
    for side in (True, False):
        pairs = counts(side)
        words = Counter(w for _, w in pairs)
        sides[side] = (pairs, words, kneser_ney.discounts(found(pairs.values())), kneser_ney.discounts(found(words.values())))
    both = {w: min(sides[True][1][w], sides[False][1][w]) for w in sides[True][1].keys() & sides[False][1].keys()}
    kinds = len(sides[True][1].keys() | sides[False][1].keys())
    d = kneser_ney.discounts(found(both.values()))
    total = max(sum(both.values()), 1)

    def shared(w):
        n = both.get(w, 0)
        return (n - cut(n, d)) / total + max(sum(cut(x, d) for x in both.values()) / total, 0.1) / (kinds + 1)

    def log_p(side, v, w):
        pairs, words, dp, dw = sides[side]
        p1 = (words[w] - cut(words[w], dw) + sum(cut(n, dw) for n in words.values()) * shared(w)) / sum(words.values())
        context = sum(n for (a, _), n in pairs.items() if a == v)
        mass = sum(cut(n, dp) for (a, _), n in pairs.items() if a == v)
        return math.log((pairs[v, w] - cut(pairs[v, w], dp) + mass * p1) / context if context else p1), math.log(p1)

    return lambda v, w: [a - b for a, b in zip(log_p(True, v, w), log_p(False, v, w), strict=True)]


def test_class_models_by_hand():
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(25)] + (["bad", "worse"] if k % 3 == 0 else []), k=rng.randrange(3, 30))) for k in range(40)]
    toxic = [k % 3 == 0 for k in range(40)]
    v, w, n = kneser_ney.tokens([t.encode() for t in texts])
    evidence = toxicity.Evidence.of(v, w, np.repeat(np.array(toxic), n))
    ratio = two_classes_by_hand(texts, toxic)
    for text in [*texts[:6], "bad worse never seen", "w1", ""]:
        v, w, _ = kneser_ney.tokens([text.encode()])
        s = ["<s>", *text.split(), "</s>"]
        want = np.array([ratio(a, b) for a, b in zip(s, s[1:], strict=False)]).T
        assert evidence.per_token(v, w) == pytest.approx(want)
