"""Toxicity by class-conditional Kneser-Ney models with shared backoff.

Two bigram models, of toxic and of ordinary labelled texts, are discounted alike and back off, through class unigrams,
to one continuation distribution over the counts that both share (the lesser of the two classes' numbers of different
words before a word): a rare expression of one class weighs little, one that neither has seen weighs nothing. A text's
evidence is the difference of the two log-likelihoods, normalised by length over the whole text and over windows, so
that a short passage in a long text counts. A logistic fit turns the evidence into a probability; its inputs are
out-of-fold, so that texts aren't scored with their own counts.

The models are fitted on at most ``per_class`` labelled texts of each class, taken in hash order of their ids; the
share of toxic rows is counted over all labelled rows. Null texts are empty; every row gets a score. A document that
has several label rows is toxic if one of them says so. Without labels of both classes every score is that share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidied
from .kneser_ney import START, discounts, pair_hash, tokens

WINDOWS = (4, 16, 64)
LEVELS = (1.0, 2.0, 3.0, 4.0, 5.0, 6.0)
N_FEATURES = 2 * (2 + len(WINDOWS) + len(LEVELS))


def _table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(keys, return_counts=True)
    return found, n.astype(np.float64)


def _get(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    found, n = table
    if not len(found):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(found, keys), len(found) - 1)
    return np.where(found[at] == keys, n[at], 0.0)


def _counts_of(n: np.ndarray) -> list[int]:
    return [int((n == i).sum()) for i in (1, 2, 3, 4)]


def _cut(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3).astype(np.int64)]


@dataclass
class ClassModel:
    """Counts of one class: pairs, contexts (with their discount mass), words."""

    pairs: tuple[np.ndarray, np.ndarray]
    contexts: tuple[np.ndarray, np.ndarray]
    mass: tuple[np.ndarray, np.ndarray]
    words: tuple[np.ndarray, np.ndarray]
    d_pairs: tuple[float, float, float]
    d_words: tuple[float, float, float]
    n_words: float
    word_mass: float

    @classmethod
    def of(cls, v: np.ndarray, w: np.ndarray) -> ClassModel:
        pairs, first, n = np.unique(pair_hash(v, w), return_index=True, return_counts=True)
        n = n.astype(np.float64)
        d = discounts(_counts_of(n))
        contexts, inverse = np.unique(v[first], return_inverse=True)
        words = _table(w[first])  # different words before each
        dw = discounts(_counts_of(words[1]))
        return cls(
            (pairs, n),
            (contexts, np.bincount(inverse, n, len(contexts))),
            (contexts, np.bincount(inverse, _cut(n, d), len(contexts))),
            words,
            d,
            dw,
            float(words[1].sum()),
            float(_cut(words[1], dw).sum()),
        )

    def log_p(self, key: np.ndarray, v: np.ndarray, w: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By pair, and by word alone."""
        n = _get(self.words, w)
        total = max(self.n_words, 1.0)
        p1 = (n - _cut(n, self.d_words) + (self.word_mass if self.n_words else 1.0) * shared) / total
        n, context = _get(self.pairs, key), _get(self.contexts, v)
        return np.log(np.where(context > 0, (n - _cut(n, self.d_pairs) + _get(self.mass, v) * p1) / np.maximum(context, 1.0), p1)), np.log(p1)


@dataclass
class Evidence:
    """Both classes and the continuation counts that they share."""

    toxic: ClassModel
    ordinary: ClassModel
    follows: tuple[np.ndarray, np.ndarray]
    d_follows: tuple[float, float, float]
    n_kinds: int

    @classmethod
    def of(cls, v: np.ndarray, w: np.ndarray, toxic: np.ndarray) -> Evidence:
        sides = []
        for rows in (toxic, ~toxic):
            _, first = np.unique(pair_hash(v[rows], w[rows]), return_index=True)
            sides.append(_table(w[rows][first]))
        both = np.intersect1d(sides[0][0], sides[1][0])
        follows = (both, np.minimum(_get(sides[0], both), _get(sides[1], both)))
        return cls(ClassModel.of(v[toxic], w[toxic]), ClassModel.of(v[~toxic], w[~toxic]), follows, discounts(_counts_of(follows[1])), len(np.union1d(sides[0][0], sides[1][0])))

    def shared(self, w: np.ndarray) -> np.ndarray:
        n, total = _get(self.follows, w), max(self.follows[1].sum(), 1.0)
        rest = _cut(self.follows[1], self.d_follows).sum() / total
        return (n - _cut(n, self.d_follows)) / total + max(rest, 0.1) / (self.n_kinds + 1)

    def per_token(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log p(token | toxic) - log p(token | ordinary), by pair and by word alone (two rows)."""
        key, first, back = np.unique(pair_hash(v, w), return_index=True, return_inverse=True)
        v, w = v[first], w[first]
        shared = self.shared(w)
        return np.subtract(self.toxic.log_p(key, v, w, shared), self.ordinary.log_p(key, v, w, shared))[:, back]


def features(ratios: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each text, for pairs and for words alone: mean ratio over all tokens, the largest, and the largest mean over windows."""
    at = np.cumsum(n) - n
    ends = np.repeat(at + n, n)
    here = np.arange(ratios.shape[1])
    out = []
    for ratio in ratios:
        total = np.concatenate(([0.0], np.cumsum(ratio)))
        out += [np.add.reduceat(ratio, at) / n, np.maximum.reduceat(ratio, at)]
        out += [np.maximum.reduceat((total[np.minimum(here + size, ends)] - total[here]) / size, at) for size in WINDOWS]
        # number of tokens at each strength of evidence
        out += [np.log1p(np.add.reduceat((ratio > level).astype(np.float64), at)) for level in LEVELS]
    return np.column_stack(out)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted logistic regression by Newton steps on standardised inputs: (mean, scale, coefficients with the constant last)."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    b = np.zeros(z.shape[1])
    ridge = np.full(len(b), penalty)
    ridge[-1] = 1e-9
    weight = weight / weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (weight * (p - y)) + ridge * b)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, b


@dataclass
class Model:
    evidence: Evidence | None
    fit: tuple[np.ndarray, np.ndarray, np.ndarray] | None
    share: float

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self.evidence is None or not texts:
            return np.full(len(texts), self.share)
        v, w, n = tokens(texts)
        x = features(self.evidence.per_token(v, w), n)
        mean, scale, b = self.fit
        return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ b[:-1] + b[-1], -30, 30)))


def fit(hashed: list[np.ndarray], toxic: np.ndarray, share: float, folds: int = 5) -> Model:
    """``hashed``: token hashes of each labelled text, the end included."""
    if not len(hashed) or toxic.all() or not toxic.any():
        return Model(None, None, share)
    n = np.array([len(t) for t in hashed])
    w = np.concatenate(hashed)
    v = np.concatenate(([START], w[:-1]))
    v[np.cumsum(n) - n] = START
    per_token = np.repeat(toxic, n)
    fold = np.empty(len(n), np.int64)
    for kind in (True, False):  # each class evenly over the folds
        rows = np.flatnonzero(toxic == kind)
        fold[rows] = np.arange(len(rows)) % folds
    token_fold = np.repeat(fold, n)
    x = np.empty((len(n), N_FEATURES))
    for k in range(folds):
        rest, mine = token_fold != k, token_fold == k
        if mine.any():
            x[fold == k] = features(Evidence.of(v[rest], w[rest], per_token[rest]).per_token(v[mine], w[mine]), n[fold == k])
    weight = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    return Model(Evidence.of(v, w, per_token), logistic(x, toxic.astype(float), weight), share)


def labelled_sample(docs: DataFrame, labels: DataFrame, kind: str, use: Column, per_class: int) -> tuple[DataFrame, float]:
    """At most ``per_class`` documents of each value of a 0/1 label (doc_id, text, y), and the share of ones over all."""
    rows = labels.where(F.col(kind).isNotNull() & use).groupBy("doc_id").agg(F.max(kind).alias("y"))
    rows = rows.join(docs.select("doc_id"), "doc_id", "left_semi")
    counted = rows.agg(F.avg(F.col("y").cast("double"))).first()[0]
    chosen = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = chosen.toPandas()  # 2 * per_class rows at most
    known = docs.sparkSession.createDataFrame(ids, "doc_id long, y int") if len(ids) else rows.limit(0).select("doc_id", F.col("y").cast("int").alias("y"))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), 0.0 if counted is None else float(counted)


def train(docs: DataFrame, labels: DataFrame, use: Column, per_class: int = 3_000) -> Model:
    """``use``: which labelled rows may be learnt from, over the labels' columns."""
    small_batches(docs.sparkSession)
    sample, share = labelled_sample(docs, labels, "toxic", use, per_class)

    def hashed(batches):
        for batch in batches:
            _, w, n = tokens(batch.column("text").cast(pa.binary()).to_pylist()) if batch.num_rows else (None, np.zeros(0, np.uint64), np.zeros(0, np.int64))
            parts = [p.tobytes() for p in np.split(w, np.cumsum(n)[:-1])] if len(n) else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(parts, pa.binary())], names=["doc_id", "y", "w"])

    got = sample.select("doc_id", "text", "y").mapInArrow(tidied(hashed), "doc_id long, y int, w binary").toArrow().sort_by("doc_id")
    return fit([np.frombuffer(b, np.uint64) for b in got["w"].to_pylist()], np.array(got["y"].to_pylist(), bool), share)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted for every row of ``docs``. The model is broadcast: it is bounded by the sample."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            p = sent.value.score(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(tidied(run), "doc_id long, score double, predicted int")
