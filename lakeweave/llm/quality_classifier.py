"""Quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled documents of quality 1; unlabelled ones are documents without a label row. The class
prior is estimated first: a plain positive-against-unlabelled model orders held-back rows, and the prior is the lowest
ratio of the two shares above a threshold (best bin). Then a small network minimises
``prior * R+(P) + max(0, R-(U) - prior * R-(P))`` with logistic losses, so its output is a probability of quality 1.

Inputs are surface measures of the whole text (character classes, repetition, line and word shapes, each over the text
and at its worst window), never labels, language, source or id. The fit takes at most ``per_side`` rows of each side,
in hash order of their ids; scoring covers every row. Null texts are empty; every row gets a score. Without positives
or unlabelled rows each score is the prior (0.5 if that is unknown too).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, tidied
from .kneser_ney import tokens

CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "symbol": b"#*$%&<>", "bar": b"|", "mark": b"!", "stop": b".,;:?", "space": b" \t\n\x0b\f\r"}
WINDOWED = ("upper", "symbol", "bar", "mark")
BYTES, STEP, WORDS = 256, 64, 32
#: Text bytes measured at once: the arrays over them are many times as large, and Spark keeps the workers' memory beside the JVM.
PIECE = 1 << 20
_CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _k, _chars in enumerate(CLASSES.values()):
    _CLASS_OF[list(_chars)] = _k


def _worst(flags: np.ndarray, at: np.ndarray, n: np.ndarray, size: int, step: int) -> np.ndarray:
    """Of each text: the largest share of set flags in a window of ``size``, at every ``step`` places."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    number = np.maximum((n + step - 1) // step, 1)
    first = np.repeat(at - step * (np.cumsum(number) - number), number) + step * np.arange(int(number.sum()))
    stop = np.minimum(first + size, np.repeat(at + n, number))
    share = (total[stop] - total[np.minimum(first, stop)]) / size
    return np.maximum.reduceat(share, np.cumsum(number) - number)


def features(texts: list[bytes | None]) -> np.ndarray:
    """A row of measures for each text; ``PIECE`` bytes are worked on at a time, or one longer text."""
    texts = [t or b"" for t in texts]
    piece = np.cumsum([len(t) for t in texts]) // PIECE  # a text is in the piece in which it ends
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(texts)] if texts else []
    return np.concatenate([np.zeros((0, N_FEATURES)), *(_measures(texts[a:b]) for a, b in itertools.pairwise(cuts))])


def _measures(texts: list[bytes]) -> np.ndarray:
    n = np.array([len(t) + 1 for t in texts])  # one closing space each, so that no text is empty
    kinds = _CLASS_OF[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    at = np.cumsum(n) - n
    columns = [np.log(n)]
    for k, name in enumerate([*CLASSES, "other"]):
        flags = kinds == k
        columns.append(np.add.reduceat(flags, at, dtype=np.int64) / n)
        if name in WINDOWED:
            columns.append(_worst(flags, at, n, BYTES, STEP))
    v, w, m = tokens(texts)
    first = np.cumsum(m) - m
    same = v == w
    columns += [np.log(m), n / m, np.add.reduceat(same, first, dtype=np.int64) / m, _worst(same, first, m, WORDS, WORDS // 4)]
    doc = np.repeat(np.arange(len(m)), m)
    order = np.lexsort((w, doc))
    new = np.concatenate(([True], (w[order][1:] != w[order][:-1]) | (doc[order][1:] != doc[order][:-1])))
    columns.append(np.add.reduceat(new, first, dtype=np.int64) / m)
    again = np.zeros(len(w), bool)  # words that stood among the last four
    for back in (1, 2, 3, 4):
        again[back:] |= (w[back:] == w[:-back]) & (doc[back:] == doc[:-back])
    columns += [np.add.reduceat(again, first, dtype=np.int64) / m, _worst(again, first, m, WORDS, WORDS // 4)]
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    columns.append(np.array([1 - len(set(x)) / len(x) if x else 0.0 for x in lines]))
    columns.append(np.array([np.log1p(len(x)) for x in lines]))
    return np.column_stack(columns)


N_FEATURES = 1 + len(CLASSES) + 1 + len(WINDOWED) + 4 + 1 + 2 + 2


@dataclass
class Network:
    """One hidden layer; ``__call__`` gives log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z, np.tanh(z @ self.weights[0] + self.weights[1])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x)[1] @ self.weights[2] + self.weights[3]


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def fit_network(p: np.ndarray, u: np.ndarray, prior: float | None, epochs: int = 120, hidden: int = 24, seed: int = 5) -> Network:
    """Minimises the non-negative risk for ``prior``; with no prior, the plain loss of P against U."""
    rng = np.random.default_rng(seed)
    both = np.concatenate((p, u))
    net = Network(both.mean(axis=0), both.std(axis=0) + 1e-6, [rng.normal(0, 0.3, (both.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)])
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in net.weights]
    steps, t = max(4, (len(p) + len(u)) // 1024), 0
    for _ in range(epochs):
        ps, us = np.array_split(rng.permutation(len(p)), steps), np.array_split(rng.permutation(len(u)), steps)
        for a, b in zip(ps, us, strict=True):
            if not len(a) or not len(b):
                continue
            x = np.concatenate((p[a], u[b]))
            z, h = net.hidden(x)
            s = _sigmoid(h @ net.weights[2] + net.weights[3])
            g = np.empty(len(x))
            if prior is None:
                g[: len(a)], g[len(a) :] = (s[: len(a)] - 1) / len(x), s[len(a) :] / len(x)
            else:
                minus = np.log1p(np.exp(np.clip(h @ net.weights[2] + net.weights[3], -30, 30)))
                negative = minus[len(a) :].mean() - prior * minus[: len(a)].mean()
                if negative < 0:  # step back: this part of the risk can't be below zero
                    g[: len(a)], g[len(a) :] = prior * s[: len(a)] / len(a), -s[len(a) :] / len(b)
                else:
                    g[: len(a)] = prior * ((s[: len(a)] - 1) - s[: len(a)]) / len(a)
                    g[len(a) :] = s[len(a) :] / len(b)
            back = np.outer(g, net.weights[2]) * (1 - h * h)
            t += 1
            for k, grad in enumerate((z.T @ back, back.sum(axis=0), h.T @ g, g.sum(keepdims=True))):
                m, q = moments[k]
                m *= 0.9
                m += 0.1 * grad
                q *= 0.999
                q += 0.001 * grad * grad
                net.weights[k] -= 0.01 * ((m / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-8) + 0.05 * net.weights[k])
    return net


def _best_bin(p: np.ndarray, u: np.ndarray, seed: int) -> float:
    rng = np.random.default_rng(seed)
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    net = fit_network(p[::2], u[::2], None, epochs=40, seed=seed)
    fp, fu = np.sort(net(p[1::2])), np.sort(net(u[1::2]))
    cuts = np.quantile(fp, np.linspace(0, 0.95, 96))
    share_p = 1 - np.searchsorted(fp, cuts, side="left") / len(fp)
    share_u = 1 - np.searchsorted(fu, cuts, side="left") / len(fu)
    slack = np.sqrt(np.log(40) / (2 * len(fp))) + np.sqrt(np.log(40) / (2 * len(fu)))
    best = np.argmin((share_u + slack) / share_p)
    return share_u[best] / share_p[best]


def estimated_prior(p: np.ndarray, u: np.ndarray, splits: int = 7) -> float:
    """Share of positives among unlabelled rows: the best bin of a P-against-U order over held-back halves; median of several splits."""
    return float(np.clip(np.median([_best_bin(p, u, seed) for seed in range(splits)]), 0.05, 0.99))


@dataclass
class Model:
    network: Network | None
    prior: float

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.prior)
        return _sigmoid(self.network(features(texts)))


def fit(p: np.ndarray, u: np.ndarray) -> Model:
    if len(p) < 4 or len(u) < 4:
        return Model(None, 0.5)
    prior = estimated_prior(p, u)
    return Model(fit_network(p, u, prior), prior)


def train(docs: DataFrame, labels: DataFrame, use: Column, per_side: int = 4_000) -> Model:
    """``use``: which labelled rows may be learnt from, over the labels' columns. All other documents count as unlabelled:
    whether one of them has a label isn't looked at."""
    spark = docs.sparkSession
    small_batches(spark)
    labels = labels.where(F.coalesce(use, F.lit(False)))

    def first(ids: DataFrame) -> DataFrame:
        return ids.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_side)

    trusted = first(labels.where("quality = 1").join(docs.select("doc_id"), "doc_id", "left_semi")).withColumn("side", F.lit(1))
    unlabelled = first(docs.select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti")).withColumn("side", F.lit(0))
    ids = trusted.unionByName(unlabelled).toPandas()  # 2 * per_side rows at most
    known = spark.createDataFrame([(int(i), int(s)) for i, s in zip(ids["doc_id"], ids["side"], strict=True)], "doc_id long, side int")

    def measured(batches):
        for batch in batches:
            rows = features(batch.column("text").cast(pa.binary()).to_pylist()).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("side"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "side", "x"])

    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("doc_id", "side", "text")
    got = sample.mapInArrow(tidied(measured), "doc_id long, side int, x array<double>").toArrow().sort_by("doc_id")
    x, side = np.array(got["x"].to_pylist(), float).reshape(-1, N_FEATURES), np.array(got["side"].to_pylist(), int)
    return fit(x[side == 1], x[side == 0])


def score(docs: DataFrame, model: Model, threshold: float = 0.7, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, score and predicted for every row of ``docs``."""
    small_batches(docs.sparkSession)
    out = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for batch in batches:
            p = model.score(batch.column(len(keep)).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep, F.col("text").cast("string").alias("_text")).mapInArrow(tidied(run), out)


def kept_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with their own columns. A row goes to Python and back
    once, its text in it."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            p = model.score(batch.column(at).cast(pa.binary()).to_pylist())
            yield batch.filter(pa.array(p >= threshold, pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)
