"""GraphSAGE against NumPy: the forward pass on a whole graph, gradients by differences, training, stops and checkpoints."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeweave.operators import features, sage

LAYERS, HIDDEN, OUT = 3, 10, 6


@pytest.fixture(scope="module")
def graph():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 7))
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 90, (300, 2))} | {(k, 0) for k in range(60)})  # 0 is a hub
    return x, edges


@pytest.fixture(scope="module")
def tables(spark, graph):
    x, edges = graph
    nodes = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)] + [(90, None)], "id long, x array<double>")
    return nodes, spark.createDataFrame([*edges, (500, 1)], "src long, dst long")


def dense(x, edges, w, layers):
    def linear(v, n):
        return v @ w[n + ".w"] + w[n + ".b"]

    def norm(v, n):
        return (v - v.mean(1, keepdims=True)) / np.sqrt(v.var(1, keepdims=True) + 1e-5) * w[n + ".gain"] + w[n + ".shift"]

    adjacent = np.zeros((len(x), len(x)))
    for a, b in edges:
        adjacent[b, a] += 1
    adjacent /= np.maximum(adjacent.sum(1, keepdims=True), 1)
    h, every = np.maximum(norm(linear(x, "input"), "input"), 0), []
    for k in range(layers):
        z = linear(adjacent @ h, f"near{k}") + h @ w[f"own{k}.w"]
        h = np.maximum(norm(z / np.linalg.norm(z, axis=1, keepdims=True), f"norm{k}"), 0)
        every.append(h)
    return np.maximum(norm(linear(np.concatenate(every, 1), "jump"), "jump"), 0)


def projected(x, w):
    z = x @ w["out1.w"] + w["out1.b"]
    z = (z - z.mean(1, keepdims=True)) / np.sqrt(z.var(1, keepdims=True) + 1e-5) * w["out1.gain"] + w["out1.shift"]
    return np.maximum(z, 0) @ w["out2.w"] + w["out2.b"]


def test_forward_equals_numpy(graph, tables):
    w = sage.initial_weights(7, HIDDEN, OUT, LAYERS, seed=5)
    w = {k: v + 0.01 * np.arange(v.size).reshape(v.shape) / v.size for k, v in w.items()}  # biases and gains that count
    got = {r["id"]: r["x"] for r in sage.forward(*tables, w, LAYERS).collect()}
    want = projected(dense(*graph, w, LAYERS), w)
    assert len(got) == 90 and np.abs(np.array([got[k] for k in range(90)]) - want).max() < 1e-6


@pytest.mark.parametrize("pooling", ["mean", "max", "add", "attention"])
def test_pooling_equals_numpy(spark, graph, tables, pooling):
    w = sage.initial_weights(7, HIDDEN, OUT, LAYERS, seed=6)
    members = spark.createDataFrame([(k, k % 4) for k in range(90)], "id long, graph int")
    got = {r["graph"]: r["x"] for r in sage.forward(*tables, w, LAYERS, members, pooling).collect()}
    h, rows = dense(*graph, w, LAYERS), []
    for g in range(4):
        mine = h[g::4]
        if pooling == "attention":
            gate = np.maximum(mine @ w["gate1.w"] + w["gate1.b"], 0) @ w["gate2.w"] + w["gate2.b"]
            share = np.exp(gate - gate.max())
            rows.append((share / share.sum() * np.maximum(mine @ w["value.w"] + w["value.b"], 0)).sum(0))
        else:
            rows.append({"mean": mine.mean(0), "max": mine.max(0), "add": mine.sum(0)}[pooling])
    assert np.abs(np.array([got[g] for g in range(4)]) - projected(np.array(rows), w)).max() < 1e-6


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    settings = sage.Settings(hidden=4, numbers=2, classes=3, class_weight=0.5)
    w = {k: v + rng.normal(size=v.shape) * 0.1 for k, v in sage.start(5, settings).weights.items()}
    n = np.array([2, 0, 3])
    batch = (rng.normal(size=(3, 5)), rng.normal(size=(3, 5)), n, rng.normal(size=(5, 5)), rng.normal(size=(5, 5)), np.column_stack((rng.normal(size=(3, 2)), [0, 2, 1])))
    _, gradient = sage.loss_and_gradient(w, settings, *batch)
    for k, v in w.items():
        for at in list(np.ndindex(v.shape))[:6]:
            up, down = ({**w, k: v + 1e-6 * s * (np.indices(v.shape) == np.array(at).reshape(-1, *[1] * v.ndim)).all(0)} for s in (1, -1))
            slope = (sage.loss_and_gradient(up, settings, *batch)[0] - sage.loss_and_gradient(down, settings, *batch)[0]) / 2e-6
            assert slope == pytest.approx(gradient[k][at], abs=1e-5)


@pytest.fixture(scope="module")
def learnt(spark, graph, tables):
    x, _ = graph
    settings = sage.Settings(hidden=8, fan_out=4, classes=2, epochs=8, rate=0.05)
    targets = spark.createDataFrame([(k, [float(row[0] + row[1] > 0)]) for k, row in enumerate(x)] + [(777, [1.0])], "id long, y array<double>")
    rows = sage.examples(*tables, features.split(targets, "id", 0.8, 1), 7, settings)
    return settings, rows


def test_examples_hold_drawn_neighbours(graph, learnt):
    x, edges = graph
    _, rows = learnt
    found = {r["id"]: r for r in rows.collect()}
    into = {k: {a for a, b in edges if b == k} for k in range(90)}
    assert set(found) == set(range(90))
    for k, r in found.items():
        assert r["n"] == min(4, len(into[k])) and len(r["their_x"]) == 7 * r["n"]
        theirs = {tuple(np.round(r["their_x"][7 * i : 7 * i + 7], 9)) for i in range(r["n"])}
        assert theirs <= {tuple(np.round(x[a], 9)) for a in into[k]}
        if r["n"]:
            assert np.allclose(r["near"], np.mean(list(theirs), axis=0), atol=1e-8)


def test_training_equals_one_process_and_resumes(spark, learnt, tmp_path):
    settings, rows = learnt
    whole = sage.train(rows, 7, settings, f"{tmp_path}/a")
    assert whole.history[-1][0] < 0.8 * whole.history[0][0] and whole.best < whole.history[0][1]

    local = sorted(rows.where("side = 'train'").collect(), key=lambda r: r["id"])
    batch = (np.array([r["x"] for r in local]), np.array([r["near"] for r in local]), np.array([r["n"] for r in local]), *(np.concatenate([r[c] for r in local]).reshape(-1, 7) for c in ("their_x", "their_near")), np.array([r["y"] for r in local]))
    state = sage.start(7, settings)
    for want in whole.history:
        loss, gradient = sage.loss_and_gradient(state.weights, settings, *batch)
        assert loss / len(local) == pytest.approx(want[0], abs=1e-9)
        sage.step(state, {k: g / len(local) for k, g in gradient.items()}, settings)
        state.epoch += 1

    sage.train(rows, 7, settings, f"{tmp_path}/b", stop_after=3)
    (tmp_path / "b" / "epoch-000009").mkdir()  # of a run that died while writing
    resumed = sage.train(rows, 7, settings, f"{tmp_path}/b")
    assert resumed.epoch == whole.epoch and resumed.history == whole.history
    assert all((resumed.weights[k] == whole.weights[k]).all() for k in whole.weights)


def test_early_stop_and_no_examples(spark, learnt, tmp_path):
    settings, rows = learnt
    stuck = sage.train(rows, 7, sage.Settings(hidden=8, fan_out=4, rate=0.0, epochs=20, patience=2), f"{tmp_path}/c")
    assert stuck.epoch == 3 and stuck.since == 2
    assert sage.train(rows.limit(0), 7, settings, f"{tmp_path}/d").epoch == 0
    assert sage.history(spark, stuck).count() == 3
