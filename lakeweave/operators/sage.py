"""GraphSAGE with weight matrices: forward pass over a whole graph, and training on sampled neighbourhoods.

Forward: neighbours are averaged by place with partial aggregates (a hub is no special case), everything else is a matrix
product over Arrow batches. Input projection, layers of mean aggregation (rows brought to length 1, then normalised), the
layers' outputs one after another through a projection (jumping knowledge), pooling by graph, output projection.

Training: of every node at most ``fan_out`` in-neighbours are drawn by a hash of the edge, the same ones on every run. An
example holds its node's vector, the mean of its neighbours', and both of each drawn neighbour; examples are written once.
An epoch is a pass over them in which each task sums its gradients; their sums, in the order of tasks, move the weights by
AdamW. Weights and moments are written after every epoch, so a run that was stopped goes on with the same numbers.

A node without in-neighbours has a mean of zeros. Null vectors and edges to unknown nodes are left out.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from ..sources.shared import written

Weights = dict[str, np.ndarray]


# numbers of one batch


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1 if width is None else width)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))


def linear(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    return x @ w[f"{name}.w"] + w[f"{name}.b"]


def layer_norm(x: np.ndarray, w: Weights, name: str) -> np.ndarray:
    centred = x - x.mean(axis=1, keepdims=True)
    return centred / np.sqrt((centred**2).mean(axis=1, keepdims=True) + 1e-5) * w[f"{name}.gain"] + w[f"{name}.shift"]


def relu(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0)


def convolved(x: np.ndarray, near: np.ndarray, w: Weights, layer: int) -> np.ndarray:
    """One layer of a batch: own and neighbours' part, rows brought to length 1, normalised, cut at 0."""
    h = linear(near, w, f"near{layer}") + x @ w[f"own{layer}.w"]
    return relu(layer_norm(h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12), w, f"norm{layer}"))


def initial_weights(inputs: int, hidden: int, outputs: int, layers: int, seed: int = 0) -> Weights:
    """Xavier weights, biases 0, gains 1."""
    rng, out = np.random.default_rng(seed), {}

    def dense(name: str, a: int, b: int, bias: bool = True) -> None:
        bound = math.sqrt(6 / (a + b))
        out[f"{name}.w"] = rng.uniform(-bound, bound, (a, b))
        if bias:
            out[f"{name}.b"] = np.zeros(b)

    def norm(name: str) -> None:
        out[f"{name}.gain"], out[f"{name}.shift"] = np.ones(hidden), np.zeros(hidden)

    dense("input", inputs, hidden)
    dense("jump", hidden * layers, hidden)
    for k in range(layers):
        dense(f"near{k}", hidden, hidden)
        dense(f"own{k}", hidden, hidden, bias=False)
        norm(f"norm{k}")
    dense("gate1", hidden, max(1, hidden // 2))
    dense("gate2", max(1, hidden // 2), 1)
    dense("value", hidden, hidden)
    dense("out1", hidden, hidden)
    dense("out2", hidden, outputs)
    for name in ("input", "jump", "out1"):
        norm(name)
    return out


# forward


def _mapped(rows: DataFrame, keys: str, columns: list[str], make) -> DataFrame:
    """``rows`` by batches: their keys as they are, and ``columns`` (arrays of doubles) made from the other ones' matrices."""
    ship_package(rows.sparkSession)
    kept = keys.split()
    spec = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in kept), *(f"{c} array<double>" for c in columns)])
    others = [c for c in rows.columns if c not in kept]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = make(*(_matrix(batch.column(batch.schema.get_field_index(c))) for c in others))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in kept), *map(_lists, made)], names=[*kept, *columns])

    return rows.mapInArrow(run, spec)


def _means(nodes: DataFrame, edges: DataFrame, width: int, column: str = "x") -> DataFrame:
    """(id, near) of every node with in-neighbours."""
    sent = edges.select("src", F.col("dst").alias("_to")).join(nodes.select(F.col("id").alias("src"), F.col(column).alias("_x")), "src")
    return sent.groupBy(F.col("_to").alias("id")).agg(F.array(*(F.avg(F.col("_x")[k]) for k in range(width))).alias("near"))


def _with_means(nodes: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    zeros = F.array_repeat(F.lit(0.0), width)
    return nodes.join(_means(nodes, edges, width), "id", "left").withColumn("near", F.coalesce("near", zeros))


def embed_nodes(nodes: DataFrame, edges: DataFrame, weights: Weights, layers: int) -> DataFrame:
    """(id, x): the joined layers of every node (id, x), before pooling and output projection."""
    hidden = weights["input.b"].shape[0]
    known = nodes.where("x IS NOT NULL").select("id", F.col("x").cast("array<double>").alias("x"))
    state = written(_mapped(known, "id", ["x"], lambda x: [relu(layer_norm(linear(x, weights, "input"), weights, "input"))]), "sage")
    for k in range(layers):
        joined = _with_means(state, edges, hidden)
        if k == 0:
            out = _mapped(joined.select("id", "x", "near"), "id", ["x", "all"], lambda x, near: [convolved(x, near, weights, 0)] * 2)
        else:
            out = _mapped(joined.select("id", "x", "near", "all"), "id", ["x", "all"], lambda x, near, before, k=k: [h := convolved(x, near, weights, k), np.concatenate((before, h), axis=1)])
        state = written(out, "sage")
    return _mapped(state.select("id", "all"), "id", ["x"], lambda every: [relu(layer_norm(linear(every, weights, "jump"), weights, "jump"))])


def pooled(nodes: DataFrame, members: DataFrame, weights: Weights, pooling: str) -> DataFrame:
    """(graph, x) of the graphs that ``members`` (id, graph) make up: mean, max or add by place, or attention."""
    width = weights["jump.b"].shape[0]
    rows = members.join(nodes, "id")
    if pooling in ("mean", "max", "add"):
        how = {"mean": F.avg, "max": F.max, "add": F.sum}[pooling]
        return rows.groupBy("graph").agg(F.array(*(how(F.col("x")[k]) for k in range(width))).alias("x"))
    gated = written(_mapped(rows.select("graph", "x"), "graph", ["gate", "value"], lambda x: [linear(relu(linear(x, weights, "gate1")), weights, "gate2"), relu(linear(x, weights, "value"))]), "gated")
    top = gated.groupBy("graph").agg(F.max(F.col("gate")[0]).alias("_top"))
    share = gated.join(top, "graph").withColumn("_e", F.exp(F.col("gate")[0] - F.col("_top")))
    total = F.sum("_e")
    return share.groupBy("graph").agg(F.array(*(F.sum(F.col("_e") * F.col("value")[k]) / total for k in range(width))).alias("x"))


def forward(nodes: DataFrame, edges: DataFrame, weights: Weights, layers: int, members: DataFrame | None = None, pooling: str = "attention") -> DataFrame:
    """Embeddings (id, x) of the nodes, or (graph, x) of the graphs in ``members``."""
    rows = embed_nodes(nodes, edges, weights, layers)
    key = "id"
    if members is not None:
        rows, key = pooled(rows, members, weights, pooling), "graph"
    return _mapped(rows.select(key, "x"), key, ["x"], lambda x: [linear(relu(layer_norm(linear(x, weights, "out1"), weights, "out1")), weights, "out2")])


# training on sampled neighbourhoods


@dataclass(frozen=True)
class Settings:
    """``numbers``: how many of a target's places are regressed (squared error); the rest is one class number."""

    hidden: int = 32
    fan_out: int = 8
    numbers: int = 0
    classes: int = 2
    class_weight: float = 1.0
    rate: float = 0.01
    decay: float = 1e-5
    clip: float = 1.0
    epochs: int = 30
    patience: int = 10
    seed: int = 0


@dataclass
class State:
    """Where a run stands: weights, AdamW's moments, losses by epoch, and the weights of the best validation loss."""

    weights: Weights
    first: Weights
    second: Weights
    epoch: int = 0
    best: float = math.inf
    since: int = 0
    best_weights: Weights = field(default_factory=dict)
    history: list[list[float]] = field(default_factory=list)


def sampled(edges: DataFrame, fan_out: int, seed: int) -> DataFrame:
    """At most ``fan_out`` in-edges of each node, by a hash of the edge; cut before the shuffle as well as after."""
    order = Window.partitionBy("dst").orderBy(F.xxhash64("src", "dst", F.lit(seed)), "src")
    return edges.select("src", "dst").distinct().withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= fan_out).drop("_n")


def examples(nodes: DataFrame, edges: DataFrame, targets: DataFrame, width: int, settings: Settings) -> DataFrame:
    """One written row for each target (id, y, side): own and mean vector, those of the drawn neighbours, and their number."""
    known = nodes.where("x IS NOT NULL").select("id", F.col("x").cast("array<double>").alias("x"))
    drawn = written(sampled(edges, settings.fan_out, settings.seed), "drawn")
    both = written(_with_means(known, drawn, width), "means")
    near = drawn.join(both.select(F.col("id").alias("src"), "x", "near"), "src").groupBy(F.col("dst").alias("id"))
    lists = near.agg(F.array_sort(F.collect_list(F.struct("src", "x", "near"))).alias("drawn"))  # at most fan_out of them
    rows = targets.join(both, "id").join(lists, "id", "left").withColumn("drawn", F.coalesce("drawn", F.array().cast(lists.schema["drawn"].dataType)))
    flat = lambda c: F.flatten(F.transform("drawn", lambda d: d[c]))
    out = rows.select("id", "side", F.col("y").cast("array<double>").alias("y"), "x", "near", F.size("drawn").alias("n"), flat("x").alias("their_x"), flat("near").alias("their_near"))
    return written(out.repartition("id").sortWithinPartitions("id"), "examples")


def start(width: int, settings: Settings) -> State:
    rng = np.random.default_rng(settings.seed)
    outputs = settings.numbers + settings.classes
    shapes = {"own1": (width, settings.hidden), "near1": (width, settings.hidden), "own2": (settings.hidden, settings.hidden), "near2": (settings.hidden, settings.hidden), "head": (settings.hidden, outputs)}
    weights = {k: rng.uniform(-1, 1, s) * math.sqrt(6 / sum(s)) for k, s in shapes.items()} | {"bias1": np.zeros(settings.hidden), "bias2": np.zeros(settings.hidden), "bias": np.zeros(outputs)}
    zeros = {k: np.zeros_like(v) for k, v in weights.items()}
    return State(weights, zeros, dict(zeros))


def loss_and_gradient(w: Weights, settings: Settings, own: np.ndarray, near: np.ndarray, n: np.ndarray, their_own: np.ndarray, their_near: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """Summed loss and gradients of a batch; the drawn neighbours' rows stand one after another, ``n`` of each example."""
    row = np.repeat(np.arange(len(n)), n)
    share = (1.0 / np.maximum(n, 1))[row][:, None]
    a = relu(own @ w["own1"] + near @ w["near1"] + w["bias1"])
    b = relu(their_own @ w["own1"] + their_near @ w["near1"] + w["bias1"])
    m = np.zeros_like(a)
    np.add.at(m, row, b * share)
    h = relu(a @ w["own2"] + m @ w["near2"] + w["bias2"])
    out = h @ w["head"] + w["bias"]

    k, d_out, loss = settings.numbers, np.zeros_like(out), 0.0
    if k:
        wrong = out[:, :k] - y[:, :k]
        loss += float((wrong**2).sum()) / k
        d_out[:, :k] = 2 * wrong / k
    if settings.classes:
        logits = out[:, k:] - out[:, k:].max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        own_class = y[:, k].astype(np.int64)
        loss -= settings.class_weight * float(np.log(np.maximum(p[np.arange(len(p)), own_class], 1e-300)).sum())
        p[np.arange(len(p)), own_class] -= 1
        d_out[:, k:] = settings.class_weight * p

    d_h = (d_out @ w["head"].T) * (h > 0)
    d_a, d_m = (d_h @ w["own2"].T) * (a > 0), d_h @ w["near2"].T
    d_b = d_m[row] * share * (b > 0)
    gradient = {
        "head": h.T @ d_out, "bias": d_out.sum(axis=0), "own2": a.T @ d_h, "near2": m.T @ d_h, "bias2": d_h.sum(axis=0),
        "own1": own.T @ d_a + their_own.T @ d_b, "near1": near.T @ d_a + their_near.T @ d_b, "bias1": d_a.sum(axis=0) + d_b.sum(axis=0),
    }
    return loss, gradient


def _packed(w: Weights) -> bytes:
    return b"".join(np.ascontiguousarray(w[k], "<f8").tobytes() for k in sorted(w))


def _unpacked(data: bytes, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = np.frombuffer(data, "<f8", like[k].size, at).reshape(like[k].shape).copy()
        at += 8 * like[k].size
    return out


def epoch_sums(rows: DataFrame, weights: Weights, settings: Settings, with_gradient: bool = True) -> tuple[float, int, Weights]:
    """Loss, number of examples and gradients over all ``rows``. A task passes on one row; they are added up in the order of
    the tasks, in groups of 256 on the executors and then here, so that the sums are the same on every run."""
    ship_package(rows.sparkSession)
    spec = "part int, loss double, n long, gradient binary"

    def row(part: int, loss: float, n: int, total: Weights) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([loss]), pa.array([n], pa.int64()), pa.array([_packed(total)], pa.binary())], names=["part", "loss", "n", "gradient"])

    def run(batches):
        from pyspark import TaskContext

        loss, n, total = 0.0, 0, {k: np.zeros_like(v) for k, v in weights.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            width = weights["own1"].shape[0]
            part_loss, part = loss_and_gradient(weights, settings, _matrix(c["x"]), _matrix(c["near"]), c["n"].to_numpy(), c["their_x"].flatten().to_numpy().reshape(-1, width), c["their_near"].flatten().to_numpy().reshape(-1, width), _matrix(c["y"]))
            loss, n = loss + part_loss, n + batch.num_rows
            if with_gradient:
                for k in total:
                    total[k] += part[k]
        if n:
            yield row(TaskContext.get().partitionId(), loss, n, total)

    def added(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda r: r["part"])
        total = {k: np.zeros_like(v) for k, v in weights.items()}
        for r in found:
            part = _unpacked(r["gradient"], weights)
            for k in total:
                total[k] += part[k]
        return pa.Table.from_batches([row(found[0]["part"] // 256, sum(r["loss"] for r in found), sum(r["n"] for r in found), total)])

    parts = rows.select("x", "near", "n", "their_x", "their_near", "y").mapInArrow(run, spec)
    found = sorted(parts.groupBy(F.floor(F.col("part") / 256)).applyInArrow(added, spec).collect(), key=lambda r: r["part"])
    total = {k: np.zeros_like(v) for k, v in weights.items()}
    for r in found:
        part = _unpacked(r["gradient"], weights)
        for k in total:
            total[k] += part[k]
    return sum(r["loss"] for r in found), sum(r["n"] for r in found), total


def step(state: State, gradient: Weights, settings: Settings) -> None:
    """AdamW on the mean gradient, its length held to ``clip``; the rate falls to 0 along a cosine."""
    t = state.epoch + 1
    length = math.sqrt(sum(float((g**2).sum()) for g in gradient.values()))
    scale = min(1.0, settings.clip / (length + 1e-6))
    rate = settings.rate * 0.5 * (1 + math.cos(math.pi * state.epoch / settings.epochs))
    for k, g in gradient.items():
        g = g * scale
        state.first[k] = 0.9 * state.first[k] + 0.1 * g
        state.second[k] = 0.999 * state.second[k] + 0.001 * g * g
        moved = (state.first[k] / (1 - 0.9**t)) / (np.sqrt(state.second[k] / (1 - 0.999**t)) + 1e-8)
        state.weights[k] = state.weights[k] * (1 - rate * settings.decay) - rate * moved


def save(spark: SparkSession, state: State, folder: str) -> None:
    """A checkpoint: one row, in a folder of its epoch; a run that dies while writing leaves the one before as the last."""
    rest = json.dumps({"best": state.best if math.isfinite(state.best) else None, "since": state.since, "history": state.history})
    row = (state.epoch, rest, *(bytearray(_packed(w)) for w in (state.weights, state.first, state.second, state.best_weights or state.weights)))
    spark.createDataFrame([row], "epoch int, rest string, weights binary, first binary, second binary, best_weights binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch-{state.epoch:06d}")


def load(spark: SparkSession, folder: str, width: int, settings: Settings) -> State:
    """The last whole checkpoint of a folder, or a fresh start."""
    state = start(width, settings)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return state
    whole = sorted(s.getPath().toString() for s in store.listStatus(path) if store.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    if not whole:
        return state
    row = spark.read.parquet(whole[-1]).first()
    rest = json.loads(row["rest"])
    weights, first, second, best = (_unpacked(bytes(row[c]), state.weights) for c in ("weights", "first", "second", "best_weights"))
    return State(weights, first, second, row["epoch"], math.inf if rest["best"] is None else rest["best"], rest["since"], best, rest["history"])


def train(rows: DataFrame, width: int, settings: Settings, folder: str, stop_after: int | None = None) -> State:
    """Trains on the examples of side ``train``, judged by those of ``validation`` (by the training loss where there are
    none), from the last checkpoint in ``folder`` on: until ``epochs``, or ``patience`` epochs without a better loss, or
    ``stop_after`` epochs of this call."""
    spark = rows.sparkSession
    state = load(spark, folder, width, settings)
    mine, others = rows.where("side = 'train'"), rows.where("side = 'validation'")
    done = 0
    while state.epoch < settings.epochs and state.since < settings.patience and done != stop_after:
        loss, n, gradient = epoch_sums(mine, state.weights, settings)
        if not n:
            break
        step(state, {k: g / n for k, g in gradient.items()}, settings)
        wrong, m, _ = epoch_sums(others, state.weights, settings, with_gradient=False)
        judged = wrong / m if m else loss / n
        state.epoch, done = state.epoch + 1, done + 1
        state.history.append([loss / n, judged])
        if judged < state.best:
            state.best, state.since, state.best_weights = judged, 0, {k: v.copy() for k, v in state.weights.items()}
        else:
            state.since += 1
        save(spark, state, folder)
    return state


def history(spark: SparkSession, state: State) -> DataFrame:
    """(epoch, train_loss, validation_loss)."""
    return spark.createDataFrame([(k, *losses) for k, losses in enumerate(state.history, 1)], "epoch int, train_loss double, validation_loss double")
