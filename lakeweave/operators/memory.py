"""Memory of a participant as tables: preferences, memories with expiry, sessions and their cleaning, step checkpoints, recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .access import unexpired
from .stateful import ordered_fold

# The first keyword that a text holds gives a memory its kind.
MEMORY_KINDS = {"喜欢": "preference", "偏好": "preference", "需要": "goal", "目标": "goal", "是": "fact", "在": "fact"}


def preferences(writes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The state of (user, key) after all its writes: the last value; confidence is averaged with each write's in turn.

    Averaging in turn weighs the k-th of n writes with 2^-(n-k+1), the first with 2^-(n-1): a sum over a window, no fold.
    """
    back = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    forth = Window.partitionBy(*keys).orderBy(*order)
    k = writes.withColumn("_back", F.row_number().over(back)).withColumn("_first", F.row_number().over(forth) == 1)
    weight = F.pow(F.lit(0.5), F.when(F.col("_first"), F.col("_back") - 1).otherwise(F.col("_back")))
    return k.groupBy(*keys).agg(F.min_by("value", "_back").alias("value"), F.sum(weight * F.col("confidence")).alias("confidence"), F.count(F.lit(1)).alias("writes"))


def live_memories(memories: DataFrame, as_of: str, kind: str | None = None, least_importance: int = 1) -> DataFrame:
    """Unexpired memories of at least an importance, optionally of one kind."""
    out = memories.where(unexpired(F.col("expires_at"), as_of) & (F.col("importance") >= least_importance))
    return out if kind is None else out.where(F.col("kind") == kind)


def changed_importance(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """Importance after the sum of its changes (memory, delta), held to 1..10."""
    total = changes.groupBy("memory").agg(F.sum("delta").alias("_delta"))
    new = F.greatest(F.lit(1), F.least(F.lit(10), F.col("importance") + F.coalesce("_delta", F.lit(0))))
    return memories.join(total, "memory", "left").withColumn("importance", new.cast(memories.schema["importance"].dataType)).drop("_delta")


def memory_summary(memories: DataFrame) -> DataFrame:
    """Rows and mean importance over all (kind null) and by kind."""
    return memories.rollup("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("importance").alias("importance"))


def memory_kind(content: Column, default: str = "fact") -> Column:
    out = None
    for word, kind in MEMORY_KINDS.items():
        hit = content.contains(word)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(default)


def session_stats(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Of each user: sessions, active ones and messages."""
    said = messages.groupBy("session").agg(F.count(F.lit(1)).alias("_n"))
    return sessions.join(said, "session", "left").groupBy("user").agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("status") == "active").alias("active"), F.sum(F.coalesce("_n", F.lit(0))).alias("messages"))


def without_old_sessions(sessions: DataFrame, messages: DataFrame, as_of: str, days: int) -> tuple[DataFrame, DataFrame]:
    """Sessions and messages without archived sessions whose last message is older than ``days``."""
    edge = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    old = sessions.where((F.col("status") == "archived") & (F.col("last_message_at") < edge)).select("session")
    return sessions.join(old, "session", "left_anti"), messages.join(old, "session", "left_anti")


def checkpoints(steps: DataFrame, order: list[str], as_of: str) -> DataFrame:
    """The last unexpired result of every (task, step); expired ones are gone."""
    live = steps.where(unexpired(F.col("expires_at"), as_of))
    return live.groupBy("task", "step").agg(F.max_by(F.struct("result", *order), F.struct(*order)).alias("_r")).select("task", "step", "_r.*")


def restored(checkpointed: DataFrame, order: list[str]) -> DataFrame:
    """(task, steps, results): the finished steps of each task in order, and a map of their results."""
    steps = F.array_sort(F.collect_list(F.struct(*order, "step", "result")))
    out = checkpointed.groupBy("task").agg(steps.alias("_s"))
    return out.select("task", F.col("_s.step").alias("steps"), F.map_from_arrays("_s.step", "_s.result").alias("results"))


def steps_to_run(wanted: DataFrame, checkpointed: DataFrame) -> DataFrame:
    """Steps (task, step) that have no checkpoint yet."""
    return wanted.join(checkpointed, ["task", "step"], "left_anti")


def checkpoint_stats(steps: DataFrame, as_of: str) -> DataFrame:
    return steps.agg(F.count(F.lit(1)).alias("steps"), F.count_if(~unexpired(F.col("expires_at"), as_of)).alias("expired"), F.countDistinct("task").alias("tasks"))


def session_state(updates: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Of each session and field: the last value that was set (``updates``: session, field, value)."""
    return updates.groupBy(session, "field").agg(F.max_by("value", F.struct(*order)).alias("value"))


def working_memory(writes: DataFrame, session: str, at: str, as_of: str) -> DataFrame:
    """Fields of each session whose time to live (``ttl`` seconds after ``at``) isn't over, last write first."""
    end = F.unix_seconds(F.col(at).cast("timestamp")) + F.col("ttl")
    last = writes.groupBy(session, "field").agg(F.max_by(F.struct("value", end.alias("end")), F.col(at)).alias("_w"))
    return last.where(F.col("_w.end") > F.unix_seconds(F.lit(as_of).cast("timestamp"))).select(session, "field", "_w.value")


def expiry(touches: DataFrame, session: str, order: list[str], at: str, ttl: float) -> DataFrame:
    """alive: whether a session still lived when each touch came; a touch of a dead one starts it anew."""

    def step(state: dict, values: tuple) -> tuple:
        alive = state["end"] is not None and values[0] < state["end"]
        state["end"] = values[0] + ttl
        return (alive,)

    return ordered_fold(touches, session, order, lambda: {"end": None}, step, [at], "alive boolean")


def recalled(layers: dict[str, DataFrame], session: str, most: int) -> DataFrame:
    """Prompt rows (session, text, score) of several layers, the first layer first, then by score; ``most`` of each session."""
    rows = None
    for rank, (name, layer) in enumerate(layers.items()):
        one = layer.select(session, "text", F.col("score").cast("double").alias("score"), F.lit(rank).alias("layer_rank"), F.lit(name).alias("layer"))
        rows = one if rows is None else rows.unionByName(one)
    w = Window.partitionBy(session).orderBy("layer_rank", F.desc("score"), "text")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("layer_rank")
