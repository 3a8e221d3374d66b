"""Job states: which actions a state admits, states after a log of actions, and what a finished run counts as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stateful import ordered_fold

# States from which an action is admitted, and the state after it.
TRANSITIONS = {
    "start": (("queued", "pending"), "processing"),
    "finish": (("processing",), "succeeded"),
    "fail": (("pending", "queued", "processing"), "failed"),
    "cancel": (("pending", "queued", "processing"), "cancelled"),
    "requeue": (("failed", "cancelled"), "queued"),
}


def next_state(state: Column, action: Column) -> Column:
    """The state after one action; null if the state doesn't admit it."""
    out = None
    for name, (before, after) in TRANSITIONS.items():
        hit = (action == name) & state.isin(*before)
        out = F.when(hit, after) if out is None else out.when(hit, after)
    return out


def replayed(actions: DataFrame, job: str, order: list[str], action: str) -> DataFrame:
    """admitted and state of each action of a log, jobs starting as queued."""

    def step(state: dict, values: tuple) -> tuple:
        before, after = TRANSITIONS.get(values[0], ((), ""))
        ok = state["now"] in before
        state["now"] = after if ok else state["now"]
        return ok, state["now"]

    return ordered_fold(actions, job, order, lambda: {"now": "queued"}, step, [action], "admitted boolean, state string")


def outcome(chunks: Column, graph_failed: Column) -> Column:
    """Of a finished run: failed without chunks, partial if only the graph part failed."""
    return F.when(chunks == 0, "failed").when(graph_failed, "partial_success").otherwise("succeeded")


def updated(tasks: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Tasks with the columns of ``changes`` that aren't null put in (one change for each key)."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in names))
    out = tasks.join(new, key, "left")
    for c in names:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.drop(*(f"_{c}" for c in names))


def space_report(rows: DataFrame, space: str, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows of each space in a window of days before ``as_of``, and in the window before that."""
    age = F.datediff(F.lit(as_of).cast("timestamp_ntz"), F.col(ts))
    return rows.groupBy(space).agg(F.count_if((age >= 0) & (age < days)).alias("now"), F.count_if((age >= days) & (age < 2 * days)).alias("before"))
