"""Ordered folds with state by key: rate limits, circuit breaker, ledgers with rejection; event-sourced projections.

Rows are dealt by key, sorted within partitions and streamed through Python in Arrow batches: a fold holds one key's
state and one batch, however long a key's history is. Folds whose step is a maximum, a sum or a count are windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_package

TIER_LIMITS = {"free": 100, "pro": 120, "enterprise": 600, "internal": 1000}


def ordered_fold(rows: DataFrame, key: str, order: list[str], start: Callable[[], dict], step: Callable[[dict, tuple], tuple], inputs: list[str], outputs: str) -> DataFrame:
    """Adds what ``step(state, inputs)`` returns for each row, in order within its key. ``outputs`` is a schema string."""
    ship_package(rows.sparkSession)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = [o.split()[0] for o in outputs.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), start()
        for frame in frames:
            found = []
            for k, *values in frame[[key, *inputs]].itertuples(index=False, name=None):
                if k != at:
                    at, state = k, start()
                found.append(step(state, tuple(values)))
            yield frame.assign(**{n: [f[i] for f in found] for i, n in enumerate(names)})

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, f"{kept}, {outputs}")


def seconds(column: str):
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


def token_bucket(rows: DataFrame, key: str, order: list[str], at: str, capacity: float, per_second: float) -> DataFrame:
    """allowed and tokens left: a bucket refills with time, up to its capacity; each admitted row takes one token."""

    def step(state: dict, values: tuple) -> tuple:
        now = values[0]
        state["tokens"] = min(capacity, state["tokens"] + (now - state["at"]) * per_second if state["at"] is not None else capacity)
        state["at"] = now
        allowed = state["tokens"] >= 1
        state["tokens"] -= 1 if allowed else 0
        return allowed, state["tokens"]

    return ordered_fold(rows, key, order, lambda: {"tokens": capacity, "at": None}, step, [at], "allowed boolean, tokens double")


def sliding_window(rows: DataFrame, key: str, order: list[str], at: str, limit: int, window: float) -> DataFrame:
    """allowed: fewer than ``limit`` admitted rows in the window before. Refused rows don't count."""

    def step(state: dict, values: tuple) -> tuple:
        log = state["log"]
        while log and log[0] <= values[0] - window:
            log.pop(0)
        allowed = len(log) < limit
        if allowed:
            log.append(values[0])
        return (allowed,)

    return ordered_fold(rows, key, order, lambda: {"log": []}, step, [at], "allowed boolean")


def circuit_breaker(rows: DataFrame, key: str, order: list[str], at: str, failed: str, failures: int = 5, successes: int = 3, wait: float = 30.0) -> DataFrame:
    """allowed and state: opens after failures in a row, probes after ``wait`` seconds, closes after successes."""

    def step(state: dict, values: tuple) -> tuple:
        now, bad = values
        if state["name"] == "open" and now - state["since"] >= wait:
            state.update(name="half_open", good=0)
        allowed = state["name"] != "open"
        if allowed and bad:
            state["bad"] += 1
            if state["name"] == "half_open" or state["bad"] >= failures:
                state.update(name="open", since=now, bad=0)
        elif allowed:
            state["bad"], state["good"] = 0, state["good"] + 1
            if state["name"] == "half_open" and state["good"] >= successes:
                state.update(name="closed")
        return allowed, state["name"]

    return ordered_fold(rows, key, order, lambda: {"name": "closed", "bad": 0, "good": 0, "since": 0.0}, step, [at, failed], "allowed boolean, state string")


def adaptive_rate(rows: DataFrame, key: str, order: list[str], load: str, start: float = 100.0) -> DataFrame:
    """rate: 10% down under load over 70, else 10% up, within 10 and 1,000."""

    def step(state: dict, values: tuple) -> tuple:
        state["rate"] = min(1000.0, max(10.0, state["rate"] * (0.9 if values[0] > 70 else 1.1)))
        return (state["rate"],)

    return ordered_fold(rows, key, order, lambda: {"rate": start}, step, [load], "rate double")


def debits(rows: DataFrame, account: str, order: list[str], cents: str, start: int) -> DataFrame:
    """accepted and balance: entries that would overdraw are refused and change nothing."""

    def step(state: dict, values: tuple) -> tuple:
        ok = state["balance"] + values[0] >= 0
        state["balance"] += values[0] if ok else 0
        return ok, state["balance"]

    return ordered_fold(rows, account, order, lambda: {"balance": start}, step, [cents], "accepted boolean, balance long")


def auction(bids: DataFrame, session: str, order: list[str], price: str, actor: str) -> DataFrame:
    """Of each session: bids, those that raised the highest, the highest price and who first offered it."""
    w = Window.partitionBy(session).orderBy(*order)
    before = F.max(price).over(w.rowsBetween(Window.unboundedPreceding, -1))
    raised = bids.withColumn("_raise", (F.col(price) > F.coalesce(before, F.lit(float("-inf")))).cast("long"))
    top = F.max_by(actor, F.when(F.col("_raise") == 1, F.struct(price)))
    return raised.groupBy(session).agg(F.count(F.lit(1)).alias("bids"), F.sum("_raise").alias("raises"), F.max(price).alias("highest"), top.alias("winner"))


def negotiation(events: DataFrame, session: str, order: list[str], kind: str, price: str) -> DataFrame:
    """State of each session after all its events: offers, last price, and whether it was accepted or withdrawn.

    The events that matter are picked by partial aggregates; no session's history is collected.
    """
    at = F.struct(*order)
    is_offer = F.col(kind).isin("OFFER", "COUNTER")
    out = events.groupBy(session).agg(
        F.count_if(is_offer).alias("offers"),
        F.max_by(price, F.when(is_offer, at)).alias("last_price"),
        F.max_by(kind, F.when(F.col(kind).isin("ACCEPT", "WITHDRAW", "TIMEOUT"), at)).alias("ended_by"),
        F.count(F.lit(1)).alias("version"),
    )
    status = F.when(F.col("ended_by") == "ACCEPT", "accepted").when(F.col("ended_by").isNotNull(), "closed").when(F.col("offers") > 0, "negotiating").otherwise("open")
    return out.withColumn("status", status)


def recent_messages(messages: DataFrame, session: str, turn: str, most: int) -> DataFrame:
    w = Window.partitionBy(session).orderBy(F.desc(turn))
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def context(messages: DataFrame, session: str, text: str, most_tokens: int) -> DataFrame:
    """Messages, estimated tokens (characters over 2) and whether they overflow, of each session."""
    out = messages.groupBy(session).agg(F.count(F.lit(1)).alias("messages"), F.sum(F.floor(F.length(text) / 2)).alias("tokens"))
    return out.withColumn("overflow", F.col("tokens") > most_tokens)


def bucket_now(folded: DataFrame, key: str, order: list[str], at: str, as_of: float, capacity: float, per_second: float) -> DataFrame:
    """Tokens of each bucket at a time, from the last row of its fold; nothing is taken."""
    last = folded.groupBy(key).agg(F.max_by(F.struct("tokens", F.col(at).alias("_at")), F.struct(*order)).alias("_l"))
    return last.select(key, F.least(F.lit(capacity), F.col("_l.tokens") + (as_of - F.col("_l._at")) * per_second).alias("tokens"))


def window_now(folded: DataFrame, key: str, at: str, as_of: float, window: float) -> DataFrame:
    """Admitted rows of each key in the window that ends at a time."""
    return folded.groupBy(key).agg(F.count_if(F.col("allowed") & (F.col(at) > as_of - window) & (F.col(at) <= as_of)).alias("used"))


def breaker_now(folded: DataFrame, key: str, order: list[str], at: str, as_of: float, wait: float) -> DataFrame:
    """State of each breaker after its last row, and the seconds until it may be tried again (null unless open)."""
    opened = (F.col("state") == "open") & F.col("allowed")  # an admitted row that leaves it open is the one that opened it
    out = folded.groupBy(key).agg(F.max_by("state", F.struct(*order)).alias("state"), F.max(F.when(opened, F.col(at))).alias("_since"))
    return out.select(key, "state", F.when(F.col("state") == "open", F.greatest(F.lit(0.0), F.col("_since") + wait - as_of)).alias("retry_s"))


# By kind of request, most requests and most rejected ones in a minute, and how long too many of each throttle.
REQUEST_LIMITS = {"bid": (10, 5), "offer": (5, 3), "message": (20, 10)}
WINDOW_S, THROTTLE_S, CONFLICT_THROTTLE_S = 60.0, 300.0, 600.0


def throttled(rows: DataFrame, key: str, order: list[str], at: str, kind: str, rejected: str, limits: dict[str, tuple[int, int]] | None = None, window: float = WINDOW_S, throttle: float = THROTTLE_S, conflict_throttle: float = CONFLICT_THROTTLE_S) -> DataFrame:
    """allowed and reason (throttled, rate, conflicts) of each request of an actor (``key``: actor and kind in one).

    A window begins with a request and lasts ``window`` seconds. A request over its limit throttles, and so does one after
    too many rejected ones; while throttled everything is refused. Kinds without limits are always allowed.
    """
    held = limits or REQUEST_LIMITS

    def step(state: dict, values: tuple) -> tuple:
        now, what, bad = values
        most, most_bad = held.get(what, (None, None))
        if most is None:
            return True, None
        if now < state["until"]:
            return False, "throttled"
        if now - state["start"] >= window:
            state.update(start=now, n=0, bad=0)
        if state["n"] >= most or state["bad"] >= most_bad:
            reason = "rate" if state["n"] >= most else "conflicts"
            state["until"] = now + (throttle if reason == "rate" else conflict_throttle)
            return False, reason
        state["n"] += 1
        state["bad"] += 1 if bad else 0
        return True, None

    return ordered_fold(rows, key, order, lambda: {"start": float("-inf"), "n": 0, "bad": 0, "until": float("-inf")}, step, [at, kind, rejected], "allowed boolean, reason string")
