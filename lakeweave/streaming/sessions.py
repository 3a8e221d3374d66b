"""State with a time to live, by ``transformWithState``: bounded message lists that expire, and live edits of resources.

Event time decides in both: rows may come in any order and in any micro-batches that the watermark allows, the result is
the one of a fold over all rows in order. State lives in RocksDB; timers drop it once the watermark has passed its time.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.stateful import ordered_fold
from ..shipping import ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def last_chain(messages: list[tuple[float, int, int]], most: int, ttl: float) -> list[tuple[float, int, int]]:
    """Of (time, id, characters) in order: the newest ``most``, back to the first pause longer than ``ttl``."""
    kept = messages[-most:]
    for k in range(len(kept) - 1, 0, -1):
        if kept[k][0] - kept[k - 1][0] > ttl:
            return kept[k:]
    return kept


class RecentMessages(StatefulProcessor):
    """Of each session the newest messages (a list state), dropped ``ttl`` seconds after the last of them."""

    def __init__(self, key: str, most: int, ttl: float):
        self.key, self.most, self.ttl = key, most, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.messages = handle, handle.getListState("messages", "at double, id long, chars long")

    def _row(self, key, held: list[tuple[float, int, int]], expired: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "n": [len(held)], "ids": [[i for _, i, _ in held]], "tokens": [sum(c for *_, c in held) // 2], "expired": [expired]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {tuple(m) for m in self.messages.get()} if self.messages.exists() else set()
        for frame in rows:
            held |= set(frame[["at", "id", "chars"]].itertuples(index=False, name=None))
        kept = last_chain(sorted(held), self.most, self.ttl)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        ends = int(1000 * (kept[-1][0] + self.ttl))
        if ends <= timerValues.getCurrentWatermarkInMs():
            self.messages.clear()
            yield self._row(key, [], True)
            return
        self.messages.put(kept)
        self.handle.registerTimer(ends)
        yield self._row(key, kept, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.messages.clear()
        yield self._row(key, [], True)

    def close(self) -> None:
        pass


def recent_messages(rows: DataFrame, key: str, most: int = 20, ttl: float = 3600.0, delay: str = "10 minutes") -> DataFrame:
    """A stream of (``key``, n, ids, tokens, expired) after each micro-batch that touches a session or passes its end.

    ``rows``: ``key``, id (long, unique in its session), ts, text. Tokens are half the characters.
    """
    ship_package(rows.sparkSession)
    timed = rows.withWatermark("ts", delay).select(key, "ts", F.col("id").cast("long").alias("id"), (F.unix_micros("ts") / 1e6).alias("at"), F.length("text").cast("long").alias("chars"))
    kind = rows.schema[key].dataType.simpleString()
    return timed.groupBy(key).transformWithStateInPandas(RecentMessages(key, most, ttl), f"{key} {kind}, n long, ids array<long>, tokens long, expired boolean", "Update", "EventTime")


# live edits


class Known:
    """Operations with their clocks, by actor: a new clock meets only the operations that share an actor with it, all of
    them at once; the others conflict with it."""

    def __init__(self, clocks: Iterable[tuple[int, dict[str, int]]] = ()):
        self.clocks: dict[int, dict[str, int]] = {}
        self._row: dict[int, int] = {}
        self._ids, self._actors = array("q"), array("q")  # of each row: the operation, and its clock's actors (0: replaced)
        self._by: dict[str, tuple[array, array]] = {}  # of each actor: rows, and its counts there
        for op, clock in clocks:
            self.add(op, clock)

    def add(self, op: int, clock: dict[str, int]) -> None:
        if op in self._row:
            self._actors[self._row[op]] = 0
        row = self._row[op] = len(self._ids)
        self.clocks[op] = clock
        self._ids.append(op)
        self._actors.append(len(clock))
        for actor, n in clock.items():
            rows, counts = self._by.setdefault(actor, (array("q"), array("q")))
            rows.append(row)
            counts.append(n)

    def _ordered(self, clock: dict[str, int]) -> np.ndarray:
        """Rows that precede or follow a clock; equal ones do neither."""
        held = [(np.array(self._by[actor][0]), np.array(self._by[actor][1]), n) for actor, n in clock.items() if actor in self._by]
        if not held:
            return np.zeros(0, np.int64)
        rows, at = np.unique(np.concatenate([r for r, *_ in held]), return_inverse=True)
        actors = np.array(self._actors)[rows]
        before = np.bincount(at, np.concatenate([c <= n for _, c, n in held])) == actors
        after = np.bincount(at, np.concatenate([c >= n for _, c, n in held])) == len(clock)
        return rows[(before != after) & (actors > 0)]

    def n_conflicts(self, clock: dict[str, int]) -> int:
        return len(self.clocks) - len(self._ordered(clock))

    def conflicts(self, clock: dict[str, int]) -> list[int]:
        free = np.array(self._actors) > 0
        free[self._ordered(clock)] = False
        return np.sort(np.array(self._ids)[free]).tolist()


def applied(known: Known | dict[int, dict], user: str, parents: list[int], ids: bool = True) -> tuple[dict[str, int], list[int] | int]:
    """The clock of a new operation, merged from its user's start and its known parents and counted up; and the ids (else
    the number) of the known operations that it neither follows nor precedes."""
    known = known if isinstance(known, Known) else Known(known.items())
    clock = {user: 1}
    for p in parents:
        for actor, n in known.clocks.get(p, {}).items():
            clock[actor] = max(clock.get(actor, 0), n)
    clock[user] += 1
    return clock, known.conflicts(clock) if ids else known.n_conflicts(clock)


class Operations(StatefulProcessor):
    """Operations wait in a list until the watermark passes them, are applied in order, and stay in a list of clocks until
    their resource has been idle for ``idle`` seconds. Both lists are read and added to once a call."""

    def __init__(self, key: str, idle: float, ids: bool = True):
        self.key, self.idle, self.ids = key, idle, ids

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at double, id long, user string, parents string")
        self.known = handle.getListState("known", "id long, clock string")
        self.last = handle.getValueState("last", "at double")

    def _wake(self, times: list[float]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if times:
            self.handle.registerTimer(int(1000 * min(times)) + 1)

    def _times(self, waiting: list[tuple]) -> list[float]:
        return [w[0] for w in waiting[:1]] + ([self.last.get()[0] + self.idle] if self.last.exists() else [])

    def _applied(self, key, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        waiting = sorted(tuple(w) for w in self.waiting.get()) if self.waiting.exists() else []
        due, rest = [w for w in waiting if w[0] < passed], [w for w in waiting if w[0] >= passed]
        known = Known((op, json.loads(clock)) for op, clock in self.known.get()) if due and self.known.exists() else Known()
        last, out, new = self.last.get()[0] if self.last.exists() else None, [], []
        for at, op, user, parents in due:
            if last is not None and at - last > self.idle:
                known, new = Known(), []
                self.known.clear()
            clock, conflicts = applied(known, user, json.loads(parents), self.ids)
            known.add(op, clock)
            new.append((op, json.dumps(clock)))
            last = at
            out.append((key[0], op, user, json.dumps(clock, sort_keys=True), conflicts))
        if due:
            self.known.appendList(new)
            self.last.update((last,))
            self.waiting.put(rest) if rest else self.waiting.clear()
        if last is not None and not rest and passed > last + self.idle:
            self.known.clear()
            self.last.clear()
        self._wake(self._times(rest))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "id", "user", "clock", "conflicts"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            named = frame[["at", "id", "user", "parents"]].itertuples(index=False, name=None)
            self.waiting.appendList([(at, op, user, json.dumps([int(p) for p in parents])) for at, op, user, parents in named])
        yield from self._applied(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._applied(key, timerValues)

    def close(self) -> None:
        pass


def _operations(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, "ts", F.col("id").cast("long").alias("id"), F.col("user").cast("string").alias("user"), F.coalesce(F.col("parents").cast("array<long>"), F.array().cast("array<long>")).alias("parents"), (F.unix_micros("ts") / 1e6).alias("at"))


def live_operations(rows: DataFrame, key: str, idle: float = 1800.0, delay: str = "10 minutes", ids: bool = True) -> DataFrame:
    """A stream of (``key``, id, user, clock as JSON, conflicts) of each operation once the watermark has passed it.
    Conflicts are the operations' ids, or their number alone: the ids of a busy resource grow with its square.

    ``rows``: ``key``, id (long), user, ts, parents (ids of operations of the resource). Operations of one time go by id.
    """
    ship_package(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    timed = _operations(rows.withWatermark("ts", delay), key)
    return timed.groupBy(key).transformWithStateInPandas(Operations(key, idle, ids), f"{key} {kind}, id long, user string, clock string, conflicts {'array<long>' if ids else 'int'}", "Append", "EventTime")


def operations_fold(rows: DataFrame, key: str, idle: float = 1800.0) -> DataFrame:
    """What ``live_operations`` gives in the end, over a table."""

    def step(state: dict, values: tuple) -> tuple:
        at, op, user, parents = values
        if state["last"] is not None and at - state["last"] > idle:
            state["known"] = Known()
        clock, conflicts = applied(state["known"], user, [int(p) for p in parents])
        state["known"].add(op, clock)
        state["last"] = at
        return json.dumps(clock, sort_keys=True), conflicts

    out = ordered_fold(_operations(rows, key).drop("ts"), key, ["at", "id"], lambda: {"known": Known(), "last": None}, step, ["at", "id", "user", "parents"], "clock string, conflicts array<long>")
    return out.select(key, "id", "user", "clock", "conflicts")


def run_in_batches(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Runs a stream over all that is there now, its state in RocksDB; its rows with the number of their micro-batch."""
    spark, path = stream.sparkSession, f"{folder}/{name}"
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKSDB)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/part={number}")  # a batch done again writes the same

    mode = "update" if "expired" in stream.columns else "append"
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch long").parquet(f"{path}/part=*")


def latest(rows: DataFrame, key: str) -> DataFrame:
    """Of each key its rows of the last micro-batch."""
    others = [c for c in rows.columns if c not in (key, "batch")]
    # a session that a batch both touches and ends has two rows there: the end comes last
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct("batch", "expired")).alias("_r"))
    return best.select(key, "_r.*")
