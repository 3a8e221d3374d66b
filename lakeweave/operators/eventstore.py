"""An append-only event store: valid events, sequence numbers, clocks, snapshots and states replayed from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Event types that a store takes, and the payload fields that some of them need.
EVENT_TYPES = (
    "INITIATE", "ANNOUNCE", "BID", "OFFER", "COUNTER", "ACCEPT", "REJECT", "WITHDRAW", "CEILING_SET", "FLOOR_SET", "AGREEMENT", "SETTLE", "TIMEOUT",
    "DATA_ASSET_REGISTER", "DATA_RIGHTS_NEGOTIATION_INIT", "DATA_RIGHTS_GRANT", "DATA_RIGHTS_COUNTER", "USAGE_SCOPE_DEFINE", "COMPUTATION_AGREEMENT",
    "DATA_ACCESS_AUDIT", "POLICY_VIOLATION", "RIGHTS_REVOKE",
)
NEEDS_PRICE = ("BID", "OFFER", "COUNTER")
SNAPSHOT_EVERY = 50


def checked(events: DataFrame, kind: str, price: str) -> DataFrame:
    """Events with ``problem``: an unknown type, or a missing or negative price where one is needed; null for valid ones."""
    bad_price = F.col(kind).isin(*NEEDS_PRICE) & (F.col(price).isNull() | (F.col(price) < 0))
    known = F.coalesce(F.col(kind).isin(*EVENT_TYPES), F.lit(False))
    return events.withColumn("problem", F.when(~known, "unknown_type").when(bad_price, "invalid_payload"))


def sequenced(events: DataFrame, session: str, actor: str, order: list[str]) -> DataFrame:
    """Adds each event's number in its session, and its clock: how many events of its actor and of its session there are
    up to it."""
    w = Window.partitionBy(session).orderBy(*order)
    mine = Window.partitionBy(session, actor).orderBy(*order)
    out = events.withColumn("sequence", F.row_number().over(w)).withColumn("_n", F.row_number().over(mine))
    return out.withColumn("clock", F.create_map(F.col(actor).cast("string"), F.col("_n"), F.lit("session"), F.col("sequence"))).drop("_n")


def in_range(events: DataFrame, start: int = 1, end: int | None = None, kinds: list[str] | None = None, kind: str = "event_type") -> DataFrame:
    """Events of a range of sequence numbers, and of some types."""
    out = events.where(F.col("sequence") >= start)
    if end is not None:
        out = out.where(F.col("sequence") <= end)
    return out.where(F.col(kind).isin(*kinds)) if kinds else out


def next_sequence(events: DataFrame, session: str) -> DataFrame:
    return events.groupBy(session).agg((F.max("sequence") + 1).alias("next"))


def snapshots(events: DataFrame, session: str, value: Column, every: int = SNAPSHOT_EVERY) -> DataFrame:
    """The running state of each session after every ``every`` events: version, events, total and last value."""
    w = Window.partitionBy(session).orderBy("sequence")
    running = events.select(session, "sequence", F.sum(value).over(w).alias("total"), value.alias("last"))
    return running.where(F.col("sequence") % every == 0).select(session, F.col("sequence").alias("version"), "total", "last")


def latest_snapshot(taken: DataFrame, session: str) -> DataFrame:
    best = F.max_by(F.struct(*(c for c in taken.columns if c != session)), "version")
    return taken.groupBy(session).agg(best.alias("_s")).select(session, "_s.*")


def replayed(events: DataFrame, taken: DataFrame, session: str, value: Column) -> DataFrame:
    """Each session's state from its latest snapshot and the events after it; what lies before isn't read into it."""
    base = latest_snapshot(taken, session).select(session, "version", F.col("total").alias("_t"), F.col("last").alias("_l"))
    after = events.join(base, session, "left").where(F.col("sequence") > F.coalesce("version", F.lit(0)))
    add = after.groupBy(session).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"), F.max_by(value, "sequence").alias("_last"))
    out = base.join(add, session, "full")
    return out.select(session, (F.coalesce("version", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("version"), (F.coalesce("_t", F.lit(0.0)) + F.coalesce("_s", F.lit(0.0))).alias("total"), F.coalesce("_last", "_l").alias("last"), F.coalesce("_n", F.lit(0)).alias("replayed"))


def executed_bids(bids: DataFrame, session: str, window: Column, priority: str, order: list[str], price: str, actor: str) -> DataFrame:
    """Bids in the order in which a moderator takes them: those that wait together (``window``) by priority, highest first,
    then by ``order``. Adds their place, whether a bid wins when it is taken, and the highest price then."""
    w = Window.partitionBy(session).orderBy(window, F.desc(priority), *order)
    before = F.max(price).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = bids.withColumn("place", F.row_number().over(w)).withColumn("winning", before.isNull() | (F.col(price) > before))
    return out.withColumn("highest", F.max(price).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def rejections(requests: DataFrame, actor: str, kind: str, seconds: Column, rejected: Column, window: int = 60) -> DataFrame:
    """Of every request: its actor's requests and rejections of its kind in the ``window`` seconds up to it."""
    w = Window.partitionBy(actor, kind).orderBy("_s").rangeBetween(-window, 0)
    timed = requests.withColumn("_s", seconds)
    return timed.withColumn("requests", F.count(F.lit(1)).over(w)).withColumn("rejections", F.count_if(rejected).over(w)).drop("_s")


def slow_share(calls: DataFrame, key: str, order: list[str], slow: Column, least: int = 10, share: float = 0.5) -> DataFrame:
    """Of every call: calls and slow calls of its key so far, and whether the breaker opens for slowness: over ``least``
    calls, at least ``share`` of them slow."""
    w = Window.partitionBy(key).orderBy(*order)
    out = calls.withColumn("calls", F.count(F.lit(1)).over(w)).withColumn("slow_calls", F.count_if(slow).over(w))
    return out.withColumn("opens", (F.col("calls") > least) & (F.col("slow_calls") >= share * F.col("calls")))


def recent_history(events: DataFrame, session: str, fields: list[str], most: int = 5) -> DataFrame:
    """Each session's state as JSON: its version and its last ``most`` events, oldest first."""
    w = Window.partitionBy(session).orderBy(F.desc("sequence"))
    last = events.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
    packed = F.array_sort(F.collect_list(F.struct("sequence", *fields)))
    return last.groupBy(session).agg(F.to_json(F.struct(F.max("sequence").alias("version"), packed.alias("history"))).alias("state"))
