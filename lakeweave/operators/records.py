"""Rows that services write and read: listings, holdings, grants, sessions, messages, decisions, previews, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Most characters of a listing's fields, and the least and greatest price in credits.
TITLE_MOST, SUMMARY_MOST, EXCERPT_MOST = 255, 600, 300
LEAST_PRICE, GREATEST_PRICE = 0.05, 500.0
PREVIEW_MOST = 1200


def newest(rows: DataFrame, *order: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of rows, newest first."""
    out = rows.orderBy(*(F.desc(c) for c in order)).offset(offset)
    return out if limit is None else out.limit(limit)


def newest_of(rows: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """Of each key the ``limit`` newest rows, with their rank."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def previews(documents: DataFrame, title: Column, text: str, most: int = PREVIEW_MOST) -> DataFrame:
    """Documents with a title (``Untitled`` where blank) and the first ``most`` characters as preview."""
    named = F.when(F.coalesce(F.trim(title), F.lit("")) == "", "Untitled").otherwise(title)
    return documents.withColumn("title", named).withColumn("preview", F.substring(F.coalesce(F.col(text), F.lit("")), 1, most))


def from_payload(events: DataFrame, payload: str, fields: dict[str, str]) -> DataFrame:
    """Events with fields read from their JSON payload; null where missing or not valid."""
    return events.withColumns({name: F.get_json_object(payload, f"$.{path}") for name, path in fields.items()})


def listing_rows(assets: DataFrame, title: Column, summary: Column, price: Column) -> DataFrame:
    """Listings to insert: fields cut to their most characters, the price held to its range and in whole cents (half up)."""
    held = F.greatest(F.lit(LEAST_PRICE), F.least(F.lit(GREATEST_PRICE), price))
    return assets.withColumns({"title": F.substring(title, 1, TITLE_MOST), "summary": F.substring(summary, 1, SUMMARY_MOST), "cents": F.round(held * 100).cast("long"), "status": F.lit("active")})


def public_listing(listings: DataFrame, private: tuple[str, ...] = ("delivery", "seller")) -> DataFrame:
    """A listing as others see it: no private fields, the price in credits, an excerpt of the summary."""
    out = listings.drop(*private).withColumn("credits", F.col("cents") / 100)
    return out.withColumn("excerpt", F.substring("summary", 1, EXCERPT_MOST))


def access_counts(holdings: DataFrame, accesses: DataFrame, key: str, ts: str) -> DataFrame:
    """Holdings after accesses: downloads counted, and the time of the last."""
    new = accesses.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max(ts).alias("_last"))
    out = holdings.join(new, key, "left")
    return out.withColumn("downloads", F.col("downloads") + F.coalesce("_n", F.lit(0))).withColumn("last_access", F.coalesce(F.greatest("last_access", "_last"), "last_access", "_last")).drop("_n", "_last")


def grants(orders: DataFrame, start: str, days: Column) -> DataFrame:
    """A rights transaction for each order: active from ``start`` for some days."""
    return orders.withColumn("valid_from", F.col(start)).withColumn("valid_until", F.col(start) + F.make_dt_interval(days)).withColumn("status", F.lit("ACTIVE"))


def negotiated_cents(credits: Column) -> Column:
    """Agreed prices are cut to whole cents, not rounded."""
    return F.floor(credits * 100 + 1e-9).cast("long")


def settings_after(current: DataFrame, changes: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """Settings after changes: of each field the last value that isn't null."""
    last = changes.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f"_{f}") for f in fields))
    out = current.join(last, key, "left")
    return out.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*(f"_{f}" for f in fields))


def sessions_after(messages: DataFrame, session: str, order: list[str], role: str) -> DataFrame:
    """Sessions as their messages make them: messages, system events among them, first and last message."""
    return messages.groupBy(session).agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col(role) == "system").alias("events"), *(F.min(o).alias(f"first_{o}") for o in order), *(F.max(o).alias(f"last_{o}") for o in order))


def without_sessions(rows: DataFrame, deleted: DataFrame, session: str) -> DataFrame:
    """Rows of any table of a session after sessions were deleted: a cascade is this on each table."""
    return rows.join(deleted.select(session).distinct(), session, "left_anti")


def preference(asked: DataFrame, preferences: DataFrame, keys: list[str], default: str) -> DataFrame:
    """The value of each asked key (JSON strings without their quotes), or a default."""
    value = F.when(F.col("value").rlike('^".*"$'), F.expr("substring(value, 2, length(value) - 2)")).otherwise(F.col("value"))
    return asked.join(preferences.select(*keys, value.alias("value")), keys, "left").withColumn("value", F.coalesce("value", F.lit(default)))


def profile(users: DataFrame, preferences: DataFrame, memories: DataFrame, user: str, most: int = 5) -> DataFrame:
    """Of each user: preferences by type, and the ``most`` memories of greatest importance."""
    kinds = preferences.groupBy(user, "kind").agg(F.count(F.lit(1)).alias("n")).groupBy(user).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("preferences"))
    w = Window.partitionBy(user).orderBy(F.desc("importance"), "memory")
    top = memories.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).groupBy(user).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "memory"))), lambda x: x["memory"]).alias("memories"))
    return users.join(kinds, user, "left").join(top, user, "left")


def layers(short: DataFrame, long: DataFrame, session: str, order: str, most: int) -> DataFrame:
    """Prompt rows of each session: its newest short-term messages, filled up from older long-term ones; ``most`` in all,
    oldest first. A message in both layers counts once, as short-term."""
    both = short.withColumn("layer", F.lit(0)).unionByName(long.join(short.select(session, order), [session, order], "left_anti").withColumn("layer", F.lit(1)))
    w = Window.partitionBy(session).orderBy("layer", F.desc(order))
    kept = both.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(order)))


def exported(documents: DataFrame, space: str) -> DataFrame:
    """Documents of each space as one JSON row a document, with how many there are."""
    body = F.to_json(F.struct(*(c for c in documents.columns if c != space)))
    return documents.select(space, body.alias("document"))


def older_than(files: DataFrame, modified: str, as_of: str, days: int) -> DataFrame:
    """Files to clean up: last modified more than ``days`` before ``as_of``."""
    return files.where(F.col(modified) < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def candidate_models(*names: str | None) -> list[str]:
    """Model names to try, in order, each once."""
    return list(dict.fromkeys(n.strip() for n in names if n and n.strip()))


def child_path(parent: Column, name: Column) -> Column:
    """The path of a folder: its parent's (the root where null) and its name."""
    return F.concat(F.when(F.coalesce(parent, F.lit("/")) == "/", "/").otherwise(F.concat(F.rtrim(parent, F.lit("/")), F.lit("/"))), name)


def elapsed_days(start: Column, end: Column) -> Column:
    """Days with their fraction."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 86_400_000_000.0


def snowflake(ts: Column, worker: Column, sequence: Column, epoch_ms: int = 1_704_067_200_000) -> Column:
    """Time-ordered ids: 41 bits of milliseconds since an epoch, 10 of the worker, 12 of a sequence number."""
    ms = F.unix_millis(ts.cast("timestamp")) - epoch_ms
    return F.shiftleft(ms, 22).bitwiseOR(F.shiftleft(F.pmod(worker, F.lit(1024)).cast("long"), 12)).bitwiseOR(F.pmod(sequence, F.lit(4096)).cast("long"))


def same_keys_share(records: DataFrame, record: str, order: str) -> DataFrame:
    """The share of records (maps) with the same keys as the first by ``order``. One row is broadcast."""
    keys = records.select(F.col(order), F.array_sort(F.map_keys(record)).alias("_k"))
    first = keys.agg(F.min_by("_k", order).alias("_first"))
    return keys.crossJoin(F.broadcast(first)).agg((F.count_if(F.col("_k") == F.col("_first")) / F.count(F.lit(1))).alias("consistency"))


def clusters(assets: DataFrame, category: str, member: str) -> DataFrame:
    """Categories with their number of assets and the least and greatest member; members stay rows of ``assets``."""
    return assets.groupBy(category).agg(F.count(F.lit(1)).alias("size"), F.min(member).alias("first_member"), F.max(member).alias("last_member"))
