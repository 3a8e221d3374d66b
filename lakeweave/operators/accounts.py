"""Rows that callers ask for about buyers, memories, jobs and assets: histories, profiles, inserts, recommendations, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector
from ..functions.money import to_credits
from . import audit, enforcement
from .stateful import ordered_fold


def transaction_history(moves: DataFrame, user: str, order: list[str], cents: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of each user's wallet moves, newest first, in credits: amount, balance_before and balance_after.

    The balances are running sums over all of a user's moves; users are the unit of work, as a wallet is one sequence.
    """
    up = Window.partitionBy(user).orderBy(*order)
    after = F.sum(cents).over(up.rowsBetween(Window.unboundedPreceding, 0))
    down = Window.partitionBy(user).orderBy(*(F.desc(c) for c in order))
    rows = moves.withColumns({"_after": after, "_n": F.row_number().over(down)}).where((F.col("_n") > offset) & (F.col("_n") <= offset + limit))
    before = F.col("_after") - F.col(cents)
    return rows.withColumns({"amount": to_credits(F.col(cents)), "balance_before": to_credits(before), "balance_after": to_credits(F.col("_after"))}).drop("_after", "_n")


def buyer_profiles(orders: DataFrame, buyer: str, order: list[str], price: str, latest: int = 20) -> DataFrame:
    """Of each buyer's latest orders: how many and what they cost together (a null price counts 0); reputation is 0.8."""
    w = Window.partitionBy(buyer).orderBy(*(F.desc(c) for c in order))
    newest = orders.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= latest)
    return newest.groupBy(buyer).agg(F.count(F.lit(1)).alias("total_count"), F.coalesce(F.sum(price), F.lit(0.0)).alias("total_spent"), F.lit(0.8).alias("reputation"))


def recommendations(assets: DataFrame, asset: str, name: str, quality: str, price: str, limit: int = 10) -> DataFrame:
    """The assets on sale of the highest quality (ties by asset): asset, name, relevance, price, reason."""
    best = assets.where(F.col("on_sale")).orderBy(F.desc(quality), asset).limit(limit)
    return best.select(F.col(asset).alias("asset"), F.col(name).alias("name"), F.col(quality).alias("relevance"), F.col(price).alias("price"), F.lit("high quality").alias("reason"))


def usage_stats(accesses: DataFrame, transaction: str, rows: str, fingerprint: str, ts: str) -> DataFrame:
    """Of each transaction: accesses, rows read together, distinct queries and the time of the last access."""
    return accesses.groupBy(transaction).agg(
        F.count(F.lit(1)).alias("total_accesses"), F.sum(F.coalesce(rows, F.lit(0))).alias("total_rows"), F.countDistinct(fingerprint).alias("unique_queries"), F.max(ts).alias("last_access")
    )


def quality_profile(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Five parts for each ``key``: completeness (share of values that are there), accuracy 0.8, timeliness 0.9, consistency
    (share of rows whose fields are there as in most rows of the key), uniqueness (share of distinct rows)."""
    there = F.concat_ws("", *(F.when(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == ""), "0").otherwise("1") for f in fields))
    marked = rows.select(key, there.alias("_there"), F.xxhash64(*fields).alias("_row"))
    shapes = marked.groupBy(key, "_there").agg(F.count(F.lit(1)).alias("_n"))
    by_key = shapes.groupBy(key).agg(F.sum("_n").alias("n"), F.max("_n").alias("_most"), F.sum(F.col("_n") * F.length(F.replace("_there", F.lit("0"), F.lit("")))).alias("_filled"))
    distinct = marked.groupBy(key).agg(F.countDistinct("_row").alias("_distinct"))
    out = by_key.join(distinct, key)
    return out.select(key, (F.col("_filled") / (F.col("n") * len(fields))).alias("completeness"), F.lit(0.8).alias("accuracy"), F.lit(0.9).alias("timeliness"), (F.col("_most") / F.col("n")).alias("consistency"), (F.col("_distinct") / F.col("n")).alias("uniqueness"))


def recorded_accesses(accesses: DataFrame, grants: DataFrame) -> DataFrame:
    """Of each access all that is kept about it: fingerprint, complexity, compliance, flags, risk and the response to it.

    ``accesses``: transaction, purpose, method, query, ts, size_bytes, rows, frequency, gap_s, growth; ``grants`` as in
    ``enforcement.compliance``.
    """
    out = enforcement.compliance(accesses, grants)
    flags = enforcement.anomaly_flags(F.col("frequency"), F.col("query"), F.col("size_bytes"), F.col("violations"), F.col("gap_s"), F.col("growth"))
    out = out.withColumns({"fingerprint": audit.fingerprint(F.col("query")), "complexity": audit.query_complexity(F.col("query")), "flags": flags})
    out = out.withColumn("risk", audit.access_risk(F.col("frequency"), F.col("size_bytes"), F.col("rows"), F.size("violations"), F.size("flags")))
    severity = F.when(F.size("violations") > 1, "high").when(F.size("violations") > 0, "medium").otherwise("low")
    return out.withColumn("response", enforcement.response(F.col("risk"), severity))


def with_recommendations(summaries: DataFrame, accesses: str, risk: str, violations: str) -> DataFrame:
    """Audit summaries with their risk level and what is advised."""
    advice = F.array(F.when(F.col(risk) > 0.5, "review the access policy"), F.when(F.col(violations) > 0, F.concat(F.lit("handle "), F.col(violations).cast("string"), F.lit(" violations"))), F.when(F.col(accesses) > 1000, "check for misuse"))
    return summaries.withColumns({"level": audit.risk_level(F.col(risk)), "advice": F.array_compact(advice)})


def adaptive_window(rows: DataFrame, key: str, order: list[str], at: str, load: str, start: int = 100, window: float = 60.0, least: int = 10, most: int = 1000) -> DataFrame:
    """allowed and limit: each request first adapts its key's limit (10 % down under load over 70, else up; whole numbers),
    then is held against the admitted requests in the window before it. Both are one fold, as each decides the next."""

    def step(state: dict, values: tuple) -> tuple:
        now, busy = values
        state["limit"] = max(least, min(most, int(state["limit"] * (0.9 if busy > 70 else 1.1))))
        log = [t for t in state["log"] if t > now - window]
        allowed = len(log) < state["limit"]
        state["log"] = [*log, now] if allowed else log
        return allowed, state["limit"]

    return ordered_fold(rows, key, order, lambda: {"limit": start, "log": []}, step, [at, load], "allowed boolean, limit int")


def new_memories(writes: DataFrame, memory: str, user: str, content: str, dimensions: int = 64, importance: int = 5) -> DataFrame:
    """Rows of memories to append: defaults where the write leaves something out (kind fact, ``importance``), its words' hashed
    vector brought to ``dimensions`` places, and the vector's model in the context. A write without content gets no vector."""
    words = F.filter(F.split(F.lower(F.coalesce(content, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    embedding = F.when(F.size(words) > 0, vector.resized(vector.hashed_words(words, dimensions), dimensions))
    context = F.when(F.size(words) > 0, F.create_map(F.lit("embedding_model"), F.lit("hashed-words"))).otherwise(F.create_map().cast("map<string,string>"))
    return writes.select(memory, user, content, F.coalesce("kind", F.lit("fact")).alias("kind"), F.coalesce("importance", F.lit(importance)).cast("int").alias("importance"), context.alias("context"), "expires_at", embedding.alias("embedding"))


def loaded_transactions(asked: DataFrame, transactions: DataFrame, as_of: str) -> DataFrame:
    """``asked`` (transaction, buyer) with the transaction's other columns: those of that buyer, active and not expired."""
    t = F.lit(as_of).cast("timestamp_ntz")
    live = transactions.where((F.col("status") == "active") & (F.col("valid_until").isNull() | (F.col("valid_until") >= t)))
    return asked.join(live, ["transaction", "buyer"])


def negotiated_cents(agreed: Column) -> Column:
    """An agreed price in whole cents, cut and not rounded."""
    return F.floor((agreed.cast("decimal(28,6)") * 100)).cast("long")


def orders_of_holdings(holdings: DataFrame, listings: DataFrame) -> DataFrame:
    """Orders (order, listing, title, seller, purchased_at) derived from what buyers hold."""
    return holdings.join(listings, "listing").select("buyer", "order", "listing", "title", F.concat(F.lit("seller-"), F.substring(F.sha2(F.col("seller").cast("string"), 256), 1, 8)).alias("seller"), "purchased_at")


def job_status(asked: DataFrame, jobs: DataFrame, queue: DataFrame) -> DataFrame:
    """Of each asked job (job): its stored status and its queue's (PENDING where the queue doesn't know it), or an error."""
    out = asked.join(jobs, "job", "left").join(queue.select("job", F.col("state").alias("queue_state")), "job", "left")
    known = F.col("status").isNotNull()
    return out.select("job", "status", F.when(known, F.coalesce("queue_state", F.lit("PENDING"))).alias("queue_status"), F.when(~known, "not found").alias("error"))


def anonymization_needs(samples: DataFrame, sensitivity: Column, fields: Column) -> DataFrame:
    """``samples`` with the level that their sensitivity asks for and what speaks for it: fields that name a person, and two
    or more that hint at one."""
    direct, quasi = (F.array(*map(F.lit, names)) for names in (("name", "email", "phone", "id", "ssn"), ("age", "gender", "zip", "location")))
    factors = F.array(F.when(F.arrays_overlap(fields, direct), "direct identifiers"), F.when(F.size(F.array_intersect(fields, quasi)) >= 2, "several quasi-identifiers"))
    return samples.withColumns({"level": audit.anonymized_level(sensitivity), "factors": F.array_compact(factors)})


def mechanisms(goals: DataFrame) -> DataFrame:
    """Of each goal (target_price, preferred, first, risk_level, review): trade is direct whatever is preferred; approval is
    asked for a review, a price over 10,000, a first transaction or a high risk."""
    asked = F.coalesce("review", F.lit(False)) | F.coalesce(F.col("target_price") > 10_000, F.lit(False)) | F.coalesce("first", F.lit(False)) | F.coalesce(F.col("risk_level") == "high", F.lit(False))
    downgraded = ~F.coalesce(F.col("preferred").isin("auto", "direct"), F.lit(True))
    return goals.withColumns({"mechanism": F.lit("direct"), "approval": asked, "downgraded": downgraded})


def merged_small(contents: Column, least: int = 400) -> Column:
    """A text's chunks in order, each joined to the one before by a line end while that one has under ``least`` characters."""

    def add(done: Column, chunk: Column) -> Column:
        n = F.size(done)
        last = F.element_at(done, F.greatest(n, F.lit(1)))
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n"), chunk)))
        return F.when(n == 0, F.array(chunk)).when(F.length(last) < least, joined).otherwise(F.array_append(done, chunk))

    return F.aggregate(contents, F.array().cast("array<string>"), add)
