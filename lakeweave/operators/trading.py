"""Purchases, transfers and versions as deterministic folds over ordered requests; counters derived from their rows.

Money is whole cents. A purchase is settled in two steps: each buyer's requests are folded in order (a listing that the
buyer already holds is returned without a charge, a request that would overdraw is refused), then the accepted ones
become ledger rows. A seller's income is there from the next run on, so that no two buyers' folds depend on each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import fee
from .stateful import ordered_fold


def purchases(requests: DataFrame, order: list[str], start_cents: int) -> DataFrame:
    """``requests`` (buyer, listing, seller, cents, ...) with status and the buyer's balance after each.

    status: bought; held (bought before, no charge); own (the buyer's own listing); short (balance too low).
    """

    def step(state: dict, values: tuple) -> tuple:
        buyer, listing, seller, cents = values
        if buyer == seller:
            return "own", state["balance"]
        if listing in state["held"]:
            return "held", state["balance"]
        if cents > state["balance"]:
            return "short", state["balance"]
        state["held"].add(listing)
        state["balance"] -= cents
        return "bought", state["balance"]

    return ordered_fold(requests, "buyer", order, lambda: {"balance": start_cents, "held": set()}, step, ["buyer", "listing", "seller", "cents"], "status string, balance long")


def ledger(settled: DataFrame) -> DataFrame:
    """(account, listing, kind, cents) rows of bought requests: the buyer's debit, the seller's income, the fee; they sum to 0."""
    bought = settled.where(F.col("status") == "bought")
    part = fee(F.col("cents"))
    rows = F.array(
        F.struct(F.col("buyer").alias("account"), F.lit("purchase").alias("kind"), (-F.col("cents")).alias("cents")),
        F.struct(F.col("seller").alias("account"), F.lit("sale").alias("kind"), (F.col("cents") - part).alias("cents")),
        F.struct(F.lit(None).cast(settled.schema["buyer"].dataType).alias("account"), F.lit("fee").alias("kind"), part.alias("cents")),
    )
    return bought.select("listing", F.inline(rows))


def transfers(moves: DataFrame) -> DataFrame:
    """Two ledger rows (account, other, cents) for each move (src, dst, cents) between different accounts of a positive sum."""
    ok = moves.where("src <> dst AND cents > 0")
    rows = F.array(F.struct(F.col("src").alias("account"), F.col("dst").alias("other"), (-F.col("cents")).alias("delta")), F.struct(F.col("dst").alias("account"), F.col("src").alias("other"), F.col("cents").alias("delta")))
    return ok.select(F.inline(rows)).withColumnRenamed("delta", "cents")


def open_wallets(wallets: DataFrame, accounts: DataFrame, start_cents: int) -> DataFrame:
    """Wallets (account, cents) and a new one for every account that has none; those that are there don't change."""
    new = accounts.select("account").distinct().join(wallets, "account", "left_anti")
    return wallets.unionByName(new.withColumn("cents", F.lit(start_cents).cast("long")))


def listing_stats(settled: DataFrame) -> DataFrame:
    """Purchases and revenue of each listing, derived from the settled requests instead of counted up in place."""
    bought = F.col("status") == "bought"
    return settled.groupBy("listing").agg(F.count_if(bought).alias("purchases"), F.sum(F.when(bought, F.col("cents")).otherwise(0)).alias("revenue"))


def wallet_stats(settled: DataFrame) -> DataFrame:
    """Of each account: purchases and spending, sales and income."""
    bought = settled.where(F.col("status") == "bought")
    out = bought.select(F.col("buyer").alias("account"), F.lit(1).alias("b"), F.lit(0).alias("s"), F.col("cents").alias("spent"), F.lit(0).cast("long").alias("income"))
    come = bought.select(F.col("seller").alias("account"), F.lit(0).alias("b"), F.lit(1).alias("s"), F.lit(0).cast("long").alias("spent"), (F.col("cents") - fee(F.col("cents"))).alias("income"))
    return out.unionByName(come).groupBy("account").agg(F.sum("b").alias("purchases"), F.sum("s").alias("sales"), F.sum("spent").alias("spent"), F.sum("income").alias("income"))


def purchased_content(holdings: DataFrame, orders: DataFrame, listings: DataFrame) -> DataFrame:
    """Holdings with the delivered payload where the order grants viewing; accesses are counted by rows of ``holdings``."""
    seen = holdings.groupBy("user", "order", "listing").agg(F.count(F.lit(1)).alias("accesses"))
    viewed = orders.where(F.array_contains("rights", "view")).select("order", "payload")
    return seen.join(viewed, "order").join(listings.select("listing", "title"), "listing")


def compare_and_append(events: DataFrame, session: str, order: list[str], expected: str) -> DataFrame:
    """accepted and version: an event is appended only if it expects the session's current version."""

    def step(state: dict, values: tuple) -> tuple:
        ok = values[0] == state["version"]
        state["version"] += 1 if ok else 0
        return ok, state["version"]

    return ordered_fold(events, session, order, lambda: {"version": 0}, step, [expected], "accepted boolean, version long")
