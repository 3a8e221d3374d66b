"""Money as integer cents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FEE_PERCENT = 5
YIELD_RATES = {"conservative": 0.03, "balanced": 0.08, "aggressive": 0.15}
DAYS_IN_YEAR = 365


def to_cents(credits: Column) -> Column:
    """Half-up at two places."""
    return F.round(credits * 100).cast("long")


def to_credits(cents: Column) -> Column:
    return F.round(cents / 100, 2)


def fee(cents: Column) -> Column:
    """The platform's share, truncated to cents."""
    return (cents * FEE_PERCENT / 100).cast("long")


def simple_interest(cents: Column, rate: Column, days: Column) -> Column:
    """Yield on a balance for a number of days, truncated to cents; nothing on balances of zero or less."""
    return F.when(cents > 0, (cents * rate * days / DAYS_IN_YEAR).cast("long")).otherwise(F.lit(0).cast("long"))


def repriced(cents: Column, demand: Column) -> Column:
    """Up 3% at a demand of 10 or more, down 1% at 2 or less, one cent at least."""
    factor = F.when(demand >= 10, F.lit(1.03)).when(demand <= 2, F.lit(0.99)).otherwise(F.lit(1.0))
    return F.greatest(F.lit(1).cast("long"), (cents * factor).cast("long"))


def model_cost(prompt_tokens: Column, completion_tokens: Column, prompt_price: Column, completion_price: Column) -> Column:
    """Prices are for 1,000 tokens."""
    return prompt_tokens / 1000 * prompt_price + completion_tokens / 1000 * completion_price
