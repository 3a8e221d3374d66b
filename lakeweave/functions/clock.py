"""Vector clocks as maps from actor to sequence number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def increment(clock: Column, actor: Column) -> Column:
    """One more at the actor's key."""
    now = F.coalesce(F.try_element_at(clock, actor), F.lit(0).cast("long"))
    return F.map_concat(F.map_filter(clock, lambda k, v: k != actor), F.create_map(actor, now + 1))


def merge(a: Column, b: Column) -> Column:
    """The greater number of each actor."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(F.coalesce(x, F.lit(0).cast("long")), F.coalesce(y, F.lit(0).cast("long"))))


def _at_most(a: Column, b: Column) -> Column:
    return F.forall(F.map_entries(a), lambda e: e["value"] <= F.coalesce(F.try_element_at(b, e["key"]), F.lit(0).cast("long")))


def compare(a: Column, b: Column) -> Column:
    """-1: a is before b; 1: after; 0: equal or concurrent."""
    low, high = _at_most(a, b), _at_most(b, a)
    return F.when(low & ~high, -1).when(high & ~low, 1).otherwise(0)


def causality(a: Column, b: Column) -> Column:
    c = compare(a, b)
    return F.when(c < 0, "before").when(c > 0, "after").otherwise("concurrent")
