"""Joins that Spark has no operator for, as compositions: as-of, point-in-interval, first row of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, *values: str) -> DataFrame:
    """Each left row with the values of the last right row of its keys at or before its time; null if there is none.

    Both sides are laid end to end and read in time order: one shuffle on the keys, no pairs. Of right rows at one time
    the greatest values count.
    """
    packed = F.struct(*values)
    own = [c for c in left.columns if c not in keys and c != ts]
    a = left.select(*keys, ts, F.struct(*own).alias("_row"), F.lit(None).cast(right.select(packed.alias("x")).schema["x"].dataType).alias("_value"), F.lit(1).alias("_side"))
    b = right.select(*keys, ts, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), packed.alias("_value"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy(ts, "_side", F.asc_nulls_first("_value")).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_found", F.last("_value", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*keys, ts, "_row.*", "_found.*")


def within(starts: DataFrame, points: DataFrame, keys: list[str], start: str, ts: str, seconds: int) -> DataFrame:
    """Pairs of equal keys with the point 0 to ``seconds`` after the start.

    Time is cut into bins of that length: a point can only meet starts of its own bin and the one before, so the join is
    on keys and bin and makes a bounded multiple of the result.
    """
    bin_of = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds)
    a = starts.withColumn("_bin", F.explode(F.array(bin_of(start), bin_of(start) + 1)))
    b = points.withColumn("_bin", bin_of(ts))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))
    return a.join(b, [*keys, "_bin"]).where((gap >= 0) & (gap <= seconds * 1_000_000)).drop("_bin")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
