"""Order, carried values, runs and places over keys; every order has a last key that makes it total."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.shared import fixed


def place(rows: DataFrame, order: str) -> DataFrame:
    """rows with their place, from 0, in a total order over the whole table: ranges are dealt out, counted and shifted, so that no task sorts all rows."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id())
    dealt = fixed(dealt)  # as another run may choose other ranges
    local = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(order)))
    before, start = 0, []
    for part, n in sorted(local.groupBy("__part").count().collect()):  # one number a range
        start.append((part, before))
        before += n
    shifts = rows.sparkSession.createDataFrame(start or [(0, 0)], "__part int, __shift long")
    return local.join(F.broadcast(shifts), "__part").withColumn("place", F.col("__n") - 1 + F.col("__shift")).drop("__part", "__n", "__shift")


#: A key with more rows than this has its rows dealt to several tasks.
MOST = 5_000_000


def hot(rows: DataFrame, by: str, most: int) -> bool:
    """Whether a key has more rows than a task should sort; counts are combined before they are dealt out."""
    if most in (0, sys.maxsize):  # known already
        return most == 0
    return (rows.groupBy(by).count().agg(F.max("count")).first()[0] or 0) > most


def ranges(rows: DataFrame, by: str, order: tuple[str, ...]) -> DataFrame:
    """rows with __part, ranges of (key, order): a key's rows lie in neighbouring ranges, in order. Fixed, as another run may choose other ranges."""
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return fixed(rows.repartitionByRange(parts, by, *order).withColumn("__part", F.spark_partition_id()))


def over_ranges(rows: DataFrame, by: str, order: tuple[str, ...], local: Column, summary: Column, carry, join, name: str) -> DataFrame:
    """A running value over keys of any size: it is computed inside each range, each range's summary is carried over the ranges of its key, and both are joined.

    local: over the window w of a range; summary: an aggregate of a key's rows in a range; carry: from the summary's column to
    an expression over the earlier ranges; join: from (local, carried) to the value.
    """
    dealt = ranges(rows, by, order)
    inner = Window.partitionBy("__part", by).orderBy(*order)
    sums = dealt.groupBy("__part", F.col(by).alias("__by")).agg(summary.alias("__s"))
    before = Window.partitionBy("__by").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried_ = sums.select(F.col("__part").alias("__p"), "__by", carry(F.col("__s")).over(before).alias("__c"))
    out = dealt.withColumn("__l", local(inner)).join(carried_, (F.col("__part") == F.col("__p")) & F.col(by).eqNullSafe(F.col("__by")), "left")
    return out.withColumn(name, join(F.col("__l"), F.col("__c"))).drop("__part", "__p", "__by", "__l", "__c")


def previous(rows: DataFrame, value: str, by: str, *order: str, name: str = "previous", most: int = MOST) -> DataFrame:
    """The value of the row before, of the same key."""
    if not hot(rows, by, most):
        return rows.withColumn(name, F.lag(value).over(Window.partitionBy(by).orderBy(*order)))
    boxed = F.struct(F.col(value).alias("v"))
    out = over_ranges(rows, by, order, lambda w: F.lag(boxed).over(w), F.max_by(boxed, F.struct(*order)), lambda s: F.last(s, ignorenulls=True), F.coalesce, "__b")
    return out.withColumn(name, F.col("__b.v")).drop("__b")


def running_sum(rows: DataFrame, value: Column, by: str, *order: str, name: str, most: int = MOST) -> DataFrame:
    """The sum of a whole number up to each row."""
    value = value.cast("long")
    if not hot(rows, by, most):
        return rows.withColumn(name, F.sum(value).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return over_ranges(rows, by, order, lambda w: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum(value), F.sum, lambda a, c: a + F.coalesce(c, F.lit(0)), name)


def nearest_preceding(rows: DataFrame, is_anchor: Column, value: Column, by: str, *order: str, name: str = "nearest", most: int = MOST) -> DataFrame:
    """The last anchor's value at or before each row; an anchor's null counts as its value."""
    boxed = F.when(is_anchor, F.struct(value.alias("v")))
    last = lambda c: F.last(c, ignorenulls=True)
    if not hot(rows, by, most):
        return rows.withColumn(name, last(boxed).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))["v"])
    keyed = F.max_by(boxed, F.when(boxed.isNotNull(), F.struct(*order)))
    out = over_ranges(rows, by, order, lambda w: last(boxed).over(w.rowsBetween(Window.unboundedPreceding, 0)), keyed, last, F.coalesce, "__b")
    return out.withColumn(name, F.col("__b.v")).drop("__b")


def carried(rows: DataFrame, heading: Column, value: Column, by: str, *order: str, name: str = "carried", most: int = MOST) -> DataFrame:
    """The value of the last heading at or before each row; a heading with a null value resets it, which last() with ignored nulls alone would not."""
    return nearest_preceding(rows, heading, value, by, *order, name=name, most=most)


def gap_runs(rows: DataFrame, time: str, seconds: int, by: str, *order: str, name: str = "run", most: int = MOST) -> DataFrame:
    """A number for each run in which neighbours are at most `seconds` apart."""
    timed = rows.withColumn("__t", F.col(time).cast("timestamp").cast("double"))
    most = 0 if hot(rows, by, most) else sys.maxsize  # keys are counted once for both steps
    before = previous(timed, "__t", by, *order, name="__before", most=most)
    starts = F.coalesce(F.col("__t") - F.col("__before") > seconds, F.lit(True))
    return running_sum(before, starts.cast("int"), by, *order, name=name, most=most).drop("__t", "__before")


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key, the first in order. An aggregate, so that rows of one key are combined before they are dealt out."""
    cols = rows.columns
    picked = rows.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("__r"))
    return picked.select("__r.*")
