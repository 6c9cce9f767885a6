"""Operators on the order of keys that work without bringing all rows into one task.

Rows are dealt into ranges of keys, written once to the shared folder so that the ranges stay as they are, worked on
range by range, and what crosses from one range into the next is carried by a table with a row for each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise

PART = "__part"


def ranges(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """``df`` with the number of its key range in PART: all keys of a range come before those of the next."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def neighbours(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``next_key`` and ``prev_key`` of each row in the order of ``key``."""
    dealt = ranges(df, [key])
    # one row for each range, so the windows over them are small
    ends = dealt.groupBy(PART).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    alone = Window.orderBy(PART)
    ends = ends.select(PART, F.lead("lo").over(alone).alias("__after"), F.lag("hi").over(alone).alias("__before"))
    w = Window.partitionBy(PART).orderBy(key)
    return (
        dealt.join(F.broadcast(ends), PART)
        .withColumn("next_key", F.coalesce(F.lead(key).over(w), F.col("__after")))
        .withColumn("prev_key", F.coalesce(F.lag(key).over(w), F.col("__before")))
        .drop(PART, "__after", "__before")
    )


def nearest(df: DataFrame, probes: DataFrame, key: str, probe: str) -> DataFrame:
    """For each row of ``probes``: ``next_key``, the smallest key strictly greater than ``probe``, and ``prev_key``, the
    greatest strictly less; null where there is none. Probe and key have one type; probes may be absent from ``df``."""
    keys = df.select(F.col(key).alias("__k"), F.lit(True).alias("__own"), F.lit(None).cast(_struct(probes)).alias("__row"))
    asked = probes.select(F.col(probe).alias("__k"), F.lit(False).alias("__own"), F.struct(*probes.columns).alias("__row"))
    dealt = ranges(keys.unionByName(asked), ["__k"])
    own = F.when(F.col("__own"), F.col("__k"))
    ends = dealt.groupBy(PART).agg(F.min(own).alias("lo"), F.max(own).alias("hi"))
    under = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(PART, F.last("hi", ignorenulls=True).over(under).alias("__before"), F.last("lo", ignorenulls=True).over(over).alias("__after"))
    # a probe sorts before an equal key when looking down, and likewise when looking up
    down = Window.partitionBy(PART).orderBy("__k", "__own").rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy(PART).orderBy(F.desc("__k"), "__own").rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.join(F.broadcast(ends), PART)
        .withColumn("prev_key", F.coalesce(F.last(own, ignorenulls=True).over(down), F.col("__before")))
        .withColumn("next_key", F.coalesce(F.last(own, ignorenulls=True).over(up), F.col("__after")))
        .where(~F.col("__own"))
        .select("__row.*", "next_key", "prev_key")
    )


def _struct(df: DataFrame) -> str:
    return f"struct<{','.join(f'`{n}`:{t}' for n, t in df.dtypes)}>"


def ranked(df: DataFrame, key: str, *, ascending: bool = True, into: str = "rank") -> DataFrame:
    """``df`` with each row's place (from 1) in the order of ``key``: counts by range, then places within a range."""
    order = F.col(key).asc() if ascending else F.col(key).desc()
    dealt = ranges(df, [order])
    counts = dealt.groupBy(PART).agg(F.count("*").alias("__n"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(PART, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    w = Window.partitionBy(PART).orderBy(order)
    return dealt.join(F.broadcast(counts), PART).withColumn(into, (F.row_number().over(w) + F.col("__offset")).cast("long")).drop(PART, "__offset")


def append_keys(df: DataFrame, wanted: str, tie: str, *, after: int | None = None, into: str = "key") -> DataFrame:
    """Free integer keys for an append log: each row gets ``wanted`` or, if earlier rows took it, the next free one.

    Rows come in the order of (``wanted``, ``tie``), nulls last: a row that wants none gets the next free one. With r the row's place, its key is r + the running maximum of
    wanted - r: what trying wanted, wanted + 1, ... one row after the other would give. ``after``: the greatest key
    that the log holds already.
    """
    last = [f for c in (wanted, tie) for f in (F.col(c).isNull().alias(f"{c}_null"), F.col(c))]
    dealt = ranked(df.withColumn("__o", F.struct(*last)), "__o", into="__r").withColumn("__d", F.col(wanted) - F.col("__r"))
    dealt = ranges(dealt, ["__r"])
    tops = dealt.groupBy(PART).agg(F.max("__d").alias("__top"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(PART, F.max("__top").over(before).alias("__carry"))
    w = Window.partitionBy(PART).orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)
    floor = F.lit(after).cast("long") if after is not None else F.lit(None).cast("long")
    shift = F.greatest(F.max("__d").over(w), F.col("__carry"), floor)
    return dealt.join(F.broadcast(tops), PART).withColumn(into, (shift + F.col("__r")).cast("long")).drop(PART, "__r", "__d", "__o", "__carry")
