"""Invariants of keyed rows, as queries that give the violations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that stand on more than one row, with ``n``."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def null_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    test = F.lit(False)
    for c in key:
        test = test | F.col(c).isNull()
    return df.where(test)


def key_report(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: rows, keys, rows that repeat an earlier key, rows with a null key; partial counts by key, one pass."""
    nulls = F.lit(False)
    for c in key:
        nulls = nulls | F.col(c).isNull()
    by_key = df.groupBy(*key).agg(F.count("*").alias("n"), F.sum(nulls.cast("int")).alias("z"))
    n = F.coalesce(F.sum("n"), F.lit(0))
    return by_key.agg(n.cast("long").alias("n_rows"), F.count("*").alias("n_keys"), (n - F.count("*")).cast("long").alias("n_repeated"), F.coalesce(F.sum("z"), F.lit(0)).cast("long").alias("n_null"))


def range_statistics(df: DataFrame, key: str, width: int) -> DataFrame:
    """For each stretch of ``width`` integer keys: rows, least and greatest key."""
    return df.groupBy(F.floor(F.col(key) / width).cast("long").alias("bucket")).agg(F.count("*").alias("n_rows"), F.min(key).alias("min_key"), F.max(key).alias("max_key"))
