"""Ranks, neighbours and top-k inside keys of any size.

A window over one key runs in one task, which a key holding much of the table would not survive. The
functions here cut a key into ordered buckets first (a coarse, monotone function of the order, such as
the hour), rank inside the buckets, and join the totals of the buckets before.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_row_number(df: DataFrame, keys: list[str], order: list, bucket: Column, out: str = "rn", descending: bool = False) -> DataFrame:
    """``row_number`` over keys. ``bucket`` must not decrease along ``order`` (not increase if descending)."""
    df = df.withColumn("_b", bucket)
    by = F.col("_b").desc() if descending else F.col("_b").asc()
    sizes = df.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    return df.join(before, [*keys, "_b"]).withColumn(out, local + F.col("_before")).drop("_b", "_before")


def bucketed_lag(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, out: str) -> DataFrame:
    """Previous ``value`` along ascending ``order`` over keys; bucket edges come from a per-bucket summary."""
    df = df.withColumn("_b", bucket)
    last = df.groupBy(*keys, "_b").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_l"))
    prev = last.withColumn("_prev", F.lag("_l").over(Window.partitionBy(*keys).orderBy("_b"))).drop("_l")
    w = Window.partitionBy(*keys, "_b").orderBy(*order)
    return (df.join(prev, [*keys, "_b"])
            .withColumn("_in", F.lag(F.struct(F.col(value).alias("v"))).over(w))
            .withColumn(out, F.coalesce("_in", "_prev").getField("v")).drop("_b", "_prev", "_in"))


def top_k(df: DataFrame, keys: list[str], order: list, k: int, shares: int = 1024, out: str = "rn") -> DataFrame:
    """First k rows of every key. Shares of a key are cut to k rows each before they meet, so the
    final window sees at most shares * k rows of a key, and the result is exact."""
    share = F.pmod(F.xxhash64(*df.columns), F.lit(shares))
    part = (df.withColumn("_s", share)
            .withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(*order))).filter(F.col("_r") <= k))
    return (part.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .filter(F.col(out) <= k).drop("_s", "_r"))


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """key -> the element at position n div 2 of the sorted values, from counts per distinct value.

    Values are counted in buckets of one unit first; only the bucket that holds the position is ranked value by value.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n")).withColumn("_b", F.floor(value))
    w = Window.partitionBy(key)
    sizes = counts.groupBy(key, "_b").agg(F.sum("_n").alias("_m"))
    at = (sizes.withColumn("_upto", F.sum("_m").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_half", F.expr("sum(_m) OVER (PARTITION BY " + f"`{key}`" + ") div 2"))
          .filter("_upto > _half").groupBy(key).agg(F.min_by(F.struct("_b", (F.col("_upto") - F.col("_m")).alias("_before"), "_half"), "_b").alias("_x")).select(key, "_x.*"))
    run = counts.join(at, [key, "_b"]).withColumn("_cum", F.col("_before") + F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    return run.filter("_cum > _half").groupBy(key).agg(F.min(value).alias("median"))
