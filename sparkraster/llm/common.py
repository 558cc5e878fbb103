"""Helpers the training-data operators share."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text (maximal runs of characters that are not white space); null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to differ from all columns of ``df``, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it and wherever the optimizer moves the whole."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_shingles(df: DataFrame, text: Column, size: int, name: str) -> DataFrame:
    """Adds ``name``, 64-bit hashes of all runs of ``size`` words; a shorter text is one run, an empty one has none.

    The word hashes are a column of their own first: inside the lambda an expression would be evaluated for every run.
    """
    d = df.withColumn("_h", F.transform(words(text), lambda x: F.xxhash64(x))).withColumn("_n", F.size("_h"))
    runs = F.transform(F.sequence(F.lit(1), F.col("_n") - size + 1), lambda i: F.xxhash64(*[F.element_at("_h", i + k) for k in range(size)]))
    return d.withColumn(name, F.when(F.col("_n") >= size, runs).when(F.col("_n") > 0, F.array(F.xxhash64("_h"))).otherwise(F.array().cast("array<bigint>"))).drop("_h", "_n")
