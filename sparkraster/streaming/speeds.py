"""Learned throughput: an exponentially weighted average per key, in batch and as a stream.

The average is a weighted sum: with weight a for the newest sample, the sample that has d newer ones
counts a * (1-a)^d, and the very first one also gets the remaining (1-a)^n. Only ranks and sums are
needed, so no task ever folds one key's samples in order, however many there are.
"""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ranking import bucketed_row_number

# Weight of the newest sample, shortest sample, smallest file sample, default rates per second.
ALPHA = 0.3
MIN_SECONDS = 0.05
MIN_FILE_BYTES = 1 << 20
DEFAULTS = {"bytes": 1e6, "chunks": 2.0 / 60, "tiles": 10.0, "tilebytes": 25_000.0}


def admit(samples: DataFrame, file_samples: bool = False) -> DataFrame:
    """Samples worth learning from, with value = amount per second."""
    ok = (F.col("seconds") > MIN_SECONDS) & (F.col("amount") > 0)
    if file_samples:
        ok = ok & (F.col("amount") >= MIN_FILE_BYTES)
    return samples.filter(ok).withColumn("value", F.col("amount") / F.col("seconds")).filter("value > 0")


def fold(samples: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """key, value, n, updated after all samples (key, value, ts, seq), starting from ``state`` if given."""
    ranked = bucketed_row_number(samples.select("key", "value", "ts", "seq"), ["key"], [F.col("ts").desc(), F.col("seq").desc()],
                                 F.date_trunc("minute", "ts"), "_r", descending=True)
    new = ranked.groupBy("key").agg(F.expr(f"sum({ALPHA}D * pow({1 - ALPHA}D, _r - 1) * value) AS _sum"), F.count("*").alias("_n"),
                                    F.expr("min_by(value, struct(ts, seq)) AS _first"), F.max("ts").alias("_ts"))
    old = state if state is not None else new.selectExpr("key", "double(NULL) AS value", "0L AS n", "_ts AS updated").filter("false")
    return (new.join(old, "key", "full")
            .selectExpr("key", f"if(_n IS NULL, value, _sum + pow({1 - ALPHA}D, _n) * coalesce(value, _first)) AS value",
                        "coalesce(n, 0L) + coalesce(_n, 0L) AS n", "coalesce(_ts, updated) AS updated"))


def rates(wanted: DataFrame, state: DataFrame, run_start: Column, default: float | None = None) -> DataFrame:
    """key -> rate and basis. 'measured' needs a sample from this run; an older value is still the better guess."""
    kind = F.split("key", ":").getItem(0)
    fallback = F.lit(default) if default is not None else F.coalesce(
        *[F.when(kind == k, F.lit(v)) for k, v in DEFAULTS.items()], F.lit(1.0))
    return (wanted.join(state.select("key", "value", "updated"), "key", "left")
            .select("key", F.coalesce("value", fallback).alias("rate"),
                    F.when(F.col("updated") >= run_start, F.lit("measured")).otherwise(F.lit("default")).alias("basis")))


def learn_stream(samples: DataFrame, state_dir: str, checkpoint: str) -> StreamingQuery:
    """Fold a stream of samples into state tables, one version per micro-batch below ``state_dir``.

    A batch reads the version before it and overwrites its own, so a repeated batch gives the same
    state. Samples are ordered within their batch; a sample that comes late counts on arrival.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(os.path.join(state_dir, f"v{batch_id - 1}")) if batch_id > 0 else None
        fold(admit(batch), before).write.mode("overwrite").parquet(os.path.join(state_dir, f"v{batch_id}"))
    return (samples.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
