"""Progress fan-in and stall alerts as streams."""
from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.jobs import STALL_S


def latest_fractions(events: DataFrame) -> DataFrame:
    """(job_id, tile) -> newest reported fraction; batch or stream."""
    return (events.filter("frac IS NOT NULL").groupBy("job_id", "tile")
            .agg(F.expr("max_by(frac, struct(ts, seq)) AS frac"), F.max("n_tiles").alias("n_tiles"), F.expr("max(struct(ts, seq)) AS at")))


def overall(latest: DataFrame) -> DataFrame:
    """job_id -> mean over all tiles; tiles that have not reported count as zero."""
    return latest.groupBy("job_id").agg(F.expr("sum(frac) / max(n_tiles)").alias("progress"), F.count("*").alias("reported"))


def fan_in_stream(events: DataFrame, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Write changed (job, tile) fractions of each micro-batch to their own folder; repeats overwrite."""
    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch={batch_id}"))
    return (latest_fractions(events).writeStream.outputMode("update").foreachBatch(step)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current(updates: DataFrame) -> DataFrame:
    """Newest row per (job, tile) from the folders written by ``fan_in_stream``."""
    return updates.groupBy("job_id", "tile").agg(F.max_by(F.struct("frac", "n_tiles"), "at").alias("_m")).select("job_id", "tile", "_m.*")


class _Stall(StatefulProcessor):
    """Remembers a job's last update and fires when a running job gets no other for STALL_S seconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint, seq bigint, running boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ms, seq, running = max((int(r.ms), int(r.seq), bool(r.running)) for pdf in rows for r in pdf[["ms", "seq", "running"]].sort_values(["ms", "seq"]).tail(1).itertuples())
        if self.last.exists():
            old = self.last.get()
            if (ms, seq) <= (old[0], old[1]):
                return iter(())
            if old[2]:
                self.handle.deleteTimer(old[0] + STALL_S * 1000)
        self.last.update((ms, seq, running))
        if running:
            self.handle.registerTimer(ms + STALL_S * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            last = self.last.get()
            if last[2] and expiredTimerInfo.getExpiryTimeInMs() == last[0] + STALL_S * 1000:
                yield pd.DataFrame({"job_id": [key[0]], "last_ms": [last[0]]})

    def close(self) -> None:
        pass


def stall_alerts(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Stream of (job_id, last_ms): running jobs whose last update lies STALL_S before the watermark.

    ``events`` is (job_id, ts, seq, status); the newest event tells whether a job still runs, and the end of a job cancels its timer.
    Only the newest event is kept per job, so a busy job needs no more state than a quiet one.
    """
    timed = (events.select("job_id", F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("bigint").alias("seq"), (F.col("status") == "running").alias("running"))
             .withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts")))
    return timed.groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=_Stall(), outputStructType="job_id bigint, last_ms bigint", outputMode="Append", timeMode="EventTime")


def alert_stream(events: DataFrame, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Starts the alerts. Timers need the RocksDB state store; the session's own choice is put back once the query has started."""
    conf, name = events.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return (stall_alerts(events).writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
    finally:
        conf.set(name, before)
