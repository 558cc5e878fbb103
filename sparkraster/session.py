"""Session defaults and the shared scratch folder."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution splits skewed join partitions and coalesces small ones, so the shuffle
    partition count is only an upper bound; on a cluster leave it at a few times the core count.
    """
    b = (SparkSession.builder.master(master).appName("sparkraster")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
         .config("spark.ui.enabled", "false"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, visible to every executor.

    Only a local master may fall back to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return os.path.join(base, f"{purpose}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame, purpose: str) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and read it back.

    A lost executor then re-reads files instead of recomputing the whole plan behind ``df``.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop_written(*tables: DataFrame | None) -> None:
    """Delete tables of ``cut_lineage`` once their successors are written; nothing may read them later. Other DataFrames are left alone."""
    for t in tables:
        path = getattr(t, "_written_to", None)
        if path is not None:
            sc = t.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that must not be broadcast: its rows are exploded from, or as many as, those of a caller's table.

    The planner takes the size of an exploded table for that of the file behind it, and would pass all of it through the driver.
    """
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Deal a table that comes in fewer splits than there are cores over all of them.

    Only meant ahead of work that multiplies rows; a table of many splits is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Hash ``df`` over all shuffle partitions ahead of work that multiplies its rows by hundreds.

    Narrow pairs look small to adaptive coalescing, which sizes tasks by bytes, not by what they become.
    Dealing by pair also spreads the pairs of one hot area or raster.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
