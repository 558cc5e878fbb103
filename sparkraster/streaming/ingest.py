"""Incremental ingest of library files and the decoder hook."""
from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StreamingQuery

FILE_COLUMNS = ["path", "length", "modificationTime"]
PIECE = 1 << 20  # pixels a task of ``decode`` holds before it hands them on, but for the last raster


def file_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """New files below a folder as rows; contents are not read unless selected."""
    return (spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
            .schema("path string, modificationTime timestamp, length bigint, content binary").load(folder).select(*FILE_COLUMNS))


def ingest_stream(files: DataFrame, out_dir: str, checkpoint: str, describe: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Append each batch's files (after ``describe``) to the item table; a repeated batch overwrites itself."""
    def step(batch: DataFrame, batch_id: int) -> None:
        rows = describe(batch) if describe else batch
        rows.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch={batch_id}"))
    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def library_items(spark: SparkSession, out_dir: str) -> DataFrame:
    """Newest version of every ingested file."""
    rows = spark.read.parquet(out_dir)
    return rows.groupBy("path").agg(F.max_by(F.struct("length", "modificationTime"), "modificationTime").alias("_f")).select("path", "_f.*")


def rescan(listing: DataFrame, stored: DataFrame | None, describe: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stored file table brought up to date with a listing (path, modificationTime, length and what ``describe`` needs).

    Files that are listed as they are stored keep their row; new and changed files are described; files that are no longer listed go. Products
    are grouped over the whole table afterwards, so an index file that arrives after its files, or goes, is taken into account.
    """
    same = ["path", "modificationTime", "length"]
    if stored is None:
        return describe(listing)
    kept = stored.join(listing.select(*same), same, "left_semi").select(*stored.columns)
    return kept.unionByName(describe(listing.join(stored.select(*same), same, "left_anti")))


def decode(files: DataFrame, decoder: Callable[[bytes], dict], key: str = "item_id", content: str = "content") -> DataFrame:
    """Rasters from file contents by a caller's decoder, batch by batch.

    ``decoder(bytes)`` gives width, height, dtype and bands (a list of flat sequences), or None for a
    file it cannot read; such files are skipped and do not fail the scan. Files are read one by one and
    rasters leave in batches of about ``PIECE`` pixels, however many files a batch of the input holds.
    """
    schema = pa.schema([(key, to_arrow_type(files.schema[key].dataType)), ("width", pa.int32()), ("height", pa.int32()), ("dtype", pa.string()),
                        ("bands", pa.list_(pa.list_(pa.float32())))])

    def piece(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type, from_pandas=True) for i, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, pixels = [], 0
        for b in batches:
            for k, data in zip(*b.columns):
                got = decoder(data.as_py())
                if got is None:
                    continue
                out.append((k.as_py(), got["width"], got["height"], got["dtype"], [np.asarray(x, np.float32) for x in got["bands"]]))
                pixels += sum(len(x) for x in out[-1][4])
                if pixels >= PIECE:
                    yield piece(out)
                    out, pixels = [], 0
        if out:
            yield piece(out)
    return files.select(key, content).mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, width int, height int, dtype string, bands array<array<float>>")
